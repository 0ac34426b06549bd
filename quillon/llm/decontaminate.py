"""Benchmark decontamination by suffix arrays over the training texts.

Each task cuts its documents into shards of about BLOCK_BYTES. A shard's words become numbers (a word that no benchmark item
has is 0, which never matches), and its suffixes that begin with a known word are sorted to the depth of a window. Every
test suffix is then binary-searched in every shard: the range it bounds holds all places where its window occurs verbatim.
A text's longest match grows along its hits: of each place in the items that the window before held, the next word's place is held on.
So a passage that many texts and many items share costs, at a time, its places in the items and not their pairs with its places in the texts. No document leaves its task, so
nothing is shuffled; a frequent passage is a wide range of one shard's array and costs what it covers.

Test items pass the driver in slices of at most SLICE words (or one item), each broadcast by itself and held by a worker by itself; what all slices take is the items' own size, on disk.

Defined cases: null or empty texts have no words and no hits; an item without words has no window; one shorter than the
window is a window by itself; items with the same id count once, null ids not at all in the list but their hits count;
repeated documents are treated one by one; of equally long matches the first in the text counts, then the smallest item id (null last), then the first in the item; a very long text is a shard
by itself; no other column is read unless it is kept, and kept ones have any name; an empty table of documents gives an empty result, of items no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import blocks, carried, documents, raw
from quillon.sharing import Shared

WINDOW = 10
SLICE = 1_000_000
#: Bytes that end a word (ASCII other than letters and digits) become a space, and A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Suite:
    """The windows of some test items, numbered by the words of these items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.names = [name for name, _ in items]
        for item, (_, text) in enumerate(items):
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text]
            for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
                found.setdefault(tuple(numbers[at : at + window]), []).append((item, at))
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = min(window, 63 // self.bits)
        self.depth = window
        keys = -(-window // self.per_key)
        self.length = np.array([len(w) for w in found], np.int64)
        self.low, self.high = (np.zeros((len(found), keys), np.int64) for _ in range(2))
        for row, w in enumerate(found):
            for k in range(keys):
                for part, pad in ((self.low, 0), (self.high, (1 << self.bits) - 1)):
                    value = 0
                    for j in range(k * self.per_key, (k + 1) * self.per_key):
                        value = value << self.bits | (w[j] if j < len(w) else pad)
                    part[row, k] = value
        self.first = np.cumsum([0, *map(len, found.values())])
        # Places as numbers that count on through an item and leave one out between items.
        starts = np.cumsum([0, *(len(text) + 1 for _, text in items)])
        self.starts = starts[:-1]
        self.places = np.array([starts[item] + at for v in found.values() for item, at in v], np.int64)
        # The order of items by name, in which ties are settled.
        self.order = np.empty(len(items), np.int64)
        self.order[sorted(range(len(items)), key=lambda i: (self.names[i] is None, self.names[i] or ""))] = np.arange(len(items))

    def items_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class SuffixArray:
    """Suffixes of a sequence of word numbers, sorted by their first `depth` words."""

    def __init__(self, sequence: np.ndarray, bits: int, per_key: int, depth: int):
        n, self.step = len(sequence), per_key
        padded = np.concatenate([sequence, np.zeros(depth + 2 * per_key, np.int64)])
        self.key = np.zeros(n + depth + per_key, np.int64)
        for j in range(per_key):
            self.key <<= bits
            self.key |= padded[j : j + len(self.key)]
        self.order = np.flatnonzero(sequence)
        self.order = self.order[np.argsort(self.key[self.order], kind="stable")]
        new = np.ones(len(self.order), bool)
        new[1:] = np.diff(self.key[self.order]) != 0
        for done in range(per_key, depth, per_key):
            group = np.cumsum(new)
            alone = new & np.append(new[1:], True)
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            after = self.key[self.order[slots] + done]
            sort = np.lexsort((after, group[slots]))
            self.order[slots] = self.order[slots[sort]]
            after = after[sort]
            new[slots[1:]] |= after[1:] != after[:-1]

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of packed words, the range of suffixes from low to high, by binary search word group by word group."""
        begin, end = np.zeros(len(low), np.int64), np.full(len(low), len(self.order))
        for k in range(low.shape[1]):
            begin, end = self._search(begin, end, low[:, k], k, False), self._search(begin, end, high[:, k], k, True)
        return begin, end

    def _search(self, begin, end, value, k, after_equal):
        begin, end = begin.copy(), end.copy()
        while len(live := np.flatnonzero(begin < end)):
            middle = (begin[live] + end[live]) >> 1
            key = self.key[self.order[middle] + k * self.step]
            right = key <= value[live] if after_equal else key < value[live]
            begin[live[right]] = middle[right] + 1
            end[live[~right]] = middle[~right]
        return begin


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[i], ..., end[i] - 1 for each i, one after the other."""
    sizes = end - begin
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def longest_of(suite: Suite, at: np.ndarray, window: np.ndarray) -> tuple[int, str | None, int, int]:
    """Words, item, begin in the text and begin in the item of the longest match of one text, from its hits in order of place. Windows of several lengths may begin at one place."""
    best, key = (0, None, 0, 0), None
    for length in np.unique(suite.length[window]):
        own = suite.length[window] == length
        before, begins, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -2
        for a, w in zip(at[own].tolist(), window[own].tolist(), strict=True):
            places = suite.places[suite.first[w] : suite.first[w + 1]]
            started = np.full(len(places), a)
            if a == last + 1 and len(before):
                i = np.minimum(np.searchsorted(before, places - 1), len(before) - 1)
                started = np.where(before[i] == places - 1, begins[i], a)
            before, begins, last = places, started, a
            size = a + int(length) - started
            if size.max() >= best[0]:
                for i in np.flatnonzero(size == size.max()).tolist():
                    item = int(suite.items_of(places[i]))
                    mine = (-int(size[i]), int(started[i]), int(suite.order[item]), int(places[i] - suite.starts[item]) - (a - int(started[i])))
                    if key is None or mine < key:
                        key = mine
                        best = (int(size[i]), suite.names[item], mine[1], mine[3])
    return best


def search(texts: list[list[bytes]], suites: Iterator[Suite]) -> tuple[np.ndarray, list[set], list[tuple]]:
    """For each text: how many of its words are hit, the ids of items that occur, and its longest match (words, item id, word in the text, word in the item)."""
    sizes = np.array([len(w) + 1 for w in texts], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    hit = np.zeros(total + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    longest: list[tuple] = [(0, None, None, None)] * len(texts)
    for suite in suites:
        sequence = np.fromiter((n for w in texts for n in (*map(suite.vocabulary.get, w, repeat(0)), 0)), np.int64, total)
        array = SuffixArray(sequence, suite.bits, suite.per_key, suite.depth)
        begin, end = array.bounds(suite.low, suite.high)
        at = array.order[ranges(begin, end)]
        if not len(at):
            continue
        window = np.repeat(np.arange(len(begin)), end - begin)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + suite.length[window], -1)
        sort = np.argsort(at, kind="stable")
        at, window = at[sort], window[sort]
        text = np.searchsorted(ends, at, "right")
        for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(text)) + 1):
            t = int(text[rows[0]])
            held = np.zeros(len(suite.names), bool)
            for w in np.unique(window[rows]):
                held[suite.items_of(suite.places[suite.first[w] : suite.first[w + 1]])] = True
            items[t] |= {suite.names[i] for i in np.flatnonzero(held).tolist()} - {None}
            n, name, begin, item_begin = longest_of(suite, at[rows], window[rows])
            found = (n, name, int(begin - ends[t] + sizes[t]), item_begin)
            rank = lambda m: (-m[0], m[2], m[1] is None, m[1] or "", m[3])
            if longest[t][0] == 0 or rank(found) < rank(longest[t]):
                longest[t] = found
    marked = np.cumsum(hit[:-1]) > 0
    counts = np.add.reduceat(marked, ends - sizes) if total else np.zeros(0, np.int64)
    return counts, items, longest


def suites(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", most: int = SLICE) -> list:
    """Broadcasts of the test items, each of at most `most` words or one item."""
    out, held, size = [], [], 0
    for row in benchmark.select(F.col(key).cast("string"), F.encode(text, "UTF-8")).toLocalIterator():
        found = words(bytes(row[1] or b""))
        if held and size + len(found) > most:
            out.append(Shared(spark, Suite(held, window)))
            held, size = [], 0
        held.append((row[0], found))
        size += len(found)
    return [*out, Shared(spark, Suite(held, window))] if held else out


FIELDS = "n_words long, n_hit long, n_items long, items array<string>, longest long, longest_item string, longest_at long, longest_item_at long"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep: bool = False, most: int = SLICE) -> DataFrame:
    """What of the test items each document holds; with keep, beside the document's own columns, in place of its key alone."""
    tests = suites(docs.sparkSession, benchmark, window, most=most)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    given = docs.columns if keep else [key]
    frame, own, at = carried(docs, given, text)
    schema = ", ".join(f"{o} {frame.schema[o].dataType.simpleString()}" for o in own) + ", " + FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, at):
            texts = [words(x) for x in raw(table.column(at))]
            n_hit, items, longest = search(texts, (b.value(keep=len(tests) == 1) for b in tests))
            sort = [sorted(x) for x in items]
            columns = [pa.array([len(w) for w in texts], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in sort], pa.int64()), pa.array(sort, pa.list_(pa.string()))]
            columns += [pa.array([x[i] for x in longest], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield from pa.table([*(table.column(o) for o in own), *columns], [*own, *names]).to_batches()

    found = frame.mapInArrow(run, schema)
    return found.select(*(F.col(o).alias(c) for c, o in zip(given, own, strict=True)), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_item", "longest_at", "longest_item_at")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS n, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
bp AS (SELECT item_id, i - 1 AS j, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS n, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
runs AS (SELECT doc_id, item_id, j - i AS diagonal, i, j, n, i - row_number() OVER (PARTITION BY doc_id, item_id, n, j - i ORDER BY i) AS island FROM dw JOIN bp USING (n, g)),
long AS (SELECT doc_id, item_id::VARCHAR AS item, min(i) - 1 AS at, min(j) AS item_at, count(*) + any_value(n) - 1 AS words FROM runs GROUP BY doc_id, item_id, n, diagonal, island),
best AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, at, item, item_at) = 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
coalesce(best.words, 0)::BIGINT AS longest, best.item AS longest_item, best.at::BIGINT AS longest_at, best.item_at::BIGINT AS longest_item_at
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)"""

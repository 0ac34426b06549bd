"""Sum-of-squares packing of token sequences.

Each text is tokenized and ended by id 0; texts longer than the capacity are cut into whole pieces and a rest. A piece goes
to the open bin for which the sum, over residual gaps, of the squared counts of open bins with that gap becomes smallest.
Pieces are kept in the shared folder, so that a lost executor costs no second tokenization, and dealt by a hash of their row's number into
groups of about GROUP pieces, whatever they hold, packed one group a task, larger pieces first. Whole pieces fill a sequence each and stay out of this.

Words are tokenized once and looked up later: the tokenizer splits at white space, and its normalizer never joins across it.
The tokenizer's special tokens, where a text spells them, are the ids that they have in its file.

Defined cases: a null or empty text is the single id 0; a very long text is looked up a stretch at a time and held whole only as its ids; repeated rows are packed one by one, and which
of them gets which place does not show; ties go to the smallest gap left, then to a new bin; document ids of any type, null too, stay as they are; no other column is read; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import blocks, cut, documents, raw, remembered

CAPACITY = 2048
GROUP = 16384
#: Distinct words that a worker process remembers, over all its tasks; beyond it, it forgets those met once and goes on. It changes no result.
WORDS = 400_000
#: ASCII punctuation without the apostrophe, which can begin a piece with the letters after it.
PUNCTUATION = """!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""
#: The characters by which byte-level tokenizers write bytes that are not printable (a space stays one).
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
#: Text bytes that are looked up at once.
LOOKUP_BYTES = 4 << 20


def split(text: bytes) -> list[bytes]:
    """Words in lower case, but for those that may hold a special token, which is found by its case."""
    if b"<|" not in text:
        return text.lower().split()
    return [w if b"<|" in w else w.lower() for w in text.split()]


class Encoder:
    """Ids of texts by a tokenizer file that drops white space and case, through a bounded memory of words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.latin = Tokenizer(self.tokenizer.model)
        self.latin.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)  # a word not met before gets the next number
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts, self.sizes, self.uses = (np.zeros(1 << 18, np.int32) for _ in range(3))
        self.filled = 0

    def shrink(self) -> None:
        """Forgets the words met once since the last time, or all, if others are too many."""
        kept = np.flatnonzero(self.uses[: len(self.words)] > 1)
        if len(kept) > WORDS // 2:
            return self.forget()
        words, flat, sizes = list(self.words), self.gathered(kept), self.sizes[kept]
        self.forget()
        self.words.update((words[i], self.words.default_factory()) for i in kept.tolist())
        self._store(np.arange(len(kept)), flat, sizes)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The number of each word; words not met before are learned."""
        if len(self.words) > WORDS:
            self.shrink()
        known = len(self.words)
        out = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        if len(self.words) > known:
            self.learn(known)
        uses = np.bincount(out)
        self.uses[: len(uses)] += uses.astype(np.int32)
        return out

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _store(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.words) > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.starts[numbers] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.filled += len(flat)

    def learn(self, known: int) -> None:
        """Ids of the words numbered from `known`. Letters go to the tokenizer many at a time, parted by where tokens end words; letters before punctuation
        are the ids of both, each learned once; other words go one by one.

        Latin letters go there as the bytes' characters, past the normalizer and the patterns, which would change nothing more."""
        latin, other, rest, joint = ([], [], []), ([], [], []), ([], []), ([], [])
        at = known
        while at < len(self.words):  # what is found to be a part of a word becomes a word
            for number, word in enumerate(list(islice(reversed(self.words), len(self.words) - at))[::-1], at):
                text = word.decode()
                base = text.rstrip(PUNCTUATION)
                if not base.isalpha():
                    rest[0].append(number)
                    rest[1].append(text)
                elif text.isascii() or max(text) < "\u0300" and "\u0130" not in text:
                    if len(base) < len(text):
                        joint[0].append(number)
                        joint[1].extend((self.words[base.encode()], self.words[text[len(base) :].encode()]))
                    else:
                        latin[0].append(number)
                        latin[1].append(text)
                        latin[2].append(1)
                else:
                    other[0].append(number)
                    other[1].append(text)
                    other[2].append(1 + (len(base) < len(text)))
                at = number + 1
        for tokenizer, (numbers, texts, pieces) in ((self.latin, latin), (self.tokenizer, other)):
            for begin in range(0, len(numbers), 2048):
                part, joined = slice(begin, begin + 2048), " ".join(texts[begin : begin + 2048])
                if tokenizer is self.latin:
                    joined = joined.lower().encode().decode("latin-1").translate(BYTE_CHARACTERS)
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                stops, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(pieces[part])
                if len(stops) == last[-1]:
                    self._store(np.array(numbers[part]), ids, np.diff(stops[last - 1], prepend=0))
                else:
                    rest[0].extend(numbers[part])
                    rest[1].extend(texts[part])
        if rest[0]:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(rest[1], add_special_tokens=False)]
            self._store(np.array(rest[0]), np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        if joint[0]:
            parts = np.array(joint[1])
            self._store(np.array(joint[0]), self.gathered(parts), self.sizes[parts].reshape(-1, 2).sum(1))

    def encode(self, text: bytes) -> Iterator[np.ndarray]:
        """Ids of the text, a stretch of about LOOKUP_BYTES at a time."""
        begin = 0
        while begin < len(text):
            end = begin + LOOKUP_BYTES
            if end < len(text):
                end = max(text.rfind(b" ", begin, end), text.rfind(b"\n", begin, end)) + 1 or len(text)
            found = split(text[begin:end])
            begin = end
            yield self.gathered(self.numbers(found))

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Texts are looked up together, about LOOKUP_BYTES at a time."""
        out, held, size = [], [], 0
        for text in texts:
            if held and size + len(text) > LOOKUP_BYTES:
                out += self._together(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        return out + self._together(held) if held else out

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1:
            return [np.concatenate([*self.encode(texts[0]), np.zeros(0, np.uint32)])]
        found = [split(x) for x in texts]
        every = [w for words in found for w in words]
        numbers = self.numbers(every)
        ends = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        return np.split(self.gathered(numbers), ends[np.cumsum([len(x) for x in found])[:-1]])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each text: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema[key].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(tokenizer, lambda: Encoder(tokenizer))  # what it has learned changes no result
        for table in blocks(batches, "t", LOOKUP_BYTES, keep=tokenizer):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, found in enumerate(encoder.encode_all(raw(table.column("t")))):
                ids = np.append(found, 0).astype("<u4")
                for number, begin in enumerate(range(0, len(ids), capacity)):
                    part = ids[begin : begin + capacity]
                    rows.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            taken = table.column("k").combine_chunks().take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(made, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, taken in the order given. Ties go to the smallest gap left, then to a new bin."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; none has gap 0
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill, bins, offsets = [], np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        # Sum of squares after moving a bin from gap g to g - size, less the sum before, halved: count[g - size] - count[g] + 1.
        gain = count[: capacity - size + 1] - count[size:]
        gain[0] = -count[size]  # a full bin counts no more: the change is 1 - 2 count[g]
        change = 2 * gain + 2
        change[0] -= 1
        change[count[size:] == 0] = np.iinfo(np.int64).max
        if size < capacity:
            change[-1] = 2 * count[capacity - size] + 1
        else:
            change[-1] = 0
        rest = int(np.argmin(change))
        gap = rest + size
        if opened[gap]:
            b = opened[gap].pop()
            count[gap] -= 1
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if rest:
            opened[rest].append(b)
            count[rest] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of pieces() with sequence_id (below 0 for whole pieces) and offset."""
    spark = parts.sparkSession
    schema = f"{', '.join(f'`{n}` {t}' for n, t in parts.dtypes)}, sequence_id long, offset long"
    kept = cut(spark, parts.withColumn("row", F.monotonically_increasing_id()))
    short = kept.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))

    def place(table: pa.Table) -> pa.Table:
        # The order of equal lengths is told by contents, not by arrival.
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        ids = bins * groups + table.column("g").to_numpy()
        return table.drop_columns(["row", "g"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = short.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("g").applyInArrow(place, schema)
    whole = kept.where(F.col("length") >= capacity)
    return packed.unionByName(whole.withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).drop("row"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), tokenizer_path()))

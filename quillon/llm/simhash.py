"""SimHash near-duplicate groups through vantage-point trees over Hamming distance.

A fingerprint's bit is the majority of the bit over the XXH64 values of the text's word shingles. Fingerprints that differ
in at most 3 bits are linked. By the pigeonhole principle such a pair differs in at most 1 bit in one of its two halves, so
that each half gets a vantage-point tree of its own, searched with radius 1: a query descends into the inner ball of a
vantage point only if its distance is at most the ball's radius + 1, and into the outer part only if it is more than the
radius - 1. Found pairs are checked on all 64 bits, so that the links are exact.

The upper levels of the trees are built on the driver from a bounded sample of fingerprints and only decide which shard
holds what: a fingerprint goes to its home shard and, as a query, to each shard whose region its ball overlaps. Each shard
builds the rest of the tree and returns, not pairs, but for each linked fingerprint the smallest one of its component
within the shard: at most a row for each fingerprint there. Components across shards come from alternating large-star and
small-star steps on these rows, with the lineage cut after each. Equal fingerprints are one node from the start, so that a
group of copies is one row before anything is compared.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; texts of fewer words than a shingle
are one shingle; repeated rows fall into one group; the id of a group is its smallest non-null doc_id, null if it has none;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import blocks, components, cut, documents, fresh, raw

BITS = 3
SHINGLE = 3
#: Fingerprints aimed at for a shard, and sampled for a leaf of the upper tree.
SHARD = 65536
SAMPLE = 64
#: Leaves of the upper tree at most; shards grow beyond.
LEAVES = 4096
#: Fingerprints that are compared with each other without a tree.
LEAF = 96


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, stops = (ends[: n - shingle + 1] - [len(w) + 1 for w in words[: n - shingle + 1]]).tolist(), (ends[shingle - 1 :] - 1).tolist()
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    values = np.fromiter((h(view[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(values), 65536):
        part = values[begin : begin + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the extra columns and fp, the fingerprint as a signed long."""
    given = [key, *(extra or [])]
    names = ["doc_id", *(extra or [])]
    schema = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, given, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "t"):
            values = np.array([fingerprint(x, shingle) for x in raw(table.column("t"))], np.uint64).view(np.int64)
            yield from pa.table([*(table.column(n) for n in names), pa.array(values)], [*names, "fp"]).to_batches()

    return docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, given, strict=True)), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"{schema}, fp long")


def half(values: np.ndarray, which: int) -> np.ndarray:
    return (values >> np.uint64(32) if which else values & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def vantage(points: np.ndarray) -> tuple[np.uint32, int, np.ndarray] | None:
    """A vantage point, the radius of its inner ball and the points' distances; None if no ball splits the points."""
    for candidate in (points[0], ~points[0], np.uint32(0x55555555), *points[1:: max(1, len(points) // 8)][:8]):
        distance = np.bitwise_count(points ^ candidate).astype(np.int64)
        counts = np.cumsum(np.bincount(distance, minlength=33))
        radius = int(np.argmin(np.abs(counts - len(points) / 2)))
        if 0 < counts[radius] < len(points):
            return np.uint32(candidate), radius, distance
    return None


def plan(points: np.ndarray, leaves: int) -> list:
    """The upper tree as [vantage point, radius, inner, outer], or [] for a leaf."""
    if leaves < 2 or len(points) < 4 or (found := vantage(points)) is None:
        return []
    v, radius, distance = found
    return [v, radius, plan(points[distance <= radius], leaves // 2), plan(points[distance > radius], leaves // 2)]


def route(tree: list, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices of points, whether it is their home) for each leaf of the upper tree."""

    def walk(node, path, index, home):
        if not node:
            yield path, index, home
            return
        v, radius, inner, outer = node
        distance = np.bitwise_count(points[index] ^ v).astype(np.int64)
        near, far = distance <= radius + 1, distance > radius - 1
        yield from walk(inner, 2 * path, index[near], home[near] & (distance[near] <= radius))
        yield from walk(outer, 2 * path + 1, index[far], home[far] & (distance[far] > radius))

    yield from walk(tree, 1, np.arange(len(points)), np.ones(len(points), bool))


def linked(values: np.ndarray, home: np.ndarray, which: int, bits: int = BITS) -> np.ndarray:
    """For each of a shard's fingerprints, the position of the smallest that it is linked to through the shard. home: which are the shard's own."""
    key = half(values, which)
    label = np.arange(len(values))
    left, right, held = [], [], 0

    def settle():
        nonlocal left, right, held, label
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            label = components(len(label), np.concatenate([a, np.arange(len(label))]), np.concatenate([b, label]))
        left, right, held = [], [], 0

    def compare(queries, points):
        nonlocal held
        for q in np.array_split(queries, max(1, len(queries) * len(points) // 4_000_000)):
            a, b = np.nonzero(np.bitwise_count(values[q][:, None] ^ values[points][None, :]) <= bits)
            a, b = q[a], points[b]
            apart = a != b  # queries need not be among the points, so that the number of matches says nothing
            if apart.any():
                left.append(a[apart])
                right.append(b[apart])
                held += int(apart.sum())
        if held > 4_000_000:
            settle()

    stack = [(np.arange(len(values)), np.flatnonzero(home))]
    while stack:
        queries, points = stack.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) <= LEAF or (found := vantage(key[points])) is None:
            compare(queries, points)
            continue
        v, radius, distance = found
        to = np.bitwise_count(key[queries] ^ v).astype(np.int64)
        stack += [(queries[to <= radius + 1], points[distance <= radius]), (queries[to > radius - 1], points[distance > radius])]
    settle()
    return label


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """a > b (as signed longs) for linked fingerprints of nodes(fp), enough of them to join every component within a shard."""
    if bits != BITS:
        raise ValueError("two halves and radius 1 find pairs of at most 3 bits")
    spark = nodes.sparkSession
    n = nodes.count()
    leaves = 1
    while leaves < LEAVES and n > leaves * SHARD:
        leaves *= 2
    trees = [[], []]
    if leaves > 1:
        share = min(1.0, leaves * SAMPLE / n)
        taken = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(4 * leaves * SAMPLE).toPandas()["fp"]
        sample = np.sort(taken.to_numpy(np.int64)).view(np.uint64)
        trees = [plan(half(sample, which), leaves) for which in (0, 1)]
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for which, tree in enumerate(shared.value):
                for leaf, index, home in route(tree, half(values, which)):
                    if len(index):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), 2 * leaf + which, np.int64)), pa.array(values[index].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy(np.int64)
        sort = np.argsort(values)
        values, home = values[sort], rows["home"].to_numpy(bool)[sort]
        label = linked(values.view(np.uint64), home, int(rows["shard"].iloc[0]) & 1)
        apart = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": values[apart], "b": values[label[apart]]})

    dealt = nodes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(solve, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """node and root, its component's smallest node, for every node of edges(a, b) with a > b that is not a root itself."""
    spark = edges.sparkSession
    edges = cut(spark, edges.distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = cut(spark, small.where("a > b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, extra: list[str] | None = None) -> DataFrame:
    """doc_id, fp, root (the group's smallest fingerprint), component_id, and the extra columns, of each document."""
    spark = docs.sparkSession
    marks = cut(spark, fingerprints(docs, key, text, shingle, extra))
    nodes = cut(spark, marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connect(links(nodes))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(named.select("fp", "root").join(lowest, "root"), "fp")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group: that of the smallest key (null last), of several of one key the one with the smallest hash of all columns."""
    from pyspark.sql import Window

    row, again = fresh(docs.columns, "row_hash", "row_again")
    hashed = docs.withColumn(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    found = groups(hashed, key, text, shingle, extra=[row])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = found.groupBy("root").agg(F.min_by(F.struct("doc_id", row), order).alias("w")).select(F.col("w.doc_id").alias("_key"), F.col(f"w.{row}").alias("_row"))
    first = hashed.join(kept, F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (F.col(row) == F.col("_row")), "left_semi")
    # Rows that repeat another one in all columns.
    return first.withColumn(again, F.row_number().over(Window.partitionBy(f"`{key}`", row).orderBy(F.lit(0)))).where(F.col(again) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

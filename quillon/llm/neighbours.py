"""Nearest neighbours by a forest of random-projection trees searched through one priority queue.

Largest inner product becomes nearest direction by one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for
queries, which are scaled to length 1). Each tree splits a bounded sample at hyperplanes between two random members, at the
median, until a leaf of the whole table would hold about LEAF points; a leaf keeps at least SAMPLED points of the sample, which
holds at most SAMPLE_BYTES, so that leaves grow with the table up to SAMPLE_BYTES / (4 x components x SAMPLED) in each tree and
beyond it in size. Trees are built on the driver and broadcast; then every vector is put into a leaf of every tree.

A query descends all trees at once: one priority queue holds the branches of all of them by the sum of squares of the
distances at which the query passed their hyperplanes, and the nearest are followed until `visits` leaves are found. Only the
points of these leaves are multiplied with the query, in double precision on the original vectors. Leaves are kept together in
pages of about PAGE_BYTES: a query is sent to a page once, with the leaves it visits there, and a page that very many queries visit is
copied for each QUERIES of them, so that what moves follows the candidates. A page returns a query's k + 1 best, and of these only what scores at
least as much as the query's k + 1st best member of the sample in its NEAREST first leaves, which is a bound for the whole table.

`visits` is measured, not set: for CALIBRATED of the queries the true neighbours are found by one scan, their leaves' places in
the queue are read off, and the least number that reaches the share TARGET of them is taken. Clustered vectors take few
leaves (20 to 70 for 8 thousand to 100 thousand vectors); on vectors spread evenly over a sphere no tree cuts much off, and the share of points that is looked at
falls slowly.

Equal vectors are one point, which keeps its smallest ids, as many as can be asked for, so that nothing is lost; queries with equal vectors are searched once.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; a shorter vector
counts as ending in zeros; rows are candidates and queries one by one, also those that share an id, and a row is never its own
neighbour; ties go to the smaller id; fewer candidates than asked for are all returned; an empty table, or one without queries, gives an empty result; no other
column is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut
from quillon.sharing import Shared

TREES = 3
#: Points aimed at in a leaf; points of the sample that a leaf keeps at least; bytes of the sample at most.
LEAF, SAMPLED, SAMPLE_BYTES = 32, 4, 32 << 20
#: Bytes of the points of a page in double precision, about, and queries that meet one copy of it.
PAGE_BYTES, QUERIES = 32 << 20, 8192
#: Leaves whose members in the sample tell what a query's neighbours score at least.
NEAREST = 128
#: Share of the true neighbours of CALIBRATED queries that the visited leaves have to hold.
TARGET, CALIBRATED = 0.95, 48


class Forest:
    """Trees over rows of vectors. A node's hyperplane is told by two members of the sample; children count on from 0, leaves down from -1."""

    def __init__(self, sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 8):
        self.sample = sample.astype(np.float32)
        self.trees = [self._grow(self.sample, max(1, len(sample) // max(1, leaves)), np.random.default_rng([seed, t])) for t in range(trees)]
        self.ready = None
        # As placed, which at a hyperplane may differ from where they were grown.
        self.members = []
        for cells, tree in zip(self.place(self.sample), self.trees, strict=True):
            self.members.append(np.split(np.argsort(cells, kind="stable").astype(np.int32), np.cumsum(np.bincount(cells, minlength=tree[4]))[:-1]))

    def __getstate__(self):
        return {"sample": self.sample, "trees": self.trees, "members": self.members, "ready": None}

    @staticmethod
    def _grow(points: np.ndarray, leaf: int, chance: np.random.Generator):
        ends, offsets, children, leaves = [], [], [], 0

        def grow(index: np.ndarray) -> int:
            nonlocal leaves
            if len(index) > leaf:
                for _ in range(5):
                    a, b = chance.choice(index, 2, replace=False)
                    normal = points[a] - points[b]
                    size = float(np.linalg.norm(normal))
                    if size < 1e-12:
                        continue
                    side = points[index] @ (normal / np.float32(size))
                    offset = float(np.median(side))
                    right = side > offset
                    if right.any() and not right.all():
                        node = len(ends)
                        ends.append((a, b))
                        offsets.append(offset)
                        children.append([0, 0])
                        children[node] = [grow(index[~right]), grow(index[right])]
                        return node
            leaves += 1
            return -leaves

        root = grow(np.arange(len(points)))
        return np.array(ends, np.int32).reshape(-1, 2), np.array(offsets, np.float32), np.array(children, np.int32).reshape(-1, 2), root, leaves

    @property
    def normals(self) -> list[np.ndarray]:
        if self.ready is None:
            self.ready = []
            for ends, *_ in self.trees:
                normals = self.sample[ends[:, 0]] - self.sample[ends[:, 1]]
                self.ready.append(normals / np.maximum(np.linalg.norm(normals, axis=1, keepdims=True), 1e-12))
        return self.ready

    def place(self, points: np.ndarray) -> np.ndarray:
        """Each point's leaf in each tree, a row a tree."""
        points = points.astype(np.float32)
        out = np.empty((len(self.trees), len(points)), np.int32)
        for t, ((_, offsets, children, root, _), normals) in enumerate(zip(self.trees, self.normals, strict=True)):
            at = np.full(len(points), root, np.int32)
            while len(live := np.flatnonzero(at >= 0)):
                node = at[live]
                right = np.einsum("ij,ij->i", points[live], normals[node]) > offsets[node]
                at[live] = children[node, right.astype(int)]
            out[t] = -1 - at
        return out

    def order(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest first over all trees."""
        query = query.astype(np.float32)
        sides = [(normals @ query - tree[1]).tolist() for tree, normals in zip(self.trees, self.normals, strict=True)]
        queue = [(0.0, t, tree[3]) for t, tree in enumerate(self.trees)]
        children = [tree[2] for tree in self.trees]
        heapq.heapify(queue)
        while queue:
            distance, t, node = heapq.heappop(queue)
            below, own = children[t], sides[t]
            while node >= 0:
                side = own[node]
                near = side > 0
                heapq.heappush(queue, (distance + side * side, t, int(below[node, 1 - near])))
                node = int(below[node, int(near)])
            yield t, -1 - node

    def least(self, query: np.ndarray, cells: list[tuple[int, int]], k: int) -> float:
        """Product of the query with the k-th best of the sample's members in some leaves, less what single precision may err."""
        own = np.unique(np.concatenate([self.members[t][leaf] for t, leaf in cells]))
        score = self.sample[own] @ query.astype(np.float32)
        return float(np.partition(score, -k)[-k]) - 1e-4 if len(own) >= k else -np.inf

    def visits(self, queries: np.ndarray, neighbours: list[np.ndarray], target: float = TARGET) -> int:
        """The fewest leaves that hold the target share of the queries' neighbours, and at least one of each tree."""
        first = []
        for query, own in zip(queries, neighbours, strict=True):
            if not len(own):
                continue
            waiting = {}
            for i, cells in enumerate(self.place(own).T.tolist()):
                for cell in enumerate(cells):
                    waiting.setdefault(cell, set()).add(i)
            left = set(range(len(own)))
            for position, cell in enumerate(self.order(query), 1):
                met = waiting.get(cell, set()) & left
                first += [position] * len(met)
                left -= met
                if not left:
                    break
        first.sort()
        return max(len(self.trees), first[max(0, -int(-len(first) * target // 1) - 1)] if first else 0)


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Points on the unit sphere of one more dimension, by which inner products order as nearness."""
    v = v / most
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1)


def aimed(v: np.ndarray) -> np.ndarray:
    """Queries at the same place."""
    return np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], 1)


def rows(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.float64)


def best(q: np.ndarray, p: np.ndarray, meet: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of each query among those it meets, if they score `least`: query, point and inner product. meet: queries and points, each all with all."""
    least = least.copy()
    held, size = [], 0

    def settle():
        nonlocal held, size
        a, b, s = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        sort = np.lexsort((-s, a))
        a, b, s = a[sort], b[sort], s[sort]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, s = a[place < k], b[place < k], s[place < k]
        last = place[place < k] == k - 1
        least[a[last]] = s[last]
        held, size = [(a, b, s)], 0

    for queries, points in meet:
        score = q[queries] @ p[points].T
        a, b = np.nonzero(score >= least[queries][:, None])
        held.append((queries[a], points[b], score[a, b]))
        size += len(a)
        if size > most:
            settle()
    settle()
    a, b, _ = held[0]
    # Summed anew in one order, whatever the shape of the product was.
    return a, b, np.einsum("ij,ij->i", q[a], p[b])


def vectors(df: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """id, v and point (128 bits of hashes of v) of the rows that take part, and the number of components."""
    double = df.schema[column].dataType.elementType.simpleString() != "float"
    v = F.transform(F.col(f"`{column}`"), lambda x: x.cast("double" if double else "float"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole)
    dims = usable.agg(F.max(F.size("v"))).first()[0] or 0
    zero = F.lit(0.0).cast("double" if double else "float")
    padded = F.when(F.size("v") < dims, F.concat("v", F.array_repeat(zero, F.lit(dims) - F.size("v")))).otherwise(F.col("v"))
    hashed = [F.lpad(F.hex(F.xxhash64(F.lit(seed), "v")), 16, "0") for seed in (3, 5)]
    return usable.withColumn("v", padded).withColumn("point", F.unhex(F.concat(*hashed))), dims


def nearest(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", column: str = "embedding", trees: int = TREES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which is_query (a Column over `id`) holds."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable, dims = vectors(df, key, column)
    # k + 1 ids, as a query is no neighbour of itself. The limit is applied before the shuffle, too.
    place = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    limited = usable.withColumn("r", place).where(F.col("r") <= k + 1)
    points = cut(spark, limited.groupBy("point").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, most = points.agg(F.count(F.lit(1)), F.max(norm)).first()
    asked = usable.where(is_query).select("id", "point")
    if not n or not (asking := cut(spark, points.select("point", "v").join(asked.select("point").distinct(), "point", "left_semi"))).head(1):
        return empty

    wanted = min(n, SAMPLE_BYTES // (4 * dims))
    leaves = max(1, min(n // LEAF, wanted // SAMPLED))
    chance = F.pmod(F.xxhash64(F.lit(8), "point"), F.lit(1 << 30))
    sample = points.where(chance < int((1 << 30) * min(1.0, 1.05 * wanted / n + 0.001))).orderBy(chance, "point").limit(wanted).select("v").toArrow()
    forest = Forest(lifted(rows(sample["v"].combine_chunks(), dims), most), leaves, trees)
    visits = forest.visits(*calibration(points, asking, dims, most, k), target)
    shared = Shared(spark, forest)
    per_page = max(1, PAGE_BYTES // (8 * dims) * leaves // n)
    kept = "<f8" if points.schema["v"].dataType.elementType.simpleString() == "double" else "<f4"

    keys = ["tree", "page", "part"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = rows(batch.column("v"), dims)
                packed = pa.array([x.tobytes() for x in v.astype(kept)], pa.binary())
                for t, cells in enumerate(shared.value().place(lifted(v, most))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), t, np.int32)), pa.array((cells // per_page).astype(np.int32)), batch.column("point"), batch.column("ids"), packed, pa.array([x.tobytes() for x in cells], pa.binary())],
                        ["tree", "page", "point", "ids", "v", "cells"],
                    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import islice

        for batch in batches:
            if batch.num_rows:
                v = rows(batch.column("v"), dims)
                out = []
                for i, (direction, size) in enumerate(zip(aimed(v), np.linalg.norm(v, axis=1), strict=True)):
                    found = list(islice(shared.value().order(direction), visits))
                    least = shared.value().least(direction, found[:NEAREST], k + 1) * size * most
                    found = np.array(found, np.int32)
                    found = found[np.lexsort((found[:, 1], found[:, 0]))]
                    page = found[:, 0].astype(np.int64) << 32 | found[:, 1] // per_page
                    starts = np.flatnonzero(np.diff(page, prepend=-1))
                    out += [(i, int(found[a, 0]), int(found[a, 1]) // per_page, cells.tobytes(), least) for a, cells in zip(starts, np.split(found[:, 1], starts[1:]), strict=True)]
                of = [x[0] for x in out]
                packed = [x.tobytes() for x in v.astype(kept)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), batch.column("point").take(pa.array(of, pa.int32())), pa.array([packed[i] for i in of], pa.binary()), pa.array([x[3] for x in out], pa.binary()), pa.array([x[4] for x in out], pa.float64())],
                    ["tree", "page", "point", "v", "cells", "least"],
                )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, p, q = None, [], []

        def met() -> Iterator[pa.RecordBatch]:
            """Matches of the queries held with the page's points."""
            if p and q:
                vectors = [np.frombuffer(b"".join(x[1] for x in side), kept).reshape(len(side), dims).astype(np.float64) for side in (q, p)]
                cells = np.frombuffer(b"".join(x[2] for x in p), np.int32)
                order = np.argsort(cells, kind="stable")
                visited = [np.frombuffer(x[2], np.int32) for x in q]
                leaf, who = np.concatenate(visited), np.repeat(np.arange(len(q)), [len(x) for x in visited])
                sort = np.argsort(leaf, kind="stable")
                leaf, who = leaf[sort], who[sort]
                names, begins = np.unique(leaf, return_index=True)
                low, high = np.searchsorted(cells[order], names), np.searchsorted(cells[order], names, "right")
                meet = [(w, order[a:b]) for w, a, b in zip(np.split(who, begins[1:]), low, high, strict=True) if a < b]
                a, b, score = best(*vectors, meet, k + 1, np.array([x[4] for x in q]))
                yield pa.RecordBatch.from_arrays([pa.array([q[i][0] for i in a], pa.binary()), pa.array([p[i][0] for i in b], pa.binary()), pa.array([p[i][3] for i in b], pa.list_(pa.int64())), pa.array(score)], ["asks", "point", "ids", "score"])
            q.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "asks", "point", "v", "cells", "ids", "least")]
            for tree, page, part, asks, *row in zip(*columns, strict=True):
                if held != (tree, page, part):
                    yield from met()
                    p.clear()
                    held = (tree, page, part)
                elif len(q) >= 2048:
                    yield from met()
                (q if asks else p).append(row)
        yield from met()

    probed = cut(spark, asking.mapInArrow(probe, "tree int, page int, point binary, v binary, cells binary, least double"))
    copies = probed.groupBy("tree", "page").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
    share = probed.join(copies, ["tree", "page"]).select("tree", "page", F.pmod(F.xxhash64("point"), F.col("copies")).cast("int").alias("part"), F.lit(True).alias("asks"), "point", "v", "cells", F.lit(None).cast("array<long>").alias("ids"), "least")
    indexed = points.mapInArrow(index, "tree int, page int, point binary, ids array<long>, v binary, cells binary")
    paged = indexed.join(copies, ["tree", "page"]).select("tree", "page", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(False).alias("asks"), "point", "v", "cells", "ids", F.lit(None).cast("double").alias("least"))
    found = paged.unionByName(share).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(rerank, "asks binary, point binary, ids array<long>, score double")
    return ranked(found, asked, k)


def calibration(points: DataFrame, asking: DataFrame, dims: int, most: float, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A few queries, and the true neighbours of each, as places in the forest's space. One scan, whose result is bounded."""
    few = asking.orderBy(F.xxhash64(F.lit(9), "point"), "point").limit(CALIBRATED).toArrow()
    names, q = few["point"].to_pylist(), rows(few["v"].combine_chunks(), dims)
    number = {x: i for i, x in enumerate(names)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in q]
        for batch in batches:
            for begin in range(0, batch.num_rows, 8192):
                part = batch.slice(begin, 8192)
                v = rows(part.column("v"), dims)
                score = q @ v.T
                for i, own in enumerate(number.get(x) for x in part.column("point").to_pylist()):
                    if own is not None:
                        score[own, i] = -np.inf
                for own, s in zip(kept, score, strict=True):
                    top = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                    own += [(s[i], v[i].tobytes()) for i in top if s[i] > -np.inf]
                    own.sort(reverse=True)
                    del own[k:]
        rows_ = [(i, s, data) for i, own in enumerate(kept) for s, data in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows_], pa.int32()), pa.array([x[1] for x in rows_], pa.float64()), pa.array([x[2] for x in rows_], pa.binary())], ["query", "score", "v"])

    first = points.select("point", "v").mapInArrow(scan, "query int, score double, v binary")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "v"))
    found = first.withColumn("r", place).where(F.col("r") <= k).select("query", "v").collect()
    own = [np.array([np.frombuffer(r["v"], np.float64) for r in found if r["query"] == i]).reshape(-1, dims) for i in range(len(q))]
    return aimed(q), [lifted(x, most) for x in own]


def ranked(found: DataFrame, asked: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The k best for each row of asked(id, point), from found(asks, point, ids, score), where trees repeat what they share."""
    once = found.groupBy("asks", "point").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = once.select("asks", "score", (F.col("asks") == F.col("point")).alias("same"), F.explode("ids").alias("id"))
    order = Window.partitionBy("asks").orderBy(F.desc("score"), "id", "same")
    top = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = top.groupBy("asks").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score", "same"))).alias("list"))
    # A vector that very many queries share would meet them in one task: both sides are salted.
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each_row = asked.select(F.col("id").alias("query_id"), F.col("point").alias("asks"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    joined = each_row.join(salted, ["asks", "salt"])
    own = F.array_position(F.transform("list", lambda x: x["same"] & (x["id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("list", lambda x, i: i + 1 != F.col("own")), 1, k)
    out = joined.withColumn("own", own).select("query_id", F.posexplode(others).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)

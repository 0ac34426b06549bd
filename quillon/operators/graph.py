"""A temporal property graph as an edge table: edges(id, src, rel, dst, conf, active, valid_from)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def incident(edges: DataFrame, direction: str = "both", symmetric: list[str] | None = None, rels: list[str] | None = None, active_only: bool = False) -> DataFrame:
    """node, other and the edge's columns for each edge as seen from its nodes. Symmetric relations count both ways."""
    kept = edges.where("active") if active_only else edges
    if rels:
        kept = kept.where(F.col("rel").isin(*rels))
    out = kept.withColumns({"node": F.col("src"), "other": F.col("dst")})
    back = kept.withColumns({"node": F.col("dst"), "other": F.col("src")})
    same = F.col("rel").isin(*(symmetric or [])) if symmetric else F.lit(False)
    if direction == "out":
        found = out.unionByName(back.where(same))
    elif direction == "in":
        found = back.unionByName(out.where(same))
    else:
        found = out.unionByName(back)
    return found.dropDuplicates(["node", "id", "other"])


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node, dist: all nodes within so many steps of each seed(seed). Only new nodes go on, so that a hub is expanded once a seed."""
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist"))
    front = seen
    for hop in range(1, hops + 1):
        found = front.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        front = found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("dist", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def bridges(reached: DataFrame) -> DataFrame:
    """Nodes that at least two seeds reach."""
    return reached.where("dist > 0").groupBy("node").agg(F.countDistinct("seed").alias("n_seeds")).where("n_seeds >= 2")


def paths(edges: DataFrame, a: Column, b: Column, hops: int = 3) -> DataFrame:
    """The edges of a shortest path from a to b of at most so many steps, as an array; the smallest of equals. No row if there is none."""
    both = edges.select("id", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select("id", F.col("dst").alias("node"), F.col("src").alias("next")))
    front = edges.sparkSession.range(1).select(a.alias("node"), F.array().cast("array<long>").alias("path"))
    best = front.where(F.col("node") == b)
    seen = front.select("node")
    for _ in range(hops):
        grown = front.join(both, "node").select(F.col("next").alias("node"), F.concat("path", F.array("id")).alias("path"))
        front = grown.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        seen = seen.unionByName(front.select("node"))
        best = best.unionByName(front.where(F.col("node") == b))
    return best.orderBy(F.size("path"), "path").limit(1)


def chunk_scores(edges: DataFrame, seeds: DataFrame, hinted: list[str], hops: int = 2, floor: float = 0.12) -> DataFrame:
    """chunk and score: the evidence of edges near the seeds, weaker with distance, stronger if hinted, on a bridge or at a seed."""
    near = reach(edges, seeds, hops - 1)
    nodes = near.groupBy("node").agg(F.min("dist").alias("dist"))
    bridge = bridges(reach(edges, seeds, hops)).select("node", F.lit(True).alias("bridge"))
    known = nodes.join(bridge, "node", "left")
    side = lambda c: known.select(F.col("node").alias(c), F.col("dist").alias(f"d_{c}"), F.coalesce("bridge", F.lit(False)).alias(f"b_{c}"))
    touched = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where("d_src is not null or d_dst is not null")
    d = F.least("d_src", "d_dst")
    on = lambda c: F.coalesce(c, F.lit(False))
    weight = (
        F.col("conf") / (1 + d)
        * F.when(F.col("rel").isin(*hinted), 1.5).otherwise(1.0)
        * F.when(on(F.col("b_src")) | on(F.col("b_dst")), 1.3).otherwise(1.0)
        * F.when(d == 0, 1.3).otherwise(1.0)
    )
    return touched.withColumn("w", weight).where(F.col("w") >= floor).groupBy("chunk").agg(F.round(F.sum("w"), 6).alias("score"))


def adjacency(edges: DataFrame, weak: list[str] | None = None) -> DataFrame:
    """u, v, w: summed weights both ways; kinship counts half, what is retired 0.6."""
    w = F.col("conf") * F.when(F.col("rel").isin(*(weak or ["IS_A", "VARIANT_OF"])), 0.5).otherwise(1.0) * F.when(F.col("active"), 1.0).otherwise(0.6)
    one = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def contract(adj: DataFrame, member: DataFrame) -> DataFrame:
    """The graph of communities, from member(node, c)."""
    u, v = member.select(F.col("node").alias("u"), F.col("c").alias("cu")), member.select(F.col("node").alias("v"), F.col("c").alias("cv"))
    return adj.join(u, "u").join(v, "v").groupBy("cu", "cv").agg(F.sum("w").alias("w"))


def best_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order given."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def conflicts(facts: DataFrame) -> DataFrame:
    """Facts (src, rel, dst) that documents date differently: how many days, and the day of the highest authority, then the latest."""
    told = facts.where(F.col("day").isNotNull()).groupBy("src", "rel", "dst").agg(
        F.countDistinct("day").alias("n_days"), F.countDistinct("doc").alias("n_docs"), F.max(F.struct("authority", "day")).alias("best")
    )
    return told.where("n_days >= 2 and n_docs >= 2").select("src", "rel", "dst", "n_days", F.col("best.day").alias("day"), F.col("best.authority").alias("authority"))


def ranked_claims(facts: DataFrame) -> DataFrame:
    """src, rel, dst, doc, day, authority and place: what each document says of a contested fact, by authority."""
    contested = conflicts(facts).select("src", "rel", "dst")
    told = facts.where(F.col("day").isNotNull()).join(contested, ["src", "rel", "dst"], "left_semi")
    w = Window.partitionBy("src", "rel", "dst").orderBy(F.desc("authority"), "day", "doc")
    return told.withColumn("place", F.row_number().over(w))


def scores_by_query(edges: DataFrame, seeds: DataFrame, hinted: list[str], mentions: DataFrame | None = None, hops: int = 2, floor: float = 0.12) -> DataFrame:
    """query, doc and score as in chunk_scores, for each query of seeds(query, seed); mentions(doc, node) of seeds in chunks count besides.

    Edges meet nodes by key, each edge once from either end; a query's two views of an edge become one."""
    each = seeds.select("query", "seed").distinct()
    reached = each.join(reach(edges, each.select("seed").distinct(), hops), "seed")
    far = reached.groupBy("query", "node").agg(F.min("dist").alias("dist"), F.countDistinct(F.when(F.col("dist") > 0, F.col("seed"))).alias("n"))
    near = far.where(F.col("dist") <= hops - 1).select("query", "node", "dist", (F.col("n") >= 2).alias("bridge"))
    ends = edges.select("*", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    seen = ends.join(near, "node").groupBy("query", "id", "chunk", "rel", "conf").agg(F.min("dist").alias("dist"), F.bool_or("bridge").alias("bridge"))
    weight = F.col("conf") / (1 + F.col("dist")) * F.when(F.col("rel").isin(*hinted), 1.5).otherwise(1.0) * F.when(F.col("bridge"), 1.3).otherwise(1.0) * F.when(F.col("dist") == 0, 1.3).otherwise(1.0)
    parts = seen.where(F.col("chunk").isNotNull() & (weight >= floor)).select("query", F.col("chunk").alias("doc"), weight.alias("w"))
    if mentions is not None:
        hits = mentions.select("doc", F.col("node").alias("seed")).distinct().join(each, "seed").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.unionByName(hits.select("query", "doc", (0.3 * F.col("n") + F.when(F.col("n") > 1, 0.4).otherwise(0.0)).alias("w")))
    return parts.groupBy("query", "doc").agg(F.round(F.sum("w"), 6).alias("score"))

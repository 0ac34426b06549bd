"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only.

Rows get numbers 0 to N - 1 from their contents (no matter how they are partitioned), a keyed Feistel network
permutes the numbers, and the permuted number p gives shard p mod S and slot p div S. Counts of shards are at most one
apart; slots have no gaps; the same rows and key give the same places on any cluster.

Defined cases: a null text has size 1 and CRC 0; null keys are numbered like any value; repeated rows each get a place of
their own (which of the equal rows gets which does not show); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import documents

#: Buckets whose counts are added up on one task and broadcast: a fixed number, whatever the input.
BUCKETS = 4096
ROUNDS = 6
#: Steps of cycle walking. The domain holds fewer than sqrt(N) + 1 numbers beyond N, so that a walk of w steps has a chance
#: below N**(-w/2); for N below 900 the bound on the length of a walk is exact.
WALK = 32


def feistel(number: Column, n: Column, key: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network on Z_a x Z_b with a = ceil(sqrt(n)), b = ceil(n / a); the result may be n or more."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(state: Column, turn: Column) -> Column:
        left, right = state["l"], state["r"]
        on_left = turn % 2 == 0
        into_left = F.pmod(left + F.pmod(F.xxhash64(F.lit(key).cast("long"), turn.cast("long"), right), a), a)
        into_right = F.pmod(right + F.pmod(F.xxhash64(F.lit(key).cast("long"), turn.cast("long"), left), b), b)
        return F.struct(F.when(on_left, into_left).otherwise(left).alias("l"), F.when(on_left, right).otherwise(into_right).alias("r"))

    start = F.struct(F.floor(number / b).cast("long").alias("l"), F.pmod(number, b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permute(number: Column, n: Column, key: int, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 to n - 1: the network is applied until its result is below n."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel(number, n, key, rounds),
        lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, key, rounds)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """df's rows, reduced to the columns `by`, with row_no from 0 to n_rows - 1 and n_rows. Equal rows are counted before they are shuffled."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    totals = groups.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    everything = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most BUCKETS rows
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("_bucket", F.coalesce(F.sum("_rows").over(everything), F.lit(0)).alias("_base"), F.sum("_rows").over(whole.orderBy("_bucket")).alias("n_rows"))
    within = Window.partitionBy("_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_before", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    return (
        placed.join(F.broadcast(bases), "_bucket")
        .select(*by, "n_rows", (F.col("_base") + F.col("_before")).alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
        .select(*by, (F.col("_first") + F.col("_copy")).alias("row_no"), "n_rows")
    )


def shard(df: DataFrame, by: list[str], shards: int = 8, key: int = 20) -> DataFrame:
    """by, row_no, n_rows, shard and slot of every row of df."""
    place = permute(F.col("row_no"), F.col("n_rows"), key)
    return numbered(df, by).withColumn("_p", place).select(*by, "row_no", "n_rows", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    sized = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"))
    placed = shard(sized, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")

"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it holds, each once. Feature f is scaled by r(f) = log((p(f) + 1) /
sum(p + 1)) - log((q(f) + 1) / sum(q + 1)), where p and q count the toxic and other training texts that hold f; a logistic
regression learns weights for the scaled features. Features of too few training texts (10, fewer if there
are few texts) are left out.

It learns from at most PER_CLASS labelled texts a class, those with the smallest hash of the document id, as far as their features, at 16 bytes a byte of text and 4 a feature at most, take SAMPLE_BYTES a class.

Defined cases: null and empty texts are scored on the bias alone; a document that is labelled more than once counts as toxic
if any label says so; null labels are not learned; without labels of both classes every score is the share of toxic labels
(0.5 without any); repeated rows are scored one by one, and of the rows that share an id one is learned from, that of the smallest hash of its text; texts without a feature in common score alike; a very long text is hashed whole, in a block of
its own; columns of any name stay beside the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import blocks, documents, fresh, remainder
from quillon.llm.ngrams import hashed, present

ORDERS, FEATURE_BITS = range(4, 8), 20
PER_CLASS, SAMPLE_BYTES = 2000, 192 << 20
STEPS = 60
LEAST_TEXTS = 10
#: Features whose log-count ratio lies nearer to 0 are left out; strength of the penalty on squared weights.
LEAST_RATIO, PENALTY = 1.0, 0.01


def train(features: list[np.ndarray], toxic: np.ndarray, bits: int = FEATURE_BITS) -> dict:
    n, size = len(features), 1 << bits
    if not n or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return {"weights": np.zeros(size, np.float32), "bias": float(np.log(share / (1 - share)))}
    index = np.concatenate(features)
    ends = np.cumsum([len(x) for x in features])
    row = np.repeat(np.arange(n), [len(x) for x in features])
    p, q = (np.bincount(index, weights=w[row], minlength=size) for w in (toxic.astype(float), (~toxic).astype(float)))
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    ratio[(p + q < min(LEAST_TEXTS, 1 + n // 100)) | (np.abs(ratio) < LEAST_RATIO)] = 0
    kept = ratio[index] != 0
    index, row = index[kept], row[kept]
    scale = ratio[index].astype(np.float32)
    # Texts of any length weigh alike in a step; the classes do, too.
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    sign = np.where(toxic, 1.0, -1.0)
    weights, bias = np.zeros(size), 0.0
    first, second, first_b, second_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam
        margin = np.clip((np.bincount(row, weights=scale * weights[index], minlength=n) + bias) * sign, -30, 30)
        slope = -sign / (1 + np.exp(margin)) * share
        g, g_b = np.bincount(index, weights=scale * slope[row], minlength=size) + PENALTY * weights, slope.sum()
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        first_b, second_b = 0.9 * first_b + 0.1 * g_b, 0.99 * second_b + 0.01 * g_b * g_b
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weights -= 0.02 * (first / fix) / (np.sqrt(second / fix2) + 1e-4)
        bias -= 0.05 * (first_b / fix) / (np.sqrt(second_b / fix2) + 1e-8)
    return {"weights": (weights * ratio).astype(np.float32), "bias": float(bias)}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """A model learned from docs(doc_id, text) whose labels(doc_id, toxic) are given. One task trains it, on a bounded sample."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chance = F.xxhash64(F.lit(10), "doc_id")
    sample = [known.where(F.col("toxic") == c).orderBy(chance, "doc_id").limit(per_class) for c in (True, False)]
    both = docs.select("doc_id", "text").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id").withColumn("pick", F.xxhash64("text"))
    sizes = both.groupBy("doc_id", "toxic").agg(F.min(F.struct("pick", F.least(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * (4 * len(ORDERS)), F.lit(4 << FEATURE_BITS)).alias("size"))).alias("one")).select("doc_id", "toxic", "one.*")
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(chance, "doc_id"))  # over at most per_class rows
    kept = sizes.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "pick")
    rows = both.join(F.broadcast(kept), ["doc_id", "pick"], "left_semi").select("toxic", "doc_id", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << FEATURE_BITS, np.int32)
        for table in blocks(batches, "text"):
            found = [present(hashed(x or "", ORDERS, FEATURE_BITS), last).tobytes() for x in table.column("text").to_pylist()]
            yield from pa.table([table.column("toxic"), table.column("doc_id"), pa.array(found, pa.binary())], ["toxic", "doc_id", "features"]).to_batches(max_chunksize=64)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, features, known = [], [], set()
        for batch in batches:
            for label, key, data in zip(*(batch.column(c).to_pylist() for c in ("toxic", "doc_id", "features")), strict=True):
                if key not in known:
                    known.add(key)
                    toxic.append(label)
                    features.append(np.frombuffer(data, np.int32))
        model = train(features, np.array(toxic, bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(featured, f"toxic boolean, doc_id {kind}, features binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, bool))


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score and predicted (each name with a _ more if it is taken)."""
    names = fresh(docs.columns, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"_{i}" for i in range(len(docs.columns))]
    frame = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)), F.col(text).alias("t"))
    schema = ", ".join(f"{o} {frame.schema[o].dataType.simpleString()}" for o in own) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value["weights"], shared.value["bias"]
        last = np.zeros(len(weights), np.int32)
        for table in blocks(batches, "t"):
            sums = np.array([weights[present(hashed(x or "", ORDERS, FEATURE_BITS), last)].sum(dtype=np.float64) for x in table.column("t").to_pylist()], np.float64)
            score = 1 / (1 + np.exp(-np.clip(sums + bias, -500, 500)))
            yield from pa.table([*(table.column(o) for o in own), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*own, "score", "predicted"]).to_batches()

    return frame.mapInArrow(run, schema).select(*(F.col(o).alias(c) for c, o in zip([*docs.columns, *names], [*own, "score", "predicted"], strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    return predict(docs, fit(docs.where(~F.col("held_out")), labels)).drop("text")

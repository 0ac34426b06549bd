"""Language identification by error-correcting output codes.

Each language has a codeword. One binary classifier a bit, logistic regression on hashed character n-grams, predicts the
codeword of a text; decoding sums, over the bits, the logistic loss that a language's codeword would have, weighted by how
well the bit was learned, and chooses the language of least loss. A text whose two best languages are close is flagged.

For up to 7 languages the code is exhaustive (every split of the languages is a bit); beyond, bits are drawn by a keyed
hash, as many as BITS_BEYOND and BITS_EACH an octave of languages, no two of them equal or opposite, and drawn again until every two codewords differ in at least a quarter
of them. There is a codeword for every language that is learned, however many. The classifiers learn from at most PER_LANGUAGE labelled texts a language, fewer if all
would take over TRAIN_BYTES, chosen by a hash of the document id and the text; a task trains on these alone.

Defined cases: null texts and texts without a letter are `und` with score 0; an empty text has no letter; without any
labelled text all are `und`; with one language every text with a letter gets it; null labels are not learned; repeated rows are scored one by
one and learned from once; of equally near languages the first by name is taken; a very long text is hashed whole, in a block of its own; columns of any name stay beside the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import blocks, carried, documents, released, remainder
from quillon.llm.ngrams import hashed

ORDERS, FEATURE_BITS = range(1, 4), 13
PER_LANGUAGE = 600
#: Bytes of the training texts' vectors, at most.
TRAIN_BYTES = 384 << 20
BITS_BEYOND, BITS_EACH = 63, 16
#: Training texts that are multiplied at once.
BATCH = 4096
STEPS = 60
#: A text is flagged if the chosen language's share is below this.
SURE = 0.5
#: The language of texts that have none.
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages."""
    if n <= 7:
        return np.array([[1 if language == 0 else 1 - 2 * (bit >> (language - 1) & 1) for bit in range(1, 1 << (n - 1))] for language in range(n)], np.float32).reshape(n, -1)
    bits = max(BITS_BEYOND, BITS_EACH * (n - 1).bit_length())
    for turn in range(100):
        chosen, seen, at = [], set(), 0
        while len(chosen) < bits:
            column = _drawn(n, turn << 20 | at)
            at += 1
            column = column if column[0] else ~column  # a split and its opposite are one
            if column.all() or (name := column.tobytes()) in seen:
                continue
            seen.add(name)
            chosen.append(column)
        code = np.where(np.stack(chosen, 1), 1, -1).astype(np.float32)
        if all((np.sort(code[i : i + 512] @ code.T, axis=1)[:, -2] <= bits / 2).all() for i in range(0, n, 512)):
            return code
    raise ValueError(f"no code of {bits} bits for {n} languages")


def _drawn(n: int, number: int) -> np.ndarray:
    """A pseudo-random bit for each of n languages."""
    key = (np.arange(n, dtype=np.uint64) + np.uint64(number * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((key ^ key >> np.uint64(29)) >> np.uint64(40) & np.uint64(1)).astype(bool)


def vector(text: str) -> np.ndarray:
    counts = np.sqrt(np.bincount(hashed(text, ORDERS, FEATURE_BITS), minlength=1 << FEATURE_BITS)).astype(np.float32)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def train(vectors: np.ndarray, labels: np.ndarray, languages: list[str]) -> dict:
    """One logistic regression a bit, all at once, by accelerated gradient steps over batches; a bit's weight is its training accuracy above chance."""
    code = codewords(len(languages))
    counts = np.bincount(labels, minlength=len(languages))
    share = (1 / np.maximum(1, (counts > 0).sum()) / counts[labels]).astype(np.float32)[:, None]
    weights = np.zeros((vectors.shape[1], code.shape[1]), np.float32)
    ahead, bias = weights.copy(), np.zeros(code.shape[1], np.float32)
    parts = [slice(i, i + BATCH) for i in range(0, len(labels), BATCH)]
    for step in range(STEPS):
        slope, slope_bias = 1e-5 * ahead, np.zeros_like(bias)
        for part in parts:
            v, target = vectors[part].astype(np.float32), code[labels[part]]
            margin = np.clip((v @ ahead + bias) * target, -30, 30)
            each = -target / (1 + np.exp(margin)) * share[part]
            slope += v.T @ each
            slope_bias += each.sum(0)
            del v  # before the next is made
        after = ahead - 8.0 * slope
        bias -= slope_bias
        ahead, weights = after + step / (step + 3) * (after - weights), after
    right = sum((((vectors[p].astype(np.float32) @ weights + bias) * code[labels[p]]) > 0).sum(0) for p in parts) / max(1, len(labels)) if parts else np.zeros(code.shape[1])
    return {"languages": languages, "code": code, "weights": weights, "bias": bias, "trust": np.clip(2 * right - 1, 0.05, 1).astype(np.float32)}


def decode(model: dict, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest language and its share among all, for each vector."""
    margin = vectors @ model["weights"] + model["bias"]
    loss = np.stack([(model["trust"] * np.logaddexp(0, -margin * word)).sum(1) for word in model["code"]], 1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    best = loss.argmin(1)
    return best, share[np.arange(len(best)), best]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """A model learned from labelled(key, text, lang). One task trains it, on a bounded sample; None if there is nothing to learn from."""
    spark = labelled.sparkSession
    # Rows alike share a chance and are learned once.
    chance = F.pmod(F.xxhash64(F.lit(7), "key", F.crc32(F.encode("text", "UTF-8"))), F.lit(1 << 40)) / float(1 << 40)
    labelled = labelled.withColumn("chance", chance)
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("chance").alias("count")).collect()
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    number = {name: i for i, name in enumerate(languages)}
    width = 2 << FEATURE_BITS
    most = max(1, min(per_language, TRAIN_BYTES // (width * len(languages))))
    rates = spark.createDataFrame([(r["lang"], number[r["lang"]], float(min(1.0, 1.5 * (most + 8) / r["count"]))) for r in counts], "lang string, number int, rate double")
    sample = labelled.join(F.broadcast(rates), "lang").where(F.col("chance") < F.col("rate"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text"):
            found = [vector(x or "").astype(np.float16).tobytes() for x in table.column("text").to_pylist()]
            yield from pa.table([table.column("number"), table.column("chance"), pa.array(found, pa.binary())], ["number", "chance", "vector"]).to_batches(max_chunksize=64)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        released()
        numbers, vectors, known = [], bytearray(), set()
        for batch in batches:
            for row in zip(batch.column("number").to_pylist(), batch.column("chance").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                if row[:2] not in known:
                    known.add(row[:2])
                    numbers.append(row[0])
                    vectors += row[2]
        if not numbers:
            return
        model = train(np.frombuffer(vectors, np.float16).reshape(len(numbers), -1), np.array(numbers), languages)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The exact bound is drawn on numbers alone; at most TRAIN_BYTES / width of them go on.
    place = F.row_number().over(Window.partitionBy("number").orderBy("chance"))
    bounded = sample.select("number", "chance").distinct().withColumn("r", place).where(F.col("r") <= most).select("number", "chance")
    kept = sample.select("number", "chance", "text").join(F.broadcast(bounded), ["number", "chance"], "left_semi")
    rows = kept.mapInArrow(featured, "number int, chance double, vector binary").repartition(1).mapInArrow(learn, "model binary").collect()
    if not rows:
        return None
    import pickle

    return pickle.loads(rows[0]["model"])


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous (each name with a _ more if it is taken)."""
    from quillon.llm.common import fresh

    names = fresh(docs.columns, "lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame, own, at = carried(docs, docs.columns, text)
    schema = ", ".join(f"{o} {frame.schema[o].dataType.simpleString()}" for o in own) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for table in blocks(batches, at):
            texts = table.column(at).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))] if learned else []
            for begin in range(0, len(rows), 512):
                part = rows[begin : begin + 512]
                vectors = np.empty((len(part), 1 << FEATURE_BITS), np.float32)
                for row, i in enumerate(part):
                    vectors[row] = vector(texts[i])
                best, share = decode(learned, vectors)
                for i, b, s in zip(part, best, share, strict=True):
                    lang[i], score[i] = learned["languages"][b], float(s)
            yield from pa.table([*(table.column(o) for o in own), pa.array(lang, pa.string()), pa.array(score), pa.array(score < SURE)], [*own, "lang_pred", "score", "ambiguous"]).to_batches()

    return frame.mapInArrow(run, schema).select(*(F.col(o).alias(c) for c, o in zip([*docs.columns, *names], [*own, "lang_pred", "score", "ambiguous"], strict=True)))


def learned(docs: DataFrame, held_out: Column) -> dict | None:
    return fit(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("key"), "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), learned(docs, held_out)).drop("text")

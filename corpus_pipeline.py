"""A training-corpus pipeline: each stage takes the documents its predecessor kept and returns documents, the last one sequences.

1. languages: texts whose language cannot be told go.
2. near_duplicates: of each group of near copies the document with the smallest id stays.
3. decontamination: documents that hold a passage of a benchmark item go.
4. secrets: found secrets are masked in the text; the documents stay.
5. packing: the texts' tokens are packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, langid, packing, secrets, simhash
from quillon.llm.common import documents, fresh, remainder, stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learned(docs, remainder("doc_id", 5) == 0)
    pred, _, unsure = fresh(docs.columns, "lang_pred", "score", "ambiguous")
    return langid.predict(docs, model).where((F.col(pred) != langid.UNKNOWN) & ~F.col(unsure)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where(F.col("n_hit") == 0).select(*docs.columns)


def masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans, masked = fresh(docs.columns, "spans", "redacted")
    changed = F.size(spans) > 0
    found = secrets.findings(docs, masked=True)
    text = F.when(changed, F.col(masked)).otherwise(F.col("text"))
    count = F.when(changed, F.length(masked).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*({"text": text.alias(c), "n_chars": count.alias(c)}.get(c, F.col(f"`{c}`")) for c in docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [
    ("languages", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", masking),
    ("packing", sequences),
]

#: The stages learn, hash and tokenize in ways that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Reports: summaries of documents, exposition of metrics, aligned tables, vectors as bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exposition(metrics: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """One line a row: name{label="..."} value."""
    return metrics.select(F.format_string('%s{%s="%s"} %s', F.lit(name), F.lit(label), F.col(label), F.col(value).cast("string")).alias("line"))


def summaries(parts: DataFrame, doc: str, at: str, lead: str, most: int = 6) -> DataFrame:
    """doc and summary: the leads of its first parts, joined."""
    first = parts.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(at))).where(F.col("_r") <= most)
    return first.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", lead))), lambda x: x[lead]), " ").alias("summary"))


def aligned(rows: DataFrame, columns: list[str], width: int = 16) -> DataFrame:
    """Each row as one line of cells of the same width."""
    cell = lambda c: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), width, " ")
    return rows.select(F.rtrim(F.concat(*map(cell, columns))).alias("line"))


def merged(candidates: DataFrame, keys: list[str], best: list[str], sets: list[str]) -> DataFrame:
    """One row for each key over all steps: the highest scores, and the union of what found it."""
    aggregates: list[Column] = [F.max(c).alias(c) for c in best] + [F.sort_array(F.collect_set(c)).alias(c) for c in sets]
    return candidates.groupBy(*keys).agg(*aggregates)


def packed(vector: Column) -> Column:
    """An array of floats as its bytes, 32 bits each, little-endian."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        import numpy as np

        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return run(vector)


def unpacked(data: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return blobs.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")

    return run(data)

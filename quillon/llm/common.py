"""Shared pieces of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.lineage import cut, shared_folder

__all__ = ["blocks", "carried", "components", "cut", "documents", "fresh", "raw", "released", "remainder", "remembered", "shared_folder", "stored"]

#: Text bytes that a Python worker holds at once, about.
BLOCK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as empty text."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.pmod(F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit(modulus)).cast("int")


def fresh(taken, *wanted: str) -> list[str]:
    """Column names like those wanted that clash with none taken, case ignored."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def carried(docs: DataFrame, given: list[str], text: str) -> tuple[DataFrame, list[str], str]:
    """The columns `given` under names that clash with none, these names, and the name that the text has there: a text that is given goes to the workers once."""
    own = [f"_{i}" for i in range(len(given))]
    columns = [F.col(f"`{c}`").alias(o) for c, o in zip(given, own, strict=True)]
    if text in given:
        return docs.select(*columns), own, own[given.index(text)]
    return docs.select(*columns, F.col(text).alias("t")), own, "t"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as Parquet into the folder that all executors share, and read again."""
    import uuid

    path = f"{shared_folder(spark)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What this worker process keeps under a name from task to task. Functions come to workers by value, so that a module cannot hold it."""
    held = sys.__dict__.setdefault("_quillon_kept", {})
    if name not in held:
        held[name] = make()
    return held[name]


def released(keep: str | None = None) -> None:
    """Gives back the memory of all that this worker process keeps, but for one name: Spark uses a worker again for the tasks of other operators."""
    held = sys.__dict__.get("_quillon_kept", {})
    if others := [x for x in held if x != keep]:
        for name in others:
            del held[name]
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES, keep: str | None = None) -> Iterator[pa.Table]:
    """Batches regrouped into tables of about `most` text bytes; a longer text stays whole, in a table of its own size. Of what the process remembers, only `keep` stays."""
    released(keep)
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + most - size, "right")))
            held.append(batch.slice(begin, end - begin))
            size += int(sizes[end - 1] - base)
            begin = end
            if size >= most or begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def raw(column: pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 to n - 1 and links a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
    return label

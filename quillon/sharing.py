"""Broadcast values that travel with their classes' code, so that executors need no copy of the package."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Shared:
    def __init__(self, spark: SparkSession, value):
        self.data, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"data": self.data, "held": None}

    def value(self, keep: bool = True):
        """The value; kept for the rest of the task unless told not to."""
        if self.held is not None:
            return self.held
        found = pickle.loads(self.data.value)
        if keep:
            self.held = found
        return found


#: Rows of which Python objects exist at once in a worker.
ROWS = 64


def by_rows(function: Callable, schema: str, rows: int = ROWS):
    """function(*values) over columns, as an Arrow function that holds Python objects for few rows at once, however many a batch has.

    Batches of Arrow are read and written a slice at a time; only their bytes stay whole."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(schema))

    def one(batches):
        import pyarrow as pa

        for column in batches:
            for at in range(0, len(column), rows):
                yield pa.array([function(x) for x in column.slice(at, rows).to_pylist()], kind)

    def many(batches):
        import pyarrow as pa

        for columns in batches:
            for at in range(0, len(columns[0]), rows):
                yield pa.array([function(*x) for x in zip(*(c.slice(at, rows).to_pylist() for c in columns), strict=True)], kind)

    def run(*columns):
        import pyarrow as pa

        if len(columns) == 1:
            one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
            return F.arrow_udf(one, schema)(*columns)
        many.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(many, schema)(*columns)

    return run

"""Vectors in double precision and their tiles: what operators 11 and 13 share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskloom.llm.common import release
from riskloom.session import importable


def usable(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns named and v (array of float if the embedding is one, else of double) of the rows whose embedding is not null and has finite components only.

    All v have one length: a shorter vector has zeros where longer ones go on, an empty one one zero at least. -0.0 is 0.0.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    good = rows.where(F.col("embedding").isNotNull() & finite)
    length = max(good.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    zero = F.lit(0.0).cast(kind)
    v = F.transform("embedding", lambda x: x.cast(kind) + zero)
    return good.select(*columns, F.concat(v, F.array_repeat(zero, F.lit(length) - F.size("embedding"))).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each list of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def lists(rows: np.ndarray) -> pa.ListArray:
    """matrix(), the other way."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def mapped(rows: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """step() over the Arrow batches of rows; it gives columns by name."""
    importable(rows.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
        release()

    return rows.mapInArrow(run, schema)


def tiled(rows: DataFrame, keys: list[str], schema: str, meet: Callable[[tuple, pa.Table], dict]) -> DataFrame:
    """meet(key, table) over the tiles of rows; it gives columns by name."""
    importable(rows.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = meet(tuple(k.as_py() for k in key), table)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return rows.groupBy(*keys).applyInArrow(run, schema)

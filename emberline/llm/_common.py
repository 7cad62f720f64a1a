"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import cut  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader only, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: T.StructType, rows: int = 256, finish: bool = False) -> DataFrame:
    """``mapInArrow`` over slices of ``rows`` rows.

    ``make()`` runs once in each task and gives a function from a dict of Python
    lists to a dict of lists (or Arrow arrays) by output column. With ``finish`` it
    is called a last time with ``None``, for what it still holds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()

        def out(columns):
            return pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
            )

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                got = step({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)})
                if got is not None:
                    yield out(got)
        if finish and (got := step(None)) is not None:
            yield out(got)

    return df.mapInArrow(run, schema)


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def row_key(text: Column | str) -> Column:
    """A 64-bit key of a text that tells rows of the same id apart; null and empty texts differ from others."""
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))

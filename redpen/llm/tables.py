"""Shared helpers: reading tables, Arrow maps over whole rows, written intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from redpen.session import scratch_path

#: Rows handled at once inside a task; bounds the Python side's memory, never the result.
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    """The Arrow schema of the scalar and list types that the operators emit."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.FloatType: pa.float32(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
    }[type(kind)]


def map_slices(
    df: DataFrame,
    columns: Iterable[str],
    make: Callable[[], Callable[..., Iterator[dict] | Iterable[dict]]],
    schema: str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply a function to slices of a few columns; columns not named are not read.

    ``make`` runs once per task and gives the function. It takes one Arrow array
    per column and yields dicts of output columns (lists or Arrow arrays).
    """
    names, out = list(columns), arrow_schema(schema)

    def run(batches):
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for made in function(*part.columns):
                    yield pa.RecordBatch.from_arrays(
                        [
                            made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type)
                            for f in out
                        ],
                        schema=out,
                    )

    return df.select(*names).mapInArrow(run, schema)


def filter_slices(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[pa.Array], list[bool]]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """The rows, with all their columns whatever their names, whose ``column`` gets a true verdict."""
    place = df.columns.index(column)

    def run(batches):
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(function(part.column(place)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the table.

    A lost executor costs at most the running tasks; nothing is recomputed.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Table readers of the file formats the corpora come in."""

from __future__ import annotations

from dataclasses import asdict, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_CSV = "input_text STRING, target_text STRING"


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str | list[str], fmt: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A corpus stored as parquet, json, orc or csv."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.format(fmt).load(path)


def read_split(df: DataFrame, split: str) -> DataFrame:
    """One split of a table partitioned by ``split``: only its folders are read."""
    return df.where(F.col("split") == split).drop("split")


def read_pair_csv(spark: SparkSession, path: str, schema: str = PAIR_CSV) -> DataFrame:
    """Pairs with a header line; empty fields come back as empty text."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, escape='"')
    rows = reader.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    texts = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType)}
    return rows.select([F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in rows.columns])


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.option("multiLine", True).json(path)


def from_rows(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A small in-memory table."""
    return spark.createDataFrame(rows, schema)


def flatten_config(*configs: object) -> dict[str, str]:
    """Dataclasses as one flat map; later ones win, paths become absolute."""
    flat: dict[str, str] = {}
    for config in configs:
        values = asdict(config) if is_dataclass(config) else dict(config)
        for key, value in values.items():
            flat[key] = str(value.resolve()) if isinstance(value, Path) else str(value)
    return flat

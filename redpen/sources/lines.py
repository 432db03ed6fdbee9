"""Line-oriented files and row numbers in file order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpen.functions.text import strip
from redpen.operators.packed import zipped
from redpen.session import materialize


def file_part(path: str) -> Column:
    """A part file's number; null for other files."""
    return F.regexp_extract(path, r"part-(\d+)", 1).try_cast("long")


def placed_rows(scan: DataFrame) -> DataFrame:
    """The rows of a direct file scan, written once with file, block and running number.

    A second pass thus cannot see other splits. ``_at`` stands for file and block.
    """
    columns = scan.columns
    placed = scan.select(
        *columns,
        file_part("_metadata.file_path").alias("_part"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    return materialize(placed.withColumn("_at", F.xxhash64("_file", "_block")), "rows")


def block_starts(placed: DataFrame, counted: Column) -> DataFrame:
    """(_at, _first, _turn, _base) per block: its first number, its place in file order, and the
    sum of ``counted`` over all blocks before it.

    One row per 128 MB of input meets in a window. The result is written, so
    that the planner knows its true size and repeats it to all tasks only below
    its own limit; the texts then stay where they are.
    """
    blocks = placed.groupBy("_part", "_file", "_block", "_at").agg(
        F.sum(counted).alias("_n"), F.min("_seq").alias("_first")
    )
    order = W.orderBy("_part", "_file", "_block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        "_at",
        "_first",
        F.row_number().over(order).alias("_turn"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    return materialize(starts, "blocks")


def _one_name(path: str) -> str:
    """A file's path, however many slashes follow its scheme and whether or not it is quoted."""
    return unquote(re.sub(r"^(\w+):/+", r"\1:/", path))


def first_files(scan: DataFrame, n: int, read: Callable[[list[str]], DataFrame]) -> list[str] | None:
    """The files that hold the first ``n`` rows in file order; None if all are needed.

    ``read`` gives the rows of some files. Rows are counted file by file in that order, in steps of ever more files, until
    there are enough: no more is read than that and the rest of the last step.
    """
    part = re.compile(r"part-(\d+)")
    number = lambda f: (lambda m: (m is None, int(m.group(1)) if m else 0, f))(part.search(f))
    # As rows are numbered: files without a part number first.
    files = sorted(scan.inputFiles(), key=lambda f: (not number(f)[0], *number(f)[1:]))
    taken, rows, step = 0, 0, 1
    while rows < n and taken < len(files):
        batch = files[taken : taken + step]
        counted = read(batch).groupBy(F.col("_metadata.file_path").alias("f"))
        counts = {_one_name(r.f): r.n for r in counted.agg(F.count("*").alias("n")).collect()}  # one row for each file
        for file in batch:
            taken, rows = taken + 1, rows + counts.get(_one_name(file), 0)
            if rows >= n:
                break
        step *= 2
    return files[:taken] if rows >= n and taken < len(files) else None


def first_rows(scan: DataFrame, n: int, read: Callable[[list[str]], DataFrame], row_id: str = "sent_id") -> DataFrame:
    """The first ``n`` rows of a direct file scan in file order, numbered; other files are not opened."""
    files = first_files(scan, n, read)
    return with_row_ids(scan if files is None else read(files), row_id).where(F.col(row_id) < n)


class Numbered(NamedTuple):
    """Rows of files with their number in file order, how many they are and the bytes of their texts."""

    rows: DataFrame
    n: int
    size: int


def _text_bytes(scan: DataFrame) -> Column:
    texts = [f.name for f in scan.schema if isinstance(f.dataType, T.StringType)]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("bigint")


def numbered(scan: DataFrame, row_id: str = "sent_id", whole: bool = False) -> Numbered:
    """Dense row numbers in file order for a direct file scan.

    ``whole``: each file is read by one task, as CSV with line breaks in its fields is. Compressed files are
    too. Their rows are counted where they are read; others are written once, so that a
    second pass cannot see other splits.
    """
    if not whole and not all(f.endswith(".gz") for f in scan.inputFiles()):
        placed = placed_rows(scan)
        number = F.col("_base") + F.col("_seq") - F.col("_first")
        rows = placed.join(block_starts(placed, F.lit(1)), "_at").select(number.alias(row_id), *scan.columns)
        found = placed.agg(F.count(F.lit(1)).alias("n"), F.sum(_text_bytes(scan)).alias("b")).first()
        return Numbered(rows, found["n"], found["b"] or 0)
    path = F.col("_metadata.file_path")
    sized = scan.select(path.alias("_file"), file_part(path).alias("_part"), _text_bytes(scan).alias("_size"))
    files = sized.groupBy("_part", "_file").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"))
    # One row for each file meets in a window.
    before = W.orderBy("_part", "_file").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    starts = materialize(files.select(F.xxhash64("_file").alias("_at"), base, "_n", "_size"), "files")
    found = starts.agg(F.sum("_n").alias("n"), F.sum("_size").alias("b")).first()
    placed = scan.select(*scan.columns, F.xxhash64(path).alias("_at"))
    schema = T.StructType([*placed.schema, T.StructField("_no", T.LongType())])
    rows = placed.mapInArrow(_counted, schema).join(starts.select("_at", "_base"), "_at")
    return Numbered(rows.select((F.col("_base") + F.col("_no")).alias(row_id), *scan.columns), found["n"] or 0, found["b"] or 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``_no``, how many of their file come before; a file's rows come one after the other."""
    at, so_far = None, 0
    for batch in batches:
        if not len(batch):
            continue
        here, place = batch.column("_at").to_numpy(), np.arange(len(batch))
        fresh = np.append(at is None or here[0] != at, here[1:] != here[:-1])
        first = np.maximum.accumulate(np.where(fresh, place, -1))
        number = np.where(first < 0, place + so_far, place - first)
        at, so_far = here[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, "_no"])


def with_row_ids(scan: DataFrame, row_id: str = "sent_id") -> DataFrame:
    """``numbered`` without the counts."""
    return numbered(scan, row_id).rows


def numbered_lines(spark: SparkSession, path: str, column: str = "text") -> Numbered:
    """``read_lines`` with the counts."""
    found = numbered(spark.read.text(path))
    return found._replace(rows=found.rows.select("sent_id", strip(F.col("value")).alias(column)))


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """(sent_id, text): one stripped line per row, numbered from 0 over all files."""
    return numbered_lines(spark, path, column).rows


def side_by_side(*inputs: Numbered) -> DataFrame:
    """Numbered rows of several files, in order; the job that reads the result fails if they do not line up."""
    return zipped([x.rows for x in inputs], max(x.n for x in inputs), sum(x.size for x in inputs))

"""Row and column operators of corpus preparation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T

from redpen.functions.text import clean_task_prefix
from redpen.schema import PAIR_COLUMNS, PAIRS


def canonical(
    df: DataFrame,
    source: str,
    input_text: str,
    target_text: str,
    original: str,
    corrected: str,
) -> DataFrame:
    """Rename the four role columns and keep only the canonical ones.

    ``sent_id`` must be present; see ``sources.lines.with_row_ids`` for files
    without a key.
    """
    return df.select(
        F.col("sent_id").cast("long").alias("sent_id"),
        F.lit(source).alias("source"),
        F.col(input_text).alias("input_text"),
        F.col(target_text).alias("target_text"),
        F.col(original).alias("original"),
        F.col(corrected).alias("corrected"),
    )


def cast_to(df: DataFrame, schema: T.StructType = PAIRS) -> DataFrame:
    """Columns of ``schema``, in its order and with its types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def drop_empty(df: DataFrame, corrected: str = "corrected") -> DataFrame:
    return df.where(F.col(corrected) != "")


def drop_identical(df: DataFrame, original: str = "original", corrected: str = "corrected") -> DataFrame:
    return df.where(F.col(original) != F.col(corrected))


REF_BITS = 20


def explode_references(df: DataFrame, references: str, corrected: str) -> DataFrame:
    """One row per reference; rows without references disappear.

    The new ``sent_id`` is the old one shifted left by ``REF_BITS`` plus the
    reference's position, so it stays unique without a shuffle. An id or a
    position that does not fit fails the job instead of colliding.
    """
    others = [c for c in df.columns if c not in (references, "sent_id")]
    rows = df.select("sent_id", *others, F.posexplode(references).alias("_ref", corrected))
    new_id = F.shiftleft("sent_id", REF_BITS) + F.col("_ref")
    edge = 1 << (63 - REF_BITS)
    fits = F.col("sent_id").between(-edge, edge - 1) & (F.col("_ref") < 1 << REF_BITS)
    new_id = F.when(fits | F.col("sent_id").isNull(), new_id).otherwise(
        F.raise_error(F.lit("sent_id or number of references too large for explode_references"))
    )
    return rows.select(new_id.alias("sent_id"), *others, corrected)


def apart(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames with ids that no two of them share: each id times their number, plus the frame's place.

    Ids stay unique if they were within each frame; no shuffle. An id that
    does not fit fails the job.
    """
    n = len(frames)
    edge = (1 << 63) // max(n, 1) - 1
    own = F.when(F.col("sent_id").isNull() | F.col("sent_id").between(-edge, edge - 1), F.col("sent_id") * F.lit(n))
    own = own.otherwise(F.raise_error(F.lit("sent_id too large for apart")))
    return [df.withColumn("sent_id", own + F.lit(i)) for i, df in enumerate(frames)]


def concatenate(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)


def stack_pairs(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of named canonical frames, tagged with ``split``."""
    tagged = [cast_to(df).withColumn("split", F.lit(name)) for name, df in frames.items()]
    return concatenate(tagged).select("split", *PAIR_COLUMNS)


def training_frame(pairs: DataFrame, task_prefix: str) -> DataFrame:
    """What a trainer reads: prefix, input_text, target_text."""
    return pairs.select(
        F.lit(clean_task_prefix(task_prefix)).alias("prefix"),
        F.coalesce("input_text", F.lit("")).alias("input_text"),
        F.coalesce("target_text", F.lit("")).alias("target_text"),
    )


def map_columns(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Add or replace columns, all computed from the incoming row."""
    return df.withColumns(derived)


#: Called once in each Python worker; gives a function from the input columns to the output columns, by name.
BatchFunction = Callable[[], Callable[[dict[str, pa.Array]], Mapping[str, pa.Array | list]]]


def map_batches(df: DataFrame, make: BatchFunction, inputs: Sequence[str], schema: str) -> DataFrame:
    """Add or replace columns computed from whole batches of several others.

    Only ``inputs`` travel to Python and only the columns of ``schema`` come back, as one
    Arrow struct; all other columns stay where they are. A batch that gives other columns than
    declared, or another number of rows, fails the job.
    """
    fields = T._parse_datatype_string(schema).fields
    names, held = list(inputs), []

    @F.arrow_udf(T.StructType(fields))
    def run(*columns: pa.Array) -> pa.Array:
        if not held:
            held.append(make())
        made = held[0](dict(zip(names, columns)))
        wanted = [f.name for f in fields]
        if sorted(made) != sorted(wanted) or any(len(made[name]) != len(columns[0]) for name in wanted):
            raise ValueError(f"a batch must give {wanted}, one value for each row")
        arrays = []
        for field in fields:
            kind, value = to_arrow_type(field.dataType), made[field.name]
            arrays.append(value.cast(kind) if isinstance(value, pa.Array) else pa.array(value, kind))
        return pa.StructArray.from_arrays(arrays, wanted)

    # Nondeterministic, so that no filter above runs it twice.
    called = df.withColumn("_made", run.asNondeterministic()(*[F.col(f"`{c}`") for c in names]))
    return called.withColumns({f.name: F.col("_made")[f.name] for f in fields}).drop("_made")

"""Seeded order, head/tail splits and row lookup by explicit row id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpen.session import materialize

#: Hexadecimal digits of the key that each counting step adds.
PREFIX_DIGITS = 4


def shuffle_key(seed: int, row_id: str = "sent_id") -> Column:
    """Pseudo-random, engine-independent position of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int, row_id: str = "sent_id") -> DataFrame:
    """All rows in seeded order: one range-partitioned sort."""
    return df.orderBy(shuffle_key(seed, row_id), row_id)


def seeded_head(df: DataFrame, n: int, seed: int, row_id: str = "sent_id") -> DataFrame:
    """The first ``n`` rows of the seeded order, as a top-k."""
    return seeded_shuffle(df, seed, row_id).limit(n)


seeded_sample = seeded_head


def head_tail_split(
    df: DataFrame, n: int, seed: int, gap: int = 0, row_id: str = "sent_id"
) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows of the seeded order, and all rows after the next ``gap``.

    Only the boundary keys are computed; both parts are then plain filters on
    the row's own key, so the large part is never shuffled, joined or numbered.
    Both boundaries together take two passes over ``df``, whatever n is.
    """
    kind = df.schema[row_id].dataType
    here = F.struct(shuffle_key(seed, row_id).alias("k"), F.col(row_id).alias("id"))
    found = keys_at(df.select(here.alias("at")), {n, n + gap} - {0})
    edge = lambda place: F.struct(F.lit(found[place].k).alias("k"), F.lit(found[place].id).cast(kind).alias("id"))
    none = df.where(F.lit(False))
    head = none if not n else df.where(here <= edge(n)) if n in found else df
    tail = df if not n + gap else df.where(here > edge(n + gap)) if n + gap in found else none
    return head, tail


def keys_at(keys: DataFrame, places: set[int]) -> dict[int, Row]:
    """The keys (k, id) of column ``at`` at some places of their order, counted from 1; none beyond the last.

    The first pass counts the rows per prefix of ``PREFIX_DIGITS`` digits, which shows
    the one that holds each place. The second stores the rows of those prefixes,
    1 in 16**PREFIX_DIGITS each; these are counted by the next digits, and only what
    shares both prefixes with a boundary is ranked.
    """
    if not places:
        return {}
    prefixed = keys.withColumn("first", F.substring("at.k", 1, PREFIX_DIGITS))
    firsts = _holding(prefixed.groupBy("first").agg(F.count("*").alias("n")), "first", {p: p for p in places})
    wanted = sorted({row["first"] for row, _ in firsts.values()})
    if not wanted:
        return {}
    edges = materialize(prefixed.where(F.col("first").isin(wanted)), "edges")
    out = {}
    for place, (row, left) in firsts.items():
        mine = edges.where(F.col("first") == row["first"]).withColumn("next", F.substring("at.k", PREFIX_DIGITS + 1, PREFIX_DIGITS))
        held = _holding(mine.groupBy("next").agg(F.count("*").alias("n")), "next", {place: left})
        (found, rank), inner = held[place], mine
        ranked = inner.where(F.col("next") == found["next"]).withColumn("rank", F.row_number().over(W.orderBy("at")))
        out[place] = ranked.where(F.col("rank") == rank).first().at
    return out


def _holding(counts: DataFrame, prefix: str, places: dict[int, int]) -> dict[int, tuple[Row, int]]:
    """Per place: the prefix that holds it, and its place among that prefix's rows."""
    before = F.coalesce(F.sum("n").over(W.orderBy(prefix).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before)
    holds = lambda place: (F.col("before") < place) & (F.col("before") + F.col("n") >= place)
    any_ = reduce(lambda x, y: x | y, [holds(p) for p in places.values()])
    rows = placed.where(any_).collect()  # one for each place at most
    return {
        name: (row, place - row.before)
        for name, place in places.items()
        for row in rows
        if row.before < place <= row.before + row.n
    }


def prefix_take(df: DataFrame, n: int | None, order_by: str = "sent_id") -> DataFrame:
    """The first ``n`` rows by an explicit key; everything if ``n`` is None."""
    return df if n is None else df.orderBy(order_by).limit(n)


def rows_at(df: DataFrame, ids: DataFrame, row_id: str = "sent_id") -> DataFrame:
    """The rows whose id is listed."""
    return df.join(ids.select(row_id).distinct(), row_id, "left_semi")

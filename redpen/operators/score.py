"""Edit scoring: gold against hypothesis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpen.functions import metrics

STRICT_KEY = ("sent_id", "edit_key")
SPAN_KEY = ("sent_id", "o_start", "o_end", "c_str")
NOOP = "noop"


def drop_noop(edits: DataFrame) -> DataFrame:
    return edits.where(F.col("type") != NOOP)


def match_edits(
    gold: DataFrame, hyp: DataFrame, key: tuple[str, ...] = SPAN_KEY, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per distinct edit with tp, fp and fn flags.

    The full outer match of two edit sets, computed as one hash aggregation of
    their union: duplicates collapse before the shuffle and no side is sorted.
    Columns in ``keep`` come from gold where gold has the edit.
    """
    sides = [
        side.select(*key, *keep, F.lit(is_gold).alias("_gold"))
        for side, is_gold in ((gold, True), (hyp, False))
    ]
    return flag_edits(sides[0].unionByName(sides[1]), key, keep)


def flag_edits(
    both: DataFrame, key: tuple[str, ...] = SPAN_KEY, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``match_edits`` over one frame whose ``_gold`` column tells the side."""
    in_gold, in_hyp = F.bool_or("_gold"), F.bool_or(~F.col("_gold"))
    kept = [
        F.coalesce(F.max(F.when(F.col("_gold"), F.col(c))), F.max(c)).alias(c) for c in keep
    ]
    grouped = both.groupBy(*key).agg(in_gold.alias("_g"), in_hyp.alias("_h"), *kept)
    flag = lambda condition, name: condition.cast("int").alias(name)
    return grouped.select(
        *key,
        *keep,
        flag(F.col("_g") & F.col("_h"), "tp"),
        flag(~F.col("_g"), "fp"),
        flag(~F.col("_h"), "fn"),
    )


def totals(flags: DataFrame) -> DataFrame:
    """One row: tp, fp, fn."""
    return flags.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def score(flags: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, p, r, f05."""
    return with_scores(totals(flags), beta)


def with_scores(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", *metrics.scores(tp, fp, fn, beta))


def per_sentence(flags: DataFrame) -> DataFrame:
    """tp, fp and fn of each sentence that has an edit on either side."""
    return flags.groupBy("sent_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def per_sentence_sets(sentences: DataFrame, gold: str = "gold", hyp: str = "hyp") -> DataFrame:
    """The same counts from two arrays of edit keys per row, without a shuffle."""
    g, h = F.col(gold), F.col(hyp)
    return sentences.select(
        "sent_id",
        F.size(F.array_intersect(g, h)).alias("tp"),
        F.size(F.array_except(h, g)).alias("fp"),
        F.size(F.array_except(g, h)).alias("fn"),
    )


def by_category(flags: DataFrame, beta: float = 0.5, digits: int | None = 4) -> DataFrame:
    """Counts and scores per category; the row with a null category is the total."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    table = with_scores(flags.rollup("category").agg(*sums), beta)
    if digits is None:
        return table
    rounded = [F.round(c, digits).alias(c) for c in ("p", "r", "f05")]
    return table.select("category", "tp", "fp", "fn", *rounded)


def score_strict(gold: DataFrame, hyp: DataFrame, ignore_noop: bool = True) -> DataFrame:
    """Span, type and correction must agree. Inputs carry ``edit_key`` and ``type``."""
    gold = drop_noop(gold) if ignore_noop else gold
    return score(match_edits(gold, hyp, STRICT_KEY))


def score_span(gold: DataFrame, hyp: DataFrame) -> DataFrame:
    """Span and correction must agree; noop edits never count."""
    return score(match_edits(drop_noop(gold), drop_noop(hyp), SPAN_KEY))


def unmatched(left: DataFrame, right: DataFrame, key: str = "sent_id") -> DataFrame:
    """Keys present on one side only: empty when two inputs line up."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = sides.groupBy(key).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return counted.where((F.col("n_left") != 1) | (F.col("n_right") != 1))


def zip_on_id(left: DataFrame, right: DataFrame, key: str = "sent_id", check: bool = True) -> DataFrame:
    """Row-aligned join of two inputs by explicit id.

    With ``check`` the job that reads the result fails if the inputs do not hold the
    same ids once each. Nothing runs before, and each side is read and shuffled
    once: counting the ids needs no other order than the join.
    """
    if not check:
        return left.join(right, key)
    counted = lambda df, name: df.withColumn(name, F.count(F.lit(1)).over(W.partitionBy(key)))
    both = counted(left, "_left").join(counted(right, "_right"), key, "full")
    fits = F.coalesce((F.col("_left") == 1) & (F.col("_right") == 1), F.lit(False))
    at = F.concat(F.lit(f"inputs do not line up, for example at {key}="), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    # The random number is always below 2. It keeps the optimizer from trying the filter out on
    # rows of nulls, which would raise the error at once.
    checked = F.when(fits, F.rand() < 2).otherwise(F.raise_error(at).cast("boolean"))
    return both.where(checked).drop("_left", "_right")


def evaluate(
    flags: DataFrame, metrics_by_name: dict[str, Callable[[DataFrame], Column]]
) -> DataFrame:
    """User metrics over the total counts: rows (metric, value)."""
    counts = totals(flags)
    pairs = [
        F.struct(F.lit(name).alias("metric"), fn(counts).cast("double").alias("value"))
        for name, fn in metrics_by_name.items()
    ]
    return counts.select(F.inline(F.array(*pairs)))

"""Token edits between an original and a corrected text, as one corpus job.

Both texts go to an Arrow batch function that splits them, trims the common ends
and aligns the middle that is left, for whole batches at once. Native expressions for
arrays are interpreted element by element: splitting and trimming by them took
longer than the alignment, and the matrix about twenty times as long.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpen.functions.arrays import bind
from redpen.functions.text import M2_SEP, edit_key, tokens
from redpen.operators import alignment, likeness
from redpen.schema import SPAN

MERGES = ("all-merge", "all-split", "all-equal")
#: A further way, by rules over the operations; it needs the cost by likeness.
RULES = "rules"
#: ``unit``: fewest operations; ``likeness``: alike words replace each other, blocks may move.
COSTS = ("unit", "likeness")

EDIT_COLUMNS = ("o_str", "o_start", "o_end", "c_str", "c_start", "c_end")


def _span_udf(merge: str, cost: str, features: bool):
    if merge not in (*MERGES, RULES):
        raise ValueError(f"merge must be one of {(*MERGES, RULES)}")
    if cost not in COSTS:
        raise ValueError(f"cost must be one of {COSTS}")
    if cost == "unit" and (merge == RULES or features):
        raise ValueError("rules and features need cost='likeness'")
    edit_spans = alignment.edit_spans if cost == "unit" else likeness.edit_spans

    def find(*lists: pa.ListArray) -> pa.ListArray:
        return edit_spans(lists[0], lists[1], merge, *lists[2:])

    @F.arrow_udf(T.ArrayType(SPAN))
    def spans(original: pa.Array, corrected: pa.Array) -> pa.Array:
        return alignment.text_spans(original, corrected, find)

    @F.arrow_udf(T.ArrayType(SPAN))
    def spans_by_features(original: pa.Array, corrected: pa.Array, o_feats: pa.Array, c_feats: pa.Array) -> pa.Array:
        return alignment.text_spans(original, corrected, find, o_feats, c_feats)

    # Filters on the result must not be pushed below it: they would run it twice.
    return (spans_by_features if features else spans).asNondeterministic()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _token_lists(texts: pa.Array) -> pa.Array:
    return alignment.token_lists(texts)


def token_lists(text: Column) -> Column:
    """``tokens`` of a whole column by Arrow batch."""
    return F.when(text.isNotNull(), _token_lists.asNondeterministic()(text))


def _common_run(left: Column, right: Column) -> Column:
    """Length of the common start of two arrays."""
    differ = F.array_position(F.zip_with(left, right, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, F.size(left)).otherwise(differ - 1).cast("int")


def align(
    pairs: DataFrame,
    original: str = "original",
    corrected: str = "corrected",
    merge: str = "all-merge",
    cost: str = "unit",
    features: tuple[str, str] | None = None,
) -> DataFrame:
    """Adds ``spans``, the edits of each pair.

    Null text counts as empty text. ``features`` names two arrays with a struct (lemma, pos, ...) for
    each token of either side; a missing or shorter one counts as unknown from its end on.
    """
    sides = [F.col(original), F.col(corrected)]
    for f in features or ():
        sides.append(F.transform(f, lambda x: F.struct(x["lemma"].alias("lemma"), x["pos"].alias("pos"))))
    return pairs.withColumn("spans", _span_udf(merge, cost, bool(features))(*sides))


def operation(o_str: Column, c_str: Column) -> Column:
    """``M`` for a missing, ``U`` for an unnecessary, ``R`` for a replaced span."""
    return F.when(o_str == "", "M").when(c_str == "", "U").otherwise("R")


def extract_edits(
    pairs: DataFrame,
    keys: tuple[str, ...] = ("sent_id",),
    original: str = "original",
    corrected: str = "corrected",
    merge: str = "all-merge",
    compare_first: bool = True,
    cost: str = "unit",
    features: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per edit: keys, edit_no, op, o_str, o_start, o_end, c_str, c_start, c_end.

    Narrow: no shuffle, so it runs inside the stage that reads the pairs. Rows
    are spread by the caller when a few files hold all the text.

    ``compare_first`` drops equal pairs before anything else. That pays for stored
    columns; texts derived in the same plan would be derived twice for it, once
    for the comparison and once for the edits.
    """
    if compare_first:
        pairs = pairs.where(F.col(original) != F.col(corrected))
    own = pairs.select(*keys, original, corrected, *(features or ()))
    spans = align(own, original, corrected, merge, cost, features)
    rows = spans.select(*keys, F.posexplode("spans").alias("edit_no", "e"))
    op = operation(F.col("e.o_str"), F.col("e.c_str")).alias("op")
    return rows.select(*keys, "edit_no", op, *[f"e.{c}" for c in EDIT_COLUMNS])


def token_distance(
    pairs: DataFrame,
    keys: tuple[str, ...] = ("sent_id",),
    original: str = "original",
    corrected: str = "corrected",
) -> DataFrame:
    """Smallest number of token insertions, deletions and substitutions."""
    aligned = align(pairs.select(*keys, original, corrected), original, corrected, "all-split")
    return aligned.select(*keys, F.size("spans").alias("distance"))


def collect_edits(edits: DataFrame, key: str = "sent_id") -> DataFrame:
    """The edits of each sentence as one ordered array (bounded by its tokens)."""
    columns = [c for c in edits.columns if c != key]
    ordered = F.array_sort(F.collect_list(F.struct("edit_no", *[c for c in columns if c != "edit_no"])))
    return edits.groupBy(key).agg(ordered.alias("edits"))


def with_edits(
    pairs: DataFrame,
    original: str = "original",
    corrected: str = "corrected",
    merge: str = "all-merge",
    cost: str = "unit",
    features: tuple[str, str] | None = None,
) -> DataFrame:
    """Every pair with its edits as an array, without a shuffle."""
    aligned = align(pairs, original, corrected, merge, cost, features)
    shown = F.transform(
        "spans",
        lambda e, k: F.struct(
            k.alias("edit_no"),
            operation(e["o_str"], e["c_str"]).alias("op"),
            e["o_str"].alias("o_str"),
            e["o_start"].alias("o_start"),
            e["o_end"].alias("o_end"),
            e["c_str"].alias("c_str"),
            e["c_start"].alias("c_start"),
            e["c_end"].alias("c_end"),
        ),
    )
    return aligned.withColumn("edits", shown).drop("spans")


def apply_edits(original: Column, edits: Column) -> Column:
    """Rebuild the corrected token string from original tokens and sorted edits.

    Each edit contributes the kept tokens since the edit before it plus its
    correction, so the work is linear in tokens plus edits.
    """
    ends = F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["o_end"]))

    def rebuilt(row: Column) -> Column:
        toks, ends = row["toks"], row["ends"]
        pieces = F.transform(
            row["edits"],
            lambda e, k: F.concat(
                F.slice(toks, F.get(ends, k) + 1, e["o_start"] - F.get(ends, k)),
                tokens(e["c_str"]),
            ),
        )
        tail_from = F.element_at(ends, -1)
        rest = F.slice(toks, tail_from + 1, F.greatest(F.size(toks) - tail_from, F.lit(0)))
        return F.array_join(F.concat(F.flatten(pieces), rest), " ")

    return bind({"toks": tokens(original), "ends": ends, "edits": edits}, rebuilt)


def single_span(
    pairs: DataFrame,
    keys: tuple[str, ...] = ("sent_id",),
    original: str = "original",
    corrected: str = "corrected",
) -> DataFrame:
    """The one span between the common start and the common end of each pair."""
    filled = lambda name: F.coalesce(F.col(name), F.lit(""))
    rest = lambda side: F.slice(F.col(side), F.col("o_start") + 1, F.size(side) - F.col("o_start"))
    cut = lambda side: F.slice(F.col(side), F.lit(1), F.size(side) - F.col("_tail"))
    return (
        pairs.where(filled(original) != filled(corrected))
        .select(*keys, tokens(filled(original)).alias("_o"), tokens(filled(corrected)).alias("_c"))
        .where(F.col("_o") != F.col("_c"))
        .withColumn("o_start", _common_run(F.col("_o"), F.col("_c")))
        .withColumns({"_or": rest("_o"), "_cr": rest("_c")})
        .withColumn("_tail", _common_run(F.reverse("_or"), F.reverse("_cr")))
        .select(
            *keys,
            "o_start",
            (F.size("_o") - F.col("_tail")).alias("o_end"),
            F.array_join(cut("_or"), " ").alias("o_str"),
            F.array_join(cut("_cr"), " ").alias("c_str"),
        )
    )


def m2_type(op: Column, category: Column) -> Column:
    """``R:SPELL`` and the like."""
    return F.concat_ws(":", op, category)


def with_edit_key(edits: DataFrame) -> DataFrame:
    """Adds ``edit_key`` to edits that carry ``type``."""
    key = edit_key(F.col("o_start"), F.col("o_end"), F.col("type"), F.col("c_str"))
    return edits.withColumn("edit_key", key)


def parse_edit_key(key: Column) -> Column:
    """``start end|||TYPE|||correction`` back to a struct."""
    fields = F.split(key, "\\|\\|\\|")
    span = F.split(F.get(fields, F.lit(0)), " ")
    return F.struct(
        F.get(span, F.lit(0)).cast("int").alias("o_start"),
        F.get(span, F.lit(1)).cast("int").alias("o_end"),
        F.get(fields, F.lit(1)).alias("type"),
        F.coalesce(F.get(fields, F.lit(2)), F.lit("")).alias("c_str"),
    )

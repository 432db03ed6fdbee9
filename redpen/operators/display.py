"""Edits shown to a reader: marked-up sentences and coloured segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import markup as M
from redpen.functions.text import tokenize
from redpen.operators.classify import category_rules
from redpen.operators.edits import token_lists, with_edits
from redpen.operators.predict import Predictor, predict_texts

EDIT_VIEW = ("type", "o_str", "o_start", "o_end", "c_str", "c_start", "c_end")


def typed(edits: Column) -> Column:
    """Adds ``type`` to an array of edits, by the string and closed-class rules."""
    return F.transform(
        edits,
        lambda e: F.struct(
            F.concat_ws(":", e["op"], category_rules(e["o_str"], e["c_str"])).alias("type"),
            *[e[c].alias(c) for c in EDIT_VIEW[1:]],
        ),
    )


def with_typed_edits(
    pairs: DataFrame, original: str = "original", corrected: str = "corrected"
) -> DataFrame:
    """Pairs with ``toks`` and their typed ``edits``; no shuffle."""
    aligned = with_edits(pairs, original, corrected)
    return aligned.withColumns({"edits": typed(F.col("edits")), "toks": token_lists(F.col(original))})


def show_edits(edits: DataFrame, keys: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """The edit table for reading: category without its operation first."""
    return edits.select(*keys, F.col("category").alias("type"), *EDIT_VIEW[1:])


def highlight(pairs: DataFrame, compat: bool = False, keys: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """``markup``: the original with its edits as inline tags."""
    rows = with_typed_edits(pairs)
    toks, edits = F.col("toks"), F.col("edits")
    text = M.compat_markup(toks, edits) if compat else M.markup(M.pieces(toks, edits))
    return rows.select(*keys, text.alias("markup"))


def segments(pairs: DataFrame, keys: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """One row per displayed piece: seg_no, text, type, color.

    Built from the edits, so quotes in the text cannot break it.
    """
    rows = with_typed_edits(pairs).select(
        *keys, F.posexplode(M.pieces(F.col("toks"), F.col("edits"))).alias("seg_no", "piece")
    )
    return rows.select(*keys, "seg_no", M.display(F.col("piece")).alias("d")).select(
        *keys, "seg_no", "d.text", "d.type", "d.color"
    )


def segments_of_markup(marked: DataFrame, keys: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """The same rows from stored markup, by splitting and parsing its tags."""
    rows = marked.select(*keys, F.posexplode(M.split_markup(F.col("markup"))).alias("seg_no", "piece"))
    shown = M.display(M.parse_piece(F.col("piece"))).alias("d")
    return rows.select(*keys, "seg_no", shown).select(*keys, "seg_no", "d.text", "d.type", "d.color")


def check(
    texts: DataFrame,
    predictor: Predictor,
    text: str = "input_text",
    keys: tuple[str, ...] = ("sent_id",),
    compat: bool = False,
) -> DataFrame:
    """Correct each text and explain how: keys, input_text, output_text, markup.

    Stateless and free of shuffles, so it also runs on a stream.
    """
    predicted = predict_texts(
        texts.select(*keys, F.col(text).alias("input_text")), predictor, "input_text", "output_text"
    )
    both = predicted.withColumns(
        {"original": tokenize(F.col("input_text")), "corrected": tokenize(F.col("output_text"))}
    )
    rows = with_typed_edits(both)
    toks, edits = F.col("toks"), F.col("edits")
    marked = M.compat_markup(toks, edits) if compat else M.markup(M.pieces(toks, edits))
    return rows.select(*keys, "input_text", "output_text", marked.alias("markup"))

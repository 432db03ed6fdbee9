"""Edit extraction and scoring as jobs over files or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.functions.text import tokenize
from redpen.operators.classify import build_vocabulary, classify, classify_counts
from redpen.operators.edits import extract_edits, with_edit_key
from redpen.operators.score import (
    SPAN_KEY,
    by_category,
    drop_noop,
    flag_edits,
    match_edits,
    score_strict,
)
from redpen.sources.files import read_pair_csv
from redpen.sources.lines import Numbered, numbered, numbered_lines, side_by_side
from redpen.sources.m2 import m2_edits, read_m2
from redpen.sources.sinks import write_m2, write_results


def both_sides(triples: DataFrame, original: str, gold: str, hyp: str, **extraction: str) -> DataFrame:
    """Gold and hypothesis edits of the same sentences in one pass.

    Narrow: the texts stay where they were read, only edits are shuffled later.
    ``extraction``: ``merge`` and ``cost`` of ``extract_edits``.
    """
    sides = F.array(
        F.struct(F.lit(True).alias("_gold"), F.col(gold).alias("corrected")),
        F.struct(F.lit(False).alias("_gold"), F.col(hyp).alias("corrected")),
    )
    stacked = triples.select("sent_id", F.col(original).alias("original"), F.inline(sides))
    return extract_edits(stacked, ("sent_id", "_gold"), **extraction)


def flags_of_triples(triples: DataFrame, original: str, gold: str, hyp: str, **extraction: str) -> DataFrame:
    """tp, fp and fn flags of every distinct edit, with op and o_str.

    The span decides op and o_str, so they join the key: a hash aggregation over
    fixed-width flags, where carrying strings along would force a sort.
    """
    edits = both_sides(triples, original, gold, hyp, **extraction)
    return flag_edits(edits, (*SPAN_KEY, "op", "o_str"))


def score_triples(
    triples: DataFrame,
    vocabulary: DataFrame,
    original: str = "original",
    gold: str = "corrected",
    hyp: str = "prediction",
    digits: int | None = 4,
    families: int | None = None,
    **extraction: str,
) -> DataFrame:
    """Category report of predictions against corrections of the same originals."""
    flags = flags_of_triples(triples, original, gold, hyp, **extraction)
    return by_category(classify_counts(flags, vocabulary, families), digits=digits)


def parallel_to_m2(
    spark: SparkSession,
    original_path: str,
    corrected_path: str,
    out_path: str,
    min_count: int = 1,
    vocabulary: DataFrame | None = None,
    compression: str | None = None,
    **extraction: str,
) -> None:
    """Two line-aligned files to an M2 file.

    Give both sides of a comparison the same ``vocabulary``; without one, the
    words of the corrected file are counted, and a misspelling that predictions
    repeat would pass as known.
    """
    originals = numbered_lines(spark, original_path, "original")
    pairs = side_by_side(originals, numbered_lines(spark, corrected_path, "corrected"))
    if vocabulary is None:
        vocabulary = build_vocabulary(pairs, "corrected", min_count)
    write_m2(originals.rows, classify(extract_edits(pairs, **extraction), vocabulary), out_path, compression=compression)


def compare_m2(
    spark: SparkSession, hyp_path: str, gold_path: str, json_path: str | None = None
) -> DataFrame:
    """Category report of two M2 files: spans and corrections must agree."""
    gold, hyp = (drop_noop(m2_edits(read_m2(spark, p, texts=False))) for p in (gold_path, hyp_path))
    report = by_category(match_edits(gold, hyp, SPAN_KEY, ("category",)))
    if json_path:
        write_results(report, json_path)
    return report


def evaluate_files(
    spark: SparkSession,
    pairs_path: str,
    predictions_path: str,
    gold_path: str,
    vocabulary: DataFrame | None = None,
    min_count: int = 1,
    ignore_noop: bool = False,
    **extraction: str,
) -> DataFrame:
    """Strict record (tp, fp, fn, p, r, f05) of a predictions file against M2 gold.

    ``pairs_path`` is the pair CSV that holds the originals; row, line and
    sentence numbers must line up, otherwise the job fails. A gold ``noop``
    counts as a missed edit unless ``ignore_noop``. Without a ``vocabulary`` the
    words of the CSV's targets are counted.
    """
    pairs = read_pair_csv(spark, pairs_path)
    # Targets are moved only if their words are wanted.
    pairs = numbered(pairs if vocabulary is None else pairs.select("input_text"), whole=True)
    gold = read_m2(spark, gold_path, texts=False)
    sentences = Numbered(gold.select("sent_id"), pairs.n, 0)
    predicted = side_by_side(pairs, numbered_lines(spark, predictions_path, "prediction"), sentences)
    if vocabulary is None:
        vocabulary = build_vocabulary(pairs.rows.select(tokenize(F.col("target_text")).alias("t")), "t", min_count)
    sides = predicted.select(
        "sent_id",
        tokenize(F.col("input_text")).alias("original"),
        tokenize(F.col("prediction")).alias("corrected"),
    )
    hyp = with_edit_key(classify(extract_edits(sides, **extraction), vocabulary))
    return score_strict(with_edit_key(m2_edits(gold, ignore_noop)), hyp, ignore_noop)

"""The corpora: how each is laid out and cleaned into canonical pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.functions.charedits import apply_char_edits
from redpen.functions.text import detokenize, normalize_ws, strip, tokenize
from redpen.operators.order import prefix_take
from redpen.operators.rows import canonical, drop_empty, drop_identical, explode_references
from redpen.sources.files import read_json_lines, read_table
from redpen.sources.lines import first_rows, with_row_ids


@dataclass(frozen=True)
class Corpus:
    """A source: raw schema, and the step from raw rows (with ``sent_id``) to pairs.

    A new source needs only another instance; ``clean`` is its cleaning hook.
    """

    name: str
    schema: str
    clean: Callable[[DataFrame], DataFrame]

    def pairs(self, raw: DataFrame) -> DataFrame:
        """Canonical pairs from raw rows."""
        return canonical(self.clean(raw), self.name, "input", "target", "original", "corrected")

    def load(
        self, spark: SparkSession, path: str, fmt: str = "parquet", take_n: int | None = None
    ) -> DataFrame:
        """Canonical pairs from files; rows without ``sent_id`` are numbered in file order.

        The first ``take_n`` of these are taken from the first files alone.
        """
        raw = read_json_lines(spark, path, self.schema) if fmt == "json" else read_table(spark, path, fmt)
        if "sent_id" in raw.columns:
            return self.pairs(prefix_take(raw, take_n))
        if take_n is None:
            return self.pairs(with_row_ids(raw))
        few = lambda files: read_table(spark, files, fmt, raw.schema)
        return self.pairs(first_rows(raw, take_n, few))


def _derive(df: DataFrame, function: Callable[[Column], Column], **columns: str) -> DataFrame:
    return df.withColumns({new: function(F.col(old)) for new, old in columns.items()})


def _clean_and_detokenize(df: DataFrame) -> DataFrame:
    stripped = _derive(df, strip, original="original", corrected="corrected")
    kept = drop_identical(drop_empty(stripped))
    return _derive(kept, detokenize, input="original", target="corrected")


def _detokenize(df: DataFrame) -> DataFrame:
    return _derive(df, detokenize, input="original", target="corrected")


def _tokenize(df: DataFrame) -> DataFrame:
    texts = df.withColumnsRenamed({"output": "target"})
    return _derive(texts, tokenize, original="input", corrected="target")


def _explode_and_clean(df: DataFrame) -> DataFrame:
    rows = explode_references(df, "corrections", "corrected")
    return _clean_and_detokenize(rows.withColumnRenamed("sentence", "original"))


def _edit_and_tokenize(df: DataFrame) -> DataFrame:
    edited = df.withColumn("target", apply_char_edits(F.col("text"), F.col("edits"))).drop("edits")
    cleaned = _derive(edited, normalize_ws, input="text", target="target")
    return _derive(cleaned, tokenize, original="input", corrected="target")


_TOKENIZED = "original STRING, corrected STRING"
_EDITED = "text STRING, edits STRUCT<start: ARRAY<INT>, end: ARRAY<INT>, text: ARRAY<STRING>>"

MERLIN = Corpus("merlin", _TOKENIZED, _clean_and_detokenize)
PIE = Corpus("pie", _TOKENIZED, _detokenize)
C4_200M = Corpus("c4_200m", "input STRING, output STRING", _tokenize)
JFLEG = Corpus("jfleg", "sentence STRING, corrections ARRAY<STRING>", _explode_and_clean)
WI = Corpus("wi", _EDITED, _edit_and_tokenize)
LOCNESS = Corpus("locness", _EDITED, _edit_and_tokenize)

CORPORA = {c.name: c for c in (MERLIN, PIE, C4_200M, JFLEG, WI, LOCNESS)}


def merlin_path(root: str, lang: str) -> str:
    """MERLIN keeps one JSON-lines file per language."""
    return f"{root}/{lang}.jsonl"

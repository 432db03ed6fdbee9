"""The whole chain: prepare, gold edits, fit, tag, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from redpen.operators.classify import build_vocabulary, classify_counts
from redpen.operators.edits import extract_edits
from redpen.operators.predict import Predictor, fit_lexicon, predict_lexicon, tag
from redpen.operators.score import SPAN_KEY, by_category, match_edits
from redpen.plans.prepare import PrepareConfig, prepare


@dataclass(frozen=True)
class ChainConfig:
    task_prefix: str = "Grammar"
    min_count: int = 2
    prepare: PrepareConfig = PrepareConfig()


def run_chain(
    spark: SparkSession,
    root: str,
    eval_pool: DataFrame,
    test: DataFrame,
    extra_train: tuple[DataFrame, ...] = (),
    predictor: Predictor | None = None,
    config: ChainConfig = ChainConfig(),
) -> DataFrame:
    """Runs every stage with a table in between; returns the category report.

    Without a predictor the corrections counted in the training part are used.
    """

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    splits = {
        name: stage(name, df)
        for name, df in prepare(eval_pool, test, extra_train, config.prepare).items()
    }
    vocabulary = stage("vocabulary", build_vocabulary(splits["train"], "corrected", config.min_count))
    gold = stage("edits-gold", extract_edits(splits["test"]))
    if predictor is None:
        lexicon = stage("lexicon", fit_lexicon(extract_edits(splits["train"], merge="all-split"), config.min_count))
        tagged = predict_lexicon(splits["test"], lexicon)
    else:
        tagged = tag(splits["test"], predictor, config.task_prefix)
    tagged = stage("predictions", tagged.select("sent_id", "original", "prediction"))
    hyp = stage("edits-hyp", extract_edits(tagged, corrected="prediction"))
    flags = match_edits(gold, hyp, (*SPAN_KEY, "op", "o_str"))
    return stage("results", by_category(classify_counts(flags, vocabulary)))

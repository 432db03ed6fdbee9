"""Corpora to training, evaluation and test splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from redpen.operators.order import head_tail_split
from redpen.operators.rows import apart, cast_to, concatenate


@dataclass(frozen=True)
class PrepareConfig:
    seed: int = 42
    n_eval: int = 1000
    #: Rows between evaluation and training part that go to neither.
    gap: int = 0


def prepare(
    eval_pool: DataFrame,
    test: DataFrame,
    extra_train: tuple[DataFrame, ...] = (),
    config: PrepareConfig = PrepareConfig(),
) -> dict[str, DataFrame]:
    """Canonical pairs to ``train``, ``eval`` and ``test``.

    The pool's seeded head becomes ``eval``; its tail and the extra sources
    become ``train``, with ids made unique over its sources (`rows.apart`). All parts are lazy and read their sources directly.
    """
    head, tail = head_tail_split(cast_to(eval_pool), config.n_eval, config.seed, config.gap)
    parts = [tail, *[cast_to(df) for df in extra_train]]
    train = concatenate(apart(parts) if extra_train else parts)
    return {"train": train, "eval": head, "test": cast_to(test)}

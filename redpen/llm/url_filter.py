"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

A url's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; its path goes on from there to ``?``, ``#`` or the end.
A rule like ``example.net/en/`` fits its host and all subdomains if the path
starts with the rule's; the longest fitting rule wins (of equally long ones, a
blocking one, then the first by code point).

Urls that a rule decides are the labelled ones. Trees learn from them how a
blocked url looks and judge the urls that no rule fits: block from an even
chance on. Features are lengths, path depth, host labels, digit ratios, character
entropies, parameters and hyphens, and statistics of suffixes: of the last
label, the last two labels and the whole of the host, and of the file ending,
how many urls have it and which share of the labelled ones is blocked.

Suffix statistics cover all rows. They are counted in ``BUCKETS`` hashed places
for each kind of suffix, so what is broadcast does not grow with the input; suffixes that
meet in a place share its counts. A training url takes the shares from the folds
it is not in, otherwise the trees would read its own label off them. The trees are
fitted on a sample of about ``TRAIN_URLS`` distinct labelled urls, chosen by hash.

Defined cases. A null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the trees like any other; its features come from its
characters, none for null. Repeated rows are judged each; a url of any length is
read whole. Without labelled urls every verdict is allow; if all are of one
verdict, it is everyone's. No rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.tables import stored

BLOCK, ALLOW = "block", "allow"
#: (verdict, rule).
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
BUCKETS, KINDS, FOLDS = 1 << 13, 4, 5
#: Distinct labelled urls to learn from, about.
TRAIN_URLS = 20_000
#: Labelled urls of the overall share that a suffix starts with.
PRIOR = 5.0
TREES, DEPTH, STEP, SEED = 30, 4, 0.2, 13


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    found = [F.coalesce(F.regexp_extract(url, pattern, g), F.lit("")) for g in (1, 2)]
    return F.translate(found[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found[1]


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one asked first ends up innermost.
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK, tuple(-ord(c) for c in r[1]))):
        name, slash, start = text.partition("/")
        below = host.endswith("." + name)
        fits = ((host == name) | below) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    """Bits a character."""
    size = len(text)
    return -sum(n / size * log2(n / size) for n in Counter(text).values()) if size else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("#")[0].partition("?")[2]
    digits = lambda s: sum(map(str.isdigit, s)) / max(len(s), 1)
    signs = sum(not c.isalnum() for c in url) / max(len(url), 1)
    return [
        len(url), len(host), len(path), sum(map(bool, path.split("/"))), len(host.split(".")), host.count("-"),
        sum(map(bool, query.replace(";", "&").split("&"))), digits(url), digits(host), signs, entropy(url), entropy(host),
    ]


def suffixes(host: str, path: str) -> list[str]:
    """One suffix of each kind."""
    labels = host.split(".")
    ending = path.rpartition("/")[2].rpartition(".")
    return [labels[-1], ".".join(labels[-2:]), host, ending[2] if ending[1] else ""]


def slots(host: str, path: str) -> list[int]:
    return [kind * BUCKETS + xxhash.xxh64_intdigest(s) % BUCKETS for kind, s in enumerate(suffixes(host, path))]


def fold(url: str | None) -> int:
    return xxhash.xxh64_intdigest(url or "", 1) % FOLDS


def marked(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str, url: str) -> DataFrame:
    """(page_id, url, host, path, rule, by_rule) of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "by_rule": verdict})


def statistics(rows: DataFrame) -> np.ndarray:
    """Per suffix slot and fold: urls, labelled urls and blocked ones; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((KINDS * BUCKETS * FOLDS, 3), np.int64)
        for batch in batches:
            for url, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.array(slots(host, path)) * FOLDS + fold(url)
                held[at] += (1, verdict is not None, verdict == BLOCK)
        used = np.flatnonzero(held[:, 0])
        columns = [pa.array(x) for x in (used.astype(np.int64), *held[used].T)]
        yield pa.RecordBatch.from_arrays(columns, ["place", "n", "labelled", "blocked"])

    names = ("n", "labelled", "blocked")
    counts = rows.select("url", "host", "path", "by_rule").mapInArrow(run, "place long, n long, labelled long, blocked long")
    # At most KINDS * BUCKETS * FOLDS rows.
    table = counts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((KINDS * BUCKETS * FOLDS, 3))
    out[table["place"].to_numpy()] = np.stack([table[c].to_numpy() for c in names], axis=1)
    return out.reshape(KINDS * BUCKETS, FOLDS, 3)


def with_features(rows: DataFrame, counts: np.ndarray, known: bool) -> DataFrame:
    """Adds ``features``. ``known``: are these training urls, whose own fold must not count?"""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    @F.arrow_udf("array<double>")
    def features(url: pa.Array, host: pa.Array, path: pa.Array) -> pa.Array:
        counts = shared.value
        whole = counts.sum(axis=1)
        n, labelled, blocked = whole[:BUCKETS].sum(axis=0)
        made = []
        for u, h, p in zip(url.to_pylist(), host.to_pylist(), path.to_pylist()):
            at = slots(h, p)
            # For training urls the other folds, scaled to all.
            own = (whole[at] - counts[at, fold(u)]) * FOLDS / (FOLDS - 1) if known else whole[at]
            share = (own[:, 2] + PRIOR * blocked / max(labelled, 1)) / (own[:, 1] + PRIOR)
            made.append([*map(float, lexical(u or "", h, p)), *share.tolist(), *np.log1p(own[:, 0] / max(n, 1) * 1e6).tolist()])
        return pa.array(made, pa.list_(pa.float64()))

    return rows.withColumn("features", array_to_vector(features("url", "host", "path")))


def train(rows: DataFrame, counts: np.ndarray, urls: int = TRAIN_URLS) -> GBTClassificationModel | None:
    """Trees fitted on a sample of the labelled urls; None if these have fewer than two verdicts."""
    labelled = rows.where(F.col("by_rule").isNotNull())
    distinct = labelled.agg(F.approx_count_distinct("url")).first()[0] or 1
    places = 1 << 40
    chosen = F.pmod(F.xxhash64("url"), F.lit(places)) < int(min(1.0, urls / distinct) * places)
    label = F.max((F.col("by_rule") == BLOCK).cast("double")).alias("label")
    sample = labelled.where(chosen).groupBy("url", "host", "path").agg(label)
    # Bounded, so one ordered file: the same trees in each run.
    sample = with_features(sample, counts, known=True).select("url", "label", "features")
    sample = stored(sample.repartition(1).sortWithinPartitions("url"), "urls")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
    return trees.fit(sample)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", urls: int = TRAIN_URLS
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else the trees'; score is their chance of block."""
    rows = marked(pages, rules, key, url)
    counts = statistics(rows)
    _, labelled, blocked = counts[:BUCKETS].sum(axis=(0, 1))
    model = train(rows, counts, urls) if 0 < blocked < labelled else None
    if model is None:
        scored = rows.withColumn("score", F.lit(float(labelled > 0 and blocked == labelled)))
    else:
        scored = model.transform(with_features(rows, counts, known=False))
        scored = scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

"""Toxicity by compression distance: two zstandard dictionaries and calibrated window lengths.

One dictionary is trained on windows of ordinary text. The other is trained on
what sets toxic text apart, the words and word beginnings that make up a far
larger share of the contexts in toxic than in ordinary training texts, and
continues with the ordinary content, so that both compress common prose alike. A text is cut at
white space into windows; a window's gain is its length under the ordinary
dictionary minus its length under the toxic one. A logistic curve, fitted on
labelled texts that trained neither dictionary, turns a text's gains into a
score from 0 to 1.

A dictionary trained on the windows of toxic text themselves, as the plain method
has it, tells almost nothing apart (README has the figures): a few words in a text
of ordinary prose make it toxic, and the prose fills the dictionary.

Training reads a bounded sample: at most ``SAMPLE`` labelled texts of each
class, chosen by a hash of their id, whole. Scoring reads every whole text and
uses nothing but the text.

Defined cases: null or empty text has one empty window and the score of no
gain; without labels of both classes all scores are the share of toxic labels
(a half without any); rows that repeat an id are scored alike; several labels
of one document count as toxic if one is; texts may have any length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.tables import filter_slices, map_slices

SAMPLE = 3000
WINDOW_CHARS = 240
DICTIONARY_BYTES = 64 * 1024
#: A sign of toxic text: this many times the ordinary share of contexts, and a chance below this one of so
#: many toxic contexts if the sign had nothing to do with the label.
RATIO, CHANCE = 8.0, 1e-6
#: A longer sign replaces a shorter one if it has this share of its contexts.
SAME = 0.9
BEGINNINGS = (4, 5, 6, 7)
#: Stands before every word, and is long enough to be a match of its own in the ordinary dictionary.
_MARK = "\x01\x02 "


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def windows(text: str | None) -> list[bytes]:
    """Lower-cased pieces of about ``WINDOW_CHARS`` characters, cut before a word."""
    words = (text or "").lower().split()
    made, held, size = [], [], 0
    for word in words:
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW_CHARS:
            made.append((_MARK + _MARK.join(held)).encode())
            held, size = [], 0
    if held or not made:
        made.append((_MARK + _MARK.join(held)).encode())
    return made


def _signs(texts: list[list[bytes]]) -> tuple[Counter, int]:
    """In how many different contexts each word, and each beginning of a word, occurs, and the number of all.

    A context is a word with its two neighbours. Copies of a text add nothing,
    and near copies little, so no group of copies makes its words telling.
    """
    counts: Counter = Counter()
    seen: set[int] = set()
    for pieces in texts:
        for piece in pieces:
            words = piece.decode().replace(_MARK, " ").split()
            for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                context = hash((before, word, after))
                if context not in seen:
                    seen.add(context)
                    counts[word] += 1
    signs: Counter = Counter()
    for word, n in counts.items():
        for length in {*BEGINNINGS, len(word)}:
            if length <= len(word):
                signs[word[:length]] += n
    return signs, len(seen)


def _tail(n: int, m: int, share: float) -> float:
    """Chance of ``m`` or more successes among ``n`` draws."""
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(m, n + 1)]
    terms = (c + k * math.log(share) + (n - k) * math.log1p(-share) for c, k in zip(log, range(m, n + 1)))
    return math.fsum(map(math.exp, terms))


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[tuple[str, int]]:
    """Signs of toxic text with their number of contexts, the most frequent first.

    Of signs that begin with one another the shortest stays, made longer as
    long as nearly all its contexts go on in the same way: endings that ordinary
    words share say nothing.
    """
    (t, of_t), (o, of_o) = _signs(toxic), _signs(ordinary)
    share = (of_t + 1) / (of_t + of_o + 2)
    least = RATIO * (of_t + 1) / (of_o + 1)
    found = {
        sign: n
        for sign, n in t.items()
        if n > 2 and n + 0.5 >= least * (o[sign] + 0.5) and _tail(n + o[sign], n, share) < CHANCE
    }
    chosen: dict[str, int] = {}
    for sign in sorted(found, key=lambda s: (len(s), s)):
        if not any(sign[:n] in chosen for n in range(BEGINNINGS[0], len(sign))):
            chosen[sign] = found[sign]
    longer: dict[str, list[str]] = {}
    for sign in found:
        for n in range(BEGINNINGS[0], len(sign)):
            if sign[:n] in chosen:
                longer.setdefault(sign[:n], []).append(sign)
    made = {}
    for sign, n in chosen.items():
        same = [s for s in longer.get(sign, ()) if found[s] >= SAME * n]
        best = max(same, key=lambda s: (len(s), s), default=sign)
        made[best] = found[best]
    return sorted(made.items(), key=lambda item: (-item[1], item[0]))


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents."""
    common = _trained([piece for pieces in ordinary for piece in pieces], DICTIONARY_BYTES)
    samples = []
    for sign, n in telling(toxic, ordinary):
        samples += [(_MARK + sign).encode()] * min(n, 50)
    special = _trained(samples, DICTIONARY_BYTES // 2) if samples else b""
    return common, special + b"".join(dict.fromkeys(samples)) + common


class Gains:
    """Compressed lengths of windows under both dictionaries."""

    def __init__(self, common: bytes, toxic: bytes):
        self.size = [self._compressor(content) for content in (common, toxic)]

    @staticmethod
    def _compressor(content: bytes):
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=3, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        content = content or b" " * 8
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        common, toxic = self.size
        return np.array([len(common(piece)) - len(toxic(piece)) for piece in pieces], np.float64)


def features(gains: np.ndarray) -> list[float]:
    """What the calibration sees of a text's gains."""
    up = np.maximum(gains, 0)
    strong = np.sort(up)[::-1]
    return [
        math.log1p(strong[0]),
        math.log1p(strong[1] if len(strong) > 1 else strong[0] / 2),
        math.log1p(up.sum()),
        up.sum() / len(up),
        math.log1p(np.count_nonzero(gains >= 1)),
        np.count_nonzero(gains >= 1) / len(gains),
        math.log(len(gains)),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of standardised features and a constant, by Newton steps with a small ridge; rows count by ``mass``."""
    mass = mass / mass.sum()
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    keep = ridge * np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ ((p - y) * mass) + keep * weights
        bend = (x * (p * (1 - p) * mass)[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return weights


@dataclass(frozen=True)
class Model:
    common: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def plain(self) -> tuple:
        """Bytes and arrays only: a broadcast of them needs no class of this package to be read."""
        return self.common, self.toxic, self.mean, self.spread, self.weights

    def scorer(self):
        if not len(self.mean):
            return lambda text: float(self.weights[0])
        gains = Gains(self.common, self.toxic)

        def score(text: str | None) -> float:
            x = (np.array(features(gains(windows(text)))) - self.mean) / self.spread
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))

        return score


def fit(rows: list[tuple[int, str | None, int]], numbers: dict[int, int] | None = None) -> Model:
    """From (id, text, toxic) rows: dictionaries and the calibration of their gains.

    Each third of the texts is scored with dictionaries of the other two
    thirds, so the calibration sees unseen texts; the model's own dictionaries
    are then trained on all rows. ``numbers`` are the classes' numbers of
    labels, for which the sample stands.
    """
    cut = [(i, windows(text), y) for i, text, y in sorted(rows, key=lambda r: r[0])]
    labels = [y for _, _, y in cut]
    if len(set(labels)) < 2:
        return Model(b"", b"", np.empty(0), np.empty(0), np.array([float(np.mean(labels)) if labels else 0.5]))
    folds = np.array([zlib.crc32(f"fold {i}".encode()) % 3 for i, _, _ in cut])
    x = np.zeros((len(cut), len(features(np.zeros(1)))))

    def trained(chosen: np.ndarray) -> tuple[bytes, bytes]:
        parts = [[p for (_, p, label), c in zip(cut, chosen) if c and label == y] for y in (1, 0)]
        return dictionaries(*parts)

    for fold in range(3):
        gains = Gains(*trained(folds != fold))
        for i in np.flatnonzero(folds == fold):
            x[i] = features(gains(cut[i][1]))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    own = Counter(labels)
    mass = np.array([(numbers or own)[y] / own[y] for y in labels])
    weights = fit_logistic((x - mean) / spread, np.array(labels, float), mass)
    return Model(*trained(np.ones(len(cut), bool)), mean, spread, weights)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """A model from rows that are not held out. Only ids of the sample meet the texts: a broadcast of fixed size."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    numbers = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}
    chosen = {row[0]: row[1] for part in parts for row in part.select(key, "toxic").collect()}
    spark = docs.sparkSession
    listed = spark.createDataFrame(list(chosen.items()) or [(0, 0)], "chosen long, toxic int").where(F.lit(bool(chosen)))
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = own.join(F.broadcast(listed), F.col("id") == F.col("chosen"))
    found = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return fit([(r.id, r.text, r.toxic) for r in found.collect()], numbers)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted of every row's whole text. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def make():
        scorer = Model(*shared.value).scorer()

        def run(keys, texts):
            scores = [scorer(value.as_py()) for value in texts]
            yield {key: keys, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_slices(docs, [key, text], make, f"`{key}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows scored below one half, with all their columns. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def make():
        scorer = Model(*shared.value).scorer()
        return lambda texts: [scorer(value.as_py()) < 0.5 for value in texts]

    return filter_slices(docs, text, make)

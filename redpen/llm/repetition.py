"""Quality rules on repetition, from a suffix array over each text's words.

The words of a slice of documents form one sequence with a separator of its
own after each document, so that no repeat reaches across documents. Prefix
doubling sorts its suffixes, refining only groups that are still tied. Equal
ranks on the doubling levels give the longest common prefix of neighbours,
so intervals of the array with a common prefix are the maximal repeated
substrings. Each position's longest repeat is the larger prefix it shares
with its two neighbours; the union of these spans is the covered part.

A word is a run of bytes other than space and 09-0D. Defined cases: null text
has no words; a text with fewer than ``MIN_WORDS`` words fails the base rule;
ties between equal suffixes cannot occur within a document (one is a prefix
of the other and ends at its separator); repeated rows are judged alike; other
columns are not read; there is no limit on length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from redpen.llm.tables import filter_slices, map_slices

MIN_WORDS = 50
WINDOW_WORDS = 3
#: Words of a slice sorted together; a longer document is sorted by itself.
SORT_WORDS = 200_000

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Limits:
    """Repeats of at least ``span_words`` words count; both limits must hold.

    ``covered`` is the largest allowed fraction of words inside such repeats,
    ``longest`` the largest allowed share of one repeat, over a floor of
    ``longest_words`` words that every text may repeat.
    """

    span_words: int = 8
    covered: float = 0.35
    longest: float = 0.25
    longest_words: int = 40


def sort_suffixes(tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Suffix array of ``tokens`` and, per doubling level, the positions still tied with their group.

    ``tokens`` are dense non-negative ids, and the last one is unique. Level k
    lists (positions, groups): two positions share a group if and only if
    their next 2**k tokens are equal.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    counts = np.bincount(tokens)
    rank = (np.cumsum(counts) - counts)[tokens]
    tied = np.flatnonzero(counts[tokens[order]] > 1)
    levels, step = [], 1
    while tied.size:
        places = order[tied]
        levels.append((places, rank[places]))
        keys = rank[places] * n + rank[places + step]
        sorting = np.argsort(keys, kind="stable")
        places, keys = places[sorting], keys[sorting]
        first = np.empty(len(keys), bool)
        first[0], first[1:] = True, keys[1:] != keys[:-1]
        order[tied] = places
        rank[places] = tied[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        alone = first & np.append(first[1:], True)
        tied = tied[~alone]
        step *= 2
    return order, levels


def longest_repeats(tokens: np.ndarray) -> np.ndarray:
    """Per position: the length of the longest substring from there that occurs elsewhere too."""
    order, levels = sort_suffixes(tokens)
    longest = np.zeros(len(tokens), np.int64)
    if not levels:
        return longest
    group = np.full(len(tokens), -1, np.int64)
    group[levels[0][0]] = levels[0][1]
    left, right = order[:-1], order[1:]
    near = np.flatnonzero((group[left] == group[right]) & (group[left] >= 0))
    left, right = left[near], right[near]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        group.fill(-1)
        group[levels[k][0]] = levels[k][1]
        here = group[left + common]
        common += ((here >= 0) & (here == group[right + common])).astype(np.int64) << k
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered_words(lengths: np.ndarray, least: int, ends: np.ndarray, fixed: int | None = None) -> np.ndarray:
    """Per document: positions in the union of the spans of at least ``least`` words.

    ``ends`` are the documents' exclusive ends in ``lengths``; ``fixed`` cuts every span to that length.
    """
    starts = np.flatnonzero(lengths >= least)
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + (fixed or lengths[starts]), -1)
    inside = np.cumsum(np.cumsum(change[:-1]) > 0)
    return np.diff(np.concatenate([[0], inside[ends - 1]]))


def _base_counts(text: str) -> tuple[list[bytes], int, int, int]:
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(raw.count, (_SPACE[i : i + 1] for i in range(6))))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in text.split("\n") if line] if "\n" in text else ()
    duplicates = 0
    if len(lines) != len(set(lines)):
        with_word = [line for line in lines if _HAS_WORD.search(line)]
        duplicates = len(with_word) - len(set(with_word))
    return words, chars, symbols, duplicates


def judge(texts: list[str | None], limits: Limits) -> dict[str, list]:
    """The base counts and the verdict of each text."""
    made: dict[str, list] = {name: [] for name in NAMES}
    held: list[tuple[list[bytes], int, int, int]] = []
    size = 0
    for row, text in enumerate(texts, 1):
        held.append(_base_counts(text or ""))
        size += len(held[-1][0]) + 1
        if size >= SORT_WORDS or row == len(texts):
            _judge_together(held, limits, made)
            held, size = [], 0
    return made


def _judge_together(held, limits: Limits, made: dict[str, list]) -> None:
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    tokens, ends = [], []
    for words, *_ in held:
        tokens.extend([number(word, len(ids)) for word in words])
        tokens.append(-1)
        ends.append(len(tokens))
    sequence, stops = np.array(tokens, np.int64), np.array(ends)
    # Words keep ids shared by the documents; a document's number in front keeps its suffixes apart.
    owner = np.repeat(np.arange(len(held)), np.diff(np.concatenate([[0], stops])))
    sequence = owner * (len(ids) + 1) + np.where(sequence < 0, len(ids), sequence)
    sequence = np.unique(sequence, return_inverse=True)[1]
    lengths = longest_repeats(sequence)
    repeated = covered_words(lengths, WINDOW_WORDS, stops, WINDOW_WORDS)
    covered = covered_words(lengths, limits.span_words, stops)
    longest = np.maximum.reduceat(lengths, np.concatenate([[0], stops[:-1]]))
    for row, (words, chars, symbols, duplicates) in enumerate(held):
        n = len(words)
        failed = n < MIN_WORDS or 100 * int(repeated[row]) > 50 * n
        fine = covered[row] <= limits.covered * n and longest[row] <= max(limits.longest_words, limits.longest * n)
        for name, value in zip(
            NAMES,
            (
                n, chars, symbols, duplicates, int(repeated[row]), failed, not failed and bool(fine),
                int(covered[row]), int(longest[row]),
            ),
        ):
            made[name].append(value)


NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    "n_covered_words", "longest_repeat",
)
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
)


def quality_rules(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base counts, the repeats' cover and longest repeat in words, and the verdict. Narrow."""

    def make():
        return lambda keys, texts: [{key: keys, **judge(texts.to_pylist(), limits)}]

    kind = docs.schema[key].dataType.simpleString()
    return map_slices(docs, [key, text], make, f"`{key}` {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns. Narrow."""
    return filter_slices(docs, text, lambda: lambda texts: judge(texts.to_pylist(), limits)["kept"])

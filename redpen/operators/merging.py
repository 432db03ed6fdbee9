"""Which neighbouring operations make one edit: rules over the operation sequence.

Every operation of a batch gets a label from its own tokens, and a cut between
two neighbours follows from their labels and a short look ahead, for all
operations at once:

* a moved block is an edit of its own;
* operations that only join or divide words (``best friend``, ``best-friend``)
  are one, whatever they are by themselves;
* a possessive ending goes with the operation before it;
* punctuation stands alone, but a change of case right after it goes with it
  (``, then`` and ``. Then``);
* a change of case goes with words inserted or deleted right before it (``Cat``
  and ``The cat``), otherwise it stands alone;
* a word replaced by an alike one (same lemma, or nearly its letters) stands alone;
* determiners inserted or deleted stand apart from operations on other words;
* of two words replaced one after the other, each stands alone;
* words inserted or deleted beside each other, or beside a replaced unlike word, go
  together; with token features beside a replaced word only within one class of words
  or among verbs, particles and adpositions (``to eat`` and ``eating``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from redpen.operators import likeness as L

# Tokens that mark possession, and determiners.
POSSESSIVES = ("'s", "'", "’s", "’")
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "some", "any", "every", "each", "no")
# What may stand inside a joined word, and classes that make up verb groups.
JOINTS = "-'’"
VERB_GROUP = ("VERB", "AUX", "PART", "ADP")

#: Operations that may join or divide one word.
WINDOW = 4


def _by_token(coded: pa.DictionaryArray, told: np.ndarray) -> np.ndarray:
    """A yes or no for each token by its distinct ones'; the last place stands for no token."""
    return np.append(told[coded.indices.to_numpy(zero_copy_only=False)], False)


def _among(words: pa.Array, listed: tuple[str, ...]) -> np.ndarray:
    return pc.is_in(words, pa.array(listed, words.type)).to_numpy(zero_copy_only=False)


def rule_cuts(ops: np.ndarray, rows: np.ndarray, tokens: L.Tokens, values: pa.Array, split: int, o_off, c_off, pos=None) -> np.ndarray:
    """For every two neighbouring operations: does an edit end between them?

    ``values``: all originals' tokens (``split`` of them), then the corrected ones; ``pos``:
    their parts of speech, if known.
    """
    if len(ops) < 2:
        return np.zeros(max(len(ops) - 1, 0), bool)
    none = len(values)
    has_o, has_c = ops != L.INSERT, ops != L.DELETE
    first = rows[:-1][np.repeat(np.arange(len(rows) - 1), np.diff(rows))]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    seen = lambda has: np.cumsum(has) - has
    place = lambda has, off: off[:-1][row] + seen(has) - seen(has)[first]
    o = np.where(has_o, place(has_o, o_off), none)
    c = np.where(has_c, split + place(has_c, c_off), none)

    moved = ops >= L.MOVED
    both = ops == L.SUBSTITUTE
    coded = values.dictionary_encode()
    lower = L.lowered(coded.dictionary)
    told = lambda yes: (yes[o] | ~has_o) & (yes[c] | ~has_c)
    mark = told(np.append(tokens.mark, False)) & ~moved
    determiner = told(_by_token(coded, _among(lower, DETERMINERS))) & ~moved & ~both
    owns = _by_token(coded, _among(lower, POSSESSIVES))
    possessive = ((has_o & owns[o]) | (has_c & owns[c])) & ~moved

    case, alike, same_kind = (np.zeros(len(ops), bool) for _ in range(3))
    at = np.flatnonzero(both)
    mine, theirs = tokens.at(o[at]), tokens.at(c[at])
    case[at] = mine.low == theirs.low
    near = L.letters_cost(mine, theirs) <= L.ALIKE
    if mine.lemma is not None:
        near |= (mine.lemma == theirs.lemma) & (mine.lemma >= 0)
    alike[at] = near & ~case[at]

    one_sided = (ops == L.INSERT) | (ops == L.DELETE)
    cut = np.ones(len(ops) - 1, bool)
    x, y = slice(None, -1), slice(1, None)
    plain = lambda s: ~moved[s] & ~mark[s] & ~case[s] & ~alike[s]
    together = plain(x) & plain(y) & (one_sided[x] | one_sided[y]) & (determiner[x] == determiner[y])
    if pos is not None:
        together &= one_sided[x] & one_sided[y] | _one_class(pos, o, c, none)
    cut[together] = False
    cut[one_sided[x] & ~mark[x] & case[y]] = False
    cut[mark[x] & case[y]] = False
    cut[possessive[y] & ~moved[x] & (ops[x] != L.MATCH) & (~mark[x] | possessive[x])] = False
    cut[ops[y] == L.MOVED_ON] = False
    _join_words(cut, ops, row, coded, lower, o, c, none)
    return cut


def _one_class(pos: pa.Array, o: np.ndarray, c: np.ndarray, none: int) -> np.ndarray:
    """Are two neighbouring operations' tokens all of one class, or all of the verb group?"""
    coded = pos.dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = np.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), -2)
    group = np.array([n in VERB_GROUP for n in names] + [True, False])  # -2: no token, -1: unknown
    sides = np.stack([code[o][:-1], code[c][:-1], code[o][1:], code[c][1:]])
    real = sides != -2
    low = np.where(real, sides, 1 << 30).min(axis=0)
    one = np.where(real, sides, -1).max(axis=0) == low
    return (one & (low >= 0)) | group[sides].all(axis=0)


def _letter_sums(lower: pa.Array) -> np.ndarray:
    """For each distinct word a number that its letters without joints add up to, in whatever order."""
    letters, starts = L.letters_of(lower)
    each = np.where(np.isin(letters, [ord(x) for x in JOINTS]), np.uint64(0), L.mixed(letters))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return total[starts[1:]] - total[starts[:-1]]


def _join_words(cut: np.ndarray, ops, row, coded: pa.DictionaryArray, lower: pa.Array, o, c, none: int) -> None:
    """Windows whose letters are the same on both sides become one edit, the shortest from each place."""
    edit = (ops != L.MATCH) & (ops < L.MOVED)
    index = coded.indices.to_numpy(zero_copy_only=False)
    sized = np.append(_letter_sums(lower)[index], np.uint64(0))
    lead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sized[o] - sized[c], dtype=np.uint64)])
    taken = 0
    letters = lambda place: "".join(ch for at in place if at != none for ch in lower[int(index[at])].as_py() if ch not in JOINTS)
    # Only where the same letters stand on both sides, in another number of words.
    sided = np.concatenate([[0], np.cumsum((ops == L.INSERT) | (ops == L.DELETE))])
    windows = []
    for w in range(2, min(WINDOW, len(ops)) + 1):
        n = len(ops) - w + 1
        found = edit[:n] & (lead[w:] == lead[:n]) & (sided[w:] > sided[:n])
        windows += [(int(start), w) for start in np.flatnonzero(found)]
    windows.sort()
    for start, size in windows:
        part = slice(start, start + size)
        if start < taken or not edit[part].all() or row[start] != row[start + size - 1]:
            continue
        words = letters(o[part])
        if words and words == letters(c[part]):
            cut[start : start + size - 1] = False
            if start:
                cut[start - 1] = True
            if start + size - 1 < len(cut):
                cut[start + size - 1] = True
            taken = start + size

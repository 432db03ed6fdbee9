"""Weighted alignment against a plain recursive version."""

import random
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from redpen.operators import alignment as A
from redpen.operators import likeness as L

POS = ["NOUN", "VERB", "DET", None]


def columns(pairs, features=None):
    """Tokens of both sides and their offsets."""
    flat = [t for k in (0, 1) for p in pairs for t in p[k]]
    kind = pa.struct([("lemma", pa.string()), ("pos", pa.string())])
    feats = None if features is None else pa.array([features(t) for t in flat], kind)
    off = [np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]).astype(np.int64) for k in (0, 1)]
    return L.described(pa.array(flat, pa.string()), feats), *off


def features(word):
    return {"lemma": word.rstrip("s").lower() if word[0] != "n" else None, "pos": POS[len(word) % 4]}


def plain_cost(a, b, feats):
    if a == b:
        return 0
    if a.lower() == b.lower():
        return 10
    x, y = L.letter_bits(a.lower()), L.letter_bits(b.lower())
    total = x.bit_count() + y.bit_count()
    cost = 100 * (total - 2 * (x & y).bit_count()) // total
    if any(map(str.isalnum, a)) != any(map(str.isalnum, b)):
        cost += 120
    elif feats is None:
        cost += 50
    else:
        f, g = feats(a), feats(b)
        cost += 0 if f["lemma"] is not None and f["lemma"] == g["lemma"] else 49
        same = f["pos"] is not None and f["pos"] == g["pos"]
        cost += 0 if same else 25 if {f["pos"], g["pos"]} <= {"NOUN", "VERB", "ADJ", "ADV"} else 50
    return max(cost, 11)


def plain(a, b, feats):
    """The least cost, cell by cell."""

    @cache
    def least(i, j):
        if not i or not j:
            return 100 * (i + j)
        found = min(least(i - 1, j) + 100, least(i, j - 1) + 100, least(i - 1, j - 1) + plain_cost(a[i - 1], b[j - 1], feats))
        for k in range(2, min(i, j, 8) + 1):
            if sorted(x.lower() for x in a[i - k : i]) == sorted(x.lower() for x in b[j - k : j]):
                found = min(found, least(i - k, j - k) + 100 + 51 * (k - 2))
        return found

    return least(len(a), len(b))


def cost_of(ops, a, b, feats):
    """The cost of an operation sequence, checked to turn a into b."""
    i = j = cost = at = 0
    while at < len(ops):
        if ops[at] == L.MOVED:
            k = 1
            while at + k < len(ops) and ops[at + k] == L.MOVED_ON:
                k += 1
            assert sorted(x.lower() for x in a[i : i + k]) == sorted(x.lower() for x in b[j : j + k])
            cost, i, j, at = cost + 100 + 51 * (k - 2), i + k, j + k, at + k
            continue
        if ops[at] in (L.MATCH, L.SUBSTITUTE):
            assert (a[i] == b[j]) == (ops[at] == L.MATCH)
            cost += plain_cost(a[i], b[j], feats)
        else:
            cost += 100
        i += ops[at] != L.INSERT
        j += ops[at] != L.DELETE
        at += 1
    assert (i, j) == (len(a), len(b))
    return cost


def random_pairs(seed, n=160):
    rng = random.Random(seed)
    words = ["a", "an", "and", "The", "the", "dog", "dogs", "god", "nap", ",", ".", "walks", "walk", "Walk"]
    for _ in range(n):
        a = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        b = [w for w in a if rng.random() > 0.15] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 14))]
        if len(b) > 3 and rng.random() < 0.7:
            at = rng.randrange(len(b))
            b.insert(rng.randrange(len(b)), b.pop(at))
        yield a, b


@pytest.mark.parametrize("budget", [8_000_000, 300, 40])
@pytest.mark.parametrize("feats", [None, features])
def test_cost_is_least_and_symmetric(monkeypatch, budget, feats):
    monkeypatch.setattr(A, "CELL_BUDGET", budget)
    pairs = list(random_pairs(budget))
    ops, rows, costs = L.align(*columns(pairs, feats))
    for k, (a, b) in enumerate(pairs):
        assert costs[k] == plain(tuple(a), tuple(b), feats)
        assert cost_of(ops[rows[k] : rows[k + 1]].tolist(), a, b, feats) == costs[k]
    back = L.align(*columns([(b, a) for a, b in pairs], feats))[2]
    assert back.tolist() == costs.tolist()


def test_long_pair_with_narrow_band_and_saved_rows(monkeypatch):
    monkeypatch.setattr(A, "CELL_BUDGET", 3000)
    rng = random.Random(1)
    a = [f"w{rng.randrange(60)}" for _ in range(400)]
    b = [w for w in a if rng.random() > 0.05]
    for at in (50, 120, 300):
        b[at], b[at + 1], b[at + 2] = b[at + 2], b[at], b[at + 1]
    ops, rows, costs = L.align(*columns([(a, b), (b, a)]))
    for k, (x, y) in enumerate(((a, b), (b, a))):
        assert cost_of(ops[rows[k] : rows[k + 1]].tolist(), x, y, None) == costs[k]
    assert costs[0] == costs[1]
    monkeypatch.setattr(A, "CELL_BUDGET", 8_000_000)
    assert L.align(*columns([(a, b)]))[2][0] == costs[0]


def test_moved_word_is_one_block():
    ops, rows, _ = L.align(*columns([("x only I want y".split(), "x I want only y".split())]))
    assert ops.tolist() == [L.MATCH, L.MOVED, L.MOVED_ON, L.MOVED_ON, L.MATCH]


def test_shared_lemma_beats_letters():
    feats = lambda w: {"lemma": {"went": "go"}.get(w, w), "pos": "VERB" if w in ("went", "go") else "NOUN"}
    ops = L.align(*columns([(["went"], ["go", "wade"])], feats))[0]
    assert ops.tolist() == [L.SUBSTITUTE, L.INSERT]
    ops = L.align(*columns([(["went"], ["go", "wade"])]))[0]
    assert ops.tolist() == [L.INSERT, L.SUBSTITUTE]

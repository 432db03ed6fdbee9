"""Steps of the alignment by likeness that go over whole batches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from redpen.operators import alignment as A
from redpen.operators import likeness as L
from redpen.operators import merging as M

WORDS = ["", "a", "Anna", "ΟΔΟΣ", "İng", "½", "²x", "naïve", "'s", "—", "x" * 40, "é", "😀", "K", "Ünter-den", "aabbaab"]


def test_words_are_described_as_one_by_one():
    words = pa.array(WORDS)
    assert L.lowered(words).to_pylist() == [w.lower() for w in WORDS]
    assert L.all_letter_bits(words).tolist() == [L.letter_bits(w) for w in WORDS]
    assert L.marks(words).tolist() == [not any(map(str.isalnum, w)) for w in WORDS]
    assert L.all_letter_bits(words.slice(3, 4)).tolist() == [L.letter_bits(w) for w in WORDS[3:7]]
    assert len(L.all_letter_bits(words[:0])) == 0
    found = L.described(pa.array(["Bb", "bB", "bb", "x"]))
    assert found.low.tolist()[:3] == [found.low[0]] * 3 and len(set(found.id.tolist())) == 4


def test_letter_sums_leave_joints_out():
    sums = M._letter_sums(pa.array(["sub-way", "subway", "ways-bu", "’s", "s", "'", "sway", ""]))
    assert sums[0] == sums[1] == sums[2] and sums[3] == sums[4] and sums[5] == sums[7] == 0 and sums[6] != sums[1]


def columns(pairs):
    flat = [t for k in (0, 1) for p in pairs for t in p[k]]
    off = [np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]).astype(np.int64) for k in (0, 1)]
    return L.described(pa.array(flat, pa.string())), *off


def some_pairs(seed, n):
    draw = random.Random(seed)
    for _ in range(n):
        a = [draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(1, 60))]
        b = [w for w in a if draw.random() > 0.1]
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + 8] = sorted(b[at : at + 8], key=lambda w: draw.random())
        if draw.random() < 0.2:
            at = draw.randrange(len(a))
            b = b[at:] + b[:at]
        yield a, b or ["z"]


@pytest.mark.parametrize("seed", [1, 2])
def test_narrow_bands_give_what_the_whole_matrix_gives(monkeypatch, seed):
    pairs = list(some_pairs(seed, 150))
    narrow = L.align(*columns(pairs))
    tried = []
    solve = L._align_chunk
    monkeypatch.setattr(L, "_align_chunk", lambda *x: tried.append(x[5]) or solve(*x))
    # No guess, and then a band that holds every cell.
    monkeypatch.setattr(L, "_unshared", lambda low, o_off, c_off: (np.zeros(len(o_off) - 1, np.int64),) * 2)
    again = L.align(*columns(pairs))
    least = max(tried)
    monkeypatch.setattr(L, "_ladder", lambda width: width + 400)
    whole = L.align(*columns(pairs))
    assert max(tried) > 300 > least
    for found in (narrow, again):
        assert all(x.tolist() == y.tolist() for x, y in zip(found, whole))


def test_a_band_is_no_wider_than_the_cost_asks_for(monkeypatch):
    """200 tokens with 40 replaced ones: before, a band of 257 cells was filled after one of 65."""
    a = [f"w{k}q" for k in range(200)]
    b = [f"{k}vxyz" if k % 5 == 0 else w for k, w in enumerate(a)]
    widths = []
    solve = L._align_chunk
    monkeypatch.setattr(L, "_align_chunk", lambda *x: widths.append(x[5]) or solve(*x))
    ops, rows, costs = L.align(*columns([(a, b)]))
    assert max(widths) <= 64 and rows.tolist() == [0, 200]
    assert np.flatnonzero(ops).tolist() == list(range(0, 200, 5)) and (ops[::5] == A.SUBSTITUTE).all()

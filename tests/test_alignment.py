import random

import pyarrow as pa
import pytest

from redpen.operators import alignment as A


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def spans(pairs, merge):
    kind = pa.list_(pa.string())
    sides = [pa.array([p[k] for p in pairs], kind) for k in (0, 1)]
    return A.edit_spans(*sides, merge).to_pylist()


def random_pairs(words, n=250, seed=0):
    rng = random.Random(seed)
    word = lambda: str(rng.randrange(words))
    for _ in range(n):
        a = [word() for _ in range(rng.randint(0, 16))]
        if rng.random() < 0.5:
            b = [word() for _ in range(rng.randint(0, 30))]
        else:
            b = [word() if rng.random() < 0.1 else t for t in a if rng.random() > 0.2]
        yield a, b


@pytest.mark.parametrize("budget", [8_000_000, 300, 40])
@pytest.mark.parametrize("words", [2, 5, 60])
@pytest.mark.parametrize("merge", ["all-split", "all-merge", "all-equal"])
def test_edits_rebuild_the_text_and_are_fewest(monkeypatch, budget, words, merge):
    monkeypatch.setattr(A, "CELL_BUDGET", budget)
    pairs = list(random_pairs(words))
    for (a, b), found in zip(pairs, spans(pairs, merge)):
        out, at = [], 0
        for e in found:
            out += a[at : e["o_start"]]
            assert len(out) == e["c_start"]
            assert " ".join(a[e["o_start"] : e["o_end"]]) == e["o_str"]
            out += e["c_str"].split()
            assert len(out) == e["c_end"]
            at = e["o_end"]
        assert out + a[at:] == b
        if merge == "all-split":
            assert len(found) == distance(a, b)
        if merge == "all-merge":
            assert all(x["o_end"] < y["o_start"] for x, y in zip(found, found[1:]))


def test_long_texts_are_aligned_whole():
    rng = random.Random(3)
    a = [str(rng.randrange(500)) for _ in range(3000)]
    b = [t for t in a if rng.random() > 0.05] + ["end"]
    (found,) = spans([(a, b)], "all-split")
    assert len(found) == distance(a, b)


def test_empty_batch_and_unknown_merge():
    assert spans([], "all-merge") == []
    assert spans([([], [])], "all-merge") == [[]]
    with pytest.raises(ValueError):
        spans([(["a"], ["b"])], "other")


@pytest.mark.parametrize("budget", [8 << 20, 60, 1])
def test_texts_are_aligned_in_parts_as_their_trimmed_tokens(monkeypatch, budget):
    monkeypatch.setattr(A, "TEXT_BUDGET", budget)
    gaps = [" ", "  ", "\t", "　 "]
    rng = random.Random(5)
    text = lambda tokens: None if not tokens and rng.random() < 0.5 else "".join(rng.choice(gaps) + t for t in tokens) + rng.choice(gaps)
    pairs = list(random_pairs(4))
    sides = [pa.array([text(p[k]) for p in pairs], pa.string()) for k in (0, 1)]
    found = A.text_spans(*sides, lambda *lists: A.edit_spans(*lists, "all-split")).to_pylist()
    for (a, b), got in zip(pairs, found):
        lead = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        rest = a[lead:], b[lead:]
        tail = next((k for k, (x, y) in enumerate(zip(*(r[::-1] for r in rest))) if x != y), min(map(len, rest)))
        (expected,) = spans([tuple(r[: len(r) - tail] for r in rest)], "all-split")
        moved = [{k: v + lead if isinstance(v, int) else v for k, v in e.items()} for e in expected]
        assert got == moved
    assert len(found) == len(pairs)
    none = pa.array([], pa.string())
    assert A.text_spans(none, none, lambda *lists: A.edit_spans(*lists, "all-merge")).to_pylist() == []


def test_thin_bands_give_the_same_operations_and_only_too_narrow_ones_are_solved_again(monkeypatch):
    draw = random.Random(5)
    words = lambda n: [str(draw.randrange(4)) for _ in range(n)]
    originals = [words(draw.randrange(60)) for _ in range(200)]
    corrected = [[w for w in words_ if draw.random() > 0.2] + words(draw.randrange(8)) for words_ in originals]
    # One pair that no thin band holds, beside many that the first band does.
    originals.append(words(60))
    corrected.append(["x"] * 60)
    sides = [pa.array(x, pa.list_(pa.string())) for x in (originals, corrected)]
    solved, thin = [], A._align_thin
    monkeypatch.setattr(A, "_align_thin", lambda o, c, n, m, k: solved.append(len(n)) or thin(o, c, n, m, k))
    by_thin = A.edit_spans(*sides, "all-split")
    assert 0 < sum(solved) < 2 * len(originals)
    monkeypatch.setattr(A, "THIN", 0)
    assert by_thin.equals(A.edit_spans(*sides, "all-split"))

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from redpen.functions import text as T
from redpen.operators import alignment as A


def _pairs(n, longest, seed=1):
    draw = random.Random(seed)
    for _ in range(n):
        a = [str(draw.randrange(draw.choice([2, 40]))) for _ in range(draw.randrange(1, longest))]
        share = draw.choice([0.02, 0.1, 0.4])
        yield a, [str(draw.randrange(9)) if draw.random() < share else t for t in a if draw.random() > share] or ["x"]


def _arrays(pairs):
    flat = [np.array([int(t) if t != "x" else -7 for p in pairs for t in p[k]], np.int32) for k in (0, 1)]
    return [x for k in (0, 1) for x in (flat[k], np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]))]


def test_bit_rows_and_whole_integers_give_the_operations_of_the_plain_matrix(monkeypatch):
    given = _arrays(list(_pairs(300, 90)))
    found = []
    # Bits side by side with the tallest alone, all side by side, and neither.
    for name, value in (("ROW_COST", A.ROW_COST), ("ROW_COST", 0), ("ROW_COST", 10**9), ("THIN", 7), ("ALONE", 0), ("THIN", 0)):
        with monkeypatch.context() as changed:
            changed.setattr(A, name, value)
            found.append(A.align(*given))
    for ops, rows in found:
        assert np.array_equal(ops, found[-1][0]) and np.array_equal(rows, found[-1][1])


def test_many_edits_in_a_line_fill_no_matrix(monkeypatch):
    monkeypatch.setattr(A, "_align_chunk", None)
    ops, rows = A.align(*_arrays(list(_pairs(100, 300, seed=2))))
    assert len(rows) == 101 and len(ops) == rows[-1]


def test_an_original_with_several_corrections_is_split_once(monkeypatch):
    split, plain = [], A.token_lists
    monkeypatch.setattr(A, "token_lists", lambda texts: split.append(len(texts)) or plain(texts))
    originals = pa.array(["a b c", "a b c", None, "", "d e", "d e"])
    corrected = pa.array(["a x c", "a b", "f", None, "d", "g d e"])
    edits = lambda *lists: A.edit_spans(*lists[:2], "all-merge")
    found = A.text_spans(originals, corrected, edits).to_pylist()
    shown = [[(e["o_start"], e["o_end"], e["o_str"], e["c_str"]) for e in row] for row in found]
    assert shown == [[(1, 2, "b", "x")], [(2, 3, "c", "")], [(0, 0, "", "f")], [], [(1, 2, "e", "")], [(0, 0, "", "g")]]
    assert split == [3, 6]


def test_clitics_are_searched_only_where_there_is_an_apostrophe(monkeypatch):
    texts = pa.array(["Don't we'll 3:30.", None, "No, it is.", "years' end", "Mr. X etc. ..."])
    expected = texts
    for old, new in [(joined, spaced) for spaced, joined in T.TOKEN_SPELLINGS] + list(T.TOKENIZE_REPAIRS):
        expected = pc.replace_substring(expected, pattern=old, replacement=new)
    assert T._tokenized(texts).equals(expected) and expected[0].as_py() == "Do n't we 'll 3 :30 ."
    searched, plain = [], pc.replace_substring
    monkeypatch.setattr(pc, "replace_substring", lambda x, pattern, replacement: searched.append((pattern, len(x))) or plain(x, pattern, replacement))
    T._tokenized(texts)
    assert ("n't", 2) in searched and (".", 5) in searched


def test_words_of_many_parts_are_added_up_before_they_are_handed_on(monkeypatch):
    parts = [pa.array([f"w{k % 7}", "a", "a"]) for k in range(50)]
    counts = [tuple(p.value_counts().flatten()) for p in parts]
    (table,) = A.summed(iter(counts))
    assert dict(zip(*table.to_pydict().values())) == {"a": 100, **{f"w{k}": 7 + (k == 0) for k in range(7)}}
    monkeypatch.setattr(A, "WORDS_HELD", 3)
    some = pa.concat_tables(list(A.summed(iter(counts)))).group_by("word").aggregate([("n", "sum")])
    assert dict(zip(*some.select(["word", "n_sum"]).to_pydict().values()))["a"] == 100 and list(A.summed(iter([]))) == []

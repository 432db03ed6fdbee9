"""The rules that join operations to edits, one case for each."""

import pyarrow as pa
import pytest

from redpen.operators import edits as E
from redpen.operators import likeness as L


def found(a, b, feats=None, merge="rules"):
    a, b = a.split(), b.split()
    sides = [pa.array([x], pa.list_(pa.string())) for x in (a, b)]
    if feats:
        kind = pa.list_(pa.struct([("lemma", pa.string()), ("pos", pa.string())]))
        sides += [pa.array([[{"lemma": feats.get(w, (w, "X"))[0], "pos": feats.get(w, (w, "X"))[1]} for w in x]], kind) for x in (a, b)]
    spans = L.edit_spans(sides[0], sides[1], merge, *sides[2:])
    return [(e["o_start"], e["o_end"], e["c_str"]) for e in spans.to_pylist()[0]]


RULES = {
    "moved block": ("x only I want y", "x I want only y", [(1, 4, "I want only")]),
    "moved block beside others": ("x b a dogs y", "x a b dog y", [(1, 3, "a b"), (3, 4, "dog")]),
    "joined words": ("a best friend x", "a bestfriend x", [(1, 3, "bestfriend")]),
    "divided words": ("a sub - way x", "a subway x", [(1, 4, "subway")]),
    "possessive": ("my friends dog", "my friend 's dog", [(1, 2, "friend 's")]),
    "plural possessive": ("two student dogs", "two students ' dogs", [(1, 2, "students '")]),
    "punctuation alone": ("he spoke qqq loud", "he spoke well , loud", [(2, 3, "well"), (3, 3, ",")]),
    "punctuation and case": ("went , then home", "went . Then home", [(1, 3, ". Then")]),
    "case with insertion": ("Cat is here", "The cat is here", [(0, 1, "The cat")]),
    "case alone": ("i Saw it", "I saw it", [(0, 1, "I"), (1, 2, "saw")]),
    "alike words": ("a dogs barks b", "a dog bark b", [(1, 2, "dog"), (2, 3, "bark")]),
    "determiners apart": ("I seen the the dogs barks", "I saw dog bark", [(1, 2, "saw"), (2, 4, ""), (4, 5, "dog"), (5, 6, "bark")]),
    "two replaced words": ("a qqq zzz b", "a one two b", [(1, 2, "one"), (2, 3, "two")]),
    "words beside a replaced one": ("he watch it", "he look at it", [(1, 2, "look at")]),
    "inserted together": ("go home", "go right back home", [(1, 1, "right back")]),
}


@pytest.mark.parametrize("name", RULES)
def test_rule(name):
    before, after, want = RULES[name]
    assert found(before, after) == want


def test_features_join_verb_groups_only():
    feats = {"to": ("to", "PART"), "eat": ("eat", "VERB"), "devouring": ("devour", "VERB"), "qqq": ("qqq", "NOUN"), "zz": ("zz", "ADP")}
    assert found("he to eat x", "he devouring x", feats) == [(1, 3, "devouring")]
    assert found("he qqq zz x", "he devouring x", feats) == [(1, 2, "devouring"), (2, 3, "")]
    assert found("he qqq zz x", "he devouring x") == [(1, 3, "devouring")]
    # A shared lemma makes words alike.
    feats = {"went": ("go", "VERB"), "goes": ("go", "VERB")}
    assert found("he went , x", "he goes x", feats) == [(1, 2, "goes"), (2, 3, "")]


def test_other_merges_keep_moved_blocks_whole():
    pair = ("x b a dogs y", "x a b dog y")
    assert found(*pair, merge="all-split") == [(1, 3, "a b"), (3, 4, "dog")]
    assert found(*pair, merge="all-merge") == [(1, 4, "a b dog")]
    with pytest.raises(ValueError):
        found(*pair, merge="other")


def test_rules_over_a_table(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(RULES.values())] + [(90, None, "new"), (91, "old one", None), (92, None, None), (93, "", "")]
    df = spark.createDataFrame(rows, "sent_id long, original string, corrected string")
    got = {}
    for r in E.extract_edits(df, merge="rules", cost="likeness", compare_first=False).orderBy("sent_id", "edit_no").collect():
        got.setdefault(r.sent_id, []).append((r.o_start, r.o_end, r.c_str))
    want = {i: w for i, (_, _, w) in enumerate(RULES.values())} | {90: [(0, 0, "new")], 91: [(0, 2, "")]}
    assert got == want
    rebuilt = E.with_edits(df, merge="rules", cost="likeness")
    rebuilt = rebuilt.select("corrected", E.apply_edits(E.F.coalesce("original", E.F.lit("")), E.F.col("edits")).alias("r"))
    assert all((r.corrected or "") == r.r for r in rebuilt.collect())
    assert E.extract_edits(df.limit(0), merge="rules", cost="likeness").count() == 0
    with pytest.raises(ValueError):
        E.extract_edits(df, merge="rules")


def test_features_of_a_table(spark):
    one = lambda lemma, pos: {"lemma": lemma, "pos": pos, "tag": "-"}
    rows = [(1, "so he went x", "so he go wade x", [one("so", "ADV"), one("he", "PRON"), one("go", "VERB"), one("x", "X")],
             [one("so", "ADV"), one("he", "PRON"), one("go", "VERB"), one("wade", "NOUN"), one("x", "X")]), (2, "a b", "b a", None, [])]
    feats = "array<struct<lemma:string,pos:string,tag:string>>"
    df = spark.createDataFrame(rows, f"sent_id long, original string, corrected string, o_feats {feats}, c_feats {feats}")
    got = E.extract_edits(df, merge="rules", cost="likeness", features=("o_feats", "c_feats")).collect()
    assert {(r.sent_id, r.o_start, r.o_end, r.c_str) for r in got} == {(1, 2, 3, "go"), (1, 3, 3, "wade"), (2, 0, 2, "b a")}

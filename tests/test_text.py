import sys

import pytest
from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.functions.charedits import apply_char_edits
from redpen.schema import CHAR_EDITS

GOLDEN = [
    ("Laura's dog.", "Laura 's dog .", "Laura's dog."),
    ("It's Laura's.", "It 's Laura 's .", "It's Laura 's."),
    ("years' work", "years ' work", "years' work"),
    ("don't they're here", "do n't they 're here", "don't they're here"),
    ("3.14 at 3:30, 1,000", "3 .14 at 3 :30 , 1 ,000", "3.14 at 3:30, 1,000"),
    ("Wait... etc. Mr. X, U.S.A.", "Wait ... etc. Mr. X , U.S.A .", "Wait... etc. Mr. X, U.S.A."),
]


def evaluate(spark, values, column, schema="t STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_golden_tokenizer_cases(spark):
    plain = [g[0] for g in GOLDEN]
    assert evaluate(spark, plain, T.tokenize(F.col("t"))) == [g[1] for g in GOLDEN]
    assert evaluate(spark, plain, T.detokenize(T.tokenize(F.col("t")))) == [g[2] for g in GOLDEN]


def test_tokenizing_twice_doubles_spaces(spark):
    assert evaluate(spark, ["don't"], T.tokenize(T.tokenize(F.col("t")))) == ["do  n't"]


def test_whitespace_matches_python_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a{c}{c}b{c}" for c in chars]
    assert evaluate(spark, texts, T.strip(F.col("t"))) == [t.strip() for t in texts]
    assert evaluate(spark, texts, T.tokens(F.col("t"))) == [t.split() for t in texts]
    assert sys.maxunicode > 0xFFFF


def test_normalize_collapses_double_spaces_once(spark):
    texts = ["a\nb", "a   b", "a\n\n b", "  x \n", "", "😀  😀"]
    expected = [t.replace("\n", " ").replace("  ", " ").strip() for t in texts]
    assert evaluate(spark, texts, T.normalize_ws(F.col("t"))) == expected


@pytest.mark.parametrize("text", ["abc", "", "😀é"])
def test_strikeout(spark, text):
    marked = "".join(ch + "̶" for ch in text) or "̶"
    assert evaluate(spark, [text], T.strikeout(F.col("t"))) == [marked]


def test_prefix(spark):
    assert T.clean_task_prefix(" Gram:mar: ") == "Grammar"
    got = evaluate(spark, ["x", None], T.with_task_prefix(F.col("t"), "Grammar:"))
    assert got == ["Grammar: x", "Grammar: "]


def test_edit_key_fields(spark):
    key = T.first_fields(F.lit("1 2|||R:DET|||the|||REQUIRED|||-NONE-|||0"), 3)
    assert evaluate(spark, ["x"], key) == ["1 2|||R:DET|||the"]
    assert evaluate(spark, ["R:NOUN:NUM"], T.strip_operation(F.col("t"))) == ["NOUN:NUM"]


CHAR_CASES = [
    ("hello world", ([0], [5], ["HELLO"]), "HELLO world"),
    ("hello world", ([5], [11], [None]), "hello"),
    ("hello world", ([], [], []), "hello world"),
    ("two  spaces", ([], [], []), "two  spaces"),
    ("a b c", ([1], [4], ["  "]), "a c"),
    ("abcdef", ([1, 2], [4, 5], ["X", "Y"]), "aXYf"),
    ("😀bc", ([1], [2], ["é"]), "😀éc"),
    ("abc", ([3], [3], ["!"]), "abc!"),
    ("abc", ([0, 0], [0, 1], ["x", "y"]), "xybc"),
]


def test_char_edits(spark):
    rows = [(i, t, e) for i, (t, e, _) in enumerate(CHAR_CASES)]
    df = spark.createDataFrame(rows, f"i INT, t STRING, e {CHAR_EDITS.simpleString()}")
    got = df.orderBy("i").select(apply_char_edits(F.col("t"), F.col("e"))).collect()
    assert [r[0] for r in got] == [c[2] for c in CHAR_CASES]

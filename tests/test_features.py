"""Token features of the given tables, by batch, and the edits that are typed by them."""

from pyspark.sql import functions as F

from queries import fixtures as X
from redpen.functions import text as T
from redpen.operators import classify as C

WORDS = "Sing does toe eed inged ing ED es e station ly quickly on at İng ΟΔΟΣ x\u0085 ed. nation's Ed tes a😀ing ß des"


def native(words):
    """The same guesses, token by token."""

    def guessed(token):
        word = F.lower(token)
        ends = lambda *suffixes: word.rlike("(" + "|".join(suffixes) + ")$")
        pos = (
            F.when(ends("ing", "ed"), "VERB").when(ends("ly"), "ADV").when(ends("es", "e", "tion"), "NOUN")
            .when(ends("n", "t"), "ADJ").otherwise("X")
        )
        tag = F.when(ends("ing"), "VBG").when(ends("ed"), "VBD").otherwise("-")
        lemma = F.regexp_replace(word, "(ing|ed|es|e)$", "")
        return F.struct(lemma.alias("lemma"), pos.alias("pos"), tag.alias("tag"))

    return F.transform(words, guessed)


def test_features_by_batch_equal_those_token_by_token(spark):
    df = spark.createDataFrame([(t,) for t in (WORDS, None, "", " \t", "one", WORDS[::-1])], "t STRING")
    rows = df.select(X.feature_array(F.col("t")).alias("batch"), native(T.tokens(F.col("t"))).alias("native")).collect()
    assert [r.batch for r in rows] == [r.native for r in rows]


def test_an_edit_goes_over_its_own_features_only(spark):
    one = lambda lemma: {"lemma": lemma, "pos": "VERB", "tag": "VBG"}
    feats = "array<struct<lemma:string,pos:string,tag:string>>"
    rows = [(1, "a b walking d", "a b walks d", [one(x) for x in "abwd"], [one(x) for x in "abwd"]), (2, "a x", "a y", None, [one("a")])]
    df = spark.createDataFrame(rows, f"sent_id long, original string, corrected string, o_feats {feats}, c_feats {feats}")
    words = spark.createDataFrame([("walking", 1), ("x", 1)], "word STRING, n LONG")
    typed = C.classify_pairs(df, words, ("o_feats", "c_feats"))
    assert sorted((r.sent_id, r.type) for r in typed.collect()) == [(1, "R:VERB:FORM"), (2, "R:OTHER")]
    cut = C.covered_features("o_feats", "o")._jc.toString()
    assert cut.index("slice") > cut.index("transform")

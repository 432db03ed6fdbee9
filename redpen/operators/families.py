"""Word families mined from the corpus: lemma, part of speech and tag without a tagger.

Every word of the vocabulary proposes the base words it might be an inflection
of; those that the vocabulary has count. An ending is kept if it shows
on enough different base words, so one that this corpus does not inflect by drops out.
The endings seen on a base word tell what it is: a verb with -ed or
-ing, an adjective with -er or -est, a noun with -s, an adjective with -ly only.

All joins are on words of the vocabulary, each of which proposes at most one
base per ending; the corpus itself is only counted once, for the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.session import materialize

# English endings as (kind, ending, what the base word has instead).
ENDINGS = (
    ("s", "s", ""), ("s", "es", ""), ("s", "ies", "y"),
    ("ed", "ed", ""), ("ed", "ed", "e"), ("ed", "ied", "y"),
    ("ing", "ing", ""), ("ing", "ing", "e"),
    ("er", "er", ""), ("er", "er", "e"), ("er", "ier", "y"),
    ("est", "est", ""), ("est", "est", "e"), ("est", "iest", "y"),
    ("ly", "ly", ""), ("ly", "ily", "y"),
)
#: Kinds before which a base word may double its last consonant.
DOUBLING = ("ed", "ing", "er", "est")
#: Letters that a base word has at least.
SHORTEST = 3


def proposals(word: Column) -> Column:
    """(lemma, kind, ending) of every base word that ``word`` might belong to."""
    rules = [
        (word.endswith(end), F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(base)), kind, f"{end}>{base}")
        for kind, end, base in ENDINGS
    ]
    for kind in DOUBLING:
        pattern = f"([^aeiou0-9])\\1{kind}$"
        rules.append((word.rlike(pattern), F.regexp_replace(word, pattern, "$1"), kind, f"2{kind}>"))
    made = [
        F.when(fits & (F.length(lemma) >= SHORTEST), F.struct(lemma.alias("lemma"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule")))
        for fits, lemma, kind, rule in rules
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def word_families(vocabulary: DataFrame, min_stems: int = 3, closed: tuple[str, ...] = ()) -> DataFrame:
    """(word, lemma, pos, tag) of every word that has a family.

    ``closed`` words inflect nothing and belong to none. An ending counts if at least ``min_stems`` base words of the vocabulary take it.
    Of several families a word belongs to the one in which it is inflected, then
    to the largest, then to the one whose lemma sorts last.
    """
    words = vocabulary.select("word").where(~F.col("word").isin(*closed)).distinct()
    proposed = words.select("word", F.inline(proposals(F.col("word"))))
    bases = words.select(F.col("word").alias("lemma"))
    attested = materialize(proposed.join(bases, "lemma"), "families")
    # One row for each rule.
    productive = attested.groupBy("rule").agg(F.count("*").alias("stems")).where(F.col("stems") >= min_stems)
    members = attested.join(F.broadcast(productive.select("rule")), "rule", "left_semi")
    kinds = members.groupBy("lemma").agg(F.collect_set("kind").alias("kinds"))
    has = lambda *names: F.arrays_overlap("kinds", F.array(*[F.lit(n) for n in names]))
    base_pos = F.when(has("ed", "ing"), "VERB").when(has("er", "est"), "ADJ").when(has("s"), "NOUN").otherwise("ADJ")
    lemmas = kinds.select("lemma", base_pos.alias("base"), F.size("kinds").alias("size"))
    own = lemmas.select(F.col("lemma").alias("word"), "lemma", F.lit("").alias("kind"), "base", "size")
    forms = members.select("lemma", "word", "kind").distinct().join(lemmas, "lemma").select(own.columns)
    everything = own.unionByName(forms)
    order = F.struct(F.col("kind") != "", "size", "lemma", "kind")
    best = everything.groupBy("word").agg(F.max_by(F.struct("lemma", "kind", "base"), order).alias("b"))
    kind, base = F.col("b.kind"), F.col("b.base")
    pos = (
        F.when(kind == "", base).when(kind == "s", F.when(base == "VERB", "VERB").otherwise("NOUN"))
        .when(kind.isin("ed", "ing"), "VERB").when(kind == "ly", "ADV")
        .when(base == "ADJ", "ADJ").otherwise("NOUN")
    )
    tag = (
        F.when(kind == "ed", "VBD").when(kind == "ing", "VBG")
        .when((kind == "s") & (base == "VERB"), "VBZ").when((kind == "") & (base == "VERB"), "VB").otherwise(kind)
    )
    return best.select("word", "b.lemma", pos.alias("pos"), tag.alias("tag"))


def known_words(vocabulary: DataFrame, families: DataFrame) -> DataFrame:
    """(word, feature) of all words; the feature is null for words without a family."""
    feature = F.struct(F.col("lemma"), F.col("pos"), F.col("tag"))
    named = families.select("word", feature.alias("feature"))
    return vocabulary.select("word").distinct().join(named, "word", "left")

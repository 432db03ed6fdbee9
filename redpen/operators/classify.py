"""Error categories of edits.

Three tiers, each optional beyond the first: string rules; word classes from
closed lists and the corpus vocabulary; part of speech and lemma, from arrays or a
token table the user supplies, or from word families mined from the vocabulary.
Without any of them the third tier's categories come out as OTHER; mined ones
do not compare with those of a tagger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions.arrays import bind
from redpen.operators import alignment
from redpen.operators.edits import with_edits
from redpen.operators.families import known_words, proposals, word_families
from redpen.operators.skew import lookup
from redpen.session import materialize

# The error categories a report can hold.
CATEGORIES = (
    "ADJ", "ADJ:FORM", "ADV", "CONJ", "CONTR", "DET", "MORPH", "NOUN", "NOUN:INFL",
    "NOUN:NUM", "NOUN:POSS", "ORTH", "OTHER", "PART", "PREP", "PRON", "PUNCT", "SPELL",
    "VERB", "VERB:FORM", "VERB:INFL", "VERB:SVA", "VERB:TENSE", "WO",
)

# Closed word classes of English, lower case.
CLOSED_CLASSES = {
    "DET": (
        "a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any",
        "no", "all", "both", "either", "neither", "another", "such", "half",
    ),
    "PREP": (
        "about", "above", "across", "after", "against", "along", "among", "around", "at",
        "before", "behind", "below", "beneath", "beside", "between", "beyond", "by", "despite",
        "during", "except", "for", "from", "in", "inside", "into", "near", "of", "off", "on",
        "onto", "outside", "over", "past", "since", "through", "throughout", "toward",
        "towards", "under", "until", "up", "upon", "via", "with", "within", "without",
    ),
    "PRON": (
        "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "yourselves",
        "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
        "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves",
        "who", "whom", "whose", "someone", "somebody", "something", "anyone", "anybody",
        "anything", "everyone", "everybody", "everything", "nobody", "nothing",
    ),
    "CONJ": (
        "and", "or", "but", "nor", "so", "yet", "because", "although", "though", "while",
        "whereas", "if", "unless", "whether",
    ),
    "PART": ("to", "not"),
}

# Clitics written as tokens of their own.
CONTRACTIONS = ("'d", "'ll", "'m", "n't", "'re", "'ve", "ca", "sha", "wo")
POSSESSIVES = ("'s", "'")

# Characters that count as punctuation.
PUNCTUATION = r"^[!-/:-@\[-`{-~\x{2018}\x{2019}\x{201c}\x{201d}\x{2026}\x{2013}\x{2014}\x{ab}\x{bb} ]+$"

#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 100_000
#: Known words of edits up to which they are broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

# Misspelled inflections: decided before the spelling rule.
INFLECTIONS = ("NOUN:INFL", "VERB:INFL")

# Part-of-speech tag to category, for one-class edits.
POS_CATEGORY = {
    "NOUN": "NOUN", "PROPN": "NOUN", "VERB": "VERB", "AUX": "VERB:TENSE", "ADJ": "ADJ",
    "ADV": "ADV", "DET": "DET", "ADP": "PREP", "PRON": "PRON", "CCONJ": "CONJ",
    "SCONJ": "CONJ", "PART": "PART", "PUNCT": "PUNCT",
}


def build_vocabulary(texts: DataFrame, text: str = "corrected", min_count: int = 1) -> DataFrame:
    """Lower-cased tokens seen at least ``min_count`` times, with their count ``n``.

    Tokens are split and counted by Arrow batch, so that only distinct ones are lower-cased,
    which never depends on another token, and added up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (c for batch in batches for c in alignment.word_counts(batch.column(0)))
        for table in alignment.summed(counts):
            yield from table.combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    words = texts.select(F.col(text).cast("string")).mapInArrow(count, "word STRING, n BIGINT")
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _all_in(words: Column, listed: tuple[str, ...]) -> Column:
    return F.forall(words, lambda w: w.isin(*listed))


def category_rules(
    o_str: Column, c_str: Column, known: Column | None = None, by_pos: Column | None = None
) -> Column:
    """The first rule that fits decides.

    ``known``: is a single original token in the vocabulary. ``by_pos``: the
    category from token features, or null.
    """
    split = lambda text: F.split(F.lower(text), " ")
    values = {"o_str": o_str, "c_str": c_str, "o": split(o_str), "c": split(c_str)}
    values |= {name: given for name, given in (("known", known), ("by_pos", by_pos)) if given is not None}
    # Each value is used by several rules.
    return bind(values, lambda row: bind({"row": row, "words": F.array_remove(F.concat(row["o"], row["c"]), "")}, _rules(*values)))


def _rules(*names: str) -> Callable[[Column], Column]:
    """The rules over a row of these values and all the words of both sides."""

    def decided(bound: Column) -> Column:
        row, words = bound["row"], bound["words"]
        o_str, c_str, o_words, c_words = (row[x] for x in ("o_str", "c_str", "o", "c"))
        both = (o_str != "") & (c_str != "")
        one_word = ~F.contains(o_str, F.lit(" "))
        squash = lambda side: F.array_join(side, "")
        rules = [
            (both & (squash(o_words) == squash(c_words)), "ORTH"),
            (_all_in(words, POSSESSIVES), "NOUN:POSS"),
            (F.concat_ws(" ", o_str, c_str).rlike(PUNCTUATION), "PUNCT"),
            (both & ~one_word & (F.array_sort(o_words) == F.array_sort(c_words)), "WO"),
            (_all_in(words, CONTRACTIONS), "CONTR"),
        ]
        if "by_pos" in names:
            rules.append((row["by_pos"].isin(*INFLECTIONS), row["by_pos"]))
        if "known" in names:
            lettered = o_str.rlike("[A-Za-z]")
            rules.append((both & one_word & lettered & ~row["known"], "SPELL"))
        rules += [(_all_in(words, listed), name) for name, listed in CLOSED_CLASSES.items()]
        chain = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
        other = F.lit("OTHER")
        return chain.otherwise(F.coalesce(row["by_pos"], other) if "by_pos" in names else other)

    return decided


def classify(
    edits: DataFrame, vocabulary: DataFrame | None = None, keys: tuple[str, ...] = ("sent_id",)
) -> DataFrame:
    """Adds ``category`` and ``type`` to edits (tiers one and two)."""
    if vocabulary is None:
        known, rows = None, edits
    else:
        rows = mark_known(edits, vocabulary, keys)
        known = F.col("_known")
    category = category_rules(F.col("o_str"), F.col("c_str"), known)
    named = rows.withColumn("category", category)
    return named.withColumn("type", F.concat_ws(":", "op", "category")).drop("_known")


def _lookup_word() -> Column:
    """What an edit looks up in the vocabulary: never null, so nothing piles up.

    Spans of several words and insertions hold a space, which no word does.
    """
    return F.when(F.col("o_str") == "", F.concat(F.lit(" "), "c_str")).otherwise(F.lower("o_str"))


def _is_known() -> Column:
    single = (F.col("op") == "R") & ~F.contains("o_str", F.lit(" "))
    return F.coalesce("_known", F.lit(False)) | ~single


def mark_known(
    edits: DataFrame, vocabulary: DataFrame, keys: tuple[str, ...] = ("sent_id",)
) -> DataFrame:
    """Adds ``_known``: is the (single-token) original in the vocabulary.

    Edits are written once because they feed both the count of frequent tokens
    and the join. Only the words of the vocabulary that edits look up are joined: broadcast if
    their measured size allows it; if not, a misspelling that makes up a third of all edits is spread.
    """
    rows = materialize(edits.withColumn("word", _lookup_word()), "edits")
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    entries = materialize(vocabulary.select("word").join(counts, "word", "left_semi"), "known")
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    entries = entries.withColumn("_known", F.lit(True))
    if size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(entries), "word", "left")
    else:
        joined = lookup(rows, entries, "word", F.struct(*keys, "o_start", "o_end"), counts)
    return joined.withColumn("_known", _is_known()).drop("word")


def classify_counts(flags: DataFrame, vocabulary: DataFrame, families: int | None = None) -> DataFrame:
    """Categories of matched edits, summed per distinct (op, o_str, c_str) first.

    The flags of equal edits are added up before any join, so a frequent edit is
    one row when it meets the vocabulary. With ``families``, the least number of base
    words an ending must show on, word families of the vocabulary decide too.
    """
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    counted = flags.groupBy("op", "o_str", "c_str").agg(*sums)
    if families is not None:
        return typed_by_families(counted, vocabulary, families)
    counted = counted.withColumn("word", _lookup_word())
    entries = vocabulary.select("word", F.lit(True).alias("_known"))
    category = category_rules(F.col("o_str"), F.col("c_str"), _is_known())
    return counted.join(entries, "word", "left").select(
        "op", "o_str", "c_str", category.alias("category"), "tp", "fp", "fn"
    )


def _other_word() -> Column:
    """What an edit looks up for its correction; deletions and several words find nothing."""
    return F.when(F.col("c_str") == "", F.concat(F.lit(" "), "o_str")).otherwise(F.lower("c_str"))


def typed_by_families(counted: DataFrame, vocabulary: DataFrame, min_stems: int = 3) -> DataFrame:
    """Adds ``category`` to distinct (op, o_str, c_str) by the word families of the vocabulary.

    An unknown original that would be a form of the correction's base word is an
    inflection of the wrong kind.
    """
    vocabulary = materialize(vocabulary.select("word").distinct(), "vocabulary")
    closed = tuple(word for listed in CLOSED_CLASSES.values() for word in listed)
    words = materialize(known_words(vocabulary, word_families(vocabulary, min_stems, closed)), "words")
    rows = counted.withColumns({"word": _lookup_word(), "_other": _other_word()})
    rows = rows.join(words.select("word", F.col("feature").alias("_of"), F.lit(True).alias("_known")), "word", "left")
    others = words.select(F.col("word").alias("_other"), F.col("feature").alias("_cf"))
    rows = rows.join(others, "_other", "left").withColumn("_known", _is_known())
    bases = F.transform(proposals(F.col("word")), lambda p: p["lemma"])
    would_be = ~F.col("_known") & (F.array_contains(bases, F.col("_cf.lemma")) | (F.col("_cf.lemma") == F.col("word")))
    as_other = F.struct(F.col("_cf.lemma").alias("lemma"), F.col("_cf.pos").alias("pos"), F.lit(None).cast("string").alias("tag"))
    o_feature = F.when(F.col("_of").isNotNull(), F.col("_of")).when(would_be, as_other)
    listed = lambda f: F.filter(F.array(f), lambda x: x.isNotNull())
    by_pos = pos_category(listed(o_feature), listed(F.col("_cf")), F.col("_known"))
    # A replacement is typed by both its words or not at all.
    told = ((F.col("o_str") == "") | o_feature.isNotNull()) & ((F.col("c_str") == "") | F.col("_cf").isNotNull())
    category = category_rules(F.col("o_str"), F.col("c_str"), F.col("_known"), F.when(told, by_pos))
    return rows.withColumn("category", category).drop("word", "_other", "_of", "_cf", "_known")


def classify_by_families(
    edits: DataFrame, vocabulary: DataFrame, keys: tuple[str, ...] = ("sent_id",), min_stems: int = 3
) -> DataFrame:
    """Adds ``category`` and ``type`` to edits: each distinct edit is typed once and looked up.

    Edits are written once because they are both counted and joined.
    """
    rows = edits.withColumn("_edit", F.concat_ws("\u0000", "op", "o_str", "c_str"))
    rows = materialize(rows, "edits")
    counted = rows.groupBy("op", "o_str", "c_str", "_edit").agg(F.count("*").alias("n"))
    typed = materialize(typed_by_families(counted, vocabulary, min_stems), "typed")
    found = lookup(rows, typed.select("_edit", "category"), "_edit", F.struct(*keys, "o_start", "o_end"), typed.select("_edit", "n"))
    return found.withColumn("type", F.concat_ws(":", "op", "category")).drop("_edit")


def covered_features(name: str, side: str) -> Column:
    """The features of the tokens that an edit covers, cut first: it does not go over all of its sentence."""
    length = F.col(f"{side}_end") - F.col(f"{side}_start")
    own = F.slice(name, F.col(f"{side}_start") + 1, length)
    own = F.transform(own, lambda f: F.struct(f["lemma"].alias("lemma"), f["pos"].alias("pos"), f["tag"].alias("tag")))
    return F.coalesce(own, F.array().cast("array<struct<lemma:string,pos:string,tag:string>>"))


def classify_pairs(
    pairs: DataFrame,
    vocabulary: DataFrame,
    features: tuple[str, str],
    keys: tuple[str, ...] = ("sent_id",),
    original: str = "original",
    corrected: str = "corrected",
    **extraction: str,
) -> DataFrame:
    """Edits of pairs with ``category`` and ``type`` by features that lie beside the texts.

    ``features`` names two arrays of structs (lemma, pos, tag), one for each token of
    either side; an edit's are cut out by position. No token is exploded or joined:
    both possible categories, of a known and an unknown original, are settled where the pair is
    read, and only those travel to the vocabulary.
    """
    given = {"features": features} if extraction.get("cost", "unit") != "unit" else {}
    rows = with_edits(pairs.select(*keys, original, corrected, *features), original, corrected, **extraction, **given)
    rows = rows.select(*keys, *features, F.inline("edits"))
    rows = rows.withColumns({"_of": covered_features(features[0], "o"), "_cf": covered_features(features[1], "c")})
    settled = {}
    for name, known in (("_if_known", True), ("_if_not", False)):
        by_pos = pos_category(F.col("_of"), F.col("_cf"), F.lit(known))
        settled[name] = category_rules(F.col("o_str"), F.col("c_str"), F.lit(known), by_pos)
    rows = rows.withColumns(settled).drop("_of", "_cf", *features)
    rows = mark_known(rows, vocabulary, keys)
    category = F.when(F.col("_known"), F.col("_if_known")).otherwise(F.col("_if_not"))
    named = rows.withColumn("category", category).withColumn("type", F.concat_ws(":", "op", "category"))
    return named.drop("_known", "_if_known", "_if_not")


def span_features(
    edits: DataFrame, token_features: DataFrame, keys: tuple[str, ...] = ("sent_id",)
) -> DataFrame:
    """Adds ``o_feats`` and ``c_feats``: features of the tokens each edit covers.

    ``token_features``: keys, side (``o`` or ``c``), tok_no, lemma, pos, tag. The
    edited positions are exploded and joined by position, so unedited tokens
    drop out and every join key is one token.
    """
    span = lambda side: F.when(
        F.col(f"{side}_end") > F.col(f"{side}_start"),
        F.sequence(F.col(f"{side}_start"), F.col(f"{side}_end") - 1),
    ).otherwise(F.array().cast("array<int>"))
    place = lambda side: F.transform(
        span(side), lambda at: F.struct(F.lit(side).alias("side"), at.alias("tok_no"))
    )
    places = F.concat(place("o"), place("c"))
    at = edits.select(*keys, "edit_no", F.inline(places))
    found = at.join(token_features, [*keys, "side", "tok_no"])
    feature = F.struct("tok_no", "lemma", "pos", "tag")
    side_list = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, feature)))
    per_edit = found.groupBy(*keys, "edit_no").agg(
        side_list("o").alias("o_feats"), side_list("c").alias("c_feats")
    )
    return edits.join(per_edit, [*keys, "edit_no"], "left")


def pos_category(o_feats: Column, c_feats: Column, known: Column) -> Column:
    """Category from part of speech, lemma and fine tag; null when nothing fits."""
    o_pos, c_pos = o_feats["pos"], c_feats["pos"]
    seen = F.array_distinct(F.concat(o_pos, c_pos))
    classes = F.array_distinct(F.transform(seen, _class_of))
    one_class = F.when(F.size(classes) == 1, F.get(classes, F.lit(0)))
    verbal = (F.size(seen) > 0) & _all_in(seen, ("VERB", "AUX"))
    o1, c1 = F.get(o_feats, F.lit(0)), F.get(c_feats, F.lit(0))
    single = (F.size(o_feats) == 1) & (F.size(c_feats) == 1)
    same_lemma = o1["lemma"] == c1["lemma"]
    tags = F.array(o1["tag"], c1["tag"])
    has = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    nouns = _all_in(seen, ("NOUN", "PROPN"))

    inflected = (
        F.when(nouns & ~known, "NOUN:INFL")
        .when(nouns, "NOUN:NUM")
        .when(verbal & ~known, "VERB:INFL")
        .when(verbal & has("VBG", "VBN"), "VERB:FORM")
        .when(verbal & has("VBD"), "VERB:TENSE")
        .when(verbal & has("VBZ") & has("VB", "VBP"), "VERB:SVA")
        .when(verbal, "VERB:FORM")
        .when(_all_in(seen, ("ADJ",)), "ADJ:FORM")
        .when(F.size(classes) > 1, "MORPH")
    )
    mixed_verbs = F.when(verbal & (F.size(classes) > 1), F.lit("VERB:TENSE"))
    return F.coalesce(F.when(single & same_lemma, inflected), one_class, mixed_verbs)


def _class_of(pos: Column) -> Column:
    table = [x for pair in POS_CATEGORY.items() for x in (F.lit(pair[0]), F.lit(pair[1]))]
    return F.coalesce(F.element_at(F.create_map(*table), pos), F.lit("OTHER"))


def classify_with_features(
    edits: DataFrame,
    vocabulary: DataFrame,
    token_features: DataFrame,
    keys: tuple[str, ...] = ("sent_id",),
) -> DataFrame:
    """Adds ``category`` and ``type`` with all three tiers."""
    rows = mark_known(edits, vocabulary, keys)
    rows = span_features(rows, token_features, keys)
    empty = F.array().cast("array<struct<tok_no:int,lemma:string,pos:string,tag:string>>")
    o_feats, c_feats = F.coalesce("o_feats", empty), F.coalesce("c_feats", empty)
    by_pos = pos_category(o_feats, c_feats, F.col("_known"))
    category = category_rules(F.col("o_str"), F.col("c_str"), F.col("_known"), by_pos)
    return (
        rows.withColumn("category", category)
        .withColumn("type", F.concat_ws(":", "op", "category"))
        .drop("_known", "o_feats", "c_feats")
    )

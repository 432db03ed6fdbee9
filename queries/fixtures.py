"""Inputs derived from the given tables: whole tables, whole texts.

The Spark and the SQL form of each fixture build the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpen.functions.text import replace_all
from redpen.operators.alignment import token_lists
from redpen.session import spread_scan

# Corruptions, as (clean, corrupted). The corrupted spellings and the added
# words occur nowhere in the tables, so every planted edit is recognizable.
MISSPELLED = ((" the ", " teh "), (" de ", " ed "), (" der ", " dre "))
CONFUSED = ((" to ", " too "),)
WRONG_REPAIR = ((" in ", " on "),)
MISSING = " and "
UNNECESSARY = " of "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of part files.

    The pattern fits only the table; a plain path to one file is no source of a stream.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.{{parquet}}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return spread_scan(docs, "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of all documents, keyed by document and line number."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ln", "line")
    )
    return docs.where(F.col("line") != "").select(
        (F.col("doc_id") * 1_000_000 + F.col("ln")).alias("sent_id"), "doc_id", "source", "line"
    )


LINES_SQL = """
  SELECT doc_id * 1000000 + ln AS sent_id, doc_id, source, line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
        FROM documents)
  WHERE line <> ''
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line triples: erroneous input, full correction, partial and partly wrong one.

    Lines with `` and `` get a missing word, other lines an unnecessary one.
    """
    line = F.col("line")
    missing = F.contains(line, F.lit(MISSING))
    added = F.when(missing, line).otherwise(
        F.replace(line, F.lit(UNNECESSARY), F.lit(UNNECESSARY + "very "))
    )
    insert = lambda word: F.when(
        missing, F.replace(line, F.lit(MISSING), F.lit(MISSING + word + " "))
    ).otherwise(line)
    return lines(spark, sf_dir).select(
        "sent_id",
        "doc_id",
        "source",
        replace_all(added, MISSPELLED + CONFUSED).alias("input_text"),
        insert("also").alias("target_text"),
        replace_all(insert("quite"), CONFUSED + WRONG_REPAIR).alias("hyp_text"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_replace(expr: str, changes) -> str:
    for old, new in changes:
        expr = f"replace({expr}, {quoted(old)}, {quoted(new)})"
    return expr


PAIRS_SQL = f"""
  SELECT sent_id, doc_id, source,
    {_sql_replace(f"CASE WHEN contains(line, '{MISSING}') THEN line ELSE replace(line, '{UNNECESSARY}', '{UNNECESSARY}very ') END", MISSPELLED + CONFUSED)} AS input_text,
    CASE WHEN contains(line, '{MISSING}') THEN replace(line, '{MISSING}', '{MISSING}also ') ELSE line END AS target_text,
    {_sql_replace(f"CASE WHEN contains(line, '{MISSING}') THEN replace(line, '{MISSING}', '{MISSING}quite ') ELSE line END", CONFUSED + WRONG_REPAIR)} AS hyp_text
  FROM ({LINES_SQL})
"""


# Words turned into clitics and abbreviations, which the prose does not have.
CLITICS = (
    (" of ", " don't "), (" to ", " they're "), (" is ", " Laura's "), (" it ", " I'm "),
    (" by ", " we've "), (" for ", " we'll "), (" on ", " years' "), (" with ", " etc. "),
    (" that ", " Mr. "), (" this ", " U.S.A. "), (" are ", " Wait... "), (" le ", " 3.14 "),
    (" la ", " 3:30 "),
)


def clitics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("sent_id", replace_all(F.col("line"), CLITICS).alias("text"))


CLITICS_SQL = f"SELECT sent_id, {_sql_replace('line', CLITICS)} AS text FROM ({LINES_SQL})"

LEFT_PAD, RIGHT_PAD = "\t\u00a0 ", " \u2003\n\u3000"


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with whitespace of several kinds at both ends."""
    text = F.concat(F.lit(LEFT_PAD), F.col("text"), F.lit(RIGHT_PAD))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


PADDED_SQL = (
    "SELECT doc_id, chr(9) || chr(160) || ' ' || text || ' ' || chr(8195) || chr(10) || chr(12288) AS text "
    "FROM documents"
)


def multi_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns with the other turns as corrections, plus a blank and an identical one."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    )
    texts = F.transform("turns", lambda t: t["text"])
    first = F.element_at(texts, 1)
    extra = F.array(F.lit(" \t"), F.concat(first, F.lit(" ")))
    rest = F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))
    return turns.select(
        F.col("conv_id").alias("sent_id"), first.alias("sentence"), F.concat(rest, extra).alias("corrections")
    )


MULTI_REFS_SQL = """
  SELECT conv_id AS sent_id, texts[1] AS sentence,
         list_concat(texts[2:], [' ' || chr(9), texts[1] || ' ']) AS corrections
  FROM (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
"""


def char_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with four character edits; French ones with none."""
    n = F.length("text")
    at = lambda num, den, plus=0: F.floor(n * num / den).cast("int") + plus
    none = F.array().cast("array<int>")
    edited = F.col("lang") != "fr"
    when = lambda filled, empty: F.when(edited, filled).otherwise(empty)
    null = F.lit(None).cast("string")
    edits = F.struct(
        when(F.array(at(1, 4), at(1, 2), at(3, 4), at(3, 4)), none).alias("start"),
        when(F.array(at(1, 4, 3), at(1, 2, 2), at(3, 4), at(3, 4, 1)), none).alias("end"),
        when(
            F.array(F.lit("XX "), null, F.lit(" \U0001f600 "), F.lit("")), F.array().cast("array<string>")
        ).alias("text"),
    )
    return documents(spark, sf_dir).select(F.col("doc_id").alias("sent_id"), "text", edits.alias("edits"))


CHAR_EDITS_SQL = """
  SELECT doc_id AS sent_id, text,
    CASE WHEN lang <> 'fr' THEN [
      {'s': length(text) // 4, 'e': length(text) // 4 + 3, 't': 'XX '},
      {'s': length(text) // 2, 'e': length(text) // 2 + 2, 't': NULL},
      {'s': length(text) * 3 // 4, 'e': length(text) * 3 // 4, 't': ' ' || chr(128512) || ' '},
      {'s': length(text) * 3 // 4, 'e': length(text) * 3 // 4 + 1, 't': ''}] ELSE [] END AS edits
  FROM documents
"""

# Word endings swapped, position by position.
ENDINGS = (("ing ", "ed "), ("es ", "e "))


def inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against the same lines with other word endings."""
    return lines(spark, sf_dir).select(
        "sent_id", replace_all(F.col("line"), ENDINGS).alias("input_text"), F.col("line").alias("target_text")
    )


INFLECTED_SQL = f"""
  SELECT sent_id, {_sql_replace('line', ENDINGS)} AS input_text, line AS target_text FROM ({LINES_SQL})
"""


def token_features(tokens_by_side: DataFrame) -> DataFrame:
    """Part of speech and lemma guessed from word endings: (sent_id, side, tok_no, token) in."""
    word = F.lower("token")
    ends = lambda *suffixes: word.rlike("(" + "|".join(suffixes) + ")$")
    pos = (
        F.when(ends("ing", "ed"), "VERB").when(ends("ly"), "ADV").when(ends("es", "e", "tion"), "NOUN")
        .when(ends("n", "t"), "ADJ").otherwise("X")
    )
    tag = F.when(ends("ing"), "VBG").when(ends("ed"), "VBD").otherwise("-")
    lemma = F.regexp_replace(word, "(ing|ed|es|e)$", "")
    return tokens_by_side.select(
        "sent_id", "side", "tok_no", lemma.alias("lemma"), pos.alias("pos"), tag.alias("tag")
    )


# Errors of several kinds in every whole block of so many words.
BLOCK = 20
#: Added to words that change places, so that none looks like its neighbour.
UNLIKE = {9: "xxzz", 12: "xxzz", 13: "kkvv"}


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose words carry their place, so that each occurs once, with errors that rules tell apart.

    In each block: two alike words next to each other, a repeated determiner, two words in
    the wrong order, one moved over two others, a wrong word with a missing comma, and a possessive.
    """
    def placed(word, k):
        ending = F.lit("")
        for p, letters in UNLIKE.items():
            ending = F.when(k % BLOCK == p, letters).otherwise(ending)
        return F.concat(word, k.cast("string"), ending)

    words = F.transform(F.filter(F.split("line", r"\s+"), lambda w: w != ""), placed)
    rows = lines(spark, sf_dir).select("sent_id", words.alias("w"))

    def side(kinds: dict[int, Callable]) -> Column:
        def made(word, k):
            place = k % BLOCK
            whole = k - place + BLOCK <= F.size("w")
            at = lambda step: F.get(F.col("w"), k + step)
            chosen = F.when(~whole, F.array(word))
            for p, build in kinds.items():
                chosen = chosen.when(place == p, F.array(*build(word, at)))
            return chosen.otherwise(F.array(word))

        return F.array_join(F.flatten(F.transform("w", made)), " ")

    with_s = lambda word, at: [F.concat(word, F.lit("s"))]
    the = F.lit("the")
    original = {
        2: with_s, 3: with_s, 6: lambda word, at: [the, the, word],
        9: lambda word, at: [at(1)], 10: lambda word, at: [at(-1)],
        12: lambda word, at: [at(2)], 13: lambda word, at: [at(-1)], 14: lambda word, at: [at(-1)],
        17: lambda word, at: [F.lit("qqq")], 19: with_s,
    }
    corrected = {17: lambda word, at: [word, F.lit(",")], 19: lambda word, at: [word, F.lit("'s")]}
    return rows.select("sent_id", side(original).alias("original"), side(corrected).alias("corrected"))


def phrase_edits_sql(split: bool) -> str:
    """The planted edits from the words alone; ``split``: each operation by itself, moved blocks whole."""
    w = lambda *places: " || ' ' || ".join(f"w[{BLOCK} * b + {p + 1}]" for p in places)
    planted = [
        (2, 3, 2, 3, f"{w(2)} || 's'", w(2)),
        (3, 4, 3, 4, f"{w(3)} || 's'", w(3)),
        *([(6, 7, 6, 6, "'the'", "''"), (7, 8, 6, 6, "'the'", "''")] if split else [(6, 8, 6, 6, "'the the'", "''")]),
        (11, 13, 9, 11, w(10, 9), w(9, 10)),
        (14, 17, 12, 15, w(14, 12, 13), w(12, 13, 14)),
        (19, 20, 17, 18, "'qqq'", w(17)),
        (20, 20, 18, 19, "''", "','"),
    ]
    ending = quoted("'s")
    if split:
        planted += [(21, 22, 20, 21, f"{w(19)} || 's'", w(19)), (22, 22, 21, 22, "''", ending)]
    else:
        planted.append((21, 22, 20, 22, f"{w(19)} || 's'", f"{w(19)} || ' ' || {ending}"))
    rows = ", ".join(
        f"{{'n': {n}, 'o0': {a}, 'o1': {b}, 'c0': {c}, 'c1': {d}, 'o': {o}, 'c': {t}}}"
        for n, (a, b, c, d, o, t) in enumerate(planted)
    )
    step = BLOCK + 2
    endings = " ".join(f"WHEN {p} THEN '{letters}'" for p, letters in UNLIKE.items())
    placed = f"x || (i - 1) || CASE (i - 1) % {BLOCK} {endings} ELSE '' END"
    return f"""
  SELECT sent_id, (b * {len(planted)} + e.n)::INT AS edit_no,
    CASE WHEN e.o = '' THEN 'M' WHEN e.c = '' THEN 'U' ELSE 'R' END AS op,
    e.o AS o_str, (b * {step} + e.o0)::INT AS o_start, (b * {step} + e.o1)::INT AS o_end,
    e.c AS c_str, (b * {step} + e.c0)::INT AS c_start, (b * {step} + e.c1)::INT AS c_end
  FROM (SELECT sent_id, b, unnest([{rows}]) AS e FROM (
    SELECT sent_id, w, unnest(range(len(w) // {BLOCK})) AS b FROM (
      SELECT sent_id, list_transform(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> ''), lambda x, i: {placed}) AS w
      FROM ({LINES_SQL}))))
"""


FEATURES = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("lemma", "pos", "tag")]))


def feature_array(text: Column) -> Column:
    """Part of speech and lemma of each token guessed from its ending, as one array.

    By Arrow batch, once for each distinct token of it.
    """
    return F.when(text.isNotNull(), _guessed.asNondeterministic()(F.lower(text)))


@F.arrow_udf(FEATURES)
def _guessed(texts: pa.Array) -> pa.Array:
    tokens = token_lists(texts)
    coded = tokens.values.dictionary_encode()
    word = coded.dictionary
    ends = {x: pc.ends_with(word, x) for x in ("ing", "ed", "es", "e", "ly", "tion", "n", "t")}
    any_of = lambda *endings: reduce(pc.or_, [ends[x] for x in endings])
    chosen = lambda cases, other: reduce(lambda rest, c: pc.if_else(c[0], c[1], rest), reversed(cases), other)
    pos = chosen([(any_of("ing", "ed"), "VERB"), (ends["ly"], "ADV"), (any_of("es", "e", "tion"), "NOUN"), (any_of("n", "t"), "ADJ")], "X")
    tag = chosen([(ends["ing"], "VBG"), (ends["ed"], "VBD")], "-")
    cut = lambda n: pc.utf8_slice_codeunits(word, 0, -n)
    lemma = chosen([(ends["ing"], cut(3)), (any_of("ed", "es"), cut(2)), (ends["e"], cut(1))], word)
    columns = [x.take(coded.indices) for x in (lemma, pos, tag)]
    return pa.ListArray.from_arrays(tokens.offsets, pa.StructArray.from_arrays(columns, ["lemma", "pos", "tag"]))


# One edit of each category, as (original, corrected, category).
PLANTED = (
    ("dog", "dogs", "NOUN:NUM"), ("doges", "dogs", "NOUN:INFL"), ("dogs", "cats", "NOUN"), ("dog", "dog 's", "NOUN:POSS"),
    ("walk", "walks", "VERB:SVA"), ("walk", "walking", "VERB:FORM"), ("walk", "walked", "VERB:TENSE"),
    ("walkes", "walks", "VERB:INFL"), ("walked", "jumped", "VERB"), ("tall", "taller", "ADJ:FORM"), ("taller", "smaller", "ADJ"),
    ("quick", "quickly", "MORPH"), ("quickly", "slowly", "ADV"), ("the", "a", "DET"), ("in", "on", "PREP"), ("he", "she", "PRON"),
    ("and", "but", "CONJ"), ("to", "not", "PART"), ("'ll", "'ve", "CONTR"), (",", ";", "PUNCT"), ("Dog", "dog", "ORTH"),
    ("cat dog", "dog cat", "WO"), ("teh", "the", "SPELL"), ("hello", "goodbye", "OTHER"), ("dogs", "dogs '", "NOUN:POSS"),
)
# The words of those corrections, so that the vocabulary has them and their families.
FAMILIES = (
    "dog dogs cat cats walk walks walked walking jump jumps jumped jumping tall taller tallest small smaller smallest "
    "quick quickly slow slowly the a in on he she and but to not hello goodbye"
)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one edit each, of all categories in turn; predictions find every third and invent every fourth."""
    which = (F.col("doc_id") * 7 + F.col("sent_id") % 1000) % len(PLANTED)
    pick = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in PLANTED]), (which + 1).cast("int"))
    text = lambda words: F.concat_ws(" ", "line", F.lit(":"), words, F.lit(":"), F.lit(FAMILIES))
    kind = F.col("sent_id") % 1000 % 12
    hyp = F.when(kind % 3 == 0, pick(1)).when(kind % 4 == 1, F.lit("tallest")).otherwise(pick(0))
    return lines(spark, sf_dir).select(
        "sent_id", text(pick(0)).alias("original"), text(pick(1)).alias("corrected"), text(hyp).alias("prediction")
    )


PLANTED_SQL = f"""
  SELECT sent_id, kind, p.o AS o_str, p.c AS c_str, p.t AS category FROM (
    SELECT sent_id, sent_id % 1000 % 12 AS kind,
      [{', '.join(f"{{'o': {quoted(o)}, 'c': {quoted(c)}, 't': {quoted(t)}}}" for o, c, t in PLANTED)}]
        [(doc_id * 7 + sent_id % 1000) % {len(PLANTED)} + 1] AS p
    FROM ({LINES_SQL}))
"""

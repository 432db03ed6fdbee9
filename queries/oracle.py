"""SQL counterparts of the registered queries.

The edit queries do not align anything here: the fixtures plant known changes,
so the SQL marks them in the text (``before⇒after``) and reads off the edits
with windows. Spark has to find the same edits from the two texts alone.
"""

from __future__ import annotations

from queries import fixtures as X
from queries.catalog import N_EVAL, SEED, VOCABULARY_MIN
from redpen.functions.text import TOKEN_SPELLINGS, TOKENIZE_REPAIRS
from redpen.operators.classify import (
    CLOSED_CLASSES,
    CONTRACTIONS,
    INFLECTIONS,
    POSSESSIVES,
    PUNCTUATION,
)

q = X.quoted

# The Unicode whitespace characters as a regular expression.
WS_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_SET}]"


def replaced(expr: str, changes) -> str:
    return X._sql_replace(expr, changes)


def tokenize(expr: str) -> str:
    return replaced(expr, [(b, a) for a, b in TOKEN_SPELLINGS] + list(TOKENIZE_REPAIRS))


def detokenize(expr: str) -> str:
    return replaced(expr, TOKEN_SPELLINGS)


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{WS}+', ''), '{WS}+\\z', '')"


def normalize(expr: str) -> str:
    return strip(f"replace(replace({expr}, chr(10), ' '), '  ', ' ')")


def tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[^{WS_SET}]+')"


def listed(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


# ---------------------------------------------------------------- planted edits

ARROW = "⇒"


def _marked(changes, of: str, and_: str | None) -> str:
    """The line with its planted changes marked, then tokenized."""
    expr = f"CASE WHEN contains(line, ' and ') THEN line ELSE replace(line, ' of ', ' of {of} ') END"
    expr = replaced(expr, changes)
    if and_:
        expr = f"CASE WHEN contains(line, ' and ') THEN replace({expr}, ' and ', ' and {and_} ') ELSE {expr} END"
    return f"SELECT sent_id, {tokenize(expr)} AS marked FROM ({X.LINES_SQL})"


_FIXED = [(clean, f" {bad.strip()}{ARROW}{clean.strip()} ") for clean, bad in X.MISSPELLED]
GOLD = _marked(_FIXED + [(" to ", f" too{ARROW}to ")], f"very{ARROW}", f"{ARROW}also")
HYP = _marked(_FIXED + [(" to ", " too "), (" in ", f" in{ARROW}on ")], f"very{ARROW}", f"{ARROW}quite")
CHECKED = _marked(
    [(" the ", f" teh{ARROW}the "), (" de ", " ed "), (" der ", " dre "), (" to ", " too ")], f"very{ARROW}", None
)

_REPAIRED = [(" the ", f" teh{ARROW}the "), (" de ", " ed "), (" der ", " dre ")]
CHECKED_DOCUMENTS = f"SELECT doc_id AS sent_id, {tokenize(replaced('text', _REPAIRED))} AS marked FROM documents"


def marks(marked: str) -> str:
    """Tokens with both sides and their positions: sent_id, k, o, c, ch, o_at, c_at."""
    return f"""
      SELECT *, sum((o <> '')::INT) OVER w - (o <> '')::INT AS o_at,
             sum((c <> '')::INT) OVER w - (c <> '')::INT AS c_at
      FROM (SELECT sent_id, k, contains(tok, '{ARROW}') AS ch,
                   split_part(tok, '{ARROW}', 1) AS o,
                   CASE WHEN contains(tok, '{ARROW}') THEN split_part(tok, '{ARROW}', 2) ELSE tok END AS c
            FROM (SELECT sent_id, unnest(list) AS tok, generate_subscripts(list, 1) AS k
                  FROM (SELECT sent_id, {tokens('marked')} AS list FROM ({marked}))))
      WINDOW w AS (PARTITION BY sent_id ORDER BY k)
    """


def edits(marked: str, merge: str = "all-merge") -> str:
    """sent_id, edit_no, op, o_str, o_start, o_end, c_str, c_start, c_end."""
    op = "CASE WHEN o = '' THEN 'M' WHEN c = '' THEN 'U' ELSE 'R' END"
    run = {
        "all-merge": "k - row_number() OVER (PARTITION BY sent_id ORDER BY k)",
        "all-equal": f"struct_pack(a := {op}, b := k - row_number() OVER (PARTITION BY sent_id, {op} ORDER BY k))",
        "all-split": "k",
    }[merge]
    return f"""
      SELECT sent_id, (row_number() OVER (PARTITION BY sent_id ORDER BY k0) - 1)::INT AS edit_no,
             CASE WHEN o_str = '' THEN 'M' WHEN c_str = '' THEN 'U' ELSE 'R' END AS op,
             o_str, o_start::INT AS o_start, o_end::INT AS o_end, c_str, c_start::INT AS c_start, c_end::INT AS c_end
      FROM (SELECT sent_id, run, min(k) AS k0,
                   coalesce(string_agg(nullif(o, ''), ' ' ORDER BY k), '') AS o_str,
                   coalesce(string_agg(nullif(c, ''), ' ' ORDER BY k), '') AS c_str,
                   min(o_at) AS o_start, max(o_at + (o <> '')::INT) AS o_end,
                   min(c_at) AS c_start, max(c_at + (c <> '')::INT) AS c_end
            FROM (SELECT *, {run} AS run FROM ({marks(marked)}) WHERE ch)
            GROUP BY sent_id, run)
    """


def category(o: str, c: str, known: str | None = None, by_pos: str | None = None) -> str:
    def all_in(words, names):
        return f"len(list_filter({words}, lambda w: NOT list_contains({listed(names)}, w))) = 0"

    both = f"({o} <> '' AND {c} <> '')"
    words = f"list_filter(list_concat(string_split(lower({o}), ' '), string_split(lower({c}), ' ')), lambda w: w <> '')"
    squash = lambda x: f"replace(lower({x}), ' ', '')"
    bag = lambda x: f"list_sort(string_split(lower({x}), ' '))"
    one = f"NOT contains({o}, ' ')"
    rules = [
        f"WHEN {both} AND {squash(o)} = {squash(c)} THEN 'ORTH'",
        f"WHEN {all_in(words, POSSESSIVES)} THEN 'NOUN:POSS'",
        f"WHEN regexp_matches({o} || ' ' || {c}, {q(PUNCTUATION)}) THEN 'PUNCT'",
        f"WHEN {both} AND contains({o}, ' ') AND {bag(o)} = {bag(c)} THEN 'WO'",
        f"WHEN {all_in(words, CONTRACTIONS)} THEN 'CONTR'",
    ]
    if by_pos:
        rules.append(f"WHEN {by_pos} IN ({', '.join(q(x) for x in INFLECTIONS)}) THEN {by_pos}")
    if known:
        rules.append(f"WHEN {both} AND {one} AND regexp_matches({o}, '[A-Za-z]') AND NOT ({known}) THEN 'SPELL'")
    rules += [f"WHEN {all_in(words, names)} THEN {q(name)}" for name, names in CLOSED_CLASSES.items()]
    return f"CASE {' '.join(rules)} ELSE {f'coalesce({by_pos}, ' + q('OTHER') + ')' if by_pos else q('OTHER')} END"


VOCABULARY = f"""
  SELECT word, count(*) AS n
  FROM (SELECT unnest({tokens("lower(" + tokenize("target_text") + ")")}) AS word FROM ({X.PAIRS_SQL}))
  GROUP BY word HAVING count(*) >= {VOCABULARY_MIN}
"""


def typed(marked: str) -> str:
    return f"SELECT *, op || ':' || category AS type FROM (SELECT *, {category('o_str', 'c_str')} AS category FROM ({edits(marked)}))"


def spelled(marked: str, words: str = VOCABULARY) -> str:
    known = "word IS NOT NULL OR op <> 'R' OR contains(o_str, ' ')"
    return f"""
      SELECT *, op || ':' || category AS type
      FROM (SELECT e.*, {category('o_str', 'c_str', known)} AS category
            FROM ({edits(marked)}) e LEFT JOIN ({words}) v ON lower(e.o_str) = v.word)
    """


def flags(gold: str, hyp: str, key: str, keep: tuple[str, ...] = ()) -> str:
    kept = "".join(f", coalesce(g.{c}, h.{c}) AS {c}" for c in keep)
    dedup = lambda side: f"(SELECT {key}{''.join(f', max({c}) AS {c}' for c in keep)} FROM ({side}) GROUP BY {key})"
    first = key.split(", ")[1]
    return f"""
      SELECT {key}{kept},
             (g.sent_id IS NOT NULL AND h.sent_id IS NOT NULL)::INT AS tp,
             (g.sent_id IS NULL)::INT AS fp, (h.sent_id IS NULL)::INT AS fn
      FROM {dedup(gold)} g FULL JOIN {dedup(hyp)} h USING ({key})
    """


SPAN = "sent_id, o_start, o_end, c_str"
SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"
P = "(CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END)"
R = "(CASE WHEN fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END)"


def f_beta(beta: float) -> str:
    b2 = beta * beta
    return f"(CASE WHEN {P} > 0 THEN {1 + b2}::DOUBLE * ({P} * {R}) / ({b2}::DOUBLE * {P} + {R}) ELSE 0.0::DOUBLE END)"


def scored(counts: str, columns: str = "", digits: int | None = None) -> str:
    r = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    return f"SELECT {columns} tp, fp, fn, {r(P)} AS p, {r(R)} AS r, {r(f_beta(0.5))} AS f05 FROM ({counts})"


def keyed(side: str) -> str:
    return f"SELECT *, o_start || ' ' || o_end || '|||' || type || '|||' || c_str AS edit_key FROM ({typed(side)})"


FLAGS = flags(edits(GOLD), edits(HYP), SPAN, ("op", "o_str"))
STRICT_FLAGS = flags(keyed(GOLD), keyed(HYP), "sent_id, edit_key")


def by_category(rows: str) -> str:
    return scored(f"SELECT category, {SUMS} FROM ({rows}) GROUP BY ROLLUP (category)", "category,", 4)


def spelled_flags(words: str = VOCABULARY) -> str:
    known = "word IS NOT NULL OR op <> 'R' OR contains(o_str, ' ')"
    return f"""
      SELECT {category('o_str', 'c_str', known)} AS category, tp, fp, fn
      FROM ({FLAGS}) f LEFT JOIN ({words}) v ON lower(f.o_str) = v.word
    """


REPORT = by_category(spelled_flags())

# ---------------------------------------------------------------- corpora

LEFT, RIGHT = "chr(9) || chr(160) || ' '", "' ' || chr(8195) || chr(10) || chr(12288)"
RAW_TOKENIZED = f"""
  SELECT sent_id, {LEFT} || {tokenize('input_text')} AS original,
    CASE WHEN contains(target_text, ' on ') THEN {RIGHT} ELSE {tokenize('target_text')} || {RIGHT} END AS corrected
  FROM ({X.PAIRS_SQL})
"""
CLEAN = f"""
  SELECT * FROM (SELECT sent_id, {strip('original')} AS original, {strip('corrected')} AS corrected FROM ({RAW_TOKENIZED}))
  WHERE corrected <> '' AND original <> corrected
"""
REFS = f"""
  SELECT (sent_id << 20) + i - 1 AS sent_id, sentence AS original, corrections[i] AS corrected
  FROM (SELECT *, unnest(range(1, len(corrections) + 1)) AS i FROM ({X.MULTI_REFS_SQL}))
"""


def canonical(source: str, rows: str, i: str, t: str, o: str, c: str) -> str:
    return (
        f"SELECT sent_id, {q(source)} AS source, {i} AS input_text, {t} AS target_text, "
        f"{o} AS original, {c} AS corrected FROM ({rows})"
    )


def detokenized(source: str, rows: str) -> str:
    return canonical(source, rows, detokenize("original"), detokenize("corrected"), "original", "corrected")


MERLIN = detokenized("merlin", CLEAN)
PIE = detokenized("pie", RAW_TOKENIZED)
JFLEG = detokenized(
    "jfleg",
    f"SELECT * FROM (SELECT sent_id, {strip('original')} AS original, {strip('corrected')} AS corrected FROM ({REFS})) "
    "WHERE corrected <> '' AND original <> corrected",
)
C4 = canonical(
    "c4_200m", X.PAIRS_SQL, "input_text", "target_text", tokenize("input_text"), tokenize("target_text")
)
CHAR_EDITED = f"""
  SELECT sent_id, text, CASE WHEN len(edits) = 0 THEN text ELSE
      replace(fold.out || substr(text, fold.pos + 1), '  ', ' ') END AS corrected
  FROM (SELECT sent_id, text, edits, list_reduce(
          list_transform(edits, lambda x: {{'out': '', 'pos': 0, 's': x.s::BIGINT, 'e': x.e::BIGINT, 't': x.t}}),
          lambda acc, x: {{
            'out': acc.out || CASE WHEN x.s > acc.pos THEN substr(text, acc.pos + 1, x.s - acc.pos) ELSE '' END || coalesce(x.t, ''),
            'pos': x.e, 's': x.s, 'e': x.e, 't': x.t}},
          {{'out': '', 'pos': 0::BIGINT, 's': 0::BIGINT, 'e': 0::BIGINT, 't': ''}}) AS fold
        FROM ({X.CHAR_EDITS_SQL}))
"""
WI = canonical(
    "wi",
    f"SELECT sent_id, {normalize('text')} AS i, {normalize('corrected')} AS t FROM ({CHAR_EDITED})",
    "i", "t", tokenize("i"), tokenize("t"),
)

SHUFFLE = f"md5('{SEED}:' || sent_id)"
RANKED = f"SELECT *, row_number() OVER (ORDER BY {SHUFFLE}, sent_id) AS place FROM ({JFLEG})"
COLUMNS = "sent_id, source, input_text, target_text, original, corrected"
TAIL = f"SELECT {COLUMNS} FROM ({RANKED}) WHERE place > {N_EVAL + 1}"
STACK = f"SELECT 'train' AS split, * FROM ({JFLEG}) UNION ALL SELECT 'train', * FROM ({C4}) UNION ALL SELECT 'test', * FROM ({MERLIN})"


def numbered(rows: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY sent_id) - 1 AS line_no FROM ({rows})"


# ---------------------------------------------------------------- prediction and display


def repaired(expr: str) -> str:
    return replaced(expr, [(" teh ", " the "), (" very ", " ")])


LEXICON = f"""
  SELECT o_str, c_str, n FROM (
    SELECT o_str, c_str, count(*) AS n, row_number() OVER (PARTITION BY o_str ORDER BY count(*) DESC, c_str DESC) AS rank
    FROM ({edits(GOLD, 'all-split')}) WHERE o_str <> '' GROUP BY o_str, c_str HAVING count(*) >= 2)
  WHERE rank = 1
"""


def lexicon_applied(rows: str, lexicon: str) -> str:
    """(sent_id, prediction) of rows (sent_id, original)."""
    return f"""
      SELECT sent_id, string_agg(nullif(coalesce(l.c_str, tok), ''), ' ' ORDER BY k) AS prediction
      FROM (SELECT sent_id, unnest(list) AS tok, generate_subscripts(list, 1) AS k
            FROM (SELECT sent_id, {tokens('original')} AS list FROM ({rows}))) t
      LEFT JOIN (SELECT * FROM ({lexicon}) WHERE NOT contains(o_str, ' ')) l ON t.tok = l.o_str
      GROUP BY sent_id
    """


def pieces(marked: str) -> str:
    """Tagged pieces and the plain tokens around them.

    (sent_id, g, tag, type, edit, text): row ``g`` is the g-th edit, or with a
    null tag the plain words before it. An insertion takes the word before it.
    """
    tagged = f"""
      SELECT e.*, (row_number() OVER (PARTITION BY e.sent_id ORDER BY e.o_start, e.c_start) - 1) AS g,
             CASE WHEN o_str = '' THEN o_start - 1 ELSE o_start END AS a,
             CASE WHEN o_str = '' THEN o_start ELSE o_end END AS b
      FROM ({typed(marked)}) e"""
    return f"""
      WITH t AS ({marks(marked)}), e AS ({tagged}),
      w AS (SELECT sent_id, o_at, o FROM t WHERE o <> ''),
      x AS (SELECT e.sent_id, g, CASE WHEN o_str = '' THEN 'a' WHEN c_str = '' THEN 'd' ELSE 'c' END AS tag,
                   category AS type,
                   CASE WHEN o_str = '' THEN CASE WHEN category = 'PUNCT' THEN c_str ELSE w.o || ' ' || c_str END ELSE c_str END AS edit,
                   CASE WHEN o_str = '' THEN w.o ELSE o_str END AS text, a, b
            FROM e LEFT JOIN w ON w.sent_id = e.sent_id AND w.o_at = e.a AND e.o_str = ''),
      spots AS (SELECT sent_id, g, coalesce(lag(b) OVER (PARTITION BY sent_id ORDER BY g), 0) AS lo, a AS hi FROM x
                UNION ALL
                SELECT s.sent_id, coalesce(max(g) + 1, 0), coalesce(max(b), 0), 1000000000
                FROM (SELECT DISTINCT sent_id FROM t) s LEFT JOIN x USING (sent_id) GROUP BY s.sent_id),
      plain AS (SELECT p.sent_id, p.g, p.hi, string_agg(w.o, ' ' ORDER BY w.o_at) AS words
                FROM spots p LEFT JOIN w ON w.sent_id = p.sent_id AND w.o_at >= p.lo AND w.o_at < p.hi
                GROUP BY p.sent_id, p.g, p.hi)
      SELECT sent_id, g, tag, type, edit, text FROM x
      UNION ALL
      SELECT sent_id, g, NULL, NULL, NULL,
             CASE WHEN words IS NULL THEN CASE WHEN g > 0 AND hi < 1000000000 THEN ' ' ELSE '' END
                  ELSE CASE WHEN g > 0 THEN ' ' ELSE '' END || words || CASE WHEN hi < 1000000000 THEN ' ' ELSE '' END END
      FROM plain
    """


def markup(marked: str) -> str:
    tag = "'<' || tag || ' type=''' || type || ''' edit=''' || edit || '''>' || text || '</' || tag || '>'"
    return f"""
      SELECT sent_id, string_agg(CASE WHEN tag IS NULL THEN text ELSE {tag} END, '' ORDER BY g, tag NULLS FIRST) AS markup
      FROM ({pieces(marked)}) GROUP BY sent_id
    """


STRUCK = "array_to_string(string_split({0}, ''), chr(822)) || chr(822)"
SEGMENTS = f"""
  SELECT sent_id, (2 * g + (tag IS NOT NULL)::INT)::INT AS seg_no,
         CASE WHEN tag IS NULL THEN text WHEN tag = 'd' THEN {STRUCK.format('text')} ELSE edit END AS text,
         type, CASE tag WHEN 'd' THEN '#faa' WHEN 'a' THEN '#afa' WHEN 'c' THEN '#fea' END AS color
  FROM ({pieces(GOLD)})
"""

# ---------------------------------------------------------------- word features


def _featured() -> str:
    """Position-wise edits of the swapped endings, with features of each token."""
    word = "lower(tok)"
    ends = lambda *s: f"regexp_matches({word}, '({'|'.join(s)})$')"
    pos = (
        f"CASE WHEN {ends('ing', 'ed')} THEN 'VERB' WHEN {ends('ly')} THEN 'ADV' "
        f"WHEN {ends('es', 'e', 'tion')} THEN 'NOUN' WHEN {ends('n', 't')} THEN 'ADJ' ELSE 'X' END"
    )
    tag = f"CASE WHEN {ends('ing')} THEN 'VBG' WHEN {ends('ed')} THEN 'VBD' ELSE '-' END"
    lemma = f"regexp_replace({word}, '(ing|ed|es|e)$', '')"
    side = lambda c: f"""
      SELECT sent_id, k, tok, {pos} AS pos, {tag} AS tag, {lemma} AS lemma
      FROM (SELECT sent_id, unnest(list) AS tok, generate_subscripts(list, 1) - 1 AS k
            FROM (SELECT sent_id, {tokens(tokenize(c))} AS list FROM ({X.INFLECTED_SQL})))"""
    words = f"""
      SELECT word FROM (SELECT unnest({tokens("lower(" + tokenize("line") + ")")}) AS word FROM ({X.LINES_SQL}))
      GROUP BY word HAVING count(*) >= {VOCABULARY_MIN}"""
    class_of = "CASE {0} WHEN 'VERB' THEN 'VERB' WHEN 'ADV' THEN 'ADV' WHEN 'NOUN' THEN 'NOUN' WHEN 'ADJ' THEN 'ADJ' ELSE 'OTHER' END"
    known = "(word IS NOT NULL OR contains(o_str, ' '))"
    by_pos = f"""CASE
      WHEN n = 1 AND same_lemma AND poss = ['NOUN'] THEN CASE WHEN NOT {known} THEN 'NOUN:INFL' ELSE 'NOUN:NUM' END
      WHEN n = 1 AND same_lemma AND poss = ['VERB'] THEN CASE WHEN NOT {known} THEN 'VERB:INFL' WHEN has_g THEN 'VERB:FORM' WHEN has_d THEN 'VERB:TENSE' ELSE 'VERB:FORM' END
      WHEN n = 1 AND same_lemma AND poss = ['ADJ'] THEN 'ADJ:FORM'
      WHEN n = 1 AND same_lemma AND len(classes) > 1 THEN 'MORPH'
      WHEN len(classes) = 1 THEN classes[1] END"""
    return f"""
      WITH d AS (
        SELECT o.sent_id, o.k, o.tok AS o, c.tok AS c, o.pos AS o_pos, c.pos AS c_pos,
               o.lemma = c.lemma AS same_lemma, o.tag = 'VBG' OR c.tag = 'VBG' AS g, o.tag = 'VBD' OR c.tag = 'VBD' AS d,
               o.k - row_number() OVER (PARTITION BY o.sent_id ORDER BY o.k) AS run
        FROM ({side('input_text')}) o JOIN ({side('target_text')}) c USING (sent_id, k) WHERE o.tok <> c.tok),
      e AS (
        SELECT sent_id, min(k)::INT AS o_start, string_agg(o, ' ' ORDER BY k) AS o_str, string_agg(c, ' ' ORDER BY k) AS c_str,
               count(*) AS n, bool_and(same_lemma) AS same_lemma, bool_or(g) AS has_g, bool_or(d) AS has_d,
               list_distinct(list_concat(list(o_pos), list(c_pos))) AS poss,
               list_distinct(list_concat(list({class_of.format('o_pos')}), list({class_of.format('c_pos')}))) AS classes
        FROM d GROUP BY sent_id, run),
      f AS (SELECT e.*, word, {by_pos} AS by_pos FROM e LEFT JOIN ({words}) v ON lower(o_str) = word)
      SELECT sent_id, o_start, o_str, c_str, 'R:' || {category('o_str', 'c_str', known, 'by_pos')} AS type FROM f
    """


# What a prediction of the word "tallest" counts as against each original.
_invented = """CASE
  WHEN o_str IN ('tall', 'taller') THEN 'ADJ:FORM' WHEN o_str = 'quick' THEN 'ADJ'
  WHEN o_str IN ('walkes', 'doges', 'teh', '''ll') THEN 'SPELL' ELSE 'OTHER' END"""

#: Kinds 0, 3, 6 and 9 are found; 1 and 5 are something else: a miss and an invention; all others are missed.
PLANTED_REPORT = by_category(f"""
  SELECT category, (kind % 3 = 0)::INT AS tp, 0 AS fp, (kind % 3 <> 0)::INT AS fn FROM ({X.PLANTED_SQL})
  UNION ALL
  SELECT {_invented}, 0, 1, 0 FROM ({X.PLANTED_SQL}) WHERE kind % 3 <> 0 AND kind % 4 = 1
""")


EDIT_COLUMNS = "sent_id, edit_no, op, o_str, o_start, o_end, c_str, c_start, c_end"
M2_ROWS = f"""
  SELECT sent_id - 0 AS sent_id, edit_no, o_start, o_end, type, c_str, category FROM (
    SELECT l.line_no AS sent_id, coalesce(edit_no, 0) AS edit_no, coalesce(o_start, -1) AS o_start,
           coalesce(o_end, -1) AS o_end, coalesce(type, 'noop') AS type, coalesce(c_str, '-NONE-') AS c_str,
           coalesce(category, 'noop') AS category
    FROM ({numbered(X.LINES_SQL)}) l LEFT JOIN ({typed(GOLD)}) e ON l.sent_id = e.sent_id)
"""

COMPARED = by_category(f"SELECT * FROM ({flags(spelled(GOLD), spelled(HYP), SPAN, ('category',))})")

STRICT = "sent_id, edit_key"
#: What a sentence without gold edits has in the M2 file.
NO_EDIT = f"""
  SELECT sent_id, '-1 -1|||noop|||-NONE-' AS edit_key FROM ({X.LINES_SQL})
  WHERE sent_id NOT IN (SELECT sent_id FROM ({edits(GOLD)}))
"""


def strict(marked: str) -> str:
    return f"SELECT sent_id, o_start || ' ' || o_end || '|||' || type || '|||' || c_str AS edit_key FROM ({spelled(marked)})"


def _chain() -> str:
    """Train on the tail of the pool, apply the counted corrections to the test part."""
    pool = f"SELECT *, row_number() OVER (ORDER BY {SHUFFLE}, sent_id) AS place FROM ({C4})"
    train = f"SELECT sent_id, corrected FROM ({pool}) WHERE place > {N_EVAL + 1}"
    words = f"""
      SELECT word FROM (SELECT unnest({tokens('lower(corrected)')}) AS word FROM ({train}))
      GROUP BY word HAVING count(*) >= {VOCABULARY_MIN}"""
    lexicon = LEXICON.replace("WHERE o_str <> ''", f"WHERE o_str <> '' AND sent_id IN (SELECT sent_id FROM ({train}))")
    hyp = f"""
      SELECT sent_id, string_agg(CASE WHEN l.o_str IS NULL THEN tok ELSE tok || '{ARROW}' || c_str END, ' ' ORDER BY k) AS marked
      FROM (SELECT sent_id, unnest(list) AS tok, generate_subscripts(list, 1) AS k
            FROM (SELECT sent_id, {tokens('original')} AS list FROM ({CLEAN}))) t
      LEFT JOIN (SELECT * FROM ({lexicon}) WHERE NOT contains(o_str, ' ')) l ON tok = l.o_str
      GROUP BY sent_id"""
    gold = f"SELECT * FROM ({GOLD}) WHERE sent_id IN (SELECT sent_id FROM ({CLEAN}))"
    known = "word IS NOT NULL OR op <> 'R' OR contains(o_str, ' ')"
    return by_category(f"""
      SELECT {category('o_str', 'c_str', known)} AS category, tp, fp, fn
      FROM ({flags(edits(gold), edits(hyp), SPAN, ('op', 'o_str'))}) f LEFT JOIN ({words}) v ON lower(f.o_str) = v.word""")


_key = "length(line) || ' ' || (length(line) + 1) || '|||R:' || source || '|||' || line"

ORACLE = {
    "tokenize": f"SELECT sent_id, {tokenize('text')} AS tokenized FROM ({X.CLITICS_SQL})",
    "detokenize": f"SELECT sent_id, {detokenize(tokenize('text'))} AS detokenized FROM ({X.CLITICS_SQL})",
    "normalize_ws": f"SELECT doc_id, {normalize('text')} AS clean FROM ({X.PADDED_SQL})",
    "strip": f"SELECT doc_id, {strip('text')} AS stripped FROM ({X.PADDED_SQL})",
    "split_tokens": f"SELECT doc_id, len(l)::INT AS n_tokens, array_to_string(l, '_') AS joined FROM (SELECT doc_id, {tokens('text')} AS l FROM ({X.PADDED_SQL}))",
    "literal_replace": "SELECT doc_id, replace(text, chr(10), ' ') AS one_line FROM documents",
    "strikeout": f"SELECT conv_id, turn, {STRUCK.format('text')} AS struck FROM conversations",
    "task_prefix": f"SELECT sent_id, 'Grammar: ' || input_text AS model_input FROM ({X.PAIRS_SQL})",
    "training_frame": f"SELECT 'Grammar' AS prefix, input_text, target_text FROM ({X.PAIRS_SQL})",
    "edit_key_fields": f"""
      SELECT sent_id, array_to_string(f, '|||') AS edit_key, length(line)::INT AS o_start,
             (length(line) + 1)::INT AS o_end, source AS category, f[3] AS c_str
      FROM (SELECT *, string_split({_key} || '|||REQUIRED|||-NONE-|||0', '|||')[1:3] AS f FROM ({X.LINES_SQL}))""",
    "explode_refs": REFS,
    "clean_pairs": CLEAN,
    "merlin_like": MERLIN,
    "pie_like": PIE,
    "c4_like": C4,
    "jfleg_like": JFLEG,
    "wi_like": WI,
    "locness_like": WI.replace("'wi'", "'locness'"),
    "batch_columns": f"""
      SELECT sent_id, gap, CASE WHEN gap > 0 THEN target_text ELSE input_text END AS longer
      FROM (SELECT *, (length(target_text) - length(input_text))::INT AS gap FROM ({X.PAIRS_SQL}))""",
    "apply_char_edits": f"SELECT sent_id, corrected FROM ({CHAR_EDITED})",
    "canonical_union": STACK,
    "seeded_shuffle_topn": f"SELECT sent_id, input_text, target_text FROM ({C4}) ORDER BY {SHUFFLE}, sent_id LIMIT {N_EVAL}",
    "seeded_sample": f"SELECT sent_id, line FROM ({X.LINES_SQL}) ORDER BY {SHUFFLE}, sent_id LIMIT 10",
    "prefix_take": f"SELECT sent_id, input_text AS input, target_text AS output FROM ({X.PAIRS_SQL}) ORDER BY sent_id LIMIT 2000",
    "prepare_train": f"""
      SELECT * REPLACE (2 * sent_id AS sent_id) FROM ({TAIL})
      UNION ALL SELECT * REPLACE (2 * sent_id + 1 AS sent_id) FROM ({C4})""",
    "prepare_eval": f"SELECT {COLUMNS} FROM ({RANKED}) WHERE place <= {N_EVAL}",
    "prepare_test": MERLIN,
    "token_distance": f"SELECT sent_id, sum(ch::INT)::INT AS distance FROM ({marks(GOLD)}) GROUP BY sent_id",
    "extract_edits": f"SELECT {EDIT_COLUMNS} FROM ({edits(GOLD)})",
    "extract_edits_split": f"SELECT {EDIT_COLUMNS} FROM ({edits(GOLD, 'all-split')})",
    "extract_edits_equal": f"SELECT {EDIT_COLUMNS} FROM ({edits(GOLD, 'all-equal')})",
    "extract_edits_likeness": X.phrase_edits_sql(split=True),
    "extract_edits_rules": X.phrase_edits_sql(split=False),
    "edit_ops_count": f"SELECT op, count(*) AS n FROM ({edits(GOLD)}) GROUP BY op",
    "edits_roundtrip": f"SELECT sent_id, array_to_string({tokens(tokenize('hyp_text'))}, ' ') AS rebuilt FROM ({X.PAIRS_SQL})",
    "single_span_edit": f"""
      SELECT m.sent_id, min(o_at) FILTER (ch)::INT AS o_start, max(o_at + (o <> '')::INT) FILTER (ch)::INT AS o_end,
             coalesce(string_agg(nullif(o, ''), ' ' ORDER BY k) FILTER (k BETWEEN lo AND hi), '') AS o_str,
             coalesce(string_agg(nullif(c, ''), ' ' ORDER BY k) FILTER (k BETWEEN lo AND hi), '') AS c_str
      FROM ({marks(GOLD)}) m
      JOIN (SELECT sent_id, min(k) AS lo, max(k) AS hi FROM ({marks(GOLD)}) WHERE ch GROUP BY sent_id) b USING (sent_id)
      GROUP BY m.sent_id""",
    "collect_edits": f"""
      SELECT sent_id, string_agg(o_start || '|' || o_end || '|' || c_str, ' ; ' ORDER BY edit_no) AS edits
      FROM ({edits(GOLD)}) GROUP BY sent_id""",
    "build_vocabulary": VOCABULARY,
    "classify_edits": f"SELECT sent_id, edit_no, type, category, o_str, c_str FROM ({spelled(GOLD)})",
    "classify_edits_features": _featured(),
    "classify_edits_families": f"""
      SELECT sent_id, category, CASE WHEN o IS NULL THEN 'R' ELSE 'M' END AS op, coalesce(o, o_str) AS o_str, coalesce(c, c_str) AS c_str
      FROM (SELECT *, CASE WHEN starts_with(c_str, o_str || ' ') THEN '' END AS o,
                   CASE WHEN starts_with(c_str, o_str || ' ') THEN substr(c_str, length(o_str) + 2) END AS c FROM ({X.PLANTED_SQL}))""",
    "score_by_families": PLANTED_REPORT,
    "show_edits": f"SELECT sent_id, category AS type, o_str, o_start, o_end, c_str, c_start, c_end FROM ({typed(GOLD)})",
    "score_strict": scored(f"SELECT {SUMS} FROM ({STRICT_FLAGS})"),
    "score_span": scored(f"SELECT {SUMS} FROM ({FLAGS})"),
    "score_by_category": REPORT,
    "match_flags": FLAGS,
    "sentence_counts": f"SELECT sent_id, {SUMS} FROM ({FLAGS}) GROUP BY sent_id",
    "sentence_set_counts": f"SELECT sent_id, {SUMS} FROM ({STRICT_FLAGS}) GROUP BY sent_id",
    "evaluate_metrics": f"""
      WITH c AS (SELECT {SUMS} FROM ({FLAGS}))
      SELECT 'p' AS metric, {P} AS value FROM c UNION ALL SELECT 'r', {R} FROM c
      UNION ALL SELECT 'f05', {f_beta(0.5)} FROM c UNION ALL SELECT 'f1', {f_beta(1.0)} FROM c""",
    "zip_on_id": f"SELECT sent_id, target_text, hyp_text FROM ({X.PAIRS_SQL})",
    "row_counts": f"SELECT 'lines' AS name, count(*) AS n FROM ({X.LINES_SQL}) UNION ALL SELECT 'documents', count(*) FROM documents",
    "predict_unique": f"SELECT sent_id, {tokenize(repaired('input_text'))} AS prediction FROM ({X.PAIRS_SQL})",
    "unique_inputs": f"SELECT DISTINCT input_text FROM ({X.PAIRS_SQL})",
    "fit_lexicon": LEXICON,
    "predict_lexicon": lexicon_applied(f"SELECT sent_id, {tokenize('hyp_text')} AS original FROM ({X.PAIRS_SQL})", LEXICON),
    "predict_phrases": f"""
      SELECT sent_id, replace(replace(replace(array_to_string({tokens('t')}, ' '),
        ' : cat dog : ', ' : dog cat : '), ' : teh : ', ' : the : '), ' : doges : ', ' : dogs : ') AS prediction
      FROM (SELECT sent_id, line || ' : ' || p.o || ' : ' || {q(X.FAMILIES)} AS t FROM (
        SELECT sent_id, line, [{', '.join(f"{{'o': {q(o)}}}" for o, _, _ in X.PLANTED)}][(doc_id * 7 + sent_id % 1000) % {len(X.PLANTED)} + 1] AS p
        FROM ({X.LINES_SQL})))""",
    "highlight": markup(GOLD),
    "highlight_compat": markup(GOLD),
    "highlight_segments": SEGMENTS,
    "markup_segments": SEGMENTS,
    "check": f"""
      SELECT p.sent_id, input_text, {repaired('input_text')} AS output_text, markup
      FROM ({X.PAIRS_SQL}) p JOIN ({markup(CHECKED)}) m USING (sent_id)""",
    "check_stream": f"""
      SELECT doc_id AS sent_id, {repaired(replaced('text', X.MISSPELLED))} AS output_text, coalesce(markup, '') AS markup
      FROM documents LEFT JOIN ({markup(CHECKED_DOCUMENTS)}) ON doc_id = sent_id""",
    "tag_stream": f"""
      SELECT conv_id * 1000 + turn AS sent_id, {tokenize(repaired(replaced('text', X.MISSPELLED)))} AS prediction
      FROM conversations""",
    "csv_roundtrip": f"""SELECT doc_id AS sent_id, ' "a, b" ' || text || '\\ "' AS input_text, '' AS target_text FROM ({X.PADDED_SQL})""",
    "text_roundtrip": f"SELECT line_no AS sent_id, original, corrected FROM ({numbered(MERLIN)})",
    "predictions_file": f"SELECT line_no AS sent_id, {strip('hyp_text')} AS text FROM ({numbered(X.PAIRS_SQL)})",
    "evaluation_files": f"""
      SELECT line_no AS sent_id, {strip('target_text')} AS targets, {strip('hyp_text')} AS predictions FROM ({numbered(X.PAIRS_SQL)})""",
    "split_files": f"""
      SELECT 'train' AS part, input_text, target_text FROM ({C4})
      UNION ALL SELECT 'test', input_text, target_text FROM ({MERLIN})
      UNION ALL SELECT 'text', original, corrected FROM ({MERLIN})""",
    "json_lines_source": detokenized(
        "merlin",
        f"SELECT * FROM (SELECT line_no AS sent_id, {strip('original')} AS original, {strip('corrected')} AS corrected "
        f"FROM ({numbered(RAW_TOKENIZED)})) WHERE corrected <> '' AND original <> corrected",
    ),
    "partitioned_split": MERLIN,
    "m2_roundtrip": M2_ROWS,
    "m2_sentences": f"""
      SELECT line_no AS sent_id, {strip(tokenize('input_text'))} AS sentence, greatest(n, 1)::INT AS n_edits
      FROM ({numbered(X.PAIRS_SQL)})
      LEFT JOIN (SELECT sent_id, count(*) AS n FROM ({edits(GOLD)}) GROUP BY sent_id) USING (sent_id)""",
    "m2_line_ends": M2_ROWS,
    "compare_files": COMPARED,
    "evaluate_files": scored(f"SELECT {SUMS} FROM ({flags(strict(GOLD), strict(HYP), STRICT)})"),
    "evaluate_files_noop": scored(f"SELECT {SUMS} FROM ({flags(f'{strict(GOLD)} UNION ALL {NO_EDIT}', strict(HYP), STRICT)})"),
    "stage_chain": _chain(),
    "results_json": REPORT,
    "run_log": f"""
      SELECT 'run-1' AS run_id, '8' AS batch_size, line_no AS sent_id, {strip('hyp_text')} AS text, tp, fp, fn
      FROM ({numbered(X.PAIRS_SQL)}), (SELECT tp, fp, fn FROM ({REPORT}) WHERE category IS NULL)""",
}

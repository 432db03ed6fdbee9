"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (tokenized, detokenized) spellings, applied in this order.
TOKEN_SPELLINGS = (
    (" .", "."),
    (" ,", ","),
    (" ?", "?"),
    (" !", "!"),
    (" :", ":"),
    (" ;", ";"),
    (" n't", "n't"),
    (" 're ", "'re "),
    (" 'm ", "'m "),
    (" 've ", "'ve "),
    (" 'll ", "'ll "),
    (" 's ", "'s "),
    ("s ' ", "s' "),
)

# Abbreviations put together again after tokenizing.
TOKENIZE_REPAIRS = (
    (". . .", "..."),
    ("etc .", "etc."),
    ("Mr .", "Mr."),
    ("U .S .A", "U.S.A"),
)

# The Unicode whitespace characters.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

STRIKE = "̶"
M2_SEP = "|||"


def replace_all(text: Column, pairs) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def detokenize(text: Column) -> Column:
    """Join punctuation and clitics to the word before."""
    return replace_all(text, TOKEN_SPELLINGS)


def _replaced(texts: pa.Array, pairs) -> pa.Array:
    for old, new in pairs:
        texts = pc.replace_substring(texts, pattern=old, replacement=new)
    return texts


def _tokenized(texts: pa.Array) -> pa.Array:
    split = [(joined, spaced) for spaced, joined in TOKEN_SPELLINGS]
    clitics = [pair for pair in split if "'" in pair[0]]
    # No other spelling adds or removes an apostrophe, so only texts that hold one are searched for clitics.
    texts = _replaced(texts, [pair for pair in split if "'" not in pair[0]])
    quoted = pc.match_substring(texts, "'").fill_null(False)
    some = texts.filter(quoted)
    if len(some):
        texts = pc.replace_with_mask(texts, quoted, _replaced(some, clitics))
    return _replaced(texts, TOKENIZE_REPAIRS)


def tokenize(text: Column) -> Column:
    """Split punctuation and clitics off with a space.

    The literal replacements of ``replace_all`` over whole Arrow batches: seventeen native
    ones took four times as long as reading the text. Marked nondeterministic so that
    filters on the result are not pushed below it, which would run it twice.
    """
    return F.arrow_udf(_tokenized, T.StringType()).asNondeterministic()(text)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def normalize_ws(text: Column) -> Column:
    """Newline to space, one pass of double space to single, strip."""
    return strip(replace_all(text, (("\n", " "), ("  ", " "))))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens as an array.

    One character mapping and a split on a plain space: several times faster
    than a split on the character class.
    """
    spaced = F.translate(text, WS_CHARS, " " * len(WS_CHARS))
    return F.array_remove(F.split(spaced, " "), "")


def strikeout(text: Column) -> Column:
    """A combining strike after every code point."""
    return F.concat(F.array_join(F.split(text, ""), STRIKE), F.lit(STRIKE))


def clean_task_prefix(prefix: str) -> str:
    """Task prefix without colons and edge whitespace."""
    return prefix.replace(":", "").strip()


def with_task_prefix(text: Column, prefix: str) -> Column:
    """``<prefix>: <text>``; a missing text counts as empty."""
    return F.concat(F.lit(clean_task_prefix(prefix) + ": "), F.coalesce(text, F.lit("")))


def edit_key(o_start: Column, o_end: Column, edit_type: Column, c_str: Column) -> Column:
    """``start end|||TYPE|||correction``: what strict scoring compares."""
    return F.concat_ws(M2_SEP, F.concat_ws(" ", o_start, o_end), edit_type, c_str)


def first_fields(text: Column, n: int, sep: str = M2_SEP) -> Column:
    """The first ``n`` separated fields, joined again."""
    return F.array_join(F.slice(split_literal(text, sep), 1, n), sep)


def split_literal(text: Column, sep: str) -> Column:
    """Split on a literal separator."""
    return F.split(text, "".join("\\" + ch for ch in sep))


def strip_operation(edit_type: Column) -> Column:
    """``R:SPELL`` to ``SPELL``."""
    return F.substring(edit_type, 3, 1 << 30)

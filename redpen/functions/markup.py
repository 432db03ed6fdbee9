"""Inline markup of edits, and its parsed form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redpen.functions.arrays import bind
from redpen.functions.text import strikeout, strip_operation

# The markup format and the colour of each tag.
TAG_FORMAT = "<%1$s type='%2$s' edit='%3$s'>%4$s</%1$s>"
TAG_COLORS = {"d": "#faa", "a": "#afa", "c": "#fea"}
TAG_PATTERN = r"<[dac]\s.*?</[dac]>"
FIELDS_PATTERN = r"(?s)^<([dac]) type='(.*?)' edit='(.*?)'>(.*)</[dac]>$"

SENTINEL = "\ue000"


def tag_string(tag: Column, edit_type: Column, edit: Column, text: Column) -> Column:
    """``<c type='SPELL' edit='the'>teh</c>``"""
    whole = F.format_string(TAG_FORMAT, tag, edit_type, edit, text)
    return F.when(tag.isNotNull() & edit_type.isNotNull() & edit.isNotNull() & text.isNotNull(), whole)


def _tag(edit: Column) -> Column:
    return F.when(edit["o_str"] == "", "a").when(edit["c_str"] == "", "d").otherwise("c")


def _insertion_text(edit: Column, word: Column, before: Column) -> Column:
    """Shown correction of an insertion: the neighbour with the inserted words.

    Punctuation is shown alone; at the sentence start the insertion comes first.
    """
    joined = F.when(before, F.concat_ws(" ", edit["c_str"], word)).otherwise(
        F.concat_ws(" ", word, edit["c_str"])
    )
    return F.when((strip_operation(edit["type"]) == "PUNCT") | (word == ""), edit["c_str"]).otherwise(joined)


def pieces(tokens: Column, edits: Column) -> Column:
    """Alternating plain and tagged pieces of a sentence, in order.

    Edits are sorted and do not overlap or touch. Each one contributes the plain
    text since the one before and its tag, so work is linear in tokens plus edits.
    """
    last = lambda e: F.when(
        e["o_str"] == "", F.least(F.greatest(e["o_start"], F.lit(1)), F.size(tokens))
    ).otherwise(e["o_end"])
    ends = F.concat(F.array(F.lit(0)), F.transform(edits, last))
    return bind({"tokens": tokens, "edits": edits, "ends": ends}, _pieces)


def _pieces(row: Column) -> Column:
    """``pieces`` over tokens, edits and the token where each piece starts."""
    tokens, edits, ends = row["tokens"], row["edits"], row["ends"]
    first = lambda e: F.when(
        e["o_str"] == "", F.greatest(e["o_start"] - 1, F.lit(0))
    ).otherwise(e["o_start"])
    spaced = lambda words: F.when(
        F.size(words) > 0, F.concat(F.array_join(words, " "), F.lit(" "))
    ).otherwise("")
    piece = lambda text, tag, type_, edit: F.struct(
        text.alias("text"), tag.alias("tag"), type_.alias("type"), edit.alias("edit")
    )
    none = F.lit(None).cast("string")

    def around(e: Column, k: Column) -> Column:
        start = F.get(ends, k)
        words = F.slice(tokens, start + 1, F.greatest(first(e) - start, F.lit(0)))
        covered = F.array_join(F.slice(tokens, first(e) + 1, F.get(ends, k + 1) - first(e)), " ")
        inserted = _insertion_text(e, covered, e["o_start"] == 0)
        tagged = piece(
            F.when(e["o_str"] == "", covered).otherwise(e["o_str"]),
            _tag(e),
            strip_operation(e["type"]),
            F.when(e["o_str"] == "", inserted).otherwise(e["c_str"]),
        )
        plain = F.concat(F.when(k > 0, " ").otherwise(""), spaced(words))
        return F.array(piece(plain, none, none, none), tagged)

    done = F.element_at(ends, -1)
    left = F.slice(tokens, done + 1, F.greatest(F.size(tokens) - done, F.lit(0)))
    lead = F.when((F.size(edits) > 0) & (F.size(left) > 0), " ").otherwise("")
    tail = piece(F.concat(lead, F.array_join(left, " ")), none, none, none)
    return F.concat(F.flatten(F.transform(edits, around)), F.array(tail))


def markup(parts: Column) -> Column:
    """The pieces as one string with inline tags."""
    shown = lambda p: F.when(p["tag"].isNull(), p["text"]).otherwise(
        tag_string(p["tag"], p["type"], p["edit"], p["text"])
    )
    return F.array_join(F.transform(parts, shown), "")


def compat_markup(tokens: Column, edits: Column) -> Column:
    """Markup with the historical placement rules.

    An insertion at the start is attached after the second token, and edits that
    meet on one token nest. A one-token sentence with such an insertion gives null.
    Edits are sorted by the token they attach to; each token with edits starts a
    group, so work is linear in tokens plus edits, but for that sort.
    """
    place = lambda e: F.when(
        e["o_str"] == "", F.when(e["o_start"] >= 1, e["o_start"] - 1).otherwise(F.lit(1))
    ).otherwise(e["o_start"])
    after = lambda e: F.when(e["o_str"] == "", place(e) + 1).otherwise(F.greatest(place(e) + 1, e["o_end"]))
    placed = F.array_sort(
        F.transform(edits, lambda e, k: F.struct(place(e).alias("at"), k.alias("k"), after(e).alias("after"), e.alias("edit")))
    )

    def grouped(row: Column) -> Column:
        opens = lambda k: (k == 0) | (F.get(row["placed"], k)["at"] != F.get(row["placed"], k - 1)["at"])
        places = F.sequence(F.lit(0), F.size(row["placed"]) - 1)
        starts = F.when(F.size(row["placed"]) > 0, F.filter(places, opens)).otherwise(F.array().cast("array<int>"))
        return bind({"tokens": row["tokens"], "placed": row["placed"], "starts": starts}, folded)

    def folded(row: Column) -> Column:
        def group(start: Column, g: Column) -> Column:
            end = F.coalesce(F.get(row["starts"], g + 1), F.size(row["placed"]))
            at = F.get(row["placed"], start)["at"]
            state = F.struct(F.get(row["tokens"], at).alias("word"), (at + 1).alias("after"))
            done = F.aggregate(F.slice(row["placed"], start + 1, end - start), state, _wrap)
            return F.struct(at.alias("at"), done.alias("done"))

        groups = F.transform(row["starts"], group)
        return bind({"tokens": row["tokens"], "groups": groups}, joined)

    def joined(row: Column) -> Column:
        tokens, groups = row["tokens"], row["groups"]
        # Two groups back: an insertion at the start attaches inside the first edit.
        free_at = lambda g: F.greatest(*[F.get(groups, g - back)["done"]["after"] for back in (1, 2)], F.lit(0))

        def piece(here: Column, g: Column) -> Column:
            free = free_at(g)
            plain = F.slice(tokens, free + 1, F.greatest(here["at"] - free, F.lit(0)))
            # A token that the group before covers is not shown.
            return F.when(here["at"] >= free, F.concat(plain, F.array(here["done"]["word"]))).otherwise(plain)

        last = free_at(F.size(groups))
        rest = F.slice(tokens, last + 1, F.greatest(F.size(tokens) - last, F.lit(0)))
        text = F.array_join(F.concat(F.flatten(F.transform(groups, piece)), rest), " ")
        return F.when(~F.exists(groups, lambda x: x["done"]["word"].isNull()), text)

    return bind({"tokens": tokens, "placed": placed}, grouped)


def _wrap(state: Column, placed: Column) -> Column:
    """Put one more edit around what its token shows so far."""
    e, word = placed["edit"], state["word"]
    edit_type = strip_operation(e["type"])
    inserted = e["o_str"] == ""
    text = F.when(inserted, word).otherwise(e["o_str"])
    shown = F.when(inserted & (edit_type != "PUNCT"), F.concat(word, F.lit(" "), e["c_str"])).otherwise(e["c_str"])
    tagged = F.when(word.isNotNull(), tag_string(_tag(e), edit_type, shown, text))
    return F.struct(tagged.alias("word"), F.greatest(state["after"], placed["after"]).alias("after"))


def split_markup(text: Column) -> Column:
    """Split marked-up text, keeping the tagged pieces."""
    around = F.regexp_replace(text, TAG_PATTERN, f"{SENTINEL}$0{SENTINEL}")
    return F.split(around, SENTINEL)


def parse_piece(piece: Column) -> Column:
    """One piece of split markup as (text, tag, type, edit)."""
    field = lambda k: F.regexp_extract(piece, FIELDS_PATTERN, k)
    tagged = piece.rlike(FIELDS_PATTERN)
    when = lambda value: F.when(tagged, value)
    return F.struct(
        F.when(tagged, field(4)).otherwise(piece).alias("text"),
        when(field(1)).alias("tag"),
        when(field(2)).alias("type"),
        when(field(3)).alias("edit"),
    )


def display(piece: Column) -> Column:
    """What a piece shows: text, category and colour (null for plain text)."""
    colors = F.create_map(*[F.lit(x) for pair in TAG_COLORS.items() for x in pair])
    shown = (
        F.when(piece["tag"].isNull(), piece["text"])
        .when(piece["tag"] == "d", strikeout(piece["text"]))
        .otherwise(piece["edit"])
    )
    return F.struct(
        shown.alias("text"), piece["type"].alias("type"), F.element_at(colors, piece["tag"]).alias("color")
    )

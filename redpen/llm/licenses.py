"""License scans: ordered signature rules over the words of whole texts.

Text is lower-cased (A-Z), and runs of anything but digits, letters a-z and
code points from 80 are one space; rules are regular expressions over that
form. A rule runs only on texts that hold its keyword. All matches of all
rules are ordered by priority (texts of a license before tags, grants,
titles and mentions), then length, then place; a match whose words lie inside
those of an accepted one is suppressed. What is left gives labels and a score.

Phrases listed in ``BASE`` are found everywhere, are never suppressed and
keep their labels.

Defined cases: null text is empty text, without words or labels and with
score 0; equal matches count once; repeated rows repeat; other columns are
not read; texts may have any length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame

from redpen.llm.tables import map_slices

#: Phrases and labels that are always reported.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

TEXT, TAG, GRANT, TITLE, MENTION = 5, 4, 3, 2, 1
SCORES = {TEXT: 1.0, TAG: 0.95, GRANT: 0.9, TITLE: 0.75, MENTION: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int


#: Label, how the license is named, and a word that every such name has.
FAMILIES = (
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v)?3(?: 0)?", "agpl|affero"),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", "agpl|affero"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl) ?(?:version |v)?2(?: 0)?", "lgpl|library general"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?2 1", "lgpl|lesser"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?3(?: 0)?", "lgpl|lesser"),
    ("lgpl", r"(?:gnu )?(?:lesser general public license|library general public license|lgpl)", "lgpl|lesser|library"),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?1(?: 0)?", "gpl|general public"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)?", "gpl|general public"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)?", "gpl|general public"),
    ("gpl", r"gnu (?:general public license|gpl)", "gnu"),
    ("gfdl-1.3", r"(?:gnu free documentation license|gfdl) ?(?:version |v)?1 3", "gfdl|documentation"),
    ("gfdl", r"(?:gnu free documentation license|gfdl)", "gfdl|documentation"),
    ("apache-1.0", r"apache (?:software )?(?:license )?(?:version |v)?1 0", "apache"),
    ("apache-1.1", r"apache (?:software )?(?:license )?(?:version |v)?1 1", "apache"),
    ("apache-2.0", r"apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit-0", r"mit (?:no attribution|0)", "mit"),
    ("mit", r"(?:mit|expat) (?:style )?licen[cs]e", "mit|expat"),
    ("x11", r"x11 licen[cs]e", "x11"),
    ("bsd-0-clause", r"(?:0 ?bsd|0 clause bsd|bsd (?:0|zero) clause)", "bsd"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause)", "bsd"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)", "bsd"),
    ("bsd-4-clause", r"(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause)", "bsd"),
    ("bsd", r"bsd (?:style )?licen[cs]e", "bsd"),
    ("isc", r"isc licen[cs]e", "isc"),
    ("mpl-1.1", r"(?:mozilla public licen[cs]e|mpl) ?(?:version |v)?1 1", "mpl|mozilla"),
    ("mpl-2.0", r"(?:mozilla public licen[cs]e|mpl) ?(?:version |v)?2(?: 0)?", "mpl|mozilla"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla"),
    ("epl-1.0", r"(?:eclipse public licen[cs]e|epl) ?(?:version |v)?1(?: 0)?", "epl|eclipse"),
    ("epl-2.0", r"(?:eclipse public licen[cs]e|epl) ?(?:version |v)?2(?: 0)?", "epl|eclipse"),
    ("cddl-1.0", r"(?:common development and distribution licen[cs]e|cddl) ?(?:version |v)?1(?: 0)?", "cddl|distribution"),
    ("cddl-1.1", r"(?:common development and distribution licen[cs]e|cddl) ?(?:version |v)?1 1", "cddl|distribution"),
    ("cpl-1.0", r"common public licen[cs]e", "common public"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl) ?(?:version |v)?1 2", "eupl|european union"),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", "eupl|european union"),
    ("osl-3.0", r"open software licen[cs]e", "open software"),
    ("afl-3.0", r"academic free licen[cs]e", "academic free"),
    ("artistic-1.0", r"artistic licen[cs]e ?(?:version |v)?1(?: 0)?", "artistic"),
    ("artistic-2.0", r"artistic licen[cs]e ?(?:version |v)?2(?: 0)?", "artistic"),
    ("artistic", r"artistic licen[cs]e", "artistic"),
    ("bsl-1.0", r"boost software licen[cs]e", "boost"),
    ("busl-1.1", r"business source licen[cs]e", "business source"),
    ("sspl-1.0", r"(?:server side public licen[cs]e|sspl)", "server side|sspl"),
    ("elastic-2.0", r"elastic licen[cs]e", "elastic"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("zlib", r"(?:zlib|libpng) licen[cs]e", "zlib|libpng"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("python-2.0", r"(?:python software foundation|psf) licen[cs]e", "python|psf"),
    ("php-3.01", r"php licen[cs]e", "php"),
    ("ruby", r"ruby licen[cs]e", "ruby"),
    ("ncsa", r"(?:university of illinois ncsa open source|ncsa) licen[cs]e", "ncsa"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft"),
    ("ofl-1.1", r"(?:sil )?open font licen[cs]e", "open font"),
    ("odbl-1.0", r"(?:open database licen[cs]e|odbl)", "open database|odbl"),
    ("odc-by-1.0", r"(?:open data commons attribution|odc by)", "open data commons|odc"),
    ("pddl-1.0", r"public domain dedication and licen[cs]e", "public domain"),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero|cc0 1 0)", "cc0|zero"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", "cc by|creative"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by|creative"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "cc by|creative"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", "cc by|creative"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "cc by|creative"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution) 3 0", "cc by|creative"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution) 4 0", "cc by|creative"),
    ("cc", r"creative commons", "creative commons"),
)

#: Passages of the licenses' own texts.
PASSAGES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission notice"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of (?:its|their) contributors", "neither the name"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising materials"),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "except in compliance"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license", "agreed to in writing"),
    ("gpl-2.0", r"either version 2 of the license or (?:at your option )?any later version", "either version 2"),
    ("gpl-3.0", r"either version 3 of the license or (?:at your option )?any later version", "either version 3"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "is free software"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"this software is provided as is without any express or implied warranty", "express or implied"),
    ("wtfpl", r"do what the fuck you want to public license", "what the fuck"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("ofl-1.1", r"reserved font name", "reserved font"),
    ("public-domain", r"(?:released|dedicated|placed|put) (?:in|in to|into|to) the public domain", "public domain"),
    ("public-domain", r"no rights reserved", "no rights"),
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", r"unauthorized (?:copying|reproduction|use|distribution)", "unauthorized"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright"),
    ("commercial", r"commercial licen[cs]e (?:agreement|required)", "commercial"),
    ("eula", r"end user licen[cs]e agreement", "end user"),
)


def _rules() -> tuple[Rule, ...]:
    made = [Rule(label, text, word, TEXT) for label, text, word in PASSAGES]
    for label, name, words in FAMILIES:
        for word in words.split("|"):
            made += [
                Rule(label, rf"spdx license identifier {name}(?: only| or later)?", word, TAG),
                Rule(
                    label,
                    rf"(?:licen[cs]ed|released|distributed|available|published|provided) (?:\S+ ){{0,3}}under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?: version \d)?",
                    word,
                    GRANT,
                ),
                Rule(label, rf"(?:the )?{name}(?: (?:public |international |unported )?licen[cs]e)?(?: version)?", word, TITLE),
                Rule(label, rf"(?:see|under|per|of) (?:the )?{name}", word, MENTION),
            ]
    return tuple(made)


RULES = _rules()


class Scanner:
    """Compiled rules, grouped by keyword."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, base: dict[str, str] = BASE):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        self.by_keyword: dict[bytes, list[tuple[re.Pattern, int, str, int]]] = {}
        for turn, rule in enumerate(rules):
            compiled = re.compile(rf"(?<= )(?:{rule.pattern})(?= )".encode())
            self.by_keyword.setdefault(rule.keyword.encode(), []).append((compiled, rule.priority, rule.label, turn))
        keep = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
        self.letters = bytes(c if c in keep else 32 for c in range(256))

    def scan(self, text: str) -> dict:
        words = text.encode().lower().translate(self.letters).split()
        joined = b" " + b" ".join(words) + b" "
        places = self._base_places(joined)
        found = self._matches(joined)
        labels = {label for _, label in places} | {label for *_, label in found}
        score = max([SCORES[priority] for _, _, priority, _ in found] + [SCORES[TITLE]] * bool(places), default=0.0)
        starts = [place for place, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({label for _, label in places})),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "spans": [
                {"label": label, "start": start, "end": end, "priority": priority}
                for start, end, priority, label in found
            ],
        }

    def _base_places(self, joined: bytes) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = joined.find(phrase, at + 1)
        return [(word, label) for word, label in zip(_word_numbers(joined, [a for a, _ in found]), [x for _, x in found])]

    def _matches(self, joined: bytes) -> list[tuple[int, int, int, str]]:
        raw = []
        for keyword, rules in self.by_keyword.items():
            if keyword in joined:
                for pattern, priority, label, turn in rules:
                    raw += [(m.start(), m.end(), priority, label, turn) for m in pattern.finditer(joined)]
        if not raw:
            return []
        starts = _word_numbers(joined, [m[0] - 1 for m in raw])
        ends = _word_numbers(joined, [m[1] for m in raw])
        return suppress([(s, e, m[2], m[3], m[4]) for s, e, m in zip(starts, ends, raw)])


def _word_numbers(joined: bytes, at: list[int]) -> list[int]:
    """For places of spaces in order of size or not: the number of spaces before each, in one pass."""
    order, numbers, last, count = sorted(range(len(at)), key=at.__getitem__), [0] * len(at), 0, 0
    for i in order:
        count += joined.count(b" ", last, at[i])
        last = at[i]
        numbers[i] = count
    return numbers


def suppress(matches: list[tuple[int, int, int, str, int]]) -> list[tuple[int, int, int, str]]:
    """Matches (start, end, priority, label, rule) without those inside an accepted one.

    Accepted in order of priority, length, start and the rules' order. Accepted
    intervals never contain each other, so by start they are also in order of
    end, and one search finds the only candidate that could contain a new one.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for start, end, priority, label, _ in sorted(matches, key=lambda m: (-m[2], m[0] - m[1], m[0], m[4])):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, priority, label))
        # Intervals that the new one contains have no further use.
        until = at
        while until < len(ends) and ends[until] <= end:
            until += 1
        low = at - 1 if at and starts[at - 1] == start else at
        starts[low:until], ends[low:until] = [start], [end]
    return sorted(kept)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,start:long,end:long,priority:int>>"
)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: words, places of the base phrases, labels, score and the accepted spans. Narrow."""

    def make():
        scanner = Scanner(rules)

        def run(keys, texts):
            made = [scanner.scan(value.as_py() or "") for value in texts]
            yield {key: keys} | {name: [m[name] for m in made] for name in NAMES}

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_slices(docs, [key, text], make, f"`{key}` {kind}, {SCHEMA}")

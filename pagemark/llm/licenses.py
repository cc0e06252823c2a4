"""License scans by ordered signature rules.

Rules are hand-written signatures of license texts and notices, and, for families of
licenses (names, versions), the ways texts refer to them: SPDX identifiers, "licensed
under", names with versions, addresses; several hundred regexes in all. One Aho-Corasick pass over the lower-cased text finds
which keywords occur; a rule's regex runs only if its keyword, a string that
every match must hold, is there, so the gate loses nothing. Detections are
taken by priority, then length: one whose interval lies inside that of an
accepted detection is suppressed.

Base phrases are places where a phrase's words stand consecutively, whatever
stands between words; their labels always stay.

Null, empty and blank texts have no words and no detections, score 0. Repeated
rows get equal results. Empty tables give empty results. The result is one
struct column under a name of the caller's.
"""
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_LUT = np.zeros(256, dtype=bool)
_LUT[ord("0"):ord("9") + 1] = _LUT[ord("a"):ord("z") + 1] = _LUT[0x80:] = True
_IN = "0-9a-z\x80-\xff"     # word characters of the lower-cased bytes, read as Latin-1
_GAP = f"[^{_IN}]+"
_L, _R = f"(?<![{_IN}])", f"(?![{_IN}])"

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# label, keyword, names (words), versions
FAMILIES = (
    ("apache", "apache", ("apache", "apache software", "asl"), ("1.0", "1.1", "2.0")),
    ("mit", "mit", ("mit", "mit x11", "expat mit"), ()),
    ("bsd", "bsd", ("bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "new bsd", "simplified bsd", "modified bsd"), ()),
    ("gpl", "gpl", ("gpl", "gnu gpl"), ("1", "2", "3", "1.0", "2.0", "3.0")),
    ("gpl", "general", ("gnu general public", "general public"), ("1", "2", "3", "2.0", "3.0")),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl"), ("2", "2.1", "3", "2.0", "3.0")),
    ("lgpl", "lesser", ("gnu lesser general public", "lesser general public"), ("2.1", "3", "3.0")),
    ("agpl", "agpl", ("agpl", "gnu agpl"), ("1", "3", "1.0", "3.0")),
    ("agpl", "affero", ("gnu affero general public", "affero general public"), ("3", "3.0")),
    ("gfdl", "documentation", ("gnu free documentation", "free documentation"), ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", ("mozilla public", "mozilla"), ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", ("eclipse public", "eclipse"), ("1.0", "2.0")),
    ("cddl", "cddl", ("common development and distribution",), ("1.0", "1.1")),
    ("eupl", "european", ("european union public",), ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", ("artistic", "perl artistic"), ("1.0", "2.0")),
    ("isc", "isc", ("isc", "internet systems consortium isc"), ()),
    ("zlib", "zlib", ("zlib", "zlib libpng"), ()),
    ("unlicense", "unlicense", ("unlicense", "the unlicense"), ()),
    ("boost", "boost", ("boost software", "boost"), ("1.0",)),
    ("psf", "python", ("python software foundation",), ("2", "2.0")),
    ("ofl", "font", ("sil open font", "open font"), ("1.0", "1.1")),
    ("odbl", "database", ("open database", "open data commons open database"), ("1.0",)),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    ("cc0", "cc0", ("cc0", "creative commons cc0"), ("1.0",)),
) + tuple(
    (f"cc-{kind}", keyword, (name,), ("1.0", "2.0", "2.5", "3.0", "4.0"))
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
    for keyword, name in (("cc", "cc " + kind.replace("-", " ")),
                      ("creative", "creative commons " + {"by": "attribution", "sa": "sharealike", "nd": "noderivs", "nc": "noncommercial"}["by"]
                       + "".join(" " + {"sa": "sharealike", "nd": "noderivs", "nc": "noncommercial"}[x] for x in kind.split("-")[1:]))))


# SPDX identifiers of the families above, without version, where the name does not give them.
SPDX = {"apache": ("apache",), "gpl": ("gpl",), "lgpl": ("lgpl",), "agpl": ("agpl",), "gfdl": ("gfdl",), "mpl": ("mpl",), "epl": ("epl",),
        "cddl": ("cddl",), "eupl": ("eupl",), "artistic": ("artistic",), "boost": ("bsl",), "psf": ("psf", "python"), "ofl": ("ofl",),
        "odbl": ("odbl",), "bsd": ("bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"), "isc": ("isc",), "zlib": ("zlib",),
        "unlicense": ("unlicense",), "wtfpl": ("wtfpl",), "mit": ("mit", "mit 0")}
# Names that are common words too: with a version alone ("boost 1.0") they tell nothing.
COMMON_WORDS = ("eclipse", "boost", "mozilla", "artistic", "general public", "open database", "zlib", "isc")

# Signatures of license texts and notices, by hand: label, keyword, words in order; ``...`` stands for up to
# twelve words, ``(a|b)`` for one of several.
TEXTS = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "hereby", "permission to use copy modify and (or|or or) distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "hereby", "permission to use copy modify and distribute this software ... for any purpose ... without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither", "neither the name of ... nor the names of (its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-1.1", "acknowledgment", "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("lgpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-or-later", "option", "either version (1|2|3) of the license or at your option any later version"),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "source", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("boost-1.0", "accompanying", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("psf", "nonexclusive", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("beerware", "retain", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("as-is", "warranty", "the software is provided as is without warranty of any kind"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade", "contains (proprietary|confidential) information and trade secrets"),
    ("proprietary", "disclose", "may not be (copied|reproduced) disclosed or distributed without ... written (permission|consent)"),
)


def _signature(words: str) -> str:
    """Regex of a hand-written signature."""
    out = ""
    for word in words.split(" "):
        if word == "...":
            out += f"(?:{_GAP}[{_IN}]+){{0,12}}?"
            continue
        parts = "(?:" + "|".join(map(re.escape, word[1:-1].split("|"))) + ")" if word[0] == "(" else re.escape(word)
        out += (_GAP if out else "") + parts
    return _L + out + _R


def _phrase(words: str) -> str:
    return _GAP.join(map(re.escape, re.split(r"[^0-9a-z]+", words)))


@lru_cache(maxsize=1)
def rules() -> tuple[tuple, ...]:
    """(priority, confidence, label, keyword, regex), in order."""
    out = []
    add = lambda *r: out.append((*r[:4], re.compile(r[4])))
    for label, word, names, versions in FAMILIES:
        for name in names:
            # One word of the name, since anything may stand between words.
            keyword = word if word in name.split(" ") else name.split(" ")[0]
            for version in (*versions, ""):
                exact = f"{label}-{version}" if version else label
                # A version may follow `v` without a gap (GPLv3).
                tail = rf"(?:{_GAP}(?:licen[cs]e{_GAP})?(?:version{_GAP}|v\.?[^{_IN}]*)?|v){_phrase(version)}{_R}" if version else _R
                add(1, 0.95, exact, keyword, rf"{_L}(?:licen[cs]ed|released|distributed|available|published){_GAP}under{_GAP}"
                                             rf"(?:the{_GAP}|an?{_GAP})?(?:terms{_GAP}of{_GAP}the{_GAP})?{_phrase(name)}{tail}")
                if version and name not in COMMON_WORDS:
                    add(2, 0.8, exact, keyword, rf"{_L}{_phrase(name)}{tail}")
            add(3, 0.7, label, keyword, rf"{_L}{_phrase(name)}{_GAP}(?:public{_GAP})?licen[cs]e{_R}")
        for name in dict.fromkeys((*SPDX.get(label, ()), *(n for n in names if label.startswith("cc")))):
            for version in (*versions, ""):
                tail = rf"{_GAP}{_phrase(version)}(?:{_GAP}(?:only|or{_GAP}later))?{_R}" if version else _R
                add(0, 1.0, f"{label}-{version}" if version else label, "spdx", rf"spdx{_GAP}license{_GAP}identifier{_GAP}{_phrase(name)}{tail}")
    for label, keyword, words in TEXTS:
        add(1, 0.95, label, keyword, _signature(words))
    for label, place in (("apache-2.0", "apache.org/licenses/license-2.0"), ("mit", "opensource.org/licenses/mit"),
                         ("gpl", "gnu.org/licenses/gpl"), ("lgpl", "gnu.org/licenses/lgpl"), ("agpl", "gnu.org/licenses/agpl"),
                         ("mpl-2.0", "mozilla.org/mpl/2.0"), ("unlicense", "unlicense.org"),
                         *((f"cc-{k}", f"creativecommons.org/licenses/{k}/") for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
                         ("cc0", "creativecommons.org/publicdomain/zero")):
        add(1, 0.95, label, place.split(".")[0], re.escape(place))
    add(4, 0.5, "public-domain", "public", rf"{_L}(?:in{_GAP}the|to{_GAP}the){_GAP}public{_GAP}domain{_R}")
    add(4, 0.5, "proprietary", "proprietary", rf"{_L}(?:proprietary{_GAP}and{_GAP}confidential|confidential{_GAP}and{_GAP}proprietary){_R}")
    add(5, 0.4, "copyright", "copyright", rf"{_L}copyright{_GAP}(?:c{_GAP})?[12][0-9]{{3}}{_R}")
    for phrase, label in BASE.items():
        add(4, 0.6, label, phrase.split(" ")[0], rf"{_L}{_phrase(phrase)}{_R}")
    return tuple(sorted(out, key=lambda r: r[0]))


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.by_keyword: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule[3], []).append(k)
        self.base = [(label, phrase.split(" ")[0], re.compile(f"{_L}(?={_phrase(phrase)}{_R})")) for phrase, label in BASE.items()]
        self.keywords = ahocorasick.Automaton()
        for word in {*self.by_keyword, *(b[1] for b in self.base)}:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()

    def scan(self, text: str | None, gated: bool = True) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
        """(words, base places as (label, word), accepted detections as (label,
        first and last word, rule, confidence)). ``gated=False`` runs every rule."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        inside = _LUT[np.frombuffer(raw, dtype=np.uint8)]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        n_words = int(np.count_nonzero(starts))
        if not n_words:
            return 0, [], []
        plain = raw.decode("latin-1")
        there = {word for _, word in self.keywords.iter(plain)} if gated else {*self.by_keyword, *(b[1] for b in self.base)}
        if not there:
            return n_words, [], []
        places = np.flatnonzero(starts)
        index = lambda at: int(np.searchsorted(places, at))
        base = [(label, index(m.start())) for label, word, regex in self.base if word in there for m in regex.finditer(plain)]
        found = sorted((self.rules[k][0], m.start() - m.end(), m.start(), k, m.end())
                       for word in there for k in self.by_keyword.get(word, ()) for m in self.rules[k][4].finditer(plain))
        return n_words, base, [(self.rules[k][2], index(a), index(b) - 1, k, self.rules[k][1]) for a, b, k in suppress(found)]


def suppress(found: list[tuple]) -> list[tuple[int, int, int]]:
    """Accepted (start, stop, rule) of detections sorted by (priority, -length,
    start, rule): none lies inside one accepted before it. ``hull`` holds the
    accepted intervals that lie inside no other, whose starts and stops rise
    together, so one look decides."""
    kept: list[tuple[int, int, int]] = []
    hull: list[tuple[int, int]] = []
    for _, _, a, k, b in found:
        at = bisect_right(hull, (a, sys.maxsize))
        if at and hull[at - 1][1] >= b:
            continue
        kept.append((a, b, k))
        low = bisect_left(hull, (a, 0))
        high = low
        while high < len(hull) and hull[high][1] <= b:
            high += 1
        hull[low:high] = [(a, b)]
    return sorted(kept)


SCHEMA = ("n_words long, base array<struct<label:string,word:long>>, "
          "detections array<struct<label:string,first:long,last:long,rule:int,confidence:double>>")


def scan_column(text: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for texts in batches:
            rows = [scanner.scan(t) for t in texts]
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows],
                "base": [[{"label": a, "word": b} for a, b in r[1]] for r in rows],
                "detections": [[dict(zip(("label", "first", "last", "rule", "confidence"), d)) for d in r[2]] for r in rows]})

    return run.asNondeterministic()(text)


def scan(docs: DataFrame, text_col: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with the struct column ``into``: ``n_words, base, detections``."""
    return docs.withColumn(into, scan_column(F.col(text_col)))

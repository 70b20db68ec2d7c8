"""License scan: ordered signature rules behind a keyword gate.

A text is lower-cased (A-Z) and split into words; rules are regular expressions over the words joined
by single spaces. A rule runs only when all words of its gate occur. Detections are taken by
priority; one that lies inside the span of a detection of the same or a higher rank is suppressed.
Base phrases are counted separately and never suppressed.

Defined results: null and empty texts have no words, no places, empty labels and score 0; ties go to
the earlier rule; equal rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from pagetwin.llm.rows import narrow
from pagetwin.session import prepare

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A-Z to a-z; every other byte that is no word byte to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # smaller goes first
    weight: float  # confidence of the detection
    gate: frozenset[str]
    pattern: re.Pattern


#: Licences by name: label, names as written in words, versions (empty: unversioned).
FAMILIES = [
    ("apache", ["apache software", "apache"], ["1 0", "1 1", "2 0"]),
    ("gpl", ["gnu general public", "general public", "gpl", "gnu gpl"], ["1", "2", "2 0", "3", "3 0"]),
    ("lgpl", ["gnu lesser general public", "lesser general public", "gnu library general public", "lgpl"], ["2", "2 1", "3", "3 0"]),
    ("agpl", ["gnu affero general public", "affero general public", "agpl"], ["1", "3", "3 0"]),
    ("mpl", ["mozilla public", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], ["1 0", "2 0"]),
    ("edl", ["eclipse distribution"], ["1 0"]),
    ("cddl", ["common development and distribution", "cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public"], ["0 5", "1 0"]),
    ("ipl", ["ibm public"], ["1 0"]),
    ("eupl", ["european union public", "eupl"], ["1 0", "1 1", "1 2"]),
    ("artistic", ["artistic", "perl artistic"], ["1 0", "2 0"]),
    ("bsl", ["boost software", "bsl"], ["1 0"]),
    ("busl", ["business source", "busl"], ["1 0", "1 1"]),
    ("sspl", ["server side public", "sspl"], ["1"]),
    ("elastic", ["elastic"], ["1", "2", "2 0"]),
    ("osl", ["open software"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", ["academic free"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("zpl", ["zope public"], ["1 1", "2 0", "2 1"]),
    ("psf", ["python software foundation", "psf"], ["2"]),
    ("php", ["php"], ["3 0", "3 01"]),
    ("ofl", ["sil open font", "open font"], ["1 0", "1 1"]),
    ("lppl", ["latex project public", "lppl"], ["1 0", "1 1", "1 2", "1 3"]),
    ("cecill", ["cecill"], ["1 0", "1 1", "2 0", "2 1"]),
    ("apsl", ["apple public source"], ["1 0", "1 1", "1 2", "2 0"]),
    ("ms-pl", ["microsoft public", "ms pl"], []),
    ("ms-rl", ["microsoft reciprocal", "ms rl"], []),
    ("qpl", ["q public"], ["1 0"]),
    ("rpl", ["reciprocal public"], ["1 1", "1 5"]),
    ("spl", ["sun public"], ["1 0"]),
    ("npl", ["netscape public"], ["1 0", "1 1"]),
    ("upl", ["universal permissive"], ["1 0"]),
    ("unlicense", ["the unlicense"], []),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public"], ["2"]),
    ("isc", ["isc"], []),
    ("mit", ["mit", "x11", "expat"], []),
    ("zlib", ["zlib", "zlib libpng"], []),
    ("bsd", ["bsd", "berkeley software distribution"], []),
    ("bsd-2-clause", ["bsd 2 clause", "simplified bsd", "freebsd"], []),
    ("bsd-3-clause", ["bsd 3 clause", "new bsd", "modified bsd", "revised bsd"], []),
    ("bsd-4-clause", ["bsd 4 clause", "original bsd"], []),
    ("0bsd", ["0bsd", "bsd zero clause"], []),
    ("ncsa", ["university of illinois ncsa open source", "ncsa"], []),
    ("openssl", ["openssl"], []),
    ("vim", ["vim"], []),
    ("ruby", ["ruby"], []),
    ("json", ["json"], []),
    ("icu", ["icu", "unicode"], []),
    ("postgresql", ["postgresql"], []),
    ("odbl", ["open database", "odbl"], ["1 0"]),
    ("odc-by", ["open data commons attribution"], ["1 0"]),
    ("pddl", ["open data commons public domain dedication"], ["1 0"]),
    ("gfdl", ["gnu free documentation", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("openrail", ["openrail", "openrail m", "creativeml open rail m"], []),
    ("llama", ["llama 2 community", "llama 3 community"], []),
    ("mulan", ["mulan psl", "mulan permissive software"], ["1", "2"]),
    ("cc0", ["cc0", "creative commons zero"], ["1 0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
]

#: Wordings that name no licence or quote its body: label, weight, pattern over words.
PHRASES = [
    ("mit", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 0.8, r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 0.9, r"neither the name of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", 0.9, r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", 0.95, r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 0.95, r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 0.95, r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", 0.95, r"you may not use this file except in compliance with the license"),
    ("mpl", 0.95, r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("bsl", 0.9, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 0.95, r"you just do what the fuck you want to"),
    ("cc0", 0.85, r"to the extent possible under law (?:\S+ ){1,12}?has waived all copyright"),
    ("ofl", 0.9, r"this font software is licensed under the sil open font license"),
    ("public-domain", 0.8, r"(?:placed|released|is|are) (?:in|into) the public domain"),
    ("public-domain", 0.8, r"dedicated to the public domain"),
    ("public-domain", 0.6, r"no rights reserved"),
    ("reserved", 0.7, r"some rights reserved"),
    ("proprietary", 0.8, r"proprietary and confidential"),
    ("proprietary", 0.8, r"unauthorized copying (?:of this file )?(?:via any medium )?is strictly prohibited"),
    ("proprietary", 0.7, r"may not be (?:reproduced|copied|distributed) (?:\S+ ){0,6}?without (?:the )?(?:prior |express )*(?:written )?permission"),
    ("commercial", 0.6, r"end user license agreement"),
    ("commercial", 0.6, r"for (?:internal|personal|non commercial) use only"),
    ("copyright", 0.5, r"copyright (?:c |© )?(?:19|20)\d\d"),
    ("copyright", 0.5, r"© (?:19|20)\d\d"),
]


def _spdx(label: str, version: str) -> str:
    head = {"mpl": "mpl", "ofl": "ofl"}.get(label, label).replace("-", " ")
    return f"{head} {version}".strip()


def _gate(*texts: str) -> frozenset[str]:
    """Plain words that a match must contain; groups and optional parts are no part of it, so patterns have groups of whole words only."""
    return frozenset(w for t in texts for w in t.split() if w.isalnum() or w == "©")


def rules() -> list[Rule]:
    """All rules in their order: quoted bodies, tags, versioned notices, versioned names, notices, names."""
    out: list[Rule] = []

    def rule(label, priority, weight, pattern, gate):
        out.append(Rule(label, priority, weight, gate, re.compile(rf"(?<= )(?:{pattern})(?= )")))

    for label, weight, pattern in PHRASES:
        rule(label, 0 if weight >= 0.8 else 4, weight, pattern, _gate(re.sub(r"\(\?:[^()]*\)[?*]?|\(\?:\\S\+ \)\{[^}]*\}\??", " ", pattern.replace("(?:\\S+ )", " ")).replace("{1,12}?", " ").replace("{0,6}?", " ")))
    given = r"(?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?"
    for label, names, versions in FAMILIES:
        for v in versions:
            number = v if " " in v else rf"{v}(?: 0)?"
            rule(f"{label}-{v.replace(' ', '.')}", 1, 1.0, rf"spdx license identifier {_spdx(label, v)}(?: only| or later)?", _gate("spdx", "identifier"))
            for name in names:
                rule(f"{label}-{v.replace(' ', '.')}", 2, 0.95, rf"{given}{name}(?: licen[cs]e)?(?: version| ver)? v?{number}(?: or (?:any )?later(?: version)?)?", _gate(name))
                rule(f"{label}-{v.replace(' ', '.')}", 3, 0.85, rf"{name}(?: licen[cs]e)?(?: version| ver)? v?{number}(?: only| or later)?(?: licen[cs]e| international| unported| generic)?", _gate(name))
        rule(label, 1, 1.0, rf"spdx license identifier {_spdx(label, '')}(?: only| or later)?", _gate("spdx", "identifier"))
        for name in names:
            rule(label, 4, 0.8, rf"{given}{name}(?: licen[cs]e)?", _gate(name))
            rule(label, 5, 0.6, rf"{name} licen[cs]es?", _gate(name))
    return out


class Spans:
    """Intervals that answer whether one of them contains another interval."""

    def __init__(self):
        self.starts: list[int] = []
        self.reach: list[int] = []

    def rebuild(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.reach, far = [], [], -1
        for a, b in sorted(spans):
            far = max(far, b)
            self.starts.append(a)
            self.reach.append(far)

    def contains(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.reach[k] >= b


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (priority, start, end, rule), those not inside one of an earlier rank; in equal rank the longer and then the earlier rule stays."""
    kept: list[tuple[int, int, int, int]] = []
    held = Spans()
    for p in sorted({f[0] for f in found}):
        far, mine = -1, []
        for f in sorted((f for f in found if f[0] == p), key=lambda f: (f[1], -f[2], f[3])):
            if f[2] > far and not held.contains(f[1], f[2]):
                mine.append(f)
                far = f[2]
        kept += mine
        held.rebuild([(f[1], f[2]) for f in kept])
    return sorted(kept, key=lambda f: (f[1], f[2], f[3]))


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.base = [(p, label, frozenset(p.split()), re.compile(rf"(?<= ){p}(?= )")) for p, label in BASE.items()]
        self.encoded = frozenset(w.encode() for r in self.rules for w in r.gate) | {w.encode() for p in BASE for w in p.split()}
        #: Rules by one word of their gate, the longest; only those are looked at whose word occurs.
        self.by_word: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            self.by_word.setdefault(max(r.gate, key=lambda w: (len(w), w)), []).append(k)

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "detections": []}
        if not words:
            return out
        present = {w.decode() for w in set(words) & self.encoded}
        if not present:
            return out
        line = None
        starts: list[int] = []
        for p, label, gate, pattern in self.base:
            if gate <= present:
                line = line or f" {' '.join(map(bytes.decode, words))} "
                at = [m.start() for m in pattern.finditer(line)]
                starts += at
                if at:
                    out["base_labels"].append(label)
        found = []
        for k in sorted({k for w in present for k in self.by_word.get(w, ())}):
            r = self.rules[k]
            if r.gate <= present:
                line = line or f" {' '.join(map(bytes.decode, words))} "
                found += [(r.priority, m.start(), m.end(), k) for m in r.pattern.finditer(line)]
        if starts:
            out |= {"n_base": len(starts), "first_word": line.count(" ", 0, min(starts)) - 1, "last_word": line.count(" ", 0, max(starts)) - 1}
        at = word = 0
        for p, a, b, k in resolve(found):
            word += line.count(" ", at, a)
            at = a
            out["detections"].append({"label": self.rules[k].label, "rule": k, "priority": p, "weight": self.rules[k].weight, "start_word": word - 1, "n_words": line.count(" ", a, b) + 1})
        return out


_DETECTION = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("weight", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("detections", pa.list_(_DETECTION))]
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections array<struct<label:string,rule:int,priority:int,weight:double,start_word:long,n_words:long>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, detections with their spans in words."""
    prepare(docs.sparkSession)
    rows = narrow(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            got = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[n] for g in got], t) for n, t in _FIELDS)], names=["doc_id", *(n for n, _ in _FIELDS)])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_DDL}")

"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a label, a priority and a confidence: over a
hundred written by hand for what license texts and notices say, the others from the
names of license families, each in the forms and versions in which it is named.  A
text first passes a substring test for its keywords, with runs of white space as
one blank; only rules whose keywords stand in the text run, and these stand in
all that the rule can match.  Detections are then resolved in order of priority (and
length): one that lies within an accepted detection is suppressed.

Defined results: a null or empty text has no words and no detections; several
detections of one label count once; of detections with the same place the first
rule's counts; texts are scanned whole, in time that grows with their length;
repeated rows give a row each; an empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, keyed_text, map_slices

# Phrases and labels that every scan reports.
BASE_PHRASES = {
    b"mit license": "mit",
    b"apache license": "apache",
    b"general public license": "gpl",
}

#: Bytes that are no part of a word become spaces; upper-case ASCII becomes lower case.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Public license families as (label, keyword, name pattern, versions); the keyword stands in all that the pattern matches.
FAMILIES = [
    ("mit", "mit", r"mit(?:/x11)?", ()),
    ("mit", "expat", r"expat", ()),
    ("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0")),
    ("gpl", "general public", r"(?:gnu )?general public", ("1", "2", "2.0", "3", "3.0")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "2.0", "3", "3.0")),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", ("2.1", "3", "3.0")),
    ("lgpl", "library general", r"(?:gnu )?library general public", ("2", "2.0")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3", "3.0")),
    ("agpl", "affero", r"(?:gnu )?affero general public", ("1", "3", "3.0")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3", "3.0")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", ("1.1", "1.2", "1.3")),
    ("bsd", "bsd", r"(?:(?:new|modified|simplified|revised|[0234]-clause) )?bsd(?:[\- ][0234][\- ]clause)?", ()),
    ("isc", "isc", r"isc", ()),
    ("mpl", "mozilla", r"mozilla public", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public", ("1.0", "2.0")),
    ("cddl", "common development", r"common development and distribution", ("1.0", "1.1")),
    ("eupl", "european union public", r"european union public", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", r"(?:perl )?artistic", ("1.0", "2.0")),
    ("boost", "boost", r"boost software", ("1.0",)),
    ("zlib", "zlib", r"zlib(?:/libpng)?", ()),
    ("unlicense", "unlicense", r"the unlicense|unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public", ("2",)),
    ("python", "python software", r"python software foundation", ("2",)),
    ("python", "psf", r"psf", ("2",)),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("openssl", "openssl", r"openssl", ()),
    ("php", "php", r"php", ("3.0", "3.01")),
    ("ruby", "ruby", r"ruby", ()),
    ("vim", "vim", r"vim", ()),
    ("ofl", "open font", r"sil open font", ("1.0", "1.1")),
    ("osl", "open software", r"open software", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free", r"academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("cpl", "common public", r"common public", ("1.0",)),
    ("ms-pl", "microsoft", r"microsoft (?:public|reciprocal)", ()),
    ("odbl", "open database", r"open database", ("1.0",)),
    ("odbl", "odbl", r"odbl", ("1.0",)),
    ("odc-by", "open data commons", r"open data commons attribution", ("1.0",)),
    ("cc0", "cc0", r"cc0", ("1.0",)),
    ("cc0", "creative commons zero", r"creative commons zero", ("1.0",)),
    ("cc-by-nc-nd", "nc-nd", r"(?:creative commons |cc[\- ])by-nc-nd", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "nc-sa", r"(?:creative commons |cc[\- ])by-nc-sa", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "by-nc", r"(?:creative commons |cc[\- ])by-nc", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "by-nd", r"(?:creative commons |cc[\- ])by-nd", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "by-sa", r"(?:creative commons |cc[\- ])by-sa", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "cc", r"cc[\- ](?:by|attribution)", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "creative commons", r"creative commons (?:by|attribution)", ("2.0", "2.5", "3.0", "4.0")),
]

# What license texts and notices say, as (label, keyword, pattern); the keyword stands in all that the pattern matches.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "copies or substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("mit", "under mit", r"licen[sc]ed under mit"),
    ("mit", "mit-style", r"(?:an? )?mit-style licen[sc]e"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "bsd-style", r"(?:an? )?bsd-style licen[sc]e"),
    ("apache", "apache software foundation", r"licen[sc]ed to the apache software foundation \(asf\) under one or more contributor licen[sc]e agreements"),
    ("apache", "you may not use this file except", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache", "grant of patent licen", r"grant of patent licen[sc]e\. subject to the terms and conditions of this licen[sc]e, each contributor"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "this program is free software", r"this program is free software[;:,]? you can redistribute it and/or modify it"),
    ("gpl", "gnu.org/licenses/gpl", r"https?://www\.gnu\.org/licenses/gpl(?:-[0-9.]+)?"),
    ("gpl-classpath", "classpath", r"(?:designates this particular file as subject to the )?[\"']?classpath[\"']? exception"),
    ("gpl-linking", "linking exception", r"(?:gcc runtime library|gpl|static|dynamic)? ?linking exception"),
    ("lgpl", "free software foundation", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", "received a copy of the gnu l", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "gnu.org/licenses/lgpl", r"https?://www\.gnu\.org/licenses/lgpl(?:-[0-9.]+)?"),
    ("agpl", "free software foundation", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl", "remote network interaction", r"remote network interaction; use with the gnu general public licen[sc]e"),
    ("gfdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/?(?:2\.0|1\.1)?"),
    ("mpl", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", "incompatible with secondary licenses", r"incompatible with secondary licenses"),
    ("epl", "terms of the eclipse public", r"made available under the terms of the eclipse public licen[sc]e"),
    ("epl", "eclipse.org/legal", r"https?://www\.eclipse\.org/legal/epl-(?:v10|2\.0|v20)"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[sc]e"),
    ("cddl", "cddl", r"cddl(?:[- ]?v?1\.[01])?"),
    ("cddl", "common development and distribution", r"subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", "eupl", r"eupl(?:[- ]?v?1\.[012])?"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense.org", r"https?://unlicense\.org"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"this (?:work|file|code|software|document|text|book) is (?:hereby )?(?:in|released into) the public domain"),
    ("public-domain", "public domain mark", r"public domain mark(?: 1\.0)?"),
    ("public-domain", "no known copyright", r"no known copyright(?: restrictions)?"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "the origin of this software", r"the origin of this software must not be misrepresented"),
    ("boost", "boost.org/license", r"https?://www\.boost\.org/license_1_0\.txt"),
    ("boost", "boost software", r"distributed under the boost software licen[sc]e, version 1\.0"),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to"),
    ("beerware", "beer", r"(?:the )?beer-?ware licen[sc]e"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "for good, not evil", r"the software shall be used for good, not evil"),
    ("artistic", "artistic", r"either the gnu general public licen[sc]e or the artistic licen[sc]e"),
    ("perl", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("ruby", "same terms as ruby", r"under the same terms as ruby(?: itself)?"),
    ("python", "psf license agreement", r"psf license agreement for python [0-9.]+"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", "curl", r"curl(?: and libcurl)? (?:is|are) licensed under (?:an? )?mit/x derivate licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: version 2)?"),
    ("libpng", "png reference library", r"png reference library licen[sc]e(?: version 2)?"),
    ("libtiff", "sam leffler", r"the names of sam leffler and silicon graphics may not be used"),
    ("icu", "unicode, inc", r"unicode, inc\. licen[sc]e agreement|copyright .{0,20}unicode, inc\."),
    ("unicode", "unicode licen", r"unicode licen[sc]e v3"),
    ("ncsa", "university of illinois", r"university of illinois/ncsa open source licen[sc]e"),
    ("w3c", "w3c", r"w3c (?:software|document)(?: notice and)? licen[sc]e"),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer"),
    ("ofl", "sil open font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "scripts.sil.org/ofl", r"https?://scripts\.sil\.org/ofl"),
    ("ofl", "reserved font name", r"with reserved font name"),
    ("apsl", "apple public source", r"apple public source licen[sc]e"),
    ("ms-pl", "ms-pl", r"ms-pl"),
    ("ms-rl", "ms-rl", r"ms-rl"),
    ("ms-eula", "microsoft software licen", r"microsoft software licen[sc]e terms"),
    ("ibm-pl", "ibm public", r"ibm public licen[sc]e"),
    ("qpl", "q public", r"q public licen[sc]e"),
    ("lppl", "latex project public", r"latex project public licen[sc]e"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e"),
    ("ecl", "educational community", r"educational community licen[sc]e"),
    ("nasa", "nasa open source", r"nasa open source agreement"),
    ("cecill", "cecill", r"cecill(?:-[abc])?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)"),
    ("blueoak", "blue oak model", r"blue oak model licen[sc]e"),
    ("sspl", "server side public", r"server side public licen[sc]e"),
    ("sspl", "sspl", r"sspl(?:-1\.0| v1)?"),
    ("elastic", "elastic license", r"elastic license(?: 2\.0)?"),
    ("busl", "business source", r"business source licen[sc]e(?: 1\.1)?"),
    ("busl", "busl", r"busl-1\.1"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e condition)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e"),
    ("confluent", "confluent community", r"confluent community licen[sc]e"),
    ("redis", "redis source available", r"redis source available licen[sc]e"),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?:\+\+)?(?:-m)?"),
    ("rail", "responsible ai licen", r"responsible ai licen[sc]e"),
    ("cdla", "community data license", r"community data license agreement"),
    ("pddl", "public domain dedication and", r"public domain dedication and licen[sc]e"),
    ("ogl", "open government", r"open government licen[sc]e"),
    ("etalab", "licence ouverte", r"licence ouverte(?: / open licence)?"),
    ("cc0", "publicdomain/zero", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc-by-nc-nd", "licenses/by-nc-nd", r"https?://creativecommons\.org/licenses/by-nc-nd/[0-9.]+"),
    ("cc-by-nc-sa", "licenses/by-nc-sa", r"https?://creativecommons\.org/licenses/by-nc-sa/[0-9.]+"),
    ("cc-by-nc", "licenses/by-nc/", r"https?://creativecommons\.org/licenses/by-nc/[0-9.]+"),
    ("cc-by-nd", "licenses/by-nd/", r"https?://creativecommons\.org/licenses/by-nd/[0-9.]+"),
    ("cc-by-sa", "licenses/by-sa/", r"https?://creativecommons\.org/licenses/by-sa/[0-9.]+"),
    ("cc-by", "licenses/by/", r"https?://creativecommons\.org/licenses/by/[0-9.]+"),
    ("cc-by-nc-nd", "noncommercial-noderiv", r"attribution-noncommercial-noderiv(?:ative)?s(?: [0-9.]+)?"),
    ("cc-by-nc-sa", "noncommercial-sharealike", r"attribution-noncommercial-sharealike(?: [0-9.]+)?"),
    ("cc-by-sa", "attribution-sharealike", r"attribution-sharealike(?: [0-9.]+)?"),
    ("cc-by-nd", "attribution-noderiv", r"attribution-noderiv(?:ative)?s(?: [0-9.]+)?"),
    ("cc-by-nc", "attribution-noncommercial", r"attribution-noncommercial(?: [0-9.]+)?"),
    ("gutenberg", "project gutenberg", r"(?:the full )?project gutenberg(?:-tm|™)? licen[sc]e"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("proprietary", "trade secret", r"contains? (?:confidential and )?(?:proprietary )?trade secrets?"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document),? via any medium,? is strictly prohibited"),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?:, distributed)?,? (?:or transmitted )?in any form"),
    ("proprietary", "express written permission", r"without (?:the )?(?:prior )?express written permission of"),
    ("proprietary", "user licen", r"end[-\s]user licen[sc]e agreement"),
]

#: Confidence where a notice says little about terms.
VAGUE = {"proprietary": 0.5, "public-domain": 0.8}

@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    also: bytes
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float


@cache
def rules() -> tuple[Rule, ...]:
    """The rules in order: each family in each form, with each of its versions and without."""
    out = []

    def add(label: str, keyword: str, pattern: str, priority: int, confidence: float, also: str = "") -> None:
        out.append(Rule(label, keyword.encode(), also.encode(), re.compile(rb"(?<![a-z0-9])(?:" + pattern.encode() + rb")(?![a-z0-9])"), priority, confidence))

    for label, keyword, sentence in SENTENCES:
        add(label, keyword, re.sub(" (?![?*])", r"\\s+", sentence), 0, VAGUE.get(label, 0.95))
    for label, keyword, name in [f[:3] for f in FAMILIES]:
        spdx = name.replace(" ", "[ -]?").replace("[\\-[ -]?]", "[\\- ]")
        add(label, "spdx-license-identifier", rf"spdx-license-identifier:\s*(?:{spdx})[a-z0-9.+-]*", 1, 1.0)
        add(label, keyword, rf"(?:licen[sc]ed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?(?:{name})(?:\s+licen[sc]e)?", 3, 0.9, " under ")
        add(label, keyword, rf"(?:{name})\s+licen[sc]e", 4, 0.8, " licen")
        add(label, keyword, rf"licen[sc]e\s*[:=]\s*['\"]?(?:{name})", 3, 0.85, "licen")
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            add(label, keyword, rf"(?:{name})(?:\s+licen[sc]e)?,?\s*(?:v|version\s+|-)?\s*{re.escape(v)}", 2, 0.95)
    return tuple(sorted(out, key=lambda r: r.priority))


@cache
def by_keyword() -> dict[bytes, dict[bytes, list[Rule]]]:
    table: dict[bytes, dict[bytes, list[Rule]]] = {}
    for r in rules():
        table.setdefault(r.keyword, {}).setdefault(r.also, []).append(r)
    return table


def detections(lowered: bytes) -> list[tuple[int, int, str, float]]:
    """Accepted ``(start, end, label, confidence)`` in a lower-case text, by start."""
    blank = b" ".join(lowered.split())
    found = []
    for keyword, forms in by_keyword().items():
        if keyword in blank:
            for r in (r for also, own in forms.items() if also in blank for r in own):
                found += [(r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.confidence) for m in r.pattern.finditer(lowered)]
    return outermost(sorted(found))


def outermost(found: list[tuple[int, int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Detections that lie in none before them in the list, by start.

    A tree of prefixes over the starts holds the furthest end of what is accepted, so n detections take n log n steps.
    """
    starts = sorted({f[2] for f in found})
    furthest = [0] * (len(starts) + 1)
    taken = []
    for _, _, a, b, label, confidence in found:
        place = k = bisect_left(starts, a) + 1
        end = 0
        while k:
            end = max(end, furthest[k])
            k &= k - 1
        if end >= b:
            continue
        taken.append((a, b, label, confidence))
        k = place
        while k < len(furthest):
            furthest[k] = max(furthest[k], b)
            k += k & -k
    return sorted(taken)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word index and label of every place where a base phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in BASE_PHRASES.items():
        padded = b" " + phrase + b" "
        at = joined.find(padded)
        while at >= 0:
            places.append((joined.count(b" ", 0, at), label))
            at = joined.find(padded, at + 1)
    return places


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,confidence:double>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, base places, labels, score (the surest detection; 0 if none) and the detections' byte spans."""
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in as_bytes(piece.column("__text")):
            low = text.lower()
            words = text.translate(WORD_BYTES).split()
            places = base_places(words) if b"license" in low else []
            found = detections(low)
            base = {x for _, x in places}
            starts = [i for i, _ in places]
            score = max([0.0, *(c for *_, c in found), *([0.8] if base else [])])
            rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in found})), score, [dict(zip(("start", "end", "label", "confidence"), x, strict=True)) for x in found]))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["__id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([piece.column("__id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return map_slices(keyed_text(df, id_col, text_col), run, f"__id {kind}, {SCHEMA}")

"""Operator 7: license scan by ordered signature rules.

A text's ASCII letters are lower-cased and it is read as a sequence of words (digits, letters and
everything beyond ASCII), so line breaks and punctuation don't matter. Base phrases are found at every
place where their words stand in a row. Hundreds of rules, each a pattern over the words with a keyword,
a priority and a label, then look for licenses by identifier, grant, title, short name and notice: a rule only runs on texts
that hold its keyword. Of overlapping detections one that lies inside another of the same or a better
priority is dropped.

Null and empty texts have no words and no labels (empty strings), no first and last word (null) and
score 0. The score is that of the surest detection. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: What stands for common parts of the rules: the word, a version, an optional one, a grant, an SPDX line up to an identifier (``at``: where
#: the detection starts, if other identifiers stand before it).
MACROS = {
    "l": r"licen[sc]e",
    "v": r"(?:version |v ?)?[0-9]+(?: [0-9]+){0,2}(?: only| or later)?",
    "w": r"(?: (?:version |v ?)?[0-9]+(?: [0-9]+){0,2}(?: only| or later)?)?",
    "g": r"(?:(?:licen[sc]ed|released|distributed|published|provided|covered|governed|available|issued|offered) (?:under|by)|under the (?:terms|conditions) (?:and conditions )?of|subject to|accordance with|compliance with|copy of|terms of|text of) "
    r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?",
    "s": r"spdx license identifier (?:[0-9a-z ]{1,40} (?:or|and|with) (?P<at>))?",
}
# Fixed values, a rule in each line: priority (the least wins), score in percent, label, a keyword that every match holds, pattern over words.
RULES = r"""
0 100 agpl | agpl | {s}agpl {v}
0 100 lgpl | lgpl | {s}lgpl {v}
0 100 gpl | identifier gpl | spdx license identifier gpl {v}
0 100 gfdl | gfdl | {s}gfdl {v}
0 100 apache | identifier apache | spdx license identifier apache {v}
0 98 apache | apache 2 0 | {s}apache 2 0
0 100 mit | identifier mit | spdx license identifier mit(?: 0| cmu| modern variant)?
0 98 mit | mit | spdx license identifier [0-9a-z ]{1,40} (?:or|and) mit
0 100 bsd | identifier bsd | spdx license identifier bsd [0-4] clause(?: clear| patent| views)?
0 98 bsd | clause | {s}bsd [0-4] clause
0 100 isc | identifier isc | spdx license identifier isc
0 100 mpl | mpl | {s}mpl {v}
0 100 epl | epl | {s}epl {v}
0 100 cddl | cddl | {s}cddl {v}
0 100 cpl | identifier cpl | spdx license identifier cpl {v}
0 100 eupl | eupl | {s}eupl {v}
0 100 ofl | ofl | {s}ofl {v}
0 100 boost | bsl 1 0 | {s}bsl 1 0
0 100 zlib | identifier zlib | spdx license identifier zlib(?: acknowledgement)?
0 100 artistic | identifier artistic | spdx license identifier artistic {v}
0 100 wtfpl | wtfpl | {s}wtfpl
0 100 unlicense | identifier unlicense | spdx license identifier unlicense
0 100 postgresql | identifier postgresql | spdx license identifier postgresql
0 100 python | identifier psf | spdx license identifier psf {v}
0 100 python | python 2 0 | {s}python 2 0
0 100 ncsa | identifier ncsa | spdx license identifier ncsa
0 100 ms-pl | ms pl | {s}ms pl
0 100 ms-rl | ms rl | {s}ms rl
0 100 odbl | odbl | {s}odbl {v}
0 100 odc-by | odc by | {s}odc by {v}
0 100 pddl | pddl | {s}pddl {v}
0 100 cc0 | cc0 | {s}cc0 {v}
0 100 cc-by-nc-nd | cc by nc nd | {s}cc by nc nd {v}
0 100 cc-by-nc-sa | cc by nc sa | {s}cc by nc sa {v}
0 100 cc-by-nc | cc by nc | {s}cc by nc {v}
0 100 cc-by-sa | cc by sa | {s}cc by sa {v}
0 100 cc-by-nd | cc by nd | {s}cc by nd {v}
0 100 cc-by | cc by | {s}cc by {v}
0 100 afl | identifier afl | spdx license identifier afl {v}
0 100 osl | identifier osl | spdx license identifier osl {v}
0 100 bsl | busl | {s}busl {v}
0 100 sspl | sspl | {s}sspl {v}
0 100 elastic | elastic 2 0 | {s}elastic 2 0
0 100 upl | identifier upl | spdx license identifier upl {v}
0 100 ecl | identifier ecl | spdx license identifier ecl {v}
0 100 cecill | cecill | {s}cecill(?: [0-9] [0-9]| b| c)?
0 100 mulan | mulanpsl | {s}mulanpsl {v}
0 100 blueoak | blueoak | {s}blueoak 1 0 0
0 100 0bsd | 0bsd | {s}0bsd
0 100 openssl | identifier openssl | spdx license identifier openssl
0 100 php | identifier php | spdx license identifier php {v}
0 100 ruby | identifier ruby | spdx license identifier ruby
0 100 vim | identifier vim | spdx license identifier vim
0 100 x11 | identifier x11 | spdx license identifier x11
0 100 zpl | identifier zpl | spdx license identifier zpl {v}
0 100 w3c | identifier w3c | spdx license identifier w3c
0 100 curl | identifier curl | spdx license identifier curl
0 100 hpnd | hpnd | {s}hpnd
1 98 agpl | affero | {g}(?:gnu )?affero general public {l}(?: as published by the free software foundation)?
1 98 lgpl | lesser general public | {g}(?:gnu )?lesser general public {l}(?: as published by the free software foundation)?
1 98 lgpl | library general public | {g}(?:gnu )?library general public {l}(?: as published by the free software foundation)?
1 98 gpl | gnu general public | {g}gnu general public {l}(?: as published by the free software foundation)?
1 98 gpl | general public | {g}general public {l}{w}
1 97 gpl | redistribute it and or modify | redistribute it and or modify it under the terms of the gnu general public {l}
1 97 lgpl | redistribute it and or modify | redistribute it and or modify it under the terms of the gnu lesser general public {l}
1 97 agpl | redistribute it and or modify | redistribute it and or modify it under the terms of the gnu affero general public {l}
1 98 gfdl | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {l}
1 98 apache | apache | {g}apache(?: software)? {l}{w}
1 98 apache | apache | you may not use this file except in compliance with the {l} you may obtain a copy of the {l} at http www apache org
1 98 mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
1 98 mit | mit licen | {g}mit {l}{w}
1 97 mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
1 98 bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
1 95 bsd | neither the name | neither the name of [0-9a-z ]{1,60} nor the names of its contributors may be used to endorse or promote products
1 95 bsd | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions
1 95 bsd | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
1 98 bsd | bsd | {g}(?:[0-4] clause |new |modified |simplified |revised |original )?bsd(?: [0-4] clause)?(?: style)? {l}{w}
1 98 isc | permission to use copy modify | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided
1 98 isc | isc licen | {g}isc {l}{w}
1 98 0bsd | permission to use copy modify | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
1 98 mpl | mozilla | subject to the terms of the mozilla public {l}
1 98 mpl | mozilla | {g}mozilla public {l}{w}
1 97 mpl | mozilla | contents of this file are subject to the mozilla public {l}
1 98 epl | eclipse | {g}eclipse public {l}{w}
1 97 epl | eclipse | made available under the terms of the eclipse public {l}
1 98 edl | eclipse distribution | {g}eclipse distribution {l}{w}
1 98 cddl | common development | {g}common development and distribution {l}{w}
1 97 cddl | common development | contents of this file are subject to the terms of the common development and distribution {l}
1 98 cpl | common public | {g}common public {l}{w}
1 98 eupl | european union public | {g}european union public {l}{w}
1 98 boost | boost software | {g}boost software {l}{w}
1 98 boost | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy
1 98 zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented
1 96 zlib | origin of this software | the origin of this software must not be misrepresented
1 98 zlib | zlib | {g}zlib(?: libpng)? {l}{w}
1 98 artistic | artistic | {g}(?:perl )?artistic {l}{w}
1 97 artistic | same terms as perl | under the same terms as perl(?: itself)?
1 98 wtfpl | do what the fuck | do what the fuck you want to public {l}
1 98 unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 98 postgresql | postgresql licen | {g}postgresql {l}{w}
1 98 python | python software foundation | {g}python software foundation {l}{w}
1 96 python | psf licen | {g}psf {l}{w}
1 98 ofl | open font | {g}(?:sil )?open font {l}{w}
1 98 ncsa | ncsa | {g}university of illinois ncsa open source {l}{w}
1 98 ms-pl | microsoft public | {g}microsoft public {l}{w}
1 98 ms-rl | microsoft reciprocal | {g}microsoft reciprocal {l}{w}
1 98 odbl | open database | {g}open (?:data commons open )?database {l}{w}
1 98 odc-by | open data commons attribution | {g}open data commons attribution {l}{w}
1 98 pddl | public domain dedication and licen | {g}open data commons public domain dedication and {l}{w}
1 98 cc0 | cc0 | {g}cc0(?: {v})?(?: universal)?
1 98 cc0 | creative commons zero | {g}creative commons zero(?: {l})?
1 98 cc-by-nc-nd | noncommercial noderiv | {g}creative commons attribution noncommercial noderiv(?:ative)?s
1 98 cc-by-nc-nd | non commercial no deriv | {g}creative commons attribution non commercial no deriv(?:ative)?s
1 98 cc-by-nc-sa | noncommercial sharealike | {g}creative commons attribution noncommercial sharealike
1 98 cc-by-nc-sa | non commercial share alike | {g}creative commons attribution non commercial share alike
1 98 cc-by-nc | attribution noncommercial | {g}creative commons attribution noncommercial
1 98 cc-by-nc | attribution non commercial | {g}creative commons attribution non commercial
1 98 cc-by-sa | attribution sharealike | {g}creative commons attribution sharealike
1 98 cc-by-sa | attribution share alike | {g}creative commons attribution share alike
1 98 cc-by-nd | attribution noderiv | {g}creative commons attribution noderiv(?:ative)?s
1 98 cc-by-nd | attribution no deriv | {g}creative commons attribution no deriv(?:ative)?s
1 98 cc-by | creative commons attribution | {g}creative commons attribution(?: {v})?(?: international| unported| generic)?
1 98 afl | academic free | {g}academic free {l}{w}
1 98 osl | open software licen | {g}open software {l}{w}
1 98 bsl | business source | {g}business source {l}{w}
1 98 sspl | server side public | {g}server side public {l}{w}
1 98 elastic | elastic licen | {g}elastic {l}{w}
1 97 commons-clause | commons clause | (?:subject to the following condition the|the) commons clause {l} condition
1 98 upl | universal permissive | {g}universal permissive {l}{w}
1 98 ecl | educational community | {g}educational community {l}{w}
1 98 cecill | cecill | {g}cecill(?: [abc])?(?: {l})?
1 98 mulan | mulan | {g}mulan psl(?: {v})?
1 98 openssl | openssl | {g}openssl {l}{w}
1 97 openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
1 98 php | php licen | {g}php {l}{w}
1 98 ruby | ruby licen | {g}ruby {l}{w}
1 98 vim | vim licen | {g}vim {l}{w}
1 98 x11 | x11 licen | {g}x11 {l}{w}
1 98 zpl | zope public | {g}zope public {l}{w}
1 98 w3c | w3c software | {g}w3c software(?: notice and)? {l}{w}
1 98 ibm-pl | ibm public | {g}ibm public {l}{w}
1 98 npl | netscape public | {g}netscape public {l}{w}
1 98 apsl | apple public source | {g}apple public source {l}{w}
1 98 qpl | q public | {g}q public {l}{w}
1 98 lppl | latex project public | {g}latex project public {l}{w}
1 98 sleepycat | sleepycat | {g}sleepycat {l}{w}
1 98 openldap | openldap public | {g}openldap public {l}{w}
1 98 hpnd | historical permission | {g}historical permission notice and disclaimer
1 98 beerware | beer ware | the beer ware {l} revision [0-9]+
1 97 json | shall be used for good | the software shall be used for good not evil
1 98 polyform | polyform | {g}polyform (?:noncommercial|shield|small business|strict|perimeter|free trial|internal use) {l}{w}
1 98 openrail | openrail | {g}(?:bigscience |creativeml |bigcode )?openrail(?: m)?
1 98 llama | llama | {g}llama [0-9]+(?: [0-9]+)? community {l}{w}
1 98 ogl | open government | {g}open government {l}{w}
2 95 agpl | gnu affero general public | gnu affero general public {l}{w}
2 95 lgpl | gnu lesser general public | gnu lesser general public {l}{w}
2 95 lgpl | gnu library general public | gnu library general public {l}{w}
2 95 gpl | gnu general public | gnu general public {l}{w}
2 95 gfdl | gnu free documentation | gnu free documentation {l}{w}
2 95 apache | apache licen | apache {l} version [12] [01]
2 95 apache | apache software licen | apache software {l}{w}
2 95 mit | mit licen | (?:the )?mit {l}
2 95 mit | x11 mit | x11 mit {l}
2 95 mit | expat | expat {l}
2 95 mpl | mozilla public | mozilla public {l}{w}
2 95 epl | eclipse public | eclipse public {l}{w}
2 95 cddl | common development and distribution | common development and distribution {l}{w}
2 95 cpl | common public licen | common public {l}{w}
2 95 eupl | european union public | european union public {l}{w}
2 95 boost | boost software | boost software {l}{w}
2 95 artistic | artistic licen | (?:the )?(?:perl |clarified )?artistic {l}{w}
2 95 ofl | open font | sil open font {l}{w}
2 95 ms-pl | microsoft public | microsoft public {l}
2 95 ms-rl | microsoft reciprocal | microsoft reciprocal {l}
2 95 odbl | open database licen | open database {l}{w}
2 95 odc-by | open data commons attribution | open data commons attribution {l}{w}
2 95 pddl | public domain dedication and licen | public domain dedication and {l}{w}
2 95 cc0 | cc0 1 0 | cc0 1 0(?: universal)?
2 95 cc-by-nc-nd | noncommercial noderiv | creative commons attribution noncommercial noderiv(?:ative)?s(?: {v})?
2 95 cc-by-nc-nd | non commercial no deriv | creative commons attribution non commercial no deriv(?:ative)?s(?: {v})?
2 95 cc-by-nc-sa | noncommercial sharealike | creative commons attribution noncommercial sharealike(?: {v})?
2 95 cc-by-nc-sa | non commercial share alike | creative commons attribution non commercial share alike(?: {v})?
2 95 cc-by-nc | attribution noncommercial | creative commons attribution noncommercial(?: {v})?
2 95 cc-by-nc | attribution non commercial | creative commons attribution non commercial(?: {v})?
2 95 cc-by-sa | attribution sharealike | creative commons attribution sharealike(?: {v})?
2 95 cc-by-sa | attribution share alike | creative commons attribution share alike(?: {v})?
2 95 cc-by-nd | attribution noderiv | creative commons attribution noderiv(?:ative)?s(?: {v})?
2 95 cc-by-nd | attribution no deriv | creative commons attribution no deriv(?:ative)?s(?: {v})?
2 95 cc-by | creative commons attribution | creative commons attribution(?: {l})?(?: {v})?
2 95 cc0 | creative commons zero | creative commons zero(?: {l}| {v})?
2 95 python | python software foundation | python software foundation {l}{w}
2 95 ncsa | illinois | university of illinois ncsa open source {l}
2 95 bsl | business source | business source {l}{w}
2 95 sspl | server side public | server side public {l}{w}
2 95 zpl | zope public | zope public {l}{w}
2 95 lppl | latex project public | latex project public {l}{w}
2 95 upl | universal permissive | universal permissive {l}{w}
2 95 osl | open software licen | open software {l} {v}
2 95 afl | academic free | academic free {l}{w}
3 90 agpl | agpl | (?:gnu )?agpl(?: {l}| {v}|v[0-9]+)
3 90 agpl | agpl | {g}(?:gnu )?agpl(?:v?[0-9]+| {v})?
3 90 lgpl | lgpl | (?:gnu )?lgpl(?: {l}| {v}|v[0-9]+)
3 90 lgpl | lgpl | {g}(?:gnu )?lgpl(?:v?[0-9]+| {v})?
3 90 gpl | gpl | gnu gpl(?:v[0-9]+)?
3 90 gpl | gpl | gpl(?: {l}| {v}|v[0-9]+)
3 90 gpl | gpl | {g}gpl(?:v?[0-9]+| {v})?
3 90 gfdl | gfdl | gfdl(?: {l}| {v})
3 90 apache | apache | apache(?: {l}| 2 0| v2)
3 90 apache | asl 2 0 | asl 2 0
3 90 bsd | bsd | bsd(?: style)? {l}
3 90 bsd | bsd | (?:[0-4]|two|three|four) clause bsd(?: {l})?
3 90 bsd | bsd | bsd (?:[0-4]|two|three|four) clause(?: {l})?
3 90 isc | isc licen | isc {l}
3 90 mpl | mpl | mpl(?: {l}| {v}|v[0-9]+)
3 90 epl | epl | epl (?:{l}|{v})
3 90 cddl | cddl | cddl(?: {l}| {v}|v[0-9]+)
3 90 eupl | eupl | eupl(?: {l}| {v})
3 90 boost | boost licen | boost {l}
3 90 zlib | zlib licen | zlib {l}
3 90 zlib | libpng | libpng {l}
3 90 wtfpl | wtfpl | wtfpl
3 90 unlicense | the unlicense | the unlicense
3 90 postgresql | postgresql licen | postgresql {l}
3 90 python | psf licen | psf {l}
3 90 ofl | ofl | ofl (?:{l}|{v})
3 90 ncsa | ncsa licen | ncsa {l}
3 90 odbl | odbl | odbl(?: {v})?
3 90 cc0 | cc0 | cc0(?: {l}| {v})?
3 90 cc-by-nc-nd | cc by nc nd | cc by nc nd(?: {v})?
3 90 cc-by-nc-sa | cc by nc sa | cc by nc sa(?: {v})?
3 90 cc-by-nc | cc by nc | cc by nc(?: {v})?
3 90 cc-by-sa | cc by sa | cc by sa(?: {v})?
3 90 cc-by-nd | cc by nd | cc by nd(?: {v})?
3 90 cc-by | cc by | cc by(?: {v})?
3 90 cc-by-nc-nd | by nc nd | (?:licen[sc]es|org) by nc nd(?: {v})?
3 90 cc-by-nc-sa | by nc sa | (?:licen[sc]es|org) by nc sa(?: {v})?
3 90 cc-by-sa | by sa | (?:licen[sc]es|org) by sa(?: {v})?
3 90 sspl | sspl | sspl(?: {l}| {v}|v[0-9]+)
3 90 x11 | x11 licen | x11 {l}
3 90 openssl | openssl licen | openssl {l}
3 90 php | php licen | php {l}(?: {v})?
3 90 ruby | ruby s licen | ruby s {l}
3 90 curl | curl licen | curl {l}
3 90 vim | vim licen | vim {l}
3 90 llama | llama | llama [0-9]+(?: [0-9]+)? community {l}
3 90 openrail | openrail | openrail(?: m)?(?: {l})?
3 90 elastic | elastic licen | elastic {l}(?: {v})?
3 90 w3c | w3c licen | w3c {l}
4 80 public-domain | public domain | (?:released|placed|dedicated|donated) (?:into|in|to) the public domain
4 80 public-domain | public domain | (?:is|are|all) in the public domain
4 80 public-domain | public domain | public domain (?:dedication|software|work)
5 70 all-rights-reserved | all rights reserved | all rights reserved
5 70 proprietary | proprietary | proprietary and confidential
5 70 proprietary | proprietary | confidential and proprietary
5 70 proprietary | trade secret | contains trade secrets? (?:and|or) proprietary information
5 70 proprietary | end user licen | end user {l} agreement
5 70 non-commercial | commercial use | for non ?commercial use only
5 70 non-commercial | commercial use | not for commercial use
"""


class Rule(NamedTuple):
    priority: int
    score: float
    label: str
    keyword: bytes
    pattern: re.Pattern


def signature_rules(macros: dict[str, str] = MACROS) -> list[Rule]:
    """All rules, the best priority first."""
    out = []
    for line in RULES.strip().split("\n"):
        head, keyword, pattern = line.split(" | ")
        priority, percent, label = head.split(" ")
        for name, part in macros.items():
            pattern = pattern.replace(f"{{{name}}}", part)
        out.append(Rule(int(priority), int(percent) / 100, label, keyword.encode(), words_pattern(pattern)))
    return sorted(out, key=lambda r: (r.priority, -r.score, r.label, r.pattern.pattern))


def words_pattern(pattern: str) -> re.Pattern:
    """A pattern that starts and ends at whole words."""
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


@lru_cache(maxsize=1)
def compiled() -> tuple[list[tuple[re.Pattern, str]], dict[bytes, list[Rule]]]:
    by_keyword: dict[bytes, list[Rule]] = {}
    for rule in signature_rules():
        by_keyword.setdefault(rule.keyword, []).append(rule)
    return [(words_pattern(phrase), label) for phrase, label in BASE], by_keyword


class Detection(NamedTuple):
    priority: int
    start: int
    end: int
    score: float
    label: str


def matches(words: bytes) -> list[Detection]:
    """All that the rules find in space-joined words, whose keyword the words hold."""
    found = []
    for keyword, rules in compiled()[1].items():
        if keyword in words:
            for r in rules:
                named = "at" in r.pattern.groupindex
                for m in r.pattern.finditer(words):
                    found.append(Detection(r.priority, m.start("at") if named and m["at"] is not None else m.start(), m.end(), r.score, r.label))
    return found


def detections(words: bytes) -> list[Detection]:
    """The matches (places in bytes) that none of the same or a better priority contains."""
    found = sorted(matches(words), key=lambda d: (d.priority, d.start - d.end, d.start, d.label))
    kept: list[Detection] = []
    starts: list[int] = []  # of kept, ascending
    widest = 0
    for d in found:
        near = kept[bisect_left(starts, d.start - widest) : bisect_right(starts, d.start)]
        if not any(x.end >= d.end for x in near):
            at = bisect_right(starts, d.start)
            starts.insert(at, d.start)
            kept.insert(at, d)
            widest = max(widest, d.end - d.start)
    return kept


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = WORD.findall(text.encode().lower())
    joined = b" ".join(words)
    base, _ = compiled()
    places, labels = [], set()
    for pattern, label in base:
        for m in pattern.finditer(joined):
            places.append(m.start())
            labels.add(label)
    found = detections(joined)
    first = joined.count(b" ", 0, min(places)) if places else None
    last = joined.count(b" ", 0, max(places)) if places else None
    score = max([0.9 if places else 0.0, *(d.score for d in found)])
    return len(words), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {d.label for d in found})), score


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels, score of every text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in texts(batch, "__text")]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*keep, *names])

    return map_rows(
        docs.select(*keep, docs[text].alias("__text")),
        run,
        f"{fields}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    )

"""License scans by ordered signature rules.

Each license has hand-written patterns for its name, identifier and address;
``rules()`` turns them into some hundreds of ordered regexes.  A keyword
automaton decides which rules run on a text.  Of overlapping detections one
that lies inside another of at least its priority goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _parser
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import hash_words, slabs, string_buffers

#: Phrases whose words stand consecutively, and the labels they give.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_V = r"[\s,(]*(?:version|ver\.?|v\.?)?\s*"
# label, keyword, name pattern, address pattern or "": one license a line, the more specific versions first.
_SIGNATURES = r"""
gpl-3.0-or-later | general public | gnu\s+general\s+public\s+licen[sc]e{v}3(?:\.0)?\W+(?:or|and)\s+(?:\(?at\s+your\s+option\)?\s+)?any\s+later |
gpl-3.0 | general public | (?:gnu\s+)?general\s+public\s+licen[sc]e{v}3(?:\.0)?\b | gnu\.org/licenses/gpl-3
gpl-2.0-or-later | general public | gnu\s+general\s+public\s+licen[sc]e{v}2(?:\.0)?\W+(?:or|and)\s+(?:\(?at\s+your\s+option\)?\s+)?any\s+later |
gpl-2.0 | general public | (?:gnu\s+)?general\s+public\s+licen[sc]e{v}2(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-2
gpl-1.0 | general public | (?:gnu\s+)?general\s+public\s+licen[sc]e{v}1(?:\.0)?\b | gnu\.org/licenses/old-licenses/gpl-1
lgpl-3.0 | lesser general | (?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{v}3(?:\.0)?\b | gnu\.org/licenses/lgpl-3
lgpl-2.1 | lesser general | (?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{v}2\.1\b | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-2.0 | library general | (?:gnu\s+)?library\s+general\s+public\s+licen[sc]e{v}2(?:\.0)?\b | gnu\.org/licenses/old-licenses/lgpl-2\.0
lgpl | lesser general | (?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e\b | gnu\.org/licenses/lgpl
agpl-3.0 | affero | (?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e{v}3(?:\.0)?\b | gnu\.org/licenses/agpl-3
agpl-1.0 | affero | affero\s+general\s+public\s+licen[sc]e{v}1(?:\.0)?\b | affero\.org/oagpl
agpl | affero | (?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e\b | gnu\.org/licenses/agpl
gpl | general public | (?:gnu\s+)?general\s+public\s+licen[sc]e\b | gnu\.org/licenses/gpl
gfdl-1.3 | documentation license | gnu\s+free\s+documentation\s+licen[sc]e{v}1\.3\b | gnu\.org/licenses/fdl-1\.3
gfdl-1.2 | documentation license | gnu\s+free\s+documentation\s+licen[sc]e{v}1\.2\b | gnu\.org/licenses/old-licenses/fdl-1\.2
gfdl | documentation license | gnu\s+free\s+documentation\s+licen[sc]e\b | gnu\.org/licenses/fdl
apache-2.0 | apache | apache(?:\s+software)?\s+licen[sc]e{v}2(?:\.0)?\b | apache\.org/licenses/license-2\.0
apache-1.1 | apache | apache(?:\s+software)?\s+licen[sc]e{v}1\.1\b | apache\.org/licenses/license-1\.1
apache-1.0 | apache | apache(?:\s+software)?\s+licen[sc]e{v}1(?:\.0)?\b(?!\.) | apache\.org/licenses/license-1\.0
apache | apache | apache(?:\s+software)?\s+licen[sc]e\b | apache\.org/licenses
mit-0 | no attribution | mit\s+no\s+attribution(?:\s+licen[sc]e)?\b | opensource\.org/licenses/mit-0
mit | mit | \b(?:the\s+)?mit[\s/-]+licen[sc]e\b | opensource\.org/licenses/mit\b
x11 | x11 | \bx11\s+licen[sc]e\b | opensource\.org/licenses/x11
expat | expat | \bexpat\s+licen[sc]e\b | directory\.fsf\.org/wiki/license:expat
bsd-4-clause | bsd | \b(?:4|four)[\s-]+clause\s+bsd\b|\boriginal\s+bsd\s+licen[sc]e\b | spdx\.org/licenses/bsd-4-clause
bsd-3-clause | bsd | \b(?:3|three)[\s-]+clause\s+bsd\b|\bnew\s+bsd\s+licen[sc]e\b|\bmodified\s+bsd\s+licen[sc]e\b | opensource\.org/licenses/bsd-3-clause
bsd-2-clause | bsd | \b(?:2|two)[\s-]+clause\s+bsd\b|\bsimplified\s+bsd\s+licen[sc]e\b|\bfreebsd\s+licen[sc]e\b | opensource\.org/licenses/bsd-2-clause
0bsd | bsd | \b(?:0|zero)[\s-]+clause\s+bsd\b | opensource\.org/licenses/0bsd
bsd | bsd | \bbsd(?:[\s-]+style)?\s+licen[sc]e\b | opensource\.org/licenses/bsd-license
isc | isc | \bisc\s+licen[sc]e\b | opensource\.org/licenses/isc
mpl-2.0 | mozilla | mozilla\s+public\s+licen[sc]e{v}2(?:\.0)?\b | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mozilla | mozilla\s+public\s+licen[sc]e{v}1\.1\b | mozilla\.org/(?:en-us/)?mpl/1\.1
mpl-1.0 | mozilla | mozilla\s+public\s+licen[sc]e{v}1\.0\b | mozilla\.org/(?:en-us/)?mpl/1\.0
mpl | mozilla | mozilla\s+public\s+licen[sc]e\b | mozilla\.org/mpl
epl-2.0 | eclipse | eclipse\s+public\s+licen[sc]e{v}2(?:\.0)?\b | eclipse\.org/legal/epl-2\.0|eclipse\.org/org/documents/epl-2\.0
epl-1.0 | eclipse | eclipse\s+public\s+licen[sc]e{v}1(?:\.0)?\b | eclipse\.org/legal/epl-v10
edl-1.0 | eclipse | eclipse\s+distribution\s+licen[sc]e\b | eclipse\.org/org/documents/edl-v10
cddl-1.1 | common development | common\s+development\s+and\s+distribution\s+licen[sc]e{v}1\.1\b | spdx\.org/licenses/cddl-1\.1
cddl-1.0 | common development | common\s+development\s+and\s+distribution\s+licen[sc]e(?:{v}1\.0)?\b | opensource\.org/licenses/cddl-1\.0
cpl-1.0 | common public | common\s+public\s+licen[sc]e\b | opensource\.org/licenses/cpl1\.0
ipl-1.0 | ibm public | ibm\s+public\s+licen[sc]e\b | opensource\.org/licenses/ibmpl
eupl-1.2 | european union | european\s+union\s+public\s+licen[sc]e{v}1\.2\b | joinup\.ec\.europa\.eu/[^\s]*eupl-text-eupl-12
eupl-1.1 | european union | european\s+union\s+public\s+licen[sc]e{v}1\.1\b | spdx\.org/licenses/eupl-1\.1
eupl | european union | european\s+union\s+public\s+licen[sc]e\b | joinup\.ec\.europa\.eu/[^\s]*eupl
cecill-2.1 | cecill | \bcecill{v}2\.1\b | cecill\.info/licences/licence_cecill_v2\.1
cecill-b | cecill | \bcecill-b\b | cecill\.info/licences/licence_cecill-b
cecill-c | cecill | \bcecill-c\b | cecill\.info/licences/licence_cecill-c
artistic-2.0 | artistic | artistic\s+licen[sc]e{v}2(?:\.0)?\b | opensource\.org/licenses/artistic-2\.0
artistic-1.0 | artistic | artistic\s+licen[sc]e(?:{v}1\.0)?\b | opensource\.org/licenses/artistic-1\.0
zlib | zlib | \bzlib(?:/libpng)?\s+licen[sc]e\b | opensource\.org/licenses/zlib
libpng | libpng | \blibpng\s+licen[sc]e\b | libpng\.org/pub/png/src/libpng-license
bsl-1.0 | boost | boost\s+software\s+licen[sc]e\b | boost\.org/license_1_0
unlicense | unlicense | \bthe\s+unlicense\b | unlicense\.org
wtfpl | wtfpl | \bwtfpl\b|do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[sc]e | wtfpl\.net
cc0-1.0 | cc0 | \bcc0(?:[\s-]+1\.0)?\b(?:\s+universal)? | creativecommons\.org/publicdomain/zero
public-domain | public domain | (?:released|placed|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain | creativecommons\.org/publicdomain/mark
cc-by-nc-nd-4.0 | cc | \bcc[\s-]+by[\s-]+nc[\s-]+nd[\s-]+4\.0\b | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | cc | \bcc[\s-]+by[\s-]+nc[\s-]+nd[\s-]+3\.0\b | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-sa-4.0 | cc | \bcc[\s-]+by[\s-]+nc[\s-]+sa[\s-]+4\.0\b | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | cc | \bcc[\s-]+by[\s-]+nc[\s-]+sa[\s-]+3\.0\b | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-4.0 | cc | \bcc[\s-]+by[\s-]+nc[\s-]+4\.0\b | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | cc | \bcc[\s-]+by[\s-]+nc[\s-]+3\.0\b | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc | cc | \bcc[\s-]+by[\s-]+nc\b | creativecommons\.org/licenses/by-nc
cc-by-nd-4.0 | cc | \bcc[\s-]+by[\s-]+nd[\s-]+4\.0\b | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd-3.0 | cc | \bcc[\s-]+by[\s-]+nd[\s-]+3\.0\b | creativecommons\.org/licenses/by-nd/3\.0
cc-by-sa-4.0 | cc | \bcc[\s-]+by[\s-]+sa[\s-]+4\.0\b | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | cc | \bcc[\s-]+by[\s-]+sa[\s-]+3\.0\b | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-2.5 | cc | \bcc[\s-]+by[\s-]+sa[\s-]+2\.5\b | creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa | cc | \bcc[\s-]+by[\s-]+sa\b | creativecommons\.org/licenses/by-sa
cc-by-4.0 | cc | \bcc[\s-]+by[\s-]+4\.0\b | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | cc | \bcc[\s-]+by[\s-]+3\.0\b | creativecommons\.org/licenses/by/3\.0
cc-by-2.0 | cc | \bcc[\s-]+by[\s-]+2\.0\b | creativecommons\.org/licenses/by/2\.0
cc-by | cc | \bcc[\s-]+by\b | creativecommons\.org/licenses/by
creative-commons | creative | creative\s+commons(?:\s+\w+){{0,4}}\s+licen[sc]e\b | creativecommons\.org
odbl-1.0 | open database | open\s+database\s+licen[sc]e\b | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open data commons | open\s+data\s+commons\s+attribution\s+licen[sc]e\b | opendatacommons\.org/licenses/by
pddl-1.0 | public domain dedication | public\s+domain\s+dedication\s+and\s+licen[sc]e\b | opendatacommons\.org/licenses/pddl
ogl-uk-3.0 | government | open\s+government\s+licen[sc]e{v}3(?:\.0)?\b | nationalarchives\.gov\.uk/doc/open-government-licence/version/3
ogl | government | open\s+government\s+licen[sc]e\b | nationalarchives\.gov\.uk/doc/open-government-licence
ofl-1.1 | sil open | sil\s+open\s+font\s+licen[sc]e\b | scripts\.sil\.org/ofl
python-2.0 | python | python(?:\s+software\s+foundation)?\s+licen[sc]e\b | docs\.python\.org/[^\s]*license
php-3.01 | php | \bphp\s+licen[sc]e{v}3\.01\b | php\.net/license/3_01
php | php | \bphp\s+licen[sc]e\b | php\.net/license
ruby | ruby | \bruby(?:'s)?\s+licen[sc]e\b | ruby-lang\.org/[^\s]*license
perl | perl | same\s+terms\s+as\s+perl(?:\s+itself)? | dev\.perl\.org/licenses
vim | vim | \bvim\s+licen[sc]e\b | vimhelp\.org/uganda
openssl | openssl | \bopenssl\s+licen[sc]e\b | openssl\.org/source/license
ms-pl | microsoft | microsoft\s+public\s+licen[sc]e\b | opensource\.org/licenses/ms-pl
ms-rl | microsoft | microsoft\s+reciprocal\s+licen[sc]e\b | opensource\.org/licenses/ms-rl
apsl-2.0 | apple | apple\s+public\s+source\s+licen[sc]e\b | opensource\.apple\.com/license/apsl
ncsa | ncsa | \bncsa\s+(?:open\s+source\s+)?licen[sc]e\b | opensource\.org/licenses/ncsa
w3c | w3c | \bw3c\s+(?:software\s+(?:notice\s+and\s+)?)?licen[sc]e\b | w3\.org/consortium/legal
postgresql | postgresql | \bpostgresql\s+licen[sc]e\b | postgresql\.org/about/licence
afl-3.0 | academic free | academic\s+free\s+licen[sc]e\b | opensource\.org/licenses/afl-3\.0
osl-3.0 | open software | open\s+software\s+licen[sc]e\b | opensource\.org/licenses/osl-3\.0
qpl-1.0 | q public | \bq\s+public\s+licen[sc]e\b | opensource\.org/licenses/qtpl
lppl-1.3c | latex project | latex\s+project\s+public\s+licen[sc]e\b | latex-project\.org/lppl
upl-1.0 | universal permissive | universal\s+permissive\s+licen[sc]e\b | opensource\.org/licenses/upl
mulanpsl-2.0 | mulan | mulan\s+permissive\s+software\s+licen[sc]e\b | license\.coscl\.org\.cn/mulanpsl2
blueoak-1.0.0 | blue oak | blue\s+oak\s+model\s+licen[sc]e\b | blueoakcouncil\.org/license
sspl-1.0 | server side | server\s+side\s+public\s+licen[sc]e\b | mongodb\.com/licensing/server-side-public-license
busl-1.1 | business source | business\s+source\s+licen[sc]e\b | mariadb\.com/bsl11
elastic-2.0 | elastic | \belastic\s+licen[sc]e\b | elastic\.co/licensing/elastic-license
openrail | openrail | \b(?:big(?:science|code)\s+)?open\s?rail(?:-m|\+\+)?\s+licen[sc]e\b | bigscience\.huggingface\.co/blog/the-bigscience-rail-license
json | json | \bjson\s+licen[sc]e\b | json\.org/license
beerware | beer | \bbeer-?ware(?:\s+licen[sc]e)?\b | spdx\.org/licenses/beerware
proprietary | reserved | \ball\s+rights\s+reserved\b |
copyleft | copyleft | \bcopyleft\b | fsf\.org/licensing/essays/copyleft
"""
# label, words of the license's own text that stand in a row; one a line.
_TEXTS = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy
boost | permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy
x11 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | may be used to endorse or promote products derived from this software without
bsd-4-clause | all advertising materials mentioning features or use of this software must display
apache-1.1 | this product includes software developed by the apache software foundation
apache-2.0 | distributed on an as is basis without warranties or conditions of any kind
openssl | this product includes software developed by the openssl project
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu(?: lesser| library) general public
gpl | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document
mpl-2.0 | this source code form is subject to the terms of the mozilla public license
epl | the accompanying materials are made available under the terms of the eclipse public license
unlicense | this is free and unencumbered software released into the public domain
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
cc0-1.0 | to the extent possible under law \w+(?: \w+)?(?: \w+)? has waived all copyright and related or neighboring rights
ofl-1.1 | this font software is licensed under the sil open font license
beerware | as long as you retain this notice you can do whatever you want with this stuff
json | the software shall be used for good not evil
proprietary | unauthori[sz]ed copying of this file via any medium is strictly prohibited
"""
_GRANT = r"\b(?:(?:re)?licen[sc]ed|released|distributed|available|provided|published|covered|redistributed?)\s+(?:\w+\s+){0,6}?(?:under|by|with|per)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:gnu\s+)?"


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


@lru_cache(1)
def rules() -> list[Rule]:
    """Four kinds for each license, the surest first: identifier tag, address, grant, mention; and words of the licenses' texts."""
    out = []
    for line in _SIGNATURES.strip().splitlines():
        label, keyword, name, address = (x.strip() for x in re.split(r" \|(?: |$)", line))
        name = name.replace("{v}", _V).replace("{{", "{").replace("}}", "}")
        out.append(Rule(label, "spdx", rf"spdx-license-identifier\s*:\s*{re.escape(label)}(?:-only)?(?![\w.-])", 4, 0.99))
        if address:
            out.append(Rule(label, address.split("\\.")[0].split("|")[0].split("/")[0], rf"(?:https?://)?(?:www\.)?(?:{address})", 3, 0.95))
        out.append(Rule(label, keyword, _GRANT + rf"(?:{name})", 2, 0.9))
        out.append(Rule(label, keyword, name, 1, 0.7))
    for line in _TEXTS.strip().splitlines():
        label, phrase = line.split(" | ")
        out.append(Rule(label, "", rf"\b{phrase}\b".replace(" ", r"\W+"), 3, 0.95))
    return out


class Detection(NamedTuple):
    start: int
    end: int
    rule: int


def needed(pattern: str) -> list[frozenset[str]]:
    """Sets of literals, of each of which every match of the pattern holds one; what is optional needs none."""
    return _needed(_parser.parse(pattern))


def _needed(items) -> list[frozenset[str]]:
    out, run = [], ""

    def best(sets):
        return max(sets, key=lambda c: min(map(len, c)), default=None)

    for op, value in items:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is _parser.SUBPATTERN:
            out += _needed(value[-1])
        elif op is _parser.BRANCH:
            either = [best(_needed(branch)) for branch in value[1]]
            if all(either):
                out.append(frozenset().union(*either))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            out += _needed(value[2])
    return [*out, frozenset([run])] if run else out


class Scanner:
    """Compiled rules behind the keyword automaton: a rule runs on texts with a literal of each set that its pattern needs."""

    def __init__(self):
        self.rules = rules()
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        self.gate = ahocorasick.Automaton()
        self.needs = [needed(r.pattern) for r in self.rules]
        self.always = [i for i, sets in enumerate(self.needs) if not sets]
        self.gated: dict[str, list[int]] = {}
        for i, sets in enumerate(self.needs):
            for word in max(sets, key=lambda c: min(map(len, c)), default=()):
                self.gated.setdefault(word, []).append(i)
        for word in {word for sets in self.needs for c in sets for word in c}:
            self.gate.add_word(word, word)
        self.gate.make_automaton()

    def scan(self, text: str) -> list[Detection]:
        """Detections in a lower-cased text that no other of at least their priority contains."""
        words = {word for _, word in self.gate.iter(text)}
        found = []
        for number in sorted({*self.always, *(n for word in words for n in self.gated.get(word, ()))}):
            if not any(c.isdisjoint(words) for c in self.needs[number]):
                found += [Detection(m.start(), m.end(), number) for m in self.compiled[number].finditer(text) if m.end() > m.start()]
        return self.resolve(found)

    def resolve(self, found: list[Detection]) -> list[Detection]:
        """Suppression by priority and containment, in one sweep; of equal spans the earlier rule stays."""
        kept: list[Detection] = []
        furthest = [-1] * (1 + max(r.priority for r in self.rules))  # end of the detections of each priority so far
        # whatever contains a detection comes before it
        for d in sorted(found, key=lambda d: (d.start, -d.end, -self.rules[d.rule].priority, d.rule)):
            priority = self.rules[d.rule].priority
            if max(furthest[priority:]) < d.end:
                kept.append(d)
            furthest[priority] = max(furthest[priority], d.end)
        return sorted(kept)


_SCANNER: list[Scanner] = []
_OUT = "row {row}, n_words long, base array<struct<at:long,label:string>>, found array<struct<start:long,end:long,label:string,rule:long,confidence:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    scanner = _SCANNER[0]
    phrases = [(p.encode().split(), hash_words(p), label) for p, label in BASE_PHRASES.items()]
    for batch in batches:
        data, bounds = string_buffers(batch.column("text"))
        n_words, base, found = [], [], []
        for rows, slab in slabs(batch.column("text")):
            n_words += np.diff(slab.first).tolist()
            own: list[list[dict]] = [[] for _ in range(len(slab))]
            if len(slab.hash):
                row = slab.row()
                for words, h, label in phrases:
                    m = len(slab.hash) - len(h) + 1
                    same = np.ones(max(m, 0), bool)
                    for j in range(len(h)):
                        same &= slab.hash[j : m + j] == h[j] if m > 0 else same
                    for i in np.flatnonzero(same).tolist():
                        if row[i] == row[i + len(h) - 1] and [slab.word(i + j) for j in range(len(h))] == words:
                            own[row[i]].append({"at": i - int(slab.first[row[i]]), "label": label})
            base += own
            for r in range(rows.start, rows.stop):
                raw = data[bounds[r] : bounds[r + 1]].tobytes()
                text = raw.decode("utf-8", "replace")
                text = text.lower() if raw.isascii() else text.translate(_FOLD)
                found.append([{"start": d.start, "end": d.end, "label": scanner.rules[d.rule].label, "rule": d.rule, "confidence": scanner.rules[d.rule].confidence} for d in scanner.scan(text)])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int64()), ("confidence", pa.float64())]))
        yield pa.record_batch([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(base, pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))), pa.array(found, spans)], ["row", "n_words", "base", "found"])


_FOLD = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, ``base`` (word places of the fixed phrases) and ``found`` (kept detections, as code points).

    Null and empty texts have no words and no detections; repeated rows are scanned alike.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    out = rows.mapInArrow(_scan, _OUT.format(row=rows.schema["row"].dataType.simpleString()))
    return out.select("row.*", "n_words", "base", "found")


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def score() -> Column:
    """1 minus the chance that every detection errs."""
    miss = F.aggregate("found", F.lit(1.0), lambda a, d: a * (1 - d["confidence"]))
    return 1 - miss * F.pow(F.lit(0.3), F.least(F.size("base"), F.lit(8)))

"""License scans by ordered signature rules.

Hundreds of signatures written by hand (a name and an address of each licence, and sentences of licence texts and notices),
with an identifier and a grant rule for each licence, are gated by keywords: one Aho-Corasick pass over a text tells which
rules can match at all, and only those regexes run.  A rule's keywords are derived from its regex, so that each of its matches
contains one of them once white space is taken as one space.  Rules are matched in a text whose runs of white space are one
character each, so that no rule repeats a part that can be empty or match one stretch in two ways.  Identifiers are sought
within the expressions of tag lines, whole ones only.  Detections are taken in order of priority, then length, then place; one
whose interval lies within an interval already taken is suppressed.  Three base phrases are always reported, with all their places.

Results for odd input: null and empty texts have no words, no labels and score 0; texts are scanned whole (an address's
path reaches over at most 200 characters); repeated rows are scanned one by one; other columns of the input do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from re import _constants as op, _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import LOWER, UPPER, texts

#: phrase: label
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label | identifier prefix | word of the licence | regex of the name | regex of the address
LICENSES = r"""
mit | mit | mit | (?:the )?mit(?: \(?expat\)?)? licen[cs]e | opensource\.org/licenses?/mit
mit-0 | mit-0 | attribution | mit no attribution(?: licen[cs]e)? | opensource\.org/licenses?/mit-0
apache | apache- | apache | (?:the )?apache(?: software)? licen[cs]e | apache\.org/licenses(?:/license)?
apache-2.0 | apache-2\.0 | apache | apache(?: software)? licen[cs]e,? v(?:ersion)? ?2(?:\.0)? | apache\.org/licenses/license-2\.0
apache-1.1 | apache-1\.1 | apache | apache(?: software)? licen[cs]e,? v(?:ersion)? ?1\.1 | apache\.org/licenses/license-1\.1
gpl | gpl- | general public | (?:the )?(?:gnu )?general public licen[cs]e | gnu\.org/licenses/gpl
gpl-1.0 | gpl-1\.0 | general public | gnu general public licen[cs]e,? v(?:ersion)? ?1(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-1
gpl-2.0 | gpl-2\.0 | general public | gnu general public licen[cs]e,? v(?:ersion)? ?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2
gpl-3.0 | gpl-3\.0 | general public | gnu general public licen[cs]e,? v(?:ersion)? ?3(?:\.0)? | gnu\.org/licenses/gpl-3
lgpl | lgpl- | general public | (?:gnu )?(?:lesser|library) general public licen[cs]e | gnu\.org/licenses/lgpl
lgpl-2.1 | lgpl-2\.1 | general public | (?:gnu )?lesser general public licen[cs]e,? v(?:ersion)? ?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | lgpl-3\.0 | general public | (?:gnu )?lesser general public licen[cs]e,? v(?:ersion)? ?3(?:\.0)? | gnu\.org/licenses/lgpl-3
agpl | agpl- | affero | (?:gnu )?affero general public licen[cs]e | gnu\.org/licenses/agpl
agpl-3.0 | agpl-3\.0 | affero | (?:gnu )?affero general public licen[cs]e,? v(?:ersion)? ?3(?:\.0)? | gnu\.org/licenses/agpl-3
gfdl | gfdl- | free documentation | (?:gnu )?free documentation licen[cs]e | gnu\.org/licenses/fdl
bsd | bsd- | bsd | (?:the )?bsd(?:-style)? licen[cs]e | opensource\.org/licenses?/bsd-licen[cs]e
bsd-2-clause | bsd-2-clause | bsd | (?:simplified|freebsd|2[- ]clause) (?:bsd )?licen[cs]e | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd-3-clause | bsd | (?:new|revised|modified|3[- ]clause) bsd licen[cs]e | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd-4-clause | bsd | (?:original|4[- ]clause) bsd licen[cs]e | spdx\.org/licenses/bsd-4-clause
0bsd | 0bsd | bsd | (?:zero[- ]clause|0[- ]clause) bsd licen[cs]e | opensource\.org/licenses?/0bsd
isc | isc | isc | (?:the )?isc licen[cs]e | opensource\.org/licenses?/isc
mpl | mpl- | mozilla | mozilla public licen[cs]e | mozilla\.org/mpl
mpl-1.1 | mpl-1\.1 | mozilla | mozilla public licen[cs]e,? v(?:ersion)?\.? ?1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mpl-2\.0 | mozilla | mozilla public licen[cs]e,? v(?:ersion)?\.? ?2\.0 | mozilla\.org/(?:en-us/)?mpl/2\.0
epl | epl- | eclipse | eclipse public licen[cs]e | eclipse\.org/legal/epl
epl-1.0 | epl-1\.0 | eclipse | eclipse public licen[cs]e,?(?: -)? v(?:ersion)? ?1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | epl-2\.0 | eclipse | eclipse public licen[cs]e,?(?: -)? v(?:ersion)? ?2\.0 | eclipse\.org/legal/epl-(?:v20|2\.0)
edl | bsd-3-clause-edl | eclipse | eclipse distribution licen[cs]e | eclipse\.org/org/documents/edl
cddl | cddl- | common development | common development and distribution licen[cs]e | opensource\.org/licenses?/cddl
cpl | cpl- | common public | common public licen[cs]e(?! for) | opensource\.org/licenses?/cpl
ms-pl | ms-pl | microsoft | microsoft public licen[cs]e | opensource\.org/licenses?/ms-pl
ms-rl | ms-rl | microsoft | microsoft reciprocal licen[cs]e | opensource\.org/licenses?/ms-rl
artistic | artistic- | artistic | (?:perl )?artistic licen[cs]e | perlfoundation\.org/artistic
artistic-2.0 | artistic-2\.0 | artistic | artistic licen[cs]e,? v?(?:ersion )?2(?:\.0)? | opensource\.org/licenses?/artistic-2
zlib | zlib | zlib | (?:the )?zlib(?:/libpng)? licen[cs]e | zlib\.net/zlib_license
libpng | libpng | libpng | libpng licen[cs]e | libpng\.org/pub/png/src/libpng-license
unlicense | unlicense | unlicense | (?:the )?unlicense(?: licen[cs]e)? | unlicense\.org
wtfpl | wtfpl | what the f | do what the f\S+ you want to public licen[cs]e | wtfpl\.net
bsl-1.0 | bsl-1\.0 | boost | boost software licen[cs]e | boost\.org/license_1_0
busl | busl- | business source | business source licen[cs]e | mariadb\.com/bsl
sspl | sspl- | server side public | server side public licen[cs]e | mongodb\.com/licensing/server-side-public-license
elastic | elastic- | elastic | elastic licen[cs]e | elastic\.co/licensing/elastic-license
eupl | eupl- | european union | european union public licen[cs]e | (?:joinup\.ec\.europa\.eu|eupl\.eu)/\S{0,200}eupl
cecill | cecill- | cecill | cecill(?:-[abc])? (?:free software )?licen[cs]e | cecill\.info/licences
osl | osl- | open software | open software licen[cs]e | opensource\.org/licenses?/osl
afl | afl- | academic free | academic free licen[cs]e | opensource\.org/licenses?/afl
upl | upl- | universal permissive | universal permissive licen[cs]e | oss\.oracle\.com/licenses/upl
ncsa | ncsa | ncsa | (?:university of illinois/)?ncsa (?:open source )?licen[cs]e | opensource\.org/licenses?/ncsa
postgresql | postgresql | postgresql | postgresql licen[cs]e | postgresql\.org/about/licen[cs]e
psf | (?:python|psf)- | python | python(?: software foundation)? licen[cs]e | docs\.python\.org/\S{0,200}/license
php | php- | php | (?:the )?php licen[cs]e | php\.net/license
ruby | ruby | ruby | (?:the )?ruby licen[cs]e | ruby-lang\.org/\S{0,200}licen[cs]e
openssl | openssl | openssl | openssl licen[cs]e | openssl\.org/source/license
ofl | ofl- | open font | (?:sil )?open font licen[cs]e | scripts\.sil\.org/ofl
lppl | lppl- | latex project | latex project public licen[cs]e | latex-project\.org/lppl
json | json | json | (?:the )?json licen[cs]e | json\.org/license
vim | vim | vim | (?:the )?vim licen[cs]e | vimhelp\.org/\S{0,200}license
w3c | w3c | w3c | w3c software(?: notice and)? licen[cs]e | w3\.org/consortium/legal/\S{0,200}software
odbl | odbl- | open database | open (?:data commons )?(?:open )?database licen[cs]e | opendatacommons\.org/licenses/odbl
odc-by | odc-by- | open data commons | open data commons attribution licen[cs]e | opendatacommons\.org/licenses/by
pddl | pddl- | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e | opendatacommons\.org/licenses/pddl
cc0 | cc0- | cc0 | (?:creative commons )?cc0(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero
cc-by | cc-by-\d | cc by | (?:creative commons|cc) by(?: \d\.0)?(?![- ]?(?:nc|nd|sa)) | creativecommons\.org/licenses/by/
cc-by-sa | cc-by-sa- | cc by | (?:creative commons|cc) by[- ]sa(?: \d\.0)? | creativecommons\.org/licenses/by-sa
cc-by-nc | cc-by-nc-\d | cc by | (?:creative commons|cc) by[- ]nc(?: \d\.0)?(?![- ](?:sa|nd)) | creativecommons\.org/licenses/by-nc/
cc-by-nd | cc-by-nd- | cc by | (?:creative commons|cc) by[- ]nd(?: \d\.0)? | creativecommons\.org/licenses/by-nd
cc-by-nc-sa | cc-by-nc-sa- | cc by | (?:creative commons|cc) by[- ]nc[- ]sa(?: \d\.0)? | creativecommons\.org/licenses/by-nc-sa
cc-by-nc-nd | cc-by-nc-nd- | cc by | (?:creative commons|cc) by[- ]nc[- ]nd(?: \d\.0)? | creativecommons\.org/licenses/by-nc-nd
openrail | openrail | openrail | (?:bigscience )?openrail(?:-m)? licen[cs]e | huggingface\.co/spaces/bigscience/license
llama | llama | llama | llama \d* ?community licen[cs]e | ai\.meta\.com/llama/license
public-domain | public-domain | public domain | (?:released|placed|dedicated) (?:in)?to the public domain | creativecommons\.org/publicdomain/mark
"""
#: label | priority | sentence of a licence's text or of a notice
SENTENCES = r"""
mit | 35 | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | 33 | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 | 36 | permission is hereby granted, free of charge, to any person obtaining a copy of this software (?:\S+ ){1,40}without restriction(?:\S* (?:\S+ ){0,39})to whom the software is furnished to do so\.? the software is provided
isc | 35 | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | 36 | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. the software is provided
bsd | 34 | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-2-clause | 33 | redistributions in binary form must reproduce the above copyright notice, this list of conditions
bsd-3-clause | 35 | neither the name of \S+(?: \S+){0,12} nor the names of (?:its|their) contributors may be used to endorse or promote
bsd-4-clause | 35 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | 35 | you may not use this file except in compliance with the license
apache-2.0 | 34 | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an
apache-2.0 | 34 | subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide
apache-1.1 | 34 | this product includes software developed by the apache software foundation
gpl | 34 | this program is free software[;:] you can redistribute it and/or modify it
gpl-2.0 | 36 | under the terms of the gnu general public licen[cs]e as published by the free software foundation[;,] either version 2
gpl-2.0 | 36 | under the terms of the gnu general public licen[cs]e version 2 as published by
gpl-3.0 | 36 | under the terms of the gnu general public licen[cs]e as published by the free software foundation[;,] either version 3
gpl | 33 | without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[cs]e
gpl | 33 | you should have received a copy of the gnu general public licen[cs]e along with
lgpl | 35 | this library is free software[;:] you can redistribute it and/or modify it
lgpl-2.1 | 37 | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 2\.1
lgpl-3.0 | 37 | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 3
lgpl | 34 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with
agpl-3.0 | 37 | under the terms of the gnu affero general public licen[cs]e as published by the free software foundation[;,] either version 3
agpl | 34 | you should have received a copy of the gnu affero general public licen[cs]e along with
gfdl | 36 | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
gpl | 32 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed
mpl-2.0 | 36 | this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. ?2\.0
mpl-2.0 | 34 | if a copy of the mpl was not distributed with this file, you can obtain one at
mpl-1.1 | 36 | the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
cddl | 36 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
epl-1.0 | 36 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1\.0
epl-2.0 | 36 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e,? (?:v(?:ersion)?\.? ?)?2\.0
bsl-1.0 | 35 | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | 35 | this is free and unencumbered software released into the public domain
unlicense | 34 | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
zlib | 35 | this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable
zlib | 34 | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
wtfpl | 35 | everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document, and changing it is allowed
artistic-2.0 | 34 | this licen[cs]e establishes the terms under which a given free software package may be copied, modified, distributed
artistic | 34 | the intent of this document is to state the conditions under which a package may be copied
openssl | 35 | this product includes software developed by the openssl project
php | 35 | this product includes php software, freely available from
python | 34 | subject to the terms and conditions of this licen[cs]e agreement, psf hereby grants licensee a nonexclusive
postgresql | 36 | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
ncsa | 36 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "software"\), to deal with the software without restriction
w3c | 35 | by obtaining, using and/or copying this work, you \(the licensee\) agree
ofl | 36 | this font software is licensed under the sil open font licen[cs]e
ofl | 34 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
lppl | 36 | this work may be distributed and/or modified under the conditions of the latex project public licen[cs]e
json | 37 | the software shall be used for good, not evil
vim | 34 | there are no restrictions on distributing unmodified copies of vim
upl | 36 | subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data
ms-pl | 34 | this licen[cs]e governs use of the accompanying software\. if you use the software, you accept this licen[cs]e
cc-by | 36 | this work is licensed under a creative commons attribution(?: \d\.0)? (?:international|unported|generic)
cc-by-sa | 37 | this work is licensed under a creative commons attribution-share ?alike
cc-by-nc | 37 | this work is licensed under a creative commons attribution-non ?commercial(?:-?[ ]?\d\.0)? (?:international|unported|generic)
cc-by-nc-sa | 38 | this work is licensed under a creative commons attribution-non ?commercial-share ?alike
cc-by-nc-nd | 38 | this work is licensed under a creative commons attribution-non ?commercial-no ?deriv\S+
cc-by-nd | 37 | this work is licensed under a creative commons attribution-no ?deriv\S+
cc0 | 36 | to the extent possible under law, \S+(?: \S+){0,12} (?:has|have) waived all copyright and related or neighboring rights
cc0 | 36 | no rights reserved
cc-by | 30 | creative commons attribution(?: \d\.0)?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-sa | 31 | creative commons attribution[- ]share ?alike(?: \d\.0)?(?: international| unported| generic)?(?: public)? licen[cs]e
cc-by-nc | 31 | creative commons attribution[- ]non ?commercial(?: \d\.0)?(?: international| unported| generic)?(?: public)? licen[cs]e
public-domain | 34 | this (?:work|file|code|software|text) is in the public domain
public-domain | 33 | i,? the (?:author|copyright holder) of this work,? (?:hereby )?release (?:it|this work) into the public domain
all-rights-reserved | 25 | all rights reserved
all-rights-reserved | 34 | no part of this (?:publication|book|work|document) may be reproduced
proprietary | 34 | (?:this (?:software|document|file) (?:is|contains) )?(?:the )?(?:confidential and proprietary|proprietary and confidential) (?:information|property)
proprietary | 33 | unauthori[sz]ed copying of this (?:file|software|document),? via any medium,? is strictly prohibited
proprietary | 20 | proprietary licen[cs]e
elastic | 35 | you may not provide the software to third parties as a hosted or managed service
sspl | 35 | if you make the functionality of the program or a modified version available to third parties as a service
busl | 35 | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
llama | 35 | you are granted a non-exclusive, worldwide, non-transferable and royalty-free limited licen[cs]e under meta's
eupl | 36 | licensed under the eupl
cecill | 35 | this software is governed by the cecill(?:-[abc])? licen[cs]e under french law
osl | 36 | licensed under the open software licen[cs]e version
afl | 36 | licensed under the academic free licen[cs]e version
odbl | 35 | any rights in individual contents of the database are licensed under
"""
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|redistributable|covered|made available|dual[- ]licen[cs]ed|subject to(?: the terms of)?)(?: \S+){0,3}? (?:under|by|of)(?: (?:the )?terms of)?(?: the| a| an)? "
#: of each form: priority, confidence; a sentence has a priority of its own
FORMS = {"address": (40, 0.98), "tag": (41, 0.99), "sentence": (0, 0.97), "grant": (30, 0.95), "name": (10, 0.8)}
#: The identifiers of a tag line; operators join them, a bracket may stand around some.
EXPRESSION = re.compile(r"spdx-license-identifier:[ \t(]*([\w.+-]+(?:[ \t)]+(?:or|and|with)[ \t(]+[\w.+-]+)*)")


class Rule(NamedTuple):
    label: str
    form: str
    priority: int
    confidence: float
    keywords: frozenset[str]
    pattern: re.Pattern


#: Strings that a piece of a regex is spelled out to at most.
SPELLINGS = 64


def _spelled(kind: object, value: object) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that a token of a regex matches, any white space as one space, or None if they are not few; for None,
    sets of which each match holds a string."""
    if kind is op.LITERAL:
        return {" " if chr(value).isspace() else chr(value)}, []
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, []
    if kind is op.IN and all(k is op.LITERAL or (k, v) == (op.CATEGORY, op.CATEGORY_SPACE) for k, v in value):
        return set().union(*(_spelled(k, v)[0] if k is op.LITERAL else {" "} for k, v in value)), []
    if kind is op.SUBPATTERN:
        return _needed(value[-1])
    if kind is op.BRANCH:
        sides = [_needed(side) for side in value[1]]
        if all(exact is not None for exact, _ in sides):
            return set().union(*(exact for exact, _ in sides)), []
        best = [_best([exact] if exact is not None else inner) for exact, inner in sides]
        return None, [set().union(*best)] if all(best) else []
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        exact, held = _needed(inner)
        if exact is not None and (most == 1 or exact == {" "}):
            return exact | ({""} if least == 0 else set()), []
        return None, (held if exact is None else [exact]) if least else []
    return None, []


def _needed(tokens: Iterable) -> tuple[set[str] | None, list[set[str]]]:
    """As _spelled, for a sequence of tokens."""
    run, held, whole = {""}, [], True
    for kind, value in tokens:
        exact, inner = _spelled(kind, value)
        if exact is not None and len(run) * len(exact) <= SPELLINGS:
            run = {(a + b).replace("  ", " ") for a in run for b in exact}
            continue
        held += [run, *inner]
        run, whole = {""} if exact is None else exact, False
    return (run, []) if whole else (None, [*held, run])


def _best(held: list[set[str]]) -> set[str]:
    """The set whose shortest string is longest, without strings that hold another one; empty if none is of use."""
    held = [x for x in held if all(y.strip() for y in x)]
    best = max(held, key=lambda x: (min(map(len, x)), -len(x)), default=set())
    return {x for x in best if not any(y != x and y in x for y in best)}


def keywords(pattern: str) -> frozenset[str]:
    """Strings of which each match of the regex holds one, with white space taken as one space."""
    exact, held = _needed(parser.parse(pattern))
    found = frozenset(_best(held if exact is None else [exact]))
    if not found:
        raise ValueError(f"no keyword for {pattern}")
    return found


@cache
def rules() -> tuple[Rule, ...]:
    """All signatures, in the order of the table; a later form of a licence comes behind its earlier ones."""
    out = []
    spaced = lambda x: x.replace(" ", r"\s")
    for line in LICENSES.strip().splitlines():
        label, tag, _, name, address = (x.strip() for x in line.split(" | "))
        named = keywords(spaced(name))
        # a family's rule takes any version of it; the rule of one version is the stronger one
        whole, exact = (rf"{tag}[\w.+-]*", 0) if tag.endswith("-") or tag.endswith(r"-\d") else (rf"{tag}(?:-only|-or-later|\+)?", 1)
        shapes = {
            "address": (rf"(?<![a-z0-9]){address}", keywords(address)),
            "tag": (rf"(?<![\w.+-]){whole}(?![\w.+-])", frozenset({"spdx-license-identifier"})),
            "grant": (spaced(rf"(?<![a-z0-9]){GRANT}(?:{name})(?![a-z0-9])"), named),
            "name": (spaced(rf"(?<![a-z0-9])(?:{name})(?![a-z0-9])"), named),
        }
        for form, (pattern, key) in shapes.items():
            priority, confidence = FORMS[form]
            out.append(Rule(label, form, priority + exact * (form == "tag"), confidence, key, re.compile(pattern)))
    for line in SENTENCES.strip().splitlines():
        label, priority, sentence = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, "sentence", int(priority), FORMS["sentence"][1], keywords(spaced(sentence)), re.compile(spaced(rf"(?<![a-z0-9])(?:{sentence})"))))
    return tuple(out)


@cache
def gate():
    """Automaton of the keywords; each gives the numbers of its rules."""
    import ahocorasick

    by_key: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for key in rule.keywords:
            by_key.setdefault(key, []).append(i)
    found = ahocorasick.Automaton()
    for key, which in by_key.items():
        found.add_word(key, (key, which))
    found.make_automaton()
    return found


def suppress(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule number), those that no stronger, longer or earlier one contains.

    For each place a tree holds the furthest end of the intervals taken that begin there or before.
    """
    order = rules()
    place = {a: i + 1 for i, a in enumerate(sorted({a for a, _, _ in found}))}
    furthest, kept = [-1] * (len(place) + 1), []
    for x in sorted(found, key=lambda x: (-order[x[2]].priority, x[0] - x[1], x[0], x[2])):
        i, most = place[x[0]], -1
        while i:
            most = max(most, furthest[i])
            i &= i - 1
        if most < x[1]:
            kept.append(x)
            i = place[x[0]]
            while i < len(furthest):
                furthest[i] = max(furthest[i], x[1])
                i += i & -i
    return sorted(kept)


def collapsed(text: str) -> str:
    """Each run of white space as one character: a blank if it has only blanks and tabs, else a line feed, which ends tag lines."""
    return re.sub(r" ?[^\S \t]\s*", "\n", re.sub(r"[ \t]+", " ", text))


def candidates(text: str, active: Iterable[int]) -> list[tuple[int, int, int]]:
    """(start, end, rule number) of all matches of the rules in a lower-cased text, as places in the collapsed one."""
    text = collapsed(text)
    tags, found = [m.span(1) for m in EXPRESSION.finditer(text)], []
    for i in active:
        spans = tags if rules()[i].form == "tag" else [(0, len(text))]
        found += [(*m.span(), i) for a, b in spans for m in rules()[i].pattern.finditer(text, a, b)]
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule number), as places in the collapsed text, of the rules whose keywords a lower-cased text holds, after
    suppression."""
    plain = f" {' '.join(text.split())} "
    active = {i for which in {key: which for _, (key, which) in gate().iter(plain)}.values() for i in which}
    return suppress(candidates(text, sorted(active))) if active else []


_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BASE = {
    label: re.compile(rb"(?<![0-9a-z\x80-\xff])" + _GAP.join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])") for p, label in BASE.items()
}


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    data = (text or "").encode().translate(_LOWER)
    if not data:
        return 0, 0, None, None, "", "", 0.0, 0
    word = _WORD[np.frombuffer(data, np.uint8)]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at, base = [], set()
    if b"license" in data:
        for label, pattern in _BASE.items():
            hits = [m.start() for m in pattern.finditer(data)]
            if hits:
                base.add(label)
                at += hits
    places = [int(np.count_nonzero(starts[:i])) for i in (min(at), max(at))] if at else [None, None]
    kept = detect(data.decode())
    own = [rules()[i] for _, _, i in kept]
    score = max([0.0, 0.9 * bool(at), *(r.confidence for r in own)])
    labels = base | {r.label for r in own}
    return int(np.count_nonzero(starts)), len(at), *places, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def scan_licenses(df: DataFrame) -> DataFrame:
    """A row of SCHEMA for each row of ``df`` (doc_id, text); a map over rows, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        for batch in batches:
            rows = [scan(x.as_py()) for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(texts(spark, sf_dir))


QUERIES = {"op10_license_scans": op10_license_scans}
ORACLES: dict[str, str] = {}

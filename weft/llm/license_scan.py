"""License scan: ordered signature rules over the words of a text.

Rules are regular expressions over the lower-cased words joined by single spaces.  A rule runs only
where its keyword occurs.  Detections are resolved by priority: one whose interval lies inside the
interval of an accepted detection of higher priority (or of equal priority and greater length) is
suppressed.

Edge cases: a null or empty text has no words and no detection, score 0, empty labels and null
positions; texts are scanned whole, whatever their length; repeated rows are scanned each; an empty
table gives an empty result; other columns are kept untouched, and the added columns replace columns
of the same names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._scratch import unused
from weft.llm._text import ASCII_LOWERED

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | identifier words | name pattern | words of the canonical address
FAMILIES = """
mit|mit|(?:mit|expat)|opensource org licenses mit
apache-2.0|apache 2 0|apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?|apache org licenses license 2 0
apache-1.1|apache 1 1|apache(?: software)?(?: license)?(?: version)? 1 1|apache org licenses license 1 1
bsd-2-clause|bsd 2 clause|(?:simplified bsd|bsd 2 clause|freebsd)|opensource org licenses bsd 2 clause
bsd-3-clause|bsd 3 clause|(?:new bsd|modified bsd|revised bsd|bsd 3 clause)|opensource org licenses bsd 3 clause
bsd-4-clause|bsd 4 clause|(?:original bsd|bsd 4 clause)|spdx org licenses bsd 4 clause
0bsd|0bsd|(?:zero clause bsd|bsd zero clause|0bsd)|opensource org licenses 0bsd
isc|isc|(?:isc|internet systems consortium)|opensource org licenses isc
gpl-1.0|gpl 1 0(?: only| or later)?|(?:gnu )?(?:gpl|general public license)(?: version)?(?: v)? ?1(?: 0)?|gnu org licenses old licenses gpl 1 0
gpl-2.0|gpl 2 0(?: only| or later)?|(?:gnu )?(?:gpl|general public license)(?: version)?(?: v)? ?2(?: 0)?|gnu org licenses old licenses gpl 2 0
gpl-3.0|gpl 3 0(?: only| or later)?|(?:gnu )?(?:gpl|general public license)(?: version)?(?: v)? ?3(?: 0)?|gnu org licenses gpl 3 0
lgpl-2.0|lgpl 2 0(?: only| or later)?|(?:gnu )?(?:lgpl|library general public license)(?: version)?(?: v)? ?2(?: 0)?|gnu org licenses old licenses lgpl 2 0
lgpl-2.1|lgpl 2 1(?: only| or later)?|(?:gnu )?(?:lgpl|lesser general public license)(?: version)?(?: v)? ?2 1|gnu org licenses old licenses lgpl 2 1
lgpl-3.0|lgpl 3 0(?: only| or later)?|(?:gnu )?(?:lgpl|lesser general public license)(?: version)?(?: v)? ?3(?: 0)?|gnu org licenses lgpl 3 0
agpl-3.0|agpl 3 0(?: only| or later)?|(?:gnu )?(?:agpl|affero general public license)(?: version)?(?: v)? ?3(?: 0)?|gnu org licenses agpl 3 0
gfdl-1.3|gfdl 1 3(?: only| or later)?|(?:gnu )?free documentation license(?: version)?(?: v)? ?1 3|gnu org licenses fdl 1 3
mpl-1.1|mpl 1 1|mozilla public license(?: version)?(?: v)? ?1 1|mozilla org mpl 1 1
mpl-2.0|mpl 2 0|mozilla public license(?: version)?(?: v)? ?2(?: 0)?|mozilla org (?:en us )?mpl 2 0
epl-1.0|epl 1 0|eclipse public license(?: version)?(?: v)? ?1(?: 0)?|eclipse org legal epl v10
epl-2.0|epl 2 0|eclipse public license(?: version)?(?: v)? ?2(?: 0)?|eclipse org legal epl 2 0
cddl-1.0|cddl 1 0|common development and distribution license(?: version)?(?: v)? ?1 0|opensource org licenses cddl 1 0
cddl-1.1|cddl 1 1|common development and distribution license(?: version)?(?: v)? ?1 1|glassfish java net public cddl gpl 1 1
cpl-1.0|cpl 1 0|common public license(?: version)?(?: v)? ?1(?: 0)?|opensource org licenses cpl 1 0
eupl-1.1|eupl 1 1|european union public licen[cs]e(?: version)?(?: v)? ?1 1|joinup ec europa eu software page eupl
eupl-1.2|eupl 1 2|european union public licen[cs]e(?: version)?(?: v)? ?1 2|joinup ec europa eu collection eupl
artistic-1.0|artistic 1 0|(?:perl )?artistic license(?: version)? ?1(?: 0)?|opensource org licenses artistic 1 0
artistic-2.0|artistic 2 0|(?:perl )?artistic license(?: version)? ?2(?: 0)?|opensource org licenses artistic 2 0
zlib|zlib|(?:zlib|zlib libpng)|opensource org licenses zlib
libpng|libpng|(?:libpng|png reference library)|libpng org pub png src libpng license
bsl-1.0|bsl 1 0|boost software license(?: version)?(?: v)? ?1(?: 0)?|boost org license 1 0
busl-1.1|busl 1 1|business source license(?: version)? ?1 1|mariadb com bsl11
unlicense|unlicense|(?:the )?unlicense|unlicense org
wtfpl|wtfpl|(?:wtfpl|do what the fuck you want to public license)|wtfpl net
cc0-1.0|cc0 1 0|(?:cc0|creative commons zero)(?: 1 0)?|creativecommons org publicdomain zero 1 0
cc-by-1.0|cc by 1 0|(?:cc by|creative commons attribution) 1 0|creativecommons org licenses by 1 0
cc-by-2.0|cc by 2 0|(?:cc by|creative commons attribution) 2 0|creativecommons org licenses by 2 0
cc-by-3.0|cc by 3 0|(?:cc by|creative commons attribution) 3 0|creativecommons org licenses by 3 0
cc-by-4.0|cc by 4 0|(?:cc by|creative commons attribution) 4 0|creativecommons org licenses by 4 0
cc-by-sa-3.0|cc by sa 3 0|(?:cc by sa|creative commons attribution share ?alike) 3 0|creativecommons org licenses by sa 3 0
cc-by-sa-4.0|cc by sa 4 0|(?:cc by sa|creative commons attribution share ?alike) 4 0|creativecommons org licenses by sa 4 0
cc-by-nc-3.0|cc by nc 3 0|(?:cc by nc|creative commons attribution non ?commercial) 3 0|creativecommons org licenses by nc 3 0
cc-by-nc-4.0|cc by nc 4 0|(?:cc by nc|creative commons attribution non ?commercial) 4 0|creativecommons org licenses by nc 4 0
cc-by-nd-4.0|cc by nd 4 0|(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 4 0|creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0|cc by nc sa 4 0|(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|cc by nc nd 4 0|(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 4 0|creativecommons org licenses by nc nd 4 0
odbl-1.0|odbl 1 0|open database license(?: version)?(?: v)? ?1 0|opendatacommons org licenses odbl
odc-by-1.0|odc by 1 0|open data commons attribution license(?: version)?(?: v)? ?1 0|opendatacommons org licenses by
pddl-1.0|pddl 1 0|public domain dedication and license(?: version)?(?: v)? ?1 0|opendatacommons org licenses pddl
ofl-1.1|ofl 1 1|(?:sil )?open font license(?: version)? ?1 1|scripts sil org ofl
psf-2.0|psf 2 0|python software foundation license(?: version)? ?2|docs python org license
python-2.0|python 2 0|python license(?: version)? ?2|opensource org licenses python 2 0
php-3.01|php 3 01|php license(?: version)? ?3 01|php net license 3 01
ruby|ruby|ruby s? ?license|ruby lang org en about license
openssl|openssl|openssl(?: toolkit)?|openssl org source license
curl|curl|curl|curl se docs copyright
postgresql|postgresql|postgresql|postgresql org about licence
sspl-1.0|sspl 1 0|server side public license(?: version)?(?: v)? ?1|mongodb com licensing server side public license
elastic-2.0|elastic 2 0|elastic license(?: version)? ?2(?: 0)?|elastic co licensing elastic license
ms-pl|ms pl|microsoft public license|opensource org licenses ms pl
ms-rl|ms rl|microsoft reciprocal license|opensource org licenses ms rl
upl-1.0|upl 1 0|universal permissive license(?: version)?(?: v)? ?1(?: 0)?|opensource org licenses upl
ecl-2.0|ecl 2 0|educational community license(?: version)? ?2(?: 0)?|opensource org licenses ecl 2 0
afl-3.0|afl 3 0|academic free license(?: version)?(?: v)? ?3(?: 0)?|opensource org licenses afl 3 0
osl-3.0|osl 3 0|open software license(?: version)?(?: v)? ?3(?: 0)?|opensource org licenses osl 3 0
ncsa|ncsa|(?:university of illinois ncsa|ncsa)(?: open source)?|opensource org licenses ncsa
vim|vim|vim|vimhelp org uganda
"""

#: Ways in which a text names a licence: pattern, keyword, priority, confidence.
FORMS = (
    (r"spdx license identifier {id}", "spdx license identifier", 100, 0.99),
    (r"(?:licensed|released|distributed|available|published|covered) under (?:the |an? )?(?:terms of (?:the )?)?{name}", " under ", 80, 0.95),
    (r"(?:https?|www)?(?: www)? ?{url}", "URL", 70, 0.9),
    (r"{name} licen[cs]e[ds]?", "licen", 60, 0.85),
)
#: Sentences of licence bodies and file headers, by label: label | keyword | pattern (fixed values).
BODIES = """
mit|hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|substantial portions|the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit|to deal in the software|to deal in the software without restriction
ncsa|to deal with the software|to deal with the software without restriction
bsl-1.0|hereby granted|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
isc|with or without fee|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd|with or without fee|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)
postgresql|written agreement|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd|and its documentation|permission to use copy modify(?: and)?(?: distribute)?(?: and sell)? this software and its documentation for any purpose(?: and)? without fee is hereby granted
x11|except as contained|except as contained in this notice the names? of [^ ]+(?: [^ ]+){0,12} shall not be used in advertising
bsd|redistributions of source|redistributions of source code must retain the above copyright notice
bsd|redistributions in binary|redistributions in binary form must reproduce the above copyright notice
bsd-3-clause|neither the name|neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of (?:its|their|any|the) contributors (?:may|can) be used to endorse or promote products
bsd-4-clause|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-1.1|end user documentation|the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-2.0|this file except|you may not use this file except in compliance with the license
apache-2.0|as is basis|software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0|hereby grants to you|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license
ecl-2.0|educational community|licensed under the educational community license version 2 0
eupl|this work except|you may not use this work except in compliance with the licen[cs]e
gpl|can redistribute it|you can redistribute it and or modify it under the terms of the gnu general public license
lgpl|can redistribute it|you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl|can redistribute it|you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-2.0|free software foundation|gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
gpl-3.0|free software foundation|gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
lgpl-2.0|free software foundation|gnu library general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
lgpl-2.1|free software foundation|gnu lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?
lgpl-3.0|free software foundation|gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
agpl-3.0|free software foundation|gnu affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
gnu|verbatim copies|everyone is permitted to copy and distribute verbatim copies of this license document
gfdl|free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0|source code form|this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1|contents of this file|the contents of this file are subject to the mozilla public license version 1 1
epl-1.0|accompanying materials|the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2.0|accompanying materials|the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2 0
cddl|contents of this file|the contents of this file are subject to the terms of (?:either )?(?:the gnu general public license version 2 only gpl or )?the common development and distribution license
zlib|altered source|altered source versions must be plainly marked as such
zlib|express or implied|this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense|unencumbered|this is free and unencumbered software released into the public domain
unlicense|anyone is free|anyone is free to copy modify publish use compile sell or distribute this software
cc0|waived all copyright|to the extent possible under law [^ ]+(?: [^ ]+){0,12} (?:has|have) waived all copyright and related or neighbou?ring rights
cc-by|this work is licensed|this work is licensed under (?:a|the) creative commons attribution(?= (?:[1-4]|international|unported|generic|licen[cs]e) )
cc-by-sa|this work is licensed|this work is licensed under (?:a|the) creative commons attribution share ?alike
cc-by-nd|this work is licensed|this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s
cc-by-nc|this work is licensed|this work is licensed under (?:a|the) creative commons attribution non ?commercial
ofl-1.1|this font software|this font software is licensed under the sil open font license
ofl-1.1|fonts and derivatives|the fonts and derivatives however cannot be released under any other type of license
psf-2.0|psf hereby grants|psf hereby grants licensee a nonexclusive royalty free world ?wide license
php|includes php|this product includes php software freely available from
openssl|openssl project|this product includes software developed by the openssl project
elastic-2.0|managed service|you may not provide the software to third parties as a hosted or managed service
sspl-1.0|as a service|the functionality of the program or a modified version available to third parties as a service
busl-1.1|non production use|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause|right to sell|the license does not grant to you the right to sell the software
ms-pl|accept this license|if you use the software you accept this license if you do not accept the license do not use the software
json|not evil|the software shall be used for good not evil
beerware|buy me a beer|you can buy me a beer in return
reserved|may be reproduced|no part of this (?:publication|book|document|work|material) may be reproduced
proprietary|confidential and proprietary|confidential and proprietary (?:information|property) of
"""
#: Rules of no family: label, pattern, keyword, priority, confidence.
SINGLE = (
    ("gpl", r"(?:gnu )?general public licen[cs]e", "public licen", 50, 0.8),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public licen", 55, 0.8),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", 55, 0.8),
    ("cc", r"creative commons(?: licen[cs]e)?", "creative commons", 40, 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright", 30, 0.5),
    ("copyright", r"(?:c|©) copyright", "copyright", 25, 0.4),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain", 45, 0.7),
    ("public-domain", r"in the public domain", "public domain", 35, 0.5),
    ("permissive", r"permission is hereby granted free of charge", "hereby granted", 65, 0.8),
    ("permissive", r"redistribution and use in source and binary forms", "redistribution and use", 65, 0.8),
    ("no-warranty", r"(?:provided )?as is without warranty of any kind", "without warranty", 20, 0.4),
    ("proprietary", r"proprietary and confidential", "proprietary", 45, 0.7),
    ("proprietary", r"for internal use only", "internal use only", 35, 0.5),
    ("proprietary", r"unauthorized (?:copying|use|distribution)[a-z ]{0,40} prohibited", "unauthorized", 45, 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules, highest priority first; order in the table decides between equals."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, ident, name, url = _fields(line)
        host = " ".join(url.split(" ")[:2])
        for form, keyword, priority, confidence in FORMS:
            keyword = host if keyword == "URL" else keyword
            out.append(Rule(label, form.replace("{id}", ident).replace("{name}", f"(?:{name})").replace("{url}", url), keyword, priority, confidence))
    for line in BODIES.strip().splitlines():
        label, keyword, pattern = line.split("|", 2)
        out.append(Rule(label, pattern, keyword, 90, 0.95))
    out += [Rule(*x) for x in SINGLE]
    out += [Rule(label, re.escape(phrase).replace(r"\ ", " "), phrase, 10, 0.6) for phrase, label in BASE.items()]
    return sorted(out, key=lambda r: -r.priority)


def _fields(line: str) -> list[str]:
    """label, identifier and address hold no bar outside a group; the name pattern may hold one inside."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(line):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(line[start:i])
            start = i + 1
    return [*out, line[start:]]


@cache
def _compiled() -> tuple[ahocorasick.Automaton, dict[str, list[tuple[Rule, re.Pattern]]], re.Pattern]:
    by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules():
        by_keyword.setdefault(rule.keyword, []).append((rule, re.compile(f"(?<= )(?:{rule.pattern})(?= )")))
    automaton = ahocorasick.Automaton()
    for keyword in by_keyword:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    base = re.compile("(?<= )(?=(" + "|".join(BASE) + ") )")
    return automaton, by_keyword, base


def detections(spaced: str, keywords: set[str]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of what stays after suppression; ``spaced`` has a space at both ends."""
    _, by_keyword, _ = _compiled()
    found = []
    for keyword in keywords:
        for rule, pattern in by_keyword[keyword]:
            found += [(m.start(), m.end(), rule) for m in pattern.finditer(spaced)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept: list[tuple[int, int, Rule]] = []  # by start
    longest = max((end - start for start, end, _ in found), default=0)
    for start, end, rule in found:
        near = bisect_left(kept, start - longest, key=lambda d: d[0])
        upto = bisect_right(kept, start, key=lambda d: d[0])
        if not any(end <= kept[i][1] for i in range(near, upto)):
            kept.insert(upto, (start, end, rule))
    return sorted(kept, key=lambda d: (d[0], d[1]))


def scan(text: str | None) -> dict:
    """The row of one text."""
    words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWERED).split()
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    spaced = (b" " + b" ".join(words) + b" ").decode("utf-8")
    automaton, _, base = _compiled()
    keywords = {k for _, k in automaton.iter(spaced)}
    if not keywords:
        return row
    places = [(m.start(), m[1]) for m in base.finditer(spaced)]
    base_labels = {BASE[phrase] for _, phrase in places}
    kept = detections(spaced, keywords)
    if places:
        starts = [spaced.count(" ", 0, at) - 1 for at in (places[0][0], places[-1][0])]
        row |= {"n_base": len(places), "first_word": starts[0], "last_word": starts[1], "base_labels": ",".join(sorted(base_labels))}
    doubt = 1.0
    for confidence in {rule.label: rule.confidence for _, _, rule in sorted(kept, key=lambda d: d[2].confidence)}.values():
        doubt *= 1 - confidence
    row |= {"labels": ",".join(sorted(base_labels | {rule.label for _, _, rule in kept})), "score": round(1 - doubt, 6)}
    row["spans"] = [{"label": r.label, "first": spaced.count(" ", 0, a) - 1, "words": spaced.count(" ", a, b) + 1, "priority": r.priority} for a, b, r in kept]
    return row


ROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("priority", pa.int32())]))),
])
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long,priority:int>>"


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the scan's columns (see ``SCHEMA``); one narrow pass, no shuffle."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t) for t in texts.to_pylist()], ROW)

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    (mark,) = unused(docs, "scan")
    found = docs.withColumn(mark, run(F.col(text)))
    return found.select(*[c for c in docs.columns if c not in names], *[F.col(f"{mark}.{n}").alias(n) for n in names])

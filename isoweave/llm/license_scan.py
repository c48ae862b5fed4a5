"""Licence scanning with ordered signature rules, in DataFrame functions only.

Texts become lower-case words joined by single spaces. A rule is a regex over that line with a keyword, a priority, a
label and a confidence. Only texts with the keyword of any rule or with a base phrase are looked at, and only rules whose
keyword occurs run their regex. A detection that lies inside another one's interval is suppressed if the other has the higher priority
(lower number), or the same priority and a longer interval, or the same interval and an earlier rule.

Most signatures (``WRITTEN``) are sentences of licences, notices and reservations; the rest name a licence by its family,
form and version, or by its identifier. The scan is one pass without a shuffle; the rules are a table of fixed size inside the expression.

Edge cases: a null text has no words and no labels; null ids are carried; repeated rows are scanned once each; equal
intervals are settled by priority, then by the rules' order; a very long text with many detections is swept once; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import ascii_lower, match_spans, running

# The characters between words, and the base phrases with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    """One signature: the lower ``priority`` wins."""

    priority: int
    label: str
    keyword: str
    regex: str
    confidence: float


#: Families: label, name as a regex over spaced words, what every match holds (with the next word's beginning where the
#: name is an ordinary word), versions ("" for none named).
FAMILIES = [
    ("apache", "apache(?: software)?", "apache", ("1 0", "1 1", "2 0", "")),
    ("mit", "mit", "mit licen", ("",)),
    ("mit", "expat", "expat licen", ("",)),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd", ("",)),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd", ("",)),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd", ("",)),
    ("bsd", "bsd", "bsd licen", ("",)),
    ("agpl", "(?:gnu )?affero general public", "affero", ("1 0", "3 0", "3", "")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general public", ("2 0", "2 1", "2", "3 0", "3", "")),
    ("gpl", "(?:gnu )?general public", "general public", ("1 0", "2 0", "2", "3 0", "3", "")),
    ("mpl", "mozilla public", "mozilla", ("1 0", "1 1", "2 0", "")),
    ("epl", "eclipse public", "eclipse", ("1 0", "2 0", "")),
    ("cddl", "common development and distribution", "common development", ("1 0", "1 1", "")),
    ("cpl", "common public", "common public", ("1 0", "")),
    ("artistic", "artistic", "artistic licen", ("1 0", "2 0", "")),
    ("boost", "boost software", "boost", ("1 0", "")),
    ("isc", "isc", "isc licen", ("",)),
    ("zlib", "zlib(?: libpng)?", "zlib", ("",)),
    ("eupl", "european union public", "european union", ("1 0", "1 1", "1 2", "")),
    ("osl", "open software", "open software", ("1 0", "2 0", "2 1", "3 0", "")),
    ("afl", "academic free", "academic free", ("1 1", "2 0", "2 1", "3 0", "")),
    ("ms-pl", "microsoft public", "microsoft", ("",)),
    ("ms-rl", "microsoft reciprocal", "microsoft", ("",)),
    ("psf", "python software foundation", "python software", ("2", "")),
    ("ofl", "sil open font", "open font", ("1 0", "1 1", "")),
    ("unlicense", "the un", "unlicense", ("",)),
    ("wtfpl", "do what the fuck you want to public", "do what the", ("2", "")),
    ("ecl", "educational community", "educational community", ("1 0", "2 0", "")),
    ("gfdl", "(?:gnu )?free documentation", "free documentation", ("1 1", "1 2", "1 3", "")),
    ("odbl", "open (?:data commons open )?database", "database", ("1 0", "")),
    ("odc-by", "open data commons attribution", "open data commons", ("1 0", "")),
    ("php", "php", "php licen", ("3 0", "3 01", "")),
    ("vim", "vim", "vim licen", ("",)),
    ("ruby", "ruby", "ruby licen", ("",)),
    ("zpl", "zope public", "zope", ("1 1", "2 0", "2 1", "")),
    ("sspl", "server side public", "server side public", ("1", "")),
    ("bsl", "business source", "business source", ("1 1", "")),
    ("elastic", "elastic", "elastic licen", ("2 0", "")),
    ("qpl", "q public", "q public", ("1 0", "")),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", ("",)),
    ("upl", "universal permissive", "universal permissive", ("1 0", "")),
]

#: What stands around a family's name: priority, confidence, before, after ("V" is the version's place).
FORMS = [
    (10, 0.95, "(?:licensed|released|distributed|available|provided|covered|made available) under (?:the )?(?:terms of (?:the )?)?", " licen[cs]e(?: agreement)?V"),
    (20, 0.9, "(?:under|subject to|per) (?:the )?(?:terms of (?:the )?)?", " licen[cs]e(?: agreement)?V"),
    (40, 0.7, "", " licen[cs]e(?: agreement)?V"),
]

#: Creative Commons: the elements after "by", and versions.
CC_ELEMENTS = ("", "sa", "nc", "nd", "nc sa", "nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0", "")

#: Identifiers after "SPDX-License-Identifier", whose spaced words name the label themselves.
SPDX = ("mit", "apache 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "epl 2 0", "isc", "cc0 1 0", "unlicense", "zlib", "0bsd", "bsl 1 0", "artistic 2 0")

#: Signatures written by hand from the licences' own sentences: priority, label, confidence, keyword, regex.
#: A keyword stands in every match of its regex.
WRITTEN = """
15|mit|0.98|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software
15|mit|0.95|without restriction including|to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
16|mit|0.9|permission notice shall|(?:the above )?copyright notice and this permission notice shall be included in all copies or substantial portions
30|mit|0.85|mit license|(?:the )?mit license mit
30|mit|0.8|mit license|(?:see|under|use) (?:the )?(?:file )?mit license(?: file)?
15|mit-0|0.95|no attribution|mit no attribution
15|isc|0.98|permission to use|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
16|isc|0.85|the author disclaims|the software is provided as is and the author disclaims all warranties with regard to this software
15|bsd|0.95|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted
16|bsd|0.85|redistributions of source|redistributions of source code must retain the (?:above )?copyright notice
16|bsd|0.85|redistributions in binary|redistributions in binary form must reproduce the (?:above )?copyright notice
14|bsd-3|0.9|endorse or promote|(?:neither|nor) the names? of .{1,80} contributors may be used to endorse or promote products
14|bsd-4|0.9|advertising materials|all advertising materials mentioning features or use of this software must display
30|bsd|0.8|bsd style|(?:under|by|with) (?:a|the) bsd style licen[cs]e
30|bsd|0.7|bsd licensed|(?:is|are) bsd licensed
15|bsd-protection|0.9|bsd protection|bsd protection license
15|0bsd|0.9|zero clause bsd|(?:bsd )?zero clause bsd(?: licen[cs]e)?
15|apache-2.0|0.98|apache license version|licensed under the apache license version 2 0 the license
16|apache-2.0|0.9|compliance with the license|you may not use this (?:file|work|software) except in compliance with the license
16|apache-2.0|0.9|www apache org|(?:https? )?www apache org licenses license 2 0
30|apache|0.8|apache software|(?:this product includes|includes) software developed (?:by|at) the apache software foundation
30|apache-2.0|0.85|apache 2|(?:licen[cs]ed?|released|available) under (?:the )?apache 2(?: 0)?
15|gpl|0.95|free software|this program is free software you can redistribute it and or modify it
16|gpl|0.9|either version|either version (?:1|2|3) of the license or at your option any later version
16|gpl|0.85|hope that it will be useful|distributed in the hope that it will be useful but without any warranty
16|gpl|0.9|received a copy of the gnu|you should have received a copy of the gnu general public license
15|lgpl|0.95|received a copy of the gnu lesser|you should have received a copy of the gnu lesser general public license
15|lgpl|0.95|received a copy of the gnu library|you should have received a copy of the gnu library general public license
15|agpl|0.95|received a copy of the gnu affero|you should have received a copy of the gnu affero general public license
15|lgpl|0.95|this library is free|this library is free software you can redistribute it and or modify it
30|gpl|0.85|gnu gpl|(?:the )?gnu gpl(?: v[123])?
30|gpl-2.0|0.85|gplv2|(?:the )?(?:gnu )?gplv2
30|gpl-3.0|0.85|gplv3|(?:the )?(?:gnu )?gplv3
30|lgpl-2.1|0.85|lgplv2|(?:the )?(?:gnu )?lgplv2(?: 1)?
30|lgpl-3.0|0.85|lgplv3|(?:the )?(?:gnu )?lgplv3
30|agpl-3.0|0.85|agplv3|(?:the )?(?:gnu )?agplv3
31|gpl|0.7|gpl compatible|gpl compatible licen[cs]e
31|gpl|0.8|under the gpl|(?:licen[cs]ed|released|distributed|available) under the gpl
31|lgpl|0.8|under the lgpl|(?:licen[cs]ed|released|distributed|available) under the lgpl
31|agpl|0.8|under the agpl|(?:licen[cs]ed|released|distributed|available) under the agpl
20|gpl-classpath|0.9|classpath exception|(?:with (?:the )?)?classpath exception
20|gpl-linking|0.8|special exception|as a special exception the copyright holders? (?:of this library )?gives? you permission to link
20|gpl-font|0.8|font exception|(?:with (?:the )?)?font exception
15|gfdl|0.95|permission is granted to copy|permission is granted to copy distribute and or modify this document
20|gfdl|0.85|invariant sections|with no invariant sections no front cover texts and no back cover texts
15|mpl-2.0|0.98|source code form|this source code form is subject to the terms of the mozilla public license v 2 0
16|mpl|0.9|the contents of this file|the contents of this file are subject to the mozilla public license
20|mpl-2.0|0.85|incompatible with secondary|this source code form is incompatible with secondary licenses
16|npl|0.9|netscape public|the contents of this file are subject to the netscape public license
15|epl|0.95|this program and the accompanying|this program and the accompanying materials are made available under the terms of the eclipse public license
16|epl|0.85|eclipse org legal|(?:https? )?(?:www )?eclipse org legal epl v[12]0?
16|cddl|0.9|the contents of this file|the contents of this file are subject to the terms of the common development and distribution license
16|cpl|0.9|common public license|made available under the terms of the common public license
15|unlicense|0.98|public domain|this is free and unencumbered software released into the public domain
16|unlicense|0.9|anyone is free|anyone is free to copy modify publish use compile sell or distribute this software
16|unlicense|0.9|unlicense org|(?:https? )?(?:www )?unlicense org
15|zlib|0.95|any express or implied|this software is provided as is without any express or implied warranty in no event will the authors be held liable
16|zlib|0.9|must not be misrepresented|the origin of this software must not be misrepresented
16|zlib|0.9|altered source versions|altered source versions must be plainly marked as such
15|libpng|0.9|png reference library|(?:the )?(?:copyright notice for )?png reference library(?: license)?
15|libtiff|0.9|names of sam leffler|the names of sam leffler and silicon graphics may not be used
15|cc0|0.9|cc0|cc0(?: 1 0)?(?: universal)?
15|cc0|0.95|dedicated the work|the person who associated a work with this deed has dedicated the work to the public domain
16|cc0|0.85|no copyright|(?:cc0 )?no copyright public domain
16|cc0|0.9|publicdomain zero|(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
25|public-domain|0.8|public domain|(?:in|into|to) the public domain
26|public-domain|0.7|public domain|public domain (?:work|software|dedication|mark)
25|cc-by|0.85|creativecommons org|creativecommons org licenses by [1-4] [0-9]
24|cc-by-sa|0.85|creativecommons org|creativecommons org licenses by sa [1-4] [0-9]
24|cc-by-nc|0.85|creativecommons org|creativecommons org licenses by nc [1-4] [0-9]
24|cc-by-nd|0.85|creativecommons org|creativecommons org licenses by nd [1-4] [0-9]
23|cc-by-nc-sa|0.85|creativecommons org|creativecommons org licenses by nc sa [1-4] [0-9]
23|cc-by-nc-nd|0.85|creativecommons org|creativecommons org licenses by nc nd [1-4] [0-9]
30|cc|0.6|creative commons|(?:a|the|under) creative commons licen[cs]e
26|cc|0.7|some rights reserved|some rights reserved creative commons
15|artistic|0.95|perl itself|(?:you (?:can|may) redistribute it and or modify it )?under the same terms as perl itself
16|artistic|0.85|standard version|you may make and give away verbatim copies of the source form of the standard version
15|boost-1.0|0.95|boost org|(?:see )?(?:accompanying file license 1 0 txt or copy at )?(?:https? )?(?:www )?boost org license 1 0 txt
16|boost|0.9|machine executable object code|solely in the form of machine executable object code generated by a source language processor
15|wtfpl|0.95|you just do what|you just do what the fuck you want to
16|wtfpl|0.8|wtfpl|(?:the )?wtfpl(?: licen[cs]e)?
15|beerware|0.95|buy me a beer|you can buy me a beer in return
16|beerware|0.9|beer ware|(?:the )?beer ware licen[cs]e
15|jslint|0.9|used for good|the software shall be used for good not evil
15|openssl|0.9|openssl toolkit|(?:this product includes )?software developed by the openssl project for use in the openssl toolkit
16|ssleay|0.9|eric young|(?:this product includes )?cryptographic software written by eric young
15|curl|0.9|copyright and permission notice|copyright and permission notice copyright c [0-9]{4}(?: [0-9]{4})? daniel stenberg
15|x11|0.9|x consortium|the name of the x consortium shall not be used in advertising
15|hpnd|0.9|in advertising or publicity|not be used in advertising or publicity pertaining to distribution
15|ntp|0.85|without express or implied|it is provided as is without express or implied warranty
15|tcl|0.9|government use|government use if you are acquiring this software on behalf of the u s government
15|postgresql|0.95|university of california be liable|in no event shall the university of california be liable to any party
15|icu|0.9|international business machines|copyright c [0-9]{4}(?: [0-9]{4})? international business machines corporation and others
15|unicode|0.9|unicode inc|(?:copyright )?(?:c )?[0-9]{4}(?: [0-9]{4})? unicode inc
15|w3c|0.9|world wide web consortium|(?:copyright )?(?:c )?[0-9]{4}(?: [0-9]{4})? world wide web consortium
16|w3c|0.85|w3c software|w3c software (?:notice and )?(?:and document )?licen[cs]e
15|python|0.9|beopen python|beopen python open source license agreement
15|python|0.9|cnri|cnri (?:open source )?(?:gpl compatible )?license agreement
15|php|0.9|this product includes php|this product includes php(?: software)? freely available
15|ruby|0.85|ruby is copyrighted|ruby is copyrighted free software by yukihiro matsumoto
15|openldap|0.9|openldap public|(?:the )?openldap public license
15|sleepycat|0.9|sleepycat|(?:the )?sleepycat (?:public )?licen[cs]e
15|ofl-1.1|0.95|reserved font name|(?:licensed under the sil open font license version 1 1 )?with reserved font name
16|ofl|0.9|scripts sil org|(?:https? )?scripts sil org ofl
15|ubuntu-font|0.9|ubuntu font|(?:the )?ubuntu font licen[cs]e(?: version 1 0)?
15|bitstream-vera|0.9|bitstream vera|(?:the )?bitstream vera fonts? (?:copyright|licen[cs]e)
15|odbl|0.9|opendatacommons org|(?:https? )?(?:www )?opendatacommons org licenses odbl
15|odc-by|0.9|opendatacommons org|(?:https? )?(?:www )?opendatacommons org licenses by
15|pddl|0.9|opendatacommons org|(?:https? )?(?:www )?opendatacommons org licenses pddl
15|ogl|0.9|open government|(?:the )?open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?
15|etalab|0.9|licence ouverte|licence ouverte(?: open licence)?(?: version [12] 0)?
15|eupl|0.9|licensed under the eupl|licensed under the eupl(?: version)?(?: 1 [012])?
15|cecill|0.9|cecill|(?:the )?cecill(?: [abc])?(?: free software)? licen[cs]e
15|mulan|0.9|mulan|(?:the )?mulan (?:psl|publ|permissive software license)(?: v[12])?
15|llama|0.9|community license agreement|llama [234](?: [0-9])? community license agreement
15|openrail|0.9|openrail|(?:creativeml )?openrail(?: [ms])? licen[cs]e
15|sspl|0.9|sspl|(?:under )?(?:the )?sspl(?: v1)?
15|bsl|0.9|change license|(?:change date .{1,40} )?change license
15|commons-clause|0.95|commons clause|(?:the )?commons clause(?: license)?(?: condition)?(?: v1 0)?
15|polyform|0.9|polyform|polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e
15|elastic|0.85|hosted or managed service|provide the software to third parties as a hosted or managed service
15|cpal|0.9|common public attribution|(?:the )?common public attribution licen[cs]e
15|rpl|0.9|reciprocal public|(?:the )?reciprocal public licen[cs]e
15|ipl|0.9|ibm public|(?:the )?ibm public licen[cs]e
15|intel|0.85|intel open source|(?:the )?intel open source licen[cs]e
15|nokia|0.85|nokia open source|(?:the )?nokia open source licen[cs]e
15|sun|0.85|sun industry standards|(?:the )?sun industry standards source licen[cs]e
15|apsl|0.9|apple public source|(?:the )?apple public source licen[cs]e
15|watcom|0.9|sybase open watcom|(?:the )?sybase open watcom public licen[cs]e
15|ms-pl|0.85|ms pl|(?:microsoft )?ms pl licen[cs]e
15|latex|0.9|latex project public|(?:the )?latex project public licen[cs]e
15|gutenberg|0.95|project gutenberg|(?:the )?(?:full )?project gutenberg(?: tm)? licen[cs]e
16|gutenberg|0.9|project gutenberg|this ebook is for the use of anyone anywhere .{0,80}project gutenberg license
15|wikipedia|0.85|share alike license|text is available under the creative commons attribution share alike license
15|stackexchange|0.85|user contributions|user contributions licensed under cc by sa
20|dual|0.7|dual licensed|(?:is |are )?dual licensed under
20|proprietary|0.8|proprietary and confidential|(?:is |are )?proprietary and confidential
20|proprietary|0.8|unauthorized copying|unauthorized copying of this file via any medium is strictly prohibited
20|proprietary|0.7|prior written permission|without (?:the )?(?:express )?prior written permission of
20|proprietary|0.7|may not be reproduced|may not be reproduced (?:or )?(?:distributed |transmitted |stored )?(?:in any form|without)
20|non-commercial|0.7|non commercial|for non commercial (?:use|purposes) only
20|non-commercial|0.7|noncommercial|for noncommercial (?:use|purposes) only
20|personal-use|0.7|personal use|for personal use only
20|research|0.7|research purposes|for (?:academic (?:and|or) )?research purposes only
20|evaluation|0.7|evaluation purposes|for evaluation purposes only
20|no-derivatives|0.6|derivative works|no derivative works
20|share-alike|0.6|share alike|(?:attribution )?share alike licen[cs]e
20|trademark|0.5|registered trademark|(?:is|are) (?:a )?registered trademarks? of
20|patent|0.6|patent license|(?:perpetual )?(?:worldwide )?(?:non exclusive )?(?:no charge )?(?:royalty free )?(?:irrevocable )?patent license
20|eula|0.8|end user license|end user license agreement
21|eula|0.7|installing or using|by installing or using (?:the|this) software
21|eula|0.6|by clicking|by clicking (?:on )?(?:i )?(?:agree|accept)
40|license|0.4|license file|see (?:the )?license file for (?:more )?(?:details|information|terms)
40|license|0.4|licence file|see (?:the )?licence file for (?:more )?(?:details|information|terms)
40|license|0.4|license terms|(?:subject to|under) the (?:following )?license terms
40|terms|0.4|terms of use|(?:subject to|see|by) (?:our|the) terms of use
40|terms|0.4|terms of service|(?:subject to|see|by) (?:our|the) terms of service
50|warranty|0.4|warrant|without warrant(?:y|ies) of any kind
50|warranty|0.4|merchantability|implied warrant(?:y|ies) of merchantability
50|warranty|0.4|particular purpose|fitness for a particular purpose
50|warranty|0.3|provided as is|provided as is
50|warranty|0.3|on an as is|provided on an as is
50|liability|0.4|be liable|in no event shall .{1,80} be liable for any
50|liability|0.4|at your own risk|use (?:it |this (?:software )?)?at your own risk
60|copyright|0.5|copyright|copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
60|reserved|0.5|rights reserved|(?:all|some|no) rights reserved
70|copyright|0.2|copyright|copyright
80|license|0.3|licen|licen[cs]ed? under
"""


def written_rules() -> list[Rule]:
    """The signatures of ``WRITTEN``."""
    parts = [line.split("|", 4) for line in WRITTEN.split("\n") if line]
    return [Rule(int(priority), label, keyword, regex, float(confidence)) for priority, label, confidence, keyword, regex in parts]


def rules() -> list[Rule]:
    """All signatures, built from the families, forms and identifiers above; a named version outranks none."""
    out = written_rules()
    for label, name, keyword, versions in FAMILIES:
        for priority, confidence, before, after in FORMS:
            for v in versions:
                tail = f"(?: as published by the free software foundation)?(?: version| v)? v?{v}(?: or (?:any )?later)?" if v else ""
                own = "unlicense" if label == "unlicense" else name + after.replace("V", tail)
                out.append(Rule(priority + (0 if v else 5), label + ("-" + v.replace(" ", ".") if v else ""), keyword, before + own, confidence))
    for element in CC_ELEMENTS:
        for v in CC_VERSIONS:
            label = "-".join(["cc-by", *element.split(), *([v.replace(" ", ".")] if v else [])])
            long = "attribution" + "".join({"sa": " share ?alike", "nc": " non ?commercial", "nd": " no ?deriv(?:s|atives)"}[e] for e in element.split())
            out.append(Rule(12 + (0 if v else 5) + 3 * (2 - len(element.split())), label, "cc by", f"(?:licen[cs]ed under (?:a |the )?)?cc by{' ' * bool(element)}{element}{' ' * bool(v)}{v}", 0.9))
            out.append(Rule(12 + (0 if v else 5) + 3 * (2 - len(element.split())), label, "creative commons", f"(?:licen[cs]ed under (?:a |the )?)?creative commons {long}(?: international| unported)?(?: licen[cs]e)?{' ' * bool(v)}{v}", 0.9))
    out += [Rule(5, "spdx-" + x.replace(" ", "-"), "spdx", f"spdx license identifier {x}", 0.99) for x in SPDX]
    return out


def alternation(words: list[str]) -> str:
    """A regex for any of ``words``, with common beginnings written once."""
    if "" in words:
        return ""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    parts = [re.sub(r"([^\w ])", r"\\\1", c) + alternation(t) for c, t in sorted(tails.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def gate(table: list[Rule]) -> str:
    """Texts that don't match this regex hold neither a rule's keyword nor a base phrase."""
    words = sorted({r.keyword for r in table} | set(BASE), key=lambda w: (len(w), w))
    least = [w for k, w in enumerate(words) if not any(x in w for x in words[:k])]  # a word inside another one stands for both
    return "(?i)" + alternation(least)


def _detections(line: Column, table: Column) -> Column:
    """array<struct<start, size, level, rank, label, confidence>> of all rules whose keyword the line holds.

    ``size`` is negative, so that sorting brings the longest of those that begin together to the front.
    """

    def of(r: Column) -> Column:
        found = match_spans(line, F.concat(F.lit("(?<= )(?:"), r["regex"], F.lit(")(?= )")))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("size"), r["level"].alias("level"), r["rank"].alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(line, r["keyword"])), of))


def _kept(found: Column, levels: int) -> Column:
    """What no other detection that holds it suppresses.

    One sweep by start, longest first, then by priority and rank: what holds a detection comes before it. The state has
    for each priority the farthest end of the detections up to there that have it or a higher one.
    """

    def end(d: Column) -> Column:
        return d["start"] - d["size"]

    def reach(state: Column, d: Column) -> Column:
        return F.transform(state, lambda e, level: F.when(level >= d["level"], F.greatest(e, end(d))).otherwise(e))

    def mark(state: Column, d: Column) -> Column:
        return F.struct((F.get(state, d["level"]) < end(d)).alias("kept"), d["label"].alias("label"), d["confidence"].alias("confidence"))

    marked = running(F.array_sort(found), F.array(*[F.lit(-1)] * levels), reach, mark, "struct<kept:boolean,label:string,confidence:double>")
    return F.filter(marked, lambda d: d["kept"])


def scan_licenses(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score is 1 - the product of (1 - confidence) over the distinct labels found.
    """
    used = rules() if signatures is None else signatures
    levels = sorted({r.priority for r in used})
    listed = [{"rank": k, "level": levels.index(r.priority), "label": r.label, "keyword": r.keyword, "regex": r.regex, "confidence": r.confidence} for k, r in enumerate(used)]
    # one literal, which is parsed once
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<rank:int,level:int,label:string,keyword:string,regex:string,confidence:double>>")
    line = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BETWEEN, " ")
    d = docs.select("doc_id", line.alias("line"))
    d = d.select("doc_id", F.size(F.array_remove(F.split("line", " "), "")).cast("long").alias("n_words"), F.when(F.col("line").rlike(gate(used)), F.concat(F.lit(" "), F.trim(ascii_lower(F.col("line"))), F.lit(" "))).alias("line"))
    d = d.withColumn("w", F.when(F.col("line").isNotNull(), F.split(F.trim("line"), " ")))

    def at(i: Column, phrase: str) -> Column:
        same = [F.get(F.col("w"), i + k) == x for k, x in enumerate(phrase.split())]
        out = same[0]
        for x in same[1:]:
            out &= x
        return out

    def any_phrase(i: Column) -> Column:
        a, b, c = (at(i, p) for p in BASE)
        return a | b | c

    held = F.lit(False)
    for p in BASE:
        held |= F.contains("line", F.lit(f" {p} "))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), any_phrase)
    d = d.withColumn("places", F.when(held, places).otherwise(F.expr("CAST(array() AS array<int>)")))
    d = d.withColumn("base", F.array_compact(F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), F.lit(x)) for p, x in BASE.items()])))
    d = d.withColumn("found", F.when(F.col("line").isNotNull(), _kept(_detections(F.col("line"), table), len(levels))))
    d = d.withColumn("sure", F.coalesce(F.array_distinct(F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence")))), F.expr("CAST(array() AS array<struct<label:string,confidence:double>>)")))
    return d.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("sure", lambda x: x["label"]))), ",").alias("labels"),
        (1 - F.aggregate("sure", F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(1.0)), lambda acc, x: acc * (1 - x["confidence"]))).alias("score"),
    )

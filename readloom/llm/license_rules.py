"""The ordered signature rules of the license scan (operator 13).

Patterns are regular expressions over a text's words, lower-cased and joined by one space, so "GPL-3.0" reads "gpl 3 0". A rule
names the words that must all occur before its pattern is tried. Smaller priorities go first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The phrases of the base, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Priorities and confidences of the kinds of rules.
IDENTIFIER, SENTENCE, NOTICE, ADDRESS, NAME = 10, 20, 30, 40, 50
CONFIDENCE = {IDENTIFIER: 1.0, SENTENCE: 1.0, NOTICE: 0.95, ADDRESS: 0.9, NAME: 0.7}
BASE_CONFIDENCE = 0.9

_L = "licen[sc]e"
_GNU = "(?:gnu )?"
_V = "(?: ?,? version| v| ver)?"

#: label | words that must occur | short identifier after "spdx license identifier" | name in prose
LICENSES = rf"""
mit | mit | mit | (?:the )?(?:mit|expat) (?:open source )?{_L}
mit-0 | mit | mit 0 | mit no attribution(?: {_L})?
mit-cmu | cmu | mit cmu | cmu (?:mit )?{_L}
x11 | x11 | x11 | (?:mit )?x11 {_L}
isc | isc | isc | isc {_L}
apache-1.0 | apache | apache 1 0 | apache(?: software)? {_L}{_V} v?1 0
apache-1.1 | apache | apache 1 1 | apache(?: software)? {_L}{_V} v?1 1
apache-2 | apache | apache 2 0 | apache(?: software)?(?: {_L})?{_V} ?v?2(?: 0)?(?: {_L})?
bsd-4-clause | bsd | bsd 4 clause | (?:4|four) clause bsd(?: {_L})?|bsd (?:4|four) clause(?: {_L})?|original bsd {_L}
bsd-3-clause | bsd | bsd 3 clause | (?:3|three) clause bsd(?: {_L})?|bsd (?:3|three) clause(?: {_L})?|(?:new|modified|revised) bsd {_L}
bsd-2-clause | bsd | bsd 2 clause | (?:2|two) clause bsd(?: {_L})?|bsd (?:2|two) clause(?: {_L})?|(?:simplified|freebsd) bsd {_L}
bsd-1-clause | bsd | bsd 1 clause | (?:1|one) clause bsd(?: {_L})?|bsd (?:1|one) clause(?: {_L})?
0bsd | 0bsd | 0bsd | 0bsd(?: {_L})?
bsd | bsd | bsd | bsd(?: style)? {_L}
gpl-1 | gpl | gpl 1 0(?: only| or later)? | {_GNU}gpl ?v?1(?: 0)?
gpl-2 | gpl | gpl 2 0(?: only)? | {_GNU}gpl{_V} ?v?2(?: 0)?(?: only)?
gpl-2-or-later | gpl | gpl 2 0 or later | {_GNU}gpl{_V} ?v?2(?: 0)? or (?:later|any later version|newer)
gpl-3 | gpl | gpl 3 0(?: only)? | {_GNU}gpl{_V} ?v?3(?: 0)?(?: only)?
gpl-3-or-later | gpl | gpl 3 0 or later | {_GNU}gpl{_V} ?v?3(?: 0)? or (?:later|any later version|newer)
gpl-2 | general public | general public 2 | (?:the )?{_GNU}general public {_L}{_V} v?2(?: 0)?
gpl-3 | general public | general public 3 | (?:the )?{_GNU}general public {_L}{_V} v?3(?: 0)?
gpl | general public | general public | (?:the )?gnu general public {_L}
gpl-2 | gplv2 | gplv2 | {_GNU}gplv2
gpl-2-or-later | gplv2 later | gplv2 or later | {_GNU}gplv2 or (?:later|any later version|newer)
gpl-3 | gplv3 | gplv3 | {_GNU}gplv3
gpl-3-or-later | gplv3 later | gplv3 or later | {_GNU}gplv3 or (?:later|any later version|newer)
lgpl-2.1 | lgplv2 | lgplv2 1 | {_GNU}lgplv2 1
lgpl-3 | lgplv3 | lgplv3 | {_GNU}lgplv3
agpl-3 | agplv3 | agplv3 | {_GNU}agplv3
lgpl-2 | lgpl | lgpl 2 0(?: only| or later)? | {_GNU}lgpl{_V} ?v?2(?: 0)?
lgpl-2.1 | lgpl | lgpl 2 1(?: only| or later)? | {_GNU}lgpl{_V} ?v?2 1
lgpl-3 | lgpl | lgpl 3 0(?: only| or later)? | {_GNU}lgpl{_V} ?v?3(?: 0)?
lgpl-2.1 | lesser general public | lesser general public 2 1 | (?:the )?{_GNU}lesser general public {_L}{_V} v?2 1
lgpl-3 | lesser general public | lesser general public 3 | (?:the )?{_GNU}lesser general public {_L}{_V} v?3(?: 0)?
lgpl | general public | lesser general public | (?:the )?gnu (?:lesser|library) general public {_L}
agpl-3 | agpl | agpl 3 0(?: only| or later)? | {_GNU}agpl{_V} ?v?3(?: 0)?
agpl-3 | affero | affero 3 | (?:the )?{_GNU}affero general public {_L}{_V} v?3(?: 0)?
agpl | affero | affero | (?:the )?gnu affero general public {_L}
gfdl | gnu documentation | gfdl 1 [123](?: only| or later)? | gnu free documentation {_L}
mpl-1.1 | mozilla | mpl 1 1 | mozilla public {_L}{_V} v?1 1
mpl-2 | mozilla | mpl 2 0 | mozilla public {_L}{_V} v?2(?: 0)?
mpl-2 | mpl | mpl 2 0 | mpl{_V} ?v?2(?: 0)?
mpl | mozilla | mozilla public license | mozilla public {_L}
epl-1 | eclipse | epl 1 0 | eclipse public {_L}{_V} v?1(?: 0)?
epl-2 | eclipse | epl 2 0 | eclipse public {_L}{_V} v?2(?: 0)?
edl-1 | eclipse | edl 1 0 | eclipse distribution {_L}{_V}(?: v?1 0)?
cddl-1 | cddl | cddl 1 0 | cddl{_V} ?v?1(?: 0)?
cddl-1.1 | cddl | cddl 1 1 | cddl{_V} ?v?1 1
cddl | common development | cddl | common development and distribution {_L}
cpl-1 | common | cpl 1 0 | common public {_L}{_V}(?: v?1 0)?
ipl-1 | ibm | ipl 1 0 | ibm public {_L}{_V}(?: v?1 0)?
osl-3 | open software | osl 3 0 | open software {_L}{_V} ?v?3(?: 0)?
afl-3 | academic | afl 3 0 | academic free {_L}{_V} ?v?3(?: 0)?
artistic-1 | artistic | artistic 1 0 | artistic {_L}{_V} v?1(?: 0)?
artistic-2 | artistic | artistic 2 0 | artistic {_L}{_V} v?2(?: 0)?
artistic | artistic | artistic | (?:the )?artistic {_L}
bsl-1 | boost | bsl 1 0 | boost software {_L}{_V}(?: v?1 0)?
busl-1.1 | business source | busl 1 1 | business source {_L}{_V}(?: v?1 1)?
sspl-1 | sspl | sspl 1 0 | sspl{_V} ?v?1?(?: 0)?
sspl-1 | server side | server side | server side public {_L}
elastic-2 | elastic | elastic 2 0 | elastic {_L}{_V} v?2(?: 0)?
zlib | zlib | zlib | zlib(?: libpng)? {_L}
libpng | libpng | libpng 2 0 | libpng {_L}
openssl | openssl | openssl | openssl {_L}
python-2 | python | python 2 0 | python software foundation {_L}(?:{_V} v?2)?
psf-2 | psf | psf 2 0 | psf {_L}(?:{_V} v?2)?
php-3 | php | php 3 0(?: 1)? | php {_L}{_V} v?3(?: 0)?(?: 1)?
ruby | ruby | ruby | ruby {_L}
perl | perl | perl | same terms as perl(?: itself)?
postgresql | postgresql | postgresql | postgresql {_L}
unlicense | unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl | wtfpl(?:{_V} ?v?2)?
beerware | beer | beerware | beer ?ware {_L}
ncsa | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? {_L}
w3c | w3c | w3c | w3c software (?:notice and )?{_L}
upl-1 | universal | upl 1 0 | universal permissive {_L}{_V}(?: v?1 0)?
eupl-1.1 | eupl | eupl 1 1 | eupl{_V} ?v?1 1
eupl-1.2 | eupl | eupl 1 2 | eupl{_V} ?v?1 2
eupl | european | eupl | european union public {_L}
cecill | cecill | cecill(?: [bc12](?: [01])?)? | cecill(?: free software)? {_L}
ms-pl | microsoft | ms pl | microsoft public {_L}
ms-rl | microsoft | ms rl | microsoft reciprocal {_L}
ofl-1.1 | ofl | ofl 1 1 | (?:sil )?ofl{_V} ?v?1 1
ofl-1.1 | font | sil open font | (?:sil )?open font {_L}
odbl-1 | odbl | odbl 1 0 | odbl(?:{_V} ?v?1(?: 0)?)?
odbl-1 | database | open database | open (?:data commons )?(?:open )?database {_L}
odc-by-1 | attribution | odc by 1 0 | open data commons attribution {_L}
pddl-1 | pddl | pddl 1 0 | pddl(?:{_V} ?v?1(?: 0)?)?
cdla-permissive | cdla | cdla permissive [12] 0 | community data {_L} agreement permissive
cdla-sharing | cdla | cdla sharing 1 0 | community data {_L} agreement sharing
ogl-uk | government | ogl uk [123] 0 | open government {_L}{_V}(?: v?[123](?: 0)?)?
cc0 | cc0 | cc0 1 0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc-pdm | public domain | cc pddc | public domain mark(?: 1 0)?
cc-by-nc-nd | cc nc nd | cc by nc nd [1234] [05](?: \w+)? | cc by nc nd(?: [1234] [05])?
cc-by-nc-sa | cc nc sa | cc by nc sa [1234] [05](?: \w+)? | cc by nc sa(?: [1234] [05])?
cc-by-nc | cc by nc | cc by nc [1234] [05](?: \w+)? | cc by nc(?: [1234] [05])?
cc-by-nd | cc by nd | cc by nd [1234] [05](?: \w+)? | cc by nd(?: [1234] [05])?
cc-by-sa | cc by sa | cc by sa [1234] [05](?: \w+)? | cc by sa(?: [1234] [05])?
cc-by | cc by | cc by [1234] [05](?: \w+)? | cc by(?: [1234] [05])
cc-by-nc-nd | creative commons noncommercial | creative commons nc nd | creative commons attribution non ?commercial no ?deriv(?:ative|ative work|ativework|ative)?s?(?: [1234] [05])?
cc-by-nc-sa | creative commons noncommercial | creative commons nc sa | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc | creative commons noncommercial | creative commons nc | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-sa | creative commons attribution | creative commons sa | creative commons attribution share ?alike(?: [1234] [05])?
cc-by | creative commons attribution | creative commons by | creative commons attribution(?: [1234] [05])?(?: international)?(?: {_L})?
bigscience-openrail | openrail | bigscience openrail m | (?:bigscience )?openrail m?(?: {_L})?
proprietary | proprietary | licenseref proprietary | proprietary (?:software )?{_L}
"""  # fmt: skip

#: label | words that must occur | a sentence of the license's own text or of its usual notice
SENTENCES = rf"""
mit | permission hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | merchantability noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | permission fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
0bsd | permission fee disclaims | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims
bsd | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd-2-clause | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse promote | neither the name of (?:\w+ ){{1,12}}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | endorse promote | the names? of (?:\w+ ){{1,12}}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | apache compliance | licensed under the apache {_L} version 2 0 the {_L} you may not use this (?:file|software|work) except in compliance with the {_L}
apache-2 | compliance obtain | you may not use this file except in compliance with the {_L} you may obtain a copy of the {_L} at
apache-2 | asf contributor | licensed to the apache software foundation asf under one or more contributor {_L} agreements
apache-2 | terms reproduction | terms and conditions for use reproduction and distribution
gpl | free redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public {_L}
gpl-2-or-later | free redistribute | this (?:program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public {_L} as published by the free software foundation either version 2 of the {_L} or at your option any later version
gpl-3-or-later | free redistribute | this (?:program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public {_L} as published by the free software foundation either version 3 of the {_L} or at your option any later version
gpl-2 | gnu june | gnu general public {_L} version 2 june 1991
gpl-3 | gnu june | gnu general public {_L} version 3 29 june 2007
gpl | hope useful warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | received copy gnu | you should have received a copy of the gnu general public {_L} along with this program
lgpl | received copy gnu | you should have received a copy of the gnu (?:lesser|library) general public {_L} along with this
lgpl-2.1 | gnu february | gnu lesser general public {_L} version 2 1 february 1999
lgpl-3 | gnu june lesser | gnu lesser general public {_L} version 3 29 june 2007
lgpl | library redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {_L}
agpl | affero redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public {_L}
agpl-3 | affero november | gnu affero general public {_L} version 3 19 november 2007
gfdl | permission invariant | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_L}
mpl-2 | mozilla subject | this source code form is subject to the terms of the mozilla public {_L} v(?:ersion)? ?2 0
mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public {_L} version 1 1
mpl-2 | mpl obtain | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {_L} v(?:ersion)? ?1 0
epl-2 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {_L} v(?:ersion)? ?2 0
cddl | cddl contents | the contents of this file are subject to the terms of the common development and distribution {_L}
artistic-2 | artistic package | everyone is permitted to copy and distribute verbatim copies of this {_L} document but changing it is not allowed the artistic {_L}
bsl-1 | boost august | boost software {_L} version 1 0 august 17th 2003
bsl-1 | permission organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this {_L}
zlib | misrepresented origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
wtfpl | want public | do what the fuck you want to public {_L}
beerware | beer think | if we meet some day and you think this stuff is worth it you can buy me a beer
ofl-1.1 | font february | sil open font {_L} version 1 1 26 february 2007
postgresql | permission paragraphs | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | permission deal | to deal with the software without restriction including without limitation the rights to use copy modify merge
cc0 | waived dedicated | the person who associated a work with this deed has dedicated the work to the public domain by waiving
cc0 | extent waived | to the extent possible under law (?:\w+ ){{1,12}}has waived all copyright and related or neighboring rights
cc-by | creative commons | this work is licensed under (?:a|the) creative commons attribution(?: [1234] [05])?(?: international| unported)? {_L}
cc-by-sa | creative commons | this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)? {_L}
cc-by-nc | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)? {_L}
cc-by-nc-sa | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)? {_L}
cc-by-nc-nd | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv\w*(?: [1234] [05])?(?: international| unported)? {_L}
public-domain | public domain | (?:this (?:work|software|file|code)|it) is (?:hereby )?(?:in|placed in|released into|dedicated to) the public domain
public-domain | public domain | (?:placed|released) in(?:to)? the public domain
all-rights-reserved | copyright rights | copyright (?:c )?(?:\w+ ){{1,8}}all rights reserved
proprietary | confidential proprietary | this (?:software|document|file) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized prohibited | unauthori[sz]ed copying of this (?:file|software) via any medium is strictly prohibited
perl | free perl | this (?:program|library|module) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl
"""  # fmt: skip

#: label | words that must occur | an address, its punctuation being spaces
ADDRESSES = """
mit | opensource mit | opensource org licen[sc]es? mit
apache-2 | apache org | apache org licen[sc]es license 2 0
apache-2 | opensource apache | opensource org licen[sc]es? apache 2 0
bsd-2-clause | opensource bsd | opensource org licen[sc]es? bsd 2 clause
bsd-3-clause | opensource bsd | opensource org licen[sc]es? bsd 3 clause
isc | opensource isc | opensource org licen[sc]es? isc
gpl | gnu org | gnu org (?:licen[sc]es|copyleft) gpl
gpl-2 | gnu org | gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0
gpl-3 | gnu org | gnu org licen[sc]es gpl 3 0
lgpl | gnu org | gnu org (?:licen[sc]es|copyleft) lesser
agpl-3 | gnu org agpl | gnu org licen[sc]es agpl 3 0
mpl-2 | mozilla org mpl | mozilla org (?:en us )?mpl 2 0
epl-1 | eclipse org | eclipse org legal epl v10
epl-2 | eclipse org | eclipse org legal epl (?:v20|2 0)
bsl-1 | boost org | boost org license 1 0
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
ofl-1.1 | sil org ofl | (?:scripts )?sil org ofl
cc0 | creativecommons zero | creativecommons org publicdomain zero 1 0
cc-pdm | creativecommons mark | creativecommons org publicdomain mark 1 0
cc-by | creativecommons by | creativecommons org licen[sc]es by [1234] [05]
cc-by-sa | creativecommons by sa | creativecommons org licen[sc]es by sa [1234] [05]
cc-by-nc | creativecommons by nc | creativecommons org licen[sc]es by nc [1234] [05]
cc-by-nd | creativecommons by nd | creativecommons org licen[sc]es by nd [1234] [05]
cc-by-nc-sa | creativecommons by nc sa | creativecommons org licen[sc]es by nc sa [1234] [05]
cc-by-nc-nd | creativecommons by nc nd | creativecommons org licen[sc]es by nc nd [1234] [05]
odbl-1 | opendatacommons odbl | opendatacommons org licen[sc]es odbl
"""  # fmt: skip

_UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|shared|offered|contributed|issued|governed) (?:\w+ )?(?:under|by) (?:(?:the|a) )?(?:terms (?:and conditions )?of (?:(?:the|a) )?|conditions of (?:(?:the|a) )?)?"


@dataclass(frozen=True)
class Rule:
    """words: those that must all occur in a text before the pattern is tried."""

    name: str
    label: str
    priority: int
    words: frozenset[bytes]
    pattern: re.Pattern

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.priority]


def _table(text: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in text.strip().splitlines()]


def _rule(label: str, priority: int, words: str, pattern: str, number: int) -> Rule:
    whole = rf"(?<![^ ])(?:{pattern})(?![^ ])"
    return Rule(f"{label}/{priority}/{number}", label, priority, frozenset(w.encode() for w in words.split()), re.compile(whole.encode()))


def _prose(words: str) -> str:
    """Words that the name in prose needs: "noncommercial" may also be written as two words."""
    return " ".join(w for w in words.split() if w != "noncommercial")


def rules() -> list[Rule]:
    """All rules in order of priority."""
    made = []
    for number, (label, words, short, prose) in enumerate(_table(LICENSES)):
        made.append(_rule(label, IDENTIFIER, "spdx identifier", f"spdx licen[sc]e identifier {short}", number))
        made.append(_rule(label, NOTICE, _prose(words), f"{_UNDER}(?:{prose})", number))
        made.append(_rule(label, NAME, _prose(words), prose, number))
    made += [_rule(label, SENTENCE, words, pattern, number) for number, (label, words, pattern) in enumerate(_table(SENTENCES))]
    made += [_rule(label, ADDRESS, words, pattern, number) for number, (label, words, pattern) in enumerate(_table(ADDRESSES))]
    return sorted(made, key=lambda r: r.priority)

"""Signature rules for licence statements, and how they become regular expressions.

A text is looked at as its words, each between two spaces of its own (" a  b  c "), so a regular expression never looks
beyond what it matches. In a rule the words stand one after the other, each a regular expression of one word:

    LIC      license, licence and their plurals and participles
    ~word    a word that may be missing
    ..n      at most n words of any kind, as few as will do
    {2.0}    a version: "2.0", "2", "v2", "version 2.0"; {2.1} needs the second number
    @        a version of the list that ends the line

Every label also gets the rule of its identifier line ("SPDX-License-Identifier: ...").
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Priorities: what is certain beats what is vague where one place is inside the other.
GENERIC, SHORT, NAME, VERSIONED, TEXT, TAG = range(6)
#: How sure a rule of each priority is that a text states terms of use.
SURE = {GENERIC: 0.25, SHORT: 0.5, NAME: 0.75, VERSIONED: 0.875, TEXT: 0.9375, TAG: 1.0}


class Rule(NamedTuple):
    rule: int
    label: str
    priority: int
    base: bool
    needs: list[str]
    regex: str


#: The phrases that always count, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label; what a text must hold; words.
_TEXT = """
mit; permission is hereby; permission is hereby granted free of charge to any person obtaining a copy ..4 software and associated documentation
mit; without restriction; to deal in the software without restriction including without limitation the rights to use copy modify merge
mit; noninfringement; the software is provided as is ..4 warranty of any kind ..12 noninfringement
isc; permission to use; permission to use copy modify and ~or distribute this software for any purpose with or without fee is hereby granted
0bsd; permission to use; permission to use copy modify and ~or distribute this software for any purpose with or without fee is hereby granted the software
bsd; redistribution and use; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; endorse or promote; neither the name ..12 nor the names of ..4 contributors may be used to endorse or promote products
bsd-4-clause; advertising materials; all advertising materials mentioning features or use of this software must display
apache-2.0; you may not use this file; you may not use this file except in compliance with the LIC
apache-2.0; distributed on an as is; unless required by applicable law or agreed to in writing software ..4 distributed on an as is basis
apache-2.0; under one or more contributor; licensed to ..6 under one or more contributor LIC agreements
gpl; free software; this program is free software you can redistribute it and or modify it
gpl-3.0; general public; terms of the gnu general public LIC as published by the free software foundation ~either {3.0}
gpl-2.0; general public; terms of the gnu general public LIC as published by the free software foundation ~either {2.0}
gpl-3.0-or-later; general public; gnu general public LIC ..12 {3.0} of the LIC or ~at ~your ~option any later version
gpl-2.0-or-later; general public; gnu general public LIC ..12 {2.0} of the LIC or ~at ~your ~option any later version
gpl-2.0-only; general public; gnu general public LIC {2.0} only
gpl-3.0-only; general public; gnu general public LIC {3.0} only
gpl-3.0; should have received; you should have received a copy of the gnu general public LIC
lgpl; should have received; you should have received a copy of the gnu (?:lesser|library) general public LIC
agpl-3.0; should have received; you should have received a copy of the gnu affero general public LIC
gpl; absolutely no warranty; comes with absolutely no warranty
gpl; merchantability or fitness; without even the implied warranty of merchantability or fitness for a particular purpose
mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public LIC ~v {2.0}
mpl-2.0; mozilla; if a copy of the mpl was not distributed with this file you can obtain one at ~https? mozilla org
epl-2.0; eclipse; this program and the accompanying materials are made available under the terms of the eclipse public LIC {2.0}
epl-1.0; eclipse; this program and the accompanying materials are made available under the terms of the eclipse public LIC {1.0}
cddl-1.0; development and; subject to the terms of the common development and distribution LIC
unlicense; unencumbered; this is free and unencumbered software released into the public domain
wtfpl; what the; you just do what the ..1 you want to
zlib; misrepresented; the origin of this software must not be misrepresented
zlib; held liable; in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0; or organization; permission is hereby granted free of charge to any person or organization obtaining a copy
cc0-1.0; extent possible; to the extent possible under law ..6 waived all copyright and related or neighboring rights
ofl-1.1; font; this font software is licensed under the sil open font LIC
artistic-2.0; artistic; you may distribute ..10 artistic LIC {2.0}
python-2.0; python; this LIC agreement is between the python software foundation
openssl; openssl; this product includes software developed by the openssl project
hpnd; its documentation; permission to use copy modify and distribute this software and its documentation for any purpose without fee
ncsa; illinois; university of illinois ncsa open source LIC
proprietary; confidential; proprietary and confidential
proprietary; confidential; confidential and proprietary
proprietary; unauthorized; unauthorized ..2 copying ..4 strictly prohibited
proprietary; prior written; no part of this ..3 may be reproduced ..12 prior written permission
proprietary; not be; may not be reproduced ..4 distributed ..8 without ..4 permission
proprietary; confidential; this ..3 contains ..3 confidential ..3 information
proprietary; trade; trade secrets? of
"""

_VERSIONED = """
apache-@; apache; ~the apache ~software LIC {@} <1.0 1.1 2.0>
gpl-@; general public; ~gnu general public LIC {@} <1.0 2.0 3.0>
lgpl-@; general public; ~gnu (?:lesser|library) general public LIC {@} <2.0 2.1 3.0>
agpl-@; affero; ~gnu affero general public LIC {@} <1.0 3.0>
gfdl-@; documentation; ~gnu free documentation LIC {@} <1.1 1.2 1.3>
mpl-@; mozilla; mozilla public LIC {@} <1.0 1.1 2.0>
epl-@; eclipse; eclipse public LIC {@} <1.0 2.0>
eupl-@; european; european union public LIC {@} <1.0 1.1 1.2>
cddl-@; distribution; common development and distribution LIC {@} <1.0 1.1>
cpl-@; common; common public LIC {@} <1.0>
ipl-@; ibm; ibm public LIC {@} <1.0>
bsl-@; boost; boost software LIC {@} <1.0>
artistic-@; artistic; artistic LIC {@} <1.0 2.0>
afl-@; academic; academic free LIC {@} <1.1 2.0 2.1 3.0>
osl-@; open; open software LIC {@} <1.0 2.0 2.1 3.0>
cecill-@; cecill; cecill ~free ~software ~LIC ~agreement {@} <1.0 2.0 2.1>
ofl-@; font; ~sil open font LIC {@} <1.0 1.1>
odbl-@; database; open ~data ~commons ~open database LIC {@} <1.0>
odc-by-@; commons; open data commons attribution LIC {@} <1.0>
pddl-@; dedication; public domain dedication and LIC {@} <1.0>
qpl-@; q public; q public LIC {@} <1.0>
lppl-@; latex; latex project public LIC {@} <1.0 1.1 1.2 1.3>
zpl-@; zope; zope public LIC {@} <1.1 2.0 2.1>
php-@; php; php LIC {@} <3.0 3.01>
python-@; python; python software foundation LIC {@} <2.0>
ms-pl; microsoft; microsoft public LIC
ms-rl; microsoft; microsoft reciprocal LIC
cc0-@; cc0; ~cc cc0 {@} <1.0>
cc0-1.0; commons; creative commons (?:zero|cc0) ~public ~domain ~dedication
bsd-2-clause; clause; 2 clause ~simplified ~new bsd ~LIC
bsd-3-clause; clause; 3 clause ~modified ~new bsd ~LIC
bsd-4-clause; clause; 4 clause ~original ~old bsd ~LIC
bsd-2-clause; bsd; bsd 2 clause ~simplified ~LIC
bsd-3-clause; bsd; bsd 3 clause ~new ~LIC
bsd-4-clause; bsd; bsd 4 clause ~LIC
bsd-2-clause; clause; two clause bsd ~LIC
bsd-3-clause; clause; three clause bsd ~LIC
bsd-2-clause; bsd; (?:simplified|freebsd) bsd LIC
bsd-3-clause; bsd; (?:modified|revised|new) bsd LIC
upl-@; universal; universal permissive LIC {@} <1.0>
ecl-@; educational; educational community LIC {@} <1.0 2.0>
sspl-@; server; server side public LIC {@} <1.0>
busl-@; business; business source LIC {@} <1.1>
elastic-@; elastic; elastic LIC {@} <1.0 2.0>
polyform-noncommercial-@; polyform; polyform noncommercial LIC {@} <1.0>
hippocratic-@; hippocratic; hippocratic LIC {@} <2.1>
mulan-psl-@; mulan; mulan ~permissive psl {@} <1.0 2.0>
ogl-@; government; open government LIC {@} <1.0 2.0 3.0>
ogl-@; ouverte; LIC ouverte ~open ~LIC {@} <1.0 2.0>
dl-de-by-@; datenlizenz; datenlizenz deutschland namensnennung {@} <2.0>
"""

_NAME = """
apache; apache; apache ~software LIC
apache-2.0; apache; apache org licenses LIC 2 0
apache; apache; apache style LIC
mit; mit; ~the mit LIC
mit; mit; mit x11 LIC
mit; mit; mit style LIC
mit; mit; ~under ~the ~terms ~of mit terms
mit; expat; expat LIC
mit; opensource; opensource org licenses mit
x11; x11; x11 LIC
isc; isc; isc LIC
bsd; bsd; bsd ~style LIC
bsd-2-clause; opensource; opensource org licenses bsd 2 clause
bsd-3-clause; opensource; opensource org licenses bsd 3 clause
lgpl; general public; ~gnu (?:lesser|library) general public LIC
agpl; affero; ~gnu affero general public LIC
gfdl; documentation; ~gnu free documentation LIC
gpl; gnu; gnu gpl
gpl; gnu; gnu org licenses gpl ~html
gpl-3.0; gnu; gnu org licenses gpl 3 0
gpl-2.0; gnu; gnu org licenses ~old ~licenses gpl 2 0
lgpl; gnu; gnu org licenses lgpl
agpl; gnu; gnu org licenses agpl
gpl; gnu; gnu org licenses
mpl; mozilla; mozilla public LIC
mpl-2.0; mozilla; mozilla org mpl 2 0
mpl; mozilla; mozilla org mpl
epl; eclipse; eclipse public LIC
epl; eclipse; eclipse org legal epl ~v?[12] ~[01]0?
eupl; european; european union public LIC
cddl; distribution; common development and distribution LIC
bsl-1.0; boost; boost software LIC
bsl-1.0; boost; boost org LIC 1 0
artistic; artistic; artistic LIC
zlib; zlib; zlib ~libpng LIC
libpng; libpng; libpng LIC
unlicense; unlicense; the unlicense
unlicense; unlicense; unlicense org
wtfpl; public; do what the ..1 you want to public LIC
ofl; font; ~sil open font LIC
ofl; scripts; scripts sil org ofl
odbl; database; open database LIC
cc0; cc0; ~creative ~commons cc0
cc; commons; creative commons LIC
cc; commons; creative commons
cc-by; commons; creative commons attribution ~LIC
cc-by-sa; commons; creative commons attribution (?:sharealike|share) ~alike ~LIC
cc-by-nc; commons; creative commons attribution (?:noncommercial|non) ~commercial ~LIC
cc-by-nd; commons; creative commons attribution (?:noderivatives|noderivs|no) ~deriv(?:ative|s|atives)? ~works? ~LIC
cc0; creativecommons; creativecommons org publicdomain zero ~1 ~0
cc-pdm; creativecommons; creativecommons org publicdomain mark ~1 ~0
cc-pdm; public domain; public domain mark
public-domain; public domain; released into the public domain
public-domain; public domain; (?:is|are) in the public domain
public-domain; public domain; dedicated to the public domain
public-domain; public domain; public domain
perl; perl; same terms as perl ~itself
php; php; php LIC
python; python; python software foundation LIC
ruby; ruby; ruby ~s LIC
vim; vim; vim LIC
openssl; openssl; openssl LIC
sleepycat; sleepycat; sleepycat LIC
postgresql; postgresql; postgresql LIC
ncsa; ncsa; ncsa ~open ~source LIC
sspl; server; server side public LIC
busl; business; business source LIC
commons-clause; clause; commons clause ~LIC
elastic; elastic; elastic LIC
polyform; polyform; polyform ..3 LIC
ogl; government; open government LIC
eula; user; end user LIC agreement
proprietary; proprietary; proprietary ~software LIC
proprietary; commercial; commercial LIC
all-rights; tous; tous droits r[ée]serv[ée]s
all-rights; alle; alle rechte vorbehalten
all-rights; todos; todos los derechos reservados
all-rights; tutti; tutti i diritti riservati
all-rights; todos; todos os direitos reservados
some-rights; some rights; some rights reserved
no-rights; no rights; no rights reserved
beerware; beer; beer(?:ware)? ~ware LIC
json; json; json LIC
ijg; jpeg; independent jpeg group
freetype; freetype; freetype ~project LIC
curl; curl; curl LIC
imagemagick; imagemagick; imagemagick LIC
"""

_SHORT = """
gpl-@; gpl; gpl {@} <2.0 3.0>
gpl-2.0; gplv2; gplv2
gpl-3.0; gplv3; gplv3
gpl-2.0-or-later; gpl; gplv?2 ~0? or later
gpl-3.0-or-later; gpl; gplv?3 ~0? or later
gpl-2.0-or-later; gpl; gpl 2 ~0 or later
gpl-3.0-or-later; gpl; gpl 3 ~0 or later
gpl; gpl; gpl
lgpl-@; lgpl; lgpl {@} <2.0 2.1 3.0>
lgpl-2.1; lgplv2; lgplv2 1
lgpl-3.0; lgplv3; lgplv3
lgpl; lgpl; lgpl
agpl-@; agpl; agpl {@} <3.0>
agpl-3.0; agplv3; agplv3
agpl; agpl; agpl
apache-2.0; apache; apache 2 ~0
apache-2.0; apache; apachev?2
mpl-@; mpl; mpl {@} <1.0 1.1 2.0>
mpl; mpl; mpl
epl-@; epl; epl {@} <1.0 2.0>
eupl-@; eupl; eupl {@} <1.1 1.2>
cddl; cddl; cddl
wtfpl; wtfpl; wtfpl
ofl-1.1; ofl; ofl 1 1
cc0-1.0; cc0; cc0 1 0
cc0; cc0; cc0
odbl; odbl; odbl
pddl; pddl; pddl
bsd; bsd; bsd LIC
isc; isc; isc licensed
mit; mit; mit licensed
eula; eula; eula
mit; licen; LIC mit
apache-2.0; licen; LIC apache 2 0
bsd; licen; LIC bsd
isc; licen; LIC isc
"""

_GENERIC = """
licensed; licen; LIC under
licensed; licen; licensed to
released; released; released under ~the ~terms ~of
see-license; licen; see ~the LIC ~file
see-license; licen; LIC (?:txt|md)
copyright; copyright; copyright ~c (?:19|20)\\d\\d
copyright; copyright; ~c copyright
copyright; copyrighted; copyrighted
copyleft; copyleft; copyleft
free-software; free software; free software
open-source; open source; open source LIC
permission; permission; with permission ~of ~the ~author
terms; terms; subject to the ~following terms
"""

_CC_PARTS = {"by": "attribution", "sa": "(?:sharealike|share) ~alike", "nc": "(?:noncommercial|non) ~commercial", "nd": "(?:noderivatives|noderivs|no) ~deriv(?:s|ative|atives)? ~works?"}
_CC_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
_MACROS = {"LIC": "licen[cs](?:e|es|ed)"}


def _version(v: str) -> list[str]:
    major, minor = v.split(".")
    return ["~(?:version|ver|v)", f"v?{major}", ("~" if set(minor) == {"0"} else "") + minor]


def words_of(pattern: str) -> list[str]:
    return [y for x in pattern.split() for y in (_version(x[1:-1]) if re.fullmatch(r"\{[\d.]+\}", x) else [x])]


def regex_of(pattern: str) -> str:
    """The regular expression of a rule's words, over a text as described at the top."""
    out = []
    for word in words_of(pattern):
        if word.startswith(".."):
            out.append(f"(?: [^ ]+ ){{0,{int(word[2:])}}}?")
            continue
        optional, word = word.startswith("~"), word.removeprefix("~")
        word = _MACROS.get(word, word)
        word = f"(?:{word})" if "|" in word else word
        out.append(f"(?: {word} )?" if optional else f" {word} ")
    return "".join(out)


def needed(phrase: str) -> list[str]:
    """A phrase that a text must hold, as it stands between the spaces of words; its last word may go on."""
    return ["  ".join(phrase.split())]


def _expanded(table: str) -> list[tuple[str, list[str], str]]:
    out = []
    for line in filter(None, table.split("\n")):
        label, needs, pattern = line.split("; ")
        versions = re.findall(r"<(.*)>$", pattern)
        for v in versions[0].split() if versions else [""]:
            out.append((label.replace("@", v), needs, re.sub(r" <.*>$", "", pattern).replace("@", v)))
    return out


def rules() -> list[Rule]:
    """All rules, numbered in their order of precedence within a priority."""
    found: list[tuple[str, int, bool, list[str], str]] = [(label, SHORT, True, needed(phrase), phrase) for phrase, label in BASE.items()]
    for priority, table in ((TEXT, _TEXT), (VERSIONED, _VERSIONED), (NAME, _NAME), (SHORT, _SHORT), (GENERIC, _GENERIC)):
        for label, needs, pattern in _expanded(table):
            found.append((label, priority, False, needed(needs), pattern))
    for kind in _CC_KINDS:
        parts, code = kind.split(), kind.replace(" ", "-")
        name = " ".join(_CC_PARTS[p] for p in parts)
        held = [f" {p} " for p in parts[1:]]
        found.append((f"cc-{code}", NAME, False, [" cc  by ", *held], f"cc {kind}"))
        for v in _CC_VERSIONS:
            label, digit = f"cc-{code}-{v}", v[0]
            found.append((label, VERSIONED, False, [" cc  by ", *held, digit], f"cc {kind} {{{v}}}"))
            found.append((label, VERSIONED, False, ["creative  commons", digit], f"creative commons {name} {{{v}}}"))
            found.append((label, VERSIONED, False, ["creative  commons", digit], f"creative commons {name} {{{v}}} international ~public ~LIC"))
            found.append((label, VERSIONED, False, ["creativecommons", *held, digit], f"creativecommons org LIC {kind} {v.replace('.', ' ')}"))
    for label in sorted({x[0] for x in found if x[1] > GENERIC and not x[2]}):
        found.append((label, TAG, False, ["spdx", label.split("-")[0].split(".")[0]], f"spdx LIC identifier {re.sub('[-.]', ' ', label)}"))
    return [Rule(k, label, priority, base, needs, regex_of(pattern)) for k, (label, priority, base, needs, pattern) in enumerate(found)]

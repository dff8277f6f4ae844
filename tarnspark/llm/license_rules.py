"""Ordered signature rules for licence notices.

A rule is (label, keyword, pattern, priority, weight). Patterns are written over words: a blank between
two words matches any run of separators, and a pattern begins and ends at word boundaries. The keyword
is a string of the normalised text without which the pattern can't match; it gates the rule.
Priorities: 3 full notices and SPDX tags, 2 licence names with a version, 1 bare names, 0 hints. The order
of the table breaks ties. ``base`` rules are reported whatever else covers them.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


BASE = [
    Rule("cc-by", "cc", "cc by", 1, 0.7, True),
    Rule("gpl", "public", "general public license", 1, 0.8, True),
    Rule("reserved", "reserved", "all rights reserved", 0, 0.5, True),
]

#: label | keyword | pattern, by priority and weight.
_NOTICES = """
apache-2.0|apache|licensed under the apache license version 2( 0)?
apache-2.0|apache|apache license version 2( 0)? january 2004
apache-1.1|apache|apache software license version 1 1
apache-1.0|apache|apache software license version 1 0
mit|mit|(released|licensed|distributed|available) under the( terms of the)? mit license
mit|permission|permission is hereby granted free of charge to any person obtaining a copy
mit|software|the software is provided as is without warranty of any kind express or implied
isc|permission|permission to use copy modify and( or)? distribute this software for any purpose with or without fee
0bsd|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause|endorse|neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote
bsd-4-clause|advertising|all advertising materials mentioning features or use of this software must display
gpl|license|(this work|this program|this software|this file) is licensed under the gnu general public license
gpl-3.0|license|licensed under the gnu general public license version 3
gpl-2.0|license|licensed under the gnu general public license version 2
gpl-3.0-or-later|version|gnu general public license .{0,80}either version 3 of the license or( at your option)? any later version
gpl-2.0-or-later|version|gnu general public license .{0,80}either version 2 of the license or( at your option)? any later version
gpl|redistribute|you can redistribute it and or modify it under the terms of the gnu general public license
lgpl|redistribute|you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
agpl|redistribute|you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl|received|you should have received a copy of the gnu general public license
lgpl|received|you should have received a copy of the gnu (lesser|library) general public license
agpl|received|you should have received a copy of the gnu affero general public license
mpl-2.0|mozilla|subject to the terms of the mozilla public license v 2 0
mpl-1.1|mozilla|subject to the mozilla public license version 1 1
epl-2.0|eclipse|made available under the terms of the eclipse public license 2 0
epl-1.0|eclipse|made available under the terms of the eclipse public license v1 0
cddl-1.0|development|subject to the terms of the common development and distribution license
unlicense|public|this is free and unencumbered software released into the public domain
wtfpl|license|do what the fuck you want to public license
zlib|software|this software is provided as is without any express or implied warranty in no event will the authors be held liable
boost-1.0|boost|distributed under the boost software license version 1 0
cc0-1.0|deed|the person who associated a work with this deed has dedicated the work to the public domain
cc-by-4.0|creative|licensed under a creative commons attribution 4 0 international license
cc-by-3.0|creative|licensed under a creative commons attribution 3 0 unported license
cc-by-sa-4.0|creative|licensed under a creative commons attribution share ?alike 4 0 international license
cc-by-sa-3.0|creative|licensed under a creative commons attribution share ?alike 3 0 unported license
cc-by-nc-4.0|creative|licensed under a creative commons attribution non ?commercial 4 0 international license
cc-by-nd-4.0|creative|licensed under a creative commons attribution no ?deriv(ative)?s 4 0 international license
cc-by-nc-sa-4.0|creative|licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0|creative|licensed under a creative commons attribution non ?commercial no ?deriv(ative)?s 4 0 international license
cc-by|licensed|licensed under cc by
cc-by-nc-4.0|licensed|licensed under cc by nc 4( 0)?
cc-by-sa-4.0|licensed|licensed under cc by sa 4( 0)?
cc-by-nd-4.0|licensed|licensed under cc by nd 4( 0)?
cc-by-4.0|licensed|licensed under cc by 4( 0)?
ofl-1.1|font|licensed under the sil open font license version 1 1
gfdl-1.3|documentation|under the terms of the gnu free documentation license version 1 3
gfdl-1.2|documentation|under the terms of the gnu free documentation license version 1 2
gfdl|documentation|under the terms of the gnu free documentation license
artistic-2.0|artistic|under the terms of the artistic license 2 0
perl|perl|under the same terms as perl itself
psf|python|python software foundation license version 2
php-3.01|php|subject to version 3 01 of the php license
odbl-1.0|database|made available under the open database license
eupl-1.2|eupl|licensed under the eupl version 1 2
elastic-2.0|elastic|licensed under the elastic license 2 0
busl-1.1|business|business source license 1 1
sspl-1.0|server|server side public license version 1
proprietary|proprietary|this software is proprietary and confidential
proprietary|copying|unauthorized copying of this (file|software) via any medium is strictly prohibited
proprietary|reproduced|no part of this (publication|work) may be reproduced
"""

_NAMES = """
apache-2.0|apache|apache (license|licence)( version| v)? ?2( 0)?
apache-2.0|apache|apache 2( 0)?( license| licence)?
apache-1.1|apache|apache (license|licence)( version| v)? ?1 1
bsd-2-clause|bsd|(simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[sc]e
bsd-3-clause|bsd|(new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[sc]e
bsd-4-clause|bsd|(original bsd|bsd 4 clause|4 clause bsd) licen[sc]e
0bsd|bsd|(zero clause bsd|0bsd|bsd zero clause)( licen[sc]e)?
gpl-1.0|gpl|gpl ?v?1( 0)?
gpl-2.0|gpl|(gnu )?gpl(( version| v)? ?2|v2)( 0)?
gpl-3.0|gpl|(gnu )?gpl(( version| v)? ?3|v3)( 0)?
gpl-2.0|general|general public licen[sc]e( version| v)? ?2( 0)?
gpl-3.0|general|general public licen[sc]e( version| v)? ?3( 0)?
lgpl-2.0|general|library general public licen[sc]e( version| v)? ?2( 0)?
lgpl-2.1|general|lesser general public licen[sc]e( version| v)? ?2 1
lgpl-3.0|general|lesser general public licen[sc]e( version| v)? ?3( 0)?
agpl-3.0|affero|affero general public licen[sc]e( version| v)? ?3( 0)?
lgpl-2.1|lgpl|lgpl ?v?2 1
lgpl-3.0|lgpl|lgpl ?v?3( 0)?
agpl-3.0|agpl|agpl ?v?3( 0)?
mpl-1.0|mozilla|mozilla public licen[sc]e( version| v)? ?1 0
mpl-1.1|mozilla|mozilla public licen[sc]e( version| v)? ?1 1
mpl-2.0|mozilla|mozilla public licen[sc]e( version| v)? ?2 0
epl-1.0|eclipse|eclipse public licen[sc]e( version| v)? ?1 0
epl-2.0|eclipse|eclipse public licen[sc]e( version| v)? ?2 0
cddl-1.0|cddl|cddl( version| v)? ?1 0
cddl-1.1|cddl|cddl( version| v)? ?1 1
eupl-1.1|eupl|eupl( version| v)? ?1 1
eupl-1.2|eupl|eupl( version| v)? ?1 2
ofl-1.1|font|open font licen[sc]e( version| v)? ?1 1
artistic-1.0|artistic|artistic licen[sc]e( version| v)? ?1 0
artistic-2.0|artistic|artistic licen[sc]e( version| v)? ?2 0
boost-1.0|boost|boost software licen[sc]e
afl-3.0|academic|academic free licen[sc]e( version| v)? ?3 0
osl-3.0|open|open software licen[sc]e( version| v)? ?3 0
zpl-2.1|zope|zope public licen[sc]e( version| v)? ?2 1
cpl-1.0|common|common public licen[sc]e( version| v)? ?1 0
ms-pl|microsoft|microsoft public licen[sc]e
ms-rl|microsoft|microsoft reciprocal licen[sc]e
odbl-1.0|database|open database licen[sc]e
pddl-1.0|domain|public domain dedication and licen[sc]e
cc0-1.0|cc0|cc0( 1 0)?
"""

_BARE = """
mit|mit|mit licen[sc]e
mit|x11|x11 licen[sc]e
isc|isc|isc licen[sc]e
apache|apache|apache (software )?licen[sc]e
bsd|bsd|bsd( style)? licen[sc]e
gpl|gpl|gpl
gpl|gnu|gnu public licen[sc]e
lgpl|lgpl|lgpl
lgpl|lesser|lesser general public licen[sc]e
agpl|agpl|agpl
agpl|affero|affero general public licen[sc]e
mpl|mozilla|mozilla public licen[sc]e
epl|eclipse|eclipse public licen[sc]e
cddl|common|common development and distribution licen[sc]e
eupl|european|european union public licen[sc]e
ofl|font|open font licen[sc]e
artistic|artistic|artistic licen[sc]e
unlicense|unlicense|unlicense
wtfpl|wtfpl|wtfpl
zlib|zlib|zlib( libpng)? licen[sc]e
gfdl|documentation|(gnu )?free documentation licen[sc]e
cc|creative|creative commons
public-domain|public|public domain
beerware|beerware|beerware licen[sc]e
json|json|json licen[sc]e
vim|vim|vim licen[sc]e
ruby|ruby|ruby licen[sc]e
openssl|openssl|openssl licen[sc]e
postgresql|postgresql|postgresql licen[sc]e
ncsa|illinois|university of illinois ncsa open source licen[sc]e
"""

_HINTS = """
copyright|copyright|copyright( c)? [0-9]{4}
copyright|copyright|copyright by
notice|license|licensed under
notice|licence|licenced under
notice|license|license agreement
notice|license|see the license file
notice|rights|some rights reserved
notice|permission|used with permission
notice|redistribute|may not be redistributed
"""

#: SPDX identifiers; each gives a tag rule, and "-only" / "-or-later" forms where the family has them.
_SPDX = (
    "0BSD AFL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 HPND IPL-1.0 ISC JSON LPPL-1.3c MIT MIT-0 MPL-1.0 "
    "MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 "
    "RPL-1.5 Ruby SISSL SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
_GNU = "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-1.0 AGPL-3.0 GFDL-1.1 GFDL-1.2 GFDL-1.3".split()
_CC_PARTS, _CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")


def _spoken(identifier: str) -> str:
    return identifier.lower().replace("-", " ").replace(".", " ")


def _table(text: str, priority: int, weight: float) -> list[Rule]:
    return [Rule(*line.split("|", 2), priority, weight) for line in text.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in their order."""
    cc = [f"CC-{p}-{v}" for p in _CC_PARTS for v in _CC_VERSIONS]
    gnu = [f"{x}{tail}" for x in _GNU for tail in ("-or-later", "-only", "")]
    found = BASE + _table(_NOTICES, 3, 0.95)
    found += [Rule(x.lower(), "spdx", f"spdx license identifier {_spoken(x)}", 3, 1.0) for x in [*_SPDX, *gnu, *cc]]
    found += _table(_NAMES, 2, 0.85)
    found += [Rule(x.lower(), "cc", _spoken(x.removesuffix(".0")) + "( 0)?" * x.endswith(".0"), 2, 0.85) for x in cc]
    found += [Rule(f"cc-{p.lower()}", "cc", _spoken(f"cc-{p}"), 1, 0.7) for p in _CC_PARTS[1:]]
    return found + _table(_BARE, 1, 0.7) + _table(_HINTS, 0, 0.3)

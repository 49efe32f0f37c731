"""Signature rules of licenses, in order.

A rule is ``label | gates | pattern``.  Patterns are regular expressions over normalised text, in which words of digits
and lower-case letters are told apart by single spaces: ``Apache-2.0`` is ``apache 2 0``.  Every text that a pattern
matches holds all of the rule's gates as words.  Rules stand in order: of equal detections the first rule's counts.
"""

from __future__ import annotations

# Titles and notices that name a license and its version, or a license without versions.
EXACT = r"""
gpl-1.0 | gnu general | gnu general public license( version)? v?1( 0)?
gpl-2.0 | gnu general | gnu general public license( gpl)?( as published by the free software foundation)?( either)?( version)? v?2( 0)?
gpl-2.0-or-later | gnu general later | gnu general public license( as published by the free software foundation)?( either)?( version)? v?2( 0)?( of the license)? or( at your option)? any later version
gpl-2.0-only | gnu general only | gnu general public license( version)? v?2( 0)? only
gpl-3.0 | gnu general | gnu general public license( gpl)?( as published by the free software foundation)?( either)?( version)? v?3( 0)?
gpl-3.0-or-later | gnu general later | gnu general public license( as published by the free software foundation)?( either)?( version)? v?3( 0)?( of the license)? or( at your option)? any later version
gpl-3.0-only | gnu general only | gnu general public license( version)? v?3( 0)? only
gpl-2.0 | gplv2 | gplv2( 0)?
gpl-3.0 | gplv3 | gplv3( 0)?
gpl-2.0 | gpl | (gnu )?gpl( version)? (v2|2)( 0)?
gpl-3.0 | gpl | (gnu )?gpl( version)? (v3|3)( 0)?
gpl-2.0-only | gpl only | gpl 2 0 only
gpl-3.0-only | gpl only | gpl 3 0 only
gpl-2.0-or-later | gpl later | gpl 2 0 or later
gpl-3.0-or-later | gpl later | gpl 3 0 or later
lgpl-2.0 | gnu library | gnu library general public license( version)? v?2( 0)?
lgpl-2.1 | gnu lesser | gnu lesser general public license( lgpl)?( as published by the free software foundation)?( either)?( version)? v?2 1
lgpl-3.0 | gnu lesser | gnu lesser general public license( lgpl)?( as published by the free software foundation)?( either)?( version)? v?3( 0)?
lgpl-2.1 | lgplv2 | lgplv2 1
lgpl-3.0 | lgplv3 | lgplv3( 0)?
lgpl-2.1 | lgpl | (gnu )?lgpl( version)? (v2|2) 1
lgpl-3.0 | lgpl | (gnu )?lgpl( version)? (v3|3)( 0)?
agpl-3.0 | gnu affero | gnu affero general public license( agpl)?( as published by the free software foundation)?( either)?( version)? v?3( 0)?
agpl-1.0 | affero | affero general public license( version)? v?1( 0)?
agpl-3.0 | agplv3 | agplv3( 0)?
agpl-3.0 | agpl | (gnu )?agpl( version)? (v3|3)( 0)?
gfdl-1.1 | gnu documentation | gnu free documentation license( version)? v?1 1
gfdl-1.2 | gnu documentation | gnu free documentation license( version)? v?1 2
gfdl-1.3 | gnu documentation | gnu free documentation license( version)? v?1 3
apache-1.0 | apache | apache (software )?license( version)? v?1 0
apache-1.1 | apache | apache (software )?license( version)? v?1 1
apache-2.0 | apache | apache (software )?license( version)? v?2( 0)?
apache-2.0 | apache | apache 2( 0)?( license)
apache-2.0 | apache org licenses | www apache org licenses license 2 0
apache-2.0 | asl | asl 2 0
mit | mit license | released under the( terms of the)? mit license
mit | mit license | licensed under the( terms of the)? mit license
mit | mit license | distributed under the( terms of the)? mit license
mit | mit opensource | opensource org licenses mit( license php)?
mit | obtaining charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | mit attribution | mit no attribution( license)?
x11 | x11 license | x11 license
x11-distribute-modifications | x11 distribution | x11 license distribution modification
bsd-2-clause | bsd clause | (simplified )?bsd 2 clause( license)?
bsd-2-clause | bsd clause | 2 clause bsd( license)?
bsd-2-clause | bsd simplified | simplified bsd license
bsd-2-clause | freebsd license | freebsd license
bsd-3-clause | bsd clause | bsd 3 clause( license)?
bsd-3-clause | bsd clause | 3 clause bsd( license)?
bsd-3-clause | bsd clause | bsd three clause( license)?
bsd-3-clause | bsd new | new bsd license
bsd-3-clause | bsd modified | modified bsd license
bsd-3-clause | bsd revised | revised bsd license
bsd-4-clause | bsd clause | bsd 4 clause( license)?
bsd-4-clause | bsd original | original bsd license
bsd-3-clause-clear | bsd clear | clear bsd license
bsd-4-clause-uc | advertising materials | all advertising materials mentioning features or use of this software must display
0bsd | bsd zero | zero clause bsd( license)?
0bsd | 0bsd | 0bsd( license)?
bsd | redistributions retain | redistributions of source code must retain the above copyright notice
bsd-3-clause | endorse promote | may be used to endorse or promote products derived from this software without specific prior written permission
isc | isc | isc licen[cs]e
isc | permission distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.0 | mozilla | mozilla public license( version)? v?1 0
mpl-1.1 | mozilla | mozilla public license( version)? v?1 1
mpl-2.0 | mozilla | mozilla public license( version)? v?2( 0)?
mpl-2.0 | mozilla mpl | mozilla org mpl 2 0
mpl-1.1 | mpl | mpl( version)? 1 1
mpl-2.0 | mpl | mpl( version)? 2 0
epl-1.0 | eclipse | eclipse public license( version)? v?1( 0)?
epl-2.0 | eclipse | eclipse public license( version)? v?2( 0)?
edl-1.0 | eclipse | eclipse distribution license( version)? v?1( 0)?
cpl-1.0 | license common public | common public license( version)? v?1( 0)?
cddl-1.0 | license development distribution | common development and distribution license( cddl)?( version)?( v?1 0)?
cddl-1.1 | license development distribution | common development and distribution license( cddl)?( version)? v?1 1
eupl-1.1 | european union | european union public licen[cs]e( version)? v?1 1
eupl-1.2 | european union | european union public licen[cs]e( version)? v?1 2
eupl-1.2 | eupl | eupl( version)? v?1 2
artistic-1.0 | artistic | artistic license( version)? 1 0
artistic-2.0 | artistic | artistic license( version)? 2 0
perl | perl same | same terms as perl itself
zlib | zlib license | zlib( libpng)? license
zlib | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
libpng | libpng | libpng license( version)?( 2)?
bsl-1.0 | boost | boost software license( version)?( 1 0)?
unlicense | unlicense | (the )?unlicense
unlicense | unencumbered | free and unencumbered software released into the public domain
wtfpl | wtfpl | wtfpl( version)?( 2)?
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | commons zero | creative commons zero( v?1 0)?( universal)?
cc-pdm-1.0 | commons mark | creative commons public domain mark 1 0
odbl-1.0 | odbl | odbl( version)?( 1 0)?
odbl-1.0 | open database | open database license( odbl)?( version)?( v?1 0)?
odc-by-1.0 | commons attribution data | open data commons attribution license( version)?( v?1 0)?
pddl-1.0 | commons dedication data | open data commons public domain dedication( and)? licen[cs]e( version)?( 1 0)?
ofl-1.1 | sil font | sil open font license( ofl)?( version)?( 1 1)?
psf-2.0 | python foundation | python software foundation license( version)?( 2)?
php-3.01 | php license | php license( version)? 3 01
php-3.0 | php license | php license( version)? 3 0
openssl | openssl license | openssl license
ssleay | ssleay license | (original )?ssleay license
vim | vim license | vim license
w3c | w3c notice | w3c software( and document)? notice and license
postgresql | postgresql licence | postgresql licence
postgresql | postgresql license | postgresql license
ncsa | illinois ncsa | university of illinois ncsa open source license
upl-1.0 | universal permissive | universal permissive license( version)?( v?1 0)?
ecl-2.0 | educational community | educational community license( version)?( 2 0)?
ms-pl | microsoft public | microsoft public license( ms pl)?
ms-rl | microsoft reciprocal | microsoft reciprocal license( ms rl)?
apsl-2.0 | apple public | apple public source license( version)?( 2 0)?
ipl-1.0 | ibm public | ibm public license( version)?( 1 0)?
qpl-1.0 | qpl | qpl( version)? 1 0
qpl-1.0 | q public license | q public license( version)?( 1 0)?
lppl-1.3c | latex project | latex project public license( version)?( 1 3c?)?
afl-3.0 | academic free | academic free license( version)?( v?3 0)?
osl-3.0 | license open software | open software license( version)?( v?3 0)?
rpl-1.5 | reciprocal public license | reciprocal public license( version)?( 1 5)?
sleepycat | sleepycat | sleepycat license
zpl-2.1 | zope public | zope public license( version)?( 2 1)?
beerware | beerware | (the )?beerware license
beerware | beer ware | beer ware license
json | evil good | software shall be used for good not evil
imagemagick | imagemagick license | imagemagick license
ijg | independent jpeg | independent jpeg group license
icu | icu license | icu license
unicode-dfs-2016 | unicode license | unicode license agreement( data files and software)?
curl | curl license | curl license
bzip2-1.0.6 | bzip2 license | bzip2( and libbzip2)? license( version)?( 1 0 6)?
hpnd | historical disclaimer | historical permission notice and disclaimer
mulanpsl-2.0 | mulan | mulan permissive software license( version)?( v?2)?
cecill-2.1 | cecill | cecill( free software license agreement)?( version)?( 2 1)?
sspl-1.0 | server side license | server side public license( version)?( v?1)?
busl-1.1 | business source license | business source license( version)?( 1 1)?
elastic-2.0 | elastic license | elastic license( version)?( v?2)?( 0)?
commons-clause | commons clause | commons clause( license condition)?( version)?( v?1 0)?
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial license( 1 0 0)?
bigscience-openrail-m | openrail | (creativeml |bigscience )?openrail( m)?( license)?
bigscience-openrail-m | rail license open | (creativeml |bigscience )?open rail m license
llama-2 | llama community | llama 2 community license( agreement)?
opl-1.0 | open publication | open publication license( version)?( v?1 0)?
fal-1.3 | art libre | licence art libre( 1 3)?
ogl-3.0 | government open | open government licen[cs]e( version)?( v?3 0)?
"""

# Names without a version, at which the version remains open.
NAMED = r"""
gpl | gnu general | gnu general public licen[cs]e
gpl | gpl | (gnu )?gpl( licen[cs]e)
gpl | gnu gpl | gnu gpl
lgpl | gnu lesser | gnu lesser general public licen[cs]e
lgpl | gnu library | gnu library general public licen[cs]e
lgpl | lgpl | (gnu )?lgpl
agpl | affero | (gnu )?affero general public licen[cs]e
agpl | agpl | (gnu )?agpl
gfdl | gnu documentation | gnu free documentation licen[cs]e
gfdl | gfdl | gfdl
apache | apache | apache (software )?licen[cs]e
mit | mit license | mit license
mit | mit licence | mit licence
mit | expat license | expat license
bsd | bsd license | bsd( style)? license
bsd | bsd licence | bsd( style)? licence
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
artistic | artistic | artistic licen[cs]e
eupl | eupl | eupl
cddl | cddl | cddl
php | php license | php license
psf | psf license | psf license
ofl | ofl | ofl
cc-by | cc by | cc by
cc-by | commons attribution | creative commons attribution
public-domain | public domain dedicated | dedicated to the public domain
public-domain | public domain released | released (in)?to the public domain
"""

# Clues that say only that there are terms.
CLUES = r"""
unknown | licensed under | licensed under( the)?( terms of)?( the)? [0-9a-z]+
unknown | released under | released under( the)?( terms of)?( the)? [0-9a-z]+( [0-9a-z]+)? licen[cs]e
unknown | distributed under | distributed under( the)?( terms of)?( the)? [0-9a-z]+( [0-9a-z]+)? licen[cs]e
unknown | license file | see the( accompanying| enclosed)?( file)? license( file| txt| md)
unknown | copying file | see the file copying
"""

#: Identifiers that stand behind ``SPDX-License-Identifier:``; each makes a rule.
SPDX = """
GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later GFDL-1.2-only GFDL-1.3-or-later Apache-1.1 Apache-2.0 MIT MIT-0 X11 ISC 0BSD
BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CPL-1.0
CDDL-1.0 CDDL-1.1 EUPL-1.1 EUPL-1.2 Artistic-1.0 Artistic-2.0 Zlib libpng-2.0 Unlicense WTFPL CC0-1.0 ODbL-1.0 ODC-By-1.0 PDDL-1.0
OFL-1.1 PSF-2.0 Python-2.0 Ruby PHP-3.01 OpenSSL Vim W3C PostgreSQL NCSA UPL-1.0 ECL-2.0 MS-PL MS-RL APSL-2.0 IPL-1.0 QPL-1.0
LPPL-1.3c AFL-3.0 OSL-3.0 ZPL-2.1 Beerware JSON ImageMagick ICU curl HPND MulanPSL-2.0 CECILL-2.1 SSPL-1.0 BUSL-1.1 Elastic-2.0
""".split()

#: Parts of Creative Commons names and their words, and the versions: a rule for each pair, short and long name.
CC_PARTS = {"by": "attribution", "by-sa": "attribution share( )?alike", "by-nc": "attribution non( )?commercial", "by-nd": "attribution no( )?deriv(ative)?s", "by-nc-sa": "attribution non( )?commercial share( )?alike", "by-nc-nd": "attribution non( )?commercial no( )?deriv(ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Gates that are ordinary words, at which a text isn't held to a rule before its other gates are there.
COMMON = {"by", "mit", "only", "later", "new", "clear", "original", "simplified", "modified", "revised", "zero", "clause", "general", "public", "open", "same", "good", "beer", "under", "file", "server", "side", "business", "source"}
#: Levels: what decides between overlapping detections, and the score of each.
LEVELS = (1.0, 0.8, 0.4)


def _listed(text: str, level: int) -> list[tuple[str, int, list[str], str]]:
    rows = [line.split(" | ") for line in text.strip().splitlines()]
    return [(label, level, gates.split(), pattern) for label, gates, pattern in rows]


def _words(name: str) -> str:
    return " ".join(name.lower().replace("+", "").replace("-", " ").replace(".", " ").split())


def rules() -> list[tuple[str, int, list[str], str]]:
    """(label, level, gates, pattern) of all rules in order."""
    spdx = [(x.lower(), 0, ["spdx"], f"spdx license identifier {_words(x)}") for x in SPDX]
    cc = [(f"cc-{part}-{v}", 0, ["cc", "by"], f"cc {_words(part)}( version)? v?{_words(v)}") for part in CC_PARTS for v in CC_VERSIONS]
    cc += [(f"cc-{part}-{v}", 0, ["commons", "attribution"], f"creative commons {words}( v?{_words(v)}| license {_words(v)})( international| unported| generic)?") for part, words in CC_PARTS.items() for v in CC_VERSIONS]
    cc += [(f"cc-{part}", 1, ["cc", "by"], f"cc {_words(part)}") for part in CC_PARTS if part != "by"]
    cc += [(f"cc-{part}", 1, ["commons", "attribution"], f"creative commons {words}") for part, words in CC_PARTS.items() if part != "by"]
    return spdx + _listed(EXACT, 0) + cc + _listed(NAMED, 1) + _listed(CLUES, 2)

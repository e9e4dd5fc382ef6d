"""License scans: ordered signature rules with a keyword prefilter; overlapping detections are settled by priority."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import mapped, pieces, utf8

#: Phrases that stand for a label wherever their words stand consecutively; fixed values.
PHRASES = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

#: label | keyword that every alternative contains | name, as a regex over lower-case words with one space between. Longer names come before those
#: that they contain only for the reader: priority and containment settle overlaps.
NAMES = r"""
mit | mit | mit
mit-0 | mit 0 | mit 0
mit-0 | mit no attribution | mit no attribution
x11 | x11 | x11
apache-1.0 | apache | apache (?:software )?(?:license )?(?:version |v )?1 0
apache-1.1 | apache | apache (?:software )?(?:license )?(?:version |v )?1 1
apache-2 | apache | apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?
bsd-1-clause | bsd | (?:1|one) clause bsd|bsd (?:1|one) clause
bsd-2-clause | bsd | (?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd
bsd-3-clause | bsd | (?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd
bsd-4-clause | bsd | (?:4|four) clause bsd|bsd (?:4|four) clause|original bsd
bsd-0-clause | bsd | 0bsd|zero clause bsd|bsd zero clause
bsd | bsd | bsd(?: style)?
isc | isc | isc
gpl-1.0 | gpl | (?:gnu )?gpl ?v?(?:ersion )?1(?: 0)?(?: only| or later)?
gpl-2.0 | gpl | (?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl | (?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)?
gpl-2.0 | general public | (?:gnu )?general public license (?:version |v )2(?: 0)?
gpl-3.0 | general public | (?:gnu )?general public license (?:version |v )3(?: 0)?
gpl | general public | gnu general public
lgpl-2.0 | lgpl | (?:gnu )?lgpl ?v?(?:ersion )?2 0(?: only| or later)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?v?(?:ersion )?2 1(?: only| or later)?
lgpl-3.0 | lgpl | (?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)?
lgpl | lesser general | (?:gnu )?lesser general public
agpl-3.0 | agpl | (?:gnu )?agpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)?
agpl | affero | (?:gnu )?affero general public
gfdl-1.1 | gfdl | gfdl ?v?(?:ersion )?1 1
gfdl-1.2 | gfdl | gfdl ?v?(?:ersion )?1 2
gfdl-1.3 | gfdl | gfdl ?v?(?:ersion )?1 3
gfdl | free documentation | (?:gnu )?free documentation
mpl-1.0 | mpl | mpl ?v?(?:ersion )?1 0
mpl-1.1 | mpl | mpl ?v?(?:ersion )?1 1
mpl-2.0 | mpl | mpl ?v?(?:ersion )?2 0
mpl-2.0 | mozilla public | mozilla public license (?:version |v )?2 0
mpl | mozilla public | mozilla public
epl-1.0 | epl | epl ?v?(?:ersion )?1 0
epl-2.0 | epl | epl ?v?(?:ersion )?2 0
epl | eclipse public | eclipse public
edl-1.0 | eclipse distribution | eclipse distribution
cddl-1.0 | cddl | cddl ?v?(?:ersion )?1 0
cddl-1.1 | cddl | cddl ?v?(?:ersion )?1 1
cddl | common development and distribution | common development and distribution
cpl-1.0 | common public | common public
eupl-1.1 | eupl | eupl ?v?(?:ersion )?1 1
eupl-1.2 | eupl | eupl ?v?(?:ersion )?1 2
eupl | european union public | european union public
artistic-1.0 | artistic | artistic (?:license )?1 0
artistic-2.0 | artistic | artistic (?:license )?2 0
artistic | artistic | artistic
perl | perl | same terms as perl(?: itself)?
python-2.0 | python | python (?:software foundation )?(?:license )?(?:version )?2(?: 0)?
psf | python software | python software foundation
php-3.01 | php | php (?:license )?(?:version )?3 01
php-3.0 | php | php (?:license )?(?:version )?3 0
ruby | ruby | ruby
zlib | zlib | zlib(?: libpng)?
libpng | libpng | libpng
openssl | openssl | openssl
curl | curl | curl
boost-1.0 | boost | boost (?:software )?(?:license )?(?:version |v )?1 0
boost-1.0 | bsl 1 0 | bsl 1 0
boost | boost | boost software
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
wtfpl | what the fuck | do what the fuck you want to public
beerware | beerware | beerware
postgresql | postgresql | postgresql
vim | vim | vim
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)?
json | json | json
ms-pl | microsoft public | microsoft public
ms-pl | ms pl | ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal
ms-rl | ms rl | ms rl
osl-3.0 | open software | open software license (?:version |v )?3 0
osl-3.0 | osl 3 0 | osl 3 0
afl-3.0 | academic free | academic free license (?:version |v )?3 0
afl-3.0 | afl 3 0 | afl 3 0
ecl-2.0 | educational community | educational community license (?:version |v )?2 0
lppl-1.3 | lppl | lppl ?v?(?:ersion )?1 3c?
lppl | latex project public | latex project public
ofl-1.1 | ofl | (?:sil )?ofl ?v?(?:ersion )?1 1
ofl-1.1 | open font | (?:sil )?open font
cecill-2.1 | cecill | cecill ?v?(?:ersion )?2 1
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
cecill | cecill | cecill
mulan-psl-2.0 | mulan | mulan (?:psl|permissive software license) ?v?2
blueoak-1.0 | blue oak | blue oak model
elastic-2.0 | elastic | elastic (?:license )?(?:version |v )?2(?: 0)?
sspl-1.0 | sspl | sspl ?v?(?:ersion )?1(?: 0)?
sspl | server side public | server side public
busl-1.1 | business source | business source license (?:version |v )?1 1
busl-1.1 | busl 1 1 | busl 1 1
polyform-nc | polyform | polyform noncommercial
polyform-sb | polyform | polyform small business
commons-clause | commons clause | commons clause
openrail | openrail | (?:creativeml |bigscience )?(?:bloom )?openrail(?: m)?(?: ?\+\+)?
openrail | open rail | (?:creativeml |bigscience )?(?:bloom )?open rail(?: m)?(?: ?\+\+)?
llama-community | llama | llama ?[0-9 ]*community
gemma-terms | gemma | gemma terms of use
odbl-1.0 | odbl | odbl(?: ?v?1 0)?
odbl-1.0 | open database | open database
odc-by-1.0 | odc | odc by(?: 1 0)?
odc-by-1.0 | open data commons | open data commons attribution
pddl-1.0 | pddl | pddl(?: 1 0)?
cdla-permissive | cdla | cdla permissive(?: [12] 0)?
cdla-sharing | cdla | cdla sharing(?: 1 0)?
ogl-uk | open government | open government
etalab-2.0 | etalab | (?:licence ouverte )?etalab(?: 2 0)?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | creative commons zero
cc-by | cc by | cc by(?: [1-4] [05])?
cc-by-sa | cc by sa | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-nc | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by | creative commons | creative commons attribution(?: [1-4] [05])?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?
intel | intel open source | intel open source
ipl-1.0 | ibm public | ibm public
apsl-2.0 | apple public | apple public source license (?:version |v )?2 0
apsl | apple public | apple public source
spl-1.0 | sun public | sun public
sissl | sissl | sissl(?: 1 [12])?
sissl | sun industry standards | sun industry standards source
npl-1.1 | netscape public | netscape public license (?:version |v )?1 1
npl | netscape public | netscape public
qpl-1.0 | q public | q public
sleepycat | sleepycat | sleepycat
oldap-2.8 | openldap | openldap (?:public )?(?:license )?(?:version |v )?2 8
oldap | openldap | openldap(?: public)?
w3c | w3c | w3c(?: software)?(?: notice)?(?: and)?
ipa | ipa font | ipa font
bitstream-vera | bitstream vera | bitstream vera(?: font)?
hpnd | historical permission | historical permission notice and disclaimer
ftl | freetype | freetype(?: project)?
ijg | independent jpeg | independent jpeg group
imagemagick | imagemagick | imagemagick
info-zip | info zip | info zip
bzip2-1.0.6 | bzip2 | bzip2(?: 1 0 6)?
tcl | tcl | tcl(?: tk)?
xfree86-1.1 | xfree86 | xfree86(?: 1 1)?
zpl-2.1 | zpl | zpl(?: 2 1)?
zpl-2.1 | zope public | zope public
unicode-3.0 | unicode | unicode(?: v3)?
icu | icu | icu
naist | naist | naist(?: 2003)?
nasa-1.3 | nasa open source | nasa open source(?: agreement)?
rpl-1.5 | reciprocal public | reciprocal public
rpsl | realnetworks public | realnetworks public source
sgi-b-2.0 | sgi free software | sgi free software(?: license b)?(?: 2 0)?
simpl-2.0 | simple public | simple public
sugarcrm | sugarcrm public | sugarcrm public
vsl-1.0 | vovida | vovida software
wxwindows | wxwindows | wxwindows(?: library)?
nokia | nokia open source | nokia open source
motosoto | motosoto | motosoto
multics | multics | multics
ms-lpl | microsoft limited public | microsoft limited public
eudatagrid | eu datagrid | eu datagrid(?: software)?
entessa | entessa public | entessa public
efl-2.0 | eiffel forum | eiffel forum(?: license)?(?: version)?(?: 2)?
cua-opl-1.0 | cua office | cua office public
cpal-1.0 | common public attribution | common public attribution
cnri-python | cnri | cnri(?: python)?
catosl-1.1 | computer associates trusted | computer associates trusted open source
aal | attribution assurance | attribution assurance
adaptive-1.0 | adaptive public | adaptive public
apl-1.0 | adaptive public source | adaptive public source
frameworx-1.0 | frameworx | frameworx(?: open)?
lucent-1.02 | lucent public | lucent public(?: license)?(?: version)?(?: 1 02)?
miros | miros | miros
ntp | ntp | ntp
ogtsl | open group test suite | open group test suite
oclc-2.0 | oclc research public | oclc research public
pgsql-docs | open publication | open publication
osl | open software | open software
afl | academic free | academic free
ecl | educational community | educational community
upl-1.0 | universal permissive | universal permissive
upl-1.0 | upl 1 0 | upl 1 0
eupl-1.0 | eupl | eupl ?v?(?:ersion )?1 0
liliq-p | liliq | liliq p(?: 1 1)?
liliq-r | liliq | liliq r(?: 1 1)?
ncgl-uk | non commercial government | (?:uk )?non commercial government
ogl-canada | open government canada | open government canada
cc-pdm | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
cc-by-3.0-igo | igo | cc by (?:nc )?(?:sa |nd )?3 0 igo
fal-1.3 | free art | free art
gust-font | gust font | gust font
mpl-2.0-no-copyleft | no copyleft exception | mpl 2 0 no copyleft exception
parity-7.0 | parity public | parity public
prosperity-3.0 | prosperity public | prosperity public
hippocratic-2.1 | hippocratic | hippocratic(?: license)?(?: 2 1| 3 0)?
anti-996 | anti 996 | anti 996
cern-ohl-p | cern | cern (?:open hardware licence|ohl) (?:version 2 )?p(?:ermissive)?
cern-ohl-s | cern | cern (?:open hardware licence|ohl) (?:version 2 )?s(?:trongly reciprocal)?
cern-ohl-w | cern | cern (?:open hardware licence|ohl) (?:version 2 )?w(?:eakly reciprocal)?
solderpad | solderpad | solderpad(?: hardware)?
tapr-ohl | tapr | tapr open hardware
fsl-1.1 | functional source | functional source
community-1.0 | confluent community | confluent community
redis-sal | redis source available | redis source available
timescale | timescale | timescale
proprietary | proprietary | (?:a )?proprietary
"""

#: label | keyword | sentence that stands in the license's own text or says the right plainly.
SENTENCES = r"""
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | software is provided as is | the software is provided as is without warranty of any kind express or implied
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee
apache-2 | apache org licenses | apache org licenses license 2 0
apache-2 | in compliance with the license | you may not use this file except in compliance with the license
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
gpl | free software foundation | under the terms of the gnu general public license as published by the free software foundation
gpl-2.0 | either version 2 | either version 2 of the license or at your option any later version
gpl-3.0 | either version 3 | either version 3 of the license or at your option any later version
lgpl-2.1 | either version 2 1 | either version 2 1 of the license or at your option any later version
gpl | gnu org licenses | gnu org licenses gpl(?: [123] 0)?
lgpl | gnu org licenses | gnu org licenses lgpl(?: [23] [01])?
agpl | gnu org licenses | gnu org licenses agpl(?: 3 0)?
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license
zlib | altered source | altered source versions must be plainly marked as such
boost-1.0 | boost org | boost org license 1 0
unlicense | public domain | this is free and unencumbered software released into the public domain
public-domain | public domain | (?:dedicated to|placed in|released into|in) the public domain
wtfpl | what the fuck | you just do what the fuck you want to
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons | opendatacommons org licenses by
ofl-1.1 | scripts sil org | scripts sil org ofl
all-rights-reserved | all rights reserved | all rights reserved
no-commercial-use | commercial | (?:for )?non ?commercial use only
no-commercial-use | personal use only | (?:for )?personal use only
no-commercial-use | commercial | may not be used for commercial purposes
no-redistribution | redistribut | (?:may not|must not|do not|cannot) (?:be )?redistribut(?:e|ed)
confidential | confidential | (?:strictly )?confidential and proprietary
gpl-1.0 | general public | (?:gnu )?general public licen[sc]e (?:version |v )1(?: 0)?(?: or later| only)?
gpl-2.0 | general public | (?:gnu )?general public licen[sc]e (?:version |v )2(?: 0)?(?: or later| only)?
gpl-3.0 | general public | (?:gnu )?general public licen[sc]e (?:version |v )3(?: 0)?(?: or later| only)?
lgpl-2.0 | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )2(?: 0)?(?: or later| only)?
lgpl-2.1 | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )2 1(?: or later| only)?
lgpl-3.0 | lesser general | (?:gnu )?lesser general public licen[sc]e (?:version |v )3(?: 0)?(?: or later| only)?
lgpl-2.0 | library general | (?:gnu )?library general public licen[sc]e(?: version 2| v2)?(?: 0)?
agpl-3.0 | affero general | (?:gnu )?affero general public licen[sc]e (?:version |v )3(?: 0)?(?: or later| only)?
agpl-1.0 | affero general | affero general public licen[sc]e (?:version |v )1(?: 0)?
gfdl-1.1 | free documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )1 1(?: or later| only)?
gfdl-1.2 | free documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )1 2(?: or later| only)?
gfdl-1.3 | free documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )1 3(?: or later| only)?
mpl-1.0 | mozilla public | mozilla public licen[sc]e (?:version |v )1 0
mpl-1.1 | mozilla public | mozilla public licen[sc]e (?:version |v )1 1
mpl-2.0 | mozilla public | mozilla public licen[sc]e (?:version |v )2 0
epl-1.0 | eclipse public | eclipse public licen[sc]e (?:version |v )?1 0
epl-2.0 | eclipse public | eclipse public licen[sc]e (?:version |v )?2 0
cddl-1.0 | common development and distribution | common development and distribution licen[sc]e (?:version |v )?1 0
cddl-1.1 | common development and distribution | common development and distribution licen[sc]e (?:version |v )?1 1
eupl-1.1 | european union public | european union public licen[sc]e (?:version |v )?1 1
eupl-1.2 | european union public | european union public licen[sc]e (?:version |v )?1 2
apache-1.0 | apache | apache (?:software )?licen[sc]e (?:version |v )1 0
apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version |v )1 1
apache-2 | apache | apache (?:software )?licen[sc]e (?:version |v )2(?: 0)?
artistic-1.0 | artistic | artistic licen[sc]e (?:version |v )?1 0
artistic-2.0 | artistic | artistic licen[sc]e (?:version |v )?2 0
boost-1.0 | boost software | boost software licen[sc]e (?:version |v )?1 0
ofl-1.1 | open font | (?:sil )?open font licen[sc]e (?:version |v )?1 1
osl-3.0 | open software | open software licen[sc]e (?:version |v )?3 0
afl-3.0 | academic free | academic free licen[sc]e (?:version |v )?3 0
elastic-2.0 | elastic | elastic licen[sc]e (?:version |v )?2 0
sspl-1.0 | server side public | server side public licen[sc]e (?:version |v )?1(?: 0)?
busl-1.1 | business source | business source licen[sc]e (?:version |v )?1 1
odbl-1.0 | open database | open database licen[sc]e(?: odbl)?(?: v1 0| 1 0)?
psf | python software | python software foundation licen[sc]e(?: version 2)?
cc-by | creative commons | creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic)(?: licen[sc]e)?
cc-by-sa | creative commons | creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|unported|generic)(?: licen[sc]e)?
cc-by-nc | creative commons | creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international|unported|generic)(?: licen[sc]e)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike (?:[1-4] [05] )?(?:international|unported|generic)(?: licen[sc]e)?
mit | opensource org licenses | opensource org licenses mit
bsd | opensource org licenses | opensource org licenses bsd [23] clause
zlib | in no event will the authors | in no event will the authors be held liable for any damages arising from the use of this software
unlicense | unlicense org | (?:please )?refer to http(?:s)? unlicense org
beerware | beer | buy me a beer in return
agpl-3.0 | remote network interaction | remote network interaction use with the gnu general public license
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | right to sell | the license does not grant to you the right to sell the software
busl-1.1 | change date | effective on the change date
openrail | use based restrictions | use based restrictions as referenced in paragraph
llama-community | materials | llama materials
no-derivatives | derivative | (?:no|may not (?:create|make)) derivative works(?: may be made)?
no-ai-training | machine learning | may not be used (?:for|to train) (?:any )?machine learning(?: models)?
no-ai-training | artificial intelligence | may not be used (?:for|to train) (?:any )?artificial intelligence(?: models)?
attribution-required | attribution | attribution (?:is )?required
share-alike | same license | distributed? under the same license
royalty-free | royalty free | (?:worldwide )?(?:non exclusive )?royalty free licen[sc]e
evaluation-only | evaluation | for evaluation purposes only
academic-only | academic | for (?:non commercial )?academic (?:research )?(?:use|purposes) only
research-only | research | for (?:non commercial )?research (?:use|purposes) only
educational-only | educational | for educational (?:use|purposes) only
not-for-resale | resale | not for resale
trade-secret | trade secret | (?:contains )?trade secrets? (?:and confidential information )?of
permission-required | permission | reproduced without (?:the )?(?:prior )?written permission
"""

#: How a name stands in running text: (regex around it, words that must be there too, priority, confidence).
FRAMES = (
    (r"spdx license identifier (?:{0})", ("spdx",), 4, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|provided|published|offered|shared|made available) under (?:the )?(?:terms of (?:the )?)?(?:{0})(?: licen[sc]es?)?", ("under",), 3, 0.95),
    (r"(?:{0}) licen[sc]es?(?: agreement)?", ("licen",), 2, 0.8),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


@cache
def rules() -> list[Rule]:
    """All rules, highest priority first, then in the tables' order."""
    out = []
    for line in NAMES.strip().split("\n"):
        label, keyword, name = line.split(" | ", 2)
        for frame, words, priority, confidence in FRAMES:
            regex = rf"(?<![^ ])(?:{frame.format(name)})(?![^ ])"
            out.append(Rule(label, tuple(x.encode() for x in (keyword, *words)), re.compile(regex.encode()), priority, confidence))
    for line in SENTENCES.strip().split("\n"):
        label, keyword, text = line.split(" | ", 2)
        out.append(Rule(label, (keyword.encode(),), re.compile(rf"(?<![^ ])(?:{text})(?![^ ])".encode()), 3, 0.9))
    return sorted(out, key=lambda r: -r.priority)


@cache
def keywords():
    """An automaton of all keywords."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k in sorted({k for r in rules() for k in r.keywords}):
        found.add_word(k.decode(), k)
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int
    confidence: float


#: A-Z to a-z; what belongs to no word to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def resolved(found: list[Detection]) -> list[Detection]:
    """Without those that lie within the interval of one of higher priority, or of a longer one of the same; of equal
    intervals of one priority the first label stands.

    What contains a suppressed detection's container contains it too, so it is enough to ask what came before, kept or
    not: a tree over the starts holds the furthest end of any start up to each, n log n steps for n detections.
    """
    starts = sorted({d.start for d in found})
    place = {x: k + 1 for k, x in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        k, reach = place[d.start], -1
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach >= d.end:
            continue
        kept.append(d)
        k = place[d.start]
        while k < len(furthest):
            furthest[k] = max(furthest[k], d.end)
            k += k & -k
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def scan(flat: bytes) -> list[Detection]:
    """Detections in normalised text (words with one space between): byte intervals, overlaps settled."""
    present = {k for _, k in keywords().iter(flat.decode("utf-8", "replace"))}
    if not present:
        return []
    found = [Detection(r.label, m.start(), m.end(), r.priority, r.confidence) for r in rules() if all(k in present for k in r.keywords) for m in r.pattern.finditer(flat)]
    return resolved(found)


def places(flat: bytes) -> list[tuple[int, str]]:
    """(byte, label) of each phrase's places."""
    out = []
    for phrase, label in PHRASES.items():
        if phrase not in flat:
            continue
        padded = b" " + flat + b" "
        at = padded.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(b" " + phrase + b" ", at + 1)
    return sorted(out)


def licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. base_* come from PHRASES alone; labels
    adds what the rules detect; score is the largest confidence of a detection (a phrase's is 0.9), 0 without any;
    detections lists label, first word and words of each that stands. A null or empty text has no words and empty label
    strings; repeated rows are scanned each. One pass, no shuffle.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,word:long,n:long>>"

    def one(doc: int | None, text: bytes) -> dict:
        words = text.translate(WORDS).split()
        flat = b" ".join(words)
        base, found = places(flat), scan(flat)
        own = {label for _, label in base}
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) if base or found else np.empty(0, np.int64)

        def word(byte: int) -> int:
            return int(np.searchsorted(gaps, byte))

        return {
            "doc_id": doc,
            "n_words": len(words),
            "n_base": len(base),
            "first_word": word(base[0][0]) if base else None,
            "last_word": word(base[-1][0]) if base else None,
            "base_labels": ",".join(sorted(own)),
            "labels": ",".join(sorted(own | {d.label for d in found})),
            "score": max([d.confidence for d in found] + [0.9] * bool(base), default=0.0),
            "detections": [{"label": d.label, "word": word(d.start), "n": word(d.end) - word(d.start) + 1} for d in found],
        }

    fields = pa.schema(
        [("doc_id", pa.int64())]
        + [(x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        + [("detections", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_pylist([one(*x) for x in zip(b.column(0).to_pylist(), utf8(b.column(1)))], fields)

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)

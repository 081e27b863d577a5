"""The signature rules of licence scans, written by hand: label | keyword | priority | confidence | pattern.

Every match of a pattern holds its keyword. Patterns see lower-case text with runs of blanks
and comment marks as one blank. Priorities: identifiers and links over grants with a version,
over sentences of a licence's own text, over names, over what hints at no licence in particular.
"""

from __future__ import annotations

SIGNATURES = r"""
# GNU General Public License: notices, texts, names, links
gpl-1.0 | general public | 92 | .95 | gnu general public licen[cs]e,? (?:as published by the free software foundation[;,] )?(?:either )?\(?version 1\b(?!\.)
gpl-2.0 | general public | 92 | .95 | gnu general public licen[cs]e,? ?\(?(?:version |v\.? ?)2(?:\.0)?\b(?!\.[1-9])
gpl-3.0 | general public | 92 | .95 | gnu general public licen[cs]e,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b(?!\.[1-9])
gpl-2.0 | either version 2 | 93 | .97 | gnu general public licen[cs]e as published by the free software foundation[;,] either version 2(?: of the licen[cs]e)?,? or \(at your option\) any later version
gpl-3.0 | either version 3 | 93 | .97 | gnu general public licen[cs]e as published by the free software foundation[;,] either version 3(?: of the licen[cs]e)?,? or \(at your option\) any later version
gpl-2.0 | version 2 only | 93 | .97 | (?:gpl|general public licen[cs]e),? version 2 only
gpl-2.0 | version 2, june 1991 | 94 | .99 | gnu general public licen[cs]e version 2, june 1991
gpl-3.0 | version 3, 29 june 2007 | 94 | .99 | gnu general public licen[cs]e version 3, 29 june 2007
gpl-1.0 | version 1, february 1989 | 94 | .99 | gnu general public licen[cs]e version 1, february 1989
gpl | redistribute it and/or modify | 85 | .9 | redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl | general public | 70 | .8 | you should have received a copy of the gnu general public licen[cs]e
gpl | the licenses for most software are designed | 80 | .9 | the licenses for most software are designed to take away your freedom to share and change it
gpl | written offer, valid for at least three years | 76 | .85 | accompany it with a written offer, valid for at least three years
gpl-3.0 | conveying verbatim copies | 76 | .85 | you may convey verbatim copies of the program's source code|conveying verbatim copies
gpl-3.0 | installation information | 70 | .7 | "?installation information"? for a user product means
gpl | general public | 45 | .65 | \bgnu general public licen[cs]e\b
gpl-2.0 | gplv2 | 75 | .85 | \b(?:gnu )?gplv2(?:\+| or later)?\b
gpl-3.0 | gplv3 | 75 | .85 | \b(?:gnu )?gplv3(?:\+| or later)?\b
gpl-2.0 | gpl-2 | 74 | .85 | \bgpl-2(?:\.0)?(?:\+|-only|-or-later)?\b
gpl-3.0 | gpl-3 | 74 | .85 | \bgpl-3(?:\.0)?(?:\+|-only|-or-later)?\b
gpl | gpl licen | 40 | .55 | \bgpl licen[cs]ed?\b
gpl-2.0 | old-licenses/gpl-2.0 | 96 | .98 | gnu\.org/(?:licenses/)?old-licenses/gpl-2\.0
gpl-3.0 | licenses/gpl-3.0 | 96 | .98 | gnu\.org/licenses/gpl-3\.0
gpl | gnu.org/licenses/gpl | 72 | .8 | gnu\.org/licenses/gpl\b
gpl | gnu.org/copyleft/gpl | 72 | .8 | gnu\.org/copyleft/gpl
gpl-classpath | as a special exception | 84 | .9 | as a special exception, the copyright holders of this library give you permission to link this library with independent modules
gpl-classpath | classpath exception | 78 | .85 | \bclasspath exception\b
gpl-autoconf | autoconf | 80 | .85 | as a special exception to the gnu general public licen[cs]e, if you distribute this file as part of a program that contains a configuration script generated by autoconf
# Lesser, Affero and Free Documentation
lgpl-2.0 | library general public | 93 | .95 | gnu library general public licen[cs]e,? (?:as published by the free software foundation[;,] either )?\(?(?:version |v)2(?:\.0)?\b
lgpl-2.1 | lesser general public | 93 | .95 | gnu lesser general public licen[cs]e,? ?\(?(?:version |v\.? ?)2\.1\b
lgpl-3.0 | lesser general public | 93 | .95 | gnu lesser general public licen[cs]e,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b
lgpl-2.1 | either version 2.1 | 94 | .97 | lesser general public licen[cs]e as published by the free software foundation[;,] either version 2\.1
lgpl-3.0 | lesser general public | 94 | .97 | lesser general public licen[cs]e as published by the free software foundation[;,] either version 3
lgpl-2.1 | version 2.1, february 1999 | 95 | .99 | lesser general public licen[cs]e version 2\.1, february 1999
lgpl-2.0 | version 2, june 1991 | 95 | .99 | library general public licen[cs]e version 2, june 1991
lgpl | lesser general public | 86 | .85 | under the terms of the gnu lesser general public licen[cs]e
lgpl | library general public | 86 | .85 | under the terms of the gnu library general public licen[cs]e
lgpl | lesser general public | 50 | .7 | \bgnu lesser general public licen[cs]e\b
lgpl | library general public | 50 | .7 | \bgnu library general public licen[cs]e\b
lgpl-2.1 | lgpl | 76 | .85 | \blgpl(?:v| v|-)?2\.1(?:\+|-only|-or-later)?\b
lgpl-3.0 | lgpl | 76 | .85 | \blgpl(?:v| v|-)?3(?:\.0)?(?:\+|-only|-or-later)?\b
lgpl | gnu.org/licenses/lgpl | 73 | .8 | gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl
agpl-3.0 | affero general public | 93 | .95 | gnu affero general public licen[cs]e,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b
agpl-3.0 | affero general public | 94 | .97 | affero general public licen[cs]e as published by the free software foundation[;,] either version 3
agpl-3.0 | remote network interaction | 80 | .9 | remote network interaction; use with the gnu general public licen[cs]e
agpl-1.0 | affero general public | 93 | .9 | affero general public licen[cs]e,? \(?version 1\b
agpl | affero general public | 55 | .75 | \b(?:gnu )?affero general public licen[cs]e\b
agpl-3.0 | agplv3 | 76 | .85 | \bagplv3\+?\b
agpl | gnu.org/licenses/agpl | 74 | .8 | gnu\.org/licenses/agpl
gfdl-1.1 | free documentation | 93 | .95 | gnu free documentation licen[cs]e,? version 1\.1
gfdl-1.2 | free documentation | 93 | .95 | gnu free documentation licen[cs]e,? version 1\.2
gfdl-1.3 | free documentation | 93 | .95 | gnu free documentation licen[cs]e,? version 1\.3
gfdl | invariant sections | 75 | .8 | with no invariant sections, (?:with )?no front-cover texts
gfdl | free documentation | 50 | .7 | \bgnu free documentation licen[cs]e\b
# Apache
apache-2.0 | apache.org/licenses | 96 | .98 | apache\.org/licenses/licen[cs]e-2\.0
apache-2.0 | apache license | 92 | .95 | apache (?:software )?licen[cs]e,? ?\(?(?:version |v\.? ?)2(?:\.0)?\b
apache-1.1 | apache software license | 92 | .95 | apache software licen[cs]e,? ?\(?(?:version |v\.? ?)1\.1\b
apache-1.0 | apache software license | 92 | .95 | apache software licen[cs]e,? ?\(?(?:version |v\.? ?)1\.0\b
apache-2.0 | except in compliance | 84 | .88 | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | distributed on an | 78 | .75 | distributed on an "?as is"? basis, without warranties or conditions of any kind
apache-2.0 | grant of patent license | 80 | .85 | grant of patent licen[cs]e\. subject to the terms and conditions of this licen[cs]e, each contributor hereby grants
apache-2.0 | january 2004 | 94 | .99 | apache licen[cs]e version 2\.0, january 2004
apache-1.1 | includes software developed by the apache | 82 | .85 | this product includes software developed by the apache (?:software foundation|group)
apache-1.1 | "apache" and "apache software foundation" | 82 | .85 | the names "apache" and "apache software foundation" must not be used to endorse
apache-2.0 | contributor license agreements | 72 | .7 | licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements
apache | under the apache | 60 | .7 | under the apache licen[cs]e
apache-2.0 | apache-2.0 | 74 | .85 | \bapache-2\.0\b
apache-2.0 | apache 2.0 | 73 | .8 | \bapache 2\.0(?: licen[cs]ed?)?\b
apache | apache | 45 | .6 | \bapache(?: software)? licen[cs]e\b
# MIT and its relatives
mit | to any person obtaining a copy | 88 | .95 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | permission is hereby granted | 80 | .85 | permission is hereby granted, free of charge, to any person obtaining a copy
mit | this permission notice shall be included | 76 | .8 | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | in no event shall the authors | 66 | .6 | in no event shall the authors or copyright holders be liable for any claim, damages or other liability
mit-0 | mit-0 | 80 | .9 | \bmit-0\b|\bmit no attribution\b
x11 | except as contained in this notice | 82 | .85 | except as contained in this notice, the name of the x consortium shall not be used in advertising
x11 | x11 licen | 60 | .75 | \bx11 licen[cs]e\b
mit-advertising | advertising | 74 | .7 | except as contained in this notice, the names? of .{1,80} shall not be used in advertising or otherwise to promote
json | shall be used for good | 86 | .95 | the software shall be used for good, not evil
mit | under the mit | 62 | .75 | (?:licen[cs]ed|released|available|distributed) under (?:the )?(?:terms of the )?mit licen[cs]e
mit | opensource.org/licenses/mit | 95 | .97 | opensource\.org/licenses?/mit\b
mit | mit licen | 45 | .6 | \bmit licen[cs]e\b
mit | expat licen | 60 | .75 | \bexpat licen[cs]e\b
isc | with or without fee is hereby granted | 84 | .9 | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | with or without fee is hereby granted | 86 | .9 | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.
isc | the author disclaims all warranties | 70 | .7 | the author disclaims all warranties with regard to this software including all implied warranties
isc | isc licen | 55 | .7 | \bisc licen[cs]e\b
hpnd | and that both that copyright notice | 82 | .85 | provided that the above copyright notice appears? in all copies and that both that copyright notice and this permission notice appear
ntp | no representations about the suitability | 76 | .8 | makes no representations about the suitability (?:of )?this software for any purpose
ncsa | university of illinois/ncsa | 88 | .95 | university of illinois/ncsa open source licen[cs]e
ncsa | deal with the software without restriction | 82 | .85 | to deal with the software without restriction, including without limitation the rights
curl | curl | 80 | .85 | permission to use, copy, modify, and distribute this software .{0,120}curl|\bcurl licen[cs]e\b
# BSD: by the number of clauses
bsd-4-clause | all advertising materials | 90 | .95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse or promote products | 82 | .88 | neither the names? of .{1,120} may be used to endorse or promote products derived from this software
bsd-3-clause | endorse or promote products | 80 | .85 | the names? of .{1,120} (?:may|must) not be used to endorse or promote products derived from this software
bsd-2-clause | source and binary forms | 70 | .7 | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd | source and binary forms | 62 | .65 | redistribution and use in source and binary forms
bsd | binary form must reproduce | 64 | .7 | redistributions in binary form must reproduce the above copyright notice
bsd | source code must retain | 64 | .7 | redistributions of source code must retain the above copyright notice
bsd | by the copyright holders and contributors | 60 | .6 | this software is provided by the (?:copyright holders|regents|author)s?(?: and contributors)? "?'?as is
bsd-4-clause | university of california, berkeley | 84 | .9 | this product includes software developed by the university of california, berkeley and its contributors
bsd-2-clause | 2-clause | 78 | .9 | \b(?:bsd )?2-clause(?: "?simplified"?)?(?: bsd)?(?: licen[cs]e)?\b
bsd-3-clause | 3-clause | 78 | .9 | \b(?:bsd )?3-clause(?: "?(?:new|revised)"?)?(?: bsd)?(?: licen[cs]e)?\b
bsd-4-clause | 4-clause | 78 | .9 | \b(?:bsd )?4-clause(?: bsd)?(?: licen[cs]e)?\b
0bsd | zero-clause | 80 | .9 | \bzero-clause bsd\b|\bbsd zero-clause\b
bsd-2-clause | simplified bsd | 76 | .85 | \bsimplified bsd licen[cs]e\b
bsd-3-clause | modified bsd | 76 | .85 | \bmodified bsd licen[cs]e\b
bsd-3-clause | new bsd | 76 | .85 | \bnew bsd licen[cs]e\b
bsd-3-clause | revised bsd | 76 | .85 | \brevised bsd licen[cs]e\b
bsd | opensource.org/licenses/bsd | 90 | .9 | opensource\.org/licenses?/bsd
bsd | bsd-style | 50 | .6 | \bbsd-style licen[cs]e\b
bsd | bsd licen | 45 | .6 | \bbsd licen[cs]e\b
bsd-3-clause-clear | no express or implied licenses to any party's patent | 86 | .9 | no express or implied licenses to any party's patent rights are granted
# Mozilla, Eclipse, Sun, IBM, European Union
mpl-2.0 | mozilla.org/mpl/2.0 | 96 | .98 | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mozilla.org/mpl/mpl-1.1 | 96 | .98 | mozilla\.org/mpl/mpl-1\.1
mpl | mozilla.org/mpl | 80 | .85 | mozilla\.org/mpl
mpl-2.0 | this source code form is subject | 88 | .95 | this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0
mpl-1.1 | subject to the mozilla public license version | 90 | .95 | subject to the mozilla public licen[cs]e version 1\.1
mpl-2.0 | mozilla public | 92 | .95 | mozilla public licen[cs]e,? ?\(?(?:version |v\.? ?)2(?:\.0)?\b
mpl-1.1 | mozilla public | 92 | .95 | mozilla public licen[cs]e,? ?\(?(?:version |v\.? ?)1\.1\b
mpl-1.0 | mozilla public | 92 | .95 | mozilla public licen[cs]e,? ?\(?(?:version |v\.? ?)1\.0\b
mpl | incompatible with secondary licenses | 84 | .9 | incompatible with secondary licenses, as defined by the mozilla public licen[cs]e
mpl | mozilla public | 50 | .7 | \bmozilla public licen[cs]e\b
epl-2.0 | eclipse.org/legal/epl | 96 | .98 | eclipse\.org/legal/epl-(?:v20|2\.0)
epl-1.0 | eclipse.org/legal/epl | 95 | .98 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse public | 92 | .95 | eclipse public licen[cs]e,? ?-? ?\(?(?:version |v\.? ?)2(?:\.0)?\b
epl-1.0 | eclipse public | 92 | .95 | eclipse public licen[cs]e,? ?-? ?\(?(?:version |v\.? ?)1(?:\.0)?\b
epl | eclipse public | 50 | .7 | \beclipse public licen[cs]e\b
edl-1.0 | eclipse distribution | 70 | .85 | eclipse distribution licen[cs]e
cddl-1.1 | common development and distribution | 92 | .95 | common development and distribution licen[cs]e \(cddl\) version 1\.1
cddl-1.0 | common development and distribution | 91 | .95 | common development and distribution licen[cs]e,? (?:\(cddl\) )?version 1\.0
cddl | common development and distribution | 50 | .7 | common development and distribution licen[cs]e
cpl-1.0 | common public | 70 | .85 | common public licen[cs]e(?: version 1\.0| - v ?1\.0)?
cpal-1.0 | common public attribution | 80 | .9 | common public attribution licen[cs]e
ipl-1.0 | ibm public | 80 | .9 | ibm public licen[cs]e
eupl-1.2 | european union public | 92 | .95 | european union public licen[cs]e,? (?:version |v\.? ?)1\.2
eupl-1.1 | european union public | 92 | .95 | european union public licen[cs]e,? (?:version |v\.? ?)1\.1
eupl | european union public | 60 | .8 | european union public licen[cs]e
osl-3.0 | open software | 90 | .9 | open software licen[cs]e,? (?:version |v\.? ?)3\.0
osl | open software license | 55 | .7 | \bopen software licen[cs]e\b
afl-3.0 | academic free | 90 | .9 | academic free licen[cs]e,? (?:version |v\.? ?)3\.0
afl | academic free | 55 | .7 | academic free licen[cs]e
qpl-1.0 | q public | 80 | .9 | \bq public licen[cs]e
ms-pl | microsoft public | 80 | .9 | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | 80 | .9 | microsoft reciprocal licen[cs]e
apsl-2.0 | apple public source | 80 | .9 | apple public source licen[cs]e
nokia | nokia open source | 80 | .9 | nokia open source licen[cs]e
sissl | sun industry standards | 80 | .9 | sun industry standards source licen[cs]e
watcom-1.0 | sybase open watcom | 80 | .9 | sybase open watcom public licen[cs]e
upl-1.0 | universal permissive | 80 | .9 | universal permissive licen[cs]e
ecl-2.0 | educational community | 80 | .9 | educational community licen[cs]e
# Creative Commons, by elements and version
cc-by-4.0 | licenses/by/4.0 | 97 | 1 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | licenses/by/3.0 | 97 | 1 | creativecommons\.org/licenses/by/3\.0
cc-by-2.5 | licenses/by/2.5 | 97 | 1 | creativecommons\.org/licenses/by/2\.5
cc-by-2.0 | licenses/by/2.0 | 97 | 1 | creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 | licenses/by-sa/4.0 | 97 | 1 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | licenses/by-sa/3.0 | 97 | 1 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | licenses/by-nc/4.0 | 97 | 1 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | licenses/by-nc/3.0 | 97 | 1 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nd-4.0 | licenses/by-nd/4.0 | 97 | 1 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-4.0 | licenses/by-nc-sa/4.0 | 97 | 1 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | licenses/by-nc-sa/3.0 | 97 | 1 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 | licenses/by-nc-nd/4.0 | 97 | 1 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | licenses/by-nc-nd/3.0 | 97 | 1 | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-4.0 | cc | 84 | .92 | \bcc[- ]by[- ]4\.0\b
cc-by-3.0 | cc | 84 | .92 | \bcc[- ]by[- ]3\.0\b
cc-by-sa-4.0 | cc | 86 | .92 | \bcc[- ]by[- ]sa[- ]4\.0\b
cc-by-sa-3.0 | cc | 86 | .92 | \bcc[- ]by[- ]sa[- ]3\.0\b
cc-by-nc-4.0 | cc | 86 | .92 | \bcc[- ]by[- ]nc[- ]4\.0\b
cc-by-nd-4.0 | cc | 86 | .92 | \bcc[- ]by[- ]nd[- ]4\.0\b
cc-by-nc-sa-4.0 | cc | 88 | .92 | \bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
cc-by-nc-nd-4.0 | cc | 88 | .92 | \bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
cc-by | cc | 72 | .8 | \bcc[- ]by\b(?![- ](?:sa|nc|nd)\b)
cc-by-sa | cc | 74 | .85 | \bcc[- ]by[- ]sa\b
cc-by-nc | cc | 74 | .85 | \bcc[- ]by[- ]nc\b(?![- ](?:sa|nd)\b)
cc-by-nd | cc | 74 | .85 | \bcc[- ]by[- ]nd\b
cc-by-nc-sa | cc | 76 | .85 | \bcc[- ]by[- ]nc[- ]sa\b
cc-by-nc-nd | cc | 76 | .85 | \bcc[- ]by[- ]nc[- ]nd\b
cc-by-4.0 | creative commons attribution | 82 | .92 | creative commons attribution 4\.0(?: international)?
cc-by-3.0 | creative commons attribution | 82 | .92 | creative commons attribution 3\.0(?: unported)?
cc-by-sa-4.0 | creative commons attribution | 83 | .92 | creative commons attribution[- ]share ?alike 4\.0(?: international)?
cc-by-sa-3.0 | creative commons attribution | 83 | .92 | creative commons attribution[- ]share ?alike 3\.0(?: unported)?
cc-by-nc-4.0 | creative commons attribution | 83 | .92 | creative commons attribution[- ]non ?-?commercial 4\.0
cc-by-nc-sa-4.0 | creative commons attribution | 84 | .92 | creative commons attribution[- ]non ?-?commercial[- ]share ?alike 4\.0
cc-by-nc-nd-4.0 | creative commons attribution | 84 | .92 | creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv(?:ative)?s(?: works)? 4\.0
cc-by | creative commons attribution | 62 | .75 | creative commons attribution(?![- ](?:non|no|share))
cc-by-sa | creative commons attribution | 63 | .8 | creative commons attribution[- ]share ?alike
cc-by-nc | creative commons attribution | 63 | .8 | creative commons attribution[- ]non ?-?commercial(?![- ](?:no|share))
cc-by-nd | creative commons attribution | 63 | .8 | creative commons attribution[- ]no ?-?deriv(?:ative)?s
cc-by-nc-sa | creative commons attribution | 64 | .8 | creative commons attribution[- ]non ?-?commercial[- ]share ?alike
cc-by-nc-nd | creative commons attribution | 64 | .8 | creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv(?:ative)?s
cc0-1.0 | publicdomain/zero | 96 | .98 | creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 | cc0 | 80 | .9 | \bcc0(?:[- ]1\.0)?\b
cc0-1.0 | to the extent possible under law | 82 | .85 | to the extent possible under law, .{1,120} has waived all copyright and related or neighboring rights
cc-pdm | publicdomain/mark | 96 | .95 | creativecommons\.org/publicdomain/mark/1\.0
cc | creative commons licen | 40 | .5 | creative commons licen[cs]e
# Other software licences
zlib | this software is provided 'as-is' | 84 | .9 | this software is provided 'as-is', without any express or implied warranty
zlib | altered source versions | 82 | .88 | altered source versions must be plainly marked as such
zlib | zlib licen | 55 | .7 | \bzlib(?:/libpng)? licen[cs]e\b
libpng | libpng licen | 60 | .75 | \blibpng licen[cs]e\b
boost-1.0 | boost.org/license_1_0 | 96 | .98 | boost\.org/licen[cs]e_1_0
boost-1.0 | boost software | 86 | .92 | boost software licen[cs]e,? ?-? ?(?:version 1\.0)?
boost-1.0 | transmit the software, and to prepare derivative works | 82 | .85 | execute, and transmit the software, and to prepare derivative works of the software
unlicense | free and unencumbered software | 90 | .97 | this is free and unencumbered software released into the public domain
unlicense | unlicense | 70 | .85 | \bunlicense(?:\.org)?\b
wtfpl | do what the | 84 | .95 | do what the \w{1,12} you want to public licen[cs]e
wtfpl | wtfpl | 76 | .85 | \bwtfpl\b
beerware | beer | 84 | .9 | (?:the )?beer-?ware licen[cs]e|you can buy me a beer in return
artistic-2.0 | artistic | 90 | .93 | artistic licen[cs]e,? \(?(?:version )?2\.0
artistic-1.0 | the intent of this document is to state | 82 | .85 | the intent of this document is to state the conditions under which a package may be copied
artistic | artistic licen | 50 | .7 | \bartistic licen[cs]e\b
perl | same terms as perl | 82 | .9 | under the same terms as perl itself
psf-2.0 | python software foundation | 82 | .9 | python software foundation licen[cs]e(?: version 2)?
php-3.01 | php licen | 82 | .9 | php licen[cs]e,? version 3\.01
php | php licen | 55 | .7 | \bphp licen[cs]e\b
ruby | ruby's licen | 70 | .8 | \bruby's licen[cs]e\b
ruby | same terms as ruby | 80 | .88 | under the same terms as ruby
openssl | openssl project for use in the openssl toolkit | 88 | .95 | developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software written by eric young | 88 | .95 | this product includes cryptographic software written by eric young
openssl | openssl licen | 60 | .75 | \bopenssl licen[cs]e\b
postgresql | postgresql licen | 75 | .85 | \bpostgresql licen[cs]e\b
vim | vim licen | 70 | .8 | \bvim licen[cs]e\b
tcl | tcl/tk | 70 | .8 | \btcl/tk licen[cs]e\b
w3c | w3c software | 80 | .88 | w3c software (?:notice and )?(?:document )?licen[cs]e
w3c | w3.org/consortium/legal | 92 | .93 | w3\.org/consortium/legal
sleepycat | sleepycat | 80 | .88 | \bsleepycat licen[cs]e\b
zpl-2.1 | zope public | 80 | .9 | zope public licen[cs]e
lppl-1.3c | latex project public | 84 | .92 | latex project public licen[cs]e(?:, either version 1\.3)?
cecill-2.1 | cecill | 80 | .88 | \bcecill(?:[- ][abc])?(?: free software)? licen[cs]e
mulanpsl-2.0 | mulan | 84 | .92 | mulan (?:permissive software licen[cs]e|psl)(?:,? ?v2)?
blueoak-1.0.0 | blue oak model | 84 | .92 | blue oak model licen[cs]e
elastic-2.0 | elastic license | 82 | .9 | \belastic licen[cs]e(?: 2\.0)?\b
sspl-1.0 | server side public | 84 | .93 | server side public licen[cs]e
busl-1.1 | business source | 84 | .93 | business source licen[cs]e(?: 1\.1)?
commons-clause | commons clause | 84 | .92 | \bcommons clause\b
polyform | polyform | 82 | .9 | polyform (?:noncommercial|small business|shield|strict) licen[cs]e
icu | icu licen | 70 | .8 | \bicu licen[cs]e\b
unicode | unicode, inc | 80 | .88 | unicode, inc\. licen[cs]e agreement
intel | intel open source | 80 | .88 | intel open source licen[cs]e
hpl | hewlett-packard | 60 | .6 | hewlett-packard company makes no warranty
sun-bcl | binary code license | 82 | .9 | binary code licen[cs]e agreement
oracle-otn | oracle technology network | 82 | .9 | oracle technology network licen[cs]e
# Fonts, data, hardware
ofl-1.1 | scripts.sil.org/ofl | 96 | .98 | scripts\.sil\.org/ofl
ofl-1.1 | open font | 82 | .9 | sil open font licen[cs]e(?:,? version 1\.1)?
ofl-1.1 | reserved font name | 78 | .85 | with reserved font name
ubuntu-font | ubuntu font | 84 | .92 | ubuntu font licen[cs]e
bitstream-vera | bitstream vera | 80 | .88 | bitstream vera is a trademark
odbl-1.0 | open database | 84 | .92 | open (?:data commons )?database licen[cs]e|open data commons open database licen[cs]e
odc-by-1.0 | open data commons attribution | 84 | .92 | open data commons attribution licen[cs]e
pddl-1.0 | public domain dedication and licen | 84 | .92 | public domain dedication and licen[cs]e
ogl-uk-3.0 | open government | 84 | .9 | open government licen[cs]e(?: v3\.0)?
cdla-permissive | community data license | 84 | .92 | community data licen[cs]e agreement
cern-ohl | cern open hardware | 84 | .92 | cern open hardware licen[cs]e
solderpad | solderpad | 82 | .9 | solderpad hardware licen[cs]e
openrail | openrail | 82 | .9 | \b(?:creativeml )?openrail(?:-m|\+\+)?\b
# Identifiers in files and packages
gpl-2.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?gpl-2\.0(?:\+|-only|-or-later)?
gpl-3.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?gpl-3\.0(?:\+|-only|-or-later)?
lgpl-2.1 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?lgpl-2\.1(?:\+|-only|-or-later)?
lgpl-3.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?lgpl-3\.0(?:\+|-only|-or-later)?
agpl-3.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?agpl-3\.0(?:\+|-only|-or-later)?
apache-2.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?apache-2\.0
mit | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?mit(?![-0-9a-z])
mit-0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?mit-0
isc | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?isc(?![-0-9a-z])
bsd-2-clause | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?bsd-2-clause
bsd-3-clause | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?bsd-3-clause
0bsd | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?0bsd
mpl-2.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?mpl-2\.0
epl-2.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?epl-2\.0
cc-by-4.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?cc-by-4\.0
cc0-1.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?cc0-1\.0
boost-1.0 | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?bsl-1\.0
unlicense | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?unlicense
zlib | spdx-license-identifier | 100 | 1 | spdx-license-identifier: ?\(?zlib
other-spdx | spdx-license-identifier | 90 | .8 | spdx-license-identifier: ?\(?[a-z0-9][a-z0-9.+-]{1,40}
gpl | osi approved :: gnu general public | 95 | .95 | osi approved :: gnu general public licen[cs]e
mit | osi approved :: mit | 95 | .97 | osi approved :: mit licen[cs]e
apache | osi approved :: apache | 95 | .95 | osi approved :: apache software licen[cs]e
bsd | osi approved :: bsd | 95 | .95 | osi approved :: bsd licen[cs]e
# No licence in particular
public-domain | public domain | 52 | .6 | (?:released|placed|dedicated) (?:in)?to the public domain
public-domain | public domain | 40 | .5 | \bpublic domain\b
warranty-disclaimer | without warranty of any kind | 20 | .3 | provided [\"']?as is[\"']?,? without warranty of any kind
warranty-disclaimer | merchantability | 20 | .3 | implied warrant(?:y|ies) of merchantability
warranty-disclaimer | without any warranty | 20 | .3 | without any warranty; without even the implied warranty
proprietary | all rights reserved | 30 | .4 | \ball rights reserved\b
proprietary | proprietary and confidential | 38 | .55 | \bproprietary and confidential\b
proprietary | unauthori | 35 | .5 | unauthori[sz]ed (?:copying|reproduction|distribution|use)
proprietary | permission | 32 | .4 | may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior |express |written )*permission
proprietary | end user license agreement | 38 | .55 | \bend user licen[cs]e agreement\b
proprietary | for internal use only | 36 | .5 | \bfor internal use only\b
proprietary | trade secret | 34 | .45 | \btrade secrets? of\b
non-commercial | non-commercial use only | 42 | .5 | \b(?:for )?non-commercial use only\b
research-only | research purposes only | 42 | .5 | \bfor research purposes only\b
dual | dual licen | 30 | .4 | \bdual[- ]licen[cs]ed\b
unspecified | licensed under | 5 | .2 | \blicensed under\b
unspecified | see license | 5 | .2 | \bsee licen[cs]e(?: file)?(?: for details)?\b
unspecified | license agreement | 6 | .2 | \blicen[cs]e agreement\b
"""

"""Signature rules of the licence scan, hand-written, one a line: label ; priority ; keyword ; regular expression.

They run on normalised text: words of a-z, 0-9 and non-ASCII characters joined by one space, so "Apache-2.0" reads
"apache 2 0". A rule runs only where its keyword occurs. Matches begin and end at word borders.
"""

RULES = r"""
gpl-3.0 ; 90 ; gnu general public license ; gnu general public license (?:as published by the free software foundation )?(?:either )?(?:gpl )?(?:version|v) ?3(?: 0)?
gpl-3.0 ; 90 ; gplv3 ; (?:gnu )?gplv3
gpl-3.0 ; 92 ; spdx license identifier ; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later ; 95 ; gnu general public license ; gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-3.0-or-later ; 96 ; spdx license identifier ; spdx license identifier gpl 3 0 (?:or later|plus)
gpl-2.0 ; 90 ; gnu general public license ; gnu general public license (?:as published by the free software foundation )?(?:either )?(?:gpl )?(?:version|v) ?2(?: 0)?
gpl-2.0 ; 90 ; gplv2 ; (?:gnu )?gplv2
gpl-2.0 ; 92 ; spdx license identifier ; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later ; 95 ; gnu general public license ; gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-2.0-or-later ; 96 ; spdx license identifier ; spdx license identifier gpl 2 0 (?:or later|plus)
gpl-1.0 ; 90 ; gnu general public license ; gnu general public license (?:version|v) ?1(?: 0)?
gpl-1.0 ; 92 ; spdx license identifier ; spdx license identifier gpl 1 0(?: only| or later)?
gpl-notice ; 70 ; free software you can redistribute ; this (?:program|software|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-notice ; 60 ; without even the implied warranty ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl-notice ; 60 ; received a copy of the gnu ; you should have received a copy of the gnu general public license
gpl-exception-classpath ; 97 ; classpath exception ; (?:gnu )?(?:gpl )?(?:with (?:the )?)?classpath exception(?: 2 0)?
gpl-exception-bison ; 97 ; bison exception ; (?:with (?:the )?)?bison exception(?: 2 2)?
gpl-exception-gcc ; 97 ; gcc runtime library exception ; gcc runtime library exception(?: version)?(?: 3 1)?
gpl-exception-linking ; 94 ; linking exception ; (?:gpl )?(?:with (?:a )?)?(?:static )?linking exception
gpl-exception-syscall ; 97 ; linux syscall note ; (?:with )?linux syscall note
lgpl ; 45 ; lesser general public license ; gnu lesser general public license
lgpl ; 45 ; library general public license ; gnu library general public license
lgpl-2.0 ; 90 ; library general public license ; gnu library general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2(?: 0)?
lgpl-2.0 ; 92 ; spdx license identifier ; spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 ; 90 ; lesser general public license ; gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2 1
lgpl-2.1 ; 92 ; spdx license identifier ; spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later ; 95 ; lesser general public license ; gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the license)? or (?:at your option )?any later version
lgpl-2.1-or-later ; 96 ; spdx license identifier ; spdx license identifier lgpl 2 1 or later
lgpl-3.0 ; 90 ; lesser general public license ; gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
lgpl-3.0 ; 92 ; spdx license identifier ; spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 ; 90 ; lgplv3 ; (?:gnu )?lgplv3
lgpl-2.1 ; 90 ; lgplv2 ; (?:gnu )?lgplv2(?: 1)?
agpl ; 45 ; affero general public license ; (?:gnu )?affero general public license
agpl-1.0 ; 90 ; affero general public license ; affero general public license (?:version|v) ?1(?: 0)?
agpl-3.0 ; 90 ; affero general public license ; gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
agpl-3.0 ; 92 ; spdx license identifier ; spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later ; 96 ; spdx license identifier ; spdx license identifier agpl 3 0 or later
agpl-3.0 ; 90 ; agplv3 ; (?:gnu )?agplv3
gfdl ; 45 ; free documentation license ; gnu free documentation license
gfdl-1.1 ; 90 ; free documentation license ; gnu free documentation license (?:version|v) ?1 1
gfdl-1.2 ; 90 ; free documentation license ; gnu free documentation license (?:version|v) ?1 2
gfdl-1.3 ; 90 ; free documentation license ; gnu free documentation license (?:version|v) ?1 3
gfdl ; 70 ; with no invariant sections ; with no invariant sections no front cover texts and no back cover texts
gnu-all-permissive ; 85 ; copying and distribution of this file ; copying and distribution of this file with or without modification are permitted in any medium without royalty
apache-2.0 ; 90 ; apache license ; apache license(?: software)? (?:version|v) ?2(?: 0)?
apache-2.0 ; 88 ; apache software license ; apache software license (?:version|v) ?2(?: 0)?
apache-2.0 ; 95 ; licensed under the apache license ; licensed under the apache license (?:version|v) ?2(?: 0)?
apache-2.0 ; 92 ; spdx license identifier ; spdx license identifier apache 2 0
apache-2.0 ; 80 ; licenses license 2 0 ; (?:http|https) www apache org licenses license 2 0(?: txt| html)?
apache-2.0 ; 75 ; may not use this file except in compliance ; you may not use this file except in compliance with the license
apache-2.0 ; 60 ; distributed on an as is basis ; software distributed under the license is distributed on an as is basis
apache-1.1 ; 90 ; apache software license ; apache software license (?:version|v) ?1 1
apache-1.1 ; 92 ; spdx license identifier ; spdx license identifier apache 1 1
apache-1.0 ; 90 ; apache license ; apache license (?:version|v) ?1(?: 0)?
apache-1.0 ; 92 ; spdx license identifier ; spdx license identifier apache 1 0
apache-llvm ; 97 ; llvm exception ; apache (?:license )?(?:v|version )?2 0 with llvm exceptions?
mit-text ; 85 ; permission is hereby granted free of charge ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-text ; 70 ; the above copyright notice and this permission notice ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-text ; 65 ; the software is provided as is ; the software is provided as is without warranty of any kind express or implied
mit-notice ; 80 ; under the mit license ; (?:released|licensed|distributed|available) under the mit license
mit-notice ; 92 ; spdx license identifier ; spdx license identifier mit
mit-notice ; 70 ; opensource org licenses mit ; (?:http|https) (?:www )?opensource org licenses mit(?: license)?(?: php)?
mit-0 ; 94 ; mit no attribution ; mit no attribution(?: license)?
mit-0 ; 94 ; spdx license identifier ; spdx license identifier mit 0
mit-modern ; 90 ; mit modern variant ; mit modern variant(?: license)?
mit-x11 ; 80 ; x11 license ; (?:mit )?x11 license
mit-x11 ; 70 ; the x consortium ; except as contained in this notice the name of the x consortium shall not be used
bsd-2-clause ; 92 ; spdx license identifier ; spdx license identifier bsd 2 clause
bsd-2-clause ; 85 ; bsd 2 clause ; bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause ; 85 ; simplified bsd license ; simplified bsd license
bsd-2-clause ; 85 ; two clause bsd ; two clause bsd(?: style)? license
bsd-2-clause-patent ; 95 ; bsd 2 clause ; bsd 2 clause (?:plus )?patent(?: license)?
bsd-3-clause ; 92 ; spdx license identifier ; spdx license identifier bsd 3 clause
bsd-3-clause ; 85 ; bsd 3 clause ; bsd 3 clause(?: new| revised)?(?: license)?
bsd-3-clause ; 85 ; new bsd license ; new bsd license
bsd-3-clause ; 85 ; modified bsd license ; modified bsd license
bsd-3-clause ; 85 ; revised bsd license ; revised bsd license
bsd-3-clause ; 75 ; nor the names of its contributors ; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause-clear ; 95 ; bsd 3 clause clear ; bsd 3 clause clear(?: license)?
bsd-4-clause ; 92 ; spdx license identifier ; spdx license identifier bsd 4 clause
bsd-4-clause ; 85 ; bsd 4 clause ; bsd 4 clause(?: original| old)?(?: license)?
bsd-4-clause ; 75 ; all advertising materials mentioning features ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-0-clause ; 92 ; spdx license identifier ; spdx license identifier 0bsd
bsd-0-clause ; 85 ; zero clause bsd ; (?:bsd )?zero clause bsd(?: license)?
bsd ; 40 ; bsd license ; bsd(?: style)? license
bsd-text ; 70 ; redistribution and use in source and binary forms ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
isc ; 85 ; isc license ; isc license
isc ; 92 ; spdx license identifier ; spdx license identifier isc
isc ; 80 ; permission to use copy modify and or distribute ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.0 ; 90 ; mozilla public license ; mozilla public license (?:version|v) ?1 0
mpl-1.1 ; 90 ; mozilla public license ; mozilla public license (?:version|v) ?1 1
mpl-2.0 ; 90 ; mozilla public license ; mozilla public license (?:version|v) ?2(?: 0)?
mpl-2.0 ; 92 ; spdx license identifier ; spdx license identifier mpl 2 0
mpl-1.1 ; 92 ; spdx license identifier ; spdx license identifier mpl 1 1
mpl ; 45 ; mozilla public license ; mozilla public license
mpl-2.0 ; 75 ; this source code form is subject to the terms ; this source code form is subject to the terms of the mozilla public license
epl-1.0 ; 90 ; eclipse public license ; eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 ; 90 ; eclipse public license ; eclipse public license (?:version |v ?)?2(?: 0)?
epl ; 45 ; eclipse public license ; eclipse public license
epl-1.0 ; 92 ; spdx license identifier ; spdx license identifier epl 1 0
epl-2.0 ; 92 ; spdx license identifier ; spdx license identifier epl 2 0
edl-1.0 ; 88 ; eclipse distribution license ; eclipse distribution license(?: v ?1 0| 1 0)?
cddl ; 45 ; common development and distribution license ; common development and distribution license
cddl-1.0 ; 90 ; common development and distribution license ; common development and distribution license (?:cddl )?(?:version |v ?)?1 0
cddl-1.1 ; 90 ; common development and distribution license ; common development and distribution license (?:cddl )?(?:version |v ?)?1 1
cddl-1.0 ; 92 ; spdx license identifier ; spdx license identifier cddl 1 0
cpl-1.0 ; 85 ; common public license ; common public license(?: version| v)?(?: 1 0)?
ipl-1.0 ; 85 ; ibm public license ; ibm public license(?: version| v)?(?: 1 0)?
cpal-1.0 ; 85 ; common public attribution license ; common public attribution license(?: version| v)?(?: 1 0)?
eupl ; 45 ; european union public licence ; european union public licence
eupl-1.1 ; 90 ; european union public licence ; european union public licence (?:eupl )?(?:version |v ?)?1 1
eupl-1.2 ; 90 ; european union public licence ; european union public licence (?:eupl )?(?:version |v ?)?1 2
eupl-1.2 ; 92 ; spdx license identifier ; spdx license identifier eupl 1 2
osl-3.0 ; 85 ; open software license ; open software license(?: version| v)?(?: 3 0)?
osl-2.1 ; 90 ; open software license ; open software license (?:version |v ?)?2 1
afl-3.0 ; 85 ; academic free license ; academic free license(?: version| v)?(?: 3 0)?
afl-2.1 ; 90 ; academic free license ; academic free license (?:version |v ?)?2 1
ecl-2.0 ; 85 ; educational community license ; educational community license(?: version| v)?(?: 2 0)?
artistic-1.0 ; 88 ; artistic license ; artistic license (?:version |v ?)?1(?: 0)?
artistic-2.0 ; 88 ; artistic license ; artistic license (?:version |v ?)?2(?: 0)?
artistic ; 45 ; artistic license ; (?:clarified )?artistic license
artistic-2.0 ; 92 ; spdx license identifier ; spdx license identifier artistic 2 0
perl ; 75 ; same terms as perl itself ; under the same terms as perl itself
python-2.0 ; 85 ; python software foundation license ; python software foundation license(?: version| v)?(?: 2)?
python-2.0 ; 85 ; psf license agreement ; psf license agreement for python(?: [0-9 ]+)?
python-cnri ; 85 ; cnri open source license ; cnri open source license(?: agreement)?
ruby ; 85 ; ruby license ; ruby license
php-3.0 ; 85 ; php license ; php license (?:version |v ?)?3 0(?: [0-9]+)?
php-3.01 ; 88 ; php license ; php license (?:version |v ?)?3 01
php ; 45 ; php license ; php license
zend-2.0 ; 85 ; zend license ; zend(?: engine)? license(?: version| v)?(?: 2 0)?
zlib ; 85 ; zlib license ; zlib license
zlib ; 88 ; zlib libpng license ; zlib libpng license
zlib ; 92 ; spdx license identifier ; spdx license identifier zlib
zlib ; 70 ; altered source versions must be plainly marked ; altered source versions must be plainly marked as such
libpng ; 85 ; libpng license ; libpng license(?: version)?(?: 2)?
boost-1.0 ; 88 ; boost software license ; boost software license(?: version| v)?(?: 1 0)?
boost-1.0 ; 92 ; spdx license identifier ; spdx license identifier bsl 1 0
busl-1.1 ; 88 ; business source license ; business source license(?: version| v)?(?: 1 1)?
busl-1.1 ; 92 ; spdx license identifier ; spdx license identifier busl 1 1
sspl-1.0 ; 88 ; server side public license ; server side public license(?: version| v)?(?: 1)?
elastic-2.0 ; 88 ; elastic license ; elastic license(?: version| v)?(?: 2 0)?
confluent ; 85 ; confluent community license ; confluent community license(?: agreement)?(?: version 1 0)?
timescale ; 85 ; timescale license ; timescale license(?: agreement)?
redis-source ; 85 ; redis source available license ; redis source available license(?: agreement)?
commons-clause ; 85 ; commons clause ; commons clause(?: license)? condition(?: v1 0)?
polyform ; 80 ; polyform ; polyform (?:noncommercial|small business|shield|perimeter|strict|internal use)(?: license)?(?: 1 0 0)?
prosperity ; 85 ; prosperity public license ; prosperity public license(?: [0-9 ]+)?
parity ; 85 ; parity public license ; parity public license(?: [0-9 ]+)?
blue-oak-1.0 ; 88 ; blue oak model license ; blue oak model license(?: 1 0 0)?
unlicense ; 85 ; the unlicense ; (?:under|released under|licensed under) the unlicense
unlicense ; 92 ; spdx license identifier ; spdx license identifier unlicense
unlicense ; 80 ; released into the public domain ; this is free and unencumbered software released into the public domain
public-domain ; 60 ; released into the public domain ; released into the public domain
public-domain ; 60 ; dedicated to the public domain ; (?:hereby )?dedicated to the public domain
public-domain ; 55 ; is in the public domain ; (?:work|file|code|software) is in the public domain
wtfpl ; 90 ; do what the fuck you want ; do what the fuck you want to public license(?: version 2)?
wtfpl ; 85 ; wtfpl ; wtfpl(?: license)?
beerware ; 85 ; beer ware license ; (?:the )?beer ware license(?: revision 42)?
json ; 85 ; for good not evil ; software shall be used for good not evil
fair ; 80 ; fair license ; (?:under the )?fair license
vim ; 85 ; vim license ; vim license
curl ; 80 ; curl license ; curl license
openssl ; 85 ; openssl license ; openssl license
openssl ; 75 ; developed by the openssl project ; product includes software developed by the openssl project
ssleay ; 80 ; original ssleay license ; original ssleay license
ncsa ; 88 ; university of illinois ncsa ; university of illinois ncsa open source license
ncsa ; 92 ; spdx license identifier ; spdx license identifier ncsa
icu ; 85 ; icu license ; icu license(?: icu 1 8 1 and later)?
unicode-dfs ; 85 ; unicode license agreement ; unicode license agreement data files and software
unicode-3.0 ; 85 ; unicode license ; unicode license v3
w3c ; 85 ; w3c software ; w3c software (?:notice and|and document) (?:license|notice and license)
ofl-1.1 ; 88 ; sil open font license ; sil open font license(?: version| v)?(?: 1 [01])?
ofl-1.1 ; 92 ; spdx license identifier ; spdx license identifier ofl 1 1
ubuntu-font ; 85 ; ubuntu font licence ; ubuntu font licence(?: version)?(?: 1 0)?
bitstream-vera ; 85 ; bitstream vera ; bitstream vera fonts? copyright
font-arphic ; 85 ; arphic public license ; arphic public license
ijg ; 85 ; independent jpeg group ; (?:based in part on|this software is) .{0,30}?(?:the work of )?the independent jpeg group
freetype ; 85 ; freetype project license ; freetype project license
imagemagick ; 85 ; imagemagick license ; imagemagick license
sleepycat ; 85 ; sleepycat license ; sleepycat license
qpl-1.0 ; 85 ; q public license ; q public license(?: version| v)?(?: 1 0)?
nokia ; 85 ; nokia open source license ; nokia open source license(?: version)?(?: 1 0a)?
apple-apsl ; 85 ; apple public source license ; apple public source license(?: version| v)?(?: [12] [0-9])?
microsoft-pl ; 88 ; microsoft public license ; microsoft public license(?: ms pl)?
microsoft-rl ; 88 ; microsoft reciprocal license ; microsoft reciprocal license(?: ms rl)?
microsoft-pl ; 92 ; spdx license identifier ; spdx license identifier ms pl
intel ; 80 ; intel open source license ; intel open source license
nasa ; 85 ; nasa open source agreement ; nasa open source agreement(?: version)?(?: 1 3)?
lppl-1.3c ; 88 ; latex project public license ; latex project public license(?: version| v)?(?: 1 3[ac]?)?
tcl ; 75 ; this software is copyrighted by the regents ; this software is copyrighted by the regents of the university of california
postgresql ; 85 ; postgresql license ; postgresql license(?: licence)?
oracle-upl ; 88 ; universal permissive license ; universal permissive license(?: version| v)?(?: 1 0)?
cecill ; 80 ; cecill ; cecill(?: free software license agreement)?(?: version| v)? ?(?:2 1|2 0|b|c)
hippocratic ; 85 ; hippocratic license ; hippocratic license(?: version)?(?: [0-9 ]+)?
mulan ; 88 ; mulan permissive software license ; mulan permissive software license(?: v ?2)?
anti-996 ; 85 ; anti 996 license ; anti 996 license(?: version)?(?: 1 0)?
odbl-1.0 ; 88 ; open database license ; open (?:data commons )?(?:open )?database license(?: v ?1 0)?
odc-by-1.0 ; 88 ; open data commons attribution license ; open data commons attribution license(?: v ?1 0)?
pddl-1.0 ; 88 ; public domain dedication and license ; (?:open data commons )?public domain dedication and license(?: v ?1 0)?
cdla-permissive ; 88 ; community data license agreement ; community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing ; 88 ; community data license agreement ; community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk ; 85 ; open government licence ; open government licence(?: v ?[123](?: 0)?)?
etalab ; 85 ; licence ouverte ; licence ouverte(?: open licence)?(?: etalab)?
dl-de-by ; 85 ; datenlizenz deutschland ; datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
cc0-1.0 ; 92 ; spdx license identifier ; spdx license identifier cc0 1 0
cc0-1.0 ; 88 ; cc0 1 0 ; cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0 ; 80 ; creative commons zero ; creative commons zero(?: v ?1 0)?(?: universal)?
cc-by-4.0 ; 90 ; cc by 4 0 ; cc by 4 0
cc-by-3.0 ; 90 ; cc by 3 0 ; cc by 3 0
cc-by-2.5 ; 90 ; cc by 2 5 ; cc by 2 5
cc-by-2.0 ; 90 ; cc by 2 0 ; cc by 2 0
cc-by-sa ; 85 ; cc by sa ; cc by sa
cc-by-sa-4.0 ; 95 ; cc by sa 4 0 ; cc by sa 4 0
cc-by-sa-3.0 ; 95 ; cc by sa 3 0 ; cc by sa 3 0
cc-by-nd ; 85 ; cc by nd ; cc by nd(?: [234] [05])?
cc-by-nc ; 85 ; cc by nc ; cc by nc(?: [234] [05])?
cc-by-nc-sa ; 92 ; cc by nc sa ; cc by nc sa(?: [234] [05])?
cc-by-nc-nd ; 92 ; cc by nc nd ; cc by nc nd(?: [234] [05])?
cc-attribution ; 80 ; creative commons attribution ; creative commons attribution(?: [234] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-attribution-sharealike ; 90 ; creative commons attribution ; creative commons attribution share ?alike(?: [234] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-attribution-noderivs ; 90 ; creative commons attribution ; creative commons attribution no ?deriv(?:ative)?s?(?: [234] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-attribution-noncommercial ; 90 ; creative commons attribution ; creative commons attribution non ?commercial(?: [234] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-attribution-noncommercial-sharealike ; 94 ; creative commons attribution ; creative commons attribution non ?commercial share ?alike(?: [234] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-attribution-noncommercial-noderivs ; 94 ; creative commons attribution ; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [234] [05])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-url ; 70 ; creativecommons org licenses ; (?:http|https) creativecommons org licenses (?:by|by sa|by nd|by nc|by nc sa|by nc nd)(?: [1234] [05])?
cc-url-zero ; 75 ; creativecommons org publicdomain ; (?:http|https) creativecommons org publicdomain (?:zero|mark) 1 0
cc-generic ; 40 ; creative commons license ; (?:under a |under the )?creative commons license
cc-spdx ; 92 ; spdx license identifier ; spdx license identifier cc by(?: nc)?(?: sa| nd)? [1234] [05]
openrail ; 85 ; openrail ; (?:creativeml |bigscience )?(?:bloom )?openrail m?(?: license)?
rail ; 85 ; responsible ai license ; responsible ai license
llama-community ; 85 ; llama ; llama [0-9 ]{0,4}community license agreement
gemma-terms ; 85 ; gemma terms of use ; gemma terms of use
all-rights-reserved ; 40 ; all rights reserved ; all rights reserved
proprietary ; 70 ; proprietary and confidential ; (?:is |are )?proprietary and confidential
proprietary ; 70 ; unauthorized copying of this file ; unauthorized copying of this file via any medium is strictly prohibited
proprietary ; 65 ; end user license agreement ; end user license agreement
proprietary ; 60 ; no part of this ; no part of this (?:publication|document|book|work) may be reproduced
copyright-notice ; 50 ; copyright ; copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
license-generic ; 30 ; licensed under the ; licensed under the (?:terms of the )?[a-z0-9]+(?: [a-z0-9]+)? license
license-generic ; 30 ; see the license file ; see the license file (?:for details|for more information)
license-generic ; 30 ; dual licensed ; dual licensed under (?:the )?[a-z0-9]+
"""

#: The contract's phrases and their labels (fixed values).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
BASE_PRIORITY = 40


def parsed() -> list[tuple[str, int, str, str]]:
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" ; ", 3))
        out.append((label, int(priority), keyword, pattern))
    return out

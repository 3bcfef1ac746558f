"""Signatures of licenses, written for texts cut to lower-case words with one space between them."""

# label | keyword, a word that every match of the expression holds | expression of the name
NAMES = r"""
0bsd | 0bsd | 0bsd
0bsd | bsd | zero clause bsd
0bsd | bsd | bsd zero clause
aal | attribution | attribution assurance license
afl-2.1 | academic | academic free license (?:version |v)?2 1
afl-3.0 | academic | academic free license (?:version |v)?3 0
agpl-1.0 | affero | affero general public license (?:version |v)?1
agpl-3.0 | affero | (?:gnu )?affero (?:general public license|gpl) (?:version |v)?3(?: 0)?
agpl-3.0 | agpl | (?:gnu )?agpl (?:version |v)?3(?: 0)?
agpl-3.0 | agplv3 | agplv3
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-2 | apache | apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?
apache-2 | apache | apache 2(?: 0)?(?: licen[cs]e)?
apsl-2.0 | apple | apple public source licen[cs]e(?: (?:version )?2 0)?
artistic-1.0 | artistic | artistic licen[cs]e (?:version )?1 0
artistic-2.0 | artistic | artistic licen[cs]e (?:version )?2(?: 0)?
beerware | beerware | beerware licen[cs]e
beerware | beer | beer ware licen[cs]e
bittorrent-1.1 | bittorrent | bittorrent open source licen[cs]e
blueoak-1.0.0 | blue | blue oak model licen[cs]e(?: 1 0 0)?
bsd-1-clause | bsd | bsd (?:1|one) clause
bsd-2-clause | bsd | bsd (?:2|two) clause|simplified bsd licen[cs]e|free bsd licen[cs]e
bsd-2-clause | freebsd | freebsd licen[cs]e
bsd-2-clause-patent | bsd | bsd (?:2|two) clause (?:plus )?patent
bsd-3-clause | bsd | bsd (?:3|three) clause|(?:new|modified|revised) bsd licen[cs]e
bsd-3-clause-clear | bsd | (?:bsd (?:3|three) clause clear|clear bsd licen[cs]e)
bsd-4-clause | bsd | bsd (?:4|four) clause|original bsd licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e(?: (?:version )?1 0)?
busl-1.1 | business | business source licen[cs]e(?: (?:version )?1 1)?
bzip2 | bzip2 | bzip2 licen[cs]e
caldera | caldera | caldera licen[cs]e
catosl-1.1 | catosl | catosl(?: 1 1)?
catosl-1.1 | associates | computer associates trusted open source licen[cs]e
cc-by | by | cc by(?! (?:nc|nd|sa))(?: [1-4] 0)?
cc-by | attribution | creative commons attribution(?! (?:non ?commercial|no ?deriv|share))
cc-by-nc | nc | cc by nc(?! (?:nd|sa))(?: [1-4] 0)?
cc-by-nc | attribution | creative commons attribution non ?commercial(?! (?:no ?deriv|share))
cc-by-nc-nd | nd | cc by nc nd(?: [1-4] 0)?
cc-by-nc-nd | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | sa | cc by nc sa(?: [1-4] 0)?
cc-by-nc-sa | attribution | creative commons attribution non ?commercial share ?alike
cc-by-nd | nd | cc by nd(?: [1-4] 0)?
cc-by-nd | attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa | sa | cc by sa(?: [1-4] 0)?
cc-by-sa | attribution | creative commons attribution share ?alike
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | commons | creative commons zero
cddl-1.0 | cddl | cddl(?: (?:version )?1 0)?
cddl-1.0 | distribution | common development and distribution licen[cs]e(?: (?:version )?1 0)?
cddl-1.1 | cddl | cddl (?:version )?1 1
cecill-2.1 | cecill | cecill(?: (?:version )?2 1)?
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
clartistic | clarified | clarified artistic licen[cs]e
cnri-python | cnri | cnri (?:open source )?(?:python )?licen[cs]e
cpal-1.0 | cpal | cpal(?: 1 0)?
cpal-1.0 | attribution | common public attribution licen[cs]e
cpl-1.0 | common | common public licen[cs]e(?: (?:version )?1 0)?
curl | curl | curl licen[cs]e
ecl-2.0 | educational | educational community licen[cs]e(?: (?:version )?2 0)?
efl-2.0 | eiffel | eiffel forum licen[cs]e(?: (?:version )?2)?
elastic-2.0 | elastic | elastic licen[cs]e(?: (?:version )?2 0)?
entessa | entessa | entessa public licen[cs]e
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version |v )?1 0
epl-2.0 | eclipse | eclipse public licen[cs]e (?:version |v )?2 0
eudatagrid | datagrid | eu datagrid software licen[cs]e
eupl-1.1 | eupl | eupl (?:version |v )?1 1
eupl-1.2 | eupl | eupl (?:version |v )?1 2
eupl-1.2 | european | european union public licen[cs]e(?: (?:version )?1 2)?
fair | fair | fair licen[cs]e
frameworx-1.0 | frameworx | frameworx open licen[cs]e
fsfap | fsf | fsf all permissive licen[cs]e
ftl | freetype | freetype (?:project )?licen[cs]e
gfdl-1.1 | documentation | (?:gnu )?free documentation licen[cs]e (?:version )?1 1
gfdl-1.2 | documentation | (?:gnu )?free documentation licen[cs]e (?:version )?1 2
gfdl-1.3 | documentation | (?:gnu )?free documentation licen[cs]e(?: (?:version )?1 3)?
gpl | general | (?:gnu )?general public licen[cs]e
gpl-1.0 | gpl | gpl (?:version |v)?1(?: 0)?
gpl-2.0 | gpl | gpl (?:version |v)?2(?: 0)?
gpl-2.0 | gplv2 | gplv2
gpl-2.0 | general | (?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?
gpl-3.0 | gpl | gpl (?:version |v)?3(?: 0)?
gpl-3.0 | gplv3 | gplv3
gpl-3.0 | general | (?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?
hippocratic-2.1 | hippocratic | hippocratic licen[cs]e
hpnd | historical | historical permission notice and disclaimer
icu | icu | icu licen[cs]e
ijg | jpeg | independent jpeg group licen[cs]e
imagemagick | imagemagick | imagemagick licen[cs]e
info-zip | zip | info zip licen[cs]e
intel | intel | intel open source licen[cs]e
ipa | ipa | ipa font licen[cs]e
ipl-1.0 | ibm | ibm public licen[cs]e(?: (?:version )?1 0)?
isc | isc | isc licen[cs]e
jasper-2.0 | jasper | jasper licen[cs]e
json | json | json licen[cs]e
latex2e | latex2e | latex2e licen[cs]e
lgpl | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | library | (?:gnu )?library general public licen[cs]e
lgpl-2.0 | library | (?:gnu )?library general public licen[cs]e (?:version |v)?2(?: 0)?
lgpl-2.1 | lgpl | lgpl (?:version |v)?2 1
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1
lgpl-3.0 | lgpl | lgpl (?:version |v)?3(?: 0)?
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?
libpng | libpng | libpng licen[cs]e
liliq-p-1.1 | liliq | liliq p 1 1
lpl-1.02 | lucent | lucent public licen[cs]e
lppl-1.3c | latex | latex project public licen[cs]e
miros | miros | miros licen[cs]e
mit | mit | (?:the )?mit(?: x11)? licen[cs]e|licen[cs]e mit
mit | expat | expat licen[cs]e
mit-0 | mit | mit no attribution|mit 0 licen[cs]e
motosoto | motosoto | motosoto open source licen[cs]e
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:version |v )?1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v )?1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: (?:version |v )?2 0)?
mpl-2.0 | mpl | mpl (?:version |v )?2 0
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
mulanpsl-2.0 | mulan | mulan (?:permissive software licen[cs]e|psl)
multics | multics | multics licen[cs]e
nasa-1.3 | nasa | nasa open source agreement
naumen | naumen | naumen public licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e
ngpl | nethack | nethack general public licen[cs]e
nokia | nokia | nokia open source licen[cs]e
npl-1.1 | netscape | netscape public licen[cs]e
nposl-3.0 | profit | non profit open software licen[cs]e
ntp | ntp | ntp licen[cs]e
oclc-2.0 | oclc | oclc research public licen[cs]e
odbl-1.0 | database | open (?:data commons )?(?:open )?database licen[cs]e
odc-by-1.0 | odc | odc by
odc-by-1.0 | attribution | open data commons attribution licen[cs]e
ofl-1.1 | font | (?:sil )?open font licen[cs]e(?: (?:version )?1 1)?
ogl-uk-3.0 | government | open government licen[cs]e
oldap-2.8 | openldap | openldap public licen[cs]e
openssl | openssl | openssl licen[cs]e
osl-2.1 | open | open software licen[cs]e (?:version )?2 1
osl-3.0 | open | open software licen[cs]e(?: (?:version )?3 0)?
parity-7.0.0 | parity | parity public licen[cs]e
pddl-1.0 | dedication | public domain dedication and licen[cs]e
php-3.01 | php | php licen[cs]e(?: (?:version )?3 01)?
polyform-noncommercial | polyform | polyform non ?commercial licen[cs]e
polyform-small-business | polyform | polyform small business licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
psf-2.0 | python | python software foundation licen[cs]e
psf-2.0 | psf | psf licen[cs]e
public-domain | domain | (?:in|into|to) the public domain
qpl-1.0 | q | q public licen[cs]e
qpl-1.0 | qt | qt public licen[cs]e
rpl-1.5 | reciprocal | reciprocal public licen[cs]e
rpsl-1.0 | realnetworks | realnetworks public source licen[cs]e
ruby | ruby | ruby licen[cs]e
rscpl | ricoh | ricoh source code public licen[cs]e
sgi-b-2.0 | sgi | sgi free software licen[cs]e b
simpl-2.0 | simple | simple public licen[cs]e
sissl | sissl | sissl
sissl | sun | sun industry standards source licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
spl-1.0 | sun | sun public licen[cs]e
sspl-1.0 | sspl | sspl(?: (?:version )?1)?
sspl-1.0 | server | server side public licen[cs]e
tcl | tcl | tcl tk licen[cs]e
ucl-1.0 | upstream | upstream compatibility licen[cs]e
unicode-3.0 | unicode | unicode licen[cs]e(?: v3)?
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | permissive | universal permissive licen[cs]e
vim | vim | vim licen[cs]e
vsl-1.0 | vovida | vovida software licen[cs]e
w3c | w3c | w3c software (?:notice and )?licen[cs]e
watcom-1.0 | watcom | sybase open watcom public licen[cs]e
wtfpl | wtfpl | wtfpl
x11 | x11 | x11 licen[cs]e
xnet | net | x net licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
zpl-2.1 | zope | zope public licen[cs]e(?: (?:version )?2 1)?
"""

# label | keyword, as above | expression of a passage from the license's own text, or of what people write in its place.
# One keyword is wanted elsewhere in the text: other licenses (ecl-2.0) say 'may not use this file' too, without apache.
PASSAGES = r"""
agpl-3.0 | remotely | interacting with it remotely through a computer network
apache-2 | apache | you may not use this file except in compliance with the license
apache-2 | basis | distributed on an as ?is basis without warranties or conditions of any kind
beerware | beer | you can buy me a beer in return
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-4-clause | acknowledgement | advertising materials mentioning features or use of this software must display the following acknowledgement
bsl-1.0 | machine | machine executable object code generated by a source language processor
cc0-1.0 | waived | has waived all copyright and related or neighboring rights
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0 | version | either version 2 of the license or at your option any later version
gpl-3.0 | version | either version 3 of the license or at your option any later version
isc | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
lgpl-2.1 | version | either version 2 1 of the license or at your option any later version
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license
proprietary | reserved | all rights reserved
proprietary | confidential | proprietary and confidential
proprietary | permission | may not be (?:copied|reproduced|used|distributed) without (?:the )?(?:prior |express |written )*permission
proprietary | consent | may not be (?:copied|reproduced|used|distributed) without (?:the )?(?:prior |express |written )*consent
proprietary | commercial | not (?:be used )?for commercial use
public-domain | unencumbered | free and unencumbered software released into the public domain
sspl-1.0 | service | making the functionality of the program available to third parties as a service
wtfpl | fuck | do what the fuck you want to
zlib | altered | altered source versions must be plainly marked as such
unknown-license | licensed | licensed under (?:a |the )?[^ ]+ licen[cs]e
unknown-license | details | see (?:the )?(?:accompanying |included )?licen[cs]e(?: file)? for details
"""

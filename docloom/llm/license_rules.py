"""Ordered signature rules for licence statements, over texts reduced to lower-case words.

A text reaches the rules as its words, each with one space before and after it, so "Apache License,
Version 2.0" reads " apache license version 2 0 ". A rule has a label, a literal gate that any text it
matches holds, a regular expression and a priority (smaller wins).
"""

from __future__ import annotations

from typing import NamedTuple

#: Literals of which every text that any rule matches holds one.
GATES = (
    "licen", "creativecommons", "cc by", "cc0", "copyright", "public domain", "rights reserved", "copyleft", "wtfpl", "bsd", "no attribution", "creative commons",
    "permission", "redistribut", "warrant", "free software", "patent", "promote products", "advertising materials", "object code", "misrepresented", "written agreement", "trademark", "sublicens", "gnu org", "as is", "adapted material", "share alike", "non commercial", "noncommercial",
)

#: Phrases that are searched in any case, with their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_L = "licen[cs]e"
#: Label, name as a pattern over words, literal of the name, identifiers as words. Where no one literal is
#: in all forms of a name, the forms are a tuple and have a literal each.
NAMES = (
    ("mit", rf"mit (?:x11 |expat )?{_L}", "mit", ("mit", "x11")),
    ("mit-0", rf"mit no attribution(?: {_L})?", "mit no attribution", ("mit 0",)),
    ("apache-2", rf"apache (?:software )?{_L}(?: v| version)? ?2(?: 0)?", "apache", ("apache 2 0", "apache2")),
    ("apache-1.1", rf"apache (?:software )?{_L}(?: version)? 1 1", "apache", ("apache 1 1",)),
    ("apache-1", rf"apache (?:software )?{_L}(?: version)? 1 0", "apache", ("apache 1 0",)),
    ("apache", rf"apache (?:software )?{_L}", "apache", ()),
    ("bsd-2", (rf"(?:2|two) clause bsd {_L}|bsd 2 clause(?: {_L})?", rf"(?:simplified|freebsd) (?:bsd )?{_L}"), ("bsd", "licen"), ("bsd 2 clause",)),
    ("bsd-3", rf"(?:3|three) clause bsd {_L}|(?:modified|new|revised) bsd {_L}|bsd 3 clause(?: {_L})?", "bsd", ("bsd 3 clause",)),
    ("bsd-4", rf"(?:4|four) clause bsd {_L}|original bsd {_L}|bsd 4 clause(?: {_L})?", "bsd", ("bsd 4 clause",)),
    ("bsd-0", rf"zero clause bsd(?: {_L})?|0bsd {_L}", "bsd", ("0bsd",)),
    ("bsd", rf"(?:berkeley software distribution|bsd)(?: style)? {_L}", "licen", ()),
    ("gpl-1", rf"gnu general public {_L}(?: v| version) ?1(?: 0)?|gpl ?v1 {_L}", "licen", ("gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later")),
    ("gpl-2", rf"gnu general public {_L}(?: v| version) ?2(?: 0)?(?: or (?:any )?later)?|gpl ?v2 {_L}", "licen", ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later")),
    ("gpl-3", rf"gnu general public {_L}(?: v| version) ?3(?: 0)?(?: or (?:any )?later)?|gpl ?v3 {_L}", "licen", ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    ("gpl", rf"gnu (?:general public {_L}|gpl {_L})|gpl {_L}", "licen", ()),
    ("lgpl-2", rf"gnu library general public {_L}(?:(?: v| version) ?2(?: 0)?)?", "gnu", ("lgpl 2 0", "lgpl 2 0 only")),
    ("lgpl-2.1", rf"gnu lesser general public {_L}(?: v| version) ?2 1", "gnu", ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later")),
    ("lgpl-3", rf"gnu lesser general public {_L}(?: v| version) ?3(?: 0)?", "gnu", ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
    ("lgpl", rf"(?:gnu lesser general public|lgpl) {_L}", "licen", ()),
    ("agpl-3", rf"gnu affero general public {_L}(?:(?: v| version) ?3(?: 0)?)?", "gnu", ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    ("gfdl-1.2", rf"gnu free documentation {_L}(?: v| version) ?1 2", "gnu", ("gfdl 1 2",)),
    ("gfdl-1.3", rf"gnu free documentation {_L}(?: v| version) ?1 3", "gnu", ("gfdl 1 3",)),
    ("gfdl", rf"gnu free documentation {_L}", "gnu", ()),
    ("mpl-1", rf"mozilla public {_L}(?: v| version)? ?1 0", "mozilla", ("mpl 1 0",)),
    ("mpl-1.1", rf"mozilla public {_L}(?: v| version)? ?1 1", "mozilla", ("mpl 1 1",)),
    ("mpl-2", rf"mozilla public {_L}(?:(?: v| version)? ?2(?: 0)?)?", "mozilla", ("mpl 2 0",)),
    ("epl-1", rf"eclipse public {_L}(?:(?: v| version)? ?1(?: 0)?)?", "eclipse", ("epl 1 0",)),
    ("epl-2", rf"eclipse public {_L}(?: v| version)? ?2(?: 0)?", "eclipse", ("epl 2 0",)),
    ("cddl-1", rf"common development and distribution {_L}", "common development", ("cddl 1 0",)),
    ("cpl-1", rf"common public {_L}(?: version)?(?: 1 0)?", "common public", ("cpl 1 0",)),
    ("eupl-1.2", rf"european union public {_L}", "european union", ("eupl 1 2",)),
    ("artistic-1", rf"artistic {_L}(?: version)? 1 0", "artistic", ("artistic 1 0",)),
    ("artistic-2", rf"artistic {_L}(?:(?: version)? 2 0)?", "artistic", ("artistic 2 0",)),
    ("isc", rf"isc {_L}", "isc", ("isc",)),
    ("zlib", rf"zlib(?: libpng)? {_L}", "zlib", ("zlib",)),
    ("libpng", rf"(?:libpng|png reference library) {_L}", "png", ("libpng 2 0",)),
    ("bsl-1", rf"boost software {_L}(?:(?: version)? 1 0)?", "boost", ("bsl 1 0",)),
    ("busl-1.1", rf"business source {_L}(?:(?: version)? 1 1)?", "business source", ("busl 1 1",)),
    ("sspl-1", rf"server side public {_L}", "server side", ("sspl 1 0",)),
    ("elastic-2", rf"elastic {_L}(?: 2 0)?", "elastic", ("elastic 2 0",)),
    ("unlicense", r"(?:the )?unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", (rf"wtfpl(?: {_L})?", rf"do what the fuck you want to public {_L}"), ("wtfpl", "do what the fuck"), ("wtfpl",)),
    ("psf", rf"python software foundation {_L}(?: version 2)?|psf {_L}", "licen", ("psf 2 0", "python 2 0")),
    ("postgresql", rf"postgresql {_L}", "postgresql", ("postgresql",)),
    ("php-3", rf"php {_L}(?: version 3 0 1?)?", "php", ("php 3 0", "php 3 01")),
    ("ruby", rf"ruby {_L}", "ruby", ("ruby",)),
    ("openssl", rf"openssl {_L}", "openssl", ("openssl",)),
    ("ofl-1.1", rf"(?:sil )?open font {_L}", "open font", ("ofl 1 1",)),
    ("ms-pl", rf"microsoft public {_L}", "microsoft", ("ms pl",)),
    ("ms-rl", rf"microsoft reciprocal {_L}", "microsoft", ("ms rl",)),
    ("ncsa", rf"(?:university of illinois ncsa|ncsa) (?:open source )?{_L}", "ncsa", ("ncsa",)),
    ("afl-3", rf"academic free {_L}(?: version)?(?: 3 0)?", "academic free", ("afl 3 0",)),
    ("osl-3", rf"open software {_L}(?: version)?(?: 3 0)?", "open software", ("osl 3 0",)),
    ("upl-1", rf"universal permissive {_L}", "universal permissive", ("upl 1 0",)),
    ("apsl-2", rf"apple public source {_L}", "apple", ("apsl 2 0",)),
    ("ipl-1", rf"ibm public {_L}", "ibm", ("ipl 1 0",)),
    ("qpl-1", rf"q public {_L}", " q public", ("qpl 1 0",)),
    ("vim", rf"vim {_L}", "vim", ("vim",)),
    ("tcl", rf"tcl(?: tk)? {_L}", "tcl", ("tcl",)),
    ("curl", rf"curl {_L}", "curl", ("curl",)),
    ("blueoak-1", rf"blue oak model {_L}", "blue oak", ("blueoak 1 0 0",)),
    ("cecill-2.1", rf"cecill(?: free software)? {_L}(?: agreement)?", "cecill", ("cecill 2 1",)),
    ("mulan-2", rf"mulan (?:permissive software|psl) {_L}?", "mulan", ("mulanpsl 2 0",)),
    ("odbl-1", rf"open (?:data commons open )?database {_L}", "database", ("odbl 1 0",)),
    ("odc-by-1", rf"open data commons attribution {_L}", "open data commons", ("odc by 1 0",)),
    ("pddl-1", rf"public domain dedication and {_L}", "public domain", ("pddl 1 0",)),
    ("cc0-1", (rf"cc0(?: 1 0)?(?: universal)?(?: {_L})?", rf"creative commons zero {_L}"), ("cc0", "creative commons zero"), ("cc0 1 0",)),
    ("llama", rf"llama (?:2 |3 )?community {_L}(?: agreement)?", "llama", ("llama2", "llama3")),
    ("openrail-m", rf"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)? {_L}", "rail", ("openrail m", "bigscience openrail m")),
    ("proprietary", rf"proprietary (?:software )?{_L}|proprietary and confidential copyright", "propriet", ("proprietary",)),
)

#: Creative Commons: elements as words, label, name as words.
_CC = (
    ("by", "cc-by", "attribution"),
    ("by sa", "cc-by-sa", "attribution share ?alike"),
    ("by nd", "cc-by-nd", "attribution no ?deriv(?:ative)?s"),
    ("by nc", "cc-by-nc", "attribution non ?commercial"),
    ("by nc sa", "cc-by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)

#: Statements that name no licence.
_STATEMENTS = (
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
    ("public-domain", "(?:released into|dedicated to|placed in|in|part of) the public domain", "public domain"),
    ("copyright-notice", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
    ("copyleft", "copyleft", "copyleft"),
    ("no-license", rf"no {_L} (?:is )?granted|without a {_L}|unlicensed", "licen"),
    ("permission-notice", rf"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?.{{0,200}}? copyright notice", "copyright"),
    ("redistribution-notice", "redistributions of source code must retain the above copyright notice", "copyright"),
    ("license-file", rf"see (?:the )?(?:file )?{_L}(?: file| txt| md)?(?: in the project root)? for (?:more )?(?:details|information)", "licen"),
    ("dual-license", rf"dual {_L}d|either {_L} at your option|tri {_L}d", "licen"),
    ("commercial-license", rf"commercial {_L}(?: agreement)?", "commercial licen"),
    ("end-user-license", rf"end user {_L} agreement|eula {_L}", "licen"),
)

#: Sentences of the licences themselves, headers of files and addresses of texts: label, gate, pattern.
SIGNATURES = (
    # Permissive texts.
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice shall be included", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "warranties of merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit", "opensource org license", "opensource org licenses? mit(?: license(?: php)?)?"),
    ("mit", "mit license", "(?:the )?mit license copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("mit", "as expat", "(?:known|referred to) as (?:the )?expat licen[cs]e"),
    ("x11", "x consortium", "x consortium shall not be used in advertising (?:.{0,160}? )?permission"),
    ("mit-0", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:.{0,300}? )?without restriction (?:.{0,200}? )?and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice)?"),
    ("isc", "the software is provided as is and", "the software is provided as is and (?:the author|isc|internet systems consortium)(?: inc)? disclaims all warranties with regard to this software"),
    ("bsd-0", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-2", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-2", "views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors (?:.{0,120}? )?freebsd project"),
    ("bsd-3", "endorse or promote products", "neither the name (?:of )?.{1,160}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3", "the name of the author may not be used", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clear", "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-no-nuclear", "not designed licensed or intended", "not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-4", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "this software is provided by the", "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd", "bsd style license that can be found", "governed by a bsd style license that can be found in the license file"),
    ("bsd", "opensource org licenses bsd", "opensource org licenses bsd(?: (?:2|3) clause| license(?: php)?)?"),
    ("apache-2", "you may not use this file except in compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "distributed under the license is distributed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "apache org licenses", "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2", "patent litigation against any entity", "if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit"),
    ("apache-2-llvm", "with llvm exception", "apache license(?: v| version)? ?2 0 with llvm exceptions?"),
    ("apache-1.1", "this product includes software developed by the apache", "this product includes software developed by the apache software foundation (?:.{0,40}? )?redistributions? (?:.{0,400}? )?apache and apache software foundation must not be used"),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("bsl-1", "machine executable object code", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsl-1", "boost org license", "(?:see accompanying file license 1 0 txt or copy at (?:http )?)?(?:www )?boost org license 1 0 txt"),
    ("curl", "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", "without a written agreement is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "names of its contributors may be used to endorse", "neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("hpnd", "permission to use copy modify", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee"),
    ("ntp", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "free to copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software (?:.{0,200}? )?public domain"),
    ("unlicense", "unlicense org", "(?:for more information please refer to (?:http )?)?unlicense org(?: licen[cs]e)?"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("beerware", "beer ware license", "the beer ware license(?: revision [0-9]+)?"),
    ("psf", "as is basis", "psf is making python available to licensee on an as is basis"),
    ("php-3", "this product includes php software", "this product includes php software freely available from (?:.{0,30}? )?warrant"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit (?:.{0,80}? )?permission"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young (?:.{0,60}? )?redistribut"),
    ("icu", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("unicode", "unicode inc", "copyright (?:.{0,40}? )?unicode inc all rights reserved distributed under the terms of use"),
    ("json", "used for good not evil", "the software shall be used for good not evil (?:.{0,40}? )?as is"),
    ("afl-3", "academic free license", "licensed under the academic free license version 3 0"),
    ("ofl-1.1", "this font software is licensed", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "scripts sil org ofl", "this license is (?:copied below and is )?also available with a faq at (?:http )?scripts sil org ofl"),
    # Copyleft texts and headers.
    ("gpl-2", "free software foundation", "free software foundation either version 2 of the license or at your option any later version|gnu general public license as published by the free software foundation version 2"),
    ("gpl-3", "gnu general public license", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", "version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-1", "version 1 february 1989", "gnu general public license version 1 february 1989"),
    ("gpl", "terms of the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu org licenses gpl", "(?:www )?gnu org licenses (?:old licenses )?gpl(?: [23] 0)?(?: html| txt)?"),
    ("gpl", "gnu org copyleft gpl", "(?:www )?gnu org copyleft gpl(?: html)?"),
    ("gpl-classpath", "classpath exception", "gnu general public license (?:.{0,40}? )?with (?:the )?classpath exception"),
    ("lgpl-2.1", "lesser general public license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2.1", "version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "lesser general public license", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2", "library general public license", "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "gnu org licenses lgpl", "(?:www )?gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl-3", "gnu affero general public license", "gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", "version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "gnu org licenses agpl", "(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "gnu org licenses fdl", "(?:www )?gnu org licenses fdl(?: 1 [123])?(?: html| txt)?"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("mpl-1.1", "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "this source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses"),
    ("mpl-2", "mozilla org mpl", "if a copy of the mpl was not distributed with this file .{0,60}?mozilla org mpl 2 0 .{0,20}?license|mozilla org (?:en us )?mpl 2 0 license"),
    ("npl-1.1", "netscape public license", "the contents of this file are subject to the netscape public license version 1 [01]"),
    ("epl-1", "eclipse org legal epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 (?:.{0,80}? )?eclipse org legal epl v10"),
    ("epl-2", "eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1", "common development and distribution license", "subject to the terms of (?:the|either the gnu general public license version 2 only (?:.{0,20}? )?or the) common development and distribution license"),
    ("cpl-1", "common public license", "made available under the terms of the common public license v1 0"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: v(?:ersion)?)? ?1 [12]"),
    ("osl-3", "open software license", "licensed under the open software license version 3 0"),
    ("sspl-1", "server side public license", "server side public license version 1 as published by mongodb"),
    ("cecill-2.1", "cecill", "this software is governed by the cecill(?: [abc])? license under french law"),
    ("artistic-2", "perl itself", "you can redistribute it and or modify it under the same terms as perl itself (?:.{0,120}? )?licen|free software (?:.{0,80}? )?same terms as perl itself"),
    ("artistic-1", "the artistic license preamble", "the artistic license preamble the intent of this document is to state the conditions"),
    ("qpl-1", "q public license", "the q public license version 1 0"),
    ("ms-pl", "microsoft public license", "microsoft public license ms pl this license governs use of the accompanying software"),
    ("busl-1.1", "business source license", "business source license is not an open source license"),
    ("elastic-2", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service (?:.{0,200}? )?license"),
    ("commons-clause", "commons clause", "commons clause license condition v1 0"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-small-business", "polyform", "polyform small business license(?: 1 0 0)?"),
    # Creative Commons and data.
    ("cc-by", "licenses by 4 0", "creativecommons org licenses by 4 0(?: legalcode| deed)?(?: [a-z]{2})?"),
    ("cc-by-sa", "licenses by sa", "creativecommons org licenses by sa [1-4] [05](?: legalcode| deed)?(?: [a-z]{2})?"),
    ("cc-by-nc", "licenses by nc", "creativecommons org licenses by nc [1-4] [05](?: legalcode| deed)?(?: [a-z]{2})?"),
    ("cc-by-nd", "licenses by nd", "creativecommons org licenses by nd [1-4] [05](?: legalcode| deed)?(?: [a-z]{2})?"),
    ("cc-by-nc-sa", "licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05](?: legalcode| deed)?(?: [a-z]{2})?"),
    ("cc-by-nc-nd", "licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05](?: legalcode| deed)?(?: [a-z]{2})?"),
    ("cc0-1", "publicdomain zero", "creativecommons org publicdomain zero 1 0(?: legalcode| deed)?"),
    ("cc-pdm", "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc0-1", "waived all copyright", "to the extent possible under law .{1,120}? waived all copyright and related or neighbou?ring rights"),
    ("cc-by-sa", "distribute your contributions under the same license", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "may not distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material (?:.{0,120}? )?licen"),
    ("cc-by-nc", "may not use the material for commercial purposes", "you may not use the material for commercial purposes (?:.{0,200}? )?licen|licen.{0,200}? you may not use the material for commercial purposes"),
    ("cc-sampling-plus", "sampling plus", "creative commons sampling plus(?: 1 0)?(?: licen[cs]e)?"),
    ("odbl-1", "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1", "opendatacommons org licenses by", "opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", "opendatacommons org licenses pddl", "opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-uk-3", "open government licen", "(?:contains public sector information licensed under the )?open government licen[cs]e v(?:ersion )?3 0"),
    ("ogl-uk", "open government licen", "open government licen[cs]e(?: for public sector information)?"),
    ("cdla-permissive", "community data license", "community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", "community data license", "community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("etalab-2", "licence ouverte", "licence ouverte(?: open licence)?(?: (?:version )?2 0)?"),
    ("dl-de-by", "datenlizenz deutschland", "licen[cs]e datenlizenz deutschland namensnennung(?: version)?(?: [12] 0)?"),
    # Models.
    ("llama", "community license agreement", "(?:meta )?llama [234](?: [0-9])? community license agreement"),
    ("llama", "is licensed under the", "llama [234](?: [0-9])? is licensed under the llama [234](?: [0-9])? community license copyright meta platforms"),
    ("gemma", "gemma license", "gemma license(?: agreement)?"),
    ("openrail-m", "use based restrictions", "use based restrictions as referenced in paragraph 5 (?:.{0,200}? )?licen|openrail (?:.{0,60}? )?use based restrictions (?:.{0,120}? )?licen"),
    # Rights that are kept.
    ("proprietary", "unauthorized copying", "unauthorized copying (?:of this file )?via any medium is strictly prohibited(?: proprietary and confidential)? (?:.{0,120}? )?copyright|copyright (?:.{0,200}? )?unauthorized copying of this file"),
    ("proprietary", "without the prior written permission", "no part of this (?:publication|document|work|book) may be reproduced (?:.{0,200}? )?without the prior written permission"),
    ("proprietary", "express written permission", "(?:reproduction|redistribution|use) (?:.{0,60}? )?without (?:the )?express written permission (?:.{0,60}? )?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "contains ", "contains (?:confidential and proprietary information|trade secrets?) (?:.{0,160}? )?licen"),
    ("all-rights-reserved", "rights reserved", "copyright (?:c )?(?:(?:19|20)[0-9]{2} )?(?:.{0,60}? )?all rights reserved"),
    ("fair-use", "fair use", "(?:constitutes|under|considered) (?:a )?fair use (?:.{0,80}? )?copyright(?:ed)?|copyrighted material (?:.{0,160}? )?fair use"),
    ("us-government-work", "united states government", "work of the united states government (?:.{0,120}? )?(?:public domain|not subject to copyright)"),
    ("crown-copyright", "crown copyright", "(?:c )?crown copyright(?: (?:19|20)[0-9]{2})?"),
    ("non-commercial", "non commercial", "for (?:personal|private|academic|research)(?: (?:and|or) (?:educational|non commercial|academic|research))? non commercial use only"),
    ("educational", "educational purposes", "permission (?:.{0,60}? )?for educational purposes(?: only)?|licensed for educational purposes(?: only)?"),
)

_VERB = rf"(?:{_L}d|released|distributed|available|published|provided|made available|offered|covered|shared) under (?:the )?(?:terms of (?:the )?)?"


class Rule(NamedTuple):
    label: str
    gate: str
    regex: str
    priority: int
    confidence: float


def _rule(label: str, gate: str, pattern: str, priority: int, confidence: float) -> Rule:
    return Rule(label, gate, rf"(?<= )(?:{pattern})(?= )", priority, confidence)


def rules() -> list[Rule]:
    """All rules in order: sentences of the licences, then identifiers, phrases and names, exact before generic."""
    out = [_rule(label, gate, pattern, order, 0.95) for order, (label, gate, pattern) in enumerate(SIGNATURES)]
    for order, (label, name, literal, ids) in enumerate(NAMES):
        for i in ids:
            out.append(_rule(label, f"identifier {i}", f"spdx license identifier {i}", 1000 + order, 1.0))
            out.append(_rule(label, f"licenses {i}", f"(?:opensource|spdx|choosealicense) (?:org|com) licenses {i}", 1200 + order, 0.95))
        for form, gate in [(name, literal)] if isinstance(name, str) else zip(name, literal, strict=True):
            out.append(_rule(label, gate, f"{_VERB}(?:{form})", 1300 + order, 0.9))
            out.append(_rule(label, gate, f"{_L} (?:is )?(?:the )?(?:{form})", 1400 + order, 0.85))
            out.append(_rule(label, gate, form, 1500 + order, 0.75))
    for order, (words, label, name) in enumerate(_CC):
        end = "" if words in ("by nc sa", "by nc nd") else "(?! (?:sa|nd))" if words == "by nc" else "(?! (?:sa|nd|nc))"
        out.append(_rule(label, "identifier cc", f"spdx license identifier cc {words}{end}(?: [1-4] [05])?", 1000 + order, 1.0))
        out.append(_rule(label, "creativecommons", f"creativecommons org licenses {words}{end}(?: [1-4] [05])?", 1200 + order, 0.95))
        out.append(_rule(label, f"cc {words}", f"{_VERB}cc {words}{end}(?: [1-4] [05])?", 1300 + order, 0.9))
        out.append(_rule(label, "creative commons", f"{_VERB}(?:a )?creative commons {name}(?: [1-4] [05])?(?: international| unported)?(?: {_L})?", 1390 + order, 0.9))
        out.append(_rule(label, f"cc {words}", f"cc {words}{end}(?: [1-4] [05])?(?: {_L})?", 1500 + order, 0.75))
        out.append(_rule(label, "creative commons", f"creative commons {name}(?: [1-4] [05])?(?: international| unported)? {_L}", 1590 + order, 0.8))
    for order, (label, pattern, gate) in enumerate(_STATEMENTS):
        out.append(_rule(label, gate, pattern, 1600 + order, 0.6))
    return out

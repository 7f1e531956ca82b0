"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, with_fields

#: Phrases whose places are always reported, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Licenses: label, keyword that a text must hold, pattern of the name. Texts are matched as their
#: lower-cased words with one space between, so "GPL-3.0" reads "gpl 3 0". More specific names come first.
NAMES = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: agpl)?(?: v(?:ersion)? ?3(?: 0)?| 3(?: 0)?)"),
    ("agpl-1.0", "affero", r"(?:gnu )?affero general public license(?: v(?:ersion)? ?1(?: 0)?| 1(?: 0)?)"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl", "agpl", r"agpl"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public license(?: v(?:ersion)? ?2(?: 0)?| 2(?: 0)?)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license(?: lgpl)?(?: v(?:ersion)? ?2 1| 2 1)"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license(?: lgpl)?(?: v(?:ersion)? ?3(?: 0)?| 3(?: 0)?)"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", "lgpl", r"lgpl ?v?2(?: 0)(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl", r"lgpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license(?: v(?:ersion)? ?1 [123]| 1 [123])?"),
    ("gfdl", "gfdl", r"gfdl(?: v?1 [123])?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license(?: gpl)?(?: v(?:ersion)? ?1(?: 0)?| 1 0)"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: gpl)?(?: v(?:ersion)? ?2(?: 0)?| 2 0)"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: gpl)?(?: v(?:ersion)? ?3(?: 0)?| 3 0)"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-1.0", "gpl", r"gpl ?v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e(?: eupl)? v?(?:ersion)? ?1 1"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e(?: eupl)? v?(?:ersion)? ?1 2"),
    ("eupl", "european union public", r"european union public licen[cs]e"),
    ("eupl", "eupl", r"eupl(?: v?1 [012])?"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: v(?:ersion)?)? ?1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: v(?:ersion)?)? ?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache ?v?2(?: 0)?(?: licen[cs]ed?)?"),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0(?: txt)?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("mit-0", "mit 0", r"mit 0(?: license)?"),
    ("mit", "mit licen", r"mit licen[cs]e"),
    ("mit", "opensource", r"opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("mit-modern", "modern variant", r"mit license modern variant"),
    ("bsd-0-clause", "bsd", r"(?:zero clause bsd|bsd zero clause|0 ?bsd|bsd 0 clause)(?: licen[cs]e)?"),
    ("bsd-1-clause", "bsd", r"(?:bsd 1 clause|1 clause bsd|one clause bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("isc", "internet systems consortium", r"internet systems consortium licen[cs]e"),
    ("mpl-1.0", "mozilla public", r"mozilla public licen[cs]e(?: mpl)?(?: v(?:ersion)?)? ?1 0"),
    ("mpl-1.1", "mozilla public", r"mozilla public licen[cs]e(?: mpl)?(?: v(?:ersion)?)? ?1 1"),
    ("mpl-2.0", "mozilla public", r"mozilla public licen[cs]e(?: mpl)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e"),
    ("mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl ?v?1 1"),
    ("epl-1.0", "eclipse public", r"eclipse public licen[cs]e(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse public", r"eclipse public licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse distribution", r"eclipse distribution licen[cs]e(?: v?1 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: cddl)?(?: v(?:ersion)?)? ?1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e(?: cddl)?(?: v(?:ersion)?)? ?1 1"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("cddl", "cddl", r"cddl(?: v?1 [01])?"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: osl)?(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("osl", "open software", r"open software licen[cs]e"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: afl)?(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("afl", "academic free", r"academic free licen[cs]e"),
    ("artistic-1.0", "intent of this document", r"artistic licen[cs]e(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("artistic-2.0", "given free software package", r"artistic licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: v(?:ersion)?)?(?: ?1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: v?(?:ersion)? ?1 1)?"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e(?: v(?:ersion)?)?(?: ?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: v(?:ersion)?)?(?: ?2)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v?2)?"),
    ("wtfpl", "what the", r"do what the \S+ you want to public licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication(?: and licen[cs]e)?"),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: odbl)?(?: v?1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: v?1 0)?"),
    ("python-2.0", "python", r"python software foundation licen[cs]e(?: v?(?:ersion)? ?2)?"),
    ("psf-2.0", "psf", r"psf licen[cs]e(?: v?2)?"),
    ("php-3.01", "php", r"php licen[cs]e(?: v(?:ersion)?)?(?: ?3 ?0?1?)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e(?: v?(?:ersion)? ?2(?: 0)?)?"),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: v?(?:ersion)? ?1 0)?"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: v?(?:ersion)? ?1 1)?"),
    ("lppl-1.3c", "latex project", r"latex project public licen[cs]e(?: v?(?:ersion)? ?1 3c?)?"),
    ("cecill-2.1", "cecill", r"cecill(?: v?2 1| free software licen[cs]e agreement)?"),
    ("mulan-2.0", "mulan", r"mulan permissive software licen[cs]e(?: v?(?:ersion)? ?2)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: v?(?:ersion)? ?1 0)?"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("json", "json", r"json licen[cs]e"),
    ("beerware", "beer", r"beer ?ware licen[cs]e"),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
)
#: Creative Commons: code, words of the long name.
COMMONS = (
    ("by nc nd", r"attribution non ?commercial no deriv(?:ative)?s?(?: works)?"), ("by nc sa", r"attribution non ?commercial share ?alike"),
    ("by nc", r"attribution non ?commercial"), ("by nd", r"attribution no deriv(?:ative)?s?(?: works)?"), ("by sa", r"attribution share ?alike"), ("by", r"attribution"),
)
#: Sentences of license texts: label, keyword, pattern.
CLAUSES = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "without restriction", r"to deal in the software without restriction"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of (?:\S+ ){1,60}?may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "either version", r"either version [123] of the license or at your option any later version"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("warranty-disclaimer", "without warranty", r"without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", "as is", r"(?:software|work|data) is provided as is"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "publish distribute", r"the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "dealings in the software", r"out of or in connection with the software or the use or other dealings in the software"),
    ("mit-modern-variant", "without written agreement", r"permission is hereby granted without written agreement and without licen[cs]e or royalty fees"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("bsd", "source code must retain", r"redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", "regents", r"this software is provided by the regents and contributors as is"),
    ("bsd", "substitute goods", r"procurement of substitute goods or services loss of use data or profits"),
    ("bsd-3-clause", "specific prior written permission", r"endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", "patent rights are granted", r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e"),
    ("bsd-4-clause", "acknowledgement", r"must display the following acknowledgement this product includes software developed by"),
    ("bsd-2-clause-patent", "hereby grants to those", r"each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual worldwide"),
    ("isc", "permission notice appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee"),
    ("hpnd", "supporting documentation", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("ntp", "with or without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee"),
    ("zlib", "held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "removed or altered", r"this notice may not be removed or altered from any source distribution"),
    ("libpng-2.0", "png reference library", r"the png reference library is supplied as is"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "limitations under the license", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "notice text file", r"if the work includes a notice text file as part of its distribution"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "free software you can", r"is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", "franklin street", r"free software foundation inc 51 franklin st(?:reet)?"),
    ("gpl", "temple place", r"free software foundation inc 59 temple place"),
    ("gpl", "gnu org licenses", r"(?:see )?(?:http|https) www gnu org licenses"),
    ("gpl-2.0", "version 2", r"as published by the free software foundation (?:either )?version 2(?: of the license)?"),
    ("gpl-3.0", "version 3", r"as published by the free software foundation (?:either )?version 3(?: of the license)?"),
    ("gpl-2.0", "gnu general public license version 2", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3", r"gnu general public license version 3 29 june 2007"),
    ("gpl", "freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "technological measure", r"no covered work shall be deemed part of an effective technological measure"),
    ("gpl-classpath-exception", "classpath", r"(?:with|gnu) (?:the )?classpath exception"),
    ("gpl-classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-gcc-exception", "gcc runtime", r"gcc runtime library exception"),
    ("gpl-autoconf-exception", "autoconf", r"(?:generated by|output of) autoconf (?:\S+ ){0,20}?distribute (?:it|that file) under the same distribution terms"),
    ("gpl-bison-exception", "bison parser skeleton", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu library general public licen[cs]e"),
    ("lgpl-2.1", "gnu lesser general public license version 2", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu lesser general public license version 3", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl", "uses the library", r"a work that uses the library"),
    ("agpl", "you should have received", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl-3.0", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("agpl-3.0", "corresponding source", r"an opportunity to receive the corresponding source of your version"),
    ("gfdl", "copy distribute and or modify", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", "invariant sections", r"with no invariant sections(?: no)? front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla org mpl", r"you can obtain one at (?:http|https) mozilla org mpl 2 0"),
    ("mpl-2.0", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license"),
    ("cddl-1.0", "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("epl-1.0", "eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1.0", "eclipse public license v1", r"made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse public license 2", r"made available under the terms of the eclipse public license 2 0"),
    ("ipl-1.0", "ibm public license", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl (?:version )?\d \d"),
    ("artistic-1.0", "intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "given free software package", r"this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("perl", "under the same terms as", r"under the same terms as (?:the )?perl(?: \d)?(?: programming language system)? itself"),
    ("ruby", "2 clause bsdl", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("python-2.0", "making python available", r"psf is making python available to licensee on an as is basis"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:\S+ ){0,6}?the freetype project"),
    ("icu", "notice s and this permission", r"provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("unicode", "data files or software", r"to deal in the data files or software without restriction"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved font name", r"with reserved font name"),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream"),
    ("lppl", "latex project public", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("wtfpl", "distribute verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "dedicate any and all copyright", r"dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc-by", "creative commons", r"this work is licensed under a creative commons attribution(?: \d \d)?(?: international| unported)? licen[cs]e"),
    ("cc-by-sa", "same or similar", r"you may distribute the resulting work only under the same or similar licen[cs]e"),
    ("cc-by-nc", "commercial", r"you may not use (?:the|this) (?:material|work) for commercial purposes"),
    ("cc-by-nd", "transform or build upon", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("odbl-1.0", "under the open database", r"made available under the open database licen[cs]e"),
    ("pddl-1.0", "public domain dedication", r"made available under the public domain dedication and licen[cs]e"),
    ("boost", "obtaining a copy of the software and accompanying documentation", r"obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("bsl-1.0", "boost org", r"(?:http|https) www boost org license 1 0 txt"),
    ("ms-pl", "you accept this", r"if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software"),
    ("upl-1.0", "larger work", r"each a larger work to which the software is contributed"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: v?1 1)?"),
    ("busl-1.1", "change date", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e(?: v?(?:ersion)? ?1)?"),
    ("sspl-1.0", "service source code", r"you must make the service source code available via network download"),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e(?: v?2 0| 2 0)?"),
    ("commons-clause", "commons clause", r"commons clause licen[cs]e condition(?: v1 0)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("public-domain", "public domain", r"(?:this|the) (?:work|software|file|code|program) is (?:hereby )?(?:in|placed in|released to|dedicated to) the public domain"),
    ("public-domain", "united states government", r"(?:is )?a work of the (?:united states|u s) government(?: and is not subject to copyright)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?"),
    ("llama-community", "llama", r"llama \d(?: \d)? community licen[cs]e(?: agreement)?"),
    ("rail-restrictions", "use based restrictions", r"use based restrictions as referenced in paragraph \d+"),
    ("research-only", "research purposes", r"for (?:non commercial )?(?:academic )?research purposes only"),
    ("non-commercial", "non commercial use", r"for non commercial use only"),
    ("internal-use", "internal use only", r"for internal use only(?: not for (?:re)?distribution)?"),
    ("proprietary", "confidential", r"confidential and proprietary (?:information|material)"),
    ("proprietary", "strictly prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this \S+)?(?: via any medium)? is strictly prohibited"),
    ("proprietary", "no part of this", r"no part of this (?:publication|document|work|book) may be reproduced"),
    ("proprietary", "trade secret", r"contains (?:the )?(?:valuable )?trade secrets (?:and|or) (?:proprietary|confidential) information"),
    ("eula", "end user licen", r"end user licen[cs]e agreement"),
    ("eula", "reverse engineer", r"you may not (?:\S+ ){0,6}?reverse engineer decompile or disassemble"),
    ("warranty-disclaimer", "implied warranties", r"disclaims? all (?:express or )?implied warranties"),
    ("warranty-disclaimer", "no warranty", r"there is no warranty for the program to the extent permitted by applicable law"),
    ("liability-disclaimer", "consequential damages", r"for any direct indirect incidental special exemplary or consequential damages"),
    ("liability-disclaimer", "liable", r"in no event shall the (?:authors?|copyright holders?|copyright owners?)(?: or (?:contributors|copyright holders))? be liable"),
    ("patent-grant", "patent licen", r"(?:hereby )?grants? (?:to )?you (?:\S+ ){0,12}?patent licen[cs]e"),
    ("trademark", "does not grant", r"does not grant (?:any )?(?:permission|rights?) (?:to use|in) the trade ?(?:names|marks)"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
)
#: Ways to name a license: priority (the lowest wins), weight, pattern around the name.
FORMS = (
    (1, 0.95, r"spdx license identifier (?:%s)"),
    (2, 0.9, r"(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:\S+ ){0,2}?(?:under|by)(?: the terms)?(?: of)?(?: the| an?)? (?:%s)"),
    (4, 0.7, r"(?:%s)"),
)


def rules() -> list[tuple[int, float, str, str, str]]:
    """All rules in order: (priority, weight, label, keyword, pattern)."""
    names = [*NAMES]
    for code, name in COMMONS:
        label = "cc-" + code.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            v = version.replace(" ", ".")
            names += [(f"{label}-{v}", "cc by", f"cc {code} {version}"), (f"{label}-{v}", "creativecommons", f"creativecommons org licenses {code} {version}"), (f"{label}-{v}", "creative commons", f"creative commons {name} {version}")]
        names += [(label, "cc by", f"cc {code}"), (label, "creative commons", f"creative commons {name}(?: licen[cs]e)?")]
    out = [(priority, weight, label, keyword, form % pattern) for priority, weight, form in FORMS for label, keyword, pattern in names]
    out += [(3, 0.85, label, keyword, pattern) for label, keyword, pattern in CLAUSES]
    return sorted(out, key=lambda r: r[0])


class Scanner:
    """The rules, compiled once for each task."""

    def __init__(self, found=None):
        self.rules = [(p, w, label, re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])".encode())) for p, w, label, _, pattern in (found or rules())]
        by: dict[str, list[int]] = {}
        for i, r in enumerate(found or rules()):
            by.setdefault(r[3], []).append(i)
        self.keys = ahocorasick.Automaton()
        for key, ids in by.items():
            self.keys.add_word(key, ids)
        self.keys.make_automaton()
        self.base = [(label, re.compile(rb"(?<![^ ])%s(?![^ ])" % phrase.encode())) for phrase, label in BASE]

    def detections(self, normal: bytes) -> list[tuple[int, int, str, float]]:
        """(first byte, end byte, label, weight) of what rules find and no stronger detection contains."""
        ids = sorted({i for _, found in self.keys.iter(normal.decode("utf-8", "replace")) for i in found})
        found = []
        for i in ids:
            priority, weight, label, pattern = self.rules[i]
            found += [(priority, m.start() - m.end(), i, m.start(), m.end(), label, weight) for m in pattern.finditer(normal)]
        kept: list[tuple[int, int, str, float]] = []
        edge: list[tuple[int, int]] = []  # taken spans that no other taken span contains: their starts and ends both rise
        for _, _, _, start, end, label, weight in sorted(found):
            i = bisect_right(edge, (start, 1 << 62))
            if i and end <= edge[i - 1][1]:
                continue
            kept.append((start, end, label, weight))
            a = i - 1 if i and edge[i - 1][0] == start else i
            b = bisect_right(edge, end, lo=i, key=lambda x: x[1])
            edge[a:b] = [(start, end)]
        return sorted(kept)

    def scan(self, text: str | None) -> dict:
        """Words, places of the base phrases, detections (word spans) and labels of a text; a null text is empty."""
        words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z only
        normal = b" ".join(words)
        starts: list[int] = []

        def place(at: int) -> int:
            if not starts:
                starts.extend(accumulate((len(w) + 1 for w in words), initial=0))
            return bisect_right(starts, at) - 1

        base = [(place(m.start()), label) for label, pattern in self.base for m in pattern.finditer(normal)]
        spans = [(place(s), place(e - 1) + 1, label, weight) for s, e, label, weight in self.detections(normal)]
        base_labels = {label for _, label in base}
        miss = 1.0
        for weight in {label: w for _, _, label, w in sorted(spans, key=lambda x: x[3])}.values():
            miss *= 1 - weight
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min((p for p, _ in base), default=None), "last_word": max((p for p, _ in base), default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {x[2] for x in spans})), "score": max(1 - miss, 0.7 * bool(base)), "spans": spans,
        }


FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
SPAN = "array<struct<first:bigint,end:bigint,label:string,weight:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with FIELDS and spans: array of (first, end, label, weight), in words from 0, end exclusive.

    A keyword automaton reads each whole text once; only rules whose keyword it finds are matched.
    Detections are taken by priority, then length, then rule order; one that lies inside a taken one
    is suppressed. Base phrases are always counted. The score joins the weights of the distinct
    labels (1 minus the product of what each leaves open). Null and empty texts have no words, no
    places (null) and score 0; repeated rows are scanned each; columns of docs with these names are replaced.
    """
    docs = docs.drop(*FIELDS, "spans")
    from pyspark.sql.types import _parse_datatype_string

    schema = with_fields(docs.schema, **FIELDS).add("spans", _parse_datatype_string(SPAN))
    names = schema.names
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))

    def run(batches):
        scanner = Scanner()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                found = [scanner.scan(x.as_py()) for x in b.column(b.schema.get_field_index("text"))]
                new = [pa.array([f[c] for f in found], kinds[k]) for c, k in FIELDS.items()]
                spans = pa.array([[dict(zip(("first", "end", "label", "weight"), s)) for s in f["spans"]] for f in found], span)
                yield pa.RecordBatch.from_arrays([*b.columns, *new, spans], names=names)

    return docs.mapInArrow(run, schema)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License mentions of every row of ``documents``."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *FIELDS, F.size("spans").cast("long").alias("n_detections"))

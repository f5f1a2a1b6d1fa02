"""Signature sentences of licence texts and notices, written by hand one by one.

Fixed values: (label, keyword, pattern). A space in a pattern stands for any run of white space.
Texts are lower-cased before they are matched; every match holds its keyword (runs of white space
as one space).
"""

from __future__ import annotations

NOTICES = [
    # GNU licences: notices of files, preambles, clauses
    ("gpl", "free software; you can redistribute", r"this (?:program|file|package|code) is free software; you can redistribute it and/or modify it under the terms of the gnu general public"),
    ("gpl", "free software: you can redistribute", r"\w+ is free software: you can redistribute it and/or modify it under the terms of the gnu general public"),
    ("lgpl", "free software; you can redistribute", r"this library is free software; you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general"),
    ("lgpl", "free software: you can redistribute", r"\w+ is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general"),
    ("agpl", "free software: you can redistribute", r"\w+ is free software: you can redistribute it and/or modify it under the terms of the gnu affero"),
    ("gpl", "you should have received a copy of the gnu general", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", "you should have received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license along with"),
    ("agpl", "you should have received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with"),
    ("gpl", "intended to guarantee your freedom", r"the gnu general public license is intended to guarantee your freedom to (?:share|change)"),
    ("gpl-2", "to the public at large", r"we have made a gnu general public license, applied to the public at large|license document, version 2, applied to the public at large"),
    ("gpl-3", "installation information", r"convey an object code work under this section in, or with,[^.]{0,80}installation information"),
    ("gpl", "mere aggregation", r"mere aggregation of another work not based on the program"),
    ("lgpl", "work that uses the library", r"is called a ['\"]work that uses the library['\"]"),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant sections", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gpl-classpath", "independent modules", r"permission to link this library with independent modules to produce an executable"),
    ("gpl-autoconf", "configuration script generated by autoconf", r"distribute a configuration script generated by autoconf"),
    ("gnu-all-permissive", "permitted in any medium without royalty", r"permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    # MIT and its kin
    ("mit", "to deal in the software without restriction", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge"),
    ("mit", "substantial portions of the software", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("x11", "shall not be used in advertising", r"except as contained in this notice, the name of [^.]{1,80} shall not be used in advertising or otherwise to promote the sale"),
    ("mit-0", "without restriction, including without limitation", r"without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("hpnd", "for any purpose and without fee is hereby granted", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", "makes no representations about the suitability", r"makes no representations about the suitability of this software for any purpose"),
    ("isc", "the author disclaims all warranties", r"the software is provided ['\"]as is['\"] and the author disclaims all warranties with regard to this software"),
    ("0bsd", "with or without fee is hereby granted", r"for any purpose with or without fee is hereby granted\. the software is provided"),
    ("isc", "with or without fee is hereby granted", r"for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("curl", "name of a copyright holder shall not be used", r"except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    # BSD and its kin
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd-3-clause", "endorse or promote products", r"neither the names? of [^.]{1,120} nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "must display the following ack", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "procurement of substitute goods", r"including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits"),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors ['\"]as is['\"]"),
    ("bsd", "regents and contributors", r"this software is provided by the regents and contributors ['\"]as is['\"]"),
    ("bsd-patent", "perpetual, worldwide, non-exclusive", r"grants you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable \(except for failure to satisfy the conditions of this license\) patent"),
    ("bsd-clear", "no express or implied licenses to any party's patent", r"no express or implied licenses to any party's patent rights are granted"),
    ("bsd", "use of this source code is governed by a bsd", r"use of this source code is governed by a bsd-style license"),
    # Apache
    ("apache-2.0", "you may obtain a copy of the license at", r"you may obtain a copy of the license at [<(]?https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "you may not use this file except in compliance", r"licensed under the apache license, version 2\.0 \(the ['\"]license['\"]\); you may not use this file except in compliance"),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "developed by the apache group", r"this product includes software developed by the apache group"),
    ("apache-2.0", "each contributor hereby grants to you", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("llvm-exception", "your compiling your source code", r"if, as a result of your compiling your source code, portions of this software are embedded into an object form"),
    # weak copyleft of foundations and companies
    ("mpl-2.0", "subject to the terms of the mozilla public", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-1.1", "subject to the mozilla public license version 1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2.0", "incompatible with secondary licenses", r"this source code form is ['\"]incompatible with secondary licenses['\"]"),
    ("mpl", "was not distributed with this file, you can obtain one at", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("npl", "subject to the netscape public license", r"the contents of this file are subject to the netscape public license"),
    ("epl-1.0", "eclipse public license v1.0 which", r"made available under the terms of the eclipse public license v1\.0 which accompanies this distribution"),
    ("epl-2.0", "eclipse public license 2.0 which", r"made available under the terms of the eclipse public license 2\.0 which is available at"),
    ("epl", "constitutes recipient's acceptance", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("cddl", "subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "include this cddl header", r"when distributing [^.]{1,40}, include this cddl header (?:notice )?in each file"),
    ("cpl-1.0", "common public license v1.0 which", r"made available under the terms of the common public license v1\.0 which accompanies"),
    ("ipl-1.0", "ibm public license", r"terms of this ibm public license \(['\"]agreement['\"]\)"),
    ("eupl", "under the eupl", r"licensed under the eupl,? (?:version|v\.?) ?1\.[0-2]"),
    ("cecill", "governed by the cecill", r"this software is governed by the cecill(?:-[bc])? license under french law"),
    ("ms-pl", "accompanying software. if you use the software, you accept", r"governs use of the accompanying software\. if you use the software, you accept this license"),
    ("osl-3.0", "licensed under the open software license version 3.0", r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "licensed under the academic free license version 3.0", r"licensed under the academic free license version 3\.0"),
    ("apsl", "subject to the apple public source license", r"contains original code and/or modifications of original code as defined in and that are subject to the apple public source license"),
    ("qpl", "q public license", r"may be distributed under the terms of the q public license"),
    ("sleepycat", "complete source code for the", r"information on how to obtain complete source code for the [\w ]{1,20} software and any accompanying software"),
    ("lppl", "latex project public license", r"conditions of the latex project public license"),
    ("artistic", "same terms as perl itself", r"redistribute it and/or modify it under the same terms as perl itself"),
    ("artistic", "artistic control over the development", r"maintains some semblance of artistic control over the development of the package"),
    ("ruby", "same terms as ruby", r"(?:distributed under|licensed under) the same terms as ruby"),
    # permissive texts of single projects
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", "must be plainly marked as such", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "distributed under the boost software license", r"distributed under the boost software license, version 1\.0"),
    ("bsl-1.0", "machine-executable object code generated by", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("openssl", "developed by the openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young"),
    ("psf", "between the python software foundation", r"this license agreement is between the python software foundation"),
    ("psf", "under the python software foundation", r"(?:licensed|distributed) under the python software foundation license"),
    ("psf-2", "psf is making python available", r"psf is making python available to licensee on an ['\"]as is['\"] basis"),
    ("php", "this product includes php", r"this product includes php(?: software)?, freely available from"),
    ("zope", "provisions of the zope public license", r"subject to the provisions of the zope public license"),
    ("zope", "zope corporation and contributors", r"zope corporation and contributors\. all rights reserved"),
    ("postgresql", "without a written agreement is hereby granted", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction"),
    ("w3c", "by obtaining, using and/or copying this work", r"by obtaining, using and/or copying this work, you \(the licensee\) agree"),
    ("unicode", "unicode data files", r"of the unicode data files and any associated documentation"),
    ("icu", "associated documentation files (the", r"obtaining a copy of the unicode data files or unicode software and any associated documentation files \(the"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("libpng", "same disclaimer and license as libpng", r"distributed according to the same disclaimer and license as libpng"),
    ("freetype", "freetype project", r"portions of this software are copyright [^.]{1,40} the freetype project"),
    ("sqlite", "in place of a legal notice", r"in place of a legal notice, here is a blessing"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("wtfpl", "you just do what the", r"you just do what the f\w+ you want to"),
    ("json", "good, not evil", r"the software shall be used for good, not evil"),
    ("vim", "vim is charityware", r"vim is charityware"),
    ("bzip2", "julian seward", r"bzip2 and libbzip2[^.]{0,60}julian seward"),
    ("tcl", "existing copyright notices are retained", r"provided that existing copyright notices are retained in all copies"),
    ("ntp", "university of delaware", r"the name university of delaware not be used in advertising"),
    ("mulan", "without warranties of any kind, either express or implied, including but not limited to non-infringement", r"without warranties of any kind, either express or implied, including but not limited to non-infringement"),
    ("blueoak", "blue oak model license", r"blue oak model license"),
    ("upl", "associated documentation and/or data", r"to any person obtaining a copy of this software, associated documentation and/or data"),
    # public domain and its like
    ("unlicense", "anyone is free to copy, modify, publish", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("cc0", "has waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons.org/publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "creativecommons.org/publicdomain/mark", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("public-domain", "disclaims copyright to this source code", r"the author disclaims copyright to this source code"),
    ("public-domain", "work of the united states government", r"is a work of the united states government and (?:is )?not subject to copyright protection"),
    ("public-domain", "no known copyright restrictions", r"no known copyright restrictions"),
    # data, fonts, contents
    ("ofl", "reserved font name", r"with reserved font name"),
    ("ofl", "sil open font license", r"this font software is licensed under the sil open font license"),
    ("odbl", "made available under the open database license", r"made available under the open database license"),
    ("odbl", "openstreetmap contributors", r"(?:\xc2\xa9|\(c\)|copyright) openstreetmap contributors"),
    ("pddl", "opendatacommons.org/licenses/pddl", r"opendatacommons\.org/licenses/pddl"),
    ("odc-by", "opendatacommons.org/licenses/by", r"opendatacommons\.org/licenses/by\b"),
    ("odbl", "opendatacommons.org/licenses/odbl", r"opendatacommons\.org/licenses/odbl"),
    ("ogl", "contains public sector information", r"contains public sector information licen[cs]ed under the open government"),
    ("cdla", "community data license agreement", r"community data license agreement"),
    ("cc", "attribute the work in the manner specified", r"you must attribute the work in the manner specified by the author"),
    ("cc-by-sa", "distribute the resulting work only under the same", r"you may distribute the resulting work only under the same or similar license"),
    ("gutenberg", "project gutenberg license", r"under the terms of the project gutenberg license"),
    ("artlibre", "free art license", r"(?:under|according to) the (?:terms of the )?free art license"),
    # restricted and source-available
    ("sspl", "server side public license", r"server side public license"),
    ("elastic", "elastic license", r"elastic license(?:,? (?:version )?2\.0)?"),
    ("commons-clause", "commons clause", r"commons clause license condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license"),
    ("busl", "change date", r"on the change date, or the fourth anniversary"),
    ("openrail", "use-based restrictions", r"use-based restrictions as referenced in paragraph 5"),
    ("eula", "end user license agreement", r"this end user license agreement"),
    ("eula", "by installing, copying", r"by installing, copying,? or otherwise using the (?:software|product)"),
    ("eula", "reverse engineer", r"you may not reverse engineer, decompile,? or disassemble"),
    ("proprietary", "trade secrets", r"contains (?:confidential|proprietary) (?:information|trade secrets)[^.]{0,40}trade secrets"),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", "unpublished proprietary source code", r"this is unpublished proprietary source code"),
    ("proprietary", "no part of this publication may be reproduced", r"no part of this publication may be reproduced, stored in a retrieval system"),
    # addresses
    ("gpl", "gnu.org/licenses/gpl", r"gnu\.org/licenses/gpl"),
    ("lgpl", "gnu.org/licenses/lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl", "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("gpl", "gnu.org/copyleft/gpl", r"gnu\.org/copyleft/gpl"),
    ("mit", "opensource.org/licenses/mit", r"opensource\.org/licenses/mit\b"),
    ("bsd", "opensource.org/licenses/bsd", r"opensource\.org/licenses/bsd"),
    ("apache-2.0", "opensource.org/licenses/apache-2.0", r"opensource\.org/licenses/apache-2\.0"),
    ("isc", "opensource.org/licenses/isc", r"opensource\.org/licenses/isc\b"),
    ("mpl-2.0", "mozilla.org/mpl/2.0", r"mozilla\.org/mpl/2\.0"),
    ("epl-2.0", "eclipse.org/legal/epl-2.0", r"eclipse\.org/legal/epl-2\.0"),
    ("bsl-1.0", "boost.org/license_1_0.txt", r"boost\.org/license_1_0\.txt"),
    ("ofl", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
]

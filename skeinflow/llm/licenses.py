"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is lower-cased (A-Z only) and reduced to its words joined by single spaces, so each rule is a regex over
words. A rule runs only on texts that hold its keyword. Of the detections found, one that lies inside the interval of
a detection of higher rank is suppressed, and so is one that overlaps it in part and is of the same family; rank is
priority, then length, then (ties) rule order. Only intervals that are still open where one starts are compared with it.
Short names and SPDX expressions are read by identifier (family, version, "or later"), several where they are joined; notices that name
a version but no licence take the family of the nearest notice before. What is negated ("not licensed under ...") suppresses but isn't reported.
The base phrases are counted apart from that and are never suppressed.

Null and empty texts have no words and no detections; texts of any length are read whole, in time in proportion to
their length and number of detections. Rows are independent: repeated rows give repeated results. An empty table gives
no rows.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .texts import map_texts, table

#: Phrase and label of the base rules.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence families: label, names as words, versions. Rules are made from each by FORMS.
FAMILIES = [
    ("gpl", ["gnu general public license", "gnu gpl", "general public license"], ["1", "2", "3"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl"], ["2", "2 1", "3"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["1", "3"]),
    ("gfdl", ["gnu free documentation license", "free documentation license"], ["1 1", "1 2", "1 3"]),
    ("apache", ["apache license", "apache software license"], ["1 0", "1 1", "2 0"]),
    ("mpl", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution license"], ["1 0", "1 1"]),
    ("cpl", ["common public license"], ["1 0"]),
    ("eupl", ["european union public license", "european union public licence"], ["1 0", "1 1", "1 2"]),
    ("osl", ["open software license"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", ["academic free license"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("artistic", ["artistic license"], ["1 0", "2 0"]),
    ("bsl", ["boost software license"], ["1 0"]),
    ("busl", ["business source license"], ["1 0", "1 1"]),
    ("sspl", ["server side public license"], ["1"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc0", ["cc0", "creative commons zero"], ["1 0"]),
    ("mit", ["mit license", "expat license", "x11 license"], []),
    ("mit-0", ["mit no attribution license", "mit no attribution"], []),
    ("bsd", ["bsd license", "berkeley software distribution license"], []),
    ("bsd-2-clause", ["2 clause bsd license", "bsd 2 clause license", "bsd 2 clause", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", ["3 clause bsd license", "bsd 3 clause license", "bsd 3 clause", "new bsd license", "modified bsd license", "revised bsd license"], []),
    ("bsd-4-clause", ["4 clause bsd license", "bsd 4 clause license", "bsd 4 clause", "original bsd license"], []),
    ("0bsd", ["zero clause bsd license", "bsd zero clause license", "0bsd"], []),
    ("isc", ["isc license", "internet software consortium license"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("libpng", ["libpng license", "png reference library license"], ["1", "2"]),
    ("openssl", ["openssl license"], []),
    ("unlicense", ["the unlicense", "unlicense license"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["1", "2"]),
    ("python", ["python software foundation license", "psf license", "python license"], ["2"]),
    ("php", ["php license"], ["3 0", "3 01"]),
    ("ruby", ["ruby license"], []),
    ("perl", ["perl license", "same terms as perl itself"], []),
    ("postgresql", ["postgresql license"], []),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], []),
    ("w3c", ["w3c software notice and license", "w3c software license"], []),
    ("unicode", ["unicode license", "unicode terms of use"], ["3"]),
    ("ofl", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("odbl", ["open database license", "open data commons open database license"], ["1 0"]),
    ("odc-by", ["open data commons attribution license"], ["1 0"]),
    ("pddl", ["public domain dedication and license", "public domain dedication and licence"], ["1 0"]),
    ("ogl", ["open government licence", "open government license"], ["1 0", "2 0", "3 0"]),
    ("etalab", ["licence ouverte", "open licence etalab"], ["1 0", "2 0"]),
    ("dl-de", ["datenlizenz deutschland"], ["2 0"]),
    ("cecill", ["cecill free software license agreement", "cecill license"], ["1 0", "1 1", "2 0", "2 1"]),
    ("ms-pl", ["microsoft public license"], []),
    ("ms-rl", ["microsoft reciprocal license"], []),
    ("upl", ["universal permissive license"], ["1 0"]),
    ("qpl", ["q public license"], ["1 0"]),
    ("sleepycat", ["sleepycat license"], []),
    ("vim", ["vim license"], []),
    ("mulan", ["mulan permissive software license"], ["1", "2"]),
    ("llama", ["llama community license", "llama 2 community license", "llama 3 community license"], []),
    ("openrail", ["creativeml open rail m", "open rail m license", "responsible ai license"], []),
    ("elastic", ["elastic license"], ["1 0", "2 0"]),
    ("hippocratic", ["hippocratic license"], ["1 0", "2 1", "3 0"]),
    ("blueoak", ["blue oak model license"], ["1 0 0"]),
]

#: Grant, notice and dedication texts: label, priority, regex over words. The keyword is the longest fixed word run.
TEXTS = [
    ("mit", 70, "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", 40, "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", 70, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 70, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 60, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 65, "neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|their) contributors may be used"),
    ("bsd-4-clause", 65, "all advertising materials mentioning features or use of this software must display"),
    ("bsd", 30, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 30, "redistributions in binary form must reproduce the above copyright notice"),
    ("zlib", 70, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 60, "altered source versions must be plainly marked as such"),
    ("apache", 70, "you may not use this file except in compliance with the license"),
    ("apache", 60, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", 70, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 70, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", 70, "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gfdl", 70, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", 70, "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", 70, "this is free and unencumbered software released into the public domain"),
    ("public-domain", 50, "(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", 45, "this (?:work|text|page|file|document) (?:is )?in the public domain"),
    ("cc0", 65, "waived all copyright and related or neighboring rights"),
    ("cc", 35, "this work is licensed under a creative commons"),
    ("cc", 30, "some rights reserved"),
    ("all-rights-reserved", 10, "copyright (?:c )?(?:[0-9]{4} )*(?:[^ ]+ ){0,8}all rights reserved"),
    # permissive notices: grants
    ("mit", 60, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", 50, "permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", 45, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 45, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", 60, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", 55, "in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("bsd", 45, "this software is provided by the (?:copyright holders|author|regents|project) (?:and contributors )?as is and any express or implied warranties"),
    ("bsd", 45, "in no event shall the (?:copyright (?:holder|owner)s?|regents|author|foundation|project) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", 60, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 60, "this product includes software developed by (?:the )?university of california berkeley and its contributors"),
    ("bsd-2-clause", 50, "the views and conclusions contained in the software and documentation are those of the authors"),
    ("zlib", 60, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 55, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", 50, "this notice may not be removed or altered from any source distribution"),
    ("libpng", 60, "the png reference library is supplied as is"),
    ("bsl", 60, "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("bsl", 55, "machine executable object code generated by a source language processor"),
    ("ncsa", 60, "neither the names of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("ncsa", 55, "to deal with the software without restriction"),
    ("postgresql", 55, "in no event shall the university of california be liable to any party"),
    ("hpnd", 50, "permission to use copy modify (?:distribute and sell )?this software and its documentation for any purpose is hereby granted without fee"),
    ("fair", 60, "usage of the works is permitted provided that this instrument is retained with the works"),
    ("beerware", 65, "the beer ware license"),
    ("beerware", 60, "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("wtfpl", 65, "you just do what the fuck you want to"),
    ("curl", 60, "copyright (?:c )?[0-9]{4} (?:[0-9]{4} )?daniel stenberg"),
    ("unicode", 60, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", 60, "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("python", 60, "psf is making python available to licensee on an as is basis"),
    ("python", 60, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", 60, "this product includes software developed by the openssl project"),
    ("openssl", 55, "this product includes cryptographic software written by eric young"),
    ("php", 60, "this product includes php software freely available from"),
    ("ijg", 60, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 60, "portions of this software are copyright (?:c )?(?:[0-9]{4} )*the freetype project"),
    ("unlicense", 60, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 55, "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", 60, "to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright"),
    ("cc0", 55, "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("pddl", 60, "the work is placed in the public domain under the open data commons"),
    # apache: grants, patents, notices
    ("apache-2.0", 65, "licensed under the apache license version 2 0 the license you may not use this file"),
    ("apache-2.0", 60, "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", 60, "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", 50, "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-1.1", 60, "this product includes software developed by the apache software foundation"),
    ("apache", 50, "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"),
    # copyleft: grants, notices, parts of the text
    ("*-1-or-later", 85, "either version 1 of the license or at your option any later version"),
    ("*-2-or-later", 85, "either version 2 of the license or at your option any later version"),
    ("*-2.1-or-later", 85, "either version 2 1 of the license or at your option any later version"),
    ("*-3-or-later", 85, "either version 3 of the license or at your option any later version"),
    ("*-2", 75, "version 2 of the license only"),
    ("*-3", 75, "version 3 of the license only"),
    ("*", 50, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", 50, "this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 45, "you should have received a copy of the gnu general public license along with this (?:program|file|software)"),
    ("lgpl", 45, "you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("agpl", 45, "you should have received a copy of the gnu affero general public license along with this program"),
    ("gpl-3", 60, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", 60, "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended"),
    ("gpl", 45, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("agpl-3", 60, "specifically to ensure cooperation with the community in the case of network server software"),
    ("agpl", 55, "interacting with it remotely through a computer network"),
    ("gpl-classpath-exception", 80, "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-linking-exception", 75, "as a special exception (?:[^ ]+ ){1,12}permission to link"),
    ("gfdl", 60, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 65, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 65, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", 50, "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied"),
    ("epl", 65, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 55, "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license"),
    ("cddl", 65, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 55, "use is subject to license terms cddl header"),
    ("cpl", 60, "the accompanying program is provided under the terms of this common public license"),
    ("eupl", 60, "licensed under the eupl"),
    ("osl", 60, "licensed under the open software license"),
    ("artistic", 60, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 60, "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", 60, "you can redistribute it and or modify it under the same terms as perl"),
    ("ruby", 60, "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("cecill", 60, "this software is governed by the cecill license under french law"),
    ("sspl", 60, "offering the program as a service you must make the service source code available"),
    ("ofl", 55, "this license is copied below and is also available with a faq at"),
    ("ofl", 50, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    # creative commons and data
    ("cc", 34, "you are free to share copy and redistribute the material in any medium or format"),
    ("cc", 34, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", 55, "you may not use the material for commercial purposes"),
    ("cc-by-nd", 55, "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", 55, "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-sa", 55, "text is available under the creative commons attribution share ?alike license"),
    ("cc", 40, "except where otherwise noted (?:content|text) on this (?:site|page|wiki) is licensed under"),
    ("odbl", 60, "you are free to share to create and to adapt as long as you attribute share alike and keep open"),
    ("odbl", 50, "data is available under the open database license"),
    ("ogl", 55, "contains public sector information licensed under the open government licence"),
    ("cc-by", 45, "licensed under cc by"),
    # source available, models, proprietary
    ("busl", 60, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl", 50, "additional use grant"),
    ("commons-clause", 65, "the license does not grant to you the right to sell the software"),
    ("elastic", 60, "you may not provide the software to third parties as a hosted or managed service"),
    ("polyform", 60, "polyform (?:noncommercial|small business|strict|shield|perimeter) license"),
    ("llama", 60, "llama (?:2|3|3 1|3 2) is licensed under the llama (?:2|3|3 1|3 2) community license"),
    ("openrail", 55, "you agree not to use the model or derivatives of the model"),
    ("proprietary", 45, "this software is the confidential and proprietary information of"),
    ("proprietary", 45, "you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement"),
    ("proprietary", 40, "no part of this (?:publication|document|book|work) may be reproduced"),
    ("proprietary", 40, "you may not (?:copy modify or distribute|reverse engineer decompile or disassemble)"),
    ("proprietary", 35, "for internal use only not for (?:redistribution|distribution)"),
    ("proprietary", 35, "use of this (?:software|site|content) is subject to (?:the )?(?:license agreement|terms of use)"),
    ("evaluation", 40, "this is (?:a )?(?:trial|evaluation) (?:version|license)"),
    ("no-redistribution", 40, "may not be (?:redistributed|sublicensed|resold)"),
    ("no-redistribution", 40, "must not be (?:redistributed|sublicensed|resold)"),
    ("non-commercial", 40, "free for (?:personal|non commercial|noncommercial|academic|educational) (?:and non commercial )?use(?: only)?"),
    ("non-commercial", 40, "for (?:non commercial|noncommercial|research|academic) (?:use|purposes) only"),
    ("public-domain", 50, "no (?:known )?copyright (?:restrictions|is claimed)"),
    ("public-domain", 50, "this (?:work|file|image|media) has been (?:released|placed) into the public domain by its (?:author|copyright holder)"),
    ("us-government", 50, "work of the (?:united states|u s) government (?:and )?(?:is )?not subject to (?:domestic )?copyright"),
    ("royalty-free", 30, "royalty free (?:license|licence)"),
    ("dual", 40, "(?:dual|multi) licensed under"),
    ("dual", 35, "at your option under (?:either )?(?:the )?(?:terms of )?(?:either|any) (?:of )?(?:the )?(?:following )?licenses"),
    ("proprietary", 40, "proprietary and confidential"),
    ("proprietary", 40, "confidential and proprietary"),
    ("proprietary", 40, "may not be reproduced (?:or distributed )?(?:in any form )?without (?:the )?(?:prior )?written permission"),
    ("proprietary", 40, "unauthorized (?:copying|reproduction|distribution) (?:[^ ]+ ){0,6}is (?:strictly )?prohibited"),
    ("eula", 40, "end user license agreement"),
    ("boost", 70, "boost software license version 1 0"),
    ("postgresql", 60, "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("ofl", 60, "this font software is licensed under the sil open font license"),
]

#: How a family's name appears: what is added to the label, priority, shape. {n}: name, {v}: version words.
FORMS = [
    ("", 20, "{n}"),
    ("", 30, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the )?{n}"),
]
VERSIONED = [
    ("-{d}", 50, "{n}(?: international| unported)? (?:version |v )?{v}(?: international| unported)?"),
    ("-{d}", 55, "{n} v{v}"),
    ("-{d}", 60, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the )?{n} (?:version |v )?{v}(?: international| unported)?"),
    ("-{d}-or-later", 80, "{n} (?:version |v )?{v} or (?:at your option )?(?:any )?later(?: version)?"),
    ("-{d}-or-later", 82, "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the )?{n} (?:version |v )?{v} or (?:at your option )?(?:any )?later(?: version)?"),
    ("-{d}-or-later", 80, "{n} either version {v} of the license or at your option any later version"),
]
#: Families whose notices say "either version N of the License" without a name: those rules, marked by a star, take the family of the nearest one before.
BOUND = {"gpl", "lgpl", "agpl", "gfdl"}
#: Families that go by their short name alone where licences are named, and those that do with a version anywhere.
SHORT = ["gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "cddl", "eupl", "mit", "bsd", "isc", "zlib", "ofl", "cc0", "unlicense", "wtfpl"]
SHORTER = ["gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "eupl"]
#: Chance that a detection of this priority or more is right.
CONFIDENCE = [(80, 0.99), (70, 0.97), (50, 0.95), (30, 0.85), (0, 0.7)]


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: bytes
    regex: re.Pattern


class Detection(NamedTuple):
    label: str
    priority: int
    start: int  # in bytes of the words joined by spaces
    end: int


def _keyword(shape: str) -> bytes:
    """The longest part of a shape that every match holds."""
    fixed = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*]?(?:\{[^}]*\})?|\[[^]]*\][+*]?", "\0", shape)
    return max(fixed.split("\0"), key=len).strip().encode()


@cache
def rules() -> list[Rule]:
    """All rules in order: by falling priority, then as listed."""
    made = [(label, priority, shape, _keyword(shape)) for label, priority, shape in TEXTS]
    for label, names, versions in FAMILIES:
        for name in names:
            made += [(label, priority, shape.format(n=name), name.encode()) for add, priority, shape in FORMS]
            for v in versions:
                d = v.replace(" ", ".")
                for add, priority, shape in VERSIONED:
                    made.append((label + add.format(d=d), priority, shape.format(n=name, v=v), name.encode()))
    made = list(dict.fromkeys(made))
    return [Rule(label, priority, keyword, re.compile(rf"(?<= ){shape}(?= )".encode())) for label, priority, shape, keyword in sorted(made, key=lambda x: -x[1])]


@cache
def _by_keyword() -> dict[bytes, list[tuple[int, Rule]]]:
    """The rules by keyword, with their order."""
    by: dict[bytes, list[tuple[int, Rule]]] = {}
    for i, rule in enumerate(rules()):
        by.setdefault(rule.keyword, []).append((i, rule))
    return by


@cache
def _keywords() -> ahocorasick.Automaton:
    """Finds all keywords in one pass; a byte is a letter of the same number."""
    found = ahocorasick.Automaton()
    for keyword in _by_keyword():
        found.add_word(keyword.decode("latin-1"), keyword)
    found.make_automaton()
    return found


class Named(NamedTuple):
    """Places that name licences by identifiers: what stands before them, the identifiers allowed, whether several may be joined."""

    priority: int
    sign: bytes
    regex: re.Pattern
    identifier: re.Pattern


def _identifier(labels: list[str], versioned: str) -> str:
    names = "|".join(x.replace("-", " ") for x in sorted(labels, key=len, reverse=True))
    return rf"(?:{names}){versioned}(?: only| or later| or any later version)?"


@cache
def _named() -> list[Named]:
    number, given = r"(?: ?v ?[0-9]+(?: [0-9]+){0,2}| (?:version )?[0-9](?: [0-9]+){0,2})", r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the )?"
    every, short, shorter = (_identifier(x, v) for x, v in (([f[0] for f in FAMILIES], number + "?"), (SHORT, number + "?"), (SHORTER, number)))
    shapes = [
        (76, "spdx license identifier", rf"spdx license identifier {every}(?: (?:or|and) {every})*", every),
        (36, " under ", given + short, short), (36, "licen", rf"licen[cs]e (?:is )?{short}", short), (50, "pl", shorter, shorter),
    ]
    return [Named(priority, sign.encode(), re.compile(rf"(?<= ){shape}(?= )".encode()), re.compile(rf"(?<= ){one}(?= )".encode())) for priority, sign, shape, one in shapes]


@cache
def _versions() -> dict[str, set[str]]:
    return {label: {v.replace(" ", ".") for v in versions} for label, _, versions in FAMILIES}


def label_of(identifier: str) -> str:
    """The label of an identifier in words: its family, version and whether later ones will do."""
    later = re.search(r" or (?:any )?later(?: version)?$", identifier)
    words = re.sub(r" (?:only|or later|or any later version)$", "", identifier)
    m = re.fullmatch(r"(.+?)(?: ?v ?([0-9]+(?: [0-9]+)*)| (?:version )?([0-9](?: [0-9]+)*))?", words)
    family, version = m[1].replace(" ", "-"), (m[2] or m[3] or "").replace(" ", ".")
    known = _versions().get(family, set())
    if version and version not in known:
        version = version.removesuffix(".0") if version.removesuffix(".0") in known else version + ".0" if version + ".0" in known else version
    return family + (f"-{version}" if version else "") + ("-or-later" if later and version else "")


#: Ends of what stands before a detection that is denied.
_NEGATED = re.compile(rb" (?:not|never|no longer|isn t|aren t|cannot be) (?:[^ ]+ )?(?:under )?(?:the )?\Z")


def _family(label: str) -> str:
    return label.split("-")[0]


def _found(words: bytes) -> list[tuple[int, int, tuple[int, int, int], str, int]]:
    """(start, -end, rank, label, priority) of every match."""
    found = []
    for keyword in {k for _, k in _keywords().iter(words.decode("latin-1"))}:
        for order, rule in _by_keyword()[keyword]:
            found += [(m.start(), -m.end(), (-rule.priority, m.start() - m.end(), order), rule.label, rule.priority) for m in rule.regex.finditer(words)]
    for k, named in enumerate(_named()):
        if named.sign in words:
            for m in named.regex.finditer(words):
                for one in named.identifier.finditer(words, m.start(), m.end() + 1):
                    found.append((one.start(), -one.end(), (-named.priority, one.start() - one.end(), 1 << 20 | k), label_of(one.group().decode()), named.priority))
    return found


def _bound(kept: list[Detection]) -> list[Detection]:
    """Detections in order, those of a starred rule with the family of the nearest one before; they take the place of that family's notices without a version."""
    out: list[Detection] = []
    last, absorbs = "gpl", {}
    for d in kept:
        if d.label.startswith("*"):
            d = d._replace(label=last + d.label[1:])
            if d.label == last:
                if d.start >= absorbs.get(last, 0):
                    out.append(d)
                continue
            absorbs[last] = d.start + ABSORBED
            while out and out[-1].label == last and d.start - out[-1].end < ABSORBED:
                out.pop()
        elif _family(d.label) in BOUND:
            last = _family(d.label)
            if d.label == last and d.start < absorbs.get(last, 0):
                continue
        out.append(d)
    return out


#: How far from a version's notice, in bytes, the rest of the same notice may lie.
ABSORBED = 2000


def detect(words: bytes) -> list[Detection]:
    """Detections in words joined by, and standing between, single spaces; overlaps are resolved."""
    # what contains an interval starts no later: those still open when it starts are all that can suppress it
    kept: list[list] = []  # detection, rank, and whether it stays
    still_open, of_family = [], {}
    for start, end, rank, label, priority in sorted(_found(words), key=lambda f: f[:3]):
        still_open = [o for o in still_open if -o[1] > start]
        family = _family(label)
        if not any(o[2] < rank and (o[1] <= end or o[3] == family) for o in still_open):
            # an earlier one of the same family that reaches into this one and is of lower rank goes; only those still open can
            reach = [k for k in of_family.get(family, ()) if k[0].end > start]
            for k in reach:
                k[2] = k[2] and k[1] <= rank
            kept.append([Detection(label, priority, start, -end), rank, True])
            of_family[family] = [*(k for k in reach if k[2]), kept[-1]]
        still_open.append((start, end, rank, family))
    stay = sorted((d for d, _, stays in kept if stays), key=lambda k: (k.start, k.end, k.label))
    return sorted((d for d in _bound(stay) if not _NEGATED.search(words, max(0, d.start - 40), d.start)), key=lambda k: (k.start, k.end, k.label))


_FOLD = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and anything beyond ASCII."""
    return text.translate(_FOLD).split()


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]]]:
    """(number of words, base matches (start word, label), detections (start word, end word, label, priority))."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in BASE.items():
        p = b" " + phrase.encode() + b" "
        i = joined.find(p)
        while i >= 0:
            base.append((i + 1, label))
            i = joined.find(p, i + 1)
    found = detect(joined)
    number, n, before = {}, -1, 0  # of the word at a byte; counted on from place to place
    for at in sorted({i for i, _ in base} | {x for d in found for x in (d.start, d.end)}):
        n += joined.count(b" ", before, at)
        number[at], before = n, at
    return len(words), sorted((number[i], label) for i, label in base), [(number[d.start], number[d.end] + 1, d.label, d.priority) for d in found]


def confidence(priority: int) -> float:
    return next(c for least, c in CONFIDENCE if priority >= least)


def scan_licenses(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Per row of df: `keep`, n_words, base (start, label), found (start, end, label, priority; in words, end exclusive)."""

    def rows_of(texts: list[bytes]) -> dict[str, list]:
        n, base, found = zip(*map(scan, texts)) if texts else ((), (), ())
        return {
            "n_words": list(n),
            "base_starts": [[s for s, _ in b] for b in base],
            "base_names": [[x for _, x in b] for b in base],
            "found_starts": [[d[0] for d in f] for f in found],
            "found_ends": [[d[1] for d in f] for f in found],
            "found_labels": [[d[2] for d in f] for f in found],
            "found_scores": [[confidence(d[3]) for d in f] for f in found],
        }

    import pyarrow as pa

    def typed(texts: list[bytes]) -> dict[str, pa.Array]:
        made = rows_of(texts)
        kinds = {"n_words": pa.int64(), "base_names": pa.list_(pa.string()), "found_labels": pa.list_(pa.string()), "found_scores": pa.list_(pa.float64())}
        return {k: pa.array(v, kinds.get(k, pa.list_(pa.int64()))) for k, v in made.items()}

    return map_texts(df, typed, "n_words bigint, base_starts array<bigint>, base_names array<string>, found_starts array<bigint>, found_ends array<bigint>, found_labels array<string>, found_scores array<double>", keep, text)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    join = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    best = F.when(F.size("found_scores") > 0, F.array_max("found_scores")).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"), F.array_min("base_starts").alias("first_word"), F.array_max("base_starts").alias("last_word"),
        join("base_names").alias("base_labels"), join("base_names", "found_labels").alias("labels"),
        F.greatest(best, F.when(F.size("base_starts") > 0, 0.8).otherwise(0.0)).alias("score"),
    )

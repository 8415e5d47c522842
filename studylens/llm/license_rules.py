"""Signature rules for license text, written over normalised words.

A rule is matched against the words of a document joined by single spaces, so "CC-BY-SA
4.0" reads "cc by sa 4 0".  Rules are ordered: a lower priority number wins.  Exact
versions come before families, families before loose mentions.  ``gate`` is a keyword
that every match contains; documents without it skip the rule.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    gate: str
    pattern: str
    weight: float


EXACT, FAMILY, MENTION = 1, 2, 3


def _versions(text: str) -> list[tuple[str, str]]:
    """("2.1", pattern of its words) of "2 2.1 ..."; whole versions may carry a zero."""
    out = []
    for v in text.split():
        words = v.split(".")
        out.append((v, f"{words[0]}(?: 0)?" if len(words) == 1 else " ".join(words)))
    return out


def _gnu() -> list[Rule]:
    out = []
    for short, name, gate, versions in (
        ("gpl", "general public licen[sc]e", "general public", "1 2 3"),
        ("lgpl", "(?:lesser|library) general public licen[sc]e", "general public", "2 2.1 3"),
        ("agpl", "affero general public licen[sc]e", "affero", "1 3"),
        ("fdl", "free documentation licen[sc]e", "free documentation", "1.1 1.2 1.3"),
    ):
        abbreviation = "g?fdl" if short == "fdl" else short
        for v, p in _versions(versions):
            out += [
                Rule(f"{short}-{v}+", EXACT, gate, rf"(?:gnu )?{name} (?:as published by the free software foundation )?(?:either )?(?:version |v ?){p} (?:of the licen[sc]e )?or (?:at your option )?any later version", 1.0),
                Rule(f"{short}-{v}", EXACT + 1, gate, rf"(?:gnu )?{name} (?:as published by the free software foundation )?(?:version |v ?){p}(?: only)?", 0.95),
                Rule(f"{short}-{v}+", EXACT, short[-3:], rf"(?:gnu )?{abbreviation} ?v?{p} or later", 0.95),
                Rule(f"{short}-{v}", EXACT + 1, short[-3:], rf"(?:gnu )?{abbreviation} (?:version )?v?{p}(?: only)?", 0.9),
            ]
        out += [Rule(short, FAMILY + 1, gate, rf"(?:gnu )?{name}", 0.8), Rule(short, MENTION + 1, short[-3:], rf"(?:gnu )?{abbreviation} licen[sc]ed?", 0.6)]
    return out


def _creative_commons() -> list[Rule]:
    out = []
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        codes = kind.split("-")
        name, code = " ".join(parts[c] for c in codes), " ".join(codes)
        for v, p in _versions("1.0 2.0 2.5 3.0 4.0"):
            out += [
                Rule(f"cc-{kind}-{v}", EXACT, "cc", rf"cc {code} {p}(?: international| unported)?", 1.0),
                Rule(f"cc-{kind}-{v}", EXACT, "commons", rf"creative commons {name} {p}(?: international| unported)?(?: licen[sc]e)?", 1.0),
                Rule(f"cc-{kind}-{v}", EXACT, "creativecommons", rf"creativecommons org licen[sc]es {code} {p}", 1.0),
            ]
        out += [
            Rule(f"cc-{kind}", FAMILY, "cc", rf"cc {code}", 0.8),
            Rule(f"cc-{kind}", FAMILY, "commons", rf"creative commons {name}(?: licen[sc]e)?", 0.85),
        ]
    out += [
        Rule("cc0-1.0", EXACT, "cc0", "cc0(?: 1 0)?(?: universal)?", 0.95),
        Rule("cc0-1.0", EXACT, "zero", "creative commons zero(?: 1 0)?", 0.95),
        Rule("cc0-1.0", EXACT, "creativecommons", "creativecommons org publicdomain zero 1 0", 1.0),
        Rule("cc-pdm", EXACT, "creativecommons", "creativecommons org publicdomain mark 1 0", 1.0),
        Rule("cc", MENTION, "commons", "creative commons", 0.5),
    ]
    return out


def _versioned() -> list[Rule]:
    """Licenses with versions: abbreviation, words of the name, gate, versions."""
    out = []
    for short, name, gate, versions in (
        ("apache", "apache(?: software)?", "apache", "1.0 1.1 2"),
        ("mpl", "mozilla public", "mozilla", "1.0 1.1 2"),
        ("epl", "eclipse public", "eclipse", "1 2"),
        ("cddl", "common development and distribution", "common development", "1.0 1.1"),
        ("cpl", "common public", "common public", "1.0"),
        ("eupl", "european union public", "european union", "1.0 1.1 1.2"),
        ("ofl", "(?:sil )?open font", "open font", "1.0 1.1"),
        ("artistic", "(?:perl )?artistic", "artistic", "1 2"),
        ("bsl", "boost software", "boost", "1"),
        ("osl", "open software", "open software", "1.0 2.0 2.1 3.0"),
        ("afl", "academic free", "academic free", "1.1 1.2 2.0 2.1 3.0"),
        ("cecill", "cecill(?: free software)?", "cecill", "1.0 1.1 2.0 2.1"),
        ("odbl", "open (?:data commons )?(?:open )?database", "database", "1.0"),
        ("odc-by", "open data commons attribution", "open data", "1.0"),
        ("pddl", "public domain dedication(?: and)?", "dedication", "1.0"),
        ("lppl", "latex project public", "latex project", "1.0 1.1 1.2 1.3"),
        ("qpl", "q public", "q public", "1.0"),
        ("rpl", "reciprocal public", "reciprocal", "1.1 1.5"),
        ("zpl", "zope public", "zope", "1.1 2.0 2.1"),
        ("psf", "python software foundation", "python software", "2"),
        ("php", "php", "php", "3.0 3.01"),
        ("sspl", "server side public", "server side", "1"),
        ("busl", "business source", "business source", "1.0 1.1"),
        ("elastic", "elastic", "elastic", "1 2"),
        ("ms-pl", "microsoft public", "microsoft public", "1"),
        ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", "1"),
        ("apsl", "apple public source", "apple public", "1.0 1.1 1.2 2.0"),
        ("oldap", "openldap public", "openldap", "2.0 2.1 2.3 2.4 2.7 2.8"),
        ("ecl", "educational community", "educational community", "1.0 2.0"),
        ("upl", "universal permissive", "universal permissive", "1.0"),
        ("etalab", "etalab open", "etalab", "1.0 2.0"),
        ("ogl-uk", "open government", "open government", "1.0 2.0 3.0"),
        ("dl-de-by", "datenlizenz deutschland namensnennung", "datenlizenz", "1.0 2.0"),
        ("dl-de-zero", "datenlizenz deutschland zero", "datenlizenz", "2.0"),
    ):
        for v, p in _versions(versions):
            out.append(Rule(f"{short}-{v}", EXACT, gate, rf"{name}(?: licen[sc]e)?(?: version| v)? {p}(?: licen[sc]e)?", 0.95))
            out.append(Rule(f"{short}-{v}", EXACT, gate, rf"licensed under (?:the )?{name} licen[sc]e (?:version |v)?{p}", 1.0))
        out.append(Rule(short, FAMILY, gate, rf"{name} licen[sc]e", 0.8))
    return out


def _plain() -> list[Rule]:
    rows = (
        ("mit", EXACT, "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
        ("mit", FAMILY, "mit licen", "(?:the )?mit licen[sc]ed?", 0.85),
        ("mit", FAMILY, "expat", "expat licen[sc]e", 0.8),
        ("isc", EXACT, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
        ("isc", FAMILY, "isc licen", "isc licen[sc]e", 0.8),
        ("bsd-2-clause", EXACT, "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[sc]e)?", 0.95),
        ("bsd-3-clause", EXACT, "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?", 0.95),
        ("bsd-4-clause", EXACT, "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", 0.95),
        ("0bsd", EXACT, "bsd", "(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?", 0.95),
        ("bsd", EXACT + 1, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
        ("bsd-3-clause", EXACT, "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote", 0.95),
        ("bsd-4-clause", EXACT, "advertising", "all advertising materials mentioning features or use of this software must display", 0.95),
        ("bsd", FAMILY, "bsd", "bsd licen[sc]ed?", 0.75),
        ("zlib", EXACT, "as is", "this software is provided as is without any express or implied warranty in no event will the authors", 0.9),
        ("zlib", FAMILY, "zlib", "zlib(?: libpng)? licen[sc]e", 0.8),
        ("unlicense", EXACT, "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
        ("unlicense", FAMILY, "unlicense", "(?:the )?unlicense", 0.85),
        ("wtfpl", EXACT, "do what the", "do what the fuck you want to public licen[sc]e", 1.0),
        ("wtfpl", FAMILY, "wtfpl", "wtfpl", 0.9),
        ("ncsa", FAMILY, "illinois", "university of illinois (?:ncsa )?open source licen[sc]e", 0.9),
        ("postgresql", FAMILY, "postgresql", "postgresql licen[sc]e", 0.85),
        ("sleepycat", FAMILY, "sleepycat", "sleepycat (?:public )?licen[sc]e", 0.85),
        ("openssl", FAMILY, "openssl", "openssl licen[sc]e", 0.85),
        ("beerware", FAMILY, "beer", "beer ?ware(?: licen[sc]e)?", 0.85),
        ("commons-clause", FAMILY, "commons clause", "commons clause(?: licen[sc]e condition)?", 0.9),
        ("public-domain", MENTION, "public domain", "(?:released |placed )?(?:in|into|to) the public domain", 0.6),
        ("as-is", MENTION, "as is", "(?:provided|distributed) as is without (?:any )?warrant(?:y|ies)", 0.4),
        ("as-is", MENTION, "warrant", "without warranties or conditions of any kind", 0.4),
        ("copyright", MENTION, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0.4),
        ("copyright", MENTION, "copyright", "copyright (?:c )?by", 0.3),
        ("copyright", MENTION, "droits", "tous droits réservés", 0.5),
        ("copyright", MENTION, "rechte", "alle rechte vorbehalten", 0.5),
        ("copyright", MENTION, "derechos", "todos los derechos reservados", 0.5),
        ("reserved", MENTION, "reserved", "all rights reserved", 0.5),
        ("proprietary", MENTION, "proprietary", "proprietary and confidential", 0.7),
        ("proprietary", MENTION, "unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution) .{0,60}?(?:is )?(?:strictly )?prohibited", 0.7),
        ("proprietary", MENTION, "permission", "(?:may not be|no part .{0,60}? may be) (?:reproduced|copied|distributed) .{0,80}?without .{0,40}?permission", 0.6),
        ("spdx", MENTION, "spdx", "spdx licen[sc]e identifier(?: [0-9a-z]+){1,4}", 0.9),
        ("licensed", MENTION, "licen", "(?:re)?licen[sc]ed under(?: the)?(?: terms of)?", 0.3),
        ("licensed", MENTION, "licen", "see (?:the )?licen[sc]e file", 0.3),
        ("noncommercial", MENTION, "commercial", "(?:for )?non ?commercial (?:use|purposes) only", 0.5),
        ("research-only", MENTION, "research", "(?:for )?(?:academic )?research (?:use|purposes) only", 0.5),
    )
    return [Rule(*row) for row in rows]


def _bodies() -> list[Rule]:
    """Sentences that stand in the text of one license: (label, gate, words)."""
    rows = (
        # fixed values: sentences of published license texts
        ("gpl-2", "take away your freedom", "the licen[sc]es for most software are designed to take away your freedom to share and change it"),
        ("gpl-2", "verbatim copies", "you may copy and distribute verbatim copies of the program s source code as you receive it"),
        ("gpl-2", "modify your copy", "you may modify your copy or copies of the program or any portion of it thus forming a work based on the program"),
        ("gpl-3", "copyleft", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
        ("gpl-3", "circumvention", "protecting users legal rights from anti circumvention law"),
        ("gpl-3", "convey", "to convey a work means any kind of propagation that enables other parties to make or receive copies"),
        ("gpl", "program is free", "this program is free software you can redistribute it and or modify it"),
        ("gpl", "without any warranty", "(?:but )?without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
        ("agpl-3", "interacting", "your modified version must prominently offer all users interacting with it remotely"),
        ("agpl-3", "network server", "designed specifically to ensure cooperation with the community in the case of network server software"),
        ("lgpl-2.1", "specially designated", "the lesser general public licen[sc]e applies to some specially designated software packages"),
        ("lgpl-3", "incorporates", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e"),
        ("lgpl", "library is free", "this library is free software you can redistribute it and or modify it"),
        ("fdl", "textbook", "the purpose of this licen[sc]e is to make a manual textbook or other functional and useful document free in the sense of freedom"),
        ("fdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
        ("fsf-text", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
        ("apache-2", "applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
        ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
        ("apache-2", "compliance", "you may not use this file except in compliance with the licen[sc]e"),
        ("apache-2", "apache", "(?:http|https) www apache org licen[sc]es licen[sc]e 2 0"),
        ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
        ("apache-1.0", "apache", "this product includes software developed by the apache group"),
        ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
        ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("mpl-2", "incompatible", "this source code form is incompatible with secondary licen[sc]es"),
        ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
        ("epl-1", "eclipse", "the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
        ("epl-2", "eclipse", "the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0"),
        ("epl", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
        ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
        ("cpl", "common public", "the accompanying program is provided under the terms of this common public licen[sc]e"),
        ("cc-by", "appropriate credit", "you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
        ("cc-by", "medium or format", "(?:share )?copy and redistribute the material in any medium or format"),
        ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e as the original"),
        ("cc-by-nc", "commercial purposes", "you may not use the material for commercial purposes"),
        ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
        ("cc0-1.0", "neighboring", "has waived all copyright and related or neighboring rights"),
        ("cc0-1.0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
        ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", "noninfringement", "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
        ("x11", "x consortium", "the name of the x consortium shall not be used in advertising"),
        ("bsd", "source code must", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd", "binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        ("bsl-1", "accompanying documentation", "any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
        ("zlib", "plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
        ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
        ("ofl-1.1", "font", "the goals of the open font licen[sc]e ofl are to stimulate worldwide development of collaborative font projects"),
        ("ofl-1.1", "font software", "this font software is licensed under the sil open font licen[sc]e"),
        ("wtfpl", "you just do", "you just do what the fuck you want to"),
        ("artistic-1", "artistic control", "some semblance of artistic control over the development of the package"),
        ("psf-2", "psf", "psf is making python available to licensee on an as is basis"),
        ("eupl", "eupl", "licensed under the eupl"),
        ("ms-pl", "accept this", "if you use the software you accept this licen[sc]e if you do not accept the licen[sc]e do not use the software"),
        ("openssl", "openssl", "this product includes software developed by the openssl project"),
        ("json", "good not evil", "the software shall be used for good not evil"),
        ("sleepycat", "sleepycat", "the sleepycat (?:public )?licen[sc]e"),
        ("odbl-1.0", "database", "this database is made available under the open database licen[sc]e"),
        ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    )
    return [Rule(label, EXACT, gate, pattern, 1.0) for label, gate, pattern in rows]


RULES: tuple[Rule, ...] = tuple(_gnu() + _creative_commons() + _versioned() + _plain() + _bodies())

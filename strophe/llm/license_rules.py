"""Signature rules for license texts, written over words: lower case, one blank between words.

``compiled`` turns a rule's pattern into one for the normal form of ``licenses``, where every word
stands between two blanks of its own. A rule has a keyword, a word that all its matches contain. Lower tiers win over higher ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TAG, TEXT, NOTICE, TITLE, PHRASE = range(5)
#: How sure a label is, by tier.
CONFIDENCE = (1.0, 0.95, 0.9, 0.7, 0.5)

# SPDX identifier, keyword, and the title as it stands in running text.
LICENSES = (
    ("Apache-1.0", "apache", r"apache licen[cs]e(?: version)? v?1 0"),
    ("Apache-1.1", "apache", r"apache licen[cs]e(?: version)? v?1 1"),
    ("Apache-2.0", "apache", r"apache licen[cs]e(?: version)? v?2(?: 0)?"),
    ("GPL-1.0", "gnu", r"gnu general public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("GPL-2.0", "gnu", r"gnu general public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("GPL-3.0", "gnu", r"gnu general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("GPL-2.0-or-later", "gnu", r"gnu general public licen[cs]e(?: version)? v?2(?: 0)?(?: of the licen[cs]e)? or(?: at your option)?(?: any)? later(?: version)?"),
    ("GPL-3.0-or-later", "gnu", r"gnu general public licen[cs]e(?: version)? v?3(?: 0)?(?: of the licen[cs]e)? or(?: at your option)?(?: any)? later(?: version)?"),
    ("LGPL-2.0", "gnu", r"gnu (?:library|lesser) general public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("LGPL-2.1", "gnu", r"gnu lesser general public licen[cs]e(?: version)? v?2 1"),
    ("LGPL-3.0", "gnu", r"gnu lesser general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("LGPL-2.1-or-later", "gnu", r"gnu lesser general public licen[cs]e(?: version)? v?2 1(?: of the licen[cs]e)? or(?: at your option)?(?: any)? later(?: version)?"),
    ("AGPL-1.0", "affero", r"affero general public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("AGPL-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("AGPL-3.0-or-later", "affero", r"gnu affero general public licen[cs]e(?: version)? v?3(?: 0)?(?: of the licen[cs]e)? or(?: at your option)?(?: any)? later(?: version)?"),
    ("GFDL-1.1", "documentation", r"gnu free documentation licen[cs]e(?: version)? v?1 1"),
    ("GFDL-1.2", "documentation", r"gnu free documentation licen[cs]e(?: version)? v?1 2"),
    ("GFDL-1.3", "documentation", r"gnu free documentation licen[cs]e(?: version)? v?1 3"),
    ("MIT", "mit", r"mit licen[cs]e"),
    ("MIT-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("X11", "x11", r"(?:mit )?x11 licen[cs]e"),
    ("Expat", "expat", r"expat licen[cs]e"),
    ("ISC", "isc", r"isc licen[cs]e"),
    ("0BSD", "bsd", r"(?:bsd )?zero clause bsd(?: licen[cs]e)?"),
    ("BSD-1-Clause", "bsd", r"(?:1|one) clause bsd(?: licen[cs]e)?"),
    ("BSD-2-Clause", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?"),
    ("BSD-3-Clause", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("BSD-4-Clause", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("BSD-2-Clause-FreeBSD", "freebsd", r"(?:simplified bsd )?freebsd licen[cs]e"),
    ("BSD-New", "bsd", r"(?:the )?new bsd licen[cs]e"),
    ("BSD-Simplified", "bsd", r"simplified bsd licen[cs]e"),
    ("BSD", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("MPL-1.0", "mozilla", r"mozilla public licen[cs]e(?: version)? v?1 0"),
    ("MPL-1.1", "mozilla", r"mozilla public licen[cs]e(?: version)? v?1 1"),
    ("MPL-2.0", "mozilla", r"mozilla public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("EPL-1.0", "eclipse", r"eclipse public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("EPL-2.0", "eclipse", r"eclipse public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("EDL-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: version)? v?1(?: 0)?"),
    ("CDDL-1.0", "distribution", r"common development and distribution licen[cs]e(?: version)? v?1(?: 0)?"),
    ("CDDL-1.1", "distribution", r"common development and distribution licen[cs]e(?: version)? v?1 1"),
    ("CPL-1.0", "common", r"common public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("CPAL-1.0", "common", r"common public attribution licen[cs]e(?: version)? v?1(?: 0)?"),
    ("IPL-1.0", "ibm", r"ibm public licen[cs]e(?: version)? v?1(?: 0)?"),
    ("EUPL-1.1", "european", r"european union public licen[cs]e(?: version)? v?1 1"),
    ("EUPL-1.2", "european", r"european union public licen[cs]e(?: version)? v?1 2"),
    ("OSL-2.1", "software", r"open software licen[cs]e(?: version)? v?2 1"),
    ("OSL-3.0", "software", r"open software licen[cs]e(?: version)? v?3(?: 0)?"),
    ("AFL-2.1", "academic", r"academic free licen[cs]e(?: version)? v?2 1"),
    ("AFL-3.0", "academic", r"academic free licen[cs]e(?: version)? v?3(?: 0)?"),
    ("ECL-2.0", "educational", r"educational community licen[cs]e(?: version)? v?2(?: 0)?"),
    ("BSL-1.0", "boost", r"boost software licen[cs]e(?: version)?(?: v?1(?: 0)?)?"),
    ("BUSL-1.1", "business", r"business source licen[cs]e(?: version)?(?: v?1 1)?"),
    ("SSPL-1.0", "server", r"server side public licen[cs]e(?: version)?(?: v?1)?"),
    ("Elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)? v?2(?: 0)?"),
    ("Artistic-1.0", "artistic", r"artistic licen[cs]e(?: version)? v?1(?: 0)?"),
    ("Artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? v?2(?: 0)?"),
    ("Artistic", "artistic", r"perl artistic licen[cs]e"),
    ("Zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng-2.0", "libpng", r"libpng licen[cs]e(?: version)? v?2(?: 0)?"),
    ("OpenSSL", "openssl", r"openssl licen[cs]e"),
    ("PHP-3.01", "php", r"php licen[cs]e(?: version)? v?3 01"),
    ("PSF-2.0", "python", r"python software foundation licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("Python-2.0", "python", r"python licen[cs]e(?: version)? v?2(?: 0)?"),
    ("Ruby", "ruby", r"ruby licen[cs]e"),
    ("Unlicense", "unlicense", r"(?:the )?unlicense"),
    ("WTFPL", "wtfpl", r"wtfpl(?: v?2)?"),
    ("Beerware", "beer", r"beer ware licen[cs]e(?: revision 42)?"),
    ("Vim", "vim", r"vim licen[cs]e"),
    ("NCSA", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("PostgreSQL", "postgresql", r"postgresql licen[cs]e"),
    ("TCL", "tcl", r"tcl(?: tk)? licen[cs]e"),
    ("CECILL-2.1", "cecill", r"cecill(?: free software licen[cs]e)?(?: agreement)?(?: version)?(?: v?2 1)?"),
    ("CECILL-B", "cecill", r"cecill b(?: free software licen[cs]e)?(?: agreement)?"),
    ("CECILL-C", "cecill", r"cecill c(?: free software licen[cs]e)?(?: agreement)?"),
    ("MS-PL", "microsoft", r"microsoft public licen[cs]e"),
    ("MS-RL", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("APSL-2.0", "apple", r"apple public source licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("SPL-1.0", "sun", r"sun public licen[cs]e(?: version)?(?: v?1(?: 0)?)?"),
    ("NPL-1.1", "netscape", r"netscape public licen[cs]e(?: version)?(?: v?1(?: 1)?)?"),
    ("QPL-1.0", "q", r"q public licen[cs]e(?: version)?(?: v?1(?: 0)?)?"),
    ("LPPL-1.3c", "latex", r"latex project public licen[cs]e(?: version)?(?: v?1 3c?)?"),
    ("OFL-1.1", "font", r"(?:sil )?open font licen[cs]e(?: version)?(?: v?1 1)?"),
    ("OGL-UK-3.0", "government", r"open government licen[cs]e(?: version)?(?: v?3(?: 0)?)?"),
    ("ODbL-1.0", "database", r"open database licen[cs]e(?: odbl)?(?: version)?(?: v?1(?: 0)?)?"),
    ("ODC-By-1.0", "commons", r"open data commons attribution licen[cs]e(?: version)?(?: v?1(?: 0)?)?"),
    ("PDDL-1.0", "dedication", r"(?:open data commons )?public domain dedication and licen[cs]e(?: version)?(?: v?1(?: 0)?)?"),
    ("CDLA-Permissive-2.0", "community", r"community data licen[cs]e agreement permissive(?: version)?(?: v?2(?: 0)?)?"),
    ("CDLA-Sharing-1.0", "community", r"community data licen[cs]e agreement sharing(?: version)?(?: v?1(?: 0)?)?"),
    ("MulanPSL-2.0", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: version)?(?: v?2(?: 0)?)?"),
    ("BlueOak-1.0.0", "oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("Parity-7.0.0", "parity", r"parity public licen[cs]e(?: 7 0 0)?"),
    ("OpenRAIL-M", "openrail", r"(?:creativeml )?openrail(?: m)?(?: licen[cs]e)?"),
    ("Llama-2", "llama", r"llama 2 community licen[cs]e(?: agreement)?"),
    ("Llama-3", "llama", r"(?:meta )?llama 3(?: [0-9])? community licen[cs]e(?: agreement)?"),
    ("Gemma", "gemma", r"gemma terms of use"),
    ("CC0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("CC-BY-1.0", "cc", r"cc by 1 0"),
    ("CC-BY-2.0", "cc", r"cc by 2 0"),
    ("CC-BY-2.5", "cc", r"cc by 2 5"),
    ("CC-BY-3.0", "cc", r"cc by 3 0"),
    ("CC-BY-4.0", "cc", r"cc by 4 0"),
    ("CC-BY-SA-2.0", "cc", r"cc by sa 2 0"),
    ("CC-BY-SA-3.0", "cc", r"cc by sa 3 0"),
    ("CC-BY-SA-4.0", "cc", r"cc by sa 4 0"),
    ("CC-BY-NC-2.0", "cc", r"cc by nc 2 0"),
    ("CC-BY-NC-3.0", "cc", r"cc by nc 3 0"),
    ("CC-BY-NC-4.0", "cc", r"cc by nc 4 0"),
    ("CC-BY-ND-3.0", "cc", r"cc by nd 3 0"),
    ("CC-BY-ND-4.0", "cc", r"cc by nd 4 0"),
    ("CC-BY-NC-SA-3.0", "cc", r"cc by nc sa 3 0"),
    ("CC-BY-NC-SA-4.0", "cc", r"cc by nc sa 4 0"),
    ("CC-BY-NC-ND-3.0", "cc", r"cc by nc nd 3 0"),
    ("CC-BY-NC-ND-4.0", "cc", r"cc by nc nd 4 0"),
)

# Sentences and short names; (label, tier, keyword, pattern).
SIGNATURES = (
    ("MIT", TEXT, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", TEXT, "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ISC", TEXT, "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD", TEXT, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD-2-Clause", TEXT, "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-2-Clause", TEXT, "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-3-Clause", TEXT, "contributors", r"neither the names? of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-4-Clause", TEXT, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("Apache-2.0", TEXT, "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("Apache-2.0", TEXT, "apache", r"(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("GPL", TEXT, "gnu", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("GPL-2.0-or-later", TEXT, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2"),
    ("GPL-3.0-or-later", TEXT, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3"),
    ("LGPL", TEXT, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("AGPL", TEXT, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("MPL-2.0", TEXT, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("EPL-2.0", TEXT, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("BSL-1.0", TEXT, "boost", r"(?:https? )?www boost org license 1 0 txt"),
    ("Unlicense", TEXT, "domain", r"this is free and unencumbered software released into the public domain"),
    ("CC0-1.0", TEXT, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("CC-BY-4.0", TEXT, "creativecommons", r"creativecommons org licenses by 4 0"),
    ("CC-BY-3.0", TEXT, "creativecommons", r"creativecommons org licenses by 3 0"),
    ("CC-BY-SA-4.0", TEXT, "creativecommons", r"creativecommons org licenses by sa 4 0"),
    ("CC-BY-SA-3.0", TEXT, "creativecommons", r"creativecommons org licenses by sa 3 0"),
    ("CC-BY-NC-4.0", TEXT, "creativecommons", r"creativecommons org licenses by nc 4 0"),
    ("CC-BY-NC-SA-4.0", TEXT, "creativecommons", r"creativecommons org licenses by nc sa 4 0"),
    ("CC-BY-ND-4.0", TEXT, "creativecommons", r"creativecommons org licenses by nd 4 0"),
    ("CC-BY-NC-ND-4.0", TEXT, "creativecommons", r"creativecommons org licenses by nc nd 4 0"),
    ("CC-BY-4.0", TITLE, "creative", r"creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("CC-BY-3.0", TITLE, "creative", r"creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?"),
    ("CC-BY-SA-4.0", TITLE, "creative", r"creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("CC-BY-SA-3.0", TITLE, "creative", r"creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?"),
    ("CC-BY-NC-4.0", TITLE, "creative", r"creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("CC-BY-NC-SA-4.0", TITLE, "creative", r"creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("CC-BY-ND-4.0", TITLE, "creative", r"creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("CC-BY-NC-ND-4.0", TITLE, "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("Creative-Commons", PHRASE, "creative", r"creative commons(?: attribution)?(?: licen[cs]e)?"),
    ("CC-BY-SA", PHRASE, "cc", r"cc by sa"),
    ("CC-BY-NC", PHRASE, "cc", r"cc by nc"),
    ("CC-BY-ND", PHRASE, "cc", r"cc by nd"),
    ("CC-BY-NC-SA", PHRASE, "cc", r"cc by nc sa"),
    ("CC-BY-NC-ND", PHRASE, "cc", r"cc by nc nd"),
    ("GPL-2.0", TITLE, "gpl", r"gpl v?2(?: 0)?(?: only)?"),
    ("GPL-2.0", TITLE, "gplv2", r"gplv2"),
    ("GPL-3.0", TITLE, "gpl", r"gpl v?3(?: 0)?(?: only)?"),
    ("GPL-3.0", TITLE, "gplv3", r"gplv3"),
    ("LGPL-2.1", TITLE, "lgpl", r"lgpl v?2 1(?: only)?"),
    ("LGPL-2.1", TITLE, "lgplv2", r"lgplv2 1"),
    ("LGPL-3.0", TITLE, "lgpl", r"lgpl v?3(?: 0)?(?: only)?"),
    ("LGPL-3.0", TITLE, "lgplv3", r"lgplv3"),
    ("AGPL-3.0", TITLE, "agpl", r"agpl v?3(?: 0)?(?: only)?"),
    ("AGPL-3.0", TITLE, "agplv3", r"agplv3"),
    ("LGPL", PHRASE, "gnu", r"gnu (?:lesser|library) general public licen[cs]e"),
    ("AGPL", PHRASE, "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("GFDL", PHRASE, "documentation", r"gnu free documentation licen[cs]e"),
    ("MPL", PHRASE, "mozilla", r"mozilla public licen[cs]e"),
    ("EPL", PHRASE, "eclipse", r"eclipse public licen[cs]e"),
    ("EUPL", PHRASE, "european", r"european union public licen[cs]e"),
    ("Public-Domain", NOTICE, "domain", r"(?:dedicated|released|placed)(?: [^ ]+){0,2} (?:in|to|into) the public domain"),
    ("Public-Domain", PHRASE, "domain", r"public domain"),
    ("Proprietary", NOTICE, "permission", r"without(?: the)?(?: prior)?(?: express)? written permission of(?: the)?(?: copyright)? (?:owner|holder|author|publisher)s?"),
    ("Proprietary", NOTICE, "reserved", r"all rights reserved(?: no part of this [^ ]+ may be (?:reproduced|copied))?"),
    ("Copyright", PHRASE, "copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)?[0-9][0-9])?"),
    ("Warranty-Disclaimer", NOTICE, "warranty", r"(?:is provided )?as is without warranty of any kind(?: express(?:ed)? or implied)?"),
    ("Warranty-Disclaimer", NOTICE, "warranties", r"(?:is provided )?as is without warranties of any kind(?: express(?:ed)? or implied)?"),
    ("Non-Commercial", NOTICE, "commercial", r"licen[cs]ed? for non commercial (?:use|purposes)(?: only)?"),
    ("Non-Commercial", NOTICE, "noncommercial", r"licen[cs]ed? for noncommercial (?:use|purposes)(?: only)?"),
)

# The base phrases with their labels.
BASE = (("gpl", "gnu", "gnu general public license"), ("apache", "apache", "apache license"), ("cc-by", "cc", "cc by"), ("mit", "mit", "mit license"))

NOTICE_BEFORE = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|used|shared)(?: [^ ]+){0,4} under(?: the)?(?: terms of)?(?: the)? "
OPENING = re.compile("[^0-9a-z]+")


@dataclass(frozen=True)
class Rule:
    """One signature: all its matches contain the word ``keyword``; the labels of ``base`` rules always stay."""

    label: str
    tier: int
    keyword: str
    pattern: str
    base: bool = False


def compiled(pattern: str) -> str:
    """The pattern for a text in which every word has a blank of its own before and after it."""
    wide = pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    return f" (?:{wide}) "


def rules() -> tuple[Rule, ...]:
    """All rules in their order: base phrases, sentences, then a tag, a notice and a title for every license."""
    out = [Rule(label, PHRASE, keyword, phrase, True) for label, keyword, phrase in BASE]
    out += [Rule(label.lower(), tier, keyword, pattern) for label, tier, keyword, pattern in SIGNATURES]
    for name, keyword, title in LICENSES:
        tag = OPENING.sub(" ", name.lower()).strip()
        out.append(Rule(name.lower(), TAG, "spdx", f"spdx license identifier {tag}(?: only)?"))
        out.append(Rule(name.lower(), NOTICE, keyword, f"{NOTICE_BEFORE}(?:{title})"))
        out.append(Rule(name.lower(), TITLE, keyword, title))
    return tuple(out)


RULES = rules()

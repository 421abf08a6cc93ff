"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased, joined by single spaces. Rules are regular
expressions over that, gated by a keyword: a rule runs only on texts that contain
its keyword. Each detection is an interval of words; one inside another of a higher
priority is suppressed, as "gnu general public license" is by "gnu lesser ...
public license version 2 1 or later". The labels of the surviving rules are the
text's; phrases of the base list are counted apart and always stay.

Detections are rows of their own while they are compared: sorted by start, one
running maximum of ends per priority finds the containing ones, however many there are.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpus_catalog.llm.common import Work, let, lower_ascii

#: Phrases and labels of the base list, and what separates words.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Priorities: full names with a version, names, notices. Scores say how sure a rule is.
VERSIONED, NAMED, NOTICE = 3, 2, 1
SCORE = {VERSIONED: 1.0, NAMED: 0.9, NOTICE: 0.6}
_V = r"(?:version |v )?"
_LATER = r"(?: or (?:at your option )?(?:any )?later(?: version)?)?"

#: Families: keyword, name as an expression, label, versions.
_FAMILIES = [
    ("apache", r"apache (?:software )?licen[sc]e", "apache", "1.0 1.1 2.0"),
    ("gnu", r"gnu general public licen[sc]e", "gpl", "1 2 3"),
    ("gpl", r"(?:gnu )?gpl", "gpl", "1 2 3 1.0 2.0 3.0"),
    ("gnu", r"gnu (?:lesser|library) general public licen[sc]e", "lgpl", "2 2.0 2.1 3"),
    ("lgpl", r"(?:gnu )?lgpl", "lgpl", "2 2.0 2.1 3 3.0"),
    ("gnu", r"gnu affero general public licen[sc]e", "agpl", "1 3"),
    ("agpl", r"(?:gnu )?agpl", "agpl", "1 1.0 3 3.0"),
    ("gnu", r"gnu free documentation licen[sc]e", "gfdl", "1.1 1.2 1.3"),
    ("gfdl", r"gfdl", "gfdl", "1.1 1.2 1.3"),
    ("mozilla", r"mozilla public licen[sc]e", "mpl", "1.0 1.1 2.0"),
    ("mpl", r"mpl", "mpl", "1.0 1.1 2.0"),
    ("eclipse", r"eclipse public licen[sc]e", "epl", "1.0 2.0"),
    ("eclipse", r"eclipse distribution licen[sc]e", "edl", "1.0"),
    ("common", r"common development and distribution licen[sc]e", "cddl", "1.0 1.1"),
    ("cddl", r"cddl", "cddl", "1.0 1.1"),
    ("common", r"common public licen[sc]e", "cpl", "0.5 1.0"),
    ("ibm", r"ibm public licen[sc]e", "ipl", "1.0"),
    ("artistic", r"(?:perl )?artistic licen[sc]e", "artistic", "1.0 2.0"),
    ("boost", r"boost software licen[sc]e", "bsl", "1.0"),
    ("academic", r"academic free licen[sc]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("open", r"open software licen[sc]e", "osl", "1.0 1.1 2.0 2.1 3.0"),
    ("open", r"(?:sil )?open font licen[sc]e", "ofl", "1.0 1.1"),
    ("open", r"open data commons (?:open database|attribution) licen[sc]e", "odc", "1.0"),
    ("open", r"open government licen[sc]e", "ogl", "1.0 2.0 3.0"),
    ("european", r"european union public licen[sc]e", "eupl", "1.0 1.1 1.2"),
    ("eupl", r"eupl", "eupl", "1.0 1.1 1.2"),
    ("cecill", r"cecill(?: [bc])?", "cecill", "1.0 1.1 2.0 2.1"),
    ("python", r"python (?:software foundation )?licen[sc]e", "psf", "2 2.0"),
    ("php", r"php licen[sc]e", "php", "3.0 3.01"),
    ("zope", r"zope public licen[sc]e", "zpl", "1.1 2.0 2.1"),
    ("sun", r"sun public licen[sc]e", "spl", "1.0"),
    ("qt", r"qt public licen[sc]e", "qpl", "1.0"),
    ("reciprocal", r"(?:microsoft )?reciprocal (?:public )?licen[sc]e", "rpl", "1.1 1.5"),
    ("server", r"server side public licen[sc]e", "sspl", "1"),
    ("business", r"business source licen[sc]e", "busl", "1.1"),
    ("elastic", r"elastic licen[sc]e", "elastic", "2.0"),
    ("latex", r"latex project public licen[sc]e", "lppl", "1.0 1.1 1.2 1.3"),
    ("creative", r"creative commons zero", "cc0", "1.0"),
    ("cc0", r"cc0", "cc0", "1.0"),
]
#: Creative Commons: parts of the name, of the short form and of the label, by version.
_CREATIVE = [
    ("attribution", "cc by", "cc-by"),
    ("attribution share ?alike", "cc by sa", "cc-by-sa"),
    ("attribution no ?deriv(?:ative)?s?", "cc by nd", "cc-by-nd"),
    ("attribution non ?commercial", "cc by nc", "cc-by-nc"),
    ("attribution non ?commercial share ?alike", "cc by nc sa", "cc-by-nc-sa"),
    ("attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd", "cc-by-nc-nd"),
]
_CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Families whose short name is written together with its version, as in "gplv3".
_GLUED = {"gpl": "1 2 3", "lgpl": "2 2.0 2.1 3 3.0", "agpl": "1 3", "mpl": "1.0 1.1 2 2.0", "gfdl": "1.2 1.3", "cddl": "1 1.0 1.1", "eupl": "1.1 1.2", "epl": "1 1.0 2 2.0"}
#: Identifiers of the software package data exchange that follow "SPDX-License-Identifier:".
_IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "BUSL-1.1 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
    "GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 "
    "OSL-3.0 PostgreSQL Python-2.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim WTFPL X11 Zlib ZPL-2.1"
).split()
#: Rules without versions: keyword, expression, label, priority. Every text that an expression matches holds the keyword.
_OTHERS = [
    ("mit", r"(?:the )?mit licen[sc]e", "mit", NAMED),
    ("mit", r"licen[sc]ed under (?:the )?mit", "mit", NAMED),
    ("mit", r"mit licen[sc]ed", "mit", NAMED),
    ("mit", r"(?:the )?mit x11 licen[sc]e", "x11", NAMED),
    ("expat", r"(?:the )?expat licen[sc]e", "mit", NAMED),
    ("permission", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", NAMED),
    ("permission", r"permission to use copy modify and(?: or)? distribute this software", "isc", NAMED),
    ("permission", r"permission to use copy modify and distribute this software and its documentation", "hpnd", NAMED),
    ("permission", r"permission is granted to anyone to use this software for any purpose", "zlib", NAMED),
    ("permission", r"permission is granted to copy distribute and or modify this document", "gfdl", NAMED),
    ("permission", r"permission is hereby granted without written agreement", "permissive", NOTICE),
    ("permission", r"(?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission(?: of)?", "by-permission", NOTICE),
    ("permission", r"without (?:the )?(?:prior |express |written )*permission", "permission-needed", NOTICE),
    ("isc", r"(?:the )?isc licen[sc]e", "isc", NAMED),
    ("zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e", "zlib", NAMED),
    ("libpng", r"(?:the )?libpng licen[sc]e", "libpng", NAMED),
    ("bsd", r"(?:the )?(?:modified |simplified |new |revised )?bsd licen[sc]e", "bsd", NAMED),
    ("bsd", r"bsd licen[sc]ed", "bsd", NAMED),
    ("bsd", r"(?:a )?bsd style licen[sc]e", "bsd", NAMED),
    ("bsd", r"(?:the )?bsd (?:2|two) clause(?: licen[sc]e)?", "bsd-2-clause", VERSIONED),
    ("bsd", r"(?:the )?bsd (?:3|three) clause(?: licen[sc]e)?", "bsd-3-clause", VERSIONED),
    ("bsd", r"(?:the )?bsd (?:4|four) clause(?: licen[sc]e)?", "bsd-4-clause", VERSIONED),
    ("bsd", r"(?:the )?(?:zero|0) clause bsd(?: licen[sc]e)?", "0bsd", VERSIONED),
    ("clause", r"(?:2|two) clause bsd(?: licen[sc]e)?", "bsd-2-clause", VERSIONED),
    ("clause", r"(?:3|three) clause bsd(?: licen[sc]e)?", "bsd-3-clause", VERSIONED),
    ("freebsd", r"(?:the )?freebsd licen[sc]e", "bsd-2-clause", NAMED),
    ("netbsd", r"(?:the )?netbsd licen[sc]e", "bsd-2-clause", NAMED),
    ("openbsd", r"(?:the )?openbsd licen[sc]e", "isc", NAMED),
    ("redistribution", r"redistribution and use in source and binary forms", "bsd", NAMED),
    ("redistributions", r"redistributions of source code must retain the above copyright notice", "bsd", NAMED),
    ("redistributions", r"redistributions in binary form must reproduce the above copyright notice", "bsd", NAMED),
    ("neither", r"neither the name of .+? nor the names of (?:its|any) contributors", "bsd-3-clause", NAMED),
    ("advertising", r"all advertising materials mentioning features or use of this software", "bsd-4-clause", NAMED),
    ("unlicense", r"(?:the )?unlicense", "unlicense", NAMED),
    ("unencumbered", r"free and unencumbered software released into the public domain", "unlicense", NAMED),
    ("wtfpl", r"wtfpl", "wtfpl", NAMED),
    ("want", r"do what the f\w+ you want to public licen[sc]e", "wtfpl", NAMED),
    ("beerware", r"beerware licen[sc]e", "beerware", NAMED),
    ("beer", r"beer ware licen[sc]e", "beerware", NAMED),
    ("beer", r"buy me a beer in return", "beerware", NAMED),
    ("openssl", r"openssl licen[sc]e", "openssl", NAMED),
    ("ssleay", r"(?:the )?(?:original )?ssleay licen[sc]e", "openssl", NAMED),
    ("ruby", r"ruby(?: s)? licen[sc]e", "ruby", NAMED),
    ("microsoft", r"microsoft public licen[sc]e", "ms-pl", NAMED),
    ("ms", r"ms (?:pl|rl)", "ms-pl", NAMED),
    ("psf", r"psf licen[sc]e(?: agreement)?", "psf", NAMED),
    ("cnri", r"cnri (?:open source )?licen[sc]e(?: agreement)?", "cnri", NAMED),
    ("public", r"q public licen[sc]e", "qpl", NAMED),
    ("vim", r"(?:the )?vim licen[sc]e", "vim", NAMED),
    ("curl", r"(?:the )?curl licen[sc]e", "curl", NAMED),
    ("postgresql", r"(?:the )?postgresql licen[sc]e", "postgresql", NAMED),
    ("ncsa", r"(?:university of illinois )?(?:illinois )?ncsa (?:open source )?licen[sc]e", "ncsa", NAMED),
    ("universal", r"universal permissive licen[sc]e", "upl", NAMED),
    ("eclipse", r"eclipse foundation software user agreement", "epl", NAMED),
    ("unicode", r"unicode (?:data files and software )?licen[sc]e(?: agreement)?", "unicode", NAMED),
    ("icu", r"icu licen[sc]e", "icu", NAMED),
    ("x11", r"(?:the )?x11 licen[sc]e", "x11", NAMED),
    ("x", r"x consortium licen[sc]e", "x11", NAMED),
    ("w3c", r"w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e", "w3c", NAMED),
    ("json", r"(?:the )?json licen[sc]e", "json", NAMED),
    ("evil", r"shall be used for good not evil", "json", NAMED),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat", NAMED),
    ("blue", r"blue oak model licen[sc]e", "blue-oak", NAMED),
    ("hippocratic", r"hippocratic licen[sc]e", "hippocratic", NAMED),
    ("commons", r"commons clause(?: licen[sc]e)?(?: condition)?", "commons-clause", NAMED),
    ("polyform", r"polyform (?:noncommercial|strict|shield|perimeter|small business|free trial) licen[sc]e", "polyform", NAMED),
    ("prosperity", r"prosperity public licen[sc]e", "prosperity", NAMED),
    ("parity", r"parity public licen[sc]e", "parity", NAMED),
    ("confluent", r"confluent community licen[sc]e", "confluent", NAMED),
    ("redis", r"redis source available licen[sc]e", "rsal", NAMED),
    ("timescale", r"timescale licen[sc]e", "tsl", NAMED),
    ("cockroach", r"cockroach community licen[sc]e", "ccl", NAMED),
    ("mulan", r"mulan (?:permissive software|public|psl) licen[sc]e", "mulan", NAMED),
    ("cecill", r"cecill (?:free software )?licen[sc]e", "cecill", NAMED),
    ("openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?", "openrail", NAMED),
    ("llama", r"llama (?:2|3) community licen[sc]e(?: agreement)?", "llama", NAMED),
    ("odbl", r"odbl", "odc", NAMED),
    ("pddl", r"pddl", "pddl", NAMED),
    ("database", r"open database licen[sc]e", "odc", NAMED),
    ("commons", r"public domain dedication and licen[sc]e open data commons", "pddl", NAMED),
    ("etalab", r"(?:licence ouverte )?etalab(?: open licen[sc]e)?", "etalab", NAMED),
    ("peer", r"peer production licen[sc]e", "ppl", NAMED),
    ("art", r"free art licen[sc]e", "fal", NAMED),
    ("fsf", r"fsf all permissive licen[sc]e", "fsfap", NAMED),
    ("bitstream", r"bitstream vera(?: font)? licen[sc]e", "bitstream-vera", NAMED),
    ("ubuntu", r"ubuntu font licen[sc]e", "ufl", NAMED),
    ("adobe", r"adobe (?:glyph list|utopia|source code) licen[sc]e", "adobe", NAMED),
    ("apple", r"apple public source licen[sc]e", "apsl", NAMED),
    ("nokia", r"nokia open source licen[sc]e", "nosl", NAMED),
    ("intel", r"intel open source licen[sc]e", "intel", NAMED),
    ("nasa", r"nasa open source agreement", "nasa", NAMED),
    ("lucent", r"lucent public licen[sc]e", "lpl", NAMED),
    ("realnetworks", r"realnetworks public source licen[sc]e", "rpsl", NAMED),
    ("sybase", r"sybase open watcom public licen[sc]e", "watcom", NAMED),
    ("ricoh", r"ricoh source code public licen[sc]e", "rscpl", NAMED),
    ("motosoto", r"motosoto open source licen[sc]e", "motosoto", NAMED),
    ("attribution", r"attribution assurance licen[sc]e", "aal", NAMED),
    ("fair", r"(?:the )?fair licen[sc]e", "fair", NAMED),
    ("frameworx", r"frameworx open licen[sc]e", "frameworx", NAMED),
    ("jabber", r"jabber open source licen[sc]e", "jabber", NAMED),
    ("netscape", r"netscape public licen[sc]e", "npl", NAMED),
    ("nethack", r"nethack general public licen[sc]e", "ngpl", NAMED),
    ("simple", r"simple public licen[sc]e", "simpl", NAMED),
    ("sissl", r"sissl", "sissl", NAMED),
    ("standards", r"sun industry standards source licen[sc]e", "sissl", NAMED),
    ("vovida", r"vovida software licen[sc]e", "vsl", NAMED),
    ("xnet", r"xnet licen[sc]e", "xnet", NAMED),
    ("condor", r"condor public licen[sc]e", "condor", NAMED),
    ("docbook", r"docbook licen[sc]e", "docbook", NAMED),
    ("opl", r"(?:open publication licen[sc]e )?opl(?: licen[sc]e)?", "opl", NAMED),
    ("publication", r"open publication licen[sc]e", "opl", NAMED),
    ("content", r"open content licen[sc]e", "opencontent", NAMED),
    ("gutenberg", r"(?:full )?project gutenberg(?: tm)? licen[sc]e", "gutenberg", NAMED),
    ("domain", r"(?:released|placed|dedicated|put) (?:into|to|in) the public domain", "public-domain", NAMED),
    ("domain", r"public domain dedication", "public-domain", NAMED),
    ("domain", r"(?:is|are) in the public domain", "public-domain", NAMED),
    ("waived", r"waived all copyright and related or neighboring rights", "cc0", NAMED),
    ("copyleft", r"copyleft (?:licen[sc]e|all wrongs reserved)", "copyleft", NOTICE),
    ("wrongs", r"all wrongs reserved", "copyleft", NOTICE),
    ("spdx", r"spdx license identifier(?: [0-9a-z]+){1,4}", "spdx", NOTICE),
    ("spdx", r"spdx filecopyrighttext", "copyright", NOTICE),
    ("under", r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?[0-9a-z]+(?: [0-9a-z]+){0,3}? licen[sc]e", "licensed", NOTICE),
    ("under", r"distributed under (?:the )?(?:terms of )?(?:the )?[0-9a-z]+(?: [0-9a-z]+){0,3}? licen[sc]e", "licensed", NOTICE),
    ("under", r"(?:available|published|released) under (?:the )?(?:terms of )?(?:the )?[0-9a-z]+(?: [0-9a-z]+){0,3}? licen[sc]e", "licensed", NOTICE),
    ("terms", r"subject to the (?:licen[sc]e )?terms (?:and conditions )?of", "terms", NOTICE),
    ("copying", r"see (?:the )?(?:file )?copying(?: file)? for (?:more )?details", "see-file", NOTICE),
    ("file", r"see (?:the )?(?:accompanying )?licen[sc]e file", "see-file", NOTICE),
    ("eula", r"(?:end user licen[sc]e agreement )?eula", "eula", NOTICE),
    ("agreement", r"end user licen[sc]e agreement", "eula", NOTICE),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", NOTICE),
    ("copyright", r"copyright holders?", "copyright", NOTICE),
    ("copyright", r"this copyright notice", "copyright", NOTICE),
    ("copyrighted", r"copyrighted (?:material|work|content)", "copyright", NOTICE),
    ("warranty", r"without (?:any )?warranty(?: of any kind)?", "no-warranty", NOTICE),
    ("warranty", r"absolutely no warranty", "no-warranty", NOTICE),
    ("warranties", r"without warranties or conditions of any kind", "no-warranty", NOTICE),
    ("warranties", r"implied warranties of merchantability", "no-warranty", NOTICE),
    ("liable", r"be liable for any (?:claim|direct|indirect|special|damages)", "no-liability", NOTICE),
    ("reserved", r"(?:some|no) rights reserved", "some-rights", NOTICE),
    ("noncommercial", r"(?:for )?noncommercial (?:use|purposes) only", "non-commercial", NOTICE),
    ("commercial", r"(?:for )?non commercial (?:use|purposes) only", "non-commercial", NOTICE),
    ("commercial", r"not for commercial (?:use|purposes)", "non-commercial", NOTICE),
    ("personal", r"(?:for )?personal use only", "personal-use", NOTICE),
    ("educational", r"(?:for )?educational (?:use|purposes) only", "educational-use", NOTICE),
    ("evaluation", r"(?:for )?evaluation (?:use|purposes) only", "evaluation-use", NOTICE),
    ("internal", r"(?:for )?internal use only", "internal-use", NOTICE),
    ("confidential", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", NOTICE),
    ("proprietary", r"proprietary (?:licen[sc]e|information|software)", "proprietary", NOTICE),
    ("secret", r"(?:contains )?trade secret(?: information)?", "proprietary", NOTICE),
    ("copied", r"may not be copied", "no-redistribution", NOTICE),
    ("copy", r"may not copy", "no-redistribution", NOTICE),
    ("redistributed", r"may not be redistributed", "no-redistribution", NOTICE),
    ("redistribute", r"may not redistribute", "no-redistribution", NOTICE),
    ("reproduced", r"(?:may not|no part of this \w+ may) be reproduced", "no-redistribution", NOTICE),
    ("resale", r"not for resale", "no-redistribution", NOTICE),
]


def rules() -> list[tuple[str, str, str, int]]:
    """All rules in order, most specific first: keyword, expression, label, priority.

    Versions of a family and of Creative Commons, and identifiers, are spelled out from the tables above.
    """
    found = []
    for keyword, name, label, versions in _FAMILIES:
        for version in sorted(versions.split(), key=len, reverse=True):
            words = version.replace(".", " ")
            found.append((keyword, f"{name} {_V}{words}{_LATER}", f"{label}-{version}", VERSIONED))
        found.append((keyword, name, label, NAMED))
    for short, versions in _GLUED.items():
        for version in sorted(versions.split(), key=len, reverse=True):
            major, _, minor = version.partition(".")
            found.append((f"{short}v{major}", f"{short}v{major}{f' {minor}' if minor else ''}{_LATER}", f"{short}-{version}", VERSIONED))
    for name in _IDENTIFIERS:
        words = re.sub("[^0-9a-z]+", " ", name.lower())
        found.append(("spdx", f"spdx license identifier {words}", name.lower(), VERSIONED))
    for (name, short, label), version in product(_CREATIVE, _CREATIVE_VERSIONS.split()):
        words = version.replace(".", " ")
        found.append(("creative", f"creative commons {name}(?: licen[sc]e)? {_V}{words}", f"{label}-{version}", VERSIONED))
        found.append(("cc", f"{short} {_V}{words}", f"{label}-{version}", VERSIONED))
    for name, short, label in _CREATIVE:
        found.append(("creative", f"creative commons {name}", label, NAMED))
        found.append(("cc", short, label, NAMED))
    return found + _OTHERS


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(text: Column, phrase: str) -> Column:
    """Count, first and last word of a phrase in ``text``, whose words have two spaces between."""
    wide = f" {phrase.replace(' ', '  ')} "
    count = ((F.length(text) - F.length(F.replace(text, F.lit(wide), F.lit("")))) / len(wide)).cast("long")
    begin = F.locate(wide, text)
    end = F.length(text) - F.length(F.substring_index(text, wide, -1))  # after the last one
    first = (_spaces(F.substring(text, F.lit(1), begin - 1)) / 2).cast("long")
    last = (_spaces(F.substring(text, F.lit(1), end)) / 2).cast("long") - len(phrase.split())
    return F.when(
        text.contains(wide), F.struct(count.alias("n"), first.alias("first"), last.alias("last"))
    ).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))


def _none() -> Column:
    return F.array().cast("array<struct<label: string, priority: int, start: int, stop: int>>")


def _detections(text: Column, held: Column) -> Column:
    """``label, priority, start, stop`` of every match in ``text``, words with single spaces around them; ``held`` are its keywords."""
    groups: dict[str, list] = {}
    for keyword, expression, label, priority in rules():
        groups.setdefault(keyword, []).append((rf"(?<= ){expression}(?= )", label, priority))

    def in_text(expression: str, label: str, priority: int) -> Column:
        marked = F.split(F.trim(F.regexp_replace(text, expression, "\x01$0\x02")), " ")

        def intervals(w: Column) -> Column:
            starts = F.filter(F.transform(w, lambda x, i: F.when(x.startswith("\x01"), i)), lambda i: i.isNotNull())
            stops = F.filter(F.transform(w, lambda x, i: F.when(x.endswith("\x02"), i)), lambda i: i.isNotNull())
            return F.zip_with(
                starts, stops,
                lambda a, b: F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), a.alias("start"), b.alias("stop")),
            )

        return F.when(text.rlike(expression), let(marked, intervals)).otherwise(_none())

    parts = []
    for keyword, own in groups.items():
        found = F.concat(*(in_text(*rule) for rule in own))
        parts.append(F.when(F.array_contains(held, keyword), found).otherwise(_none()))
    return F.concat(*parts)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase.
    The score is that of the surest label, 0 without any. Null and empty texts have no words and
    no labels. Null ids and repeated rows are judged like others; an empty table gives an empty one; other columns aren't read.
    """
    with Work(docs.sparkSession, "licenses") as work:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        body = F.trim(F.regexp_replace(lower_ascii(text), BETWEEN, "  "))
        wide = docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text, F.octet_length(text)).alias("text_key"),
            F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(" "), body, F.lit(" "))).alias("t"),
        )
        keywords = F.array(*map(F.lit, sorted({r[0] for r in rules()})))

        def detected(single: Column) -> Column:
            held = F.array_intersect(F.split(F.trim(single), " "), keywords)
            return let(held, lambda h: F.when(F.size(h) > 0, _detections(single, h)).otherwise(_none()))

        places = F.struct(*(_places(F.col("t"), p).alias(l.replace("-", "_")) for p, l in BASE.items()))
        scanned = work.keep(
            wide.select("doc_id", "text_key", "t", (_spaces(F.col("t")) / 2).cast("long").alias("n_words"), places.alias("p"))
            .select(
                "doc_id", "text_key", "n_words", "p.*",
                let(F.replace("t", F.lit("  "), F.lit(" ")), detected).alias("found"),
            ),
            "scanned",
        )
        found = scanned.filter(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("d"))
        found = found.select("doc_id", "text_key", "d.*").distinct()
        ahead = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("stop"), F.desc("priority"), "label")
        earlier = Window.partitionBy("doc_id", "text_key").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
        covered = F.lit(False)
        for p in SCORE:  # by a higher priority, or by a longer one of the same
            stop = F.when(F.col("priority") >= p, F.col("stop"))
            end = F.max(stop).over(ahead)
            longer = (end > F.col("stop")) | F.coalesce(F.max(stop).over(earlier) >= F.col("stop"), F.lit(False))
            covered |= ((F.col("priority") < p) & (end >= F.col("stop"))) | ((F.col("priority") == p) & longer)
        labels = work.keep(
            found.withColumn("covered", F.coalesce(covered, F.lit(False))).filter(~F.col("covered"))
            .groupBy("doc_id", "text_key")
            .agg(F.collect_set("label").alias("own"), F.max("priority").alias("best")),
            "labels",
        ).select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), "own", "best")
    names = [l.replace("-", "_") for l in BASE.values()]
    base = F.filter(
        F.array(*(F.when(F.col(n)["n"] > 0, F.lit(l)) for n, l in zip(names, BASE.values()))), lambda x: x.isNotNull()
    )
    score = F.coalesce(*(F.when(F.col("best") == p, F.lit(s)) for p, s in SCORE.items()), F.when(F.size("base") > 0, F.lit(0.6)), F.lit(0.0))
    return (
        scanned.drop("found").join(labels, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left")
        .withColumn("base", base)
        .select(
            "doc_id", "n_words",
            sum((F.col(n)["n"] for n in names), F.lit(0)).cast("long").alias("n_base"),
            F.least(*(F.col(n)["first"] for n in names)).alias("first_word"),
            F.greatest(*(F.col(n)["last"] for n in names)).alias("last_word"),
            F.array_join(F.array_sort("base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
            score.alias("score"),
        )
    )

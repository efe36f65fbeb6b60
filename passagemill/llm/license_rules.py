"""The signature rules of license scans: regexes over lower-cased text, each with a label, two sets of keywords (the gate
is asked first), a priority (less is stronger) and a weight. Each match holds a keyword of either set once white space is
one blank; they are read off the pattern, so that no alternative of it is forgotten.

A license has a name, an SPDX identifier and addresses; FORMS are the ways in which texts refer to them, and NOTICES are
passages by which a license is known without its name. Patterns take any white space between words.
"""

from __future__ import annotations

import re
from re import _constants as _op
from re import _parser
from typing import NamedTuple


class Rule(NamedTuple):
    gate: tuple[str, ...]
    keyword: tuple[str, ...]
    pattern: str
    label: str
    priority: int
    weight: float


_L = r"licen[sc]e"
_V = r"(?:,? version| v\.?|-v?)? ?"
#: label: (keyword of the name, or names by keyword, name, keyword of the identifier, identifier, address or "").
LICENSES = {
    "mit": ("mit", rf"(?:the )?(?:mit|expat|x11)(?:[-/ ]style)? {_L}", "mit", r"mit(?:-0|-cmu|-feh)?", r"opensource\.org/licenses/mit"),
    "apache": ("apache", rf"(?:the )?apache(?: software)?(?: {_L})?(?:,? version| v\.?)? ?(?:1\.[01]|2(?:\.0)?|{_L})", "apache-", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    "gpl": ("general public", rf"(?:the )?gnu general public {_L}s?(?:,? version [123](?:\.0)?)?", "gpl-", r"a?gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl"),
    "gpl-name": ("gpl", r"(?:the )?(?:gnu )?gpl(?:[- ]?v?[123](?:\.0)?\+?)?(?: licen[sc]e)?", "gpl", r"gpl[- ]?v?[123](?:\.0)?\+?", ""),
    "lgpl": ("general public", rf"(?:the )?(?:gnu )?(?:lesser|library) general public {_L}", "lgpl", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl"),
    "agpl": ("affero", rf"(?:the )?(?:gnu )?affero general public {_L}", "agpl", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    "gfdl": ("free documentation", rf"(?:the )?gnu free documentation {_L}", "gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    "bsd": ("bsd", rf"(?:the )?(?:(?:new|revised|modified|simplified|original|free|[0234]-clause)[ -])*bsd(?: [0234]-clause)?(?:[- ]style)? {_L}", "bsd-", r"(?:bsd-[0-4]-clause(?:-[a-z]+)*|0bsd)", r"opensource\.org/licenses/bsd"),
    "isc": ("isc", rf"(?:the )?isc {_L}", "isc", r"isc", r"opensource\.org/licenses/isc"),
    "mpl": ("mozilla", rf"(?:the )?mozilla public {_L}{_V}(?:[12]\.[01])?", "mpl-", r"mpl-[12]\.[01]", r"mozilla\.org/(?:en-us/)?mpl"),
    "epl": ("eclipse", rf"(?:the )?eclipse (?:public|distribution) {_L}{_V}(?:[12]\.0)?", "epl-", r"ep?l-[12]\.0", r"eclipse\.org/legal/ep"),
    "cddl": ("common development", rf"(?:the )?common development and distribution {_L}", "cddl", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    "eupl": ("european union", rf"(?:the )?european union public {_L}", "eupl", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    "artistic": ("artistic", rf"(?:the )?(?:clarified )?artistic {_L}{_V}(?:[12]\.0)?", "artistic-", r"artistic-[12]\.0", r"perlfoundation\.org/artistic"),
    "bsl": ("boost", rf"(?:the )?boost software {_L}{_V}(?:1\.0)?", "bsl-", r"bsl-1\.0", r"boost\.org/license"),
    "zlib": ("zlib", rf"(?:the )?zlib(?:/libpng)? {_L}", "zlib", r"zlib(?:-acknowledgement)?", r"opensource\.org/licenses/zlib"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense", r"unlicense\.org"),
    "wtfpl": ("what the fuck", rf"do what the fuck you want to public {_L}", "wtfpl", r"wtfpl", r"wtfpl\.net"),
    "cc0": ("cc0", r"(?:creative commons (?:zero )?)?cc0(?: 1\.0)?(?: universal)?", "cc0-", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    **{
        f"cc-{kind}": ({f"cc{sep}{at}": rf"(?:creative commons )?cc{sep}{at}(?: [1-4]\.[05])?" for sep in "- " for at in {kind, kind.replace("-", " ")}} | ({"attribution": rf"(?:creative commons )?attribution{words}(?: [1-4]\.[05])?(?: international)?"} if words else {}), "", f"cc-{kind}-", rf"cc-{kind}-[1-4]\.[05]", rf"creativecommons\.org/licenses/{kind}/")
        for kind, words in {"by": "", "by-sa": r"[- ]share-?alike", "by-nd": r"[- ]no-?deriv(?:ative)?s?", "by-nc": r"[- ]non-?commercial", "by-nc-sa": r"[- ]non-?commercial[- ]share-?alike", "by-nc-nd": r"[- ]non-?commercial[- ]no-?deriv(?:ative)?s?"}.items()
    },
    "creative-commons": ("creative commons", rf"(?:a |the )?creative commons(?: attribution)?(?: {_L})?", "cc-", r"cc-pddc", r"creativecommons\.org/licenses"),
    "odbl": ("open d", rf"(?:the )?open (?:data commons )?(?:open )?database {_L}", "odbl", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by": ("open data commons", rf"open data commons attribution {_L}", "odc-by", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl": ("public domain dedication", rf"public domain dedication and {_L}", "pddl", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "ofl": ("open font", rf"(?:the )?(?:sil )?open font {_L}", "ofl-", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    "psf": ("python", rf"(?:the )?(?:python software foundation|psf|python) {_L}", "p", r"(?:psf|python)-2\.0", r"python\.org/(?:psf/)?license"),
    "php": ("php", rf"(?:the )?php {_L}", "php-", r"php-3\.0[1]?", r"php\.net/license"),
    "ruby": ("ruby", rf"(?:the )?ruby {_L}", "ruby", r"ruby", r"ruby-lang\.org/.{0,20}license"),
    "postgresql": ("postgresql", rf"(?:the )?postgresql {_L}", "postgresql", r"postgresql", r"postgresql\.org/about/licence"),
    "openssl": ("openssl", rf"(?:the )?openssl {_L}", "openssl", r"openssl", r"openssl\.org/source/license"),
    "ms-pl": ("microsoft", rf"(?:the )?microsoft (?:public|reciprocal) {_L}", "ms-", r"ms-(?:pl|rl)", r"opensource\.org/licenses/ms-"),
    "ibm-pl": ("ibm", rf"(?:the )?ibm public {_L}", "ipl-", r"ipl-1\.0", r"opensource\.org/licenses/ibmpl"),
    "cpl": ("common public", rf"(?:the )?common public {_L}(?! attribution)", "cpl-", r"cpl-1\.0", r"opensource\.org/licenses/cpl"),
    "cpal": ("common public attribution", rf"(?:the )?common public attribution {_L}", "cpal", r"cpal-1\.0", r"opensource\.org/licenses/cpal"),
    "osl": ("open software", rf"(?:the )?open software {_L}", "osl-", r"osl-[123]\.[01]", r"opensource\.org/licenses/osl"),
    "afl": ("academic free", rf"(?:the )?academic free {_L}", "afl-", r"afl-[123]\.[012]", r"opensource\.org/licenses/afl"),
    "ecl": ("educational community", rf"(?:the )?educational community {_L}", "ecl-", r"ecl-[12]\.0", r"opensource\.org/licenses/ecl"),
    "ncsa": ("ncsa", rf"(?:the )?(?:university of illinois/)?ncsa(?: open source)? {_L}", "ncsa", r"ncsa", r"opensource\.org/licenses/uoi-ncsa"),
    "upl": ("universal permissive", rf"(?:the )?universal permissive {_L}", "upl-", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl"),
    "mulan": ("mulan", rf"(?:the )?mulan (?:psl|permissive software {_L})", "mulanpsl", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn/mulanpsl"),
    "sspl": ("server side public", rf"(?:the )?server side public {_L}", "sspl", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    "busl": ("business source", rf"(?:the )?business source {_L}", "busl", r"busl-1\.1", r"mariadb\.com/bsl"),
    "elastic": ("elastic", rf"(?:the )?elastic {_L}(?: 2\.0)?", "elastic-", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    "polyform": ("polyform", rf"polyform (?:noncommercial|small business|shield|strict) {_L}", "polyform", r"polyform-[a-z-]+-1\.0\.0", r"polyformproject\.org/licenses"),
    "openrail": ("rail", rf"(?:the )?(?:creativeml |bigscience |bigcode )?open ?rail(?:-[ms]+| [ms])*(?: {_L})?", "openrail", r"(?:creativeml-)?openrail(?:\+\+)?(?:-[ms])?", r"huggingface\.co/spaces/.{0,40}license"),
    "curl": ("curl", rf"(?:the )?curl {_L}", "curl", r"curl", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    "vim": ("vim", rf"(?:the )?vim {_L}", "vim", r"vim", r"vimhelp\.org/uganda"),
    "ftl": ("freetype", rf"(?:the )?freetype (?:project )?{_L}", "ftl", r"ftl", r"freetype\.org/license"),
    "ijg": ("jpeg group", rf"(?:the )?independent jpeg group {_L}", "ijg", r"ijg", ""),
    "nasa": ("nasa", rf"(?:the )?nasa open source agreement", "nasa-", r"nasa-1\.3", r"opensource\.org/licenses/nasa"),
    "w3c": ("w3c", rf"(?:the )?w3c(?: software(?: notice)?(?: and)?)? {_L}", "w3c", r"w3c(?:-[0-9]+)?", r"w3\.org/consortium/legal"),
    "unicode": ("unicode", rf"(?:the )?unicode(?:,? inc\.)? {_L}", "unicode-", r"unicode-(?:3\.0|dfs-201[56])", r"unicode\.org/(?:copyright|license)"),
    "beerware": ("beer", rf"(?:the )?beer-?ware {_L}", "beerware", r"beerware", ""),
    "json": ("json", rf"(?:the )?json {_L}", "json", r"json", r"json\.org/license"),
    "sleepycat": ("sleepycat", rf"(?:the )?sleepycat {_L}", "sleepycat", r"sleepycat", r"opensource\.org/licenses/sleepycat"),
    "ofsl": ("functional source", rf"(?:the )?functional source {_L}", "fsl-", r"fsl-1\.1", r"fsl\.software"),
    "blue-oak": ("blue oak", rf"(?:the )?blue oak model {_L}", "blueoak", r"blueoak-1\.0\.0", r"blueoakcouncil\.org/license"),
}
#: (what stands before the name, priority, weight).
FORMS = [
    (r"(?:licensed|released|distributed|published|offered|provided|available|covered|shared|redistributed) (?:to you )?(?:under|by|with|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: an?)? ", 1, 1.0),
    (r"(?:under|subject to|governed by|in accordance with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? ", 2, 0.9),
    ("", 4, 0.7),
]
#: keyword, pattern, label, weight: passages and statements that need no name.
NOTICES = [
    ("permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", "mit", 1.0),
    ("the above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies", "mit", 0.9),
    ("permission to use, copy", r"permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee", "isc", 1.0),
    ("redistribution and use", r"redistribution and use in source and binary forms,? with or without modification", "bsd", 1.0),
    ("neither the name", r"neither the name of .{1,80} nor the names of its contributors", "bsd", 0.9),
    ("free software", r"this (?:program|library|file) is free software[;:,] you can redistribute it and/?or modify", "gpl", 1.0),
    ("free software foundation", r"as published by the free software foundation", "gpl", 0.8),
    ("limitations under the", r"see the license for the specific language governing permissions and limitations under the license", "apache", 0.9),
    ("source code form is subject", r"this source code form is subject to the terms of the mozilla public license", "mpl", 1.0),
    ("as-is", r"this software is provided 'as-is', without any express or implied warranty", "zlib", 0.9),
    ("free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 1.0),
    ("public domain", r"(?:released|placed|dedicated|put) (?:in)?to the public domain", "public-domain", 0.9),
    ("public domain", r"(?:is|are) in the public domain", "public-domain", 0.8),
    ("rights reserved", r"all rights (?:are )?reserved", "proprietary", 0.6),
    ("rights reserved", r"some rights (?:are )?reserved", "creative-commons", 0.5),
    ("confidential", r"proprietary and confidential", "proprietary", 0.9),
    ("unauthorized", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)", "proprietary", 0.8),
    ("may not be reproduced", r"(?:no part|may not be reproduced)[^.\n]{0,80} without (?:the )?(?:prior )?(?:written )?permission", "proprietary", 0.8),
    ("redistribut", r"(?:do not|not for|no) (?:re)?distribut(?:e|ion)", "proprietary", 0.7),
    ("non-commercial", r"for (?:personal,? )?non-commercial (?:use|purposes) only", "non-commercial", 0.8),
    ("noncommercial", r"for noncommercial (?:use|purposes) only", "non-commercial", 0.8),
    ("personal use", r"for personal use only", "non-commercial", 0.7),
    ("research purposes", r"for (?:academic|research) (?:use|purposes) only", "non-commercial", 0.7),
    ("copyright", r"(?:copyright|©)(?: \(c\)| ©)? ?(?:19|20)[0-9]{2}", "copyright", 0.4),
    ("copyright", r"copyright holders? (?:and|or) contributors", "copyright", 0.5),
]
#: Labels that are reported by another name.
LABELS = {"gpl-name": "gpl"}


def _spaced(pattern: str) -> str:
    """A blank between words stands for any white space; those in brackets for one character of it."""
    parts = re.split(r"(\[[^]]*\])", pattern)
    return "".join(x.replace(" ", r"\s") if x.startswith("[") else x.replace(" ?", r"\s*").replace(" ", r"\s+") for x in parts)


def _edge(pattern: str) -> str:
    return rf"(?<![a-z0-9]){_spaced(pattern)}(?![a-z0-9])"


def _needed(pattern) -> list[tuple[str, ...]]:
    """Sets of literals, the longest first (rare characters count as long); each match of pattern, its white space made one blank, holds one of every set."""
    out: list[tuple[str, ...]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run.strip():
            out.append((re.sub(" +", " ", run),))
        run = ""

    def walk(items) -> None:
        nonlocal run
        for kind, value in items:
            if kind is _op.LITERAL:
                run += chr(value)
            elif kind is _op.SUBPATTERN:
                walk(value[-1])
            elif kind is _op.MAX_REPEAT and value[0] == 1 and list(value[2]) == [(_op.IN, [(_op.CATEGORY, _op.CATEGORY_SPACE)])]:
                run += " "
            elif kind is _op.BRANCH:
                end()
                each = [_needed(x) for x in value[1]]
                if all(each):
                    out.append(tuple(sorted({w for x in each for w in x[0]})))
            elif kind is _op.MAX_REPEAT and value[0] > 0:
                end()
                out.extend(_needed(value[2]))
            elif kind not in (_op.ASSERT, _op.ASSERT_NOT, _op.AT):
                end()

    walk(pattern)
    end()
    return sorted(reversed(out), key=lambda x: -min(len(k) if k.isascii() else 9 for k in x))


def needed(pattern: str) -> list[tuple[str, ...]]:
    return _needed(_parser.parse(pattern))


def _rule(pattern: str, part: str, label: str, priority: int, weight: float) -> Rule:
    """A rule asked by the longest keywords of part, which each match of pattern holds."""
    keys = needed(pattern)
    own = needed(part)[0]
    gate = next((("licen",) for x in keys if len(x) == 1 and "licen" in x[0]), own)
    other = [x for x in needed(part) if x != gate and not (len(x) == 1 and x[0].strip() in gate)]
    return Rule(gate, other[0] if other else own, pattern, label, priority, weight)


def _rules() -> list[Rule]:
    out = []
    for label, (names, name, _, spdx, url) in LICENSES.items():
        to = LABELS.get(label, label)
        for own in names.values() if isinstance(names, dict) else [name]:
            for before, priority, weight in FORMS:
                out.append(_rule(_edge(before + own), _spaced(own), to, priority, weight))
        out.append(_rule(_spaced(rf"spdx-licen[sc]e-identifier: ?(?:\(?[a-z0-9.+-]+ (?:and|or) )?{spdx}(?![a-z0-9-])"), spdx, to, 0, 1.0))
        out.append(_rule(_edge(rf"(?:licen[sc]es?|licen[sc]e-expression|license_id)[\"']? ?[:=] ?[\"'(]?{spdx}"), spdx, to, 1, 0.9))
        if url:
            out.append(_rule(rf"(?:https?://)?(?:www\.)?{url}[a-z0-9./_-]*", url, to, 1, 1.0))
    out += [_rule(_spaced(pattern), _spaced(pattern), label, 3, weight) for _, pattern, label, weight in NOTICES]
    return out


RULES = _rules()

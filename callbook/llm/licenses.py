"""License scans by ordered signature rules, in built-in SQL functions alone.

A text is lower-cased (A-Z) and becomes its words, each with a space on either side, so
that matches begin and end at words and neighbours share nothing. A rule has a label, a
tier, a confidence, a keyword that any match of it contains, and a pattern in words. A
text without any of the few words that let a rule match at all is left at once; in others,
only rules whose keyword is there are tried, and only those that match are located.

All matches are intervals of words. One is dropped if another of the same or a better
tier holds its whole interval; of the same interval and tier, the earlier rule stays. In
the order (start, longest first, tier, rule) only earlier matches can hold a later one, so
one pass with the furthest end seen by tier decides; it goes over blocks, so that time
grows in proportion to the matches even where a text repeats its notice many times.

Null, empty and wordless texts have no words and no matches. Long texts are scanned whole.
Rows that repeat are scanned each, null keys are kept, an empty table gives an empty table,
other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What stands between words once A-Z is lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Matches that one step of the suppression copies at most.
BLOCK = 256
TIERS = 4
GRANT, REFERENCE, TAG, NAME = range(TIERS)


def _always(pattern: str) -> str:
    """A pattern without its groups that may be missing or have a choice."""
    while (less := re.sub(r"\(\?:[^()]*\)(\{[^}]*\})?\??", " ", pattern)) != pattern:
        pattern = less
    return pattern


@dataclass(frozen=True)
class Rule:
    label: str
    tier: int
    confidence: float
    keyword: str
    pattern: str        # words with single spaces between them

    @property
    def regex(self) -> str:
        """The pattern over words that have a space on either side each."""
        return f" {self.pattern.replace(' ', '  ')} "

    @property
    def gate(self) -> str:
        """What a text must hold to be looked at for this rule: one word serves most of them."""
        return "licen" if "licen" in _always(self.pattern) else self.keyword


#: The phrases whose places are always reported.
BASE = [Rule("cc-by", NAME, 0.5, " cc ", "cc by"),
        Rule("gpl", NAME, 0.5, "general", "general public license"),
        Rule("reserved", NAME, 0.4, "rights", "all rights reserved")]

UNDER = (r"(?:licen[cs]ed|released|distributed|available|published|offered|provided|covered|governed|redistribute it"
         r"|used|shared) (?:\S+ ){0,3}?(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?")
VERSION = "(?:version |ver |v ?)?"
CC_NAME = "(?:cc|creative commons)"

#: label | keyword | name | identifier. A name makes two rules, by itself and after "licensed under"
#: and the like; an identifier makes the rule of its tag.
FAMILIES = """
apache-2.0 | apache | apache (?:software )?(?:foundation )?(?:licen[cs]e )?{v}2(?: 0)? | apache 2 0
apache-1.1 | apache | apache (?:software )?licen[cs]e {v}1 1 | apache 1 1
apache-1.0 | apache | apache (?:software )?licen[cs]e {v}1 0 | apache 1 0
apache | apache | apache (?:software )?licen[cs]e | apache
mit | mit | (?:mit|expat|x11) (?:style |like )?licen[cs]e | mit
mit | x11 | mit x11(?: licen[cs]e)? | x11
mit-0 | no  attribution | mit no attribution | mit 0
gpl-1.0 | gnu | gnu (?:general public licen[cs]e|gpl) {v}1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2.0 | gnu | gnu (?:general public licen[cs]e|gpl) {v}2(?: 0)? | gpl 2 0
gpl-2.0-only | gnu | gnu (?:general public licen[cs]e|gpl) {v}2(?: 0)? only | gpl 2 0 only
gpl-2.0-or-later | gnu | gnu (?:general public licen[cs]e|gpl) {v}2(?: 0)? or (?:any )?later(?: version)? | gpl 2 0 or later
gpl-3.0 | gnu | gnu (?:general public licen[cs]e|gpl) {v}3(?: 0)? | gpl 3 0
gpl-3.0-only | gnu | gnu (?:general public licen[cs]e|gpl) {v}3(?: 0)? only | gpl 3 0 only
gpl-3.0-or-later | gnu | gnu (?:general public licen[cs]e|gpl) {v}3(?: 0)? or (?:any )?later(?: version)? | gpl 3 0 or later
gpl | gnu | gnu (?:general public licen[cs]e|gpl) | gpl
gpl-2.0 | gplv2 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3 | gplv3
lgpl-2.0 | gnu | gnu (?:library|lesser) general public licen[cs]e {v}2(?: 0)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | gnu | gnu (?:library|lesser) general public licen[cs]e {v}2 1 | lgpl 2 1(?: only| or later)?
lgpl-3.0 | gnu | gnu lesser general public licen[cs]e {v}3(?: 0)? | lgpl 3 0(?: only| or later)?
lgpl | gnu | gnu (?:library|lesser) general public licen[cs]e | lgpl
agpl-1.0 | affero | (?:gnu )?affero general public licen[cs]e {v}1(?: 0)? | agpl 1 0(?: only| or later)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e {v}3(?: 0)? | agpl 3 0(?: only| or later)?
agpl | affero | (?:gnu )?affero general public licen[cs]e | agpl
gfdl-1.1 | gnu | gnu free documentation licen[cs]e {v}1 1 | gfdl 1 1(?: only| or later)?
gfdl-1.2 | gnu | gnu free documentation licen[cs]e {v}1 2 | gfdl 1 2(?: only| or later)?
gfdl-1.3 | gnu | gnu free documentation licen[cs]e {v}1 3 | gfdl 1 3(?: only| or later)?
gfdl | gnu | gnu free documentation licen[cs]e | gfdl
mpl-1.0 | mozilla | mozilla public licen[cs]e {v}1 0 | mpl 1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e {v}1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e {v}2(?: 0)? | mpl 2 0
mpl | mozilla | mozilla public licen[cs]e | mpl
epl-1.0 | eclipse | eclipse public licen[cs]e {v}1 0 | epl 1 0
epl-2.0 | eclipse | eclipse public licen[cs]e {v}2 0 | epl 2 0
edl-1.0 | eclipse | eclipse distribution licen[cs]e {v}1 0 | edl 1 0
epl | eclipse | eclipse public licen[cs]e | epl
bsd-4-clause | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)? | bsd 4 clause
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)? | bsd 3 clause
bsd-2-clause | bsd | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)? | bsd 2 clause
0bsd | bsd | (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)? | 0bsd
bsd | bsd | bsd (?:style |type )?licen[cs]e | bsd
isc | isc | isc licen[cs]e | isc
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
bsl-1.0 | boost | boost software licen[cs]e(?: {v}1 0)? | bsl 1 0
artistic-1.0 | artistic | artistic licen[cs]e {v}1 0 | artistic 1 0
artistic-2.0 | artistic | artistic licen[cs]e {v}2 0 | artistic 2 0
artistic | artistic | artistic licen[cs]e | artistic
unlicense | unlicense | the unlicense | unlicense
wtfpl | fuck | do what the fuck you want to public licen[cs]e | wtfpl
cddl-1.0 | distribution | common development and distribution licen[cs]e(?: {v}1 0)? | cddl 1 0
cddl-1.1 | distribution | common development and distribution licen[cs]e {v}1 1 | cddl 1 1
cpl-1.0 | common | common public licen[cs]e(?: {v}1 0)? | cpl 1 0
eupl-1.1 | european | european union public licen[cs]e {v}1 1 | eupl 1 1
eupl-1.2 | european | european union public licen[cs]e {v}1 2 | eupl 1 2
eupl | european | european union public licen[cs]e | eupl
ms-pl | microsoft | microsoft public licen[cs]e | ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl
osl-3.0 | open | open software licen[cs]e(?: {v}3 0)? | osl 3 0
afl-3.0 | academic | academic free licen[cs]e(?: {v}3 0)? | afl 3 0
ecl-2.0 | educational | educational community licen[cs]e(?: {v}2 0)? | ecl 2 0
odbl-1.0 | open | open database licen[cs]e(?: {v}1 0)? | odbl 1 0
odc-by-1.0 | open | open data commons attribution licen[cs]e | odc by 1 0
pddl-1.0 | domain | public domain dedication and licen[cs]e | pddl 1 0
ofl-1.1 | sil | sil open font licen[cs]e(?: {v}1 1)? | ofl 1 1
psf-2.0 | python | (?:python software foundation|psf) licen[cs]e(?: {v}2)? | (?:psf|python) 2 0
php-3.01 | php | php licen[cs]e(?: {v}3 01)? | php 3 01
ruby | ruby | ruby licen[cs]e | ruby
openssl | openssl | openssl licen[cs]e | openssl
lppl-1.3c | latex | latex project public licen[cs]e(?: {v}1 3c?)? | lppl 1 3c
qpl-1.0 | public | q public licen[cs]e(?: {v}1 0)? | qpl 1 0
ncsa | ncsa | (?:university of illinois )?(?:ncsa|ncsa open source) licen[cs]e | ncsa
postgresql | postgresql | postgresql licen[cs]e | postgresql
upl-1.0 | universal | universal permissive licen[cs]e(?: {v}1 0)? | upl 1 0
vim | vim | vim licen[cs]e | vim
w3c | w3c | w3c (?:software (?:notice and )?)?licen[cs]e | w3c
cecill-2.1 | cecill | cecill(?: free software)? licen[cs]e(?: agreement)?(?: {v}2 1)? | cecill 2 1
busl-1.1 | business | business source licen[cs]e(?: {v}1 1)? | busl 1 1
sspl-1.0 | server | server side public licen[cs]e(?: {v}1)? | sspl 1 0
elastic-2.0 | elastic | elastic licen[cs]e(?: {v}2(?: 0)?)? | elastic 2 0
polyform-nc-1.0 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)? | polyform noncommercial 1 0 0
openrail | rail | (?:open ?rail(?: m)?|responsible ai) licen[cs]e | openrail
ogl-3.0 | government | open government licen[cs]e(?: {v}3 0)? | ogl uk 3 0
etalab-2.0 | etalab | (?:licence ouverte etalab|etalab open licen[cs]e)(?: 2 0)? | etalab 2 0
mulan-psl-2.0 | mulan | mulan (?:permissive software licen[cs]e|psl)(?: {v}2)? | mulanpsl 2 0
"""

#: The parts of Creative Commons names: label, words; each comes with "cc", "creative commons", by itself,
#: with a version, after "licensed under", and as a tag.
COMMONS = """
cc-by | (?:by|attribution)
cc-by-sa | (?:by|attribution) (?:sa|share ?alike|share alike)
cc-by-nd | (?:by|attribution) (?:nd|no ?derivatives|no ?derivs|no derivatives|no derivs)
cc-by-nc | (?:by|attribution) (?:nc|non ?commercial|non commercial)
cc-by-nc-sa | (?:by|attribution) (?:nc|non ?commercial|non commercial) (?:sa|share ?alike|share alike)
cc-by-nc-nd | (?:by|attribution) (?:nc|non ?commercial|non commercial) (?:nd|no ?derivatives|no ?derivs|no derivatives|no derivs)
"""
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: label | tier | confidence | keyword | pattern: notices, addresses and phrases with a wording of their own.
NOTICES = r"""
mit | 0 | 1.0 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 0 | 0.8 | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | 0 | 1.0 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 0 | 0.9 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 0 | 1.0 | endorse | neither the name of (?:\S+ ){1,12}?(?:contributors )?may be used to endorse or promote products
bsd-4-clause | 0 | 1.0 | advertising | all advertising materials mentioning features or use of this software must display
gpl | 0 | 0.9 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-2.0-or-later | 0 | 1.0 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2
gpl-3.0-or-later | 0 | 1.0 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3
lgpl | 0 | 0.9 | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl | 0 | 0.9 | affero | under the terms of the gnu affero general public licen[cs]e as published
apache-2.0 | 0 | 1.0 | compliance | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | 0 | 1.0 | apache | licensed under the apache licen[cs]e version 2 0 the licen[cs]e
mpl-2.0 | 0 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | 0 | 1.0 | mozilla | subject to the mozilla public licen[cs]e version 1 1
epl | 0 | 1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
unlicense | 0 | 1.0 | unencumbered | this is free and unencumbered software released into the public domain
bsl-1.0 | 0 | 1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | 0 | 1.0 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
wtfpl | 0 | 1.0 | fuck | you just do what the fuck you want to
public-domain | 0 | 0.9 | domain | (?:dedicated|released|placed) (?:\S+ ){0,4}?(?:to|into|in) the public domain
public-domain | 3 | 0.6 | domain | (?:this work is |is )?in the public domain
cc0-1.0 | 1 | 0.9 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 1 | 0.9 | dedication | public domain dedication
cc0-1.0 | 2 | 1.0 | publicdomain | creativecommons org publicdomain zero 1 0
public-domain | 2 | 0.9 | publicdomain | creativecommons org publicdomain mark 1 0
cc-by | 2 | 0.9 | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | 2 | 0.9 | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | 2 | 0.9 | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | 2 | 0.9 | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | 2 | 0.9 | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 2 | 0.9 | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
apache-2.0 | 2 | 1.0 | apache | (?:www )?apache org licenses license 2 0
mit | 2 | 0.9 | opensource | opensource org licenses? mit
bsd-3-clause | 2 | 0.9 | opensource | opensource org licenses? bsd 3 clause
bsd-2-clause | 2 | 0.9 | opensource | opensource org licenses? bsd 2 clause
gpl | 2 | 0.8 | gnu | (?:www )?gnu org (?:copyleft|licenses) gpl(?: html)?
gpl-2.0 | 2 | 0.9 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | 2 | 0.9 | gnu | (?:www )?gnu org licenses gpl 3 0
lgpl | 2 | 0.8 | gnu | (?:www )?gnu org (?:copyleft|licenses) lgpl(?: html)?
agpl-3.0 | 2 | 0.9 | gnu | (?:www )?gnu org licenses agpl 3 0
mpl-2.0 | 2 | 1.0 | mozilla | mozilla org mpl 2 0
epl-2.0 | 2 | 1.0 | eclipse | eclipse org legal epl (?:2 0|v20)
reserved | 1 | 0.6 | rights | (?:copyright|c) (?:\S+ ){0,8}?all rights reserved
reserved | 1 | 0.5 | droits | tous droits r\S+s
reserved | 1 | 0.5 | rechte | alle rechte vorbehalten
reserved | 1 | 0.5 | derechos | todos los derechos reservados
some-rights | 1 | 0.5 | rights | some rights reserved
no-rights | 1 | 0.5 | rights | no rights reserved
proprietary | 0 | 0.8 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 0 | 0.7 | permission | may not be (?:reproduced|copied|distributed|published|transmitted) (?:\S+ ){0,12}?without (?:\S+ ){0,4}?permission
proprietary | 1 | 0.6 | prohibited | (?:unauthori[sz]ed|any) (?:copying|reproduction|distribution|use) (?:\S+ ){0,10}?(?:is )?(?:strictly )?prohibited
non-commercial | 1 | 0.5 | commercial | for (?:non commercial|noncommercial|personal) use only
research-only | 1 | 0.5 | research | for (?:academic|research)(?: and educational)? (?:use|purposes) only
copyright | 3 | 0.3 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
copyright | 3 | 0.2 | copyright | copyright notice
warranty-disclaimer | 3 | 0.2 | warrant | without (?:any )?warrant(?:y|ies) of any kind
warranty-disclaimer | 3 | 0.2 | warrant | as is without warrant(?:y|ies)
open-source | 3 | 0.2 | open | open source licen[cs]e
creative-commons | 3 | 0.4 | creative | creative commons(?: licen[cs]e)?
license-reference | 3 | 0.1 | licen | licen[cs]ed under
license-reference | 3 | 0.1 | licen | see (?:the )?(?:file )?licen[cs]e(?: txt| md| file)?
"""


def _rows(table: str) -> list[list[str]]:
    """The lines of a table, cut into their parts."""
    return [[part.strip() for part in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in their order, the base phrases first."""
    made = list(BASE)
    for label, keyword, name, identifier in _rows(FAMILIES):
        name = name.replace("{v}", VERSION)
        made += [Rule(label, REFERENCE, 0.9, keyword, UNDER + name), Rule(label, NAME, 0.6, keyword, name),
                 Rule(label, TAG, 1.0, "spdx", f"spdx licen[cs]e identifier {identifier}")]
    for label, words in _rows(COMMONS):
        name = f"{CC_NAME} {words}"
        for keyword in (" cc ", "creative"):
            named = name.replace(CC_NAME, "cc" if keyword == " cc " else "creative commons")
            made.append(Rule(label, NAME, 0.6, keyword, f"{named}(?: licen[cs]e)?"))
            made.append(Rule(label, REFERENCE, 0.9, keyword, f"{UNDER}(?:an? )?{named}(?: licen[cs]e)?"))
            for version in CC_VERSIONS:
                full = f"{label}-{version.replace(' ', '.')}"
                tail = f"(?: licen[cs]e)? {VERSION}{version}(?: international| unported| generic)?(?: licen[cs]e)?"
                made.append(Rule(full, NAME, 0.8, keyword, named + tail))
                made.append(Rule(full, REFERENCE, 1.0, keyword, f"{UNDER}(?:an? )?{named}{tail}"))
        for version in CC_VERSIONS:
            made.append(Rule(f"{label}-{version.replace(' ', '.')}", TAG, 1.0, "spdx",
                             f"spdx licen[cs]e identifier {label.replace('-', ' ')} {version}"))
    made += [Rule(label, int(tier), float(confidence), keyword, pattern)
             for label, tier, confidence, keyword, pattern in _rows(NOTICES)]
    return made


def spaced(text: Column) -> Column:
    """The words of a text, each with a space on either side; no words: an empty text."""
    low = F.translate(F.coalesce(text, F.lit("")), *LETTERS)
    words = F.trim(F.regexp_replace(low, BETWEEN, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _marks(parts: Column, mark: str) -> Column:
    """Where a mark stands among the parts."""
    return F.filter(F.transform(parts, lambda x, i: F.when(x == mark, i)), F.isnotnull)


def _places(words: Column, regex: Column, no: Column, tier: Column) -> Column:
    """The matches of one rule: control characters, which words never hold, are put around them."""
    marked = F.regexp_replace(words, regex, F.lit(" \u0001 $0 \u0002 "))

    def located(parts):
        return _let(_marks(parts, "\u0002"), lambda closed: F.transform(
            _marks(parts, "\u0001"), lambda at, j: F.struct(
                (at - 2 * j).cast("long").alias("start"),
                (2 * j + 1 - F.get(closed, j)).cast("long").alias("minus_end"),
                tier.alias("tier"), no.alias("no"))))
    return _let(F.split(F.trim(marked), " +"), located)


def _kept(matches: Column) -> Column:
    """Of ordered matches, those that no earlier one of the same or a better tier holds."""
    def further(ends, match):
        return F.transform(ends, lambda end, t: F.when(match["tier"] <= t, F.greatest(end, -match["minus_end"]))
                           .otherwise(end))

    nothing = F.array(*[F.lit(-1).cast("long")] * TIERS)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(matches, b * BLOCK + 1, F.lit(BLOCK)))

    def within(block, ends):
        state = F.struct(ends.alias("ends"), F.slice(block, 1, 0).alias("kept"))
        return F.aggregate(block, state, lambda now, x: F.struct(
            further(now["ends"], x).alias("ends"),
            F.when(F.get(now["ends"], x["tier"]) >= -x["minus_end"], now["kept"])
             .otherwise(F.concat(now["kept"], F.array(x))).alias("kept")), lambda now: now["kept"])

    def before(blocks):
        """The furthest ends before each block."""
        return F.aggregate(blocks, F.array(nothing), lambda all_ends, block: F.concat(all_ends, F.array(
            F.aggregate(block, F.element_at(all_ends, -1), further))))

    return _let(blocks, lambda blocks: _let(before(blocks), lambda starts: F.flatten(
        F.transform(blocks, lambda block, b: within(block, F.get(starts, b))))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """key, n_words, matches (of all rules, ordered), detections (those that stay).

    Both are arrays of start, end (words, end exclusive), rule (its number), tier, label, confidence.
    """
    signatures = signatures or rules()
    table = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(r.tier).alias("tier"), F.lit(r.keyword).alias("keyword"),
                               F.lit(r.regex).alias("regex")) for i, r in enumerate(signatures)])
    labels = F.array(*[F.lit(r.label) for r in signatures])
    trust = F.array(*[F.lit(float(r.confidence)) for r in signatures])
    gates = {r.gate for r in signatures}
    gate = F.lit(False)
    for word in sorted(g for g in gates if not any(o != g and o in g for o in gates)):
        gate = gate | F.col("words").contains(word)
    words = F.col("words")
    tried = F.when(gate, F.filter(table, lambda r: F.contains(words, r["keyword"]) & F.regexp_like(words, r["regex"]))) \
        .otherwise(F.slice(table, 1, 0))
    found = F.when(F.size("hits") > 0, F.array_sort(F.flatten(F.transform(
        "hits", lambda r: _places(words, r["regex"], r["no"], r["tier"])))))

    def shown(column):
        return F.coalesce(F.transform(column, lambda m: F.struct(
            m["start"].alias("start"), (-m["minus_end"]).alias("end"), m["no"].alias("rule"), m["tier"].alias("tier"),
            F.get(labels, m["no"]).alias("label"), F.get(trust, m["no"]).alias("confidence"))), F.array())

    return (
        docs.select(F.col(key).alias("key"), spaced(F.col(text)).alias("words"))
        .withColumn("hits", tried)
        .select("key", ((F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit("")))) / 2)
                .cast("long").alias("n_words"), found.alias("found"))
        .withColumn("stay", F.when(F.size("found") > 0, _kept(F.col("found"))))
        .select(F.col("key").alias(key), "n_words", shown("found").alias("matches"), shown("stay").alias("detections")))

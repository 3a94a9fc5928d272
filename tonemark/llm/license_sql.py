"""The licence scan in SQL, stated apart from the operator: own patterns, one for each identifier, and own rules."""

from __future__ import annotations

#: One pattern for each identifier; a blank is any gap within a sentence, ~ stands for one to 25 words.
PATTERNS = r"""
MITref: (~ is )?(licensed|released|distributed|available) under the (terms of the )?mit license|spdx-license-identifier mit
MITtitle: (the )?mit license( mit)?
MITgrant: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
MITnotice: the above copyright notice and this permission notice (including the next paragraph )?shall be included in all copies or substantial portions of the software
MITasis: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non-?infringement
MITliable: in no event shall ~ be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
Apache2ref: (~ is )?licensed under the apache license version 2\.0( the license)?|apache license version 2\.0 january 2004|spdx-license-identifier apache-2\.0
Apache2use: you may not use (this file|these files) except in compliance with the license
Apache2copy: you may obtain a copy of the license at
Apache2asis: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
Apache2see: see the license for the specific language governing permissions and limitations under the license
GPLwarranty: ~ is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
BSDpre: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
BSDsource: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
BSDbinary: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
BSDadvert: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
Apache11ack: this product includes software developed by the apache software foundation
BSDack: this product includes software developed by ~
BSDendorse: (neither the names? of ~ nor the names of ((its|their|any) )?contributors may|the names? of ~ may not) be used to endorse or promote products derived from this software without specific prior written permission
BSDasis: this software is provided (by ~ )?as is and any express(ed)? or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
BSDliable: in no event shall ~ be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage
Apache11called: products derived from this software may not be called ~ nor may ~ appear in their name without prior written permission of ~
ISCgrant: permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0BSDgrant: permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted
ISCasis: the software is provided as is and ~ disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
ISCliable: in no event shall ~ be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software
MPL2ref: this source code form is subject to the terms of the mozilla public license (v|version) 2\.0|spdx-license-identifier mpl-2\.0
MPL2copy: if a copy of the mpl was not distributed with this file you can obtain one at
MPL11ref: the contents of this file are subject to the mozilla public license version 1\.1( the license)?|spdx-license-identifier mpl-1\.1
EPL2ref: this program and the accompanying materials are made available under the terms of the eclipse public license (version |v ?)?2\.0 which (accompanies this distribution and )?is available at|spdx-license-identifier epl-2\.0
EPL1ref: this program and the accompanying materials are made available under the terms of the eclipse public license (version |v ?)?1\.0 which (accompanies this distribution and )?is available at|spdx-license-identifier epl-1\.0
Zlibasis: this software is provided as(-| )is without any express or implied warranty
Zlibliable: in no event will the authors? be held liable for any damages arising from the use of this software
Zlibgrant: permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
Unlicenseref: this is free and unencumbered software released into the public domain|spdx-license-identifier unlicense
BSL10ref: ((licensed|distributed|released) )?under the boost software license version 1\.0|boost software license version 1\.0 august 17th 2003|spdx-license-identifier bsl-1\.0
CC0: licensed under cc0 1\.0|to the extent possible under law ~ has waived all copyright and related or neighboring rights to ~|spdx-license-identifier cc0-1\.0
AllRights: all rights reserved
ISCref: spdx-license-identifier isc
0BSDref: spdx-license-identifier 0bsd
Zlibref: spdx-license-identifier zlib
BSD2ref: spdx-license-identifier bsd-2-clause
BSD3ref: spdx-license-identifier bsd-3-clause
BSD4ref: spdx-license-identifier bsd-4-clause
Apache11ref: spdx-license-identifier apache-1\.1
"""
#: Licences and identifiers, from the most specific rule on; @GNU and @GNUREF stand for the notices and references of the GNU licences, @CC for Creative Commons.
RULES = """
Apache-1.1 BSDpre BSDsource BSDbinary Apache11ack Apache11called
BSD-4-Clause BSDpre BSDsource BSDbinary BSDadvert BSDack BSDendorse BSDasis BSDliable
BSD-4-Clause BSDpre BSDsource BSDbinary BSDadvert BSDendorse BSDasis
BSD-3-Clause BSDpre BSDsource BSDbinary BSDendorse BSDasis BSDliable
BSD-3-Clause BSDpre BSDsource BSDbinary BSDendorse BSDasis
BSD-2-Clause BSDpre BSDsource BSDbinary BSDasis BSDliable
BSD-2-Clause BSDpre BSDsource BSDbinary BSDasis
Apache-2.0 Apache2ref Apache2use Apache2copy Apache2asis Apache2see
MPL-1.1 MPL11ref Apache2use Apache2copy
MIT MITgrant MITnotice MITasis MITliable
MIT MITref MITnotice MITasis
MIT MITgrant MITnotice MITasis
MIT MITnotice MITasis
ISC ISCgrant ISCasis ISCliable
ISC ISCgrant ISCasis
0BSD 0BSDgrant ISCasis ISCliable
0BSD 0BSDgrant ISCasis
Zlib Zlibasis Zlibliable Zlibgrant
MPL-2.0 MPL2ref MPL2copy
@GNU
@GNUREF
Apache-2.0 Apache2ref
MIT MITref
MIT MITtitle
MPL-2.0 MPL2ref
MPL-1.1 MPL11ref
EPL-2.0 EPL2ref
EPL-1.0 EPL1ref
Unlicense Unlicenseref
BSL-1.0 BSL10ref
ISC ISCref
0BSD 0BSDref
Zlib Zlibref
BSD-2-Clause BSD2ref
BSD-3-Clause BSD3ref
BSD-4-Clause BSD4ref
Apache-1.1 Apache11ref
CC0-1.0 CC0
@CC
Proprietary AllRights
"""
GNU = (
    ("GPL", "gnu general public license", (("3", r"3(\.0)?", "29 june 2007"), ("2", r"2(\.0)?", "june 1991"), ("1", r"1(\.0)?", "february 1989"))),
    ("LGPL", "gnu (lesser|library) general public license", (("3", r"3(\.0)?", "29 june 2007"), ("2.1", r"2\.1", "february 1999"), ("2", r"2(\.0)?", "june 1991"))),
    ("AGPL", "gnu affero general public license", (("3", r"3(\.0)?", "19 november 2007"),)),
)


def _patterns() -> list[tuple[str, str]]:
    out = [tuple(line.split(": ", 1)) for line in PATTERNS.strip().split("\n")]
    for short, name, versions in GNU:
        out += [(f"{short}see", f"see the {name} for more details"), (f"{short}copy", f"you should have received a copy of the {name} along with ~")]
        for v, digits, date in versions:
            free, by = "~ is free software you can redistribute it and or modify it under the terms of the ", "as published by the free software foundation"
            said = f"(~ is )?(licensed|released|distributed) under the (terms of the )?{name} (version|v) {digits}"
            spdx = rf"spdx-license-identifier {short.lower()}-{v if '.' in v else v + '.0'}".replace(".", r"\.")
            out.append((f"{short}{v}plus", rf"{free}{name} {by} either version {digits} of the license or at your option any later version|{said} or (at your option )?(any )?later( version)?|{spdx}(\+|-or-later)"))
            dotted = v.replace(".", r"\.")
            out.append((f"{short}{v}ref", f"{free}{name} ({by} version {digits}( of the license)?|version {digits} {by})|{said}|{name} version {dotted} {date}|{spdx}(-only)?"))
    words = (("by-nc-sa", "attribution-noncommercial-sharealike"), ("by-nc-nd", "attribution-noncommercial-noderivatives"), ("by-nc", "attribution-noncommercial"), ("by-nd", "attribution-noderivatives"), ("by-sa", "attribution-sharealike"), ("by", "attribution"))
    for terms, long in words:
        for v, region in (("4.0", "international"), ("3.0", "unported"), ("2.0", "generic")):
            n = v.replace(".", r"\.")
            out.append((f"CC{terms.replace('-', '').upper()}{v[0]}", rf"(~ is )?licensed under (a )?(cc {terms} {n}( license)?|creative commons {long} {n} ({region} )?license)|spdx-license-identifier cc-{terms}-{n}"))
    return out


def _rules() -> list[tuple[str, list[str]]]:
    out: list[tuple[str, list[str]]] = []
    for line in RULES.strip().split("\n"):
        name, *ids = line.split(" ")
        if name == "@CC":
            out += [(f"CC-{t}-{v}.0", [f"CC{t.replace('-', '')}{v}"]) for t in ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-ND", "BY-SA", "BY") for v in "432"]
        elif name in ("@GNU", "@GNUREF"):
            for short, _, versions in GNU:
                for v, *_ in versions:
                    for end, first in (("or-later", "plus"), ("only", "ref")):
                        whole = [f"{short}{v}{first}", "GPLwarranty", f"{short}see", f"{short}copy"]
                        out.append((f"{short}-{v if '.' in v else v + '.0'}-{end}", whole if name == "@GNU" else whole[:1]))
        else:
            out.append((name, ids))
    return out


def license_sql() -> str:
    """The licence scan over documents."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    # a point that is certain to end a sentence, one that may, and a line's end become 1, 2 and 3 in brackets of their own
    gap, word = r"[ \x02\x03]+", r"[^ \x01\x02\x03]+"
    slot = f"{word}(?:{gap}{word}){{0,24}}?"
    regex = lambda p: p.replace("(", "(?:").replace(" ", gap).replace("~", slot)
    known = [(i, regex(p)) for i, p in _patterns()]
    open_last = sorted(known, key=lambda x: (word in x[1], -len(x[1])))
    text = "coalesce(text, '')"
    for a, b in (
        (r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s]*", "\n"),
        (r"\b([vV](?:er)?)\.(\s*\d)", r"\1\2"),
        (r"\b((?i:inc|corp|ltd|llc|co|jr|sr|dr|mr|mrs|al|e\.g|i\.e))\.(,|\s+[a-z])", r"\1\2"),
    ):
        text = f"regexp_replace({text}, {quote(a)}, {quote(b)}, 'g')"
    text = f"lower({text})"
    for a, b in (
        (r"[^\p{L}\p{N}.+\-\n!?;:]+", " "),
        (r"(^|\n)[ .+\-;:!]*(?:(?:rem|dnl) )?", r"\1"),
        (r"[.!?]+([ \n]|$)", "\x01\\1"),
        (r"[;:]+([ \n]|$)", "\x02\\1"),
        (r"\n", "\x03"),
        (r"[\x01\x02\x03]", r"\0\0"),  # twice, as the end of one sentence is the start of the next
    ):
        text = f"regexp_replace({text}, {quote(a)}, {quote(b)}, 'g')"
    every = rf"(?:^|[\x01\x02\x03]) *(?:(?:\d{{1,2}}|[a-z]|[ivx]{{1,4}}) +)??({'|'.join(p for _, p in open_last)}) *(?:[\x01\x02\x03]|$)"
    names = " ".join(f"WHEN regexp_full_match(x, {quote(p)}) THEN {quote(i)}" for i, p in open_last)
    maybe = "regexp_matches(text, '(?i)licen[sc]e|software|condition|redistribut|warrant|permission|rights|boost|public domain')"
    steps = [
        f"a AS (SELECT doc_id, CASE WHEN {maybe} THEN regexp_extract_all({text}, {quote(every)}, 1) ELSE [] END AS found FROM documents)",
        f"b AS (SELECT doc_id, list_transform(coalesce(found, []), lambda x: CASE {names} END) AS ids FROM a)",
        "r0 AS (SELECT *, CASE WHEN len(ids) > 0 THEN ' ' || array_to_string(ids, '  ') || ' ' ELSE '' END AS s0 FROM b)",
    ]
    picks = []
    rules = _rules()
    for k, (name, (first, *rest)) in enumerate(rules):
        pattern = "\x01" + "".join(rf"([^\x01]*?) {i} " for i in rest)
        left = f"replace(regexp_replace(replace(s{k}, {quote(f' {first} ')}, chr(1)), {quote(pattern)}, {quote(''.join(chr(92) + str(i + 1) for i in range(len(rest))))}, 'g'), chr(1), {quote(f' {first} ')})"
        steps.append(f"r{k + 1} AS (SELECT doc_id, ids, {''.join(f'f{j}, ' for j in range(k))} {left} AS s{k + 1}, {left} <> s{k} AS f{k} FROM r{k})")
        before = "".join(f" AND NOT f{j}" for j, (other, _) in enumerate(rules[:k]) if other == name)
        picks.append(f"CASE WHEN f{k}{before} THEN {quote(name)} END")
    n = len(rules)
    return f"""WITH {", ".join(steps)} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ' ') AS sentence_ids,
        array_to_string(list_filter([{", ".join(picks)}], lambda x: x IS NOT NULL), ' ') AS licenses, CAST(len(list_filter(string_split(s{n}, ' '), lambda x: x <> '')) AS BIGINT) AS unmatched FROM r{n}"""

"""Licence scans by sentence rules: known licence sentences, then ordered rules over their sequence.

Only DataFrame functions, in one pass without a shuffle. A text is normalised and its sentence ends are marked;
those sentences that are known become identifiers, and the sequence of identifiers is matched against the
rules in order: a rule that matches names its licence and takes its identifiers out of the sequence, so
that a later, more general rule doesn't report them again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences are normalised: lower case, words parted by one blank. (x) may be absent, {x|y} are alternatives, <> stands
# for one to 25 words of a sentence.

#: Sentences of licence texts and notices, and their identifiers.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("(<> is) {licensed|released|distributed|available} under the (terms of the) mit license", "MITref"),
    ("(the) mit license", "MITtitle"),
    ("(the) mit license mit", "MITtitle"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "MITgrant"),
    ("the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software", "MITnotice"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {noninfringement|non-infringement}", "MITasis"),
    ("in no event shall <> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "MITliable"),
    ("(<> is) licensed under the apache license version 2.0", "Apache2ref"),
    ("(<> is) licensed under the apache license version 2.0 the license", "Apache2ref"),
    ("apache license version 2.0 january 2004", "Apache2ref"),
    ("you may not use {this file|these files} except in compliance with the license", "Apache2use"),
    ("you may obtain a copy of the license at", "Apache2copy"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "Apache2asis"),
    ("see the license for the specific language governing permissions and limitations under the license", "Apache2see"),
    ("<> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "GPLwarranty"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BSDpre"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BSDsource"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "BSDbinary"),
    ("all advertising materials mentioning features or use of this software must display the following {acknowledgement|acknowledgment}", "BSDadvert"),
    ("this product includes software developed by <>", "BSDack"),
    ("neither the {name|names} of <> nor the names of ({its|their|any}) contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("the {name|names} of <> may not be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("this software is provided (by <>) as is and any {express|expressed} or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "BSDasis"),
    ("in no event shall <> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "BSDliable"),
    ("this product includes software developed by the apache software foundation", "Apache11ack"),
    ("products derived from this software may not be called <> nor may <> appear in their name without prior written permission of <>", "Apache11called"),
    ("permission to use copy modify {and or|and} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "ISCgrant"),
    ("permission to use copy modify {and or|and} distribute this software for any purpose with or without fee is hereby granted", "0BSDgrant"),
    ("the software is provided as is and <> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "ISCasis"),
    ("in no event shall <> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "ISCliable"),
    ("this source code form is subject to the terms of the mozilla public license {v|version} 2.0", "MPL2ref"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "MPL2copy"),
    ("the contents of this file are subject to the mozilla public license version 1.1", "MPL11ref"),
    ("the contents of this file are subject to the mozilla public license version 1.1 the license", "MPL11ref"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license {2.0|v2.0|v 2.0|version 2.0} which {is available at|accompanies this distribution and is available at}", "EPL2ref"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license {1.0|v1.0|v 1.0|version 1.0} which {is available at|accompanies this distribution and is available at}", "EPL1ref"),
    ("this software is provided {as-is|as is} without any express or implied warranty", "Zlibasis"),
    ("in no event will the {author|authors} be held liable for any damages arising from the use of this software", "Zlibliable"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "Zlibgrant"),
    ("this is free and unencumbered software released into the public domain", "Unlicenseref"),
    ("({licensed|distributed|released}) under the boost software license version 1.0", "BSL10ref"),
    ("boost software license version 1.0 august 17th 2003", "BSL10ref"),
    ("licensed under cc0 1.0", "CC0"),
    ("to the extent possible under law <> has waived all copyright and related or neighboring rights to <>", "CC0"),
    ("all rights reserved", "AllRights"),
)

#: Licence and the identifiers that name it, in this order within the sequence; the first rules are the most specific.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-1.1", ("BSDpre", "BSDsource", "BSDbinary", "Apache11ack", "Apache11called")),
    ("BSD-4-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDadvert", "BSDack", "BSDendorse", "BSDasis", "BSDliable")),
    ("BSD-4-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDadvert", "BSDendorse", "BSDasis")),
    ("BSD-3-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis", "BSDliable")),
    ("BSD-3-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis")),
    ("BSD-2-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDasis", "BSDliable")),
    ("BSD-2-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDasis")),
    ("Apache-2.0", ("Apache2ref", "Apache2use", "Apache2copy", "Apache2asis", "Apache2see")),
    ("MPL-1.1", ("MPL11ref", "Apache2use", "Apache2copy")),
    ("MIT", ("MITgrant", "MITnotice", "MITasis", "MITliable")),
    ("MIT", ("MITref", "MITnotice", "MITasis")),
    ("MIT", ("MITgrant", "MITnotice", "MITasis")),
    ("MIT", ("MITnotice", "MITasis")),
    ("ISC", ("ISCgrant", "ISCasis", "ISCliable")),
    ("ISC", ("ISCgrant", "ISCasis")),
    ("0BSD", ("0BSDgrant", "ISCasis", "ISCliable")),
    ("0BSD", ("0BSDgrant", "ISCasis")),
    ("Zlib", ("Zlibasis", "Zlibliable", "Zlibgrant")),
    ("MPL-2.0", ("MPL2ref", "MPL2copy")),
)

#: Licences and the identifier of a mere reference to them.
REFERENCES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache2ref"),
    ("MIT", "MITref"),
    ("MIT", "MITtitle"),
    ("MPL-2.0", "MPL2ref"),
    ("MPL-1.1", "MPL11ref"),
    ("EPL-2.0", "EPL2ref"),
    ("EPL-1.0", "EPL1ref"),
    ("Unlicense", "Unlicenseref"),
    ("BSL-1.0", "BSL10ref"),
    ("ISC", "ISCref"),
    ("0BSD", "0BSDref"),
    ("Zlib", "Zlibref"),
    ("BSD-2-Clause", "BSD2ref"),
    ("BSD-3-Clause", "BSD3ref"),
    ("BSD-4-Clause", "BSD4ref"),
    ("Apache-1.1", "Apache11ref"),
    ("CC0-1.0", "CC0"),
)


def gnu() -> tuple[list[tuple[str, str]], list[tuple[str, tuple[str, ...]]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences, rules of whole notices and rules of mere references for the GNU licences, of which all are built alike."""
    known: list[tuple[str, str]] = []
    whole: list[tuple[str, tuple[str, ...]]] = []
    refs: list[tuple[str, tuple[str, ...]]] = []
    # fixed values: licence, its name, versions and the dates that stand in the titles
    for short, name, versions in (
        ("GPL", "gnu general public license", (("3", "29 june 2007"), ("2", "june 1991"), ("1", "february 1989"))),
        ("LGPL", "gnu {lesser|library} general public license", (("3", "29 june 2007"), ("2.1", "february 1999"), ("2", "june 1991"))),
        ("AGPL", "gnu affero general public license", (("3", "19 november 2007"),)),
    ):
        known.append((f"see the {name} for more details", f"{short}see"))
        known.append((f"you should have received a copy of the {name} along with <>", f"{short}copy"))
        for v, date in versions:
            number = v if "." in v else f"{v}.0"
            said = v if "." in v else f"{{{v}|{v}.0}}"
            plus, only = f"{short}{v}plus", f"{short}{v}ref"
            free = "<> is free software you can redistribute it and or modify it under the terms of the"
            by = "as published by the free software foundation"
            known += [
                (f"{free} {name} {by} either version {said} of the license or at your option any later version", plus),
                (f"{free} {name} {by} version {said} of the license", only),
                (f"{free} {name} {by} version {said}", only),
                (f"{free} {name} version {said} {by}", only),
                (f"(<> is) {{licensed|released|distributed}} under the (terms of the) {name} {{version|v}} {said}", only),
                (f"(<> is) {{licensed|released|distributed}} under the (terms of the) {name} {{version|v}} {said} or (at your option) {{later|any later version}}", plus),
                (f"{name} version {v} {date}", only),
                (f"spdx-license-identifier {short}-{number}-or-later".lower(), plus),
                (f"spdx-license-identifier {short}-{number}+".lower(), plus),
                (f"spdx-license-identifier {short}-{number}-only".lower(), only),
                (f"spdx-license-identifier {short}-{number}".lower(), only),
            ]
            for end, first in (("or-later", plus), ("only", only)):
                whole.append((f"{short}-{number}-{end}", (first, "GPLwarranty", f"{short}see", f"{short}copy")))
                refs.append((f"{short}-{number}-{end}", (first,)))
    return known, whole, refs


def creative_commons() -> tuple[list[tuple[str, str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of the Creative Commons licences: all combinations of terms and versions."""
    known, rules = [], []
    words = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    for terms in ("by-nc-sa", "by-nc-nd", "by-nc", "by-nd", "by-sa", "by"):
        for version, region in (("4.0", "international"), ("3.0", "unported"), ("2.0", "generic")):
            name, mark = f"CC-{terms.upper()}-{version}", f"CC{terms.replace('-', '').upper()}{version[0]}"
            long = "-".join(words[t] for t in terms.split("-"))
            known += [
                (f"(<> is) licensed under (a) cc {terms} {version}", mark),
                (f"(<> is) licensed under (a) cc {terms} {version} license", mark),
                (f"(<> is) licensed under (a) creative commons {long} {version} ({region}) license", mark),
                (f"spdx-license-identifier {name.lower()}", mark),
            ]
            rules.append((name, (mark,)))
    return known, rules


KNOWN = (*SENTENCES, *gnu()[0], *creative_commons()[0], *((f"spdx-license-identifier {name.lower()}", mark) for name, mark in dict(reversed(REFERENCES)).items()))
ORDERED: tuple[tuple[str, tuple[str, ...]], ...] = (*RULES, *gnu()[1], *gnu()[2], *((n, (i,)) for n, i in REFERENCES), *creative_commons()[1], ("Proprietary", ("AllRights",)))

#: What is not part of a word, line ends aside.
NOT_WORD = r"[^\p{L}\p{N}.+\-\n!?;:]+"
#: A URL ends a sentence. Marks of a sentence's certain end, and of one that may be inside a sentence; line ends may be, too.
URL, END, MAYBE = r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s]*", "\x01", "\x02"
#: Points that end no sentence: of a version before its number, and of shortened words before a small letter or a comma.
SHORTENED = r"\b(?:([vV](?:er)?)\.(?=\s*\d)|((?i:inc|corp|ltd|llc|co|jr|sr|dr|mr|mrs|al|e\.g|i\.e))\.(?=,|\s+[a-z]))"
#: What comment styles put before a line's text.
COMMENT = r"(?<![^\n])[ .+\-;:!]*(?:(?:rem|dnl) )?"
GAP, WORD = rf"[ \n{MAYBE}]+", rf"[^ \n{END}{MAYBE}]+"


def variants(sentence: str) -> list[tuple[str, ...]]:
    """The sentence as tokens, with and without each of its optional parts."""
    head, mark, rest = sentence.partition("(")
    if not mark:
        return [tuple(re.findall(r"\{[^{}]*\}|<>|[^\s{}]+", sentence))]
    part, _, tail = rest.partition(")")
    return [*variants(head + part + tail), *variants(head + tail)]


def token_pattern(t: str) -> str:
    if t == "<>":
        return f"{WORD}(?:{GAP}{WORD}){{0,24}}?"
    if t[0] == "{":
        return "(?:" + "|".join(GAP.join(map(re.escape, part.split())) for part in t[1:-1].split("|")) + ")"
    return re.escape(t)


def pattern_of(sentences: Sequence[str]) -> str:
    """A regular expression for any of the sentences: their tokens as a prefix tree, so that what several begin with is tried once.

    Where several fit, a longer sentence comes before a shorter one, and a given word before an open place.
    """
    tree: dict = {}
    for s in sentences:
        for tokens in variants(s):
            at = tree
            for t in tokens:
                at = at.setdefault(t, {})
            at[""] = {}

    def write(at: dict) -> str:
        parts = [token_pattern(t) + write(at[t]) for t in sorted(at, key=lambda t: (t == "<>", t[:1] == "{", t)) if t]
        if at is not tree:
            parts = [GAP + p for p in parts] + ([""] if "" in at else [])
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return write(tree)


def hints(table: Sequence[tuple[str, str]]) -> list[str]:
    """Few words of which every sentence of the table has one for certain, so that texts without any need no closer look."""
    need = [set(re.sub(r"\([^()]*\)|\{[^{}]*\}|<>", " ", s).split()) for s, _ in table]
    out: list[str] = []
    while need:
        words = sorted({w for n in need for w in n if len(w) > 6}) or sorted({w for n in need for w in n})
        best = max(words, key=lambda w: (sum(w in n for n in need), len(w)))  # long words are rare in other texts
        out.append(best)
        need = [n for n in need if best not in n]
    return out


def normalised(text: Column) -> Column:
    """Lower case, words parted by blanks; sentence ends are END or MAYBE, line ends stay, comment marks go."""
    lines = F.regexp_replace(F.regexp_replace(text, URL, "\n"), SHORTENED, "$1$2")
    words = F.regexp_replace(F.regexp_replace(F.lower(lines), NOT_WORD, " "), COMMENT, "")
    return F.regexp_replace(F.regexp_replace(words, r"[.!?]+(?=[ \n]|\z)", END), r"[;:]+(?=[ \n]|\z)", MAYBE)


def known(words: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Identifiers of the known sentences in text order: from the start of a line, sentence or list item to the end of one, over line ends but not over certain sentence ends."""
    if not table:
        return F.array().cast("array<string>")
    pattern = rf"(?:^|[\n{END}{MAYBE}]) *(?:(?:\d{{1,2}}|[a-z]|[ivx]{{1,4}}) +)??({pattern_of([s for s, _ in table])})(?= *(?:[\n{END}{MAYBE}]|\z))"
    by_id: dict[str, list[str]] = {}
    for s, i in sorted(table, key=lambda x: ("<>" in x[0], -len(x[0]))):  # exact sentences come before those with open places, and long before short ones
        by_id.setdefault(i, []).append(s)

    def name(s: Column) -> Column:
        out = None
        for i, sentences in by_id.items():
            hit = s.rlike(rf"\A(?:{pattern_of(sentences)})\z")
            out = F.when(hit, i) if out is None else out.when(hit, i)
        return out

    return F.transform(F.regexp_extract_all(words, F.lit(pattern), 1), name)


def scan_licenses(df: DataFrame, id_col: str, text_col: str, table: Sequence[tuple[str, str]] = KNOWN, rules: Sequence[tuple[str, Sequence[str]]] = ORDERED) -> DataFrame:
    """One row for each row of df: id, n_known, sentence_ids (parted by blanks), licenses (parted by blanks, in the order of the rules), unmatched.

    A known sentence may be wrapped over lines and stand in a comment; it starts at the start of a line, sentence or list
    item and ends at the end of one, or at a URL. A rule takes its identifiers in their order, others may lie between, as often as they occur.
    unmatched counts identifiers that no rule took. A null or empty text has no sentence: counts 0 and empty strings. Repeated rows come
    out as often; an empty table gives no rows; other columns of df are not read. table and rules are small and fixed: each is a literal in the plan.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    none = F.array().cast("array<string>")
    maybe = reduce(lambda a, b: a | b, [F.contains(F.lower("__text"), F.lit(h)) for h in hints(table)], F.lit(False))
    ids = F.when(maybe, known(normalised(F.col("__text")), table)).otherwise(none)
    rows = rows.withColumn("__ids", ids).drop("__text")
    # A blank around each identifier. What a rule begins with becomes one character, as no rule reaches over its own
    # beginning; atomic groups take the next of its identifiers and never look back, so a rule is linear in the sequence.
    start = F.when(F.size("__ids") > 0, F.concat(F.lit(" "), F.array_join("__ids", "  "), F.lit(" "))).otherwise(F.lit(""))
    fields = ("name", "first", "pattern", "rest")
    plan = [(n, f" {wanted[0]} ", END + "".join(rf"(?>([^{END}]*?) {re.escape(i)} )" for i in wanted[1:]), "".join(f"${k}" for k in range(1, len(wanted)))) for n, wanted in rules]
    steps = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, p, strict=True)]) for p in plan]) if plan else F.array().cast("array<struct<name:string,first:string,pattern:string,rest:string>>")
    state = F.struct(start.alias("s"), none.alias("names"))

    def apply(now: Column, rule: Column) -> Column:
        left = F.replace(F.regexp_replace(F.replace(now["s"], rule["first"], F.lit(END)), rule["pattern"], rule["rest"]), F.lit(END), rule["first"])
        left = F.when(F.contains(now["s"], rule["first"]), left).otherwise(now["s"])
        return F.struct(left.alias("s"), F.when(left != now["s"], F.concat(now["names"], F.array(rule["name"]))).otherwise(now["names"]).alias("names"))

    rows = rows.withColumn("__end", F.when(F.size("__ids") > 0, F.aggregate(steps, state, apply)).otherwise(state))
    return rows.select(
        F.col("__id").alias(id_col),
        F.size("__ids").cast("bigint").alias("n_known"),
        F.array_join("__ids", " ").alias("sentence_ids"),
        F.array_join(F.array_distinct("__end.names"), " ").alias("licenses"),
        F.size(F.filter(F.split("__end.s", " +"), lambda x: x != "")).cast("bigint").alias("unmatched"),
    )

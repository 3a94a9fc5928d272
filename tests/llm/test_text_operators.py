"""Token counts, sentencepiece, packing, licences, language and quality against brute force or the libraries."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm import licence_texts
from tests.llm.data import DOCS, docs, odd_rows, prose
from tokenizers import Tokenizer, models

from tonemark.llm import language_id, licenses, packing, quality_rules, sentencepiece_codec, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    mixed = ["  two  blanks \n lines\n\n", "日本語 text ß é", "a b 　 c", " lead", "trail ", "▁▁ x", "tab\tand\r\n"]
    return [prose(i, 60 + i, ("en", "fr")[i % 2]) for i in range(20)] + mixed


def test_sentencepiece_matches_the_library(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = odd_rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = sentencepiece_codec.round_trip(docs(spark, rows), "doc_id", "text", PIECES, keep_ids=True).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        back = sp.decode(ids)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == want


def test_merge_definition_equals_prefix_table():
    c = sentencepiece_codec.codec(PIECES)
    for unit in ("▁hello", "▁▁▁▁▁x", "▁" * 40, "▁untranslatable", "abcabcabc"):
        assert c.unit_ids(unit) == c.merge(unit)


def test_token_counts_match_wordpiece(spark, texts):
    pieces = token_counts.model_pieces(PIECES)
    piece = Tokenizer(models.WordPiece(vocab={"[UNK]": 0} | {p: i + 1 for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=10**9, continuing_subword_prefix=""))
    rows = odd_rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = token_counts.count_tokens(docs(spark, rows), "doc_id", "text", PIECES).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        cut = [piece.encode("▁" + w, add_special_tokens=False).tokens for w in (t or "").split()]
        want[i, len(cut), sum(map(len, cut)), sum(c == ["[UNK]"] for c in cut)] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_automaton_pops_several_pieces_at_once():
    c = token_counts.Counter(["▁a", "b", "abcdx", "▁abc", "cd", "▁abcdy", "d"])
    assert c.count("abcd") == 2  # ▁abc, d
    assert c.count("ab") == 2
    assert c.count("q") == 0


def test_packing_is_whole_and_close_to_full(spark, texts):
    rows = odd_rows() + [(100 + i, t * (1 + i % 4), "en", "a", 1) for i, t in enumerate(texts)]
    got = packing.pack(docs(spark, rows), "doc_id", "text", JSON, RANKS, group=50).toPandas()
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for k, n in enumerate(packing.cut(len(ids), 1024)):
            want[i if i is not None else -1, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    have = collections.Counter((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024
        assert (s.offset == s.length.cumsum() - s.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 3


def test_packing_queries_have_the_unmodified_library_ids(spark, tmp_path):
    import corpus_pipeline
    from tonemark.llm import queries

    rows = odd_rows() + [(100, "a plain text<|endoftext|>and another", "en", "a", 1), (101, "<|endoftext|>", "en", "a", 1), (102, "日本<|endoftext|> x <|endoftext|", "en", "a", 1)]
    library = Tokenizer.from_file(JSON)
    assert 50256 in library.encode(rows[-3][1], add_special_tokens=False).ids
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for k, n in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    whole = queries.op8_best_fit_packing(spark, str(tmp_path))
    for got in (whole, corpus_pipeline.pack(spark, docs(spark, rows), str(tmp_path))):
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want


def test_search_empties_a_bin_by_exchange():
    # best fit alone would leave three bins: one for one and two for one make room
    sizes = [60, 60, 40, 30, 10]
    bins = packing.search(sizes, [[0, 3], [1, 4], [2]], 100)
    assert sorted(i for b in bins for i in b) == list(range(5))
    assert len(bins) == 2 and all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark, []), "doc_id", "text", JSON, RANKS).count() == 0


LICENSED = [
    (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0"),
    (2, "Released under the MIT License.", "MIT"),
    (3, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "GPL-3.0-only CC-BY-NC-4.0"),
    (4, "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met: x. Nothing known.", ""),
    (5, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)\nany later version.", "GPL-3.0-or-later"),
    (6, "I like licences. All rights reserved.", "Proprietary"),
    (7, None, ""),
    (8, "", ""),
]


def test_licenses(spark):
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t, _ in LICENSED], "doc_id long, text string, licenses string"), "doc_id", "text")
    assert {r.doc_id: r.licenses for r in got.collect()} == {i: x for i, _, x in LICENSED}
    assert licenses.scan_licenses(docs(spark, odd_rows()), "doc_id", "text").count() == len(odd_rows())


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at{0}http://www.apache.org/licenses/LICENSE-2.0{0}Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD2, APACHE2 = "BSDpre BSDsource BSDbinary BSDasis", "Apache2ref Apache2use Apache2copy Apache2asis Apache2see"
WRAPPED = [
    (1, "Copyright (c) 2001, Someone\nAll rights reserved.\n\n" + BSD, "AllRights " + BSD2, "BSD-2-Clause Proprietary"),
    (2, "SPDX-License-Identifier: MIT\n" + BSD, "MITref " + BSD2, "BSD-2-Clause MIT"),
    (3, "A heading\n" + APACHE.format("\n\n    "), APACHE2, "Apache-2.0"),
    (4, APACHE.format(" "), APACHE2, "Apache-2.0"),
    (5, BSD + "\n\n" + APACHE.format("\n"), f"{BSD2} {APACHE2}", "BSD-2-Clause Apache-2.0"),
    (6, "This project is\nlicensed under the MIT license.", "MITref", "MIT"),
    (7, "All rights. Reserved.", "", ""),
]


def test_licenses_wrapped_beside_known_lines(spark):
    got = licenses.scan_licenses(spark.createDataFrame([x[:2] for x in WRAPPED], "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: (r.sentence_ids, r.licenses, r.n_known) for r in got} == {i: (s, x, len(s.split())) for i, _, s, x in WRAPPED}


def licence_rows():
    rows = [(t, n) for x, n in licence_texts.TEXTS for t in (f(x) for f in licence_texts.SHAPES.values())]
    rows += [(a + "\n\n" + b, f"{x} {y}") for a, x in licence_texts.TEXTS for b, y in licence_texts.TEXTS if x != y]
    rows += [
        ("Copyright (c) 2012 Some Widgets Inc. All rights reserved.", "Proprietary"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"),
        ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("All rights reserved.\n" * 3000 + licence_texts.BSD3, "BSD-3-Clause Proprietary"),
        ("* " + "redistribution and use " * 2000, ""),
        (licence_texts.BSD3 + "\n" + licence_texts.BSD3, "BSD-3-Clause"),
        ("All of these rights are\nreserved for licensed software.", ""),
    ]
    return [(i, t, n) for i, (t, n) in enumerate(rows)]


def test_canonical_licence_texts_in_all_shapes_and_mixtures(spark, tmp_path):
    import duckdb

    from tonemark.llm import queries

    rows = licence_rows()
    spark.createDataFrame([*((i, t) for i, t, _ in rows), (-1, None), (-2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_license_scans(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    names = dict(zip(got.doc_id, got.licenses, strict=True))
    assert {i: sorted(names[i].split()) for i, _, _ in rows} == {i: sorted(n.split()) for i, _, n in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op4_license_scans"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert licenses.scan_licenses(docs(spark, []), "doc_id", "text").count() == 0


def test_licenses_agree_with_sql(spark, sf_dir):
    import duckdb

    from tonemark.llm import queries

    got = queries.op4_license_scans(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op4_license_scans"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert (got.licenses != "").sum() > 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_outliers(spark):
    rows = odd_rows() + [(100 + i, prose(i, 120 + i % 50), "en", "a", 1) for i in range(120)]
    junk = [(900 + i, prose(i, 90).replace(" ", "%%% "), "en", "a", 1) for i in range(4)]
    repeats = [(950, "the same three words " * 40, "en", "a", 1), (951, "one line with words\n" * 3 + prose(3, 90), "en", "a", 1)]
    rows += junk + repeats
    got = quality_rules.quality(docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == collections.Counter((i, *brute_counts(t)) for i, t, *_ in rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(100, 220))
    assert not any(by[900 + i].kept for i in range(4))
    assert by[950].base_failed and not by[950].kept
    assert by[951].n_dup_lines == 2
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(docs(spark, [])).count() == 0


def test_mcd_fit_against_numpy(spark):
    """The fit's distances rank planted outliers first, and its mean is that of the clean rows."""
    rng = np.random.default_rng(1)
    clean = rng.multivariate_normal([1, 0, 0, 0.2, 0.8], np.diag([0.02, 0.01, 0.01, 0.02, 0.03]), 400)
    far = clean[:60] + [0, 2, 0, 0, 0]
    frame = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([clean, far])], "g string, x1 double, x2 double, x3 double, x4 double, x5 double")
    fit = quality_rules.fit_mcd(frame, True).first()
    assert abs(fit.m1 - 0) < 0.05 and abs(fit.m0 - 1) < 0.05
    d = quality_rules._distance(frame, quality_rules.fit_mcd(frame, False).drop("middle", "rows"), False).select("x2", "d").toPandas()
    assert d[d.x2 > 1.2].d.min() > d[d.x2 < 0.8].d.max()


def plain_mcd(x):
    """Mean and factor of the half with the least determinant: three starts, two steps of each, and the best one until it stays."""
    n, p = x.shape
    floor = np.array(quality_rules.SPREAD)

    def fit(rows, scale=1.0):
        m, v = rows.mean(axis=0), np.cov(rows.T, bias=True) * scale
        low = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                rest = v[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = max(rest, floor[i] ** 2) ** 0.5 if i == j else rest / low[j, j]
        return m, low

    def distances(f):
        return (np.linalg.solve(f[1], (x - f[0]).T) ** 2).sum(axis=0)

    def step(f):
        d = distances(f)
        return fit(x[d <= np.sort(d)[(n + p + 1) // 2 - 1]])

    det = lambda f: np.log(np.diag(f[1])).sum()
    median = lambda v: (np.sort(np.floor(v * 128), axis=0)[(n + 1) // 2 - 1] + 0.5) / 128
    c = median(x)
    wide = np.maximum(median(abs(x - c)) * 1.4826, floor)
    fits = [step(step(f)) for f in ((c, np.diag(wide)), fit(x), fit(np.clip(x, c - 2 * wide, c + 2 * wide)))]
    best = min(fits, key=det)
    while det(new := step(best)) < det(best) - 1e-9:
        best = new
    d = distances(best)
    near = x[d * quality_rules.CHI2_MEDIAN <= quality_rules.CHI2_NEAR * np.median(d)]
    return best, fit(near, quality_rules.CONSISTENT)


@pytest.mark.parametrize("seed", range(3))
def test_mcd_equals_a_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(5, 5)) * 0.2 + np.diag([0.6, 0.5, 0.7, 0.9, 0.6])
    x = np.vstack([rng.normal(size=(60, 5)) @ mixed, rng.normal(size=(14, 5)) * 0.3 + [4, -3, 5, 4, -4]])
    other = rng.normal(size=(90, 5)) @ mixed.T + 1
    frame = spark.createDataFrame([(g, *map(float, r)) for g, rows in (("a", x), ("b", other)) for r in rows], "g string, x1 double, x2 double, x3 double, x4 double, x5 double")
    raw = {r.g: r for r in quality_rules.least_determinant(frame, True).collect()}
    final = {r.g: r for r in quality_rules.fit_mcd(frame, False).collect()}
    for g, rows in (("a", x), ("b", other)):
        half, near = plain_mcd(rows)
        for got, want in ((raw[g], half), (final[g], near)):
            np.testing.assert_allclose([got[f"m{i}"] for i in range(5)], want[0], atol=1e-6 if got is raw[g] else 0.05)
            np.testing.assert_allclose([got[f"l{i}{j}"] for i in range(5) for j in range(i + 1)], [want[1][i, j] for i in range(5) for j in range(i + 1)], atol=1e-6 if got is raw[g] else 0.05)


def test_small_groups_are_judged_by_their_language(spark):
    rows = [(i, prose(i, 120 + i % 50), "en", "a" if i < 100 else f"s{i}", 1) for i in range(110)] + [(900, prose(1, 90).replace(" ", "%%% "), "en", "s900", 1), (901, prose(2, 90).replace(" ", "%%% "), "xx", None, 1)]
    got = {r.doc_id: r.kept for r in quality_rules.quality(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(110)) and not got[900] and not got[901]
    few = {r.doc_id: r for r in quality_rules.quality(docs(spark, rows[:10])).collect()}
    assert all(r.distance is not None and r.kept for r in few.values())


@pytest.fixture(scope="module")
def network():
    samples = [(prose(i, 60, lang).encode()[:256], lang) for i in range(60) for lang in ("en", "fr")]
    return language_id.train(samples, steps=60)


def test_language(spark, network):
    rows = odd_rows() + [(100 + i, prose(1000 + i, 150, ("en", "fr")[i % 2]), None, None, 1) for i in range(40)]
    got = language_id.identify(docs(spark, rows), network, "doc_id", "text", keep=["lang", "text"]).collect()
    assert len(got) == len(rows)
    right = [r[1] == ("en", "fr")[r[0] % 2] for r in got if r[0] is not None and r[0] >= 100]
    assert sum(right) >= 39
    for r in got:
        assert 0 <= r[2] <= 1
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert r[1] == "und" and r[2] == 0
    assert language_id.identify(docs(spark, rows), None, "doc_id", "text").where("lang_pred <> 'und'").count() == 0


def test_responses_equal_a_plain_convolution(network):
    text = prose(5, 90).encode()
    flat, windows = language_id.flatten([text, b"ab"])
    got = language_id.responses(flat, network.compiled())
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    want = np.concatenate([np.stack([sum(t[k][padded[a + k : a + language_id.WINDOW + k]] for k in range(len(t))).max(axis=0) for a in range(0, len(flat), language_id.WINDOW)]) for t in network.tables], axis=1)
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-4)
    assert windows.tolist() == [len(got) - 1, 1]


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark, network):
    rows = [(i, prose(i, 70), None, None, 1) for i in range(10)]
    one = {r.doc_id: r.score for r in language_id.identify(docs(spark, rows).coalesce(1), network, "doc_id", "text").collect()}
    alone = {r.doc_id: r.score for r in language_id.identify(docs(spark, rows).repartition(10), network, "doc_id", "text").collect()}
    assert all(abs(one[k] - alone[k]) < 1e-6 for k in one)


def test_held_out_accuracy(spark):
    from tonemark.llm import queries

    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_sampling_reads_no_held_out_rows(spark):
    rows = docs(spark, [(i, prose(i, 50), "en", "a", 1) for i in range(30)])
    assert len(language_id.sample_windows(rows.where("doc_id < 5"), "doc_id", "text", "lang", windows=2)) == 10
    assert language_id.sample_windows(spark.createDataFrame([], DOCS), "doc_id", "text", "lang") == []

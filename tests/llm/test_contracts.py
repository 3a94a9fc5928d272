"""What every operator must take: empty tables, clashing columns, many rows without an id, one id with several texts, hubs."""

import collections
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.data import docs, odd_rows, prose

from tonemark.llm import common, jaccard_join, language_id, licenses, multi_index, packing, quality_rules, sentencepiece_codec, token_counts, toxicity, url_filter

PIECES = public_tokenizers.path("piece_bpe_32k.model")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = toxicity.Model({"blemf$": 0}, __import__("numpy").ones(1 + toxicity.EXTRA + len(toxicity.PATTERNS)), -1.0, None, None)


@pytest.fixture(scope="module")
def network():
    return language_id.train([(prose(i, 60, lang).encode()[:256], lang) for i in range(20) for lang in ("en", "fr")], steps=20)


OPERATORS = {
    "toxicity": lambda d, net: toxicity.score(d, MODEL, "doc_id", "text"),
    "sentencepiece": lambda d, net: sentencepiece_codec.round_trip(d, "doc_id", "text", PIECES),
    "licences": lambda d, net: licenses.scan_licenses(d, "doc_id", "text"),
    "quality": lambda d, net: quality_rules.quality(d),
    "language": lambda d, net: language_id.identify(d, net, "doc_id", "text"),
    "packing": lambda d, net: packing.pack(d, "doc_id", "text", JSON, RANKS, special=True).drop("sequence_id", "offset"),
    "join": lambda d, net: jaccard_join.near_duplicates(d),
    "tokens": lambda d, net: token_counts.count_tokens(d, "doc_id", "text", PIECES),
}


def counted(df):
    return collections.Counter(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_columns(spark, network, name):
    run = OPERATORS[name]
    assert run(docs(spark, []), network).count() == 0
    rows = odd_rows() + [(100 + i, prose(i, 70), "en", "a", 1) for i in range(60)]
    plain = docs(spark, rows)
    names = ("id", "key", "sig", "path", "score", "kept", "n_words", "g", "k", "d", "piece", "start", "h", "class_id", "lang_pred", "__id", "__text", "x1", "k0", "pieces", "n_tokens", "licenses", "size")
    clash = plain.withColumns({n: F.lit("other") for n in names if n not in plain.columns})
    got = run(clash, network)
    assert not set(got.columns) - set(run(plain, network).columns)
    assert counted(got) == counted(run(plain, network))


def test_urls_and_vectors_with_clashing_columns(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x", "other"), (None, None, "other")], "page_id long, url string, host string")
    assert counted(url_filter.filter_urls(urls.withColumn("id", F.lit(9)).withColumn("score", F.lit("s")), "page_id", "url", ())) == counted(url_filter.filter_urls(urls, "page_id", "url", ()))
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)], "vec_id long, embedding array<double>")
    clash = vectors.withColumns({n: F.lit(1) for n in ("id", "v", "block", "part", "q", "cell", "cells", "score", "rank", "query_id")})
    assert counted(multi_index.search(clash, "vec_id", "embedding", 10, 5)) == counted(multi_index.search(vectors, "vec_id", "embedding", 10, 5))


def test_many_rows_without_an_id(spark):
    texts = [prose(10_000 + i, 40) for i in range(2_000)]
    copy = prose(7, 60)
    near = copy.split(" ")
    near[-1] = "changed"
    rows = [(None, t) for t in texts] + [(None, copy)] * 2_000 + [(None, " ".join(near))] + [(5, texts[0])]
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, None, 0): 1_999, (None, None, 2_000): 2_001, (None, 5, 1): 1, (5, 5, 1): 1}


def test_links_just_above_the_threshold_are_found(spark):
    """Pairs of a similarity of 0.81 to 0.83: four far words of 200 to 220 changed."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200 + i % 21)]
        other = words[:]
        for place in (20, 70, 120, 170):
            other[place] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_links = 1 and class_id = doc_id - doc_id % 2").count() >= 598


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks compare each pair once; the counts are those of a plain comparison."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 100)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(450):
        words = base[:]
        words[i % 300] = f"x{i}"
        words[(i * 7 + 11) % 300] = f"y{i}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, n) for i, n in enumerate(links)}


def test_hubs_at_either_end(spark, monkeypatch):
    monkeypatch.setattr(common, "MANY", 10)
    edges = [(i, 10**6) for i in range(3_000)] + [(10**7, 10**7 + i) for i in range(1, 3_000)] + [(10**8 + i, 10**8 + i + 1) for i in range(200)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(3_000)} | {10**6: 0} | {10**7 + i: 10**7 for i in range(3_000)} | {10**8 + i: 10**8 for i in range(201)}
    assert got == want


def test_language_of_number_characters_is_unknown(spark, network):
    rows = [(i, t, None, None, 1) for i, t in enumerate(["²", "½ ①", "Ⅷ", "12 34", "٣", "_", "a½", "ª"])]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs(spark, rows), network, "doc_id", "text").collect()}
    assert [got[i] == "und" for i in range(8)] == [True] * 6 + [False] * 2


def test_exchanges_look_at_all_pieces_of_a_bin():
    rng = random.Random(5)
    for trial in range(30):
        sizes = [rng.randint(1, 60) for _ in range(80)]
        bins = packing.pack_sizes(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(80)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 100))
        fill = [sum(sizes[i] for i in b) for b in bins]
        if len(bins) > -(-sum(sizes) // 100):  # a local optimum: no move or exchange that raises the squares is left
            for v, items in enumerate(bins):
                gives = [{i} for i in items] + [{i, k} for i in items for k in items if i < k]
                for b, others in enumerate(bins):
                    if b == v:
                        continue
                    for give in gives:
                        takes = [0, *(sizes[j] for j in others)] if len(give) == 1 else [sizes[j] for j in others]
                        for take in takes:
                            d = sum(sizes[i] for i in give) - take
                            assert not (d > 0 and fill[b] + d <= 100 and fill[v] < 100 and (fill[b] + d) ** 2 + (fill[v] - d) ** 2 > fill[b] ** 2 + fill[v] ** 2)

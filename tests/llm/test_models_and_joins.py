"""Toxicity, URL filters, nearest neighbours, near duplicates and the pipeline against brute force or held-out labels."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.data import docs, odd_rows, prose

from tonemark.llm import common, jaccard_join, multi_index, queries, toxicity, url_filter


def with_insult(i, n=80):
    words = prose(i, n).split(" ")
    rng = random.Random(i)
    for _ in range(3):
        words.insert(rng.randrange(len(words)), rng.choice(["glorkish", "glorkan", "blemf", "blemf"]))
    return " ".join(words)


def test_toxicity_learns_from_labels_and_holds_out(spark):
    rows = [(i, with_insult(i) if i % 5 == 0 else prose(i, 80), "en", "a", 1) for i in range(300)] + [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "GLORKAN!", None, None, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), labels.where("doc_id % 3 <> 1"))
    assert "glork" in model.terms or "glor" in model.terms
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), model, "doc_id", "text").collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300) if i % 3 == 1)
    assert got[1000] < 0.5 and got[1001] < 0.5
    assert all(0 <= s <= 1 for s in got.values())
    assert 0.5 < np.median(model.accuracy) <= 1


def plain_toxicity(text, model):
    """The classifier's score, term by term and pattern by pattern."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    hits = {t for t in model.terms if any(w == t[:-1] if t.endswith("$") else w.startswith(t) and len(t) in toxicity.STEMS for w in words)}
    counts = [len(re.findall(p, text or "")) for p in (r"[A-Z]{4,}[A-Z ,.]*!", r"[!?]{2,}", r"\w[*#@$]{2,}\w?", r"([^\W\d_])\1{3,}")]
    dense = [float(bool(hits)), math.log1p(len(hits)), min(1.0, 20 * len(hits) / max(1, len(words))), *map(math.log1p, counts)]
    n = len(model.terms)
    z = sum(model.weight[model.terms[t]] for t in hits) + sum(w * x for w, x in zip(model.weight[n:], dense, strict=True)) + model.bias
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_scores_equal_a_plain_sum(spark):
    rows = [(i, with_insult(i) if i % 5 == 0 else prose(i, 80), "en", "a", 1) for i in range(200)] + odd_rows() + [(2000, "GLORKAN BLEMF!!! you d**n soooooo blemf", "en", "a", 1)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(7, 1, None), (8, None, 1), (8, 1, 0), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    clash = docs(spark, rows).withColumns({"score": F.lit(9.0), "id": F.lit("x")})
    model = toxicity.learn(clash, labels)
    got = sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score(clash, model, "doc_id", "text").collect())
    assert got == sorted((i or -1, round(plain_toxicity(t, model), 9)) for i, t, *_ in rows)
    assert toxicity.score(docs(spark, []), model, "doc_id", "text").count() == 0
    assert not toxicity.learn(docs(spark, []), labels).terms


def test_label_model_sees_through_copies_of_a_voter():
    rng = np.random.default_rng(8)
    y = rng.random(5000) < 0.3
    noisy = lambda right: np.where(np.where(rng.random(5000) < right, y, ~y), 1, -1)
    bad = noisy(0.62)
    votes = np.stack([*[noisy(0.8) for _ in range(4)], *[np.where(rng.random(5000) < 0.97, bad, -bad) for _ in range(3)]], axis=1)
    post, accuracy, correlation = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == y).mean() > 0.9 > 0.8 > ((votes.sum(axis=1) > 0) == y).mean()
    assert accuracy[:4].min() > accuracy[4:].max() and correlation[4, 5] > 0.8 > correlation[0, 1]


def test_toxicity_without_labels(spark):
    model = toxicity.learn(docs(spark, odd_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs(spark, odd_rows()), model, "doc_id", "text")
    assert got.count() == len(odd_rows()) and got.where("score >= 0.5").count() == 0


def test_label_model_prefers_the_accurate_voter():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y)
    bad = np.where(rng.random(4000) < 0.6, y, ~y)
    votes = np.stack([np.where(v, 1, -1) for v in (good, good ^ (rng.random(4000) < 0.1), bad)], axis=1)
    post, accuracy, correlation = toxicity.label_model(votes, 0.3)
    assert accuracy[0] > accuracy[2]
    assert ((post > 0.5) == y).mean() > 0.8
    assert correlation.shape == (3, 3)


RULES = queries.URL_RULES


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = url_filter.split_url(url)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best


URLS = [
    "http://a.com/x", "http://com/", "http://telecom/x", "http://com", "HTTP://WWW.Example.COM/en/1?q=http://net/es/", "https://example.com/en/", "https://x.www.example.com/en/z#f",
    "http://example.com/eng/", "ftp://b.net/es/q", "http://net/fr/", "http://b.net/esx", "nothing", "", None, "://", "http://ÄÖ.com/", "http://h\nost.com/a\nb?c", "http://u:p@a.com:80/x", "http://a.com://b.net/es/",
    "http://vegas-gamble.top/bonus/claim", "http://thonan.example.org/en/4",
]


def test_url_rules(spark):
    rows = [(i, u, "html", "verdict") for i, u in enumerate(URLS)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = url_filter.filter_urls(frame, "page_id", "url", RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = brute_url(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best[0] + best[1] if best else None)
        assert r.verdict == (best[2] if best else ("block" if r.score >= 0.5 else "allow"))
    by = {r.page_id: r.verdict for r in got}
    assert by[19] == "block" and by[20] == "allow"
    assert url_filter.filter_urls(frame.limit(0), "page_id", "url", RULES).count() == 0


def plain_url_score(url, w, b):
    """The regression's probability by a plain sum over the n-grams of host and path."""
    host, path = url_filter.split_url(url or "")
    seen, total = set(), 0.0
    for mark, part in (("h", f"^{host.lower()}$"), ("p", f"^{path}$")):
        for n in (2, 3, 4, 5):
            for i in range(len(part) - n + 1):
                if (g := mark + part[i : i + n]) not in seen:
                    seen.add(g)
                    total += w[zlib.crc32(g.encode()) % url_filter.DIMS]
    return 1 / (1 + math.exp(-(total / math.sqrt(len(seen)) + b)))


def test_url_model_on_hosts_held_out(spark):
    train, rest = url_filter.sample_urls(), url_filter.sample_urls(held_out=True)
    host = lambda u: url_filter.split_url(u)[0]
    assert not {host(u) for u, _ in train} & {host(u) for u, _ in rest}
    more = ["https://essex.ac.uk/", "http://online-library.com/", "https://en.wikipedia.org/wiki/Malware", "http://track-and-field.org/results", "https://free-software.org/", "", "nothing"]
    frame = spark.createDataFrame(list(enumerate([u for u, _ in rest] + more)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, "page_id", "url", ()).collect()}
    w, b = url_filter.train(train)
    for i, u in frame.collect():
        assert abs(got[i].score - plain_url_score(u, w, b)) < 1e-9
    right = [(got[i].verdict == "block") == bool(label) for i, (_, label) in enumerate(rest)]
    assert np.mean(right) >= 0.8 and all(got[i].verdict == "allow" for i, (_, label) in enumerate(rest) if not label)
    assert all(got[len(rest) + i].verdict == "allow" for i in range(len(more)))


def test_url_table_shares_no_host_or_spam_word_with_the_pages(spark):
    urls = [u for part in (False, True) for u, _ in url_filter.sample_urls(part)]
    hosts = {r.host for sf in ("0.01", "0.1") for r in queries.op2_url_filters(spark, f"/root/testdata/sf{sf}").select("host").distinct().collect()}
    assert not hosts & {url_filter.split_url(u)[0] for u in urls}
    spam = {w for h in hosts for label in h.split(".") if "-" in label for w in label.split("-")}
    assert not spam & set(re.findall("[a-z]+", " ".join(urls)))


def test_url_model_allows_ordinary_pages(spark):
    got = queries.op2_url_filters(spark, "/root/testdata/sf0.01").where(~F.col("host").contains("-")).select("score").collect()
    assert np.mean([r.score < 0.5 for r in got]) > 0.98


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_neighbours(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(v) and len(v) == 8}
    out = {}
    for q in ok:
        if q % every == 0:
            s = {i: float((ok[q] * v).sum() / (np.linalg.norm(v) * np.linalg.norm(ok[q]))) for i, v in ok.items() if i != q}
            out[q] = sorted(s, key=lambda i: (-round(s[i], 12), i))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # many equal vectors: ties go to the smaller id
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [1.0] * 5), (None, [1.0] * 8), (1050, [float("inf")] * 8)]
    got = multi_index.search(vectors(spark, [(i, v, 0) for i, v in rows + odd]), "vec_id", "embedding", 10, 5)
    found = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
    want = brute_neighbours(rows, 10, 5)
    assert found.keys() == want.keys()
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert found[410] == [3, 400, 401, 402, 403]


def test_neighbours_of_few_and_none(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 0), (50, [1.0, 1.0], 0), (50, [1.0, 1.0], 0)])
    assert [(r.query_id, r.rank, r.vec_id) for r in multi_index.search(few, "vec_id", "embedding", 50, 5).orderBy("query_id").collect()] == [(0, 1, 50), (50, 1, 0)]
    assert multi_index.search(few.limit(0), "vec_id", "embedding", 50, 5).count() == 0
    assert multi_index.search(few.where("vec_id = 0"), "vec_id", "embedding", 50, 5).count() == 0


def test_recall_on_the_embeddings(spark):
    got = queries.op5_nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    hit = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -2
        best = set(ids[np.argsort(-s)[:5]])
        hit += len(best & set(got[got.query_id == ids[q]].vec_id))
        n += 5
    assert hit / n >= 0.9


def test_heap_order_is_the_order_of_sums():
    rng = np.random.default_rng(5)
    a, b = rng.random(7), rng.random(9)
    cells = multi_index.visited(a, b, np.ones(63, dtype=int), 63)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)


def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else None))
    link = [[j for j, (_, b) in enumerate(sets) if j != k and a is not None and b is not None and len(a & b) >= 0.8 * len(a | b)] for k, (_, a) in enumerate(sets)]
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for k, near in enumerate(link):
            m = min([label[k], *(label[j] for j in near)])
            if m != label[k]:
                label[k], changed = m, True
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[label[k]].append(i)
    return collections.Counter((i, min((x for x in ids[label[k]] if x is not None), default=None), len(link[k])) for k, (i, _) in enumerate(sets))


def near_rows():
    rng = random.Random(6)
    rows = [(i, prose(i, 60 + i % 90)) for i in range(60)]
    for g in range(12):  # groups of copies and near copies, chains included
        words = prose(g, 120).split(" ")
        for k in range(rng.randint(2, 9)):
            rows.append((1000 + 20 * g + k, " ".join(words)))
            words = words[:]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
    shared = prose(77, 50)  # a passage that many texts share
    rows += [(2000 + i, shared + "\n" + prose(5000 + i, 50)) for i in range(60)]
    rows += [(3000, "one two"), (3001, "One  TWO"), (3002, "one two three"), (3003, None), (3004, ""), (3005, " \n"), (None, "one two"), (3000, "one two")]
    return rows


@pytest.mark.parametrize("limits", [(32, 2048, 512), (4, 10, 5)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("SMALL", "LARGE", "BLOCK"), limits, strict=True):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, class_id long, key string")
    got = jaccard_join.near_duplicates(frame).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)


def test_near_duplicates_of_odd_rows(spark):
    assert jaccard_join.near_duplicates(docs(spark, odd_rows())).count() == len(odd_rows())
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_recall_rule():
    assert jaccard_join.runs_for() >= 2
    assert jaccard_join.runs_for(0.9999) > jaccard_join.runs_for(0.9)


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "a", 1) for i, t in near_rows() if i is not None and i < 3000] + [(5000, "12345 678", None, None, 1), (5001, None, None, None, None), (5002, prose(1, 90).replace(" ", "### "), "en", "a", 1), (1000, prose(0, 120), "en", "a", 1)]
    frame = docs(spark, rows).withColumns({"score": F.lit(1.5), "kept": F.lit("x"), "id": F.col("doc_id")})
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    now = frame
    (_, language), (_, quality), (_, near), (_, pack) = corpus_pipeline.STAGES
    now = language(spark, now, str(tmp_path))
    assert now.schema.names == frame.schema.names
    assert {5000, 5001} & {r.doc_id for r in now.collect()} == set()
    assert now.count() == len(rows) - 2
    now = quality(spark, common.materialize(now, "t"), str(tmp_path))
    assert now.schema.names == frame.schema.names
    left = {r.doc_id for r in now.collect()}
    assert 5002 not in left and {i for i, *_ in rows if i < 5000} == left
    before = [(r.doc_id, r.text) for r in now.collect()]
    now = near(spark, common.materialize(now, "t"), str(tmp_path))
    assert now.schema.names == frame.schema.names
    first = sorted({c for _, c, _ in brute_classes(before)})
    assert sorted(r.doc_id for r in now.collect()) == first
    packed = pack(spark, common.materialize(now, "t"), str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(first)
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_near_duplicates_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (prose(900 + i, 80) for i in range(4))
    # under id 2 a copy of id 1's text and one of its own; null ids with a copy of each other, and one of id 3's
    rows = [(1, a), (2, a), (2, b), (3, c), (None, d), (None, d), (None, c), (4, b), (None, None), (5, ""), (6, c)]
    frame = docs(spark, [(i, t, "en", "a", 1) for i, t in rows]).withColumns({"row": F.lit(1), "first": F.lit(2)})
    got = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path))
    assert got.columns == frame.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(1, a), (2, b), (3, c), (None, d), (None, None), (5, "")])

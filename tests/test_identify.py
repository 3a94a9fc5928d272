"""The plans against the sequential statement, and identification of known clips end to end."""

import random

import pytest
from pyspark.sql import functions as F
from tests import sequential

from tonemark import errors
from tonemark.operators import index, match, xscale
from tonemark.plans import engine

QLF = "fid int, lid int, t int, f int, w int, e int"
QUERY = "query_id int, block_no int, lid int, t int, f int, w int, e int"


def recording(seed, n, words=100):
    rng = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += rng.choice((0, 2, 3, 4, 6))
        out.append({"t": t, "f": rng.randrange(36, 557), "w": rng.randrange(words), "e": rng.randrange(50, 256)})
    return out


def clip(seq, start, n, seed, wrong=0.2):
    rng = random.Random(seed)
    t0 = seq[start]["t"]
    out = []
    for lid, x in enumerate(seq[start : start + n]):
        w = (x["w"] + 1) % 100 if rng.random() < wrong else x["w"]
        out.append({"lid": lid, "t": x["t"] - t0, "f": x["f"], "w": w, "e": x["e"], "block_no": (x["t"] - t0) // 130})
    return out


@pytest.fixture(scope="module")
def world(spark):
    recs = {fid: recording(fid, 350, 100 if fid < 8 else 6) for fid in range(1, 13)}
    queries = {q: clip(recs[q], 40 + 10 * q, 150, q) for q in (1, 2, 9)}
    queries[50] = clip(recording(500, 460), 0, 455, 50)  # in no recording, and long enough for a decision
    queries[51] = clip(recording(501, 30), 0, 15, 51)  # less than one batch
    queries[52] = clip(recs[3][:200] + recs[4][:200], 0, 130, 52, 0.6)
    flat = [(fid, lid, x["t"], x["f"], x["w"], x["e"]) for fid, s in recs.items() for lid, x in enumerate(s)]
    rows = [(q, x["block_no"], x["lid"], x["t"], x["f"], x["w"], x["e"]) for q, s in queries.items() for x in s]
    return recs, queries, spark.createDataFrame(flat, QLF), spark.createDataFrame(rows, QUERY)


@pytest.mark.parametrize("kind", ["MSCALE", "XSCALE"])
def test_candidates_and_scores(world, kind):
    recs, queries, qlf, rows = world
    batches = match.full_batches(rows)
    postings = index.build(qlf, kind)
    top = match.search(batches, postings)[2] if kind == "MSCALE" else xscale.search(batches, rows, postings)[2]
    got = {(r.query_id, r.batch, r.fid): (r.score, r.bin) for r in top.collect()}
    want = {}
    for q, s in queries.items():
        m = sequential.Matcher(recs, kind)
        for block in range(max(x["block_no"] for x in s) + 1):
            m.x += [x for x in s if x["block_no"] == block]
            while len(m.x) - m.done >= 20:
                for score, fid, b, _ in m.candidates(m.done, m.done + 20):
                    want[q, m.done // 20, fid] = (score, b)
                m.done += 20
    assert got == want and len(want) > 20


@pytest.mark.parametrize("kind,threshold", [("MSCALE", 0.0), ("MSCALE", 0.5), ("MSCALE", 1.0), ("XSCALE", 0.5), ("XSCALE", 1.0)])
def test_identification(world, kind, threshold):
    recs, queries, qlf, rows = world
    got = engine.identify(rows, index.build(qlf, kind), qlf, engine.Config(match_type=kind, rerank_threshold=threshold)).collect()
    for q, s in queries.items():
        status, fids = sequential.identify(s, recs, kind, mms=threshold)
        mine = [r for r in got if r.query_id == q]
        assert {r.status for r in mine} == {status}, (q, status, mine)
        assert sorted(r.fid for r in mine if r.fid is not None) == fids
    found = {r.query_id: r.fid for r in got}
    assert found[1] == 1 and found[2] == 2 and found[51] is None


def test_accumulated_scores_with_rerank(world):
    recs, queries, qlf, rows = world
    batches = match.full_batches(rows)
    parts = engine.contributions(batches, rows, index.build(qlf), qlf, engine.Config(rerank_threshold=1.0))
    got = {(r.query_id, r.fid): r.s for r in parts.groupBy("query_id", "fid").agg(F.sum("score").alias("s")).collect()}
    for q, s in queries.items():
        m = sequential.Matcher(recs, mms=1.0)
        for block in range(max(x["block_no"] for x in s) + 1):
            m.process([x for x in s if x["block_no"] == block])
        assert {f: a for f, a in m.acc.items() if a} == {f: a for (k, f), a in got.items() if k == q}


def test_binary(world):
    _, _, qlf, rows = world
    got = {r.query_id: r for r in engine.identify(rows, index.build(qlf), qlf, engine.Config(id_type="BINARY", binary_threshold=0.7)).collect()}
    assert got[1].fid == 1 and got[1].id_class == "IDENTIFIED" and got[1].confidence >= 0.7
    assert got[51].status == "PENDING"


def test_json_has_escaped_metadata(spark, world):
    _, _, qlf, rows = world
    result = engine.identify(rows.where("query_id in (1, 51)"), index.build(qlf), qlf)
    meta = spark.createDataFrame([(1, 'a "quoted" name')], "fid int, meta string")
    out = {r.query_id: r.json for r in engine.as_json(engine.with_metadata(result, meta)).collect()}
    assert r'"Metadata":"a \"quoted\" name"' in out[1] and '"Matches":[]' in out[51]


@pytest.mark.parametrize("bad", [{"match_type": "X"}, {"id_type": "X"}, {"id_mode": "X"}, {"rerank_threshold": 1.1}, {"binary_threshold": 0.4}, {"binary_min_time": 21}, {"max_recording": 0}, {"step_seconds": 3}])
def test_parameters(bad):
    with pytest.raises(errors.InvalidParameter):
        engine.Config(**bad)


def test_sequence(spark):
    good = spark.createDataFrame([(1, 0, 0, 0, 36, 0, 0), (1, 0, 1, 1, 36, 0, 0)], QUERY)
    engine.check_sequence(good)
    with pytest.raises(errors.InvalidMatchSequence):
        engine.check_sequence(good.where("lid = 1"))


def test_empty_queries_and_index(spark, world):
    _, _, qlf, rows = world
    assert engine.identify(rows.limit(0), index.build(qlf), qlf).count() == 0
    got = engine.identify(rows.where("query_id = 1"), index.build(qlf.limit(0)), qlf.limit(0)).collect()
    assert [r.status for r in got] == ["PENDING"]


def test_float_quotients():
    """Pairs are told apart by 32-bit quotients: not by integer division."""
    assert sequential.units(4, 9, 5.0) == 0
    assert sequential.units(0, 5, 5.0) == 1


def test_terms_stay_below_the_largest(world):
    from tonemark.functions.terms import max_term

    _, _, qlf, _ = world
    for kind in ("MSCALE", "XSCALE"):
        assert index.build(qlf, kind).agg(F.max("term")).first()[0] <= max_term(kind)
    assert max_term("MSCALE") == 6462

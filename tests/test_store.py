"""Sessions, invariants, merge and re-index of the store."""

import pytest
from pyspark.sql import functions as F

from tonemark import errors
from tonemark.operators import index
from tonemark.sources import synthetic
from tonemark.sources.store import FingerprintStore, IndexSession, reindex, session


@pytest.fixture(scope="module")
def recs(spark):
    return synthetic.recordings(spark, 6, seed=3).cache()


def test_synthetic_recordings_keep_the_invariants(recs):
    assert index.invariants(recs).where("violations > 0").count() == 0
    assert recs.select("fid").distinct().count() == 6


def test_build_and_read(spark, tmp_path, recs):
    store = FingerprintStore(spark, str(tmp_path), "BUILD")
    assert store.is_empty() and store.match_type() is None
    with session(store) as s:
        s.index(recs.where("fid < 4"))
        s.index(recs.where("fid >= 4"))
    assert store.fingerprints_count() == 6 and store.match_type() == "MSCALE"
    assert store.read("index").exceptAll(index.build(recs)).count() == 0
    assert store.fingerprint(5).count() == recs.where("fid = 5").count()
    assert [r.lid for r in store.fingerprint(5, 10, 3).orderBy("lid").collect()] == [10, 11, 12]
    term = store.read("index").first()["term"]
    lists = store.postings(term).orderBy("fid").collect()
    assert all([o.lid for o in r.occ] == sorted({o.lid for o in r.occ}) and r.tf == len(r.occ) for r in lists)
    store.put_metadata(spark.createDataFrame([(1, "one")], "fid int, meta string"))
    assert {r.fid: r.meta for r in store.metadata(recs.select("fid").distinct()).collect()} == {1: "one"} | dict.fromkeys(range(2, 7), "")
    other = FingerprintStore(spark, str(tmp_path / "small"), "BUILD")
    store.compact(other)
    assert other.read("index").count() == store.read("index").count()
    store.clear()
    assert store.is_empty()


def test_states_and_refusals(spark, tmp_path, recs):
    store = FingerprintStore(spark, str(tmp_path), "BUILD")
    s = IndexSession(store)
    with pytest.raises(errors.InvalidIndexerState):
        s.index(recs)
    with pytest.raises(errors.InvalidIndexerState):
        s.end()
    s.start()
    with pytest.raises(errors.InvalidIndexerState):
        s.start()
    s.index(recs.where("fid = 3"))
    for old in (2, 3):
        with pytest.raises(errors.InvalidParameter):
            s.index(recs.where(F.col("fid") == old))
    with pytest.raises(errors.InvalidFingerprint):
        s.index(recs.where("fid = 4 and lid > 5"))
    s.index(recs.limit(0))
    s.end()
    with pytest.raises(errors.InvalidParameter):
        IndexSession(store, "XSCALE").start()
    with pytest.raises(errors.InvalidIndexerState):
        FingerprintStore(spark, str(tmp_path)).put_metadata(spark.createDataFrame([(1, "x")], "fid int, meta string"))
    with pytest.raises(errors.InvalidParameter):
        FingerprintStore(spark, str(tmp_path), "WRITE")


def test_merge_of_a_delta(spark, tmp_path, recs):
    with session(FingerprintStore(spark, str(tmp_path), "BUILD")) as s:
        s.index(recs.where("fid <= 3"))
    store = FingerprintStore(spark, str(tmp_path), "BUILD_MERGE")
    with session(store) as s:
        s.index(recs.where("fid > 3"))
        assert store.read("index").agg(F.max("fid")).first()[0] == 3
    assert store.read("index").exceptAll(index.build(recs)).count() == 0
    assert store.read("delta").isEmpty()
    store._write(index.build(recs.where("fid = 2")), "delta")
    with pytest.raises(errors.InvalidIndexData):
        store.merge()


def test_reindex(spark, tmp_path, recs):
    a, b = FingerprintStore(spark, str(tmp_path / "a"), "BUILD"), FingerprintStore(spark, str(tmp_path / "b"), "BUILD")
    with session(a) as s:
        s.index(recs)
    reindex(a, b, "XSCALE")
    assert b.match_type() == "XSCALE" and b.read("index").count() == index.build(recs, "XSCALE").count()
    assert b.read("fingerprints").isEmpty()

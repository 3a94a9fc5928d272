"""Candidate search in tasks that meet a part of the recordings with a part of the queries."""

import duckdb
import pytest
from tests.test_catalogue import rows

from tonemark.operators import grid, local_graphs
from tonemark.plans import catalogue, oracle


@pytest.mark.parametrize("name", ["candidates_join", "bin_first_hit", "best_bin", "topk_candidates"])
def test_many_small_tasks_equal_sql(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(grid, "HELD", 500)
    monkeypatch.setattr(grid, "ASKED", 5)
    monkeypatch.setattr(grid, "CHUNK", 40)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(oracle.sql(name)).df())


@pytest.mark.parametrize("name", ["candidates_join", "bin_first_hit", "time_order_scores", "bin_scores", "best_bin", "cue_points"])
def test_hits_are_neither_shuffled_nor_sorted(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not any(x in above for x in ("Join", "Aggregate", "Window", "Repartition", "Sort"))


@pytest.mark.parametrize("name", ["peak_bins", "graph_edges", "graph_common", "graph_rerank"])
def test_graphs_in_many_small_tasks_equal_sql(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(local_graphs, "HELD", 500)
    monkeypatch.setattr(local_graphs, "PAIRS", 7)
    monkeypatch.setattr(grid, "CHUNK", 40)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf_dir)
    assert rows(got.toPandas()) == rows(con.sql(oracle.sql(name)).df())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    # neighbourhoods and their edges are neither joined nor shuffled; centres are made distinct
    assert not any(x in above for x in ("Join", "Generate", "Window", "Repartition", "Sort"))


def test_graphs_with_gaps_in_recordings_equal_joins(spark, sf_dir):
    from pyspark.sql import functions as F

    from tonemark.operators import match, rerank
    from tonemark.plans.catalogue import Stages

    s = Stages(spark, sf_dir, keep=True)
    some = s.qlf.where(F.col("lid") % 7 != 3)
    scored = match.candidate_scores(s.doubtful, s.batches, s.postings)
    pairs = rerank.centre_pairs(scored, match.peaks(match.bin_scores(scored), s.doubtful))
    want = rerank.rerank(rerank.common_edges(pairs, s.batches, s.q, some))
    got = local_graphs.search(s.doubtful, s.batches, s.q, s.postings, some, "again")
    assert rows(got.toPandas()) == rows(want.toPandas()) != []


def test_distinct_pairs_need_no_shuffle_of_pairs(spark, sf_dir):
    from tonemark.operators import index
    from tonemark.sources import fixtures

    qlf = fixtures.corpus(spark, sf_dir)
    got = index.build(qlf, "XSCALE")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    key = ["term", "fid", "lid", "t", "e"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, index.pair_terms(qlf).select(*key).distinct().collect()))


@pytest.mark.parametrize(("recordings", "terms", "share"), [(2000, 5800, 0.1), (30, 5800, 0.5), (100, 200, 1.0)])
def test_top_candidates_score_few_hits(monkeypatch, recordings, terms, share):
    import numpy as np

    rng = np.random.default_rng(3)
    n, asked = recordings * 600, 20 * 20
    lid = np.tile(np.arange(600), recordings)
    rows = {"fid": np.repeat(np.arange(recordings), 600), "lid": lid, "t": 4 * lid + rng.integers(0, 3, n), "e": rng.integers(50, 256, n), "term": rng.integers(0, terms, n)}
    book = grid.Book({c: v.astype(np.int32) for c, v in rows.items()}, True)
    row, k, eq = np.repeat(np.arange(20), 20), np.tile(np.arange(20), 20), rng.integers(50, 256, asked)
    start, size = book.find(rng.integers(0, terms, asked))
    want = grid._chunk(book, "best", 11, row, k, eq, start, size)
    lead = grid._leading(want["row"], want["fid"], want["score"], 11)
    scored, scores = [], grid._scores
    monkeypatch.setattr(grid, "_scores", lambda key, *x: scored.append(len(key)) or scores(key, *x))
    got = grid._chunk(book, "top", 11, row, k, eq, start, size)
    for c in grid.COLUMNS["top"][2:]:
        assert got[c].tolist() == want[c][lead].tolist() != []
    assert sum(scored) <= share * size.sum()


def test_postings_and_queries_are_dealt_with_few_copies():
    # six times sf0.1 with a tenth of the recordings asked and with all; sixty times; far more
    assert grid.shares(3_600_000, 7_929, 16) == (16, 1)
    assert grid.shares(3_600_000, 79_290, 16) == (5, 4)
    assert grid.shares(36_000_000, 79_290, 16) == (16, 1)
    assert grid.shares(360_000_000, 792_900, 16) == (90, 4)
    assert grid.shares(0, 0, 16) == (1, 16)


@pytest.mark.parametrize("x", [[7], [0, 5, 300, -4], [-(2**31), 2**31 - 1], [2**31 - 1, -(2**31), 0], [-(2**31)] * 20 + [2**31 - 1], list(range(600)) * 3])
def test_blocks_keep_their_numbers(x):
    import numpy as np

    got = grid.unpacked(grid._block(np.array(x, np.int32)) + grid._block(np.array([1, 2], np.int32)))
    assert [y.tolist() for y in got] == [x, [1, 2]] and got[0].dtype == np.int32


def test_a_recording_in_order_takes_a_byte_for_a_step():
    import zlib

    import numpy as np

    lid = np.tile(np.arange(600), 4)
    t, e = 4 * lid + lid % 7 % 3, 50 + lid * 131 % 206
    assert [len(grid._block(x)) < len(x) * n + 30 for x, n in ((lid[:600], 1), (t[:600], 1), (e, 1))] == [True] * 3
    assert len(zlib.compress(grid._block(lid))) < 100


@pytest.mark.parametrize("name", ["candidates_join", "bin_first_hit"])
def test_a_list_is_yielded_on_end_to_all_that_ask_for_it(spark, sf_dir, tmp_path, name):
    from pyspark.sql import functions as F

    got = catalogue.QUERIES[name](spark, sf_dir)
    task = got.withColumn("n", F.monotonically_increasing_id()).toPandas().sort_values("n")
    columns = task[["query_id", "batch", "k"]].ne(task[["query_id", "batch", "k"]].shift()).any(axis=1)
    asked = task.groupby(["query_id", "batch", "k", task["n"].to_numpy() // 2**33]).ngroups
    # each query fingerprint's rows stand together in a task, none between those of another one
    assert columns.sum() == asked

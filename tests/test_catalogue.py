"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tonemark.plans import catalogue, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.sql(oracle.sql(name)).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracle.QUERIES) - {"stream_identify"}))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_stream_decides_as_the_batch_plan_does(spark, sf_dir):
    whole = catalogue.QUERIES["fuzzy_identify_flush"](spark, sf_dir).where("status <> 'PENDING'").toPandas()
    stream = catalogue.QUERIES["stream_identify"](spark, sf_dir).toPandas()
    assert rows(stream) == rows(whole)


def test_all_queries_ask_every_recording_and_row(spark, tmp_path):
    from pyspark.sql import functions as F

    from tonemark.sources import fixtures

    supplier = F.col("id") % 13
    lines = spark.range(13 * 230).where((supplier != 12) | (F.col("id") < 13 * 50)).select(supplier.alias("l_suppkey"), F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") * 7 % 2000).alias("l_partkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(900).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = lambda q: {r.query_id: (r.n, r.a, r.b) for r in q.groupBy("query_id").agg(F.count("*").alias("n"), F.min("lid").alias("a"), F.max("lid").alias("b")).collect()}
    whole = sizes(fixtures.all_query_fingerprints(spark, str(tmp_path)))
    assert whole == {i: (120, 0, 119) for i in range(1, 13)} | {13: (50, 0, 49)} | {1_000_000 + i: (n, 0, n - 1) for i, n in enumerate((400, 400, 100))}
    few = sizes(fixtures.query_fingerprints(spark, str(tmp_path)))
    assert few == {10: (120, 0, 119), 1_000_000: (90, 0, 89)}  # one recording, and the orders of nine customers


def test_all_queries_agree_with_the_query_set(spark, sf_dir):
    whole, few = (catalogue.QUERIES[n](spark, sf_dir).toPandas() for n in ("fuzzy_identify_all", "fuzzy_identify"))
    own = few[few.query_id < 1_000_000]
    assert rows(whole[whole.query_id.isin(own.query_id)]) == rows(own)
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    own = whole[whole.query_id < 1_000_000]
    assert len(own) == n and (own.fid == own.query_id).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

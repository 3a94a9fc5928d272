"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tonemark.plans.scratch import materialize, shared_dir  # noqa: F401

#: Rows that become Python objects at once.
ROWS = 1_000
#: Rows that components() may broadcast.
MANY = 50_000

#: White space that separates words everywhere in this subpackage.
BLANKS = r"[\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over columns as Python lists. make() runs once in each task and returns the function for a batch."""
    spark = df.sparkSession
    out = pa_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):  # few texts at once as Python objects
                yield pa.RecordBatch.from_pydict(each(batch.slice(a, ROWS).to_pydict()), schema=out)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def words_bytes(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased. bytes.split parts at BLANKS exactly."""
    return text.encode("utf-8", "surrogatepass").lower().split()


#: A character of one of the Unicode categories of letters; digits of any script, fractions and number forms are none.
LETTER = regex.compile(r"\p{L}")


def map_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], schema: str) -> DataFrame:
    """Like map_arrow, for the rows of one key at a time; only one group is held. The groups must be of bounded size."""
    spark = df.sparkSession
    out = pa_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        held: dict[str, list] | None = None
        ready: dict[str, list] = {n: [] for n in out.names}

        def done(group):
            for n, v in (each(group) or {}).items():
                ready[n].extend(v)

        for batch in batches:
            x = batch.to_pydict()
            marks = list(zip(*(x[k] for k in keys), strict=True))
            a = 0
            while a < len(marks):
                b = a + 1
                while b < len(marks) and marks[b] == marks[a]:
                    b += 1
                part = {n: v[a:b] for n, v in x.items()}
                if held is not None and tuple(held[k][0] for k in keys) == marks[a]:
                    for n, v in part.items():
                        held[n].extend(v)
                else:
                    if held is not None:
                        done(held)
                    held = part
                a = b
            if len(ready[out.names[0]]) >= 5_000:
                yield pa.RecordBatch.from_pydict(ready, schema=out)
                ready = {n: [] for n in out.names}
        if held is not None:
            done(held)
        if ready[out.names[0]]:
            yield pa.RecordBatch.from_pydict(ready, schema=out)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for each node of edges (a, b) the least node of its connected component.

    Alternating large-star and small-star steps, each an aggregation and a join; a written table cuts the lineage after
    each round, and the rounds end when the edges no longer change. Every component ends as a star around its least node.
    """
    from pyspark.sql import functions as F

    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if mark["n"] == 0 or (mark["n"], mark["x"]) == seen:
            break
        seen = (mark["n"], mark["x"])
        # with n edges at most MANY nodes have over 2 n / MANY neighbours, so that a table of these may be broadcast
        bar = max(1_000, 2 * mark["n"] // MANY)
        # large star: each node links its larger neighbours to the least one around it
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_to_least(both, bar, name).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), name)
        # small star: each node links its smaller neighbours, and itself, to the least of them
        low = _to_least(large.select(F.col("b").alias("a"), F.col("a").alias("b")), bar, name)
        now = materialize(low.select(F.col("m").alias("a"), "b").union(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), name)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _to_least(pairs: DataFrame, bar: int, name: str) -> DataFrame:
    """a, b and m, the least of a's neighbours b and a itself. A node with over `bar` neighbours would meet all of them in one
    task of a join by node: its minimum goes to them as a broadcast instead, and only the others are joined by node."""
    from pyspark.sql import functions as F

    least = materialize(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("c")), name)
    hot = least.where(F.col("c") > bar).select("a", "m")
    rest = pairs.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.where(F.col("c") <= bar).select("a", "m"), "a")
    return pairs.join(F.broadcast(hot), "a").unionByName(rest)

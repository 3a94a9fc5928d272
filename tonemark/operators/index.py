"""Index build: terms, pairs of terms, postings, and checks of what was built."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tonemark import params as P
from tonemark.functions import terms as T
from tonemark.functions.codec import byte_counts


def single_terms(qlf: DataFrame) -> DataFrame:
    """term, fid, lid, t, e: one for each fingerprint."""
    return qlf.select(T.single_term(F.col("w"), F.col("f")).alias("term"), "fid", "lid", "t", "e")


def pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows and, for each, its followers in the same band: at most PAIRS, within PAIR_FRAMES frames. Adds term, lid2."""
    w = Window.partitionBy(*by, "band").orderBy("lid").rowsBetween(1, P.PAIRS)
    banded = rows.withColumn("band", T.band(F.col("f")))
    near = banded.withColumn("near", F.collect_list(F.struct("lid", "t", "f", "w")).over(w))
    out = near.withColumn("n", F.explode("near")).drop("near").where(F.col("n.t") - F.col("t") <= P.PAIR_FRAMES)
    vpt, vpf = T.steps(F.col("t"), F.col("n.t"), P.QT), T.steps(F.col("f"), F.col("n.f"), P.QF)
    return out.withColumn("term", T.pair_term(F.col("w"), F.col("band"), F.col("n.w"), vpt, vpf)).withColumn("lid2", F.col("n.lid")).drop("n", "band")


def pair_terms(qlf: DataFrame) -> DataFrame:
    """term, fid, lid, t, e for each pair; the posting is the first one's."""
    return pairs(qlf, ["fid"]).select("term", "fid", "lid", "t", "e")


def distinct_pair_terms(qlf: DataFrame) -> DataFrame:
    """pair_terms, each fingerprint once under a term. Its pairs (PAIRS at most) stand in one row, so equal ones are dropped there, without a shuffle."""
    w = Window.partitionBy("fid", "band").orderBy("lid").rowsBetween(1, P.PAIRS)
    rows = qlf.withColumn("band", T.band(F.col("f"))).withColumn("near", F.collect_list(F.struct("t", "f", "w")).over(w))

    def term(n: Column) -> Column:
        vpt, vpf = T.steps(F.col("t"), n["t"], P.QT), T.steps(F.col("f"), n["f"], P.QF)
        return T.pair_term(F.col("w"), F.col("band"), n["w"], vpt, vpf)

    near = F.filter("near", lambda n: n["t"] - F.col("t") <= P.PAIR_FRAMES)
    return rows.select(F.explode(F.array_distinct(F.transform(near, term))).alias("term"), "fid", "lid", "t", "e")


def distinct_terms(rows: DataFrame) -> DataFrame:
    """A fingerprint is listed once under a term."""
    return rows.dropDuplicates(["term", "fid", "lid"])


def postings(rows: DataFrame) -> DataFrame:
    """term, fid, tf, occ: occurrences in order."""
    return rows.groupBy("term", "fid").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list(F.struct("lid", "t", "e"))).alias("occ"))


def build(qlf: DataFrame, match_type: str = "MSCALE") -> DataFrame:
    """Flat postings (term, fid, lid, t, e) of recordings (fid, lid, t, f, w, e)."""
    return single_terms(qlf) if match_type == "MSCALE" else distinct_pair_terms(qlf)


def invariants(qlf: DataFrame) -> DataFrame:
    """rule, violations: what must hold for every recording."""
    w = Window.partitionBy("fid").orderBy("lid")
    rows = qlf.withColumns({"pl": F.lag("lid").over(w), "pt": F.lag("t").over(w)})
    bad = {
        "lid_consecutive": F.col("lid") != F.coalesce(F.col("pl") + 1, F.lit(0)),
        "t_monotone": F.col("t") < F.col("pt"),
        "f_range": ~F.col("f").between(P.K_MIN, P.K_MAX),
        "w_range": ~F.col("w").between(0, P.WORDS - 1),
        "e_range": ~F.col("e").between(0, P.MAX_ERROR),
        "fid_positive": F.col("fid") < 1,
    }
    counts = rows.agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    return counts.select(F.explode(F.create_map(*[x for k in bad for x in (F.lit(k), F.col(k))])).alias("rule", "violations"))


def _sizes(x: np.ndarray) -> np.ndarray:
    return byte_counts(np.asarray(x, dtype=np.int64).astype(np.uint64))


#: Postings that a task of a layout takes, unless a term alone has more.
ROWS = 500_000


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """term, fid, tf, body of each posting, from occurrences in order, some thousand at a time. body: bytes without the recording's number."""
    size = lambda x: 1 + np.searchsorted(np.array([128, 16384, 2097152, 268435456]), x, side="right")
    none = np.zeros(0, dtype=np.int64)
    held, kept = None, (none,) * 4  # of the last posting, which may go on: its last occurrence; its row
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.array([b[c].to_numpy() for c in ("term", "fid", "lid", "t", "e")], dtype=np.int64)
        before = np.concatenate([rows[:, :1] - 1 if held is None else held, rows[:, :-1]], axis=1)
        new = (rows[:2] != before[:2]).any(axis=0)
        body = sum(size(rows[i] - np.where(new, 0, before[i])) for i in (2, 3)) + size(rows[4])
        first = np.flatnonzero(new)
        edge = np.concatenate([[0], first[first > 0], [b.num_rows]])
        n, total = np.diff(edge), np.add.reduceat(body, edge[:-1])
        term, fid = rows[0, edge[:-1]], rows[1, edge[:-1]]
        if not new[0]:
            n[0], total[0] = n[0] + kept[2][0], total[0] + kept[3][0]
            kept = (none,) * 4
        done = [np.concatenate([x, y]) for x, y in zip(kept, (term, fid, n, total), strict=True)]
        held, kept = rows[:, -1:], tuple(x[-1:] for x in done)
        term, fid, n, total = (x[:-1] for x in done)
        yield term, fid, n, total + size(n)
    yield (*kept[:3], kept[3] + size(kept[2]))


def layout(rows: DataFrame, chunk_bytes: int = P.CHUNK_BYTES, block_bytes: int = P.BLOCK_BYTES) -> DataFrame:
    """term, fid, tf, bytes, chunk, block of each posting: how lists are cut and stored.

    A chunk ends with the posting at which its raw size, four bytes for each of 2 + 3 tf numbers, reaches chunk_bytes.
    A chunk goes into the last block while that block's body, in the variable-byte code, is below block_bytes; else into a
    new one, whose first recording number is coded from 0. bytes are a posting's in that code. Chunks count from 0, blocks from 1.

    The cut depends on all postings before it, so it is a pass over a list in order; a task sorts ROWS occurrences, or those of one term,
    and holds an Arrow batch and a list's state.
    """
    schema = "term int, fid int, tf bigint, bytes bigint, chunk int, block int"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, block, raw, stored, last = None, 0, 0, 0, 0, 0  # of the list at hand
        for term, fid, tf, rest in _counted(batches):
            got = np.zeros((3, len(term)), dtype=np.int64)  # bytes, chunk, block
            edges = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if term[lo] != now:
                    now, chunk, block, raw, stored, last = term[lo], 0, 0, 0, 0, 0
                sums = np.cumsum(4 * (2 + 3 * tf[lo:hi]))
                at, before = lo, 0
                while at < hi:
                    if raw == 0 and (block == 0 or stored >= block_bytes):
                        block, stored, last = block + 1, 0, 0
                    # the posting that fills the chunk, or the end of the batch
                    end = min(hi, lo + int(np.searchsorted(sums, chunk_bytes - raw + before)) + 1)
                    got[0, at:end] = rest[at:end] + _sizes(np.diff(fid[at:end], prepend=last))
                    got[1, at:end], got[2, at:end] = chunk, block
                    stored, last = stored + int(got[0, at:end].sum()), int(fid[end - 1])
                    raw += int(sums[end - 1 - lo]) - before
                    before = int(sums[end - 1 - lo])
                    at = end
                    if raw >= chunk_bytes:
                        chunk, raw = chunk + 1, 0
            columns = (term, fid, tf, *got)
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    dealt = rows.select("term", "fid", "lid", "t", "e").repartition(n, "term")
    return dealt.sortWithinPartitions("term", "fid", "lid").mapInArrow(run, schema)


def block_headers(placed: DataFrame) -> DataFrame:
    """term, block, body_size, fid_max, block_count of a layout: the header of each block, and of its list."""
    rows = placed.groupBy("term", "block").agg(F.sum("bytes").cast("bigint").alias("body_size"), F.max("fid").alias("fid_max"))
    return rows.withColumn("block_count", F.max("block").over(Window.partitionBy("term")))

"""Re-ranking where the recordings are: a task holds a group of recordings and scores the candidates of unclear batches that are among them.

Neighbourhoods and their edges are many times larger than the tables they come from, so none is shuffled or written: a task gets, for each
query batch, its terms, its candidates in the group and the query's fingerprints around the batch, and yields only what is asked for.
It holds HELD postings, an Arrow batch of query batches, grid.CHUNK hits and PAIRS neighbourhoods at once. The same steps on DataFrames are in match and rerank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tonemark import params as P
from tonemark.operators import grid
from tonemark.operators.match import KEYS, query_terms

#: Postings that a task holds; pairs of neighbourhoods compared at once.
HELD, PAIRS = 2_000_000, 4096

COLUMNS = {
    "peaks": ("query_id", "batch", "fid", "bin", "score"),
    "centres": ("query_id", "batch", "k"),
    "common": ("query_id", "batch", "fid", "bin", "k", "lid", "edge", "score", "bin1", "bin2"),
    "again": ("query_id", "batch", "fid", "score", "bin"),
}
LONG = {"edge", "score"}


def _sorted_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = grid._starts(key)
    return first, np.diff(np.append(first, len(key)))


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes: the run of each item, and its place in it."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


class Lists:
    """Postings by recording and term, of a term the first of each bin."""

    def __init__(self, rows: dict[str, np.ndarray]):
        bins = rows["t"] // P.BIN
        order = np.lexsort((rows["lid"], bins, rows["term"], rows["fid"]))
        key, bins = (rows["fid"].astype(np.int64) << 32 | rows["term"])[order], bins[order]
        keep = np.ones(len(order), bool)
        keep[1:] = (np.diff(key) != 0) | (np.diff(bins) != 0)
        order, key, self.bin = order[keep], key[keep], bins[keep]
        self.lid, self.t, self.e = (rows[c][order] for c in ("lid", "t", "e"))
        self.start, self.size = _sorted_runs(key)
        self.key = key[self.start]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.start[at], np.where(self.key[at] == key, self.size[at], 0)


class Fingerprints:
    """Fingerprints of recordings, or of queries, by owner and number."""

    def __init__(self, rows: dict[str, np.ndarray], owner: str):
        key = rows[owner].astype(np.int64) << 32 | rows["lid"]
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.t, self.f, self.w, self.e = (rows[c][order] for c in "tfwe")
        step = np.diff(self.key)
        self.gapless = bool(((step == 1) | (np.diff(self.key >> 32) != 0)).all())

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each one is, and whether it is there."""
        if not len(self.key):
            return np.zeros(key.shape, np.int64), np.zeros(key.shape, bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def around(self, key: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the members around each centre, one column for each distance, and their offsets; -1 where there is none."""
        middle, there = self.place(key)
        p = np.arange(-P.AROUND_GRAPH, P.AROUND_GRAPH + 1)
        wanted = key[:, None] + p
        if not len(self.key):
            return np.zeros(wanted.shape, np.int64), np.full(wanted.shape, -1, np.int32)
        if self.gapless:
            at = np.clip(middle[:, None] + p, 0, len(self.key) - 1)
            good = self.key[at] == wanted
        else:
            at, good = self.place(wanted)
        good &= there[:, None] & (p >= -left[:, None]) & (p <= right[:, None])
        q = lambda x, unit: (2 * x + unit) // (2 * unit)
        t, f = q(self.t, int(P.QT)), q(self.f, int(P.QF))
        o = ((t[middle][:, None] - t[at]) & 255) << 8 | ((f[middle][:, None] - f[at]) & 255)
        return at, np.where(good, o, -1).astype(np.int32)


def _edges(member: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (pair, offsets of both ends) of the edges among members, each with the columns of its ends. Of equal keys the last edge counts."""
    pair, column = np.nonzero(member)
    first, size = _sorted_runs(pair)
    rank = np.arange(len(pair)) - np.repeat(first, size)
    i, step = _spread(np.repeat(size, size) - 1 - rank)
    j = i + 1 + step
    at = o[pair, column].astype(np.int64)
    key = pair[i].astype(np.int64) << 32 | at[i] << 16 | at[j]
    key, last = np.unique(key[::-1], return_index=True)
    last = len(i) - 1 - last
    return key, column[i[last]], column[j[last]]


def _hashes(key: np.ndarray) -> np.ndarray:
    """An edge's hash: four differences, eight bits each."""
    oi, oj = key >> 16 & 65535, key & 65535
    return ((oi >> 8) - (oj >> 8) & 255) << 24 | ((oi & 255) - (oj & 255) & 255) << 16 | oi


def _reach(k: np.ndarray, horizon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(k, P.AROUND_GRAPH), np.minimum(P.AROUND_GRAPH, horizon - k)


def _common(queries: Fingerprints, recordings: Fingerprints, row: np.ndarray, fid: np.ndarray, k: np.ndarray, lid: np.ndarray, horizon: np.ndarray) -> dict[str, np.ndarray]:
    """Edges that both neighbourhoods of a pair have: pair, edge, score, bin1, bin2."""
    left, right = _reach(k, horizon)
    qa, qo = queries.around(row.astype(np.int64) << 32 | k, left, right)
    ra, ro = recordings.around(fid.astype(np.int64) << 32 | lid, left, right)
    same = (qo[:, :, None] == ro[:, None, :]) & (qo >= 0)[:, :, None]
    qm, rm = same.any(axis=2), same.any(axis=1)
    enough = np.flatnonzero((qm.sum(axis=1) > 1) & (rm.sum(axis=1) > 1))
    qa, ra = qa[enough], ra[enough]
    qk, qi, qj = _edges(qm[enough], qo[enough])
    rk, ri, rj = _edges(rm[enough], ro[enough])
    key, x, y = np.intersect1d(qk, rk, assume_unique=True, return_indices=True)
    pair = key >> 32

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = P.MAX_SCORE * (P.BITS - np.abs(queries.e[a].astype(np.int64) - recordings.e[b])) // P.BITS
        return np.where(queries.w[a] == recordings.w[b], near, 0)

    ends = (qa[pair, qi[x]], ra[pair, ri[y]]), (qa[pair, qj[x]], ra[pair, rj[y]])
    score = 1000 + alike(*ends[0]) + alike(*ends[1])
    return {"pair": enough[pair], "edge": _hashes(key), "score": score, "bin1": recordings.t[ends[0][1]] // P.BIN, "bin2": recordings.t[ends[1][1]] // P.BIN}


def _summed(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Sums of the last array by the others, in their order."""
    *by, value = rows
    order = np.lexsort(by[::-1])
    by = [x[order] for x in by]
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x) != 0 for x in by], axis=0)
    first = np.flatnonzero(new)
    return (*(x[first] for x in by), np.add.reduceat(value[order], first) if len(first) else value[:0])


def _rows(lists: Lists, recordings: Fingerprints, queries: Fingerprints, mode: str, cand: dict[str, np.ndarray], horizon: np.ndarray, terms: tuple[np.ndarray, ...], start: np.ndarray, size: np.ndarray, hits: tuple[np.ndarray, np.ndarray], pairs: int) -> dict[str, np.ndarray]:
    """Output columns for candidates (row, fid). terms: k, eq of all rows; start, size: where a row's are; hits: start and length of the list of each candidate and term."""
    row, fid = cand["row"], cand["fid"]
    k, eq = terms
    of, step = _spread(size[row])
    term = start[row][of] + step
    asked, step = _spread(hits[1])
    at = hits[0][asked] + step
    c, k, eq, bins = of[asked], k[term[asked]], eq[term[asked]], lists.bin[at]
    order = np.lexsort((k, bins, c))
    c, k, eq, bins, at = c[order], k[order], eq[order], bins[order], at[order]
    new = np.ones(len(c), bool)
    new[1:] = (np.diff(c) != 0) | (np.diff(bins) != 0)
    number = np.cumsum(new) - 1
    score = grid._scores(number, lists.t[at].astype(np.int64), lists.e[at], eq)
    first = np.flatnonzero(new)
    total = np.add.reduceat(score, first) if len(first) else score
    bc, bb = c[first], bins[first]
    most = total.copy()
    for d in range(1, P.PEAK_RADIUS + 1):
        near = (bc[d:] == bc[:-d]) & (bb[d:] - bb[:-d] <= P.PEAK_RADIUS)
        most[:-d] = np.where(near, np.maximum(most[:-d], total[d:]), most[:-d])
        most[d:] = np.where(near, np.maximum(most[d:], total[:-d]), most[d:])
    peak = (total == most) & (total > P.MIN_SCORE * 3 // 2)
    if mode == "peaks":
        return {"row": row[bc[peak]], "fid": fid[bc[peak]], "bin": bb[peak], "score": total[peak]}
    keep = peak[number]
    c, k, bins, lid = c[keep], k[keep], bins[keep], lists.lid[at[keep]]
    if mode == "centres":
        both = np.unique(row[c].astype(np.int64) << 32 | k)
        return {"row": both >> 32, "k": both & 0xFFFFFFFF}
    found, halves = [], []
    for lo in range(0, len(c), pairs):
        s = slice(lo, lo + pairs)
        got = _common(queries, recordings, row[c[s]], fid[c[s]], k[s], lid[s], horizon[row[c[s]]])
        pair = lo + got.pop("pair")
        if mode == "common":
            found.append({"row": row[c[pair]], "fid": fid[c[pair]], "bin": bins[pair], "k": k[pair], "lid": lid[pair], **got})
        else:
            twice = lambda x: np.concatenate([x, x])
            halves.append(_summed((twice(c[pair]), twice(bins[pair]), np.concatenate([got["bin1"], got["bin2"]]), twice(got["score"] // 2))))
    if mode == "common":
        return {x: np.concatenate([f[x] for f in found]) for x in found[0]} if found else {"row": row[:0]}
    if not halves:
        return {"row": row[:0]}
    c, top, bins, score = _summed(tuple(np.concatenate(x) for x in zip(*halves, strict=True)))
    # the best bin of each peak: the largest score, of equal ones the first bin; of all peaks likewise
    order = np.lexsort((bins, -score, top, c))
    c, top, bins, score = c[order], top[order], bins[order], score[order]
    first = np.ones(len(c), bool)
    first[1:] = (np.diff(c) != 0) | (np.diff(top) != 0)
    c, top, bins, score = c[first], top[first], bins[first], score[first]
    order = np.lexsort((top, -score, c))
    c, bins, score = c[order], bins[order], score[order]
    first = grid._starts(c)
    return {"row": row[c[first]], "fid": fid[c[first]], "score": np.add.reduceat(score, first) if len(first) else score, "bin": bins[first]}


def _around(batches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, batch, horizon, y: the query's fingerprints from AROUND_GRAPH before a batch to as many after it, as far as received."""
    ends = batches.groupBy(*KEYS).agg(F.min("lid").alias("a"), F.max("lid").alias("b"), F.max("horizon").alias("horizon"))
    reach = F.sequence(F.greatest(F.lit(0), F.col("a") - P.AROUND_GRAPH), F.least(F.col("b") + P.AROUND_GRAPH, F.col("horizon")))
    near = ends.select(*KEYS, "horizon", F.explode(reach).alias("lid")).join(queries.select("query_id", "lid", "t", "f", "w", "e"), ["query_id", "lid"])
    listed = near.groupBy(*KEYS).agg(F.max("horizon").alias("horizon"), F.collect_list(F.struct("lid", "t", "f", "w", "e")).alias("x"))
    return listed.select("query_id", F.col("batch").cast("int").alias("batch"), F.col("horizon").cast("int").alias("horizon"), grid.packed("lid", "t", "f", "w", "e").alias("y"))


def _out(mode: str, query_id: StructField) -> StructType:
    kinds = {c: StructField(c, LongType() if c in LONG else IntegerType()) for c in COLUMNS[mode]}
    return StructType([query_id if c == "query_id" else kinds[c] for c in COLUMNS[mode]])


def _numbers(x: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of all rows, n in an item, and how many items each row has."""
    data = x.to_pylist()
    return np.frombuffer(b"".join(data), dtype=">i4").astype(np.int32).reshape(-1, n).T, np.array([len(d) // (4 * n) for d in data], dtype=np.int64)


def search(candidates: DataFrame, batches: DataFrame, queries: DataFrame, postings: DataFrame, recordings: DataFrame, mode: str) -> DataFrame:
    """What follows from the hits of query batches in their candidates (query_id, batch, fid).

    mode: peaks (bins that no bin within PEAK_RADIUS exceeds); centres (the query fingerprints with a hit in one); common (the edges that both
    neighbourhoods of such a hit have); again (each candidate's score by its edges).
    """
    spark = candidates.sparkSession
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-postings.count() // HELD))
    field = candidates.schema["query_id"]
    asked = candidates.select("query_id", F.col("batch").cast("int").alias("batch"), "fid", grid.group("fid", groups).alias("cell"))
    asked = asked.groupBy(*KEYS, "cell").agg(F.collect_list(F.struct("fid")).alias("x")).select(*KEYS, "cell", grid.packed("fid").alias("c"))
    listed = query_terms(batches).groupBy(*KEYS).agg(F.collect_list(F.struct("k", "eq", "term")).alias("x"))
    listed = listed.select("query_id", F.col("batch").cast("int").alias("batch"), grid.packed("k", "eq", "term").alias("x"))
    told = asked.join(listed.join(_around(batches, queries), KEYS), KEYS).withColumn("kind", F.lit(2))
    cells = told.unionByName(grid.dealt(postings, ("fid", "term", "lid", "t", "e"), groups).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    if mode in ("common", "again"):
        cells = cells.unionByName(grid.dealt(recordings, ("fid", "lid", "t", "f", "w", "e"), groups).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    cells = cells.select("cell", "kind", "query_id", "batch", "horizon", "c", "x", "y").repartitionById(groups, "cell").sortWithinPartitions("kind")
    schema = _out(mode, field)
    out = to_arrow_schema(schema)
    chunk, pairs = grid.CHUNK, PAIRS

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        lists = fingerprints = None
        for b in rows:
            kind = b["kind"].to_numpy()
            for x, of in zip(b["x"].slice(0, int((kind < 2).sum())).to_pylist(), kind, strict=False):
                held[of].append(grid.unpacked(x))
            b = b.slice(int((kind < 2).sum()))
            if not b.num_rows:
                continue
            if lists is None:
                lists = Lists(grid.joined(held[0], ("fid", "term", "lid", "t", "e")))
                held[0].clear()
                fingerprints = Fingerprints(grid.joined(held[1], ("fid", "lid", "t", "f", "w", "e")), "fid")
                held[1].clear()
            (fid,), per = _numbers(b["c"], 1)
            (k, eq, term), size = _numbers(b["x"], 3)
            y, members = _numbers(b["y"], 5)
            queries = Fingerprints({"row": np.repeat(np.arange(len(members)), members), **dict(zip(("lid", "t", "f", "w", "e"), y, strict=True))}, "row")
            horizon = b["horizon"].to_numpy()
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(per)), per)
            of, step = _spread(size[row])
            at, n = lists.find(fid[of].astype(np.int64) << 32 | term[start[row][of] + step])
            edge = np.concatenate([[0], np.cumsum(size[row])])  # of the terms of each candidate
            total = np.concatenate([[0], np.cumsum(n)])[edge]
            lo = 0
            while lo < len(row):
                # the candidates of some CHUNK hits, one at least
                hi = min(max(lo + 1, int(np.searchsorted(total, total[lo] + chunk, side="right")) - 1), len(row))
                s = slice(edge[lo], edge[hi])
                got = _rows(lists, fingerprints, queries, mode, {"row": row[lo:hi], "fid": fid[lo:hi]}, horizon, (k, eq), start, size, (at[s], n[s]), pairs)
                if len(got["row"]):
                    place = pa.array(got["row"])
                    got = {**got, "query_id": b["query_id"].take(place), "batch": b["batch"].take(place)}
                    done = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name]) for f in out]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(done, out, strict=True)], schema=out)
                lo = hi

    found = cells.mapInArrow(run, schema)
    return found.distinct() if mode == "centres" else found


def query_edges(centres: DataFrame, batches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, batch, k, n_edges, edge_sum: how many edges are around each query fingerprint, and the sum of their keys modulo 1,000,003."""
    asked = centres.groupBy(*KEYS).agg(F.collect_list(F.struct("k")).alias("x")).select(*KEYS, grid.packed("k").alias("c"))
    rows = asked.join(_around(batches, queries), KEYS)
    schema = StructType([rows.schema["query_id"], rows.schema["batch"]]).add("k", IntegerType()).add("n_edges", LongType()).add("edge_sum", LongType())
    out = to_arrow_schema(schema)

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            (k,), per = _numbers(b["c"], 1)
            y, members = _numbers(b["y"], 5)
            own = Fingerprints({"row": np.repeat(np.arange(len(members)), members), **dict(zip(("lid", "t", "f", "w", "e"), y, strict=True))}, "row")
            row, horizon = np.repeat(np.arange(len(per)), per), b["horizon"].to_numpy()
            for lo in range(0, len(k), PAIRS):
                r, c = row[lo : lo + PAIRS], k[lo : lo + PAIRS]
                _, o = own.around(r.astype(np.int64) << 32 | c, *_reach(c, horizon[r]))
                key, _, _ = _edges(o >= 0, o)
                at, value = (key >> 32), _hashes(key) % 1_000_003
                n, total = np.bincount(at, minlength=len(c)), np.bincount(at, weights=value, minlength=len(c)).astype(np.int64)
                some = np.flatnonzero(n)
                place = pa.array(r[some])
                done = [b["query_id"].take(place), b["batch"].take(place), pa.array(c[some]), pa.array(n[some]), pa.array(total[some])]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(done, out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)

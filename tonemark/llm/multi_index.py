"""Approximate nearest neighbours by an inverted multi-index, with exact reranking.

Unit vectors are cut into two halves, each quantised by its own centroids; a cell is a pair of centroids. A
query visits cells in the order of summed squared distances, drawn from a heap, until the cells hold a
wanted share of all vectors. That share is set on a bounded sample: the least for which the true neighbours
of sampled queries are found with the wanted recall. All vectors of the visited cells are then scored exactly.

The search runs in tiles: vectors by first centroid, and queries that stand near each other, both in parts of a
bounded size. A part of the vectors is sent only to the parts of the queries that ask for its centroid.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pa_schema

#: Bounds: rows that centroids and the share are fitted on; centroids of a half up to a million rows (beyond, they grow with the
#: root of the rows, to a twentieth of the sample); queries of the fit; rows and queries of a tile; cells scored at once.
SAMPLE, CENTROIDS, TRIALS, TILE, QUERIES, CELLS = 20_000, 64, 300, 16_384, 8_192, 4_000_000
RECALL = 0.97


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    share: float
    dim: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.dim // 2
        return _squared(unit[:, :h], self.first), _squared(unit[:, h:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _squared(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def visited(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in the order of a[i] + b[j], from a heap, until they hold the wanted number of rows. Empty cells are passed over."""
    i_order, j_order = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    da, db, width = a.tolist(), b.tolist(), len(b)
    heap, seen, out, got = [(da[i_order[0]] + db[j_order[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = i_order[i] * width + j_order[j]
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(da) and v < width and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (da[i_order[u]] + db[j_order[v]], u, v))
    return out


def fit(sample: np.ndarray, k: int, recall: float = RECALL, rows: int = 0, seed: int = 3) -> Index:
    """Centroids from the sample, and the share of rows to visit at which sampled queries find their k neighbours with the wanted recall. rows: how many will be indexed."""
    unit = unit_rows(sample)
    h = unit.shape[1] // 2
    c = max(1, min(CENTROIDS, int(len(unit) ** 0.5 / 2)), min(len(unit) // 20, int(rows**0.5 / 16)))
    index = Index(centroids(unit[:, :h], c, seed), centroids(unit[:, h:], c, seed + 1), 1.0, unit.shape[1])
    if len(unit) < 50:
        return index  # visit all
    q = np.linspace(0, len(unit) - 1, min(TRIALS, len(unit))).astype(int)
    scores = unit[q] @ unit.T
    scores[np.arange(len(q)), q] = -2
    near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    cells = index.cells(unit)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    a, b = index.distances(unit[q])
    need = []
    for t in range(len(q)):
        order = np.argsort((a[t][:, None] + b[t][None, :]).ravel(), kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(counts[order])
        need += (held[cells[near[t]]] / len(unit)).tolist()
    index.share = float(np.quantile(need, recall))
    return index


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v of the rows that take part; of rows with one id the least vector. Floats stay floats, other numbers become doubles."""
    kind = df.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def nearest(v: np.ndarray, ids: np.ndarray, cell: np.ndarray, x: np.ndarray, queries: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) of each query's k nearest vectors in its wanted cells, its own left out."""
    size, length = np.linalg.norm(v, axis=1), np.linalg.norm(x, axis=1)
    out = []
    step = max(1, CELLS // max(1, len(v)))
    for a in range(0, len(x), step):
        rough = x[a : a + step] @ v.T / size[None, :]
        rough[~wanted[a : a + step][:, cell] | (ids[None, :] == queries[a : a + step, None])] = -np.inf
        bar = np.full(len(rough), -np.inf) if len(v) <= k else np.partition(rough, len(v) - k, axis=1)[:, len(v) - k]
        # all that may be among the k, then exactly
        i, j = np.nonzero((rough >= (bar - 1e-9 * length[a : a + step])[:, None]) & np.isfinite(rough))
        exact = (v[j] * x[a + i]).sum(axis=1) / (size[j] * length[a + i])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((queries[a + i[top]], ids[j[top]], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(df: DataFrame, id_col: str, vec_col: str, query_every: int, k: int, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine for each row whose id is divisible by query_every.

    Candidates are all other rows; fewer than k if there are fewer. Nearest first, ties to the smaller id. Rows whose
    id or vector is null, and vectors that are zero, hold null or non-finite components or differ from the most frequent
    length, take no part; of rows with one id the least vector does. An empty table gives no rows; other columns of
    df are not read. sample bounds the rows that centroids and share are fitted on; every row is indexed and reranked.
    """
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = materialize(valid_vectors(df, id_col, vec_col), "index-vectors")
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None or dims["n"] < 2:
        return spark.createDataFrame([], schema)
    dim, n = dims["d"], dims["n"]
    kind = rows.schema["v"].dataType.simpleString()
    rows = rows.where(F.size("v") == dim)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1_000_003)) <= min(1.0, sample / n) * 1_000_003)
    index = fit(np.array([r["v"] for r in sorted(chosen.collect(), key=lambda r: r["id"])], dtype=np.float64).reshape(-1, dim), k, recall, n)
    width = len(index.second)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = index.cells(unit_rows(matrix(b["v"], dim)))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(cell // width, pa.int32()), pa.array(cell % width, pa.int32()), b["v"]], names=["id", "block", "cell", "v"])

    cells = materialize(rows.mapInArrow(assign, f"id bigint, block int, cell int, v {kind}"), "index-cells")
    # a row for each cell, of which there are at most as many as pairs of centroids
    counts, asking = np.zeros(len(index.first) * width, dtype=np.int64), np.zeros(len(index.first), dtype=np.int64)
    own = F.col("id") % query_every == 0
    for r in cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("q")).collect():
        counts[r["block"] * width + r["cell"]] = r["n"]
        asking[r["block"]] += r["q"]
    parts = [max(1, int(-(-c // TILE))) for c in counts.reshape(-1, width).sum(axis=1)]
    # queries of neighbouring blocks share a part, those of a large block have several
    firsts, splits, held, part = [], [], 0, 0
    for a in asking.tolist():
        if held and held + a > QUERIES:
            part, held = part + 1, 0
        firsts.append(part)
        splits.append(max(1, -(-a // QUERIES)))
        held += a
        if splits[-1] > 1:
            part, held = part + splits[-1], 0
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    q = of(firsts, F.col("block")) + F.pmod(F.xxhash64("id"), of(splits, F.col("block"))).cast("int")
    queries = cells.where(own).select("id", "v", q.alias("q"))

    def plan():
        def each(x):
            v = np.array(x["v"], dtype=np.float64)
            a, b = index.distances(unit_rows(v))
            out: dict[str, list] = {c: [] for c in ("block", "part", "q", "id", "cells", "v")}
            for t, key in enumerate(x["id"]):
                by: dict[int, list[int]] = {}
                for c in visited(a[t], b[t], counts, index.share * n + k):
                    by.setdefault(c // width, []).append(c % width)
                for block, inner in by.items():
                    for p in range(parts[block]):
                        for c, value in zip(out, (block, p, x["q"][t], key, inner, x["v"][t]), strict=True):
                            out[c].append(value)
            return out

        return each

    asked = materialize(map_arrow(queries, plan, f"block int, part int, q int, id bigint, cells array<int>, v {kind}"), "index-asked")
    keys = ["block", "part", "q"]
    placed = cells.withColumn("part", F.pmod(F.xxhash64("id"), of(parts, F.col("block"))).cast("int"))
    wants = asked.select(*[F.col(c).alias(f"a_{c}") for c in keys]).distinct()
    tiles = placed.join(wants, (F.col("block") == F.col("a_block")) & (F.col("part") == F.col("a_part"))).select("block", "part", F.col("a_q").alias("q"), "id", "cell", "v")
    out = pa_schema(spark, "query_id bigint, vec_id bigint, score double")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        wanted = np.zeros((right.num_rows, width), dtype=bool)
        inner = right["cells"].combine_chunks()
        wanted[np.repeat(np.arange(right.num_rows), inner.value_lengths().to_numpy()), inner.flatten().to_numpy()] = True
        got = nearest(matrix(left["v"], dim), left["id"].to_numpy(), left["cell"].to_numpy(), matrix(right["v"], dim), right["id"].to_numpy(), wanted, k)
        return pa.Table.from_arrays([pa.array(c) for c in got], schema=out)

    found = tiles.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

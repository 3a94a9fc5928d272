"""N-gram Jaccard join by chosen paths, for near duplicates.

A text is the set of its five-word shingles. Texts with equal sets are copies and count once as a node. A
node is split recursively on sampled tokens: a token is one of the set's minima under fixed hash
functions, and nodes that share a sampled token go down the same path together. Small buckets are compared
by brute force, and the whole is repeated, so that two sets at the threshold meet with the wanted
probability. Buckets only say which nodes belong together; within such a component every pair is
then compared exactly, block by block, so that all links between its texts are counted without listing them.

A link at the threshold is lost only if its sets never meet in a bucket (RECALL) or differ in far more minima than
expected (LIKELY, about one in 10,000), and no third set joins them.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MANY, components, map_arrow, map_groups, materialize, words_bytes

WORDS, THRESHOLD = 5, 0.8
#: Minima in a signature; tokens sampled at each node of a path; wanted recall at the threshold.
MINIMA, SAMPLED, RECALL = 64, 2, 0.999
#: A bucket up to SMALL is compared at once; one up to LARGE is split within a task; a larger one is split by Spark, DEPTH times.
SMALL, LARGE, DEPTH = 32, 2_048, 3
#: Nodes, and shingles, of a block in the exact comparison; cells of a matrix that it holds at once.
BLOCK, BLOCK_SHINGLES, CELLS = 1_024, 4_000_000, 8_000_000
#: Agreement of two signatures from which their nodes may belong together: the threshold less four standard deviations.
LIKELY = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / MINIMA) ** 0.5

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, sampled: int = SAMPLED, depth: int = DEPTH) -> int:
    """Repetitions after which two sets at the threshold have met with the wanted probability."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - threshold * meet) ** sampled
    return int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of words; a shorter text is one window; one without words has none."""
    w = words_bytes(text or "")
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """MINIMA minima under fixed hash functions, the top 16 bits of a mix of each."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 8192):
        part = s[a : a + 8192, None] * _MUL + _ADD
        part ^= part >> np.uint64(32)
        part *= _STEP
        low = np.minimum(low, part.min(axis=0))
    low = (low ^ (low >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (low >> np.uint64(48)).astype("<u2")


def tokens(path: int, sampled: int = SAMPLED) -> list[int]:
    """Places of the signature that a node of a path is split on: a hash of the path."""
    out: list[int] = []
    k = 0
    while len(out) < sampled:
        c = xxhash.xxh64_intdigest(b"%d" % path, seed=k) % MINIMA
        k += 1
        if c not in out:
            out.append(c)
    return out


def child(path: int, place: int, value: int) -> int:
    return xxhash.xxh64_intdigest(b"%d,%d,%d" % (path, place, value)) - 2**63


def close(sig: np.ndarray) -> np.ndarray:
    """For each row of signatures the first row of its component, where rows that agree enough are linked."""
    m, need = len(sig), int(np.ceil(LIKELY * MINIMA))
    near = np.zeros((m, m), dtype=bool)
    for a in range(0, m, 64):
        near[a : a + 64] = (sig[a : a + 64, None, :] == sig[None, :, :]).sum(axis=2) >= need
    return spread(near)


def spread(near: np.ndarray) -> np.ndarray:
    """For each row of a matrix of links the first row of its component."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = label.copy()
        for a in range(0, n, 256):
            part = np.where(near[a : a + 256], label[None, :], n)
            new[a : a + 256] = np.minimum(label[a : a + 256], part.min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def together(sig: np.ndarray, path: int) -> list[tuple[int, int]]:
    """(row, first row of its component) as found in the bucket of a path: by brute force if it is small, else by splitting on. A row comes once at most."""
    parent = np.arange(len(sig))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    todo = [(np.arange(len(sig)), path, 0)]
    while todo:
        rows, at, depth = todo.pop()
        if len(rows) <= SMALL or depth > 8:
            for i, j in enumerate(close(sig[rows])):
                if i != j:
                    a, b = root(int(rows[i])), root(int(rows[j]))
                    parent[max(a, b)] = min(a, b)
            continue
        for place in tokens(at):
            order = rows[np.argsort(sig[rows, place], kind="stable")]
            v = sig[order, place]
            cuts = np.flatnonzero(np.diff(v)) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:  # a part that hardly shrank is dense: splitting on wouldn't help
                    todo.append((np.sort(part), child(at, place, int(sig[part[0], place])), 99 if len(part) >= 0.9 * len(rows) else depth + 1))
    return [(i, root(i)) for i in range(len(sig)) if parent[i] != i]


def _nodes(df: DataFrame, words: int) -> DataFrame:
    def make():
        def each(x):
            keys, sigs, sizes = [], [], []
            for t in x["text"]:
                s = shingles(t, words)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
                sizes.append(len(s))
            return {"id": x["id"], "h": x["h"], "key": keys, "sig": sigs, "size": sizes}

        return each

    kind = df.schema["id"].dataType.simpleString()
    return materialize(map_arrow(df, make, f"id {kind}, h bigint, key binary, sig binary, size bigint"), "join-documents")


def _paths(nodes: DataFrame, first: int) -> DataFrame:
    """A row for each node and path: at the start (first: runs) or one token deeper (first 0, from column path)."""

    def make():
        def each(x):
            out: dict[str, list] = {"path": [], "key": [], "sig": []}
            for i, (key, sig) in enumerate(zip(x["key"], x["sig"], strict=True)):
                s = np.frombuffer(sig, dtype="<u2")
                for at in range(first) if first else (x["path"][i],):
                    for place in tokens(at):
                        out["path"].append(child(at, place, int(s[place])))
                        out["key"].append(key)
                        out["sig"].append(sig)
            return out

        return each

    return map_arrow(nodes, make, "path bigint, key binary, sig binary")


def candidates(nodes: DataFrame, runs: int) -> DataFrame:
    """Edges (a, b) that tie the nodes (key, sig) found close in some bucket."""
    found = None
    level = _paths(nodes.select("key", "sig"), runs)

    def make():
        def each(x):
            sig = np.frombuffer(b"".join(x["sig"]), dtype="<u2").reshape(-1, MINIMA)
            pairs = together(sig, x["path"][0])
            return {"a": [x["key"][j] for _, j in pairs], "b": [x["key"][i] for i, _ in pairs]}

        return each

    for depth in range(DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        rows = level.join(sizes, "path")
        small = map_groups(rows.where(F.col("c") <= LARGE).select("path", "key", "sig"), ["path"], make, "a binary, b binary").distinct()
        found = small if found is None else found.union(small)
        if depth == 0:
            found = materialize(found, "join-edges")
        if not sizes.where(F.col("c") > LARGE).limit(1).count():
            return found
        large = materialize(rows.where(F.col("c") > LARGE), "join-large")
        if depth < DEPTH:
            level = materialize(_paths(large.select("path", "key", "sig"), 0), "join-paths")
    # what never got small: all pairs of blocks
    blocks = large.withColumn("n", F.ceil(F.col("c") / LARGE)).withColumn("i", F.pmod(F.xxhash64("key"), F.col("n")))
    pairs = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("path", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "key", "sig")

    def make_blocks():
        def each(x):
            label = close(np.frombuffer(b"".join(x["sig"]), dtype="<u2").reshape(-1, MINIMA))
            at = [(i, j) for i, j in enumerate(label) if i != j]
            return {"a": [x["key"][j] for _, j in at], "b": [x["key"][i] for i, _ in at]}

        return each

    return found.union(map_groups(pairs, ["path", "i", "j"], make_blocks, "a binary, b binary").distinct())


def linked(sets: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold; with left only pairs across it."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), size)
    shared = counts[at] > 1  # only these can be in an intersection
    names, at = np.unique(at[shared], return_inverse=True)
    of = of[shared]
    near = np.zeros((n, n), dtype=bool)
    if n * len(names) < 30 * max(1, len(at)):  # most shared ones are in many sets: as a product of matrices, some columns at once
        both = np.zeros((n, n), dtype=np.float32)  # exact up to 2**24 shingles
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
        width = max(1, CELLS // n)
        for a in range(0, len(names), width):
            lo, hi = np.searchsorted(at, [a, a + width])
            x = np.zeros((n, min(width, len(names) - a)), dtype=np.float32)
            x[of[lo:hi], at[lo:hi] - a] = 1
            both += x @ x.T
        for a in range(0, n, 256):
            near[a : a + 256] = both[a : a + 256] >= threshold * (size[a : a + 256, None] + size[None, :] - both[a : a + 256]) - 1e-6
    else:
        order = np.argsort(at, kind="stable")
        holders, first = of[order], np.searchsorted(at[order], np.arange(len(names) + 1))
        mine = np.searchsorted(of, np.arange(n + 1))
        for i in range(n):
            own = at[mine[i] : mine[i + 1]]
            both = np.bincount(np.concatenate([holders[first[u] : first[u + 1]] for u in own]) if len(own) else own, minlength=n)
            near[i] = both >= threshold * (size + size[i] - both) - 1e-9
    if left is not None:
        near &= left[:, None] != left[None, :]
    np.fill_diagonal(near, False)
    return near


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of df: id, class_id, n_links, copy_id.

    n_links: other rows whose shingles have a Jaccard similarity of at least the threshold, copies included. class_id:
    the least id of all rows that links join, directly or through others; copy_id: the least id with the
    same shingles. Words are parted by white space, A-Z lower-cased. A text without words (null, empty, blank) has no links and is
    its own class. Rows with a null id take part; a class of such rows only has a null id. Repeated rows are copies of
    each other. An empty table gives no rows; other columns of df are not read.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    docs = _nodes(base, words)
    # a node is told by its key; the row that gives its text by id and the text's hash, n_rows of which are equal
    rows = docs.where(F.col("key").isNotNull()).groupBy("key", "id", "h").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", F.col("n").alias("n_rows"))).alias("row")
    nodes = rows.groupBy("key").agg(first, F.sum("n").alias("n"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    nodes = materialize(nodes.select("key", F.col("row.id").alias("rep"), F.col("row.h").alias("h"), F.col("row.n_rows").alias("n_rows"), "n", "sig", "size"), "join-nodes")
    parts = materialize(components(candidates(nodes, runs_for(recall, threshold)), "join-components"), "join-parts")
    members = nodes.select("key", "rep", "h", "n_rows", "n", "size").join(parts.withColumnRenamed("node", "key"), "key")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    members = materialize(members.join(sizes, "root").withColumnRenamed("h", "rep_h"), "join-members")
    of_row = (F.col("rep_h") == F.col("h")) & F.col("rep").eqNullSafe(F.col("id"))
    # by a shuffle at every size: the members grow with the data
    texts = members.where("n_rows = 1").hint("merge").join(base, of_row).select("root", "key", "n", "blocks", "text")
    if members.where("n_rows > 1").limit(1).count():  # rows of one id and one text: one of them is enough
        texts = texts.union(members.where("n_rows > 1").hint("merge").join(base, of_row).select("root", "key", "n", "blocks", "text").dropDuplicates(["key"]))
    i = F.pmod(F.xxhash64("key"), F.col("blocks"))
    pairs = texts.withColumn("i0", i).withColumn("j0", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", F.least("i0", "j0").alias("i"), F.greatest("i0", "j0").alias("j"), (F.col("i0") > F.col("j0")).alias("second"), "key", "n", "blocks", "text")

    def make():
        def each(x):
            keys, sets = x["key"], [shingles(t, words) for t in x["text"]]
            if len(sets) < 2:
                return None
            across = np.array(x["second"]) if x["i"][0] != x["j"][0] else None
            near = linked(sets, threshold, across)
            n = np.array(x["n"], dtype=np.int64)
            label = spread(near)
            least: dict[int, bytes] = {}
            for k, r in zip(keys, label.tolist(), strict=True):
                least[r] = min(k, least.get(r, k))
            return {"key": keys, "links": [int(n[row].sum()) for row in near], "first": [least[int(r)] for r in label], "blocks": x["blocks"]}

        return each

    checked = materialize(map_groups(pairs, ["root", "i", "j"], make, "key binary, links bigint, first binary, blocks bigint"), "join-links")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    one = checked.where(F.col("blocks") == 1).select(F.col("key").alias("node"), F.col("first").alias("root"))
    several = components(checked.where(F.col("blocks") > 1).select(F.col("key").alias("b"), F.col("first").alias("a")), "join-classes")
    classes = one.union(several)
    named = nodes.select("key", "rep", "n").join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = materialize(named.where((F.col("n") > 1) | (F.col("links") > 0)), "join-named")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    told = materialize(named.join(least, "root").select("key", "class_id", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "join-told")
    # keys of very many rows would meet all of them in one task: there are at most MANY / 2 of these, which are broadcast
    bar = max(1_000, 2 * (named.agg(F.sum("n")).first()[0] or 0) // MANY)
    with_key, without = docs.where(F.col("key").isNotNull()).select("id", "key"), docs.where(F.col("key").isNull()).select("id", "key")
    hot = told.where(F.col("n") > bar)
    rare = with_key.join(F.broadcast(hot.select("key")), "key", "left_anti").join(told.where(F.col("n") <= bar), "key", "left")
    none = without.select("key", "id", *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in told.columns if c != "key"])
    out = rare.unionByName(with_key.join(F.broadcast(hot), "key")).unionByName(none)
    alone = F.col("n_links").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("copy_id"))

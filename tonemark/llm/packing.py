"""Packing of tokenised documents into sequences, by best fit and a swap-based local search.

Pieces are dealt evenly into groups of a bounded size. In a group, pieces go into bins by best fit in
decreasing order. Then the emptiest bin gives away its pieces: it moves one into a bin with room, or
exchanges one, or two, of its pieces for a smaller one of a fuller bin. Every step increases the sum of
squared fills, so the search ends; a bin that has given all away is gone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pa_schema

#: Pieces in a group that is packed at once.
GROUP = 8_000
#: Characters that both tokenizer libraries class alike for certain; other texts go to the slower one.
_ODD = re.compile("[^\t\n\x20-\x7e\xa0-ɏ]")

_encoders: dict[tuple[str, str, bool], "Encoder"] = {}


class Encoder:
    """Ids of the byte-level vocabulary in json_path. ranks_path: the same vocabulary as ranks, which is several times faster. special: strings of added tokens get the tokens' ids, as the library does by itself; otherwise those of special tokens are ordinary text."""

    def __init__(self, json_path: str, ranks_path: str | None, special: bool = False):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.exact.encode_special_tokens = not special
        #: texts with one of these strings are for the exact tokenizer, too
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values() if special or not t.special]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not _ODD.search(text) and not any(a in text for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def encoder(json_path: str, ranks_path: str | None, special: bool = False) -> Encoder:
    key = (json_path, ranks_path or "", special)
    if key not in _encoders:
        _encoders[key] = Encoder(json_path, ranks_path, special)
    return _encoders[key]


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document with n ids; only the first may be shorter than size."""
    first = n % size
    return [first] * (first > 0) + [size] * (n // size)


def pieces(df: DataFrame, id_col: str, text_col: str, json_path: str, ranks_path: str | None, end_id: int, size: int, special: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 for each piece. A null text is empty: only the end id."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        e = encoder(json_path, ranks_path, special)

        def each(x):
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
            for key, text in zip(x["id"], x["text"], strict=True):
                ids = np.array([*e.ids(text or ""), end_id], dtype="<u4")
                start = 0
                for k, n in enumerate(cut(len(ids), size)):
                    for c, v in zip(out, (key, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        out[c].append(v)
                    start += n
            return out

        return each

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indexes: each piece, largest first, into the fullest bin that it fits."""
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    gaps = np.zeros(room + 1, dtype=bool)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        at = int(gaps[s:].argmax()) + s
        if gaps[at]:
            b = by_gap[at].pop()
            gaps[at] = bool(by_gap[at])
        else:
            b, at = len(bins), room
            bins.append([])
        bins[b].append(i)
        by_gap[at - s].append(b)
        gaps[at - s] = True
    return bins


def search(sizes: list[int], bins: list[list[int]], room: int) -> list[list[int]]:
    """Empties bins by moves, one-for-one and two-for-one exchanges, each of which increases the sum of squared fills.

    Ends when no bin has such a step, or when there are as few bins as the sizes allow. For each size a table has the
    fullest bin, up to any fill, that holds a piece of this size; so a step looks at every pair of distinct sizes of a
    bin (of which room allows few) against every piece of every other bin.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(sizes) // room)
    live = sum(map(bool, bins))
    holders: dict[int, dict[int, int]] = {}  # size: bins that hold it, and how often
    levels: dict[int, set[int]] = {}  # fill: its bins
    best = np.full((room + 1, room + 1), -1, dtype=np.int32)  # size, x: greatest fill up to x of a bin that holds the size

    def row(s: int) -> None:
        best[s] = -1
        at = np.array([fill[b] for b in holders.get(s, ())], dtype=np.int64)
        best[s, at] = at
        np.maximum.accumulate(best[s], out=best[s])

    for b, items in enumerate(bins):
        levels.setdefault(fill[b], set()).add(b)
        for i in items:
            held = holders.setdefault(sizes[i], {})
            held[b] = held.get(b, 0) + 1
    for s in holders:
        row(s)

    def move(give: list[int], a: int, take: list[int], b: int) -> None:
        """Pieces give of bin a go to bin b, take come back."""
        nonlocal live
        changed = {sizes[i] for i in bins[a]} | {sizes[i] for i in bins[b]}
        for source, target, items in ((a, b, give), (b, a, take)):
            for i in items:
                s = sizes[i]
                bins[source].remove(i)
                bins[target].append(i)
                holders[s][source] -= 1
                if not holders[s][source]:
                    del holders[s][source]
                holders[s][target] = holders[s].get(target, 0) + 1
        for x in (a, b):
            levels[fill[x]].discard(x)
            fill[x] = sum(sizes[i] for i in bins[x])
            levels.setdefault(fill[x], set()).add(x)
        live -= not bins[a]
        for s in changed:
            row(s)

    def step(v: int) -> bool:
        mine: dict[int, list[int]] = {}
        for i in bins[v]:
            mine.setdefault(sizes[i], []).append(i)
        own = sorted(mine, reverse=True)
        for s in own:  # move to the fullest bin with room
            for x in range(room - s, max(fill[v] - s, 0), -1):
                if others := levels.get(x, set()) - {v}:
                    move([mine[s][0]], v, [], min(others))
                    return True
        sums = {s: [mine[s][0]] for s in own}  # one for one
        pairs = {s + t: [mine[s][0], mine[t][-1]] for k, s in enumerate(own) for t in own[k:] if s != t or len(mine[s]) > 1}
        for given in (sums, pairs):
            if not given:
                continue
            total = np.array(list(given), dtype=np.int64)
            s = np.arange(1, room + 1)
            d = total[:, None] - s[None, :]  # what the other bin gains
            top = np.where(d > 0, best[s[None, :], np.clip(room - d, 0, room)], -1)
            gain = np.where((top >= 0) & (d <= room), d * (top - fill[v] + d), 0)
            while (at := int(gain.argmax())) >= 0 and gain.flat[at] > 0:
                k, j = divmod(at, room)
                size, level = int(s[j]), int(top[k, j])
                found = [b for b in levels[level] if b != v and b in holders[size]]
                if found:
                    b = min(found)
                    move(given[int(total[k])], v, [next(i for i in bins[b] if sizes[i] == size)], b)
                    return True
                # the only holder is v itself: the next fuller ones below
                below = best[size, level - 1] if level else -1
                top[k, j] = below
                gain[k, j] = d[k, j] * (below - fill[v] + d[k, j]) if below >= 0 else 0
        return False

    again = True
    while again and live > least:
        again = False
        for v in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < room), key=lambda b: fill[b]):
            while live > least and bins[v] and fill[v] < room and step(v):
                again = True
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], room: int) -> list[list[int]]:
    return search(sizes, best_fit(sizes, room), room)


def pack(df: DataFrame, id_col: str, text_col: str, json_path: str, ranks_path: str | None = None, end_id: int = 2, size: int = 1024, group: int = GROUP, special: bool = False) -> DataFrame:
    """One row for each piece of each row of df: id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and end_id; only one longer than size is cut, and then only its first piece may be
    shorter. Every piece lies whole in one sequence of at most size tokens, without gaps. A null text is empty (the end
    id alone). Repeated rows are packed as often as they occur, ties go by order of arrival, an empty table gives no rows;
    other columns of df are not read. group: pieces that are packed at once, which bounds the memory of a task.
    special: strings of special tokens in a text get the tokens' ids instead of those of ordinary text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = materialize(pieces(df, id_col, text_col, json_path, ranks_path, end_id, size, special), "pieces")
    n = max(1, -(-rows.count() // group))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [], schema=pa.schema(list(out)[:5]))
        if not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        sizes = table["length"].to_pylist()
        base = TaskContext.get().partitionId() << 32
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for k, b in enumerate(pack_sizes(sizes, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + k, at
                at += sizes[i]
        arrays = [c.combine_chunks() for c in table.columns]
        yield from pa.Table.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], schema=out).to_batches(max_chunksize=10_000)

    return rows.repartition(n).mapInArrow(run, schema).withColumnRenamed("id", id_col)

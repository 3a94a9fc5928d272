"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths slide over the raw bytes of a window, each filter keeps its largest response
in the window, and a softmax over these gives the window's languages; a text's are the mean over all its
windows. As input bytes are one-hot, a filter of width w is w tables of 256 weights, and two neighbouring
tables are added up beforehand into one of 65,536 rows: a window costs look-ups, not products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, map_arrow

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of what the network is trained on: texts of each language, and windows of each text.
TEXTS, WINDOWS = 600, 3
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    weight: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    bias: np.ndarray

    def compiled(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width the look-up tables and where they start: pairs of bytes, a single byte for an odd rest."""
        out = []
        for t in self.tables:
            parts = [(k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, len(t) - 1, 2)]
            if len(t) % 2:
                parts.append((len(t) - 1, np.tile(t[-1], (1, 1))))
            out.append(parts)
        return out


def responses(flat: np.ndarray, compiled: list, chunk: int = 128) -> np.ndarray:
    """Largest response of each filter in each window of flat (uint8, a multiple of WINDOW, zeros at the end of each text)."""
    n = len(flat) // WINDOW
    wide = np.concatenate([flat, np.zeros(8, dtype=np.uint8)])
    pairs = wide[:-1].astype(np.intp) << 8 | wide[1:]
    out = np.empty((n, sum(p[0][1].shape[1] for p in compiled)), dtype=np.float32)
    buf = tmp = None
    for a in range(0, n, chunk):
        b = min(n, a + chunk)
        lo, hi, at = a * WINDOW, b * WINDOW, 0
        for parts in compiled:
            f = parts[0][1].shape[1]
            if buf is None or len(buf) != hi - lo or buf.shape[1] != f:
                buf, tmp = np.empty((hi - lo, f), dtype=np.float32), np.empty((hi - lo, f), dtype=np.float32)
            for j, (k, table) in enumerate(parts):
                index = pairs[lo + k : hi + k] if len(table) == 65536 else wide[lo + k : hi + k]
                np.take(table, index, axis=0, out=tmp if j else buf, mode="clip")
                if j:
                    buf += tmp
            out[a:b, at : at + f] = buf.reshape(b - a, WINDOW, f).max(axis=1)
            at += f
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def flatten(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each with at least three zeros and filled up to whole windows; the windows of each."""
    windows = np.array([-(-(len(t) + max(WIDTHS) - 1) // WINDOW) for t in texts], dtype=np.int64)
    flat = np.zeros(int(windows.sum()) * WINDOW, dtype=np.uint8)
    at = 0
    for t, w in zip(texts, windows, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(w) * WINDOW
    return flat, windows


def train(samples: Sequence[tuple[bytes, str]], steps: int = 160, batch: int = 96, seed: int = 7) -> Network:
    """samples: windows of text and their language. Adam on the cross-entropy; the gradient of a filter goes to the bytes at its largest response."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    x = np.zeros((len(samples), WINDOW + max(WIDTHS)), dtype=np.uint8)
    for i, (t, _) in enumerate(samples):
        part = t[:WINDOW]
        x[i, : len(part)] = np.frombuffer(part, dtype=np.uint8)
    y = np.array([languages.index(lang) for _, lang in samples], dtype=np.int64)
    net = Network(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), dtype=np.float32))
    params = [*net.tables, net.weight, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_language = [np.flatnonzero(y == k) for k in range(len(languages))]
    for step in range(1, steps + 1 if len(languages) > 1 else 0):
        pick = np.concatenate([rng.choice(g, max(1, batch // len(languages))) for g in by_language])
        xb, yb = x[pick], y[pick]
        pooled, places = [], []
        for t in net.tables:
            r = t[0][xb[:, :WINDOW]]
            for k in range(1, len(t)):
                r = r + t[k][xb[:, k : k + WINDOW]]
            p = r.argmax(axis=1)
            places.append(p)
            pooled.append(np.take_along_axis(r, p[:, None, :], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        d = softmax(h @ net.weight + net.bias)
        d[np.arange(len(yb)), yb] -= 1
        d /= len(yb)
        dh = d @ net.weight.T
        grads = []
        for j, (t, p) in enumerate(zip(net.tables, places, strict=True)):
            g = np.zeros_like(t)
            part = dh[:, j * FILTERS : (j + 1) * FILTERS]
            column = np.broadcast_to(np.arange(FILTERS), p.shape)
            for k in range(len(t)):
                np.add.at(g[k], (xb[np.arange(len(xb))[:, None], p + k], column), part)
            grads.append(g)
        grads += [h.T @ d, d.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def sample_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = TEXTS, windows: int = WINDOWS) -> list[tuple[bytes, str]]:
    """At most about `texts` texts of each language, chosen by a hash of their id, and `windows` windows of each, anywhere in it."""
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g")).where(F.col("g").isNotNull() & (F.length("t") > 0))
    rates = rows.groupBy("g").agg(F.least(F.lit(1.0), F.lit(float(texts)) / F.count(F.lit(1))).alias("rate"))
    h = F.xxhash64(F.lit(11), F.col("i"))
    # a row for each language
    chosen = rows.join(F.broadcast(rates), "g").where(F.pmod(h, F.lit(1_000_003)) < F.col("rate") * 1_000_003)
    room = F.greatest(F.length("t") - WINDOW, F.lit(1))
    parts = [F.substring(F.col("t"), (F.pmod(F.xxhash64(F.lit(k), F.col("i")), room) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows)]
    got = chosen.select("i", "g", F.array(*parts).alias("p")).collect()
    return [(p.encode(), r["g"]) for r in sorted(got, key=lambda r: (r["i"], r["p"][0])) for p in r["p"]]


def identify(df: DataFrame, net: Network | None, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row of df: id, lang_pred, score (the mean probability of that language over all windows of the whole text), and the columns in keep.

    A text that is null or has no letter is UNKNOWN with score 0, as is every text if there is no network. Repeated rows come out
    as often; an empty table gives no rows; other columns of df are not read.
    """
    names = [f"k{i}" for i in range(len(keep))]
    kept_text = [k for c, k in zip(keep, names, strict=True) if c == text_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, names, strict=True) if c != text_col])
    fields = [("id", id_col), *zip(names, keep, strict=True)]
    schema = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in fields) + ", lang_pred string, score double"

    def make():
        compiled = net.compiled() if net else None

        def each(x):
            out = {k: v for k, v in x.items() if k != "text"} | dict.fromkeys(kept_text, x["text"]) | {"lang_pred": [UNKNOWN] * len(x["id"]), "score": [0.0] * len(x["id"])}
            at = [i for i, t in enumerate(x["text"]) if net and t and LETTER.search(t)]
            while at:
                size, take = 0, 0  # some megabytes at once
                while take < len(at) and size < 4_000_000:
                    size += len(x["text"][at[take]])
                    take += 1
                part, at = at[:take], at[take:]
                flat, windows = flatten([x["text"][i].encode("utf-8", "replace") for i in part])
                p = softmax(responses(flat, compiled) @ net.weight + net.bias)
                mean = np.add.reduceat(p, np.concatenate([[0], np.cumsum(windows)[:-1]]), axis=0) / windows[:, None]
                best = mean.argmax(axis=1)
                for j, i in enumerate(part):
                    out["lang_pred"][i] = net.languages[best[j]]
                    out["score"][i] = min(1.0, float(mean[j, best[j]]))
            return out

        return each

    out = map_arrow(rows, make, schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", *[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)])

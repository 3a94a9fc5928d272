"""Toxicity by weak supervision.

Voters, each looking at a text alone, vote toxic, harmless or abstain: lexicons of words and word stems
that are mined from a bounded sample of labelled texts, and patterns of counts, letter case and spelling. A generative
label model explains the votes: given the hidden label, each voter depends on at most one other, by the tree
of the greatest conditional mutual information; accuracies and correlations are estimated by expectation
maximisation. A linear classifier is then trained on the model's posterior labels, and scores whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Bounds of the sample that is learnt from: toxic and other texts. All terms that it proves are used.
TOXIC, OTHER = 3_000, 12_000
LEXICONS, STEMS = 20, (4, 5, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Patterns that look at the text alone: shouted runs, rows of exclamation marks, masked words, drawn-out letters.
PATTERNS = (re.compile(r"[A-Z]{4,}[A-Z ,.]*!"), re.compile(r"[!?]{2,}"), re.compile(r"\w[*#@$]{2,}\w?"), re.compile(r"([^\W\d_])\1{3,}"))
#: What else a text gives beside its terms and patterns: whether it has a term, how many, their share of words.
EXTRA = 3


def terms_of(words: set[str]) -> set[str]:
    """Whole words (with a closing $) and stems."""
    out = {w + "$" for w in words}
    for n in STEMS:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


#: What a text must hold for a pattern to occur; the last pattern is sought in its distinct words first.
_MARKS = (("!",), ("!!", "??", "!?", "?!"), ("**", "##", "@@", "$$", "*#", "*@", "*$", "#*", "#@", "#$", "@*", "@#", "@$", "$*", "$#", "$@"))


def surface(text: str, distinct: set[str]) -> list[int]:
    """How often each pattern occurs. distinct: the lower-cased words of the text."""
    may = [any(m in text for m in marks) for marks in _MARKS]
    may.append("İ" in text or PATTERNS[3].search("\n".join(distinct)) is not None)  # this letter alone becomes two in lower case
    return [sum(1 for _ in p.finditer(text)) if m else 0 for p, m in zip(PATTERNS, may, strict=True)]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic: int, other: int) -> DataFrame:
    """y, n_words, surface, terms of at most about toxic + other labelled texts, near copies left out."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull()).groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("y") > 0, min(1.0, toxic / max(1, counts.get(1, 0)))).otherwise(min(1.0, other / max(1, counts.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(5), F.col("i").cast("string")), F.lit(1_000_003)) < rate * 1_000_003)
    # chosen has no more rows than the sample's bound allows, whatever the tables' size
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i").where(F.length("text") > 0).select(F.col("i").cast("string").alias("i"), "y", "text")

    def make():
        def each(x):
            out: dict[str, list] = {k: [] for k in ("i", "y", "m1", "m2", "n_words", "surface", "terms")}
            for i, y, text in zip(x["i"], x["y"], x["text"], strict=True):
                words = WORD.findall(text.lower())
                runs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))]
                low = min(runs), min(h * 0x9E3779B97F4A7C15 % 2**64 for h in runs)
                for c, v in zip(out, (i, y, low[0] - 2**63, low[1] - 2**63, len(words), surface(text, set(words)), sorted(terms_of(set(words)))), strict=True):
                    out[c].append(v)
            return out

        return each

    rows = map_arrow(rows, make, "i string, y int, m1 bigint, m2 bigint, n_words bigint, surface array<bigint>, terms array<string>")
    for m in ("m1", "m2"):  # texts that share their least window of words are taken for copies
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(m).orderBy("i", "n_words"))).where(F.col("r") == 1).drop("r")
    return materialize(rows.drop("m1", "m2"), "toxicity-sample")


def mine_terms(sample: DataFrame) -> list[str]:
    """Terms that are in toxic texts far more often than chance gives, by the log-likelihood ratio; the bar rises with the number of terms tried."""
    sizes = sample.agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).first()
    pos, all_ = int(sizes["a"] or 0), int(sizes["n"])
    if not 0 < pos < all_:
        return []
    share = pos / all_
    counts = materialize(sample.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("a") >= 4), "toxicity-terms")
    tried = counts.count()
    p = F.col("a") / F.col("n")
    llr = F.col("a") * F.log(p / share) + F.when(F.col("n") > F.col("a"), (F.col("n") - F.col("a")) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    best = counts.withColumn("llr", llr).where((F.col("llr") > math.log(max(tried, 1)) + 1.5) & (p >= 0.8)).orderBy(F.desc("llr"), "t")
    return [r["t"] for r in best.collect()]


@dataclass
class Model:
    terms: dict[str, int]
    weight: np.ndarray
    bias: float
    accuracy: np.ndarray
    correlation: np.ndarray


@dataclass
class Features:
    """Of some texts: the terms of text rows[k] are terms[k], and dense columns: any term, log of distinct terms, their share of words, log of each pattern's count."""

    rows: np.ndarray
    terms: np.ndarray
    dense: np.ndarray
    n_terms: int

    def product(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.terms], len(self.dense)) + self.dense @ w[self.n_terms :]

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.terms, g[self.rows], self.n_terms), self.dense.T @ g])


def features(hits: Sequence[Sequence[int]], n_words: Sequence[int], surfaces: Sequence[Sequence[int]], n_terms: int) -> Features:
    count = np.array([len(h) for h in hits], dtype=np.int64)
    share = np.minimum(1.0, 20 * count / np.maximum(1, np.array(n_words, dtype=np.int64)))
    pattern = np.log1p(np.array(surfaces, dtype=np.float64).reshape(len(hits), len(PATTERNS)))
    dense = np.column_stack([(count > 0).astype(float), np.log1p(count), share, pattern])
    return Features(np.repeat(np.arange(len(hits)), count), np.array([t for h in hits for t in h], dtype=np.int64), dense, n_terms)


def votes(x: Features) -> np.ndarray:
    """1 toxic, -1 harmless, 0 abstains. Lexicon g has every LEXICONS-th term; other voters look at counts, at patterns, and three at what is absent."""
    out = []
    n = len(x.dense)
    for g in range(LEXICONS):
        out.append((np.bincount(x.rows, x.terms % LEXICONS == g, n) > 0).astype(int))
    some, share, patterns = x.dense[:, 1], x.dense[:, 2], x.dense[:, EXTRA:]
    out.append(np.where(some >= math.log1p(2), 1, 0))
    # a word that is a term mostly brings its stems along: a term alone is chance
    out.append(np.where(some <= math.log1p(1), -1, np.where(share >= 0.05, 1, 0)))
    for p, least in zip(patterns.T, (4, 4, 1, 1), strict=True):
        out.append(np.where(p >= math.log1p(least), 1, 0))
    for g in range(3):
        out.append(np.where(np.bincount(x.rows, x.terms % 3 == g, n) == 0, -1, 0))
    return np.stack(out, axis=1)


LEVELS = (-1, 0, 1)
#: Weight of the prior that votes are right, and of a vote's chances given the label alone, as a share of the texts.
TRUST = 0.002


def _tree(joint: np.ndarray) -> list[int]:
    """The parent of each voter (-1 for none): the tree of the greatest mutual information given the label. joint: label, voter, vote, voter, vote."""
    m = joint.shape[1]
    own = np.einsum("yiaia->yia", joint)
    total = own.sum(axis=(0, 2))[0]
    label = own[:, 0].sum(axis=1)
    p = joint / total
    free = own[:, :, :, None, None] * own[:, None, None, :, :] / label[:, None, None, None, None] / total
    info = (p * np.log(np.maximum(p, 1e-12) / np.maximum(free, 1e-12))).sum(axis=(0, 2, 4))
    np.fill_diagonal(info, -1)
    parent, inside = [-1] * m, {0}
    while len(inside) < m:
        i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: (info[e], -e[0], -e[1]))
        # less than chance gives at two degrees of freedom is no correlation
        parent[j] = i if 2 * total * info[i, j] > 12 else -1
        inside.add(j)
    return parent


def _evidence(table: np.ndarray) -> np.ndarray:
    """Log-odds of toxic for each vote (the last axis); table: the votes' chances for either label (the first axis)."""
    odds = np.log(table[1] / table[0])
    return np.stack([np.minimum(odds[..., 0], 0), np.zeros_like(odds[..., 1]), np.maximum(odds[..., 2], 0)], axis=-1)


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes, accuracy of each voter, and the correlations of voters given the label.

    The model: a label, and votes that depend on it and on the vote of at most one other voter, in a tree. Voters are
    taken to be no worse than chance, and to abstain whatever the label is: a vote never speaks against what it says.
    """
    n, m = v.shape
    hot = np.stack([v == a for a in LEVELS], axis=2).astype(float)  # row, voter, vote
    flat = hot.reshape(n, -1)
    start = (v == 1).sum(axis=1) - 0.5 * (v == -1).sum(axis=1)
    post = np.where(start > 0, 0.9, 0.1 * prior)
    correlation = np.eye(m)
    for _ in range(rounds):
        weight = np.stack([1 - post, post])
        joint = np.stack([(flat * w[:, None]).T @ flat for w in weight]).reshape(2, m, 3, m, 3)
        parent = _tree(joint + 1e-9)
        own = np.einsum("yiaia->yia", joint) + 0.5
        own[0, :, 0] += TRUST * n  # the prior: votes are right
        own[1, :, 2] += TRUST * n
        own /= own.sum(axis=2, keepdims=True)
        z = np.full(n, math.log(prior / (1 - prior)))
        for j, i in enumerate(parent):
            if i < 0:
                z += hot[:, j] @ _evidence(own[:, j])
            else:  # the vote of j given the label and the vote of i, drawn to that given the label alone
                table = joint[:, i, :, j, :] + TRUST * n * own[:, j][:, None, :]
                table /= table.sum(axis=2, keepdims=True)
                z += np.einsum("na,ab,nb->n", hot[:, i], _evidence(table), hot[:, j])
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        mean = own @ np.array(LEVELS, dtype=float)
        residual = v - weight.T @ mean
        scale = np.sqrt((residual**2).mean(axis=0)) + 1e-6
        correlation = (residual / scale).T @ (residual / scale) / n
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    said = v != 0
    right = (v == 1) * post[:, None] + (v == -1) * (1 - post)[:, None]
    accuracy = (right.sum(axis=0) + 1) / (said.sum(axis=0) + 2)
    return post, accuracy, correlation


def linear(x: Features, target: np.ndarray, rounds: int = 400, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient descent with momentum; both classes weigh the same."""
    size = x.n_terms + x.dense.shape[1]
    w, b = np.zeros(size), 0.0
    vw, vb = np.zeros(size), 0.0
    sample = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    sample /= sample.sum()
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x.product(w) + b))) - target) * sample
        vw, vb = 0.9 * vw + x.gradient(g) + decay * w, 0.9 * vb + g.sum()
        w, b = w - rate * vw, b - rate * vb
    return w, b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, other: int = OTHER) -> Model:
    """What the labelled rows teach. labels: the rows that may be learnt from. toxic, other: bounds of the sample.

    Of conflicting labels of one id the greatest counts; null ids and labels, labels without a document and empty texts
    teach nothing; of texts that share their least window of words one is used. Without labels of both kinds, or
    empty tables, no text is toxic.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, toxic, other)
    terms = mine_terms(sample)
    at = {t: i for i, t in enumerate(terms)}
    none = Model({}, np.zeros(EXTRA + len(PATTERNS)), -3.0, np.zeros(0), np.zeros((0, 0)))
    known = spark_terms(sample, terms)
    rows = sorted(known.select("i", "y", "n_words", "surface", "h").collect(), key=lambda r: r["i"])
    share = sum(r["y"] > 0 for r in rows) / max(1, len(rows))
    if not terms or not 0 < share < 1:
        return none
    x = features([[at[t] for t in r["h"]] for r in rows], [r["n_words"] for r in rows], [r["surface"] for r in rows], len(terms))
    v = votes(x)
    post, accuracy, correlation = label_model(v[:, (v != 0).any(axis=0)], min(0.95, max(0.01, share)))  # voters that never vote say nothing
    w, b = linear(x, post)
    return Model(at, w, b, accuracy, correlation)


def spark_terms(sample: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The sample with h, the given terms among its own; the sample's bound bounds the terms."""
    table = sample.sparkSession.createDataFrame([(t,) for t in terms], "t string")
    found = sample.select("i", F.explode("terms").alias("t")).join(F.broadcast(table), "t").groupBy("i").agg(F.sort_array(F.collect_set("t")).alias("h"))
    return sample.join(found, "i", "left").withColumn("h", F.coalesce("h", F.array().cast("array<string>")))


def score(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of df: id, score (0 to 1), over the whole text.

    A null or empty text has no words and gets the score of a text without any term or pattern. Repeated rows come out as often; an
    empty table gives no rows; other columns of df are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    n = len(model.terms)

    def make():
        whole = {t[:-1]: i for t, i in model.terms.items() if t.endswith("$")}
        stems = [(k, {t: i for t, i in model.terms.items() if not t.endswith("$") and len(t) == k}) for k in STEMS]

        def each(x):
            hits, n_words, surfaces = [], [], []
            for text in x["text"]:
                words = WORD.findall((text or "").lower())
                distinct, h = set(words), set()
                h.update(whole[w] for w in whole.keys() & distinct)
                for k, table in stems:
                    h.update(table[s] for s in table.keys() & {w[:k] for w in distinct if len(w) >= k})
                hits.append(sorted(h))
                n_words.append(len(words))
                surfaces.append(surface(text or "", distinct))
            z = features(hits, n_words, surfaces, n).product(model.weight) + model.bias
            return {"id": x["id"], "score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()}

        return each

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, f"id {kind}, score double").withColumnRenamed("id", id_col)

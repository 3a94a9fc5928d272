"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest piece that starts at the current place, again and again. The
automaton is the trie of the vocabulary with failure links; each link carries the number of pieces that
following it pops, counted beforehand. So a word costs one step for each character and no piece is built.
A word that can't be cut into pieces counts as one unknown token.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

START = "▁"
#: Bounds of what a worker keeps: words and their length.
KEPT_WORDS, KEPT_LENGTH = 500_000, 24

_counters: dict[str, "Counter"] = {}


class Counter:
    """vocabulary: pieces; those that begin with START only match at the start of a word."""

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for p in vocabulary:
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                at = to
            piece[at] = bool(p) or piece[at]
        # fail: where the rest goes on once the longest pieces are popped, -1 for nowhere; popped: how many
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque((0, c, v) for c, v in self.next[0].items())
        while queue:
            u, c, v = queue.popleft()
            if piece[v]:
                self.fail[v], self.popped[v] = 0, 1
            else:
                at, n = self.fail[u], self.popped[u]
                while at >= 0 and c not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.next[at][c], n
            queue.extend((v, d, w) for d, w in self.next[v].items())
        self.kept: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be cut."""
        at, n, go, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in START + word:
            to = go[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = go[at].get(c)
            at = to
        while at > 0:  # the end: pop what is left
            n += popped[at]
            at = fail[at]
        return n if at == 0 else 0

    def counts(self, words: list[str]) -> tuple[int, int]:
        """Tokens and unknown words among them."""
        kept, tokens, unknown = self.kept, 0, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = n
            if n:
                tokens += n
            else:
                tokens, unknown = tokens + 1, unknown + 1
        return tokens, unknown


def model_pieces(model: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model file, as the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p for p in pieces if START not in p.lstrip(START) and not p.startswith(START * 2)]


def counter(model: str) -> Counter:
    if model not in _counters:
        _counters[model] = Counter(model_pieces(model))
    return _counters[model]


def count_tokens(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """For each row: id, n_words, n_tokens, n_unknown (words without a cut, one token each), all over the whole text.

    Words are parted by white space as str.split does. A null or empty text has zeros. One row for each row of df,
    repeated rows too; other columns are not read. model is a file that every executor can open.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        c = counter(model)

        def each(x):
            words = [(t or "").split() for t in x["text"]]
            both = [c.counts(w) for w in words]
            return {"id": x["id"], "n_words": list(map(len, words)), "n_tokens": [b[0] for b in both], "n_unknown": [b[1] for b in both]}

        return each

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)

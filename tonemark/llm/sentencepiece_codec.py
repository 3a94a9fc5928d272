"""SentencePiece (merge type) encoding and decoding by a prefix table.

For every prefix of a text the encoding's last token is unique: it is the one token that ends there
(found by an automaton over the vocabulary) and is compatible with the last token of the prefix before
it, where two tokens are compatible if encoding their concatenation gives just these two. The table is
filled from left to right and the ids are read backwards from its end.

A text is cut before each run of blanks first: no piece of the vocabulary has a blank after another
character, so no merge crosses such a place. Units that occur often are kept with their ids, up to a
fixed number of them.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BLANK = "▁"
#: Bounds of what a worker keeps: units, their length, and pairs of tokens.
KEPT_UNITS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 24, 1_000_000

_codecs: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in normal}
        self.text = {i: p for p, i in self.pieces.items()}
        self.score = {i: sp.get_score(i) for i in normal}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece has a blank inside; texts can't be cut at blanks")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if self.unk in self.byte_ids:
            raise ValueError("the model has no byte pieces")
        #: what each id decodes to; control ids decode to nothing
        self.out = [b""] * n
        for i, p in self.text.items():
            self.out[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.out[i] = bytes([b])
        self.out[self.unk] = " ⁇ ".encode()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        joined = "".join(p for p in self.pieces if len(p) > 1)
        #: line ends and tabs end a unit too, if no longer piece has them
        loose = "".join(c for c in "\n\t\r" if c not in joined)
        self.units = re.compile(f"{BLANK}*[^{BLANK}{loose}]+|{BLANK}+" + (f"|[{loose}]" if loose else ""))
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """The encoding by its definition: merge the pair with the best score, the first of equals, until none is left. None of its input may lack a piece."""
        parts: list[str | None] = list(text)
        left, right = [i - 1 for i in range(len(parts))], [i + 1 for i in range(len(parts))]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                i = self.pieces.get(parts[a] + parts[b])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, b, parts[a] + parts[b]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], right[a] = both, None, right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.pieces.get(p, self.unk) for p in parts if p is not None]

    def stands(self, i: int) -> bool:
        """Whether the token is what its own text encodes to."""
        if i not in self.alone:
            self.alone[i] = self.merge(self.text[i]) == [i]
        return self.alone[i]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return got

    def table(self, unit: str) -> list[int]:
        """The last token of each prefix; -1 for a character without a piece, which goes to bytes."""
        n = len(unit)
        last, done, pairs = [-1] * n, [False] * n, self.pairs
        for end, (i, size) in self.automaton.iter(unit):
            if done[end]:
                continue
            start = end - size
            before = last[start] if start >= 0 else -1
            if before < 0:
                good = self.stands(i)  # at the start, or after a character that no merge crosses
            else:
                good = pairs.get(before << 32 | i)
                if good is None:
                    good = self.compatible(before, i)
            if good:
                last[end], done[end] = i, True
        return last

    def unit_ids(self, unit: str) -> list[int]:
        last, out, end = self.table(unit), [], len(unit) - 1
        while end >= 0:
            i = last[end]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(unit[end].encode("utf-8", "replace"))]
                end -= 1
            else:
                out.append(i)
                end -= len(self.text[i])
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a text without begin and end, as little-endian 32-bit integers."""
        if not text:
            return b""
        kept, out = self.kept, []
        for unit in self.units.findall(BLANK + text.replace(" ", BLANK)):
            got = kept.get(unit)
            if got is None:
                got = b"".join(i.to_bytes(4, "little") for i in self.unit_ids(unit))
                if len(unit) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_UNITS:
                        kept.clear()
                    kept[unit] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str, begin_end: bool = True) -> list[int]:
        ids = memoryview(self.packed(text)).cast("I").tolist() if text else []
        return [self.bos, *ids, self.eos] if begin_end else ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, without the blank put before the text; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, ids))
        if text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def codec(model: str) -> Codec:
    """One for each model file and worker."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def round_trip(df: DataFrame, id_col: str, text_col: str, model: str, begin_end: bool = True, keep_ids: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again: id, n_tokens, ids_sha256, decoded_sha256.

    keep_ids adds ids (array<int>) and decoded (string). model is a merge-type model file with byte pieces that
    every executor can open. A null text counts as empty: begin and end ids only. One row for each row of df,
    repeated rows too; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        import array

        c = codec(model)
        first, end = (c.bos.to_bytes(4, "little"), c.eos.to_bytes(4, "little")) if begin_end else (b"", b"")

        def each(x):
            out = {"id": x["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep_ids else {})
            for text in x["text"]:
                packed = first + c.packed(text or "") + end
                ids = array.array("I", packed)
                back = c.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    out["ids"].append(list(ids))
                    out["decoded"].append(back)
            return out

        return each

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, schema).withColumnRenamed("id", id_col)

"""Operator 7: SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (space to U+2581, a dummy prefix), the
pieces with their weights, and the byte fallback. A text is composed with them into a lattice whose states
are (place, last piece), and the tropical-semiring shortest path from its start to its end is the
encoding. In a unigram model an arc weighs the negated score of its piece. In a BPE model an arc weighs
zero where the piece may follow the last one and infinity where merging would not have left that pair;
exactly one path of finite weight remains, the encoding. Decoding runs the inverse machine.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file
UNIGRAM, BPE = 1, 2  # kinds of models
CACHE_WORDS = 1_300_000  # words a Python worker remembers; older ones are encoded again
CACHE_PAIRS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at: at + size]
            at += size


class PieceTransducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        trainer, norm = {}, {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.score.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kind.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise ValueError("only identity normalisers are supported: this model has a character map")
        self.model = trainer.get(3, UNIGRAM)
        if self.model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kind[k] == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.kind[k] in (NORMAL, USER)}
        self.worst = 10.0 - min(self.score, default=0.0)  # a fallback costs more than any piece
        self.reach: dict[str, int] = {}  # longest piece by its first two characters
        for p in self.ids:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.chars = set("".join(self.ids))
        self.joined = {p[k: k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours within some piece
        space = SPACE if self.escape else " "
        # a word can be encoded alone where no piece holds a space after another character
        alone = not any(space in p.lstrip(space) for p in self.ids)
        if any(self.kind[k] == USER for k in self.ids.values()):
            alone = False
        cut = "".join(c for c in "\n\t\r" if c not in self.chars)
        self.units = re.compile(rf"[{cut}]|{space}*[^{space}{cut}]+|{space}+" if cut else rf"{space}*[^{space}]+|{space}+") if alone else re.compile(r"(?s).+")
        self.space = space
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.never: set[int] = set()
        levels = {x: k for k, x in enumerate(sorted(set(self.score), reverse=True))}
        self.rank = [levels[x] for x in self.score]  # when a piece is merged: the best score first, equal ones by place
        self.out = [b"" if self.kind[k] in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if self.kind[k] == BYTE else
                    " ⁇ ".encode() if self.kind[k] == UNKNOWN else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _split(self, piece: int) -> tuple[int, int] | None:
        """The last merge that makes a piece; None for a single character, and for pieces that merging never makes."""
        known = self.splits.get(piece, 0)
        if known != 0:
            return known
        parts, made = list(self.pieces[piece]), None
        while len(parts) > 1:  # the best scored pair first, the leftmost on ties
            found = [(-self.score[p], k) for k in range(len(parts) - 1) if (p := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            made = (parts[k], parts[k + 1])
            parts[k: k + 2] = [parts[k] + parts[k + 1]]
        whole = len(parts) == 1 and all(c in self.ids for c in self.pieces[piece])
        if not whole:
            self.never.add(piece)
        out = self.splits[piece] = (self.ids[made[0]], self.ids[made[1]]) if whole and made else None
        return out

    def _may_follow(self, last: int, piece: int) -> bool:
        """The arc weight of a BPE model: finite (True) or not. ``last`` -1: the start, or after a fallback.

        Undoes the merges next to the border, the latest first; a merge across the border that would have
        come before the one just undone rules the pair out.
        """
        known = self.pairs.get((last, piece))
        if known is not None:
            return known
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        self._split(piece)
        ok = piece not in self.never
        if ok and last >= 0:
            left, right, rank, merge = last, piece, self.rank, self.ids.get
            done = (1 << 60, 0)  # when the last undone merge was made: (rank, side); the left side goes first on ties
            while True:
                across = merge(self.pieces[left] + self.pieces[right])
                if across is not None and (rank[across], 1) < done:
                    ok = False
                    break
                a, b = self._split(left), self._split(right)
                if a is None and b is None:
                    break
                # of the two pieces, the one merged later is undone
                if b is None or (a is not None and rank[left] > rank[right]):
                    done, left = (rank[left], 0), a[1]
                else:
                    done, right = (rank[right], 2), b[0]
        self.pairs[last, piece] = ok
        return ok

    def shortest_path(self, text: str) -> list[int]:
        """Ids of the best path through the lattice of ``text`` (normalised)."""
        path = self._finite_path(text) if self.model == BPE else self._cheapest_path(text)
        if all(piece >= 0 for _, piece in path):
            return [piece for _, piece in path]
        out = []
        for at, piece in path:
            if piece >= 0:
                out.append(piece)
            elif self.byte:
                out.extend(self.byte[x] for x in text[at].encode())
            else:
                out.append(self.unknown)
        return out

    def _finite_path(self, text: str) -> list[tuple[int, int]]:
        """(place, piece) of the one path without an infinite arc; piece -1 is the fallback.

        Depth first, the longest pieces first. Whatever path of finite arcs reaches a place is the only
        one that does, so a place without a way on is never entered again.
        """
        n, ids, reach, may_follow = len(text), self.ids, self.reach, self._may_follow
        path: list[tuple[int, int]] = []
        dead = bytearray(n + 1)
        at, last, end = 0, -1, min(n, reach.get(text[:2], 1))
        while at < n:
            piece = None
            while end > at:
                if not dead[end]:
                    piece = ids.get(text[at:end])
                    if piece is not None and may_follow(last, piece):
                        break
                    piece = None
                end -= 1
            if piece is None and text[at] not in ids and not dead[at + 1]:
                piece, end = -1, at + 1
            if piece is None:  # back to the piece before, shorter
                dead[at] = 1
                end = at - 1
                at, _ = path.pop()
                last = path[-1][1] if path else -1
            else:
                path.append((at, piece))
                at, last = end, piece
                end = min(n, at + reach.get(text[at: at + 2], 1))
        return path

    def _cheapest_path(self, text: str) -> list[tuple[int, int]]:
        """(place, piece) of the path of least weight; the earliest found on ties."""
        n, inf = len(text), float("inf")
        cost: list[float] = [0.0] + [inf] * n
        back: list[tuple[int, int]] = [(-1, -1)] * (n + 1)
        for at in range(n):
            for end in range(at + 1, min(n, at + self.reach.get(text[at: at + 2], 1)) + 1):
                piece = self.ids.get(text[at:end])
                if piece is not None and cost[at] - self.score[piece] < cost[end]:
                    cost[end], back[end] = cost[at] - self.score[piece], (at, piece)
            if text[at] not in self.ids and cost[at] + self.worst < cost[at + 1]:
                cost[at + 1], back[at + 1] = cost[at] + self.worst, (at, -1)
        path, at = [], n
        while at > 0:
            path.append(back[at])
            at = back[at][0]
        return path[::-1]

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit. Where no piece holds the two characters at a border, the sides are encoded apart."""
        known, joined = self.words, self.joined
        cuts = [k for k in range(1, len(unit)) if unit[k - 1: k + 1] not in joined]
        if not cuts:
            return array("I", self.shortest_path(unit)).tobytes()
        parts = []
        for a, z in zip([0, *cuts], [*cuts, len(unit)]):
            part = unit[a:z]
            ids = known.get(part)
            if ids is None:
                ids = array("I", self.shortest_path(part)).tobytes()
                if len(part) < 64:
                    known[part] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        units = self.units.findall(self.normalise(text))
        ids = list(map(known.get, units))
        if None in ids:
            for k, unit in enumerate(units):
                if ids[k] is None:
                    found = known.get(unit)
                    if found is None:
                        found = self._unit(unit)
                        if len(unit) < 64:
                            known[unit] = found
                    ids[k] = found
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become U+FFFD. Without the dummy prefix."""
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def machine(model_path: str) -> PieceTransducer:
    """Compiled once per Python worker, from a vocabulary file installed on every machine."""
    with open(model_path, "rb") as f:
        return PieceTransducer(f.read())


def piece_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) per row: the encoding of every whole text. Null and empty texts have no ids; repeated rows stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model_path)
        for b in batches:
            ids = [np.frombuffer(own.encode(x or ""), "<u4").astype(np.int32) for x in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32 (UTF-8), round_trip.

    round_trip: decoding gives the text back. Only texts that hold U+2581 themselves do not (it becomes a
    space); null counts as empty. Rows are handled one by one: repeats, ties and other columns do not matter.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model_path)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                t = t or ""
                ids = own.encode(t)
                back = own.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == t))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.bool_())],
                                             names=["id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)

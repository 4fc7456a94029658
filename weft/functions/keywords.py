"""Many keywords in one pass over a batch of texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # bytes scanned at once, so that the scan's arrays stay small whatever the batch


def counter(groups: list[list[str]]):
    """Function of an Arrow string array: for each text a list of how many keywords of each group it holds (null: null).

    A table of three-byte codes picks the places where a keyword may begin; those are compared byte by byte, and
    a match must end inside its text. Keywords are compared as UTF-8 bytes and must not be empty. All helpers are
    local, so that the function travels to workers whole.
    """
    def codes(data: np.ndarray) -> np.ndarray:
        """15-bit code of the three bytes from each place (five low bits of each); the last two places have none."""
        low = (data & 31).astype(np.uint16)
        return low[:-2] << 10 | low[1:-1] << 5 | low[2:]

    words = sorted({w.encode() for g in groups for w in g})
    if not all(words):
        raise ValueError("an empty keyword")
    weight = np.array([[[x.encode() for x in g].count(w) for g in groups] for w in words], np.int32).reshape(len(words), len(groups))
    longest = max(map(len, words), default=1)
    starts: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 3:
            starts.setdefault(int(codes(np.frombuffer(w[:3], np.uint8))[0]), []).append(i)
    code_of = np.zeros(1 << 15, np.uint16)
    for at, code in enumerate(starts, 1):
        code_of[code] = at
    short = [i for i, w in enumerate(words) if len(w) < 3]

    def found(data: np.ndarray, n: int):
        """(keyword number, places below ``n`` where it stands) in ``data``, which goes on for the longest keyword."""
        kind = code_of[codes(data)[:n]]
        places = np.flatnonzero(kind)
        kind = kind[places]
        order = np.argsort(kind, kind="stable")
        places, ends = places[order], np.searchsorted(kind[order], np.arange(1, len(starts) + 2))
        todo = [(i, places[a:z]) for (a, z), same in zip(zip(ends[:-1], ends[1:]), starts.values()) for i in same]
        todo += [(i, np.flatnonzero(data[:n] == words[i][0])) for i in short]
        for i, p in todo:
            for j, byte in enumerate(words[i]):
                p = p[data[p + j] == byte]
            yield i, p

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
        size = int(bounds[-1] - bounds[0])
        held = np.zeros((n, len(words)), bool)
        if size and words:
            data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
            bounds = bounds - bounds[0]
            for at in range(0, size, SLICE_BYTES):
                m = min(SLICE_BYTES, size - at)
                part = data[at:at + m + longest]
                part = np.concatenate([part, np.zeros(m + longest + 2 - len(part), np.uint8)])
                for i, p in found(part, m):
                    p = p + at
                    row = np.searchsorted(bounds, p, "right") - 1
                    held[row[p + len(words[i]) <= bounds[row + 1]], i] = True
        counts = held.astype(np.int32) @ weight
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(groups)), pa.array(counts.ravel(), pa.int32()),
                                        mask=texts.is_null() if texts.null_count else None)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # types, not their names: Spark reads the kind of UDF from them
    return run

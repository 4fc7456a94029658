"""Operator 8: quality rules by repetition coverage.

Words are hashed once; rolling hashes of several n-gram lengths are made over a whole batch of
documents in numpy; characters inside repeated n-grams and repeated lines are measured against the
document's characters. Row-local: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_N = 3
#: Largest allowed share (per cent) of word characters inside later copies of an n-gram, by n-gram length (published values).
MAX_DUP_PCT = {5: 15, 7: 13, 10: 10}
#: Largest allowed share (per cent) of word characters inside later copies of a line.
MAX_DUP_LINE_PCT = 20
#: Largest allowed share (per cent) of symbols in the word characters.
MAX_SYMBOL_PCT = 10
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SLICE_BYTES = 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
          *[f"dup_chars_{n}" for n in sorted(MAX_DUP_PCT)]]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _repeats(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its document, found earlier in its document) for every n-gram; order is by position."""
    key = _mix(gram + _mix((doc.astype(np.uint64) + np.uint64(1)) * _MUL))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def _cover(start: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words inside n-grams that start at ``start``."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge[:size]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of COUNTS for a list of texts."""
    n_docs = len(texts)
    out = {c: np.zeros(n_docs, np.int64) for c in COUNTS}
    words = [t.encode().split() for t in texts]  # bytes split on exactly \x20 \x09-\x0D
    out["n_words"] = np.fromiter(map(len, words), np.int64, n_docs)
    flat = list(chain.from_iterable(words))
    total = len(flat)
    doc = np.repeat(np.arange(n_docs), out["n_words"])
    for k, t in enumerate(texts):
        out["word_chars"][k] = len(t) - sum(map(t.count, WHITE))
        out["n_symbols"][k] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        if len(lines) > 1:
            seen: set[str] = set()
            for x in lines:
                if x in seen:
                    out["n_dup_lines"][k] += 1
                    out["dup_line_chars"][k] += len(x) - sum(map(x.count, WHITE))
                seen.add(x)
    if not total:
        return out
    joined = np.frombuffer(b" ".join(flat), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, total) + 1)
    lead = np.r_[0, np.cumsum((joined & 0xC0) != 0x80)]  # code points before each byte
    chars = lead[ends - 1] - lead[np.r_[0, ends[:-1]]]
    h = np.fromiter(map(hash, flat), np.int64, total).view(np.uint64)
    roll, upto = h.copy(), 1
    for n in sorted({BASE_N, *MAX_DUP_PCT}):
        while upto < n and len(roll) > 1:  # extend every window by its next word
            roll = _mix(roll[:-1] * _MUL + h[upto:])
            upto += 1
        if upto < n or not len(roll):
            break
        start = np.flatnonzero(doc[: total - n + 1] == doc[n - 1:])
        if not len(start):
            continue
        many, later = _repeats(doc[start], roll[start])
        if n == BASE_N:
            out["n_repeat_words"] += np.bincount(doc[_cover(start[many], n, total)], minlength=n_docs)
        if n in MAX_DUP_PCT:
            inside = _cover(start[later], n, total)
            out[f"dup_chars_{n}"] += np.bincount(doc[inside], weights=chars[inside], minlength=n_docs).astype(np.int64)
    return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES, so that a batch of very long texts stays within memory."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def quality_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) and the quality columns.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, dup_chars_<n>,
    base_failed, kept. Null and empty texts have no words, so base_failed. Columns of ``docs`` with one
    of these names are replaced. One output row per input row: repeated rows and ties are each measured on
    their own. Very long texts are measured whole, a few megabytes of texts at a time. An empty table gives
    an empty result.
    """
    added = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    names = {f.name for f in added}
    own = [c for c in (keep or docs.columns) if c not in names]
    if text in names:
        raise ValueError(f"the text column may not be named {text}")
    src = docs.select(*own, *([] if text in own else [text]))
    schema = T.StructType([src.schema[c] for c in own] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(text).to_pylist()]
            for lo, hi in _slices(texts):
                m = measure(texts[lo:hi])
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])
                bad = 100 * m["dup_line_chars"] > MAX_DUP_LINE_PCT * m["word_chars"]
                bad |= 100 * m["n_symbols"] > MAX_SYMBOL_PCT * m["word_chars"]
                for n, pct in MAX_DUP_PCT.items():
                    bad |= 100 * m[f"dup_chars_{n}"] > pct * m["word_chars"]
                cols = [b.column(c).slice(lo, hi - lo) for c in own]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(m[c]) for c in COUNTS], pa.array(failed), pa.array(~failed & ~bad)],
                                                 names=[*own, *COUNTS, "base_failed", "kept"])

    return src.mapInArrow(run, schema)

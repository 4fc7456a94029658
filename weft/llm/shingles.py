"""Sets of word shingles as sorted 64-bit hashes, taken from Arrow string buffers a few megabytes at a time.

A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is a sum of products of random
numbers, one for the byte and one for its place, so that all words of a buffer are hashed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17  # bytes hashed together
PLACES = 4096
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0


def _mix(h: np.ndarray, multiplier: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(multiplier)
    h ^= h >> np.uint64(29)
    return h


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``data``; ``starts``: places where a text starts, which end a word too."""
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = space[:-1]
    first[starts] = True
    first &= ~space
    at = np.flatnonzero(first)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    here = np.arange(len(data), dtype=np.int32)
    place = here - np.maximum.accumulate(here * first)
    value = _BYTE[data]
    value *= _PLACE[place & (PLACES - 1)]
    far = np.flatnonzero(place >= PLACES)  # in words longer than the table its runs are weighed as well
    if len(far):
        value[far] *= _mix((place[far] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9) | np.uint64(1)
    return at, _mix(np.add.reduceat(value, at), 0x94D049BB133111EB)


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about SEGMENT bytes, at the start of a text or at white space; a longer word is whole."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            k = np.searchsorted(bounds, end)
            limit = int(bounds[k]) if k < len(bounds) else len(data)  # the next text starts there at the latest
            while end < limit:
                found = np.flatnonzero(_SPACE[data[end: min(limit, end + SEGMENT)]])
                if len(found):
                    end += int(found[0])
                    break
                end = min(limit, end + SEGMENT)
        yield at, end
        at = end


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8))[off[0]: off[-1]], off - off[0]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    Fewer words than k are one shingle, the whole sequence; null, empty and blank texts have none.
    """
    data, off = _buffers(texts)
    lo = 0
    while lo < len(texts):  # runs of whole texts of about 64 SEGMENT
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + 64 * SEGMENT, "right")) - 1)
        part, bounds = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, z in _segments(part, bounds):
            inner = bounds[np.searchsorted(bounds, a): np.searchsorted(bounds, z)] - a
            where, h = _words(part[a:z], inner)
            at.append(where + a)
            hashes.append(h)
        at, h = np.concatenate(at), np.concatenate(hashes)
        edge = np.searchsorted(at, bounds)  # words of text i: edge[i] to edge[i + 1]
        acc = h
        for j in range(1, k):  # order matters: each word is mixed into the state of those before it
            acc = _mix(acc[:-1], 0x9E3779B97F4A7C15) + h[j:] if len(acc) else acc
        acc = _mix(acc, 0xD6E8FEB86659FD93)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            n = z - a
            if n >= k:
                s = np.sort(acc[a: z - k + 1])
                new = s[1:] != s[:-1]
                yield s if new.all() else s[np.r_[True, new]]
            elif n:
                s = h[a: a + 1]
                for j in range(a + 1, z):
                    s = _mix(s, 0x9E3779B97F4A7C15) + h[j: j + 1]
                yield _mix(s + np.uint64(n), 0xA0761D6478BD642F)
            else:
                yield h[:0]
        lo = hi

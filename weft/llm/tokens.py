"""Operator 1: token ids in binary files with a shared zstandard dictionary.

File format (a Parquet table in a folder, so that any file system Spark writes to will do):

* ``dictionary``: one row (dict_hash, dictionary); the zstandard dictionary is trained on the serialized
  id arrays of a bounded sample of documents, dict_hash is the first 16 hex digits of its SHA-256.
* ``blocks``: one row per run of documents in ascending id order: part, block, dict_hash, data (the
  documents' zstandard frames one after the other, each compressed on its own) and the offset index:
  doc_ids, frame_ends (bytes), token_starts (ids before the document within its part) and token_counts.
* ``parts``: (part, base): ids before each part.

A document's ids are little-endian unsigned 32-bit integers. One document is read by its block row, a
slice of ``data`` and the dictionary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import n_parts, scratch_path

DICT_BYTES = 64 << 10  # size of the dictionary
SAMPLE_DOCS = 1024  # documents the dictionary is trained on, about; twice as many at most
SAMPLE_IDS = 512  # ids of each that training sees, at most
BLOCK_BYTES = 1 << 20
CACHE_WORDS = 1_200_000  # words a Python worker remembers; older ones are encoded again
_MARK = re.compile(r"[^\w\s]|[_\x1c-\x1f\x85]")
#: a stop or comma after anything but a plain letter or digit; the fixed start makes the search fast
STOPS = [re.compile(r"\. (?<=[^a-zA-Z0-9]\. )"), re.compile(r", (?<=[^a-zA-Z0-9], )")]
#: the parts of a tokenizer file under which words, and stops that end them, can be encoded apart
APART = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"], "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
LEVEL = 3

BLOCK_SCHEMA = ("part int, block int, dict_hash string, data binary, doc_ids array<long>, frame_ends array<long>, "
                "token_starts array<long>, token_counts array<long>")


def _parts_of(path: str) -> dict:
    """The parts of a tokenizer file that APART names."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    norm, pre = ((file[k] or {}).get(n, []) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    split = [x["pattern"].get("Regex") for x in pre if x["type"] == "Split"]
    return {"normalizer": [x["type"] for x in norm], "pre_tokenizer": [x["type"] for x in pre], "split": split[0] if split else None}


class Encoder:
    """Text -> ids as bytes. Where white space never joins two tokens (APART) each distinct word is encoded once; other
    tokenizers encode whole texts."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        if suffix:
            self.closes[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.apart = bool(suffix) and _parts_of(path) == APART
        self.marked: dict[str, bool] = {}  # does a character end in a mark once it is normalised
        self.words: dict[str, bytes] = {}  # lives as long as the Python worker
        self.end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of ``words``. Words of letters go to the library many at a time and are told apart by the ids that end
        a word; where these do not come out one for each, and for all other words, each goes alone."""
        out: dict[str, bytes] = {}
        plain: list[str] = []
        rest: list[str] = []
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        parts = [plain[lo: lo + 200] for lo in range(0, len(plain), 200)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                rest.extend(part)
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist()):
                out[w] = data[at:end]
                at = end
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def _mark(self, char: str) -> bool:
        known = self.marked.get(char)
        if known is None:
            known = self.marked[char] = any(_MARK.search(x) for x in (char, self.tokenizer.normalizer.normalize_str(char)))
        return known

    def _words(self, text: str) -> list[str]:
        """The parts of a text that can be encoded apart: words, and a full stop or comma that ends one.

        Case goes before only where Python and the library agree on it (ASCII, no special token); a stop or comma
        after another mark, also one that normalising parts from its letter, stays with it, as the library takes runs
        of marks as one.
        """
        if text.isascii() and "<|" not in text:
            text = text.lower()
        text = text.replace("\n", " ") + " "
        if not any(self._mark(text[m.start() - 1]) for p in STOPS for m in p.finditer(text)):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of every text with the end id, as bytes."""
        if not self.apart:
            return [np.array(e.ids, "<u4").tobytes() + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        split = [self._words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        ids = list(map(known.get, flat))
        gaps, k = [], -1
        while True:
            try:
                k = ids.index(None, k + 1)
            except ValueError:
                break
            gaps.append(k)
        if gaps:
            fresh = self._learn({flat[k] for k in gaps})
            for k in gaps:
                ids[k] = fresh[flat[k]]
            known.update(fresh)
        out, at = [], 0
        for ws in split:
            out.append(b"".join(ids[at: at + len(ws)]) + self.end)
            at += len(ws)
        return out


def _slices(texts: pa.Array, most: int = 4 << 20):
    """(offset, length) of runs of texts of about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def train_dictionary(docs: DataFrame, n_docs: int, tokenizer: str, id_col: str, text: str, end_id: int | None) -> bytes:
    """From about SAMPLE_DOCS of ``n_docs`` rows, those with a small hash of (id, text); raw content where there is too little to train on."""
    some = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col), F.col(text))), 1, 12), 16, 10).cast("long") <= F.lit(int((1 << 48) * min(1.0, SAMPLE_DOCS / max(1, n_docs))))
    texts = [r[0] for r in docs.where(F.col(text) != "").where(some).select(F.substring(text, 1, 8 * SAMPLE_IDS)).limit(2 * SAMPLE_DOCS).collect()]
    samples = [x[: 4 * SAMPLE_IDS] for x in encoder(tokenizer, end_id).many(sorted(texts))]
    if len(samples) < 64 or sum(map(len, samples)) < 4 * DICT_BYTES:
        return b"".join(samples)[:DICT_BYTES]
    return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the token files of ``docs`` under ``path``, in ascending id order (null ids first, equal ids by text).

    Null and empty texts have only the end id. Repeated rows are each written. Long texts are whole; a
    document is one frame, and a block closes as soon as it holds BLOCK_BYTES. An empty table writes
    empty tables. Documents are encoded and compressed where they are read; only frames are shuffled, to
    parts cut at quantiles of the ids.
    """
    spark = docs.sparkSession
    n = n_parts(spark)
    n_docs, cuts = docs.select(F.count("*"), F.percentile_approx(F.col(id_col).cast("long"), [k / n for k in range(1, n)] or [0.5], 10_000)).first()
    dictionary = train_dictionary(docs, n_docs, tokenizer, id_col, text, end_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest()[:16]
    spark.range(1).select(F.lit(dict_hash).alias("dict_hash"), F.lit(dictionary).alias("dictionary")).write.parquet(f"{path}/dictionary")

    part = F.coalesce(F.aggregate(F.lit(cuts), F.lit(0), lambda k, c: k + (F.col(id_col) > c).cast("int")), F.lit(0)) if cuts else F.lit(0)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), part.alias("part"), F.xxhash64(F.col(text)).alias("tie"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        for b in batches:
            for lo, size in _slices(b.column("text")):
                sub = b.slice(lo, size)
                ids = enc.many([x or "" for x in sub.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([sub.column("part"), sub.column("id"), sub.column("tie"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array([comp.compress(x) for x in ids], pa.binary())], names=["part", "id", "tie", "n", "frame"])

    frames = src.mapInArrow(encode, "part int, id long, tie long, n long, frame binary")
    dealt = frames.repartition(n, "part").sortWithinPartitions("part", "id", "tie")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = block = start = size = 0
        held: list[tuple[int | None, int, bytes, int]] = []

        def flush() -> pa.RecordBatch:
            ids, counts, data, starts = zip(*held)
            row = [now, block, dict_hash, b"".join(data), list(ids), np.cumsum([len(x) for x in data]).tolist(), list(starts), list(counts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES)], names=BLOCK_NAMES)

        for b in batches:
            for p, i, _, k, f in zip(*(c.to_pylist() for c in b.columns)):
                if held and (p != now or size >= BLOCK_BYTES):
                    yield flush()
                    held, size, block = [], 0, block + 1
                if p != now:
                    now, block, start = p, 0, 0
                held.append((i, k, f, start))
                start, size = start + k, size + len(f)
        if held:
            yield flush()

    dealt.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").select("part", F.explode("token_counts").alias("n")).groupBy("part").agg(F.sum("n")).collect()
    base, run = [], 0  # one entry per part
    for p, s in sorted(map(tuple, totals)):
        base.append((p, run))
        run += s
    rows = F.explode(F.from_json(F.lit(str([{"part": p, "base": b} for p, b in base]).replace("'", '"')), "array<struct<part:int,base:long>>")).alias("x")
    spark.range(1).select(rows).select("x.part", "x.base").write.parquet(f"{path}/parts")


BLOCK_NAMES = [x.split(" ")[0] for x in BLOCK_SCHEMA.split(", ")]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 4]


class Reader:
    """Frames of one block row back to ids."""

    def __init__(self, dict_hash: str, dictionary: bytes):
        if hashlib.sha256(dictionary).hexdigest()[:16] != dict_hash:
            raise ValueError("the dictionary does not have the hash that the files name")
        self.dict_hash = dict_hash
        self.decomp = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, dict_hash: str, data: bytes, frame_ends: list[int], k: int) -> bytes:
        """Document ``k`` of a block: its ids as bytes."""
        if dict_hash != self.dict_hash:
            raise ValueError("the block was written with another dictionary")
        return self.decomp.decompress(data[frame_ends[k - 1] if k else 0: frame_ends[k]])


def _reader(spark: SparkSession, path: str) -> Reader:
    return Reader(*spark.read.parquet(f"{path}/dictionary").first())


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: reads the index, one block and the dictionary."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    row = blocks.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("dict_hash", "data", "frame_ends", F.array_position("doc_ids", F.lit(doc_id).cast("long")).alias("k")).first()
    return None if row is None else np.frombuffer(_reader(spark, path).ids(row[0], bytes(row[1]), row[2], row[3] - 1), "<u4").tolist()


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per written document: id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    meta = spark.read.parquet(f"{path}/dictionary").first()
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").join(F.broadcast(parts), "part")  # one small row per part

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*meta)
        for b in batches:
            for k in range(b.num_rows):
                h, data, ends, ids, starts, base = (b.column(c)[k].as_py() for c in ("dict_hash", "data", "frame_ends", "doc_ids", "token_starts", "base"))
                raw = [reader.ids(h, data, ends, j) for j in range(len(ends))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([base + s for s in starts], pa.int64()),
                                                  pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                                                 names=["id", "start", "n_tokens", "ids_crc32"])

    cols = blocks.select("dict_hash", "data", "frame_ends", "doc_ids", "token_starts", "base")
    return cols.mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens (the ids ``write_tokens`` would write, the end id counted) and text_hash, which tells rows of one id apart.

    Null and empty texts have only the end id. Texts, however long, are encoded whole where they are read; repeated
    rows and null ids are rows like any other, other columns are left out, an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        for b in batches:
            for lo, size in _slices(b.column("text")):
                sub = b.slice(lo, size)
                n = [len(x) // 4 for x in enc.many([x or "" for x in sub.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([sub.column("id"), pa.array(n, pa.int64()), sub.column("text_hash")], names=["id", "n_tokens", "text_hash"])

    return src.mapInArrow(count, "id long, n_tokens long, text_hash long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to a new folder beside the checkpoints and return what the files hold."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text)
    return read_tokens(docs.sparkSession, path, id_col)

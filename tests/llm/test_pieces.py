import zlib

import numpy as np
import sentencepiece

from weft.llm.pieces import PieceTransducer, piece_digests, piece_ids
from weft.llm.queries import QUERIES, tokenizer_path

SF_SMALL = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"
ODD = ["", " ", "  ", " a", "a  b\n\nc", "naïve 日本語 \t tab 🙂🙂", "a" * 60 + "    " + "b" * 40, "the the" * 50, "\x00\x01", "É é", "x" * 5000, "\r\n\r\n", "１２ ﬁ"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def test_same_ids_as_the_library_and_round_trip():
    lib, own = library(), PieceTransducer(open(tokenizer_path(MODEL), "rb").read())
    for t in ODD:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == lib.encode(t), t
        assert own.decode(own.encode(t)) == t
    assert own.decode(own.encode("a ▁b")) == lib.decode(lib.encode("a ▁b"))


def test_query_equals_the_library(spark):
    lib = library()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op7_sentencepiece"](spark, SF_SMALL).collect():
        ids = np.array(lib.encode(text[r["doc_id"]]), "<u4")
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_messy_rows(spark, messy, no_docs, clashing):
    lib = library()
    path = tokenizer_path(MODEL)
    want = sorted(((r["doc_id"], lib.encode(r["text"] or "")) for r in messy.collect()), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in piece_ids(clashing, path).collect()), key=repr) == want
    assert piece_ids(no_docs, path).collect() == [] and piece_digests(no_docs, path).collect() == []
    assert all(r["round_trip"] for r in piece_digests(messy, path).collect())


def test_unigram_weights_take_the_cheapest_path():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(p, score, kind=1):
        return field(1, field(1, p.encode()) + b"\x15" + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in (("▁", -2), ("a", -3), ("b", -3), ("ab", -4), ("▁ab", -9), ("▁a", -3)))
    own = PieceTransducer(model + field(2, bytes([3 << 3, 1])))
    names = lambda t: [own.pieces[k] for k in np.frombuffer(own.encode(t), "<u4")]
    assert names("ab") == ["▁a", "b"] or names("ab") == ["▁", "ab"]  # both cost 6
    assert names("aab") == ["▁a", "ab"]
    assert names("a?") == ["▁a", "<unk>"]


def test_runs_and_joined_pieces_equal_the_library():
    """Runs of every character that some piece repeats, and pieces joined at random."""
    import random

    lib, own = library(), PieceTransducer(open(tokenizer_path(MODEL), "rb").read())
    again = sorted({p[0] for p in own.ids if len(set(p)) == 1 and len(p) == 2})
    texts = [form.format(c * n) for c in (x.replace("\u2581", " ") for x in again) for n in (*range(1, 41), 64, 100, 199, 200) for form in ("{}", "a{}b", "{0}\n{0}")]
    rnd = random.Random(1)
    pieces = [p.replace("\u2581", " ") for p in own.ids]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 8))) for _ in range(8000)]
    texts += ["".join(rnd.choice([" ", " " * rnd.randint(1, 30), rnd.choice(pieces)]) for _ in range(rnd.randint(1, 10))) for _ in range(4000)]
    assert [t for t in texts if np.frombuffer(own.encode(t), "<u4").tolist() != lib.encode(t)] == []

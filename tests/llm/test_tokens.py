import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weft.llm import tokens as K
from weft.llm.common import scratch_path
from weft.llm.queries import QUERIES, tokenizer_path

SF_SMALL = "/root/testdata/sf0.001"

NAME = "word_bpe_49k.json"


def expected(pairs):
    tok = Tokenizer.from_file(tokenizer_path(NAME))
    out, start = [], 0
    for d, t in pairs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(tuple(r) for r in QUERIES["op1_token_files"](spark, SF_SMALL).collect()) == expected(docs)


def test_messy_rows_round_trip_and_single_reads(spark, messy):
    path = scratch_path(spark, "tokens-test")
    K.write_tokens(messy, path, tokenizer_path(NAME))
    got = [tuple(r) for r in K.read_tokens(spark, path).orderBy("start").collect()]
    assert len(got) == messy.count()
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))  # ascending, null ids first
    starts = np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert [r[1] for r in got] == starts
    by_id = {r[0]: r for r in got}
    want = {r[0]: r for r in expected([(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()])}
    for d in (1, 4, 5, 10, 14):
        assert by_id[d][2:] == want[d][2:]
    assert K.read_document(spark, path, 5) == [2]
    assert len(K.read_document(spark, path, 14)) == by_id[14][2]
    assert K.read_document(spark, path, 99) is None


def test_empty_table_and_clashing_columns(spark, no_docs, clashing, messy):
    assert K.token_files(no_docs, tokenizer_path(NAME)).collect() == []
    a = sorted(map(tuple, K.token_files(clashing, tokenizer_path(NAME)).collect()), key=repr)
    b = sorted(map(tuple, K.token_files(messy, tokenizer_path(NAME)).collect()), key=repr)
    assert a == b


def test_another_dictionary_is_refused():
    with pytest.raises(ValueError):
        K.Reader("0" * 16, b"other")


def test_words_apart_encode_like_whole_texts():
    tok = Tokenizer.from_file(tokenizer_path(NAME))
    enc = K.Encoder(tokenizer_path(NAME), None)
    texts = ["it's  a\ttest\n\nof <|endoftext|> marks<|startoftext|>x", "don't 12345 naïve é e\u0301 \u0301x ΑΣ ΑΣ. 日本語\u3000字", "a\u00a0b\u2028c \u0301\u0301 İI ﬁ", "  lead and trail  ", "", "Stop. Go, on.. No?. 5. _. x\x1c. (a). b., c,. <|ENDOFTEXT|> D. é. É, ,. . ,", "ends."]
    for t in texts:
        assert np.frombuffer(enc.many([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def same_ids(texts, path):
    enc, tok = K.Encoder(path, None), Tokenizer.from_file(path)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return [t for t, g, w in zip(texts, enc.many(texts), want) if np.frombuffer(g, "<u4").tolist() != w]


def test_every_character_before_a_stop():
    """Also letters that normalising parts into letter and mark (U+0130, U+0958, U+09DC, ...), and all marks."""
    chars = [chr(c) for c in range(1, 0x3000)]
    chars += [chr(c) for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c).lower()) != chr(c)]
    for form in ("x{}. y", "{}, y", "a{} b", "q {}. {}, {}"):
        assert same_ids([form.replace("{}", c) for c in chars], tokenizer_path(NAME)) == []


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A file whose parts are not those that allow words to be encoded apart."""
    import json

    with open(tokenizer_path(NAME), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"] = file["normalizer"]["normalizers"][:2]
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    assert not K.Encoder(path, None).apart and K.Encoder(tokenizer_path(NAME), None).apart
    assert same_ids(["Some Text. Here, there", "", "a\nb  c"], path) == []

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import corpus_pipeline as P

from weft.llm.common import stored

SF_SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_against_brute_force(spark):
    """Every stage's decisions, taken again from what the stage before it kept."""
    from llm.test_lines import brute as lines
    from llm.test_packing import library_counts
    from llm.test_quality import sql_rows
    from llm.test_simhash import brute as simhash
    from llm.test_suffix import cover

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in P.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF_SMALL), f"test-{name}"))
    pairs = [sorted(tuple(r) for r in df.select("doc_id", "text").collect()) for df in kept[:-1]]
    good = {d for d, ok in sql_rows(docs, ["doc_id", "kept"]) if ok}
    assert pairs[1] == [p for p in pairs[0] if p[0] in good] and 0 < len(pairs[1]) < len(pairs[0])
    assert dict(pairs[2]) == lines(pairs[1], 1, 5)
    assert pairs[3] == [p for p in pairs[2] if p[0] in {d for d, _, c in simhash(pairs[2]) if c == d}] and len(pairs[3]) < len(pairs[2])
    for (d, b, gone), (e, text) in zip(cover(pairs[3]), pairs[4]):
        every = bytearray()
        for c, at in _characters(b):
            if not all(gone[at: at + len(c)]):
                every += c
        assert d == e and text.encode() == bytes(every)
    assert all(df.columns == docs.columns for df in kept[:-1])
    assert all(r["n_chars"] == len(r["text"]) for r in kept[4].collect())
    tokens = defaultdict(int)
    for r in kept[5].collect():
        tokens[r["doc_id"]] += r["n_tokens"]
    assert dict(tokens) == library_counts(dict(pairs[4]))
    assert P.run(spark, SF_SMALL).count() == kept[5].count()


def _characters(b):
    at = 0
    for ch in b.decode():
        c = ch.encode()
        yield c, at
        at += len(c)


def test_messy_rows_pass_through_every_stage(spark, messy, no_docs, clashing):
    for start in (messy, clashing, no_docs):
        docs = start
        for name, stage in P.STAGES:
            docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert (docs.count() > 0) == (start is not no_docs)


def test_the_rest_does_without_this_package(tmp_path):
    """__spark_entry__ still imports where the package and the pipeline are not there."""
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, *a):\n"
            "        if name in ('weft.llm', 'corpus_pipeline'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()] and len(e.queries()) >= 150 and e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)

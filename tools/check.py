"""Run registered queries on Spark and their oracle SQL on DuckDB; compare rows, columns and values.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v, digits):  # noqa: C901
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, digits) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x, digits) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(v[k], digits)}" for k in sorted(v)) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict(), digits)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(rows, cols, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i], digits) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--digits", type=int, default=6)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    import duckdb

    from weft.plans.registry import ORACLES, QUERIES, load_all
    from weft.session import get_spark

    load_all()
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = [n for n in QUERIES if not a.names or any(n.startswith(p) for p in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLES:
            print(f"ROWS {n}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[n])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {n}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        if len(srows) != len(drows):
            print(f"FAIL {n}: rows spark={len(srows)} duck={len(drows)}")
            bad += 1
            continue
        dcols_map = {c: i for i, c in enumerate(dcols)}
        drows = [tuple(r[dcols_map[c]] for c in scols) for r in drows]
        hs, ls = digest(srows, scols, a.digits)
        hd, ld = digest(drows, scols, a.digits)
        exact = digest(srows, scols, 15)[0] == digest(drows, scols, 15)[0]
        if hs != hd:
            bad += 1
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            print(f"FAIL {n}: values differ; cols={sorted(scols)}\n   spark: {diff_s}\n   duck : {diff_d}")
        else:
            print(f"OK   {n}: {len(srows)} rows{'' if exact else ' (equal after rounding)'} {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()

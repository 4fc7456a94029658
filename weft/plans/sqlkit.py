"""DuckDB-dialect text for the oracle side of the query checks.

These produce the *same numbers* as the Column builders in ``weft.functions.rand``
so that DuckDB can serve as an independent oracle for keyed randomness.
"""

from __future__ import annotations

import math

TWO_52 = "4503599627370496.0"
EPS_53 = repr(2.0**-53)


def key_sql(seed, tag: str, *keys: str) -> str:
    parts = [f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]
    return "concat_ws(':', " + ", ".join(parts) + ")"


def u_sql(seed, tag: str, *keys: str) -> str:
    return f"(CAST(('0x' || substr(sha256({key_sql(seed, tag, *keys)}), 1, 13)) AS BIGINT) / {TWO_52})"


def normal_sql(seed, tag, keys, mean=0.0, std=1.0) -> str:
    u1 = f"({u_sql(seed, tag + '#1', *keys)} + {EPS_53})"
    u2 = u_sql(seed, tag + "#2", *keys)
    return f"({float(mean)!r} + {float(std)!r} * (sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2})))"


def cdf_index_sql(u: str, cdf) -> str:
    arr = "[" + ", ".join(repr(float(c)) for c in cdf) + "]"
    return f"len(list_filter({arr}, lambda c: c <= {u}))"


def cumulative(weights):
    tot = float(sum(weights))
    out, acc = [], 0.0
    for w in weights[:-1]:
        acc += float(w) / tot
        out.append(acc)
    return out


def categorical_sql(seed, tag, keys, values, weights=None) -> str:
    weights = list(weights) if weights is not None else [1.0] * len(values)
    idx = cdf_index_sql(u_sql(seed, tag, *keys), cumulative(weights))
    vals = "[" + ", ".join(_lit(v) for v in values) + "]"
    return f"({vals})[{idx} + 1]"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def tables_sql(sf_dir: str, names) -> list[str]:
    return [f"CREATE OR REPLACE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')" for n in names]

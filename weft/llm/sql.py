"""DuckDB SQL of the operators' results."""

from __future__ import annotations

URL_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS MATERIALIZED (SELECT row_number() OVER () AS rn, page_id,
               CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rn, page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
fit AS (SELECT rn, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS v
        FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fit USING (rn)
"""

_DUP_LEVELS = {5: 15, 7: 13, 10: 10}


def _quality_sql() -> str:
    grams, covers, cols, bad = [], [], [], []
    for n in (3, *_DUP_LEVELS):
        later = "c > 1" if n == 3 else "nth > 1"
        what = "count(DISTINCT w.i)" if n == 3 else "sum(length(w.w))"
        grams.append(f"""g{n} AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c, row_number() OVER (PARTITION BY rn, g ORDER BY i) AS nth
  FROM (SELECT rn, unnest(range(1, len(ws) - {n - 2})) AS i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM d WHERE len(ws) >= {n}))""")
        covers.append(f"""c{n} AS (SELECT w.rn, {what} AS v FROM (SELECT DISTINCT rn, i + unnest(range(0, {n})) AS i FROM g{n} WHERE {later}) p
  JOIN w ON w.rn = p.rn AND w.i = p.i GROUP BY w.rn)""")
        if n != 3:
            cols.append(f"CAST(coalesce(c{n}.v, 0) AS BIGINT) AS dup_chars_{n}")
            bad.append(f"100 * dup_chars_{n} <= {_DUP_LEVELS[n]} * word_chars")
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.rn = d.rn" for n in (3, *_DUP_LEVELS))
    white = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{white}+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rn, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
l AS (SELECT rn, line, row_number() OVER (PARTITION BY rn, line) AS nth FROM
      (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ld AS (SELECT rn, count(*) AS n, sum(length(regexp_replace(line, '{white}', '', 'g'))) AS chars FROM l WHERE nth > 1 GROUP BY rn),
{', '.join(grams)}, {', '.join(covers)},
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{white}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ld.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.v, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(ld.chars, 0) AS BIGINT) AS dup_line_chars, {', '.join(cols)}
  FROM d LEFT JOIN ld ON ld.rn = d.rn {joins})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * dup_line_chars <= 20 * word_chars
  AND 100 * n_symbols <= 10 * word_chars AND {' AND '.join(bad)} AS kept FROM m
"""


QUALITY_SQL = _quality_sql()

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM l),
o AS (SELECT doc_id, i, line, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n WHERE nth > 1),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) OVER (PARTITION BY doc_id, run) AS words
      FROM o) WHERE words >= 5),
k AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone,
             coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS before
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_runs,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       md5(coalesce(kept, '')) AS kept_md5 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""


def _merkle_sql(leaf_levels: int = 24, group_levels: int = 10) -> str:
    """Level by level: enough for 2^24 rows a group and 2^10 groups."""

    def f(c):
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def levels(name, n):
        return [f"""{name}{k + 1} AS MATERIALIZED (SELECT grp, pos // 2 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h,
  (max(n) + 1) // 2 AS n FROM {name}{k} GROUP BY grp, pos // 2)""" for k in range(n)]

    def steps(name, level, n):
        return [f"""{name}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.pos // 2 AS pos, (p.n + 1) // 2 AS n, CASE WHEN p.n > 1 THEN p.sib || coalesce(s.h, '') ELSE p.sib END AS sib,
  CASE WHEN p.n = 1 THEN p.cur WHEN s.h IS NULL THEN sha256(p.cur) WHEN p.pos % 2 = 1 THEN sha256(s.h || p.cur) ELSE sha256(p.cur || s.h) END AS cur)
  FROM {name}{k} p LEFT JOIN {level}{k} s ON s.grp = p.grp AND s.pos = xor(p.pos, 1))""" for k in range(n)]

    head = " || ".join(f(c) for c in ("doc_id", "source", "lang"))
    crc = ("xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: "
           "list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")
    ctes = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS grp, sha256({head} || {f('n_chars')} || {f('text')}) AS leaf,
  sha256({head} || {f("(CASE WHEN " + crc + " % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} || {f('text')}) AS given FROM documents)""",
            """r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, given) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d)""",
            "a0 AS (SELECT grp, pos, leaf AS h, n FROM r)", *levels("a", leaf_levels),
            f"t0 AS MATERIALIZED (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, h, count(*) OVER () AS n, grp AS lang FROM a{leaf_levels})", *levels("t", group_levels),
            "p0 AS (SELECT doc_id, leaf, grp, pos, n, given AS cur, '' AS sib FROM r)", *steps("p", "a", leaf_levels),
            f"q0 AS (SELECT p.doc_id, p.leaf, t0.h AS subroot, t0.grp, t0.pos, t0.n, p.cur, p.sib FROM p{leaf_levels} p JOIN t0 ON t0.lang = p.grp)", *steps("q", "t", group_levels)]
    return f"""
WITH {', '.join(ctes)}
SELECT doc_id, leaf, subroot, (SELECT h FROM t{group_levels}) AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = (SELECT h FROM t{group_levels}) AS verified FROM q{group_levels}
"""


MERKLE_SQL = _merkle_sql()

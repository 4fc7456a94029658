"""Operator 6: URL filters.

Every URL is expanded into host-suffix and path-prefix expressions; these meet the rules in an
equi-join on a short hash prefix; the full digest and the rest of the path are then confirmed, and
the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import ASCII_LOWER, ASCII_UPPER, as_row

SHORT_HEX = 8  # 4 bytes of the SHA-256 digest


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; both empty for null or no ``://``. Only A-Z is lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    part = lambda k: F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), ASCII_UPPER, ASCII_LOWER), part(2)


def _directory(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) -> one row per (host, path); a rule stated both ways blocks; null or empty hosts are ignored."""
    r = rules.select(F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.where("host <> '' and verdict in ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    expr = F.concat("host", _directory(F.col("path")))
    return r.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
                    F.sha2(expr, 256).alias("r_digest"))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with added columns host, path, rule (null: none fits) and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest
    (host + path) wins, block before allow on a tie. Null URLs and URLs without ``://`` have an empty
    host, which no rule fits: they get ``default``. Repeated rows each keep their own row. Existing
    columns named host, path, rule or verdict are replaced. An empty rule table gives ``default``.

    Distinct (host, path) pairs are judged once (map-side combined, so a hot URL is one row per task)
    and joined back. Expressions deeper than the deepest rule cannot match and are not made; the two
    depths are the only figures read by the driver.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col("row")[url])
    own = as_row(pages).select("row", host.alias("host"), path.alias("path"))
    ready = prepare_rules(rules)
    labels, depth = ready.agg(F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)),
                              F.coalesce(F.max(F.length("r_path") - F.length(F.replace("r_path", F.lit("/")))), F.lit(0))).first()

    part, seg = F.split("host", r"\."), F.split("path", "/", depth + 2)
    n_host = F.least(F.size(part), F.lit(labels))
    hosts = F.when((F.col("host") != "") & (n_host > 0), F.transform(F.sequence(F.lit(1), F.greatest(n_host, F.lit(1))),
                   lambda i: F.array_join(F.slice(part, F.size(part) - i + 1, i), ".")))
    n_path = F.least(F.size(seg) - 1, F.lit(depth))
    paths = F.concat(F.array(F.lit("")), F.when(n_path > 0, F.transform(F.sequence(F.lit(1), F.greatest(n_path, F.lit(1))),
                     lambda i: F.concat(F.array_join(F.slice(seg, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    urls = own.select("host", "path").where("host <> ''").distinct()
    expr = urls.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", F.explode(F.transform(paths, lambda p: F.concat("h", p))).alias("expr"))
    hashed = expr.withColumn("digest", F.sha2("expr", 256))
    hit = hashed.join(ready, F.substring("digest", 1, SHORT_HEX) == F.substring("r_digest", 1, SHORT_HEX)).where(
        (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path")))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    out = own.join(best, ["host", "path"], "left")
    return out.select(*[F.col("row")[c].alias(c) for c in columns], "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.v"), F.lit(default)).alias("verdict"))

"""URL filter by host-suffix and path-prefix expressions, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest on which rows are joined: 32 bits, as short lists ship them.
PREFIX = 8


def url_parts(url):
    """(host, path) Columns. Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; path: from there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host, path):
    return F.sha2(F.concat_ws("\n", host, path), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and all subdomains when the path of the
    url starts with the rule's, which ends in ``/`` (or is empty); of several the longest host wins, then the
    longest path, then ``block``. No rule: ``rule`` is null and ``verdict`` is ``default``.

    Each distinct (host, path) expands to every host suffix times every path prefix that ends in ``/``, no deeper
    than the rules go. The expansions meet the rules on a short prefix of their digest; full digests and precedence
    settle the rest. Rules equal in host and path count once. Repeated urls keep all their rows; columns of the
    input that are named like the four new ones are replaced.
    """
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    deepest = rules.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.size(F.split("r_path", "/"))).alias("steps")
    ).first()
    labels, steps = deepest["labels"] or 1, deepest["steps"] or 1
    known = rules.withColumn("r_full", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.left("r_full", F.lit(PREFIX)))

    host, path = url_parts(F.col(url))
    keyed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    # Prefix k ends behind the k-th slash; the empty prefix fits every path.
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: k < F.size(F.split("path", "/"))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"), F.lit("/"))),
    )
    asked = keyed.select("host", "path").distinct()
    spread = asked.select("host", "path", F.explode(suffixes).alias("e_host")).select("host", "path", "e_host", F.explode(prefixes).alias("e_path"))
    spread = spread.withColumn("e_full", _digest(F.col("e_host"), F.col("e_path"))).withColumn("e_short", F.left("e_full", F.lit(PREFIX)))
    hits = spread.join(known, F.col("e_short") == F.col("r_short")).where(F.col("e_full") == F.col("r_full"))
    order = F.struct(F.length("r_host"), F.length("r_path"), F.col("r_verdict"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    return (
        keyed.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})
        .drop("best")
    )


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM p),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM q),
r(r_host, r_path, r_verdict) AS (VALUES ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
hit AS (SELECT u.page_id, arg_max({'rule': r_host || r_path, 'verdict': r_verdict}, (length(r_host), length(r_path))) AS best
        FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY u.page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (page_id)
"""

"""Mixing sources to target weights by hash-random prefixes, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Each source is cut into 2^14 hash ranges; rows are sorted within a range only.
RANGE_BITS = 14


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all sizes. No target
    exceeds ``most`` times its source's size; the excess goes to the others by weight until none is above. In closed
    form: with sources ordered by limit / weight, the first few stand at their limits and the rest share what is left.
    Only one row per source passes these windows, never documents.
    """
    w = F.array([F.lit(float(x)) for x in weights])
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("w", F.get(w, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = every.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    s = s.withColumns(
        {
            "before": F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
            "left": F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(every) * F.lit(float(share)),
        }
    )
    # Level of the water: what the sources at their limits leave, by weight; the first source that it doesn't fill sets it.
    level = F.greatest((F.col("all") - F.col("before")) / F.col("left"), F.lit(0.0))
    s = s.withColumn("level", F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), level.alias("v")))).over(every)["v"])
    return s.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))).select(
        "source", "source_size", "target"
    )


def place(docs: DataFrame, size: Column, seed: int = 17, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with a struct ``_mix``: size, source_size, target, epochs, part, taken.

    Every row gets a hash-random place in its source, md5 of (seed, key). Whole epochs of the source come first,
    ``epochs`` of them; the last one is cut where the running sum of sizes meets floor(target) - epochs * source_size,
    and ``part`` is what the row gives to it: all, nothing or, for the one row on the cut, its first words. So each
    source's ``taken`` adds up to exactly floor(target). Rows of size 0 take 0; null keys share one place and ties go
    by size, so reruns agree. A source may hold any share of all rows: sums are made by ranges of the hash before
    anything is shuffled, and rows are sorted within one range only. Columns named ``_mix*`` are replaced.
    """
    src = {"_mix_none": F.col(source).isNull(), "_mix_src": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    keyed = docs.withColumns({**src, "_mix_size": size.cast("long"), "_mix_place": place})
    keyed = keyed.withColumn("_mix_range", F.shiftright(F.conv(F.left("_mix_place", F.lit(4)), 16, 10).cast("int"), 16 - RANGE_BITS))
    by = ["_mix_none", "_mix_src"]
    ranges = keyed.groupBy(*by, "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum"))
    run = Window.partitionBy(*by).orderBy("_mix_range")
    ranges = ranges.withColumn("_mix_before", F.sum("_mix_sum").over(run) - F.col("_mix_sum")).drop("_mix_sum")
    sizes = keyed.groupBy(*by).agg(F.sum("_mix_size").alias("source_size"))
    t = source_targets(sizes.select(F.when(~F.col("_mix_none"), F.col("_mix_src")).alias("source"), "source_size"), **how)
    t = t.select(
        F.col("source").isNull().alias("_mix_none"), F.coalesce("source", F.lit("")).alias("_mix_src"),
        F.col("source_size").alias("_mix_all"), F.col("target").alias("_mix_target"),
        F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_mix_epochs"),
    )
    ranges = ranges.join(t, by)
    inside = Window.partitionBy(*by, "_mix_range").orderBy("_mix_place", key, "_mix_size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_mix_before") + F.sum("_mix_size").over(inside) - F.col("_mix_size")
    rest = F.floor("_mix_target") - F.col("_mix_epochs") * F.col("_mix_all")
    part = F.greatest(F.lit(0), F.least(F.col("_mix_size"), rest - start)).cast("long")
    out = keyed.join(ranges, [*by, "_mix_range"]).withColumn("_mix_part", part)
    fields = {"size": "_mix_size", "source_size": "_mix_all", "target": "_mix_target", "epochs": "_mix_epochs", "part": "_mix_part"}
    taken = (F.col("_mix_epochs") * F.col("_mix_size") + F.col("_mix_part")).alias("taken")
    return out.select(*docs.columns, F.struct(*[F.col(v).alias(k) for k, v in fields.items()], taken).alias("_mix"))


def mix_documents(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """``docs`` (same columns) as the mix: one row per epoch in which a document is taken, whole texts.

    The row on a cut comes whole if at least half of it fits, else not in that epoch. Documents without words take
    no room and come once. Empty input gives an empty frame.
    """
    t = place(docs, word_count(F.col("text")), seed, **how)
    last = F.when((F.col("_mix.part") > 0) & (F.col("_mix.part") * 2 >= F.col("_mix.size")), 1).otherwise(0)
    times = F.when(F.col("_mix.size") == 0, 1).otherwise(F.col("_mix.epochs") + last).cast("int")
    return t.withColumn("_mix", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('17:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM n),
f AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS UNBOUNDED PRECEDING) - cap AS before,
  sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft,
  sum(source_size) OVER () * 1.5::DOUBLE AS tot FROM c),
g AS (SELECT *, greatest((tot - before) / lft, 0.0::DOUBLE) AS v FROM f),
l AS (SELECT arg_min(v, cap / w) AS lev FROM g WHERE v * w <= cap),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN cap ELSE least(cap, lev * w) END AS target FROM f, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.epochs, floor(target)::BIGINT - epochs * source_size AS rest,
  (sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM r
"""

"""Ordered merge of near-parallel vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions import text as X
from pairmill.operators.graph import HOT_ROWS, HOT_SHARE, components, hot_lookup
from pairmill.session import cut_lineage, stored

#: Share of the older vector and of the newcomer in a merge.
OLD, NEW = 0.7, 0.3
#: Chance to overlook a pair of linked vectors; sign bits of a row's sketch; rows of a set that one task folds, and of a range.
MISS, SKETCH, FOLD_ROWS = 1e-8, 128, 4096
#: Leftovers of a bucket that are compared with one another; larger ones get another hub.
PAIR_ROWS = 8
#: Rows of a bucket whose sketches are compared with one another where they are sent, and pairs a row that may come of it.
LOCAL_ROWS, LOCAL_PAIRS = 256, 4
#: One row in so many is counted to find buckets of very many rows; steps of a coordinate on the way to the cosine.
COUNTED, STEPS = 16, 32767


def unit(c: str) -> Column:
    x = F.transform(F.col(c), lambda v: v.cast("double"))
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(n <= 1e-8, x).otherwise(F.transform(x, lambda v: v / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def clean_keywords(keywords: Column) -> Column:
    """Trimmed, lower-case, sorted; "vector" where none is left."""
    k = F.array_sort(F.array_distinct(F.filter(F.transform(keywords, lambda x: F.lower(X.strip(x))), lambda x: x != "")))
    return F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("vector")))


def merge_steps(cosine: float) -> int:
    """Merges after which what a vector was before is below the last bit of a double.

    A merge multiplies the older part by ``OLD`` and divides by the sum's length, which is least at the merge angle.
    """
    length = math.sqrt(OLD**2 + NEW**2 + 2 * OLD * NEW * cosine)
    return math.ceil(-60 * math.log(2) / math.log(OLD / length))


def link_angle(cosine: float) -> float:
    """Two rows can only meet in a merged vector over rows this close: the merge angle and how far a merge leads from its newcomer."""
    theta = math.acos(cosine)
    return theta + math.atan2(OLD * math.sin(theta), NEW + OLD * math.cos(theta))


def _signs(c: str, dim: int, bands: int, bits: int, seed: int = 7):
    """Sign bits of fixed random directions: one number per band, then the sketch as longs (Arrow batches)."""
    planes = np.random.default_rng(seed).standard_normal((dim, bands * bits + SKETCH)).astype("float32")

    @F.pandas_udf("array<long>")
    def signs(v: pd.Series) -> pd.Series:
        m = np.concatenate(v.to_list()).astype("float32").reshape(len(v), dim)
        s = m @ planes > 0
        band = (s[:, : bands * bits].reshape(len(m), bands, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        sketch = np.packbits(s[:, bands * bits :], axis=1).view(np.int64)
        return pd.Series(list(np.concatenate([band, sketch], axis=1)))

    return signs(F.col(c))


def _sketch_cut(angle: float) -> int:
    """Differing sketch bits of two vectors at ``angle`` or less, but for a chance of 1e-9 (six deviations)."""
    p = angle / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def _met_in_buckets(cut: int):
    """Rows sorted by (bucket, _id) -> pairs (_id, _hub) of a bucket that differ in at most ``cut`` sketch bits; the rows of
    a bucket of too many rows or pairs come out as they are (_hub null), for the hubs."""
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def met(t: pa.Table):
        h, s = t["bucket"].to_numpy(), [t[w].to_numpy().view(np.uint64) for w in words]  # counts of signed numbers are those of their size
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        at = np.repeat(np.arange(len(first)), size)
        # Rows of the same bucket that follow a row; none where the bucket is too large.
        behind = np.where(size[at] <= LOCAL_ROWS, first[at] + size[at] - 1 - np.arange(len(h)), 0)
        ones, two, step, left = [], [], 1, np.flatnonzero(behind > 0)
        while len(left):
            far = sum(np.bitwise_count(w[left] ^ w[left + step]).astype(np.int64) for w in s)
            ones.append(left[far <= cut])
            two.append(ones[-1] + step)
            step += 1
            left = left[behind[left] >= step]
        one, two = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (ones, two))
        crowded = (size > LOCAL_ROWS) | (np.bincount(at[one], minlength=len(first)) > LOCAL_PAIRS * size)
        keep = ~crowded[at[one]]
        ids, rest, names = t["_id"], t.filter(pa.array(crowded[at])), ["bucket", "_id", "_hub", *words]
        none = pa.nulls(int(keep.sum()), pa.int64())
        yield from pa.table([none, ids.take(pa.array(two[keep])), ids.take(pa.array(one[keep])), *[none] * len(words)], names=names).to_batches()
        yield from pa.table([rest["bucket"], rest["_id"], pa.nulls(len(rest), ids.type), *[rest[w] for w in words]], names=names).to_batches()

    def run(batches):
        tail = None  # the last bucket seen, whose rows may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([b])])
            if not len(t):
                continue
            h = t["bucket"].to_numpy()
            cut_at = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            tail = t.slice(cut_at)
            if cut_at:
                yield from met(t.slice(0, cut_at))
        if tail is not None:
            yield from met(tail)

    return run


def linked_sets(v: DataFrame, keys: Sequence[str], angle: float, dim: int) -> DataFrame:
    """(_id, comp) of the rows of ``v`` (keys, _id, _v) that have a neighbour: any two rows of equal keys within ``angle`` share their set.

    Buckets are bands of sign bits, so long that about eight rows of the largest key group meet in one by chance, and as many
    bands as ``MISS`` asks for. Rows travel once, as bucket, id and sketch; sketches are compared in the bucket, and only
    pairs that may be linked get their cosine. In buckets of too many rows or links the members meet a hub, the least
    row, and not one another: those within ``angle`` are done, as all their neighbours are within twice the angle of the hub,
    and what is that close joins the hub's set. So sets may be coarser than need be, never finer. The rest of such a bucket
    gets another hub, or is compared if few.
    """
    n, most = v.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    bits = min(62, max(8, math.ceil(math.log2(most or 1)) - 3))
    bands = math.ceil(math.log(MISS) / math.log1p(-((1 - angle / math.pi) ** bits)))
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def bucketed(v: DataFrame) -> DataFrame:
        s = v.select("_id", *keys, _signs("_v", dim, bands, bits).alias("_s"))
        sketch = [F.get("_s", F.lit(bands + k)).alias(w) for k, w in enumerate(words)]
        return s.select("_id", *keys, *sketch, F.posexplode(F.slice("_s", 1, bands)).alias("band", "bits")).select(F.xxhash64(*keys, "band", "bits").alias("bucket"), "_id", *words)

    far = sum((F.bit_count(F.col(f"me.{w}").bitwiseXOR(F.col(f"hub.{w}"))) for w in words), F.lit(0))
    # The cosine is taken of coordinates in whole steps of 1 / STEPS: at most this much off.
    slack = 2 * math.sqrt(dim) / STEPS
    vectors = v.select("_id", F.struct(*keys).alias("_k"), F.transform("_v", lambda x: F.round(x * STEPS).cast("short")).alias("_q"))

    def measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        """Distinct (_id, _hub) of equal keys with the cosine; vectors travel once per pair and hubs of very many rows not at all."""
        one = stored(pairs.join(vectors, "_id"), "pairs")
        two = hot_lookup(one, vectors.select(F.col("_id").alias("_hub"), F.col("_k").alias("_l"), F.col("_q").alias("_w")), "_hub")
        return two.filter(F.col("_k").eqNullSafe(F.col("_l"))).select("_id", "_hub", (dot(F.col("_q").cast("array<double>"), F.col("_w").cast("array<double>")) / STEPS**2).alias("cos"))

    def met(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Each row of a bucket next to its hub; buckets of very many rows meet it by broadcast."""
        total, most = hubs.agg(F.sum("n"), F.max("n")).first()
        limit = max(HOT_ROWS, total * HOT_SHARE)
        if most <= limit:
            return rows.join(hubs, "bucket")
        hot = hubs.filter(F.col("n") > limit)
        cold = rows.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(hubs, "bucket")
        return rows.join(F.broadcast(hot), "bucket").select(*cold.columns).unionByName(cold)

    # Buckets of very many rows are told by a part of the rows and not sent to one task; they have hubs at once.
    rows, hot = bucketed(v), None
    limit = max(HOT_ROWS, (n or 0) * bands * HOT_SHARE)
    if (n or 0) > limit / 2:
        part = bucketed(v.filter(F.pmod(F.xxhash64("_id"), F.lit(COUNTED)) == 0))
        many = cut_lineage(part.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") * COUNTED > limit / 2).select("bucket"))
        if not many.isEmpty():
            hot = rows.join(F.broadcast(many), "bucket", "left_semi")
            rows = rows.join(F.broadcast(many), "bucket", "left_anti")
    kind = v.select(F.col("_id"), F.col("_id").alias("_hub")).schema.fields
    schema = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(f.name, f.dataType) for f in kind), *(T.StructField(w, T.LongType()) for w in words)])
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "_id")
    local = stored(dealt.mapInArrow(_met_in_buckets(_sketch_cut(angle)), schema), "met")
    pairs = local.filter("_hub IS NOT NULL").select("_id", "_hub").distinct()
    edges = stored(measured(pairs, vectors).filter(F.col("cos") >= math.cos(angle) - slack).select(F.col("_hub").alias("u"), F.col("_id").alias("v")), "edges")
    crowded = local.filter("_hub IS NULL").select("bucket", "_id", *words)
    rows = (crowded if hot is None else crowded.unionByName(hot)).select("bucket", F.struct("_id", *words).alias("me"))
    rows = rows if hot is None else stored(rows, "crowded")
    # The rounds take the vectors of the rows in such buckets only, mostly a small part.
    some = stored(vectors.join(rows.select("me._id").distinct(), "_id", "left_semi"), "some") if not rows.isEmpty() else vectors
    while True:
        hubs = stored(rows.groupBy("bucket").agg(F.min("me").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
        if hubs.isEmpty():
            break
        both = met(rows, hubs).filter(F.col("me._id") != F.col("hub._id"))
        pairs = both.filter(far <= _sketch_cut(2 * angle)).select(F.col("me._id").alias("_id"), F.col("hub._id").alias("_hub")).distinct()
        seen = stored(measured(pairs, some), "seen")
        close = seen.filter(F.col("cos") >= math.cos(min(math.pi, 2 * angle)) - slack).select(F.col("_hub").alias("u"), F.col("_id").alias("v"))
        edges = edges.unionByName(close)
        done = seen.filter(F.col("cos") >= math.cos(angle) + slack).select(F.struct("_id", "_hub").alias("pair"))
        rest = both.withColumn("pair", F.struct(F.col("me._id").alias("_id"), F.col("hub._id").alias("_hub"))).join(done, "pair", "left_anti").select("bucket", "me")
        rest = stored(rest, "rest")
        size = rest.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        few = rest.join(size.filter(F.col("n") <= PAIR_ROWS), "bucket").drop("n")
        two = few.join(few.withColumnRenamed("me", "hub"), "bucket").filter((F.col("me._id") > F.col("hub._id")) & (far <= _sketch_cut(angle)))
        more = measured(two.select(F.col("me._id").alias("_id"), F.col("hub._id").alias("_hub")).distinct(), some)
        edges = edges.unionByName(stored(more.filter(F.col("cos") >= math.cos(angle) - slack).select(F.col("_hub").alias("u"), F.col("_id").alias("v")), "edges"))
        rows = stored(rest.join(size.filter(F.col("n") > PAIR_ROWS), "bucket", "left_semi"), "crowded")
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return v.select("_id", F.col("_id").alias("comp")).limit(0)
    return components(edges.select(F.explode(F.array("u", "v")).alias("_id")).distinct(), edges, "_id")


def _norm(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x if n <= 1e-8 else x / n


class Merged:
    """Kept vectors of one set, in the order in which they came."""

    def __init__(self, dim: int, cosine: float):
        self.vectors, self.cosine, self.records = np.zeros((8, dim)), cosine, []

    def add(self, row, x: np.ndarray) -> None:
        n = len(self.records)
        if n:
            cos = self.vectors[:n] @ x
            best = int(cos.argmax())
            if cos[best] >= self.cosine:
                self.vectors[best] = _norm(OLD * self.vectors[best] + NEW * x)
                r = self.records[best]
                r["_sc"], r["members"] = max(r["_sc"], row["_sc"]), r["members"] + 1
                r["_kw"].update(row["_kw"])
                return
        if n == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[n] = x
        self.records.append({**row, "_kw": set(row["_kw"]), "members": 1})


def _fold(dim: int, cosine: float, names: list[str]):
    """Sets one after the other as their rows stream by; only the kept vectors of the present set are in memory."""

    def run(frames):
        comp, state = None, None
        out: list[dict] = []

        def ended():
            return [{**r, "_kw": sorted(r["_kw"]), "_v": state.vectors[k].tolist()} for k, r in enumerate(state.records)] if state else []

        for f in frames:
            for row in f.to_dict("records"):
                if state is None or row["comp"] != comp:
                    out += ended()
                    comp, state = row["comp"], Merged(dim, cosine)
                state.add(row, np.asarray(row["_v"], dtype=np.float64))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out + ended(), columns=names)

    return run


def _one_vector(cosine: float):
    """Whether every row of a range joins the one vector that the rows before it make, and that vector at the end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        ok, acc = True, None
        for x, before in zip(pdf["_v"], pdf["_before"], strict=True):
            x = np.asarray(x, dtype=np.float64)
            if acc is not None:
                ok = ok and (before or float(acc @ x) >= cosine)
                x = _norm(OLD * acc + NEW * x)
            acc = x
        return pd.DataFrame([(pdf["comp"].iloc[0], ok, int(pdf["_r"].iloc[-1]), acc.tolist())], columns=["comp", "ok", "_r", "_v"])

    return run


def one_vector_sets(rows: DataFrame, cosine: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(comp, ok, _v): whether a set stays one vector from its first row to the last, however many rows it has, and that vector.

    The vector before a row depends on the last ``merge_steps`` rows only, to the last bit. So a set is cut into ranges of
    its order, each with that many rows ahead of it, and checked range by range; if all rows of all ranges join, that is
    what the sequential merge does, by induction. Ranks come from ranges of the order and their counts.
    """
    spark = rows.sparkSession
    kind = rows.schema["comp"].dataType
    steps = merge_steps(cosine)
    span = max(fold_rows, steps + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = stored(rows.select("comp", "_o", "_id", "_v").repartitionByRange(parts, "comp", "_o", "_id").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = d.groupBy("comp", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("comp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("comp", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("comp", "_part").orderBy("_o", "_id")) + F.col("_start") - 1
    d = d.join(sums, ["comp", "_part"]).withColumn("_r", place).withColumn("_range", F.floor(F.col("_r") / span))
    ahead = F.col("_r") % span >= span - steps
    copies = F.when(ahead, F.array(F.struct(F.col("_range").alias("g"), F.lit(False).alias("b")), F.struct((F.col("_range") + 1).alias("g"), F.lit(True).alias("b")))).otherwise(
        F.array(F.struct(F.col("_range").alias("g"), F.lit(False).alias("b"))))
    d = d.withColumn("_c", F.explode(copies)).select("comp", F.col("_c.g").alias("_g"), F.col("_c.b").alias("_before"), "_r", "_v")
    schema = T.StructType([T.StructField("comp", kind), *T.StructType.fromDDL("ok boolean, _r long, _v array<double>").fields])
    checked = d.groupBy("comp", "_g").applyInPandas(_one_vector(cosine), schema)
    return checked.groupBy("comp").agg(F.min("ok").alias("ok"), F.max(F.struct("_r", "_v")).alias("m")).select("comp", "ok", F.col("m._v").alias("_v"))


def vector_merge(df: DataFrame, vid: str, groups: Sequence[str], order: str, vector: str, keywords: str, score: str,
                 cosine: float = 0.985, dim: int = 64, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Ordered merge of near-parallel vectors of equal ``groups`` (kind and layer; text is trimmed and lower-case there).

    A row joins the closest kept vector at ``cosine`` or more (kept = norm(0.7 old + 0.3 new), best score, keyword union),
    else it is inserted; ``vid`` is unique and decides ties of ``order``. Rows are split into sets that cannot influence one
    another, and each set is folded in order on its own, with the result of one sequential pass. Rows without a neighbour
    are results as they are. Sets of up to ``fold_rows`` rows are folded by the task they are sent to. Larger sets are
    checked range by range whether they stay one vector, as groups of copies do; only those that don't are streamed in
    order through one task, which holds their kept vectors and never their rows.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    keys = [f"_g{k}" for k in range(len(groups))]
    named = [(F.lower(X.strip(g)) if g in text else F.col(g)).alias(k) for g, k in zip(groups, keys, strict=True)]
    v = stored(df.select(F.col(vid).alias("_id"), *named, F.col(order).alias("_o"), unit(vector).alias("_v"), clean_keywords(F.col(keywords)).alias("_kw"),
                         F.col(score).cast("double").alias("_sc")), "vectors")
    sets = cut_lineage(linked_sets(v, keys, link_angle(cosine), dim))
    sizes = sets.groupBy("comp").agg(F.count("*").alias("_size"))
    sets = stored(hot_lookup(sets, sizes, "comp"), "sets")
    out = [*keys, "_id", "_sc", "_kw", "members", "_v"]
    large = not sets.filter(F.col("_size") > fold_rows).isEmpty()
    told = v.join(sets, "_id", "left")
    told = stored(told, "told") if large else told
    alone = told.filter("comp IS NULL").withColumn("members", F.lit(1).cast("long")).select(*out)
    schema = T.StructType([*v.select(*keys).schema.fields, v.schema["_id"], *T.StructType.fromDDL("_sc double, _kw array<string>, members long, _v array<double>").fields])

    def streamed(rows: DataFrame) -> DataFrame:
        d = rows.select(*keys, "comp", "_id", "_o", "_v", "_kw", "_sc").repartition("comp").sortWithinPartitions("comp", "_o", "_id")
        return d.mapInPandas(_fold(dim, cosine, out), schema)

    merged = alone.unionByName(streamed(told.filter(F.col("_size") <= fold_rows)))
    if large:
        rows = told.filter(F.col("_size") > fold_rows)
        checked = stored(one_vector_sets(rows, cosine, fold_rows), "checked-sets")
        rows = stored(hot_lookup(rows, checked.select("comp", "ok"), "comp"), "told-sets")
        mine, whole = rows.filter("ok"), checked.filter("ok").select("comp", "_v")
        words = mine.select("comp", F.explode("_kw").alias("k")).distinct().groupBy("comp").agg(F.array_sort(F.collect_list("k")).alias("_kw"))
        facts = mine.groupBy("comp").agg(*[F.first(k).alias(k) for k in keys], F.min(F.struct("_o", "_id"))["_id"].alias("_id"), F.max("_sc").alias("_sc"), F.count("*").alias("members"))
        merged = merged.unionByName(facts.join(words, "comp").join(whole, "comp").select(*out)).unionByName(streamed(rows.filter(~F.col("ok"))))
    return merged.select(F.col("_id").alias(vid), *[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], F.col("_sc").alias(score), F.col("_kw").alias(keywords),
                         "members", F.col("_v").alias(vector))

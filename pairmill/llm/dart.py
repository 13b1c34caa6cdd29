"""MinHash near-duplicates by hashed darts over weighted shingles, banded joins and exact weighted Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.llm.common import Words, bites, list_array, mix, stored

SHINGLE, LEAST = 5, 0.8
#: Coordinates of a signature; 16 bands of 4 meet with probability 0.9998 at a similarity of 0.8.
BANDS, BAND_ROWS = 16, 4
COORDS = BANDS * BAND_ROWS
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def weighted_shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of the distinct shingles of each row, rows in order."""
    g, ptr = w.grams(SHINGLE)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], g[at], np.diff(np.append(at, len(g)))


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = COORDS) -> np.ndarray:
    """(rows, k) array of dart ids: per coordinate the earliest dart that hits the row's weighted set.

    The strip of an element is cut into the weight slices [0, 1), [1, 2), [2, 4), ...; in each, darts form a Poisson process in
    time whose gaps, weight positions and coordinates are hashes of (element, slice, number), so that every row sees
    the same darts. A dart hits where its weight position lies below the element's weight. Two rows agree in a coordinate with
    the probability of their weighted Jaccard similarity. Time runs to (k ln k + 2k) / total weight; rows with a
    coordinate that is still empty run twice as long, until none is. Rows without elements stay 0.
    """
    out = np.zeros((rows, k), dtype=np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    todo, reach = total > 0, k * np.log(k) + 2 * k
    while todo.any():
        live = todo[row]
        r, e, x = row[live], element[live], weight[live].astype(np.float64)
        until = reach / total[r]
        cells, times, ids = [], [], []
        low, width, n = 0.0, 1.0, 0
        while len(r):
            with np.errstate(over="ignore"):
                key = mix(e + _A * np.uint64(n + 1))
            at, d, idx = np.zeros(len(r)), 0, np.arange(len(r))
            while len(idx):
                d += 1
                with np.errstate(over="ignore"):
                    h = mix(key[idx] + _B * np.uint64(d))
                at = at - np.log(_unit(h)) / width
                stay = at < until[idx]
                idx, at, h = idx[stay], at[stay], h[stay]
                hit = low + width * _unit(mix(h ^ _C)) <= x[idx]
                dart = mix(h ^ _A)[hit]
                cells.append(r[idx[hit]] * k + (dart % np.uint64(k)).astype(np.int64))
                times.append(at[hit])
                ids.append(dart)
            low, width, n = low + width, max(1.0, low + width), n + 1
            more = x > low
            r, e, x, until = r[more], e[more], x[more], until[more]
        cell, time, ident = np.concatenate(cells), np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((time, cell))
        cell, ident = cell[order], ident[order]
        first = np.ones(len(cell), dtype=bool)
        first[1:] = cell[1:] != cell[:-1]
        flat = out.reshape(-1)
        flat[cell[first]] = ident[first]
        todo &= np.bincount(cell[first] // k, minlength=rows) < k
        reach *= 2
    return out


def _signature_batches(batches):
    for b in bites(batches):
        w = Words(b.column(1))
        n = b.num_rows
        row, g, c = weighted_shingles(w)
        sig = dart_signatures(row, g, c, n)
        with np.errstate(over="ignore"):
            keys = np.zeros((n, BANDS), dtype=np.uint64)
            for k in range(BAND_ROWS):
                keys = keys * _A + sig[:, k::BAND_ROWS]
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[None, :] * _B)
            some = np.diff(w.ptr) > 0
            total = [np.zeros(n, dtype=np.uint64) for _ in range(2)]
            for t, m in zip(total, (_A, _C), strict=True):
                np.add.at(t, row, mix(g * m + c.astype(np.uint64)))
        ptr = np.concatenate([[0], np.cumsum(some * BANDS)])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(total[0].view(np.int64)), pa.array(total[1].view(np.int64)), pa.array(np.diff(w.ptr)), list_array(keys[some].reshape(-1).view(np.int64), ptr, pa.int64())],
            ["id", "key", "h1", "h2", "n", "bands"],
        )


def elements(g: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counted shingles of each row as a sorted set of 32-bit numbers, one per (shingle, occurrence), and the row pointer."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(g)) - first[np.cumsum(new) - 1]
    with np.errstate(over="ignore"):
        e = mix(g + _A * nth.astype(np.uint64)) >> np.uint64(32)
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | e)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(len(ptr), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two element sets, that is the weighted Jaccard of the counted shingles. Two empty ones: 1."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - same
    return same / either if either else 1.0


#: Roles of the keys under which members of a hub meet.
EXTRA, FAR, SHRUNK = 0, 1, 2


def hub_keys(a: np.ndarray, hub: np.ndarray, linked: bool) -> list[tuple[int, np.ndarray]]:
    """(role, elements): keys under which ``a`` meets every b with jaccard(a, b) >= 0.8 where a or b is not linked with the hub.

    Let D be the elements of a that the hub h lacks, and M those of h that a lacks. Similarity needs |a & b| >= 0.8 |a|, of which
    h can give |h| - |Ma|, so Da and Db share at least s = 0.8 |Da| - 0.2 (|h| - |Ma|) elements, and one of their first |D| - s + 1 in
    any fixed order (role EXTRA; the caller takes the rarest, as what many texts share beside the hub is no sign). If s is not
    positive, they may share none; then |a & b| = |h| - |Ma | Mb|, and similarity needs
    0.2 |h| + 1.8 |Ma & Mb| >= |Ma| + |Mb| + 0.8 (|Da| + |Db|). If a is not linked, |Ma| + 0.8 |Da| > 0.2 |h|, from which follows
    that |Mb| > |Db|, and that |Ma & Mb| >= t = (|Ma| + 0.8 |Da| - 0.2 |h|) / 0.8. So a, with role FAR, meets b, with role SHRUNK, under one of
    the first |Ma| - t + 1 elements of Ma. Independent edits of one text share no extra elements, and those that keep
    its length are not shrunk: they do not meet.
    """
    own, lacking = np.setdiff1d(a, hub, assume_unique=True), np.setdiff1d(hub, a, assume_unique=True)
    out = [(EXTRA, own)]
    if not linked:
        least = max(1, int(np.ceil((len(lacking) + 0.8 * len(own) - 0.2 * len(hub)) / 0.8 - 1e-9)))
        if least <= len(lacking):
            out.append((FAR, lacking[: len(lacking) - least + 1]))
    if len(lacking) > len(own):
        out.append((SHRUNK, lacking))
    return out


def may_be_similar(role, h, ma, da, mb, db):
    """Column: what the sizes of D and M still allow of two members of a hub of size ``h``; without a shared extra element, the bound of ``hub_keys``."""
    apart = F.abs((ma + da) - (mb + db)) * 9 <= h * 2 - ma + da - mb + db
    alone = h * 0.2 + F.least(ma, mb) * 0.8 >= F.greatest(ma, mb) + (da + db) * 0.8 - 1e-6
    return F.when(role == EXTRA, apart).otherwise(alone)


def _schema(docs: DataFrame, key: str, *fields, name: str = "id") -> T.StructType:
    return T.StructType([T.StructField(name, docs.schema[key].dataType), *fields])


#: A Bloom filter of ids has 2^16 to 2^28 bits (32 MB), 16 for each id while that is enough.
BLOOM = (16, 28)


def _sets_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, set) of the texts with these ids, and of a few others; written out.

    A Bloom filter of bounded size lets the tasks that read texts pass over those that cannot be meant, so that texts are not shuffled.
    """
    place = lambda c, k: F.xxhash64(c, F.lit(k))
    bits = min(BLOOM[1], max(BLOOM[0], (16 * ids.count()).bit_length()))
    spots = ids.select(F.explode(F.array(*[place(F.col("id"), k) for k in range(2)])).alias("h")).select(F.expr(f"h & {(1 << bits) - 1}L").alias("at"))
    words = spots.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    bloom = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bloom[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def sets(batches):
        for b in bites(batches):
            hit = np.ones(b.num_rows, dtype=bool)
            for k in (2, 3):
                at = b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits) - 1)
                hit &= (held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            b = b.filter(pa.array(hit, pa.bool_()))
            e, ptr = elements(*Words(b.column(1)).grams(SHINGLE))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(e.view(np.int32), ptr, pa.int32())], ["id", "set"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), text, *[place(F.col(key), k).alias(f"h{k}") for k in range(2)])
    return stored(rows.mapInArrow(sets, _schema(docs, key, T.StructField("set", T.ArrayType(T.IntegerType())))), "sets")


def _slices(batches, rows: int = 500):
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)


def _compared(pairs: DataFrame, sets: DataFrame, key_type, keys: bool) -> DataFrame:
    """Pairs (a, b) with ``linked``; with ``keys``, b is a hub, and |h|, |M|, |D| and the keys of a as (role, element) are added."""
    entry = T.StructType([T.StructField("role", T.IntegerType()), T.StructField("element", T.IntegerType())])
    counts = [T.StructField(c, T.IntegerType()) for c in ("h", "m", "d")]
    fields = [T.StructField("a", key_type), T.StructField("b", key_type), T.StructField("linked", T.BooleanType()), *counts, T.StructField("keys", T.ArrayType(entry))]

    def compare(batches):
        for b in _slices(batches):
            linked, sizes, ends, roles, found = [], [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (v.values.to_numpy().view(np.uint32) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(same >= LEAST * (len(x) + len(y) - same))
                sizes.append((len(y), len(y) - same, len(x) - same))
                own = hub_keys(x, y, linked[-1]) if keys else []
                roles += [np.full(len(e), role, np.int32) for role, e in own]
                found += [e for _, e in own]
                ends.append(ends[-1] + sum(len(e) for _, e in own))
            entries = pa.StructArray.from_arrays([pa.array(np.concatenate(roles)), pa.array(np.concatenate(found).view(np.int32))], ["role", "element"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            three = [pa.array(c, pa.int32()) for c in (zip(*sizes, strict=True) if sizes else ([], [], []))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_()), *three, lists], [f.name for f in fields])

    unique = sets.dropDuplicates(["id"])
    both = pairs.join(unique.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(unique.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    return stored(both.select("a", "b", "sa", "sb").mapInArrow(compare, T.StructType(fields)), "compared")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): the least id that it is linked with.

    Each round every node takes the least label of its neighbours, then its label's label; rounds are written out
    and end when no label changes.
    """
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("root")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, F.col("id") == F.col("a")).select("id", "root", F.least("root", "near").alias("next"))
        jump = step.select(F.col("id").alias("j"), F.col("next").alias("jump"))
        new = stored(step.join(jump, F.col("next") == F.col("j"), "left").select("id", F.least("next", "jump").alias("root"), (F.least("next", "jump") != F.col("root")).alias("moved")), "labels")
        label = new.select("id", "root")
        if new.where("moved").isEmpty():
            return label


def _row_id(key: str, text: str):
    """One id per key and text: rows that repeat a key with other texts are told apart, copies under other keys too."""
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``class_id``) for every row of ``docs``: documents linked by a similarity of at least 0.8 share a class,
    named by its least key.

    Similarity is the weighted Jaccard of counted five-word shingles (words split at white space, A-Z in lower case; a
    text of fewer words is one shingle). Texts of equal shingles collapse first, so copies cost nothing further. Band
    buckets of the others are not expanded into pairs: every member meets the bucket's hub, its most crowded member,
    the exact similarity decides, and linked texts become components. Members of different components that share a
    hub then meet under keys made of their differences to a centre that the hub is linked with (``hub_keys``), which loses no
    link and keeps independent edits of one text apart. Null texts count as empty, and all texts without words form one class. Null
    keys get a null class. Rows are told apart by key and text, so rows that repeat a key with different texts have the classes of
    their texts, whatever the partitions; an empty frame gives an empty one.
    """
    return _classes(docs, key, text).select(F.col("key").alias(key), F.when(F.col("key").isNotNull(), F.col("class_id")).alias("class_id"))


def _classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, root, class_id) for every row: its own id, the least id of its class and the least key."""
    kind = T.LongType()
    docs = rows.select(_row_id(key, text).alias("id"), F.col(text).alias("text"), F.col(key).alias("key"))
    fields = [T.StructField(c, T.LongType()) for c in ("h1", "h2", "n")] + [T.StructField("bands", T.ArrayType(T.LongType()))]
    sig = stored(docs.mapInArrow(_signature_batches, T.StructType([docs.schema["id"], docs.schema["key"], *fields])), "signatures")
    same = stored(sig.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min("key").alias("least")), "copies")
    reps = sig.join(same.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    bands = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    members = bands.groupBy("band", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    crowded = stored(bands.join(members, ["band", "bucket"]), "bands")
    crowd = stored(crowded.groupBy("id").agg(F.sum("members").alias("crowd")), "crowd")
    order = F.struct(F.col("crowd"), F.xxhash64("id"))
    hubs = crowded.join(crowd, "id").groupBy("band", "bucket").agg(F.max_by("id", order).alias("hub"))
    pairs = crowded.join(hubs, ["band", "bucket"]).where(F.col("id") != F.col("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = stored(pairs, "pairs")
    sets = _sets_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "text")
    links = _compared(pairs, sets, kind, keys=False).where("linked").select("a", "b")
    root = components(links)

    # Members of a hub are held against its centre, the most crowded hub that it is linked with, so that few centres serve all.
    known = pairs.select(F.col("b").alias("id")).distinct().join(root, "id", "left").select("id", F.coalesce("root", "id").alias("own"))
    near = known.select("id", F.col("id").alias("c")).union(links.select(F.col("a").alias("id"), F.col("b").alias("c")))
    crowds = crowd.select(F.col("id").alias("c"), F.struct(F.col("crowd"), F.xxhash64("id")).alias("order"))
    centre = near.join(crowds, "c").groupBy("id").agg(F.max_by("c", "order").alias("c"))
    of_hub = known.join(centre, "id").select(F.col("id").alias("b"), "own", "c")
    member = pairs.join(of_hub, "b").select("a", "c", "own").distinct().join(root.withColumnRenamed("id", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    mixed = member.groupBy("c").agg(F.max((F.col("root") != F.col("own")).cast("int")).alias("mixed")).where("mixed = 1").select("c")
    group = stored(member.join(mixed, "c", "left_semi").where("a <> c").select("a", F.col("c").alias("b")), "members")
    if not group.isEmpty():
        root, links = _rest(group, links, root, sets, kind)
    named = stored(same.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("root"), "least"), "classes")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return sig.select("key", "id", "h1", "h2", "n").join(named.join(least, "root").drop("least"), ["h1", "h2", "n"]).select("key", "id", "root", "class_id")


def _recentred(near: DataFrame, sets: DataFrame, key_type) -> DataFrame:
    """``near``, compared with a better centre where there is one.

    Elements that more than half of a centre's members have and it lacks say that the centre itself is edited. Then the member
    that has most of these and least else takes its place; an unedited text, if the group has one, has all of them and nothing else.
    """
    extra = near.select("a", "b", F.explode("keys").alias("k")).where(F.col("k.role") == EXTRA).select("a", "b", F.col("k.element").alias("element"))
    often = extra.groupBy("b", "element").agg(F.count("*").alias("n")).join(near.groupBy("b").agg(F.count("*").alias("all")), "b").where("2 * n > all").select("b", "element")
    hits = extra.join(often, ["b", "element"]).groupBy("a", "b").agg(F.count("*").alias("hits"))
    gain = hits.join(near.select("a", "b", "d"), ["a", "b"]).select("a", "b", (2 * F.col("hits") - F.col("d")).alias("gain")).where("gain > 0")
    better = stored(gain.groupBy("b").agg(F.max_by("a", F.struct("gain", F.xxhash64("a"))).alias("c")), "centres")
    if better.isEmpty():
        return near
    moved = near.select("a", "b").join(better, "b").select("a", F.col("c").alias("b")).union(better.select("b", "c")).where("a <> b").distinct()
    return near.join(better.select("b"), "b", "left_anti").select(*near.columns).union(_compared(moved, sets, key_type, keys=True).select(*near.columns))


def _rest(group: DataFrame, links: DataFrame, root: DataFrame, sets: DataFrame, key_type) -> tuple[DataFrame, DataFrame]:
    """(components, links) with the links between members (a, b: a and its centre) that the hubs alone have not shown."""
    near = stored(_recentred(_compared(group, sets, key_type, keys=True), sets, key_type), "near")
    links = links.union(near.where("linked").select("a", "b"))
    root = components(links)
    at = near.join(root.withColumnRenamed("id", "a"), "a", "left").select("a", "b", "h", "m", "d", F.coalesce("root", "a").alias("root"), "keys")
    keyed = at.select("a", "b", "h", "m", "d", "root", F.explode("keys").alias("k"))
    keyed = keyed.select("a", "b", "root", "h", "m", "d", F.col("k.role").alias("role"), F.xxhash64("b", "k.element", F.col("k.role") == EXTRA).alias("k"))
    keyed = stored(keyed, "all-keys")
    # Of the elements that a hub lacks, the rarest |D| - s + 1.
    often = keyed.where(F.col("role") == EXTRA).groupBy("k").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("n", "k"))
    must = F.greatest(F.lit(1), F.ceil(F.col("d") * 0.8 - (F.col("h") - F.col("m")) * 0.2 - 1e-9))
    extra = keyed.where(F.col("role") == EXTRA).join(often, "k").withColumn("rank", rank).where((F.col("rank") <= F.col("d") - must + 1) & (F.col("n") > 1))
    names = ["a", "root", "h", "m", "d", "role", "k"]
    keyed = extra.select(*names).union(keyed.where(F.col("role") != EXTRA).select(*names))
    keyed = stored(keyed, "keys")
    # Only keys under which different components meet, and, of elements that the hub alone has, both roles.
    shared = keyed.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("role").alias("p0"), F.max("role").alias("p1"))
    shared = shared.where(f"r0 <> r1 AND (p0 = {EXTRA} OR p0 <> p1)").select("k")
    keyed = keyed.join(shared, "k", "left_semi")
    other = keyed.where(F.col("role") != FAR).withColumnsRenamed({"a": "b", "root": "rb", "m": "mb", "d": "db", "role": "role_b", "h": "hb"})
    fits = may_be_similar(F.col("role"), F.col("h"), F.col("m"), F.col("d"), F.col("mb"), F.col("db"))
    meet = (F.col("root") != F.col("rb")) & ((F.col("role") == FAR) | ((F.col("role") == EXTRA) & (F.col("a") < F.col("b"))))
    cross = keyed.where(F.col("role") != SHRUNK).join(other, "k").where(meet & fits)
    cross = stored(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cross")
    if not cross.isEmpty():
        more = _compared(cross, sets, key_type, keys=False).where("linked").select("a", "b")
        if not more.isEmpty():
            links = links.union(more)
            root = components(links)
    return root, links


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (same columns) without all but one document of each class: the one with the least key.

    Rows that repeat its key and text are dropped too; of rows that repeat its key with different texts of the class, one stays.
    Rows whose key is null are kept, as nothing names them. The result does not depend on the partitions.
    """
    first = _classes(docs, key, text).where(F.col("key").isNotNull()).groupBy("root").agg(F.min(F.struct("key", "id")).alias("first"))
    kept = first.select(F.col("first.id").alias("_dart_id"))
    named = docs.where(F.col(key).isNotNull()).withColumn("_dart_id", _row_id(key, text)).join(kept, "_dart_id", "left_semi").dropDuplicates(["_dart_id"])
    return named.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))

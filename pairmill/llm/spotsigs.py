"""SpotSigs fingerprints: chains of content words behind common words; sets compared by pruned Jaccard."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.common import Words, bites, mix, stored

#: Common words that start a chain (articles and forms of "to be" in English, German, French, Spanish).
ANCHORS = "the a an is are was were der die das ein eine ist war le la les un une est el los las una es son".split()
#: Content words of a chain.
CHAIN = 2
#: The first words of a text all start chains, so that short texts have some.
LEAD = 24
_M = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]


def spot_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 32-bit spots of each text: an anchor with the next two content words (fewer at the end)."""
    known = np.sort(Words(pa.array([" ".join(ANCHORS)]), letters=True).hash)
    w = Words(texts, letters=True)
    n = len(w.ptr) - 1
    common = known[np.minimum(np.searchsorted(known, w.hash), len(known) - 1)] == w.hash
    row = w.rows
    start = np.flatnonzero(common | (np.arange(len(row)) - w.ptr[row] < LEAD))
    content = np.flatnonzero(~common)
    at = np.searchsorted(content, start, side="right")
    end, padded = w.ptr[row[start] + 1], np.append(content, np.full(CHAIN, len(row) + 1))
    with np.errstate(over="ignore"):
        spot = w.hash[start] * _M[0]
        for k in range(CHAIN):
            word = padded[at + k]
            inside = word < end
            spot = mix(spot + np.where(inside, w.hash[np.where(inside, word, 0)], np.uint64(0)) * _M[k + 1]) if len(row) else spot
    key = np.unique((row[start].astype(np.uint64) << np.uint64(32)) | (spot >> np.uint64(32)))
    cuts = np.searchsorted(key >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
    spots = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [spots[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def fingerprint(spots: np.ndarray) -> str:
    """The sorted spots, four bytes each, in base 64; empty for a text without words."""
    return base64.b64encode(spots.tobytes()).decode()


def spots_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u4")


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without a look at the members when their sizes alone rule out ``least``. Two empty sets: 1."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (small + large - same)


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter of code points is replaced by the first as many (or all) of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str]) -> dict:
    """Result columns of texts whose next documents are ``following``."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, new = spot_sets(pa.array(texts, pa.string())), spot_sets(pa.array(changed, pa.string()))
    # The next document of a row is most often the next row; only other texts are read again.
    other = [own[k + 1] if k + 1 < len(texts) and following[k] is texts[k + 1] else spot_sets(pa.array([f], pa.string()))[0] for k, f in enumerate(following)]
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed],
        "fingerprint": [fingerprint(s) for s in own], "edited_fingerprint": [fingerprint(s) for s in new],
        "near_edited": [pruned_jaccard(a, b) for a, b in zip(own, new, strict=True)], "near_next": [pruned_jaccard(a, b) for a, b in zip(own, other, strict=True)],
    }


def _sequence(batches):
    """Results of all rows of a sorted partition but its last; its first and last texts come as open ends."""
    names = [*_RESULT.names, "part", "is_first", "is_last", "open_text"]
    kinds = [*_RESULT.types, pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    part, first, last = TaskContext.get().partitionId(), None, None
    for b in bites(batches, size=1 << 20):
        if not b.num_rows:
            continue
        ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        first = first or (ids[0], texts[0])
        if last is not None:
            ids, texts = [last[0], *ids], [last[1], *texts]
        last = (ids[-1], texts[-1])
        if len(ids) > 1:
            cols = _rows(ids[:-1], texts[:-1], texts[1:])
            n = len(ids) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols.values(), [part] * n, [False] * n, [False] * n, [None] * n], kinds, strict=True)], names)
    for is_first, end in ((True, first), (False, last)):
        if end is not None:
            row = [end[0], *[None] * 6, part, is_first, not is_first, end[1]]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names)


def _ends(batches):
    for b in batches:
        for r in b.to_pylist():
            cols = _rows([r["doc_id"]], [r["open_text"]], [r["next_text"]])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols.values(), _RESULT.types, strict=True)], _RESULT.names)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next key in ascending order, after the last the first; nulls stand first, rows that repeat a
    key in the order of their texts, and a single row follows itself. Null texts are empty. Texts are dealt out by ranges of the key once and
    read in order, so that every document meets its next one in the same task; at the seams, one document of each
    range meets the first of the next range in a second small join.
    """
    ranged = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    all_ = stored(ranged.mapInArrow(_sequence, f"{_SQL}, part int, is_first boolean, is_last boolean, open_text string"), "spots")
    order = Window.orderBy("part")
    seams = all_.where("is_first").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    heads = all_.where("is_first").select(F.col("part").alias("next_part"), F.col("open_text").alias("next_text"))
    ends = all_.where("is_last").join(seams, "part").join(heads, "next_part").select("doc_id", "open_text", "next_text").mapInArrow(_ends, _SQL)
    return all_.where("NOT is_first AND NOT is_last").select(*_RESULT.names).union(ends)


def similar_pairs(prints: DataFrame, least: float = 0.8, key: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """(a, b, jaccard) of representatives with different fingerprints and a Jaccard of at least ``least``; the representative of equal
    fingerprints is their least key.

    Sets are parted by length class (powers of 1 / least): only equal and adjacent classes can meet. Within these, each set enters
    under its first (1 - least) n + 1 spots by rarity, one of which two similar sets must share.
    """
    sets = prints.where(F.col(column) != "").groupBy(column).agg(F.min(key).alias("id"))

    def open_(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([spots_of(x).astype(np.int64) for x in b.column(0).to_pylist()], pa.list_(pa.int64()))], ["id", "spots"])

    sets = stored(sets.mapInArrow(open_, f"id {prints.schema[key].dataType.simpleString()}, spots array<long>"), "spot-sets")
    often = sets.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("n"))
    ranked = sets.select("id", F.size("spots").alias("size"), F.explode("spots").alias("spot")).join(often, "spot")
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "spot"))
    keys = ranked.withColumn("k", place).where(F.col("k") <= F.floor((1 - F.lit(least)) * F.col("size") + 1e-9) + 1)
    keys = stored(keys.select("id", "spot", "size", F.floor(F.log("size") / F.log(F.lit(1 / least))).cast("int").alias("cls")), "spot-keys")
    # The larger set looks into its own class and the one below.
    wide = keys.select(F.col("id").alias("b"), "spot", F.col("size").alias("size_b"), F.explode(F.array(F.col("cls"), F.col("cls") - 1)).alias("cls"))
    fits = (F.struct("size", "id") < F.struct("size_b", "b")) & (F.col("size") >= F.lit(least) * F.col("size_b"))
    pairs = keys.join(wide, ["spot", "cls"]).where(fits).select(F.col("id").alias("a"), "b").distinct()
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "spots": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "spots": "sb"}), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (same / (F.size("sa") + F.size("sb") - same)).alias("jaccard")).where(F.col("jaccard") >= least)

"""Ranked lexical search: shards of block-compressed posting lists with score maxima, searched by Block-Max MaxScore."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.llm.common import bites, shared_folder

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text per shard, postings per block, query terms per group of queries.
SHARD_BYTES, BLOCK, GROUP_TERMS = 32 << 20, 64, 1 << 18


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, the documents with at least one term, and all their terms with repeats."""

    path: str
    n_docs: int
    n_terms: int
    key_type: T.DataType

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(index_schema(self.key_type)).parquet(self.path)


def index_schema(key_type: T.DataType) -> T.StructType:
    """One row per shard and term; the row of a shard without a term has its documents' keys and factors."""
    of = T.StructType.fromDDL("shard long, term string, df int, peak long, last array<int>, peaks array<long>, ends array<int>, data binary, factors array<long>")
    return T.StructType([*of.fields, T.StructField("keys", T.ArrayType(key_type))])


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, the last of each below 128; and the end of each."""
    values = values.astype(np.int64)
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = size > k
        out[(ends - size)[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, ends


def from_varints(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data < 128)
    first = np.concatenate([[0], stop[:-1] + 1])
    size = stop - first + 1
    place = np.arange(len(data)) - np.repeat(first, size)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(stop) else np.zeros(0, np.int64)


def gains(tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What an occurrence count adds per unit of a term's weight, given 8 * m of the documents."""
    return 1_000_000_000 * tf // (1000 * tf + factor)


def _shard(name: int, texts: pa.Array, keys: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """All rows of one shard."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())), pattern=BREAK)
    doc = pc.list_parent_indices(lists).to_numpy()
    coded = pc.dictionary_encode(lists.flatten())
    code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    del lists, coded
    blank = pc.index(terms, pa.scalar("", terms.type)).as_py()
    doc, code = (doc, code) if blank < 0 else (doc[code != blank], code[code != blank])
    size = np.bincount(doc, minlength=len(texts))
    factor = 8 * (100 - 90 + 90 * size * n_docs // max(n_terms, 1))
    pair, tf = np.unique(code * len(texts) + doc, return_counts=True)
    code, doc = pair // max(len(texts), 1), pair % max(len(texts), 1)
    gain = gains(tf, factor[doc])
    n = len(pair)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    df = np.diff(np.append(starts, n))
    within = np.arange(n) - np.repeat(starts, df)
    blocks = np.flatnonzero(within % BLOCK == 0)
    stops = np.append(blocks[1:], n) - 1
    gap = np.where(within == 0, doc, np.diff(doc, prepend=0))
    both = np.empty(2 * n, np.int64)
    both[0::2], both[1::2] = gap, tf
    data, ends = varints(both)
    ends = ends[1::2]
    begin = np.concatenate([[0], ends])[starts]  # of each list's bytes
    ptr = np.append(np.searchsorted(blocks, starts), len(blocks)).astype(np.int32)
    relative = ends[stops] - np.repeat(begin, np.diff(ptr)) if n else ends
    head = pa.nulls(1, pa.int64())
    at = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ptr]), pa.int32()), pa.array(values, kind))
    full = np.append(begin, len(data)).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(full), pa.py_buffer(data.tobytes())])
    k = len(starts) + 1
    only_first = lambda a: pa.concat_arrays([a, pa.nulls(k - 1, a.type)])
    one_list = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k, name)),
            pa.concat_arrays([pa.nulls(1, pa.string()), terms.take(pa.array(code[starts])).cast(pa.string())]),
            pa.concat_arrays([head.cast(pa.int32()), pa.array(df.astype(np.int32))]),
            pa.concat_arrays([head, pa.array(np.maximum.reduceat(gain, starts) if n else gain, pa.int64())]),
            at(doc[stops].astype(np.int32) if n else [], pa.int32()),
            at(np.maximum.reduceat(gain, blocks) if n else [], pa.int64()),
            at(relative.astype(np.int32), pa.int32()),
            pa.concat_arrays([pa.nulls(1, pa.binary()), binary]),
            only_first(one_list(pa.array(factor, pa.int64()))),
            only_first(one_list(keys)),
        ],
        names=["shard", "term", "df", "peak", "last", "peaks", "ends", "data", "factors", "keys"],
    )


def _indexer(n_docs: int, n_terms: int, shard_bytes: int):
    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        texts, keys, size = [], [], 0

        def flush():
            t, k = pa.concat_arrays(texts), pa.concat_arrays(keys)
            texts.clear(), keys.clear()
            whole = _shard(part << 24 | count, t, k, n_docs, n_terms)
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)

        for b in bites(batches):
            n = int(pc.sum(pc.fill_null(pc.binary_length(b.column(1)), 0)).as_py() or 0)
            if texts and size + n > shard_bytes:
                yield from flush()
                size, count = 0, count + 1
            if b.num_rows:
                texts.append(b.column(1)), keys.append(b.column(0))
                size += n
        if texts:
            yield from flush()

    return run


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> Index:
    """Index of all whole texts in the shared folder; terms are runs of letters, digits and non-ASCII, A-Z in lower case.

    Two passes: the corpus counts, then the shards, each of about ``shard_bytes`` of one task's texts. A list has blocks of
    ``BLOCK`` postings; each block's last document, greatest gain and end stand apart from its bytes, so that a search can
    reject a block unread. Null texts have no terms; keys may be null or repeat, each row is a document of its own.
    """
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(TERM)), F.lit(0))
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    path = folder or shared_folder(docs.sparkSession, "ranked-index")
    kind = docs.schema[key].dataType
    docs.select(key, text).mapInArrow(_indexer(n_docs, n_terms, shard_bytes), index_schema(kind)).write.option("compression", "zstd").parquet(path)
    return Index(path, n_docs, n_terms, kind)


# ---------------------------------------------------------------- search


class Shard:
    """The lists of one shard that its queries ask for."""

    def __init__(self, factors: np.ndarray, keys: list, lists: dict[str, tuple]):
        self.factors, self.keys, self.lists = factors, keys, lists
        self.scores = np.zeros(len(factors), np.int64)
        self.blocks_read = 0

    def read(self, entry: tuple, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of a list, or of some of its blocks."""
        _, last, _, ends, data = entry
        raw = np.frombuffer(data, np.uint8)
        if blocks is None:
            blocks = np.arange(len(last))
        else:
            raw = np.concatenate([raw[ends[k - 1] if k else 0 : ends[k]] for k in blocks.tolist()])
        self.blocks_read += len(blocks)
        both = from_varints(raw)
        doc, tf = both[0::2].copy(), both[1::2]
        # Gaps run on from one block to the next; where blocks were left out, the last document before each one is known.
        first = np.arange(len(blocks)) * BLOCK
        doc[first] += np.where(blocks > 0, last[blocks - 1], 0)
        sums = np.cumsum(doc)
        doc = sums - np.repeat(sums[first] - doc[first], np.diff(np.append(first, len(doc))))
        return doc, gains(tf, self.factors[doc])

    def best(self, query: list[tuple[str, int]], k: int) -> list[tuple[int, object]]:
        """The ``k`` best (score, key) of a query of (term, weight); of equal scores the least keys, null last.

        Lists are taken by falling global bound, weight times peak. As long as a document that stands in none of the lists so
        far could reach the k-th score, a list is essential and read whole. Then no new document can enter, and the rest only
        adds to those that stand: a candidate whose score, block maximum and remaining bounds stay below the k-th score goes
        before the block is read. Bounds that equal it stay, as the key decides there.
        """
        score, least = self.scores, 1
        score[:] = 0
        lists = sorted(((w * e[0], w, e) for t, w in query if w > 0 and (e := self.lists.get(t))), key=lambda x: -x[0])
        left = np.append(np.cumsum([b for b, _, _ in lists[::-1]])[::-1], 0)
        kth = lambda values: int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0
        at = 0
        while at < len(lists) and left[at] >= least:
            _, w, entry = lists[at]
            doc, gain = self.read(entry)
            score[doc] += w * gain
            least = max(least, kth(score))
            at += 1
        some = np.flatnonzero((score > 0) & (score + left[at] >= least))
        for j in range(at, len(lists)):
            _, w, entry = lists[j]
            _, last, peaks, _, _ = entry
            block = np.searchsorted(last, some)
            inside = block < len(last)
            bound = np.where(inside, w * peaks[np.minimum(block, len(last) - 1)], 0)
            alive = score[some] + bound + left[j + 1] >= least
            some, block = some[alive], block[alive]
            need = np.unique(block[block < len(last)])
            if len(need):
                doc, gain = self.read(entry, need)
                score[doc] += w * gain
            least = max(least, kth(score[some]))
        some = some[score[some] >= least]
        found = [(int(score[d]), self.keys[d]) for d in some.tolist()]
        return heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))


def _searcher(k: int, item_type: pa.DataType, key_type: pa.DataType):
    names = ["item", "score", "key"]

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        factors, keys, lists = None, None, {}
        for r in index.to_batches():
            for row in r.select(["term", "peak", "last", "peaks", "ends", "data", "factors", "keys"]).to_pylist():
                if row["term"] is None:
                    factors, keys = np.array(row["factors"], np.int64), row["keys"]
                else:
                    lists[row["term"]] = (row["peak"], *(np.array(row[c], np.int64) for c in ("last", "peaks", "ends")), row["data"])
        out = []
        if factors is not None:
            shard = Shard(factors, keys, lists)
            for item, terms in zip(queries["item"].to_pylist(), queries["terms"].to_pylist(), strict=True):
                out += [(item, s, key) for s, key in shard.best([(t["term"], t["w"]) for t in terms], k)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (item_type, pa.int64(), key_type), strict=True)], names=names)

    return run


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(index: Index, queries: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item, rank, key, score): the ``k`` best documents of each item, scores above 0, equal ones by key, null last.

    A term weighs floor(1000 * ln((2N + 2) / (2 df + 1))). Rows of one item count as one query, null is an item as any other,
    items without a known term have no rows. Each shard meets its lists of the queries' terms and all queries, in groups
    of about ``GROUP_TERMS`` terms, which bounds what is broadcast and what a task holds; it returns its heap of each query,
    and the heaps meet at last. Neither queries nor anything of the corpus pass through the driver's program.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    rows = index.rows(spark)
    terms = queries.select(F.col(item).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(lowered(F.col(text)), F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    asked = terms.select("term").distinct()
    df = rows.select("term", "df").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asking = terms.join(df.select("term", weight.alias("w")), "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    groups = max(1, -(-terms.count() // GROUP_TERMS))
    asking = asking.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    heads, listed = rows.where(F.col("term").isNull()), rows.where(F.col("term").isNotNull()).join(asked, "term", "left_semi")
    item_type, key_type = queries.schema[item].dataType, index.key_type
    schema = T.StructType([T.StructField("item", item_type), T.StructField("score", T.LongType()), T.StructField("key", key_type)])
    run = _searcher(k, to_arrow_type(item_type), to_arrow_type(key_type))

    def heaps(group: int) -> DataFrame:
        mine = F.explode(F.array(F.lit(group))).alias("part")
        asked_of = heads.select(F.col("shard").alias("of"), mine).join(F.broadcast(asking.where(F.col("part") == group)), "part")
        return heads.unionByName(listed).groupBy("shard").cogroup(asked_of.groupBy("of")).applyInArrow(run, schema)

    found = reduce(DataFrame.unionByName, [heaps(g) for g in range(groups)])
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key"), "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT item_id, m.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY item_id, m.r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

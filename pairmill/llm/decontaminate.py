"""Benchmark decontamination: rare n-gram seeds join training text to test items, Smith-Waterman alignment scores it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.llm.common import Words, bites, grams

#: Words of a seed.
SEED = 4
#: A seed is rare when its words, drawn independently with the frequencies of the corpus, would give it with this chance at most.
RARE = 1e-8
#: Alignment: a common word adds 1, a changed, added or missing word takes half.
MISS = 0.5
#: Least score, as a share of the item's words.
LEAST = 0.45
#: Words of test items that a task holds at once; a larger benchmark is worked off in parts, one pass each.
PART_WORDS = 4_000_000


class Items:
    """Test items as word hashes with an index of their rare seeds; a few dozen bytes per word."""

    def __init__(self, ids: list, texts: list, counts: dict[int, int], total: int):
        w = Words(pa.array(texts, type=pa.string()), letters=True)
        self.ids, self.hash, self.ptr = ids, w.hash, w.ptr
        chance = np.log(np.array([max(1, counts.get(int(np.int64(h.view(np.int64))), 0)) for h in w.hash], dtype=float) / max(1, total))
        g, gptr = grams(w.hash, w.ptr, SEED, short=False)
        row = np.repeat(np.arange(len(ids)), np.diff(gptr))
        first = w.ptr[row] + np.arange(len(g)) - gptr[row]
        sums = np.concatenate([[0.0], np.cumsum(chance)])
        rare = sums[first + SEED] - sums[first] <= math.log(RARE)
        some = np.zeros(len(ids), dtype=bool)
        np.logical_or.at(some, row, rare)
        keep = rare | ~some[row]  # an item without any rare seed is sought by all of its seeds
        order = np.argsort(g[keep], kind="stable")
        self.seed, self.row, self.at = g[keep][order], row[keep][order], (first - w.ptr[row])[keep][order]

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``g``, index into the seeds) of all equal pairs."""
        lo, hi = np.searchsorted(self.seed, g, "left"), np.searchsorted(self.seed, g, "right")
        n = hi - lo
        some = np.flatnonzero(n)
        idx = np.repeat(some, n[some])
        return idx, np.arange(len(idx)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + lo[idx]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each row of ``windows``, and the position where it ends (exclusive)."""
    n, width = windows.shape
    slope = MISS * np.arange(width + 1)
    old = np.zeros((n, width + 1))
    best, end = np.zeros(n), np.zeros(n, dtype=np.int64)
    for word in item:
        new = np.zeros((n, width + 1))
        np.maximum(old[:, :-1] + np.where(windows == word, 1.0, -MISS), old[:, 1:] - MISS, out=new[:, 1:])
        np.maximum(new, 0.0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope  # words of the text without a partner
        top = new.argmax(axis=1)
        score = new[np.arange(n), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
        old = new
    return best, end


def findings(items: Items, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of every item that a text holds, the best place of each."""
    w = Words(texts, letters=True)
    g, gptr = grams(w.hash, w.ptr, SEED, short=False)
    idx, seed = items.hits(g)
    if not len(idx):
        return []
    row = np.searchsorted(gptr, idx, side="right") - 1
    pos, item = idx - gptr[row], items.row[seed]
    order = np.lexsort((pos, row, item))
    row, pos, item, at = row[order], pos[order], item[order], items.at[seed][order]
    length = np.diff(items.ptr)[item]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > length[1:])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    low, high = np.minimum.reduceat(pos - at, start), np.maximum.reduceat(pos - at, start)
    row, item, length = row[start], item[start], length[start]
    low, high = np.maximum(low - length // 2, 0), np.minimum(high + length + length // 2, np.diff(w.ptr)[row])
    best: dict[tuple[int, int], tuple] = {}
    for i in np.unique(item):
        of = np.flatnonzero(item == i)
        words = items.hash[items.ptr[i] : items.ptr[i + 1]]
        for part in np.array_split(of[np.argsort(high[of] - low[of], kind="stable")], max(1, len(of) // 64)):
            width = int((high[part] - low[part]).max())
            win = np.zeros((len(part), width), dtype=np.uint64)
            for k, c in enumerate(part):
                win[k, : high[c] - low[c]] = w.hash[w.ptr[row[c]] + low[c] : w.ptr[row[c]] + high[c]]
            score, end = align(words, win)
            good = np.flatnonzero(score >= LEAST * len(words))
            if not len(good):
                continue
            _, back = align(words[::-1], win[good][:, ::-1])
            for k, b in zip(good, back, strict=True):
                c, s = part[k], float(score[k]) / len(words)
                span = (int(low[c]) + width - int(b), int(low[c]) + int(end[k]))
                key = (int(row[c]), int(i))
                if key not in best or s > best[key][0]:
                    best[key] = (s, *span)
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def _word_counts(docs: DataFrame, text: str, wanted: np.ndarray) -> tuple[dict[int, int], int]:
    """How often each of the ``wanted`` word hashes (sorted) occurs in all texts, and the number of all words."""

    def count(batches):
        total, sums = 0, np.zeros(len(wanted), dtype=np.int64)
        for b in bites(batches, 0):
            h = Words(b.column(0), letters=True).hash
            at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
            if len(wanted):
                sums += np.bincount(at[wanted[at] == h], minlength=len(wanted))
            total += len(h)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(wanted[some].view(np.int64), 0)), pa.array(np.append(sums[some], total)), pa.array(np.append(np.ones(len(some), bool), False))], ["h", "n", "word"]
        )

    rows = docs.select(text).mapInArrow(count, "h long, n long, word boolean").groupBy("word", "h").agg(F.sum("n").alias("n")).collect()
    return {r["h"]: r["n"] for r in rows if r["word"]}, sum(r["n"] for r in rows if not r["word"])


def _parts(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str) -> list:
    """Broadcast variables with the items, each of at most about PART_WORDS words."""
    size = benchmark.agg(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    n = 1 + size // (4 * PART_WORDS)
    out = []
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(item_text), F.lit(n)) == k).select(item_key, item_text).distinct().collect()
        texts = [r[1] for r in rows]
        wanted = np.unique(Words(pa.array(texts, type=pa.string()), letters=True).hash)
        counts, total = _word_counts(docs, text, wanted)
        out.append(docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], texts, counts, total)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, ``score``, ``first_word``, ``end_word``): test items that stand in a document, copied or edited.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Seeds of four words of an item that
    the corpus makes unlikely (all of them where an item has no such) are looked up at every position of every text; the
    stretch around the hits is aligned with the item by Smith-Waterman. ``score`` is the alignment's score by the
    item's words, from 0.45 to 1; the best place counts. Rarity comes from word frequencies over all texts, not from
    how often a seed itself occurs, so that an item copied into a third of all documents keeps its seeds. Null and
    empty texts and items, and items of under four words, have no findings. Repeated rows are judged each by itself,
    repeated items count once.
    """
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, benchmark.schema[item_key].dataType), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    found = None
    for held in _parts(docs, benchmark, text, item_key, item_text):

        def find(batches, held=held):
            items = held.value
            for b in bites(batches):
                f = findings(items, b.column(1))
                rows, which, score, first, end = zip(*f, strict=True) if f else ((),) * 5
                ids = pa.array([items.ids[i] for i in which], type=item_type)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), ids, pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], out.names)

        item_type = _arrow_type(benchmark, item_key)
        part = docs.select(key, text).mapInArrow(find, out)
        found = part if found is None else found.union(part)
    return found


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` (same columns) without the rows in which a test item stands; rows stay where they are, nothing is shuffled."""
    for held in _parts(docs, benchmark, text, item_key, item_text):

        def keep(batches, held=held, at=docs.columns.index(text)):
            for b in bites(batches, at):
                bad = {f[0] for f in findings(held.value, b.column(at))}
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)], type=pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

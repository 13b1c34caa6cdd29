"""Lookups of the curation scripts as joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions import text as X
from pairmill.operators.graph import hot_lookup
from pairmill.schema import HANGUL, Script
from pairmill.session import cut_lineage, stored

def rare_symbol_ratio(df: DataFrame, key: str, c: str, profile: DataFrame, script: Script = HANGUL) -> DataFrame:
    """Share of script symbols of ``c`` outside ``profile(ch)``; 0 where the text has none.

    A script has at most 65,536 symbols below U+FFFF, so the profile always fits a broadcast.
    Symbols are counted per row first: one joined row per distinct symbol, not per character.
    """
    syms = F.regexp_extract_all(X.text(c), F.lit(f"[{script.symbols}]"), F.lit(0))
    per = (
        df.select(key, F.explode(syms).alias("ch"))
        .groupBy(key, "ch").agg(F.count("*").alias("n"))
        .join(F.broadcast(profile.select("ch", F.lit(1).alias("known"))), "ch", "left")
        .groupBy(key)
        .agg((F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("rare"))
    )
    return df.join(per, key, "left").withColumn("rare", F.coalesce("rare", F.lit(0.0)))


def index_to_files(rows: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """Rows of the files named in a field index (adaptive execution broadcasts the index when its bytes are few)."""
    return rows.join(index, path)


# Vocabulary weight by grade.
GRADE_WEIGHT = {"A": 1.0, "B": 0.7, "C": 0.45}
OTHER_GRADE = 0.5


def grade_weight(grade: Column) -> Column:
    w = F.lit(OTHER_GRADE)
    for g, v in GRADE_WEIGHT.items():
        w = F.when(F.upper(grade) == g, v).otherwise(w)
    return w


def vocab_hits(df: DataFrame, key: str, terms: Column, vocab: DataFrame) -> DataFrame:
    """Adds ``vocab_hits`` and ``vocab_score`` (sum of grade weights) from ``vocab(term, grade)``.

    One vocabulary row per term (best grade) is kept first, so a row cannot multiply.
    """
    v = vocab.groupBy("term").agg(F.max(grade_weight(F.col("grade"))).alias("w"))
    hit = (
        df.select(key, F.explode(F.array_distinct(terms)).alias("term"))
        .join(v, "term")
        .groupBy(key).agg(F.count("*").alias("vocab_hits"), F.sum("w").alias("vocab_score"))
    )
    return df.join(hit, key, "left").withColumns(
        {"vocab_hits": F.coalesce("vocab_hits", F.lit(0)), "vocab_score": F.coalesce("vocab_score", F.lit(0.0))})


def common_symbols(profile: DataFrame, min_count: int = 3) -> DataFrame:
    return profile.filter(F.col("n") >= min_count).select("ch")


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not used yet."""
    return df.join(used.select(key), key, "left_anti")


# ------------------------------------------------------------------ fuzzy terms

MAX_GAP = 2


def _edits(n: Column, similarity: float) -> Column:
    return F.floor(n * (1.0 - similarity) + 1e-9).cast("int")


def _start(i: Column, n: Column, parts: Column) -> Column:
    return F.floor(i * n / parts).cast("int")


def _without_one(piece: Column) -> Column:
    """All ways to take one letter out of a piece."""
    return F.transform(F.sequence(F.lit(1), F.length(piece)), lambda k: F.concat(F.substr(piece, F.lit(1), k - 1), F.substr(piece, k + 1)))


def _pieces(df: DataFrame, size: str, similarity: float) -> DataFrame:
    """Adds d, the most edits a partner of a term of ``size`` letters can have, and each piece's number, begin and width.

    d edits fall on d // 2 + 1 pieces, so one of these takes one edit at most; pieces have five letters or more.
    """
    d = df.withColumn("d", _edits(F.col(size) + MAX_GAP, similarity)).filter("d > 0").withColumn("parts", F.floor(F.col("d") / 2).cast("int") + 1)
    d = d.withColumn("i", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("c0", _start(F.col("i"), F.col(size), F.col("parts")))
    return d.withColumn("w", _start(F.col("i") + 1, F.col(size), F.col("parts")) - F.col("c0"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, similarity: float = 0.84) -> DataFrame:
    """Distinct term pairs (a, b, sim): equal, or length gap <= 2 and edit similarity reached.

    A deletion index: terms of ``b`` are cut into pieces of which one takes at most one edit, and stand under each piece and
    each piece less one letter. Terms of ``a`` look up what lies at most d places from there, with up to one letter less or
    more, whole and less one letter: two strings one edit apart have such a form in common. Whole pieces of five letters
    and more in their place are the keys, so there are no short, hot ones. Candidates are then measured.
    """
    return _near_terms(left.select(a).distinct(), right.select(b).distinct(), a, b, similarity)


def _near_terms(left: DataFrame, right: DataFrame, a: str, b: str, similarity: float) -> DataFrame:
    r = right.filter(F.length(b) > 0).select(b, F.length(b).alias("len"))
    q = left.filter(F.length(a) > 0).select(a, F.length(a).alias("n"))
    exact = q.join(r, q[a] == r[b]).select(a, b, F.lit(1.0).alias("sim"))
    piece = F.substr(b, F.col("c0") + 1, F.col("w"))
    forms = _pieces(r, "len", similarity).select(b, "len", "i", F.explode(F.concat(F.array(piece), _without_one(piece))).alias("form"))
    asked = _pieces(q.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - MAX_GAP), F.col("n") + MAX_GAP))), "len", similarity)
    asked = asked.withColumn("size", F.explode(F.expr("sequence(greatest(w - 1, 1), least(w + 1, n))")))
    asked = asked.withColumn("lo", F.greatest(F.lit(0), F.col("c0") - F.col("d"))).withColumn("hi", F.least(F.col("n") - F.col("size"), F.col("c0") + F.col("d")))
    asked = asked.filter("hi >= lo").withColumn("p", F.explode(F.expr("sequence(lo, hi)")))
    part = F.substr(a, F.col("p") + 1, F.col("size"))
    whole = F.when(F.col("size") <= F.col("w"), F.array(part)).otherwise(F.array().cast("array<string>"))
    less = F.when(F.col("size") >= F.col("w"), _without_one(part)).otherwise(F.array().cast("array<string>"))
    asked = asked.select(a, "len", "i", F.explode(F.concat(whole, less)).alias("form"))
    key = F.xxhash64("len", "i", "form").alias("key")
    near = asked.select(a, key).distinct().join(forms.select(b, key), "key").filter((F.col(a) != F.col(b)) & (F.abs(F.length(a) - F.length(b)) <= MAX_GAP))
    near = near.select(a, b, X.edit_ratio(F.col(a), F.col(b)).alias("sim")).filter(F.col("sim") >= similarity)
    return exact.unionByName(near.distinct())


# A cached answer's bonus is this, or this many characters over its length if that is less.
BONUS, BONUS_CHARS = 0.35, 24


def fuzzy_term_join(queries: DataFrame, cache: DataFrame, query: str, term: str, size: str, pos: str, similarity: float = 0.84) -> DataFrame:
    """Best cache row per query term: exact = 10, else similarity, plus a short-answer bonus; (query, matched, pos, score).

    ``cache`` has the length of each answer, not the answer: fetch that by ``pos`` for the winners. Rows of one term share
    its similarity, so each term first keeps its shortest answer, the first of equal ones; only distinct terms are compared.
    """
    least = math.floor(BONUS_CHARS / BONUS)  # answers up to this length have the same bonus
    best = cut_lineage(cache.groupBy(F.col(term).alias("_t")).agg(F.min(F.struct(F.greatest(F.col(size), F.lit(least)).alias("size"), F.col(pos).alias("pos"))).alias("m")))
    pairs = _near_terms(queries.select(query).distinct(), best, query, "_t", similarity).join(best, "_t")
    bonus = F.least(F.lit(BONUS), BONUS_CHARS / F.col("m.size"))
    score = F.when(F.col(query) == F.col("_t"), 10.0).otherwise(F.col("sim")) + bonus
    top = pairs.groupBy(query).agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("m.pos")).alias("np"), F.col("_t").alias("t"))).alias("b"))
    return top.select(query, F.col("b.t").alias("matched"), (-F.col("b.np")).alias(pos), F.col("b.score").alias("score"))


# ------------------------------------------------------------------ top-k by keyword overlap

#: Lists of more items than this are cut to those that can be among the best; items of one part of the index, which a task holds, and queries that it answers.
HOT_RULE_ROWS, PLACES, QUERIES = 256, 1 << 19, 1 << 17
#: Scores apart by more than SLACK differ when rounded; items of the blocks that give a query its first k-th score.
SLACK, FIRST_ROWS = 1e-8, 64


def use_bonus(uses: Column, cap: float, step: float) -> Column:
    return F.least(F.lit(cap), step * F.log1p(F.greatest(uses, F.lit(0)).cast("double")))


def _leaders(items: DataFrame, k: int) -> DataFrame:
    """Rows of ``items`` that are not behind ``k`` rows of equal keywords: equal sets have equal overlaps, so their base decides, then their place."""
    same = Window.partitionBy("_kw", "_base").orderBy("_pos")
    few = cut_lineage(items.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k).drop("_r"))
    best = Window.partitionBy("_kw").orderBy(F.col("_base").desc(), "_pos")
    last = few.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k).select("_kw", F.col("_base").alias("_last"))
    return few.join(last, "_kw", "left").filter(F.col("_last").isNull() | (F.col("_base") >= F.col("_last") - SLACK)).drop("_last")


def _firsts(*cols: np.ndarray) -> np.ndarray:
    """For each row of sorted ``cols`` the first row equal to it."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of ``n`` each, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(start - ends + n, n)


class Part:
    """Items of one part of the index in the order of their places: blocks of items by token, and the best items of a query.

    Tokens stand in one order, rare ones first. If the first token that a pair shares has i tokens of the query and j of the item
    from there on, the pair shares min(i, j) at most. So a block holds items of one token, j and size, with its best base.
    """

    def __init__(self, size: np.ndarray, base: np.ndarray, held: np.ndarray, tokens: np.ndarray, k: int, weight: float, hot: int):
        """``held``: how many of ``tokens`` each item has, in order; ``size`` is that of all its keywords."""
        self.size, self.base, self.held, self.k, self.weight = size, base, held, k, weight
        self.start = np.concatenate([[0], np.cumsum(held)])
        self.words, flat = np.unique(tokens, return_inverse=True)
        self.flat, self.mark = flat.astype(np.int32), np.zeros(len(self.words), np.int32)
        at = np.flatnonzero(self._standing(hot))
        owner = np.repeat(np.arange(len(size), dtype=np.int32), held)[at]
        left = self.start[owner + 1] - at
        order = np.lexsort((-base[owner], size[owner], left, self.flat[at]))
        self.items, word, left = owner[order], self.flat[at[order]], left[order]
        first = _firsts(word, left, size[self.items])
        self.first = np.flatnonzero(first == np.arange(len(first)))
        self.rows = np.diff(np.append(self.first, len(first)))
        self.blocks = np.searchsorted(word[self.first], np.arange(len(self.words) + 1))
        self.left, self.of_size, self.most = left[self.first], size[self.items[self.first]], base[self.items[self.first]]
        self.kth = np.where(self.rows >= k, base[self.items[self.first + np.minimum(self.rows, k) - 1]], -np.inf)

    def _standing(self, hot: int) -> np.ndarray:
        """Which places of ``flat`` lists of more than ``hot`` items keep.

        A pair is met at the first token it shares. Items of one size that have equal tokens from there on share as many with the
        query at least, so an item stays out of a list if ``k`` of these are before it by base and place. Groups of tokens from
        the last one on are made finer step by step, until none has more than ``k`` items.
        """
        stays, often = np.ones(len(self.flat), bool), np.bincount(self.flat, minlength=len(self.words)) > hot
        left, group, step = np.arange(len(self.size)), self.size.astype(np.int64), 1
        while len(left := left[self.held[left] >= step]):
            at = self.start[left + 1] - step
            group[left] = np.unique(group[left] * len(self.words) + self.flat[at], return_inverse=True)[1]
            order = np.lexsort((-self.base[left], group[left]))  # stable: equal ones by place
            left, at = left[order], at[order]
            g, b, i = group[left], self.base[left], np.arange(len(left))
            first, n = _firsts(g), np.bincount(g)[g]
            last = b[first + np.minimum(n, self.k) - 1]
            stays[at] = (i - first < self.k) | ((b >= last - SLACK) & (i - _firsts(g, b) < self.k)) | ~often[self.flat[at]]
            left, step = np.sort(left[n > self.k]), step + 1
        return stays

    def _scored(self, blocks: np.ndarray, n_all: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, overlap, score) of all items of ``blocks``, each once, for the query whose tokens are marked."""
        items = np.sort(self.items[_spans(self.first[blocks], self.rows[blocks])])
        items = items[np.append(True, items[1:] != items[:-1])]
        held = self.held[items]
        n = np.add.reduceat(self.mark[self.flat[_spans(self.start[items], held)]], np.cumsum(held) - held)
        overlap = n / (n_all + self.size[items] - n)
        return items, overlap, self.weight * overlap + self.base[items]

    def best(self, tokens: np.ndarray, n_all: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, overlap) of the ``k`` best items by score and place, and of those that rounding could tie with them.

        ``tokens``: places in ``words`` of those of a query's ``n_all`` tokens that are there, in order. Blocks that promise most
        are opened first; then those that can reach the k-th score found in them, or the one that one shared token gives for sure.
        """
        n, k = self.blocks[tokens + 1] - self.blocks[tokens], self.k
        blocks = _spans(self.blocks[tokens], n)
        size, shared = n_all + self.of_size[blocks], np.minimum(self.left[blocks], np.repeat(np.arange(len(tokens), 0, -1), n))
        bound = self.weight * shared / (size - shared) + self.most[blocks]
        least = (self.weight / (size - 1) + self.kth[blocks]).max() - SLACK
        able = np.flatnonzero(bound >= least)
        able = able[np.argsort(-bound[able])]
        ahead = int(np.searchsorted(np.cumsum(self.rows[blocks[able]]), FIRST_ROWS)) + 1
        self.mark[tokens] = 1
        items, overlap, score = self._scored(blocks[able[:ahead]], n_all)
        if len(able) > ahead:
            if len(items) >= k:
                least = max(least, np.partition(score, -k)[-k] - SLACK)
            more = able[ahead:][bound[able[ahead:]] >= least]
            if len(more):
                both = [np.concatenate(x) for x in zip((items, overlap, score), self._scored(blocks[more], n_all), strict=True)]
                once = np.unique(both[0], return_index=True)[1]
                items, overlap, score = (x[once] for x in both)
        self.mark[tokens] = 0
        if len(items) > k:
            near = np.flatnonzero(score >= np.partition(score, -k)[-k] - SLACK)
            near = near[np.argsort(-score[near], kind="stable")]  # equal ones by place
            near = near[np.arange(len(near)) - _firsts(score[near]) < k]
            items, overlap = items[near], overlap[near]
        return items, overlap


def _best_of_part(k: int, weight: float, hot: int):
    """Rows (_s, _n, _size, _base, _ids) of one part, its items by place before queries, which have no _n -> (_s, _n, overlap, _base) of each query's best."""

    def columns(b: pa.RecordBatch):
        ids = b["_ids"]
        ends = ids.offsets.to_numpy()
        return b["_size"].to_numpy(), np.diff(ends), ids.values.to_numpy()[ends[0] : ends[-1]]

    def run(batches):
        items, part = [], None
        for b in batches:
            n = len(b) - b["_n"].null_count
            if n:
                mine = b.slice(0, n)
                size, held, tokens = columns(mine)
                items.append((mine["_n"].to_numpy(), mine["_base"].to_numpy(), size, held, tokens))
            asked = b.slice(n)
            if not len(asked) or not items:
                continue
            if part is None:
                place, base, size, held, tokens = (np.concatenate(x) for x in zip(*items, strict=True))
                part = Part(size, base, held, tokens, k, weight, hot)
            size, held, tokens = columns(asked)
            at = np.minimum(np.searchsorted(part.words, tokens), len(part.words) - 1)
            known = part.words[at] == tokens
            row = np.repeat(np.arange(len(asked)), held)[known]
            at = at[known]
            rows, ends = np.unique(row, return_index=True)
            found = [part.best(at[x:y], size[r]) for r, x, y in zip(rows, ends, [*ends[1:], len(at)], strict=True)]
            if found:
                item, overlap = (np.concatenate(x) for x in zip(*found, strict=True))
                of = pa.array(np.repeat(rows, [len(x[0]) for x in found]))
                yield pa.record_batch([asked["_s"].take(of), pa.array(place[item]), pa.array(overlap), pa.array(base[item])], names=["_s", "_n", "overlap", "_base"])

    return run


def overlap_scores(queries: DataFrame, items: DataFrame, qid: str, q_tokens: str, item: str, keywords: str,
                   base: str, pos: str, k: int, always: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """(qid, item, overlap, base, pos) of the ``k`` best items of each query by weight * overlap + base, equal ones by pos.

    Queries of equal tokens are answered once, and of items of equal keywords only those that can be among ``k`` take part;
    tokens that one side alone has count for the size only. Items are dealt to parts and queries to shares, both of a bounded
    number of rows, and each share meets each part in a task that builds lists by token and finds each query's best ``k``. Only
    these leave the task: the rows sent are those of both sides, once for each part or share, not the pairs that share a token.
    """
    it = stored(items.select(item, F.array_distinct(keywords).alias("_kw"), F.col(base).alias("_base"), F.col(pos).alias("_pos")), "items")
    asked = stored(queries.select(qid, F.array_sort(F.array_distinct(q_tokens)).alias("_q")), "asked")
    sets = stored(asked.groupBy("_q").agg(F.min(qid).alias("_s")), "sets").withColumn("_size", F.size("_q"))
    k_words = it.select(item, F.size("_kw").alias("_size"), "_base", "_pos", F.explode("_kw").alias("tok"))
    q_words = sets.select("_s", "_size", F.explode("_q").alias("tok"))
    counts = k_words.groupBy("tok").agg(F.count("*").alias("_df")).join(q_words.select("tok").distinct(), "tok")
    # Ids in the order of the tokens, rare ones first.
    counts = cut_lineage(cut_lineage(counts.orderBy("_df", "tok")).select("tok", F.monotonically_increasing_id().alias("_t")))

    def with_ids(words: DataFrame, *keys: str) -> DataFrame:
        return hot_lookup(words, counts, "tok").groupBy(*keys).agg(F.sort_array(F.collect_list("_t")).alias("_ids"))

    lists = with_ids(k_words, item, "_size", "_base", "_pos").withColumn("_kw", F.concat(F.array(F.col("_size").cast("long")), "_ids"))
    lists = cut_lineage(_leaders(lists, k).drop("_kw").orderBy("_pos")).withColumn("_n", F.monotonically_increasing_id())
    mine = stored(with_ids(q_words, "_s", "_size"), "mine")
    parts = max(1, math.ceil(lists.count() / PLACES))
    shares = max(math.ceil(items.sparkSession.sparkContext.defaultParallelism / parts), math.ceil(mine.count() / QUERIES))
    part, share = F.pmod(F.xxhash64("_n"), F.lit(parts)), F.pmod(F.xxhash64("_s"), F.lit(shares))
    kept = lists.select(F.lit(None).cast(sets.schema["_s"].dataType).alias("_s"), "_n", "_size", "_base", "_ids", part.alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    sent = mine.select("_s", F.lit(None).cast("long").alias("_n"), "_size", F.lit(None).cast("double").alias("_base"), "_ids", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), share.alias("_share"))
    dealt = kept.unionByName(sent).withColumn("_to", (F.col("_part") * shares + F.col("_share")).cast("int")).drop("_part", "_share")
    dealt = dealt.repartitionById(parts * shares, "_to").drop("_to").sortWithinPartitions(F.col("_n").asc_nulls_last())
    schema = T.StructType([T.StructField("_s", sets.schema["_s"].dataType), T.StructField("_n", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("_base", T.DoubleType())])
    best = Window.partitionBy("_s").orderBy(F.round(weight * F.col("overlap") + F.col("_base"), 9).desc(), "_n")
    found = stored(dealt.mapInArrow(_best_of_part(k, weight, HOT_RULE_ROWS), schema), "found").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    found = found.select("_s", "_n", "overlap").join(lists.select("_n", item, "_base", "_pos"), "_n").drop("_n")
    if always is not None:
        few = F.broadcast(always.select(item).join(it, item).select(item, F.size("_kw").alias("_nk"), "_base", "_pos"))
        zero = F.when(F.col("_size") + F.col("_nk") == 0, 1.0).otherwise(0.0)
        found = found.unionByName(sets.crossJoin(few).select("_s", zero.alias("overlap"), item, "_base", "_pos"))
        found = found.groupBy("_s", item).agg(F.max("overlap").alias("overlap"), F.first("_base").alias("_base"), F.first("_pos").alias("_pos"))
    return asked.join(sets.select("_q", "_s"), "_q").select(qid, "_s").join(found, "_s").select(qid, item, "overlap", "_base", "_pos")


def _top(d: DataFrame, qid: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), "_pos")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(qid, item, "rank", "score")


def active(df: DataFrame, status: str | None) -> DataFrame:
    return df if status is None else df.filter(F.col(status) == "active")


def topk_jaccard(queries: DataFrame, rules: DataFrame, qid: str, q_tokens: str, rid: str, keywords: str, uses: str, pos: str, k: int = 3, status: str | None = None) -> DataFrame:
    """Active rules by keyword overlap > 0 plus min(0.08, 0.01 ln(1 + uses)), top ``k`` per query.

    With ``status``, only rules whose column of that name is "active" take part.
    """
    r = active(rules, status).withColumn("_bonus", use_bonus(F.col(uses), 0.08, 0.01))
    d = overlap_scores(queries, r, qid, q_tokens, rid, keywords, "_bonus", pos, k).filter("overlap > 0")
    return _top(d.withColumn("score", F.round(F.col("overlap") + F.col("_base"), 9)), qid, rid, k)


def topk_vectors(queries: DataFrame, recs: DataFrame, qid: str, q_tokens: str, vid: str, keywords: str, score: str, uses: str, pos: str, k: int = 3, status: str | None = None,
                 kind: str | None = None, kind_allow: Sequence[str] = ()) -> DataFrame:
    """0.60 overlap + 0.30 clipped score + min(0.15, 0.02 ln(1 + uses)), positive, top ``k``.

    Rows without overlap compete by the static part alone, so their global best ``k`` are the
    only ones that can appear in any answer. ``status`` as in ``topk_jaccard``; with ``kind_allow``, only records
    whose ``kind`` is among these, case and outer spaces aside.
    """
    recs = active(recs, status)
    if kind and kind_allow:
        recs = recs.filter(F.lower(X.strip(kind)).isin([x.strip().lower() for x in kind_allow]))
    static = 0.30 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score))) + use_bonus(F.col(uses), 0.15, 0.02)
    r = recs.withColumn("_static", static)
    always = r.orderBy(F.col("_static").desc(), pos).limit(k)
    d = overlap_scores(queries, r, qid, q_tokens, vid, keywords, "_static", pos, k, always, 0.60)
    return _top(d.withColumn("score", F.round(0.60 * F.col("overlap") + F.col("_base"), 9)).filter("score > 0"), qid, vid, k)


def compose_layers(hits: DataFrame, recs: DataFrame, qid: str, vid: str, layer: str, vector: str, weight: Column, max_norm: float = 2.0) -> DataFrame:
    """Weighted vector sum per query and layer, norm clipped; (qid, layer, pos, value).

    At most k vectors meet per query and layer, so they travel whole and are summed in the row, in the order of their ids.
    """
    d = hits.join(recs.select(vid, layer, vector, weight.alias("_w")), vid).filter(F.col(vector).isNotNull())
    one = F.struct(F.col(vid).alias("id"), (F.col("score") * F.col("_w")).alias("c"), F.col(vector).alias("v"))
    s = d.select(qid, layer, one.alias("_one")).groupBy(qid, layer).agg(F.array_sort(F.collect_list("_one")).alias("_all"))

    def add(a: Column, x: Column) -> Column:
        more = F.transform(x["v"], lambda y: y.cast("double") * x["c"])
        return F.zip_with(a, more, lambda p, q: F.coalesce(p + q, p, q))

    s = s.select(qid, layer, F.aggregate("_all", F.array().cast("array<double>"), add).alias("_v"))
    n = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda t, y: t + F.coalesce(y * y, F.lit(0.0))))
    s = s.withColumn("_n", n).select(qid, layer, "_n", F.posexplode("_v").alias("pos", "value"))
    return s.select(qid, layer, "pos", F.when(F.col("_n") > max_norm, F.col("value") * (max_norm / F.col("_n"))).otherwise(F.col("value")).alias("value"))


# ------------------------------------------------------------------ expectations


def expectation_frame(spark, table: dict) -> DataFrame:
    rows = [(k, [x.lower() for x in v.get("all", [])], [x.lower() for x in v.get("any", [])], int(v.get("max_len", 0))) for k, v in table.items()]
    return spark.createDataFrame(rows, "id string, need_all array<string>, need_any array<string>, max_len int")


def matches_expectation(text: Column, need_all: Column, need_any: Column, max_len: Column) -> Column:
    """All terms, any term and length bound; an item without expectations passes."""
    low = F.lower(X.normalize_space(text))
    ok = (
        ((max_len == 0) | (F.length(low) <= max_len))
        & F.forall(need_all, lambda x: F.contains(low, x))
        & ((F.size(need_any) == 0) | F.exists(need_any, lambda x: F.contains(low, x)))
    )
    return F.when(need_all.isNull(), True).otherwise(ok)


def with_expectations(answers: DataFrame, expectations: DataFrame, item: str = "id", text: str = "stdout") -> DataFrame:
    # A suite has a few items with a row each, and answers of few items would meet in as many tasks.
    e = F.broadcast(expectations.select(F.col("id").alias(item), "need_all", "need_any", "max_len"))
    d = answers.join(e, item, "left")
    return d.withColumn("matches", matches_expectation(F.col(text), F.col("need_all"), F.col("need_any"), F.col("max_len")))


def canonical_join(suite: DataFrame, canonical: DataFrame, item: str = "id") -> DataFrame:
    return suite.join(canonical, item)


def term_summaries(terms: DataFrame, summaries: DataFrame, term: str, lang: str, summary: str, order: Sequence[str] = ("ko", "en"),
                   closed: str = "은", opened: str = "는", min_chars: int = 20, max_chars: int = 220) -> DataFrame:
    """First summary of each distinct term by language preference, as an answer that names the term."""
    rank = F.lit(len(order))
    for i, g in reversed(list(enumerate(order))):
        rank = F.when(F.col(lang) == g, i).otherwise(rank)
    best = summaries.withColumn("_rank", rank).filter(F.col("_rank") < len(order)).groupBy(term).agg(F.min(F.struct("_rank", summary)).alias("s"))
    d = terms.select(term).distinct().join(best, term)
    s = X.first_sentence(F.col("s").getField(summary), max_chars)
    answer = F.when(F.contains(F.lower(s), F.lower(F.col(term))), s).otherwise(F.concat(X.with_particle(term, closed, opened), F.lit(" "), s))
    return d.select(term, answer.alias("answer")).filter(F.length("answer") >= min_chars)

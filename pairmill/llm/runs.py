"""Periodic runs of words: longest common extensions from suffix trees of a stretch and its reversal, started at Lyndon roots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.llm.common import bites, grams, mix

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
_BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of a list of numbers above 0, with an Euler tour of string depths.

    ``rank[i]`` orders suffix i (the end of the text sorts first); ``common(a, b)`` is the length of what the suffixes at
    two arrays of different places begin with alike: the depth of their lowest common ancestor, a range minimum of the tour.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self.size = len(text)
        self._tour(*self._grow(text, max(text) + 1))

    @staticmethod
    def _grow(text: list[int], width: int) -> tuple[dict[int, int], int, list[int], list[int]]:
        """Edges (node * width + first symbol: child), their width, and begin and end of the text on the edge into each node."""
        end = len(text)
        begin, stop, link, kids = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            inner = -1  # the last node made in this step, which still lacks its suffix link
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = kids.get(key)
                if child is None:
                    kids[key] = len(begin)
                    begin.append(i), stop.append(end), link.append(0)
                    if inner >= 0:
                        link[inner] = node
                        inner = -1
                else:
                    first = begin[child]
                    span = stop[child] - first
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    at = first + length
                    if text[at] == symbol:
                        if inner >= 0:
                            link[inner] = node
                        length += 1
                        break
                    split = len(begin)
                    begin.append(first), stop.append(at), link.append(0)
                    begin.append(i), stop.append(end), link.append(0)
                    kids[key], kids[split * width + symbol], kids[split * width + text[at]] = split, split + 1, child
                    begin[child] = at
                    if inner >= 0:
                        link[inner] = split
                    inner = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return kids, width, begin, stop

    def _tour(self, kids: dict[int, int], width: int, begin: list[int], stop: list[int]) -> None:
        """Depths in the order of a walk around the tree, children by their first symbols, and each suffix's place in it."""
        keys = np.fromiter(kids.keys(), np.int64, len(kids))
        order = np.argsort(keys)
        child = np.fromiter(kids.values(), np.int64, len(keys))[order].tolist()
        ptr = np.searchsorted(keys[order] // width, np.arange(len(begin) + 1)).tolist()
        depth, depths, leaf_depth, leaf_place = [0] * len(begin), [], [], []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:  # back at a node
                depths.append(depth[~v])
                continue
            d = depth[v]
            lo, hi = ptr[v], ptr[v + 1]
            if lo == hi:
                leaf_depth.append(d), leaf_place.append(len(depths))
            depths.append(d)
            for c in reversed(child[lo:hi]):
                depth[c] = d + stop[c] - begin[c]
                stack.append(~v), stack.append(c)
        self.rank = np.zeros(self.size, np.int64)
        self.rank[self.size - np.array(leaf_depth)] = leaf_place
        pad = -len(depths) % _BLOCK
        self.tour = np.array(depths + [self.size] * pad, np.int32).reshape(-1, _BLOCK)
        self.ahead = np.minimum.accumulate(self.tour[:, ::-1], axis=1)[:, ::-1].ravel()  # least from a place to its block's end
        self.behind = np.minimum.accumulate(self.tour, axis=1).ravel()
        self.table = [self.tour.min(axis=1)]
        self.tour = self.tour.ravel()
        while 2 << len(self.table) - 1 <= len(self.table[0]):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // _BLOCK, y // _BLOCK
        out = np.minimum(self.ahead[x], self.behind[y])
        near = np.flatnonzero(p == q)
        if len(near):
            at = np.minimum(x[near, None] + np.arange(_BLOCK), y[near, None])
            out[near] = self.tour[at].min(axis=1)
        far = np.flatnonzero(q - p > 1)
        if len(far):
            lo, hi = p[far] + 1, q[far]
            level = np.frexp(hi - lo)[1] - 1
            for k in np.unique(level).tolist():
                s = level == k
                i = far[s]
                out[i] = np.minimum(out[i], np.minimum(self.table[k][lo[s]], self.table[k][hi[s] - (1 << k)]))
        return out.astype(np.int64)


def _next_less(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, else one beyond any period, for all places but the last."""
    last = len(rank) - 1
    out, stack = [len(rank) * len(rank)] * last, []
    values = rank.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        if i < last:
            stack.append(i)
    return np.array(out, np.int64)


def stretch_runs(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of one list of numbers, by start and period.

    By the runs theorem the longest Lyndon word at some place of every run, in one order of the symbols or its reverse, is
    the run's root. The longest Lyndon word at i ends where the next smaller suffix starts, in the reverse order where the
    next greater one does, which then differs in a symbol; the two trees extend it both ways.
    """
    n = len(symbols)
    if n < max(least_length, least_exponent):
        return np.zeros((0, 3), np.int64)
    s = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(s)
    i = np.arange(n)
    start = np.concatenate([i, i])
    period = np.concatenate([_next_less(tree.rank) - i, _next_less(-tree.rank) - i])
    some = period * least_exponent <= n
    start, period = start[some], period[some]
    ahead = tree.common(start, start + period)
    del tree
    back = SuffixTree(s[::-1]).common(n - start, n - start - period)
    length = period + ahead + back
    some = length >= np.maximum(least_length, least_exponent * period)
    found = np.unique(np.stack([start - back, period, length], axis=1)[some], axis=0)
    return found[:, [0, 2, 1]]


def repeated_stretches(ids: np.ndarray, ptr: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """Stretches (begin, end) of the rows' words outside of which no run can lie.

    A run of period q has the same n words q places on, all along, with n = its least length less q. So each of its words
    is covered by such a group whose nearest copy is at most a part (1 / exponent) of the stretch away; all other words
    split the stretches, again and again until none is split. Equal words have equal groups, so no run is lost.
    """
    n = min(max(least_length, least_exponent * q) - q for q in range(1, least_length // least_exponent + 2))
    least = max(least_length, least_exponent)
    size = np.diff(ptr)
    begin, end = ptr[:-1][size >= least], ptr[1:][size >= least]
    while len(begin):
        size = end - begin
        cut = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(begin)), size)
        place = np.arange(cut[-1]) - cut[owner] + begin[owner]
        g, gptr = grams(ids[place].astype(np.uint64), cut, n, short=False)
        row = np.repeat(np.arange(len(begin)), np.diff(gptr))
        at = np.arange(len(g)) - gptr[row] + cut[row]
        g = mix(g ^ mix(row.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(g, kind="stable")
        one, two = order[:-1], order[1:]
        same = (g[one] == g[two]) & (row[one] == row[two])
        same &= (at[two] - at[one]) * least_exponent <= size[row[two]]
        near = np.zeros(len(g), bool)
        near[one[same]] = near[two[same]] = True
        edge = np.bincount(at[near], minlength=cut[-1] + 1) - np.bincount(at[near] + n, minlength=cut[-1] + 1)
        inside = np.cumsum(edge[:-1]) > 0
        first = inside & ~np.concatenate([[False], inside[:-1] & (owner[1:] == owner[:-1])])
        last = inside & ~np.concatenate([inside[1:] & (owner[1:] == owner[:-1]), [False]])
        b, e = place[first], place[last] + 1
        long = e - b >= least
        b, e = b[long], e[long]
        if len(b) == len(begin) and (b == begin).all() and (e == end).all():
            break
        begin, end = b, e
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _finder(column: int, into: str, least_length: int, least_exponent: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def find(batches):
        for b in bites(batches, column):
            texts = [(t or "").encode().split() for t in b.column(column).to_pylist()]
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
            ptr = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            keep = np.ones(len(ids), bool)
            runs = [[] for _ in texts]
            for lo, hi in repeated_stretches(ids, ptr, least_length, least_exponent):
                r = int(np.searchsorted(ptr, lo, "right")) - 1
                for s, length, q in stretch_runs(ids[lo:hi], least_length, least_exponent).tolist():
                    keep[lo + s + q : lo + s + length] = False
                    runs[r].append({"start": s + lo - int(ptr[r]), "length": length, "period": q})
            out = []
            for r, words in enumerate(texts):
                left = [words[k] for k in np.flatnonzero(keep[ptr[r] : ptr[r + 1]]).tolist()] if runs[r] else words
                out.append({"n_words": len(words), "runs": runs[r], "collapsed": b" ".join(left).decode()})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, into])

    return find


def find_runs(docs: DataFrame, text: str = "text", into: str = "_runs", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are split at ASCII white space. A run is a stretch of words with least period q, of ``least_length`` words and
    ``least_exponent`` (2 at least) periods or more, which no neighbouring word extends. The collapsed text has the words, joined by
    one space, that no run holds after its first q words. Null and blank texts have no words, no runs and the collapsed
    text ''. Each row is judged alone: repeated rows, null keys and further columns pass through, a column ``into`` is
    replaced. Nothing is shuffled; a task holds the trees of one stretch of one text at a time.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    rest = docs.drop(into)
    kind = T.StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return rest.mapInArrow(_finder(rest.columns.index(text), into, least_length, least_exponent), T.StructType([*rest.schema.fields, T.StructField(into, kind)]))


def repeat_tail(text: Column, key: Column) -> Column:
    """Plants runs for tests at scale: where h = crc32(key) has h % 10 = 0, words from a on repeat the p words after a.

    With n words and g = floor(h / 10): a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Words are joined by one space;
    other texts, and those of null keys, stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), F.transform(F.array(words), edited)[0]).otherwise(text)


def run_digests(runs: Column) -> dict[str, Column]:
    """Number of runs, the one of greatest exponent (first of ties), and digests of the list and of the collapsed text."""
    listed = runs["runs"]
    lines = F.transform(listed, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.aggregate(listed, F.get(listed, F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    return {
        "n_runs": F.size(listed).cast("long"),
        "start": best["start"], "length": best["length"], "period": best["period"],
        "exponent_milli": F.floor(best["length"] * 1000 / best["period"]).cast("long"),
        "runs_sha256": F.sha2(F.array_join(lines, ""), 256),
        "collapsed_sha256": F.sha2(runs["collapsed"], 256),
    }

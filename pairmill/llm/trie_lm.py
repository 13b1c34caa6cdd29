"""N-gram scores from an Elias-Fano trie: levels of monotone keys with quantised probabilities in memory-mapped files."""

from __future__ import annotations

import json
import math
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import Words, bites, local_path, shared_folder, stored

#: Taken from every count of a pair and given to the words that did not follow.
DISCOUNT = 0.75
#: Hash of the token that ends every text.
END = np.uint64(0x5851F42D4C957F2D)
#: Words of a file of the first level, tokens counted for a file of the second, distinct pairs that a task holds.
WORDS_PER_FILE, TOKENS_PER_FILE, HELD = 1 << 20, 1 << 22, 1 << 21
#: Bytes of text that are looked up together.
TEXT = 4 << 20
#: Words of the longest runs.
ORDER = 3
#: Stands for the key of a token whose run no level has.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


# ---------------------------------------------------------------- Elias-Fano sequence


def ef_build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a strictly increasing uint64 sequence: about 2 + log2(span / n) bits each, plus half a bit of directory.

    The upper parts stand in unary in ``high``, the lower ``bits`` of each key side by side in ``low``; ``zeros`` counts the
    zeros before each word of ``high``.
    """
    n, first = len(keys), keys[0] if len(keys) else np.uint64(0)
    rel = keys - first
    bits = max(0, (int(rel[-1]) + 1).bit_length() - n.bit_length()) if n else 0
    top = (rel >> np.uint64(bits)).astype(np.int64)
    marks = np.zeros((int(top[-1]) + n + 65) // 64 * 64 if n else 64, dtype=np.uint8)
    marks[top + np.arange(n)] = 1
    low = np.zeros((n * bits + 127) // 64 * 64, dtype=np.uint8)
    for k in range(bits):
        low[k : n * bits : bits] = (rel >> np.uint64(k)) & _ONE
    zeros = np.concatenate([[0], np.cumsum(64 - marks.reshape(-1, 64).sum(axis=1, dtype=np.int64))])
    pack = lambda a: np.packbits(a, bitorder="little").view(np.uint64)
    return {"meta": np.array([n, bits, first], dtype=np.uint64), "high": pack(marks), "low": pack(low), "zeros": zeros.astype(np.uint32)}


class EliasFano:
    """Searches in the arrays of ``ef_build``, many keys at a time."""

    def __init__(self, a: dict[str, np.ndarray]):
        n, bits, self.first = a["meta"]
        self.n, self.bits, self.high, self.low, self.zeros = int(n), int(bits), a["high"], a["low"], a["zeros"]

    def _zero(self, nth: np.ndarray) -> np.ndarray:
        """Place of the nth zero of ``high``, counted from 1; -1 for 0."""
        w = np.maximum(np.searchsorted(self.zeros, nth, side="left") - 1, 0)
        left, gaps = nth - self.zeros[w].astype(np.int64), ~self.high[w]
        at = w * 64
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(gaps & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left > c
            left -= c * on
            at += width * on
            gaps >>= (width * on).astype(np.uint64)
        return np.where(nth > 0, at, -1)

    def _bucket(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First key of each upper part and the first behind it: the ones between a zero and the next."""
        part = np.minimum(part, np.int64(self.zeros[-1]))
        start = self._zero(part) + 1
        lo = start - part
        w, s = start >> 6, (start & 63).astype(np.uint64)
        rest = ~(self.high[np.minimum(w, len(self.high) - 1)] >> s)
        with np.errstate(over="ignore"):
            run = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        over = (run >= 64 - s.astype(np.int64)) & (w < len(self.high))
        run[w >= len(self.high)] = 0
        if over.any():  # the run goes on in the next word
            last = np.minimum(part[over] + 1, np.int64(self.zeros[-1]))
            run[over] = self._zero(last) - last + 1 - lo[over]
        return np.minimum(lo, self.n), np.minimum(lo + run, self.n)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        w, s = at >> 6, (at & 63).astype(np.uint64)
        x = (self.low[w] >> s) | np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return x & np.uint64((1 << self.bits) - 1)

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of smaller keys, whether the key is there) for each key; successor search within the key's bucket."""
        rel = np.where(keys >= self.first, keys - self.first, np.uint64(0))
        part = np.minimum(rel >> np.uint64(self.bits), np.uint64(1 << 62)).astype(np.int64)
        want = rel & np.uint64((1 << self.bits) - 1)
        lo, hi = self._bucket(part)
        end = hi.copy()
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live], hi[live] = np.where(less, mid + 1, lo[live]), np.where(less, hi[live], mid)
        found = lo < end
        found[found] = self._lows(lo[found]) == want[found]
        low = keys < self.first
        lo[low], found[low] = 0, False
        return lo, found


# ---------------------------------------------------------------- files


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """A new file with the arrays; a repeated attempt writes another one."""
    os.makedirs(folder, exist_ok=True)
    path, heads, at = f"{folder}/{uuid.uuid4().hex}.level", {}, 0
    for k, a in arrays.items():
        heads[k] = (a.dtype.str, at, len(a))
        at += (a.nbytes + 7) // 8 * 8
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    return path


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    size = struct.unpack("<Q", raw[:8].tobytes())[0]
    heads = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(t).itemsize].view(t) for k, (t, at, n) in heads.items()}


class Level:
    """One level of the trie in several files of rising keys, opened when first needed."""

    def __init__(self, files: list[tuple[str, int, int]]):
        """``files``: (path, first key, number of keys) in order."""
        self.paths, self.open = [f[0] for f in files], {}
        self.firsts = np.array([f[1] for f in files], dtype=np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum([f[2] for f in files])]).astype(np.int64)

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def _file(self, f: int) -> tuple[EliasFano, dict[str, np.ndarray]]:
        if f not in self.open:
            arrays = map_arrays(self.paths[f])
            self.open[f] = (EliasFano(arrays), arrays)
        return self.open[f]

    def _each(self, which: np.ndarray):
        """(file, from, to) of the stretches of a rising array of file numbers."""
        cuts = np.flatnonzero(np.diff(which, prepend=-2, append=len(self.paths))) if len(which) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if which[a] >= 0:
                yield which[a], a, b

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of smaller keys in all files, whether the key is there, its probability if it is) for sorted keys."""
        pos, found, prob = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        for f, a, b in self._each(np.searchsorted(self.firsts, keys, side="right") - 1):
            ef, arrays = self._file(f)
            p, ok = ef.search(keys[a:b])
            pos[a:b], found[a:b] = p + self.offsets[f], ok
            if "prob" in arrays and ok.any():
                low, step = arrays["scale"]
                prob[a:b][ok] = 10.0 ** (low + step * arrays["prob"][p[ok]])
        return pos, found, prob

    def counts(self, places: np.ndarray) -> np.ndarray:
        """How often the entries at these rising places were seen."""
        out = np.zeros(len(places))
        for f, a, b in self._each(np.searchsorted(self.offsets, places, side="right") - 1):
            arrays, at = self._file(f)[1], places[a:b] - self.offsets[f]
            out[a:b] = arrays["count"][at] if "count" in arrays else arrays["cum"][at + 1] - arrays["cum"][at]
        return out


def quantised(logs: np.ndarray) -> dict[str, np.ndarray]:
    """Logarithms in 256 even steps between the least and the greatest."""
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return {"prob": np.rint((logs - low) / step).astype(np.uint8), "scale": np.array([low, step])}


class Tokens:
    """The texts of one batch in a trie: every token's key in the first level that is not given, on the way there all it meets.

    A key is the place of the context in the level below, times ``size``, plus the successor relative to its context: its rank
    among the successors that the level below has behind the same context without its first word.
    """

    def __init__(self, texts: pa.Array, levels: list[Level], kinds: bool = True):
        w = Words(texts)
        rows, m = len(w.ptr) - 1, len(w.hash)
        self.ptr = w.ptr + np.arange(rows + 1)
        self.hash = np.full(m + rows, END, dtype=np.uint64)
        at = np.arange(m) + w.rows
        self.hash[at] = w.hash
        first = np.zeros(m + rows, dtype=bool)
        first[self.ptr[:-1]] = True
        uniq, self.slot = np.unique(self.hash, return_inverse=True)
        ident, self.known, _ = levels[0].search(uniq)
        self.count = np.zeros(len(uniq))
        by_place = np.argsort(ident[self.known], kind="stable")
        self.count[np.flatnonzero(self.known)[by_place]] = levels[0].counts(ident[self.known][by_place])
        self.start = int(levels[0].offsets[-1])  # the last context is the start of a text
        self.size = np.uint64(self.start + 1)
        self.relative = np.where(self.known, ident, -1)[self.slot]
        self.context = np.where(first, self.start, np.roll(self.relative, 1))
        self.met = []
        for level in levels[1:]:
            keys, slot = np.unique(self.keys(), return_inverse=True)
            place, found, prob = level.search(keys)
            contexts, where = np.unique(self.context, return_inverse=True)
            live = np.maximum(contexts, 0).astype(np.uint64) * self.size
            begin = level.search(live)[0]
            if kinds:
                self.met.append((prob[slot], contexts, where, np.where(contexts >= 0, level.search(live + self.size)[0] - begin, 0)))
            place = np.where(found, place, -1)[slot]
            self.relative = np.where(place >= 0, place - begin[where], -1)
            self.context = np.where(first, -1, np.roll(place, 1))

    def keys(self) -> np.ndarray:
        """context * size + successor for every token that has both, else the largest number."""
        ok = (self.relative >= 0) & (self.context >= 0)
        with np.errstate(over="ignore"):
            return np.where(ok, self.context.astype(np.uint64) * self.size + self.relative.astype(np.uint64), NONE)


# ---------------------------------------------------------------- training


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _gathered(parts):
    """Sums of (keys, counts) parts, handed on whenever more than HELD distinct keys have come together."""
    held, n = [], 0
    for keys in parts:
        held.append(np.unique(keys, return_counts=True))
        n += len(held[-1][0])
        if n > HELD:
            k, c = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held, n = [(k, c)], len(k)
            if n > HELD // 2:
                yield k, c
                held, n = [], 0
    if n:
        yield _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def _word_counts(batches):
    def parts():
        for b in bites(batches, 0, TEXT):
            yield np.concatenate([Words(b.column(0)).hash, np.full(b.num_rows, END, dtype=np.uint64)])

    for keys, counts in _gathered(parts()):
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], ["h", "n"])


def _squeeze(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _expand(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


class Model:
    """Levels of words, pairs and longer runs. ``total``: training tokens, ``texts``: training texts."""

    def __init__(self, levels: list[Level], total: int, texts: int):
        self.levels, self.total, self.texts, self.distinct = levels, total, texts, int(levels[0].offsets[-1])

    def scores(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score, score.

        The base is p(w) = (c + 1) / (N + V + 1). Each level then gives max(c - d, 0) / c(v) + d T / c(v) * p of the level below
        for w behind the context v: c counts the run, c(v) the context, T its different successors - the stretch of the level that
        the pointers of v and of the next context bound. Where v is unknown, the level below stands.
        """
        t = Tokens(texts, self.levels)
        p = ((t.count + 1) / (self.total + self.distinct + 1))[t.slot]
        row = np.repeat(np.arange(len(t.ptr) - 1), np.diff(t.ptr))
        total = lambda x: np.bincount(row, weights=x, minlength=len(t.ptr) - 1)
        out = {"n_tokens": np.diff(t.ptr), "n_known": total(t.known[t.slot].astype(float)).astype(np.int64), "base_score": total(np.log10(p))}
        for below, (seen, contexts, where, kinds) in zip(self.levels[:-1], t.met, strict=True):
            times = np.zeros(len(contexts))
            real = (contexts >= 0) & ((contexts != t.start) | (below is not self.levels[0]))
            times[real] = below.counts(contexts[real])
            if below is self.levels[0]:
                times[contexts == t.start] = self.texts
            rest = np.where(times > 0, DISCOUNT * kinds / np.maximum(times, 1), 1.0)
            p = np.minimum(seen + rest[where] * p, 1.0)
        return {**out, "score": total(np.log10(p))}


def _parts(files: DataFrame) -> tuple[Level, list]:
    rows = sorted(files.collect(), key=lambda r: r["shard"])
    return Level([(r["path"], r["first"] % (1 << 64), r["n"]) for r in rows]), rows


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Model of all texts of ``docs``, runs of up to ``order`` words; its files stand below the shared folder, which all machines mount.

    Words are counted per task, summed by hash and written in files of about a million words each, ranges of the hash. Then level
    by level, runs are counted per task as numbers (context, successor), packed, and summed file by file. A file of pairs takes
    contexts of about four million tokens, and a context of any size spreads over as many files as it needs; a file of longer runs
    takes an even share of the contexts.
    """
    spark = docs.sparkSession
    folder = local_path(shared_folder(spark, "trie"))
    counts = stored(docs.select(text).mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    end = int(END.view(np.int64))
    sums = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum(F.when(F.col("h") == end, F.col("n"))).alias("d")).first()
    distinct, total, texts = sums["v"], sums["n"] or 0, sums["d"] or 0
    if not distinct:
        return Model([Level([])], 0, 0)
    bits = max(0, math.ceil(math.log2(distinct / WORDS_PER_FILE)))

    def words(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        n = t.column("n").to_numpy()[order]
        path = write_arrays(folder, {**ef_build(h[order]), "cum": np.concatenate([[0], np.cumsum(n)]).astype(np.uint64)})
        return pa.table({"shard": [t.column("shard")[0].as_py()], "path": [path], "first": h[order][:1].view(np.int64), "n": [len(h)], "sum": [int(n.sum())]})

    schema = "shard long, path string, first long, n long, sum long"
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    level, rows = _parts(stored(counts.withColumn("shard", shard).groupBy("shard").applyInArrow(words, schema), "words"))
    before = np.concatenate([[0], np.cumsum([r["sum"] for r in rows])]).astype(np.float64)
    levels, files = [level], max(1, math.ceil(total / TOKENS_PER_FILE))
    while len(levels) < order:
        levels.append(_runs(docs.select(text), levels, before, texts, files, folder, schema))
    return Model(levels, total, texts)


def _runs(docs: DataFrame, levels: list[Level], before: np.ndarray, texts: int, files: int, folder: str, schema: str) -> Level:
    """The level above ``levels``. ``before``: tokens in the files of the first level before each."""
    held = docs.sparkSession.sparkContext.broadcast((levels, before))
    size = np.uint64(int(levels[0].offsets[-1]) + 1)
    contexts = int(levels[-1].offsets[-1])

    def places(keys: np.ndarray) -> np.ndarray:
        """File of each key, rising with the key."""
        levels, before = held.value
        context, part = (keys // size).astype(np.int64), (keys % size).astype(np.float64) / float(size)
        if len(levels) > 1:
            return np.minimum((context + part) * files / contexts, files - 1).astype(np.int64)
        upto, own = np.full(len(keys), before[-1]), np.full(len(keys), float(texts))
        for f, a, b in levels[0]._each(np.minimum(np.searchsorted(levels[0].offsets, context, side="right") - 1, len(levels[0].paths))):
            if f < len(levels[0].paths):
                cum, at = levels[0]._file(f)[1]["cum"], context[a:b] - levels[0].offsets[f]
                upto[a:b], own[a:b] = before[f] + cum[at], cum[at + 1] - cum[at]
        return np.minimum((upto + own * part) * files / (before[-1] + texts), files - 1).astype(np.int64)

    def count(batches):
        def parts():
            for b in bites(batches, 0, TEXT):
                keys = Tokens(b.column(0), held.value[0], kinds=False).keys()
                yield keys[keys != NONE]

        for keys, n in _gathered(parts()):
            file = places(keys)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(file)) + 1, [len(file)]]) if len(file) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([int(file[a])]), pa.array([_squeeze(np.diff(keys[a:b], prepend=np.uint64(0)))], pa.binary()), pa.array([_squeeze(n[a:b])], pa.binary())], ["shard", "keys", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        k = np.concatenate([np.cumsum(_expand(x.as_py()), dtype=np.uint64) for x in t.column("keys")])
        c = np.concatenate([_expand(x.as_py()) for x in t.column("counts")])
        k, c = _summed(k, c)
        levels, _ = held.value
        uniq, slot = np.unique((k // size).astype(np.int64), return_inverse=True)
        own = np.full(len(uniq), float(texts))
        real = uniq < contexts
        own[real] = levels[-1].counts(uniq[real])
        counted = {"count": c.astype(np.min_scalar_type(int(c.max())))}
        path = write_arrays(folder, {**ef_build(k), **quantised(np.log10((c - DISCOUNT) / own[slot])), **counted})
        return pa.table({"shard": [t.column("shard")[0].as_py()], "path": [path], "first": k[:1].view(np.int64), "n": [len(k)], "sum": [int(c.sum())]})

    packed = docs.mapInArrow(count, "shard long, keys binary, counts binary")
    return _parts(stored(packed.groupBy("shard").applyInArrow(merge, schema), "runs"))[0]


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; null texts have the end token only.

    Rows are scored where they are read; tasks map the files of the model and touch what they look up.
    """
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in bites(batches, size=TEXT):
            s = held.value.scores(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()), pa.array(np.full(b.num_rows, held.value.total), pa.int64()), pa.array(s["base_score"]), pa.array(s["score"])],
                ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    counts = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
    logs = [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *counts, *logs])
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)

"""Helpers of the operators: tables, shared folder, word hashes of whole Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; everything else belongs to a word.
SPACE = frozenset(b" \t\n\x0b\x0c\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset (tests), below a folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="pairmill-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path of a shared folder that all machines mount; memory maps need such a folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"a mounted shared folder is needed, not {uri}")
    return uri


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and executors can be lost."""
    path = shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- word hashes

_STEP = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    out = []
    with np.errstate(over="ignore"):
        for base in (_MULT, inverse):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


@cache
def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        v[65:91] = v[97:123]
    return v


@cache
def _word_bytes(letters: bool) -> np.ndarray:
    """Which bytes belong to words: all but white space, or letters, digits and non-ASCII bytes only."""
    keep = np.ones(256, dtype=bool)
    for b in range(128):
        keep[b] = chr(b).isalnum() if letters else b not in SPACE
    return keep


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (shifts and odd multipliers), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of the texts of one Arrow batch.

    ``hash[k]`` is a 64-bit hash of word k, ``start``/``end`` its bytes in ``buf``; the words of
    row r are ``ptr[r]:ptr[r+1]``. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, letters: bool = False, lower: bool = True, prefixes: tuple[int, ...] = ()):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        self.buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.offs = offs
        keep, values = _word_bytes(letters), _byte_values(lower)
        hashes, starts, ends, pre = [], [], [], [[] for _ in prefixes]
        at, last = int(offs[0]), int(offs[-1])
        while at < last:
            to = self._cut(at, last, keep)
            h, s, e, p = self._slab(at, to, keep, values, prefixes)
            hashes.append(h), starts.append(s), ends.append(e)
            for k, x in enumerate(p):
                pre[k].append(x)
            at = to
        cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        self.hash, self.start, self.end = cat(hashes, np.uint64), cat(starts, np.int64), cat(ends, np.int64)
        self.prefix = [cat(p, np.uint64) for p in pre]
        self.ptr = np.searchsorted(self.start, offs, side="left")

    def _cut(self, at: int, last: int, keep: np.ndarray) -> int:
        """End of the slab that begins at ``at``: behind white space or a row's end, never inside a word."""
        to = min(at + _STEP, last)
        while to < last:
            row = self.offs[np.searchsorted(self.offs, to, side="right") - 1]
            gap = np.flatnonzero(~keep[self.buf[max(at, to - 4096) : to]])
            cut = max(int(row), max(at, to - 4096) + int(gap[-1]) + 1 if len(gap) else 0)
            if cut > at:
                return cut
            to = min(to + _STEP, last)
        return to

    def _slab(self, at, to, keep, values, prefixes):
        b = self.buf[at:to]
        w = keep[b]
        rows = self.offs[np.searchsorted(self.offs, at) : np.searchsorted(self.offs, to)] - at
        first = np.ones(len(b), dtype=bool)
        first[1:] = ~w[:-1]
        first[rows] = True
        last = np.ones(len(b), dtype=bool)
        last[:-1] = ~w[1:]
        last[rows[rows > 0] - 1] = True
        s, e = np.flatnonzero(w & first), np.flatnonzero(w & last) + 1
        size = max(_STEP, 1 << int(len(b)).bit_length()) + 1
        up, down = powers(size)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum(values[b] * up[: len(b)], out=sums[1:])
            of = lambda stop: mix((sums[stop] - sums[s]) * down[s] + (stop - s).astype(np.uint64))
            return of(e), s + at, e + at, [of(np.minimum(s + k, e)) for k in prefixes]

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words, and the row pointer; a shorter row has one run of all its words."""
        return grams(self.hash, self.ptr, n)


def grams(h: np.ndarray, ptr: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(ptr)
    runs = np.maximum(count - n + 1, (count > 0).astype(count.dtype) if short else 0)
    out = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(count)), runs)
    first = ptr[row] + (np.arange(out[-1]) - out[row])
    size = np.minimum(count, n)[row]
    padded = np.concatenate([h, np.zeros(n, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        g = np.zeros(len(first), dtype=np.uint64)
        for k in range(n):
            g = g * np.uint64(0xFF51AFD7ED558CCD) + np.where(k < size, padded[first + k], np.uint64(0))
        return mix(g + size.astype(np.uint64)), out


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def list_array(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))


def bites(batches, column: int = 1, size: int = 1 << 20):
    """The batches cut at rows into slices of about ``size`` bytes of text, so that work arrays stay small.

    Python workers outlive their tasks; what a task has freed goes back to the system at its end.
    """
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size, prepend=0)).tolist() if len(lengths) else []
        edges = [0, *[c for c in cuts if c], b.num_rows]
        for at, to in zip(edges, edges[1:], strict=False):
            yield b.slice(at, to - at)
        del b
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)

"""Counts of equal tokens inside a row, in Arrow batches: hashing costs a small part of sorting token arrays in the JVM."""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(toks: pa.ListArray):
    """The tokens of one row after the other, so that only one row's are Python objects at a time."""
    words, at = toks.flatten(), 0
    for n in toks.value_lengths().fill_null(0).to_pylist():
        yield words.slice(at, n).to_numpy(zero_copy_only=False).tolist()
        at += n


def most_frequent(toks: Column, n: int) -> Column:
    """``n`` most frequent tokens, first seen wins ties."""

    @F.arrow_udf("array<string>")
    def top(toks: pa.Array) -> pa.Array:
        counts = map(Counter, _rows(toks))  # in the order of first sight, which nlargest keeps
        return pa.array([heapq.nlargest(n, c, key=c.get) for c in counts], pa.list_(pa.string()))

    return top(toks)


def repeats(toks: Column) -> Column:
    """[n, top, big]: tokens, largest number of equal tokens, and of equal pairs of neighbours."""

    @F.arrow_udf("array<long>")
    def counted(toks: pa.Array) -> pa.Array:
        most = lambda x: max(Counter(x).values(), default=0)
        return pa.array([[len(k), most(k), most(zip(k, k[1:], strict=False))] for k in _rows(toks)], pa.list_(pa.int64()))

    return counted(toks)

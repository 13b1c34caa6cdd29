"""Readers that open files of a mounted store themselves: first lines of files, members of archives by their place.

Spark's own readers take whole files; these take what is asked for. Paths travel as rows, so the driver lists nothing.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.sources.files import discover
from pairmill.sources.jsonl import parsed_lines
from pairmill.schema import RAW_SCHEMA

#: Bytes of an archive whose members one task reads.
RANGE_BYTES = 64 << 20


def local(uri: str) -> str:
    """The path that all machines mount."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"a mounted folder is needed, not {uri}")
    return uri


def head_of(path: str, n: int) -> tuple[list[bytes], int]:
    """The first ``n`` lines of a file, as Spark's text reader splits them, and how many of its bytes were read."""
    lines: list[bytes] = []
    with open(path, "rb", buffering=0) as raw:
        # One character per byte, so that lines come out as they stand; \\r, \\n and \\r\\n end a line.
        text = io.TextIOWrapper(io.BufferedReader(raw), encoding="latin-1", newline=None)
        while len(lines) < n and (line := text.readline()):
            lines.append(line.removesuffix("\n").encode("latin-1"))
        return lines, raw.tell()


def head_lines(files: DataFrame, n: int) -> DataFrame:
    """(line, path, block, pos) of the first ``n`` lines of each file of ``files`` (path); nothing behind them is read."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                lines, _ = head_of(local(path), n)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array([path] * len(lines), pa.string()), pa.array([0] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64())],
                                                 names=["line", "path", "block", "pos"])

    raw = files.select("path").mapInArrow(run, "line binary, path string, block long, pos long")
    return raw.withColumn("line", F.make_valid_utf8(F.col("line").cast("string")))


def head_scan(spark: SparkSession, root: str, n: int, glob: str = "*", schema=RAW_SCHEMA) -> DataFrame:
    """As ``jsonl_scan``, of the first ``n`` lines of every file under ``root``."""
    files = discover(spark, root, glob, ()).select("path")
    return parsed_lines(head_lines(files, n), schema)


# ---------------------------------------------------------------- archives


def archive_index(archives: DataFrame) -> DataFrame:
    """(path, member, size, place) of the file members of each zip file of ``archives`` (path): only its directory is read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                with zipfile.ZipFile(local(path)) as z:
                    rows = [(path, m.filename, m.file_size, m.header_offset) for m in z.infolist() if not m.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "place"])

    return archives.select("path").mapInPandas(run, "path string, member string, size long, place long")


def read_members(index: DataFrame, max_bytes: int = 2_000_000, skip: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, member, size, status, content): every member of ``index`` that stands in no folder of ``skip``.

    Members are dealt out by stretches of ``range_bytes`` of their archive, so a large archive is read by many tasks, each
    seeking to its members. A member over ``max_bytes`` has status "oversize" and no content, one that cannot be unpacked "damaged".
    """
    low = F.concat(F.lit("/"), F.lower("member"))
    kept = index
    for s in skip:
        kept = kept.filter(~low.contains(f"/{s}/"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, part in f.groupby("path", sort=False):
                with zipfile.ZipFile(local(path)) as z:
                    for at in range(0, len(part), 64):
                        some = part.iloc[at : at + 64]
                        rows = []
                        for member, size in zip(some["member"], some["size"], strict=True):
                            status, content = "oversize", None
                            if size <= max_bytes:
                                try:
                                    status, content = "ok", z.read(member)
                                except (zipfile.BadZipFile, NotImplementedError, OSError, RuntimeError, EOFError):
                                    status = "damaged"
                            rows.append((path, member, size, status, content))
                        yield pd.DataFrame(rows, columns=["path", "member", "size", "status", "content"])

    # As many tasks as the members' bytes ask for: rows of an index are small, so their own size says nothing.
    tasks = max(1, -(-int(kept.agg(F.sum(F.least("size", F.lit(max_bytes)))).first()[0] or 0) // range_bytes))
    dealt = kept.withColumn("_stretch", F.floor(F.col("place") / range_bytes)).repartition(tasks, "path", "_stretch").sortWithinPartitions("path", "place")
    return dealt.select("path", "member", "size").mapInPandas(run, "path string, member string, size long, status string, content binary")


def write_archives(rows: DataFrame, folder: str, archive: str, member: str, text: str) -> DataFrame:
    """(path) of zip files under ``folder``, which all machines mount: one for each name in ``archive``, task and batch.

    A file's name holds its task's number and it is moved into place at last, so a task that runs again writes the same files.
    """
    root = local(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        for k, f in enumerate(frames):
            done = []
            for name, some in f.groupby(archive, sort=True):
                path = f"{root}/{name}__{part}-{k}.zip"
                with zipfile.ZipFile(f"{path}.{attempt}", "w", zipfile.ZIP_DEFLATED) as z:
                    for m, s in zip(some[member], some[text], strict=True):
                        z.writestr(m, s)
                os.replace(f"{path}.{attempt}", path)
                done.append(path)
            yield pd.DataFrame({"path": done})

    return rows.select(archive, member, text).mapInPandas(run, "path string")

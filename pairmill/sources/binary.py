"""Binary columns: character sets and archive members. Arrow batches, one record at a time per task."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character sets in the order tried; code and document extensions; skipped folders.
CHARSETS = ("utf-8", "utf-8-sig", "cp949", "cp1252", "latin-1")
CODE_EXTS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs",
             ".swift", ".kt", ".php", ".rb", ".sh")
DOC_EXTS = (".md", ".txt", ".rst")


def _decode(raw: bytes) -> str:
    for enc in CHARSETS:
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1", errors="replace")


def decode_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """Bytes to text. Valid UTF-8 stays in the JVM; only the other rows meet the charset list."""

    @F.pandas_udf("string")
    def other(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else _decode(bytes(b)))

    as_utf8 = F.col(source).cast("string")
    valid = F.is_valid_utf8(as_utf8)
    plain = F.when(valid, as_utf8)
    # The null passed for valid rows keeps their bytes out of the Python worker.
    decoded = F.coalesce(plain, other(F.when(~valid, F.col(source))))
    return df.withColumn(target, F.replace(F.replace(decoded, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def repo_of(path) -> "F.Column":
    """owner__repo__branch.zip -> owner/repo, else the file stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "__")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(stem)


def archive_members(archives: DataFrame, max_bytes: int = 2_000_000, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of zip files -> (path, member, size, status, content), one row per file member.

    A task reads one archive at a time and yields members in small batches; members over ``max_bytes`` have status "oversize" and
    no content, folders named in ``skip`` are left out, as in the source rules. For archives in a mounted store see
    ``mounted.read_members``, which spreads one archive over many tasks.
    """
    names = ["path", "member", "size", "status", "content"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        low = "/" + m.filename.lower()
                        if m.is_dir() or any(f"/{s}/" in low for s in skip):
                            continue
                        over = m.file_size > max_bytes
                        rows.append((path, m.filename, m.file_size, "oversize" if over else "ok", None if over else z.read(m)))
                        if len(rows) >= 64:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("path", "content").mapInPandas(unpack, "path string, member string, size long, status string, content binary")


def member_kind(name) -> "F.Column":
    low = F.lower(name)
    ext = F.regexp_extract(low, r"(\.[^./]+)$", 1)
    base = F.element_at(F.split(low, "/"), -1)
    return F.when(ext.isin(*CODE_EXTS), "code").when(ext.isin(*DOC_EXTS) | base.startswith("readme"), "doc").otherwise("other")

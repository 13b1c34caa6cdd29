"""Token counts through a stored cache: digests of content and of the tokenizer's version, one encoding per new content."""

from __future__ import annotations

import hashlib
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import bites, shared_folder, stored

CACHE_SCHEMA = "digest binary, n_tokens long"
#: A content that holds more than this part of all rows is joined by broadcast; there are fewer than ``1 / HOT_SHARE`` of them.
HOT_SHARE = 0.001


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece as library
    elif path.endswith(".json"):
        import tokenizers as library
    else:
        raise ValueError(f"neither a .json nor a .model file: {path}")
    return library


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and release, and the way of counting."""
    library = _library(path)
    said = f"{library.__name__} {library.__version__}, no special tokens added, no truncation"
    return hashlib.sha256(said.encode() + b"\0" + Path(path).read_bytes()).hexdigest()


@cache
def _counter(path: str):
    """Counts of a list of texts; one tokenizer per worker process."""
    library = _library(path)
    if path.endswith(".model"):
        model = library.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t, add_bos=False, add_eos=False)) for t in texts]
    model = library.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def same_text(text: Column) -> Column:
    """Content as most tokenizers see it: null is the empty text, nothing else is alike."""
    return F.coalesce(text, F.lit(""))


def _encode(path: str):
    def run(batches):
        for b in bites(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_counter(path)(b.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


class TokenCache:
    """Counts on disk: ``folder/version=<digest>`` has rows (digest of content, n_tokens), appended run by run.

    ``normal`` turns a text column into the content that is digested and encoded; texts of equal content must have equal
    counts. Runs at the same time may store a content twice, which changes no result.
    """

    def __init__(self, folder: str, tokenizer: str, normal=same_text):
        self.folder, self.tokenizer, self.normal = folder.rstrip("/"), tokenizer, normal
        self.path = f"{self.folder}/version={tokenizer_version(tokenizer)}"

    def rows(self, spark) -> DataFrame:
        """One row per stored content."""
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(self.path)
        return spark.read.schema(CACHE_SCHEMA).parquet(self.path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def add_missing(self, docs: DataFrame, text: str = "text") -> None:
        """Encodes each content of ``docs`` that the cache lacks once and appends its count.

        Contents are reduced to one per task before they are shuffled, so copies don't meet in one task. With something in the
        cache only the digests are compared first, and texts of known contents don't leave their task's input.
        """
        content = docs.select(self.normal(F.col(text)).alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
        known = self.rows(docs.sparkSession)
        if not known.isEmpty():
            missing = content.select("digest").distinct().join(known, "digest", "left_anti")
            content = content.join(stored(missing, "missing"), "digest", "left_semi")
        fresh = content.groupBy("digest").agg(F.first("content").alias("content"))
        fresh.mapInArrow(_encode(self.tokenizer), CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(self.path)


def count_tokens(docs: DataFrame, cache: TokenCache, text: str = "text", into: str = "_tokens") -> DataFrame:
    """``docs`` without ``text``, with a struct ``into``: n_bytes (UTF-8, of the raw text) and n_tokens.

    Every row gets its count from the cache, by digest, after ``cache.add_missing``. Null and empty texts have 0 bytes and
    the tokenizer's count of the empty text. Each row is kept, null keys, repeated rows and further columns (but ``into``,
    which is replaced) included. Contents that hold more than a part ``HOT_SHARE`` of the rows, of which there are fewer
    than 1,000, are joined by broadcast, the others by digest.
    """
    cache.add_missing(docs, text)
    rest = [c for c in docs.columns if c not in (text, into)]
    fields = F.struct(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(cache.normal(F.col(text)), 256)).alias("digest"))
    rows = stored(docs.select(*rest, fields.alias(into)), "digests")
    digest = F.col(f"{into}.digest")
    total = rows.count()
    hot = rows.groupBy(digest.alias("digest")).count().where(F.col("count") > max(1, total * HOT_SHARE)).select("digest")
    counts = cache.rows(docs.sparkSession)
    hot = stored(hot.join(counts, "digest"), "hot")
    some = rows.join(F.broadcast(hot), digest == hot["digest"])
    others = rows.join(F.broadcast(hot), digest == hot["digest"], "left_anti").join(counts, digest == counts["digest"])
    out = F.struct(F.col(f"{into}.n_bytes").alias("n_bytes"), F.col("n_tokens").alias("n_tokens")).alias(into)
    return some.select(*rest, out).unionByName(others.select(*rest, out))


def new_cache(spark, tokenizer: str | None = None) -> TokenCache:
    """An empty cache in the shared folder."""
    return TokenCache(shared_folder(spark, "token-counts"), tokenizer or default_tokenizer())

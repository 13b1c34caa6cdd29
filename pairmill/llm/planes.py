"""Token-id files: fixed-size blocks of ids as bit or byte planes, each compressed with zstandard, and a chunk index."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.llm.common import powers, bites, mix, shared_folder, stored

#: Ids of a block.
BLOCK = 1 << 16
MAGIC = b"PMPLANE1"
#: Distinct pieces of text whose ids a worker remembers; beyond, it starts anew.
CACHE = 500_000
END = 0
#: Texts of more bytes are encoded in one go, without pieces.
LONG = 8 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([32 < b < 127 and not chr(b).isalpha() for b in range(256)])
_RAW = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)


def _odd(buf: np.ndarray) -> np.ndarray:
    """Places of white space other than the six blanks, which the tokenizer may join with them."""
    found = [np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F))]
    for lead, rest in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,))):
        at = np.flatnonzero(buf[:-1] == lead)
        at = at[np.isin(buf[at + 1], rest)]
        if lead == 0xE2:  # not the dashes and quotes of the same range
            third = buf[np.minimum(at + 2, len(buf) - 1)]
            at = at[(third <= 0x8F) | (third >= 0xA8) & (third <= 0xAF) | (third == 0x9F)]
        found.append(at)
    return np.concatenate(found)


def pieces(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts at ``offs`` (first 0, last the length of ``buf``).

    The pre-tokenizer of byte-level BPE cuts a text at these places whatever stands around them: behind every word, before the last
    blank of a run in front of a word, behind that blank unless it is a space, and where an ASCII sign follows a letter.
    """
    word = ~_BLANK[buf]
    row = np.zeros(len(buf) + 1, dtype=bool)
    row[offs] = True
    before = np.concatenate([[False], word[:-1]])
    cut = row[:-1].copy()
    begins = np.flatnonzero(word & (~before | cut))
    behind = np.flatnonzero(word) + 1
    cut[behind[(behind < len(buf)) & ~word[np.minimum(behind, len(buf) - 1)]]] = True
    letter = _LETTER[buf]
    wide = np.flatnonzero(buf[:-1] == 0xC3)
    letter[wide[(buf[wide + 1] != 0x97) & (buf[wide + 1] != 0xB7)] + 1] = True
    cut[1:] |= letter[:-1] & _SIGN[buf[1:]]
    blank = begins[~row[begins]]
    cut[blank - 1] = True
    cut[blank[buf[blank - 1] != 32]] = True
    return np.flatnonzero(cut)


class Encoder:
    """The ids of whole texts. Pieces that always stand apart are encoded once and remembered by a 64-bit hash.

    With ``added``, an added token's content in a text (``<|endoftext|>``) is that token, as in the tokenizer's own ``encode``; texts
    with one are encoded whole. Without, it is text like other text.
    """

    def __init__(self, path: str, limit: int = CACHE, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        contents = sorted({t.content for t in self.tok.get_added_tokens_decoder().values() if t.content and (added or not t.special)})
        self.marks = "|".join(map(re.escape, contents))
        self.known: dict[int, bytes] = {}
        self.limit = limit

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            return []
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        buf = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        if not len(buf):
            return [np.zeros(0, dtype="<u4")] * n
        whole = np.zeros(n, dtype=bool)
        whole[np.searchsorted(offs, _odd(buf), side="right") - 1] = True
        whole |= np.diff(offs) > LONG
        if self.marks:
            whole |= pc.match_substring_regex(texts, self.marks).to_numpy(zero_copy_only=False)
        out: list = [None] * n
        for k in np.flatnonzero(whole):
            out[k] = np.frombuffer(self._ids([texts[int(k)].as_py()])[0], dtype="<u4")
        rest = np.flatnonzero(~whole)
        if len(rest) < n:
            texts = texts.take(pa.array(rest))
            for k, x in zip(rest, self.encode(texts), strict=True):
                out[k] = x
            return out
        start = pieces(buf, offs)
        stop = np.append(start[1:], len(buf))
        up, down = powers(1 << int(len(buf)).bit_length())
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_RAW[buf] * up[: len(buf)], dtype=np.uint64)])
            hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        uniq, first, slot = np.unique(hashes, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.known) > self.limit:
            self.known = {}
        new = [k for k, h in enumerate(keys) if h not in self.known]
        if new:
            raw = buf.tobytes()
            for k, ids in zip(new, self._ids([raw[start[first[k]] : stop[first[k]]].decode() for k in new]), strict=True):
                self.known[keys[k]] = ids
        found = [self.known[h] for h in keys]
        size = np.array([len(f) // 4 for f in found])
        flat, at = np.frombuffer(b"".join(found), dtype="<u4"), np.concatenate([[0], np.cumsum(size)])
        count = size[slot]
        ends = np.cumsum(count)
        ids = flat[np.arange(ends[-1]) + np.repeat(at[slot] - (ends - count), count)]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, offs)]
        return [ids[a:b] for a, b in zip(upto, upto[1:], strict=False)]


@cache
def encoder(path: str, added: bool = False) -> Encoder:
    """One per worker process, whatever the number of tasks it runs."""
    return Encoder(path, added=added)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (plane k: byte k of every id) or bit planes (plane k: bit k of every id), as many as the largest id needs."""
    need = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    if bits:
        return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(need)]
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(planes[:, k]).tobytes() for k in range((need + 7) // 8)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for k, p in enumerate(planes):
        a = np.frombuffer(p, dtype=np.uint8)
        if bits:
            a = np.unpackbits(a)[:n]
        ids |= a.astype(np.uint32) << np.uint32(k if bits else 8 * k)
    return ids


class Writer:
    """One file: magic, compressed planes block by block, the documents' ids and lengths, the chunk index as JSON, its length, magic.

    Chunk index: per block its offset, number of ids and the size of each plane; then where the document table lies.
    """

    def __init__(self, sink, bits: bool = False, block: int = BLOCK):
        import zstandard

        self.sink, self.bits, self.block = sink, bits, block
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.held, self.n_held, self.blocks, self.docs, self.lengths, self.n_ids = [], 0, [], [], [], 0
        self.at = sink.write(MAGIC)

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= 4 * self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        stop = len(ids) if all_ else len(ids) // self.block * self.block
        for k in range(0, stop, self.block):
            part = ids[k : min(k + self.block, stop)]
            packed = [self.pack(p) for p in to_planes(part, self.bits)]
            self.blocks.append([self.at, len(part), [len(p) for p in packed]])
            for p in packed:
                self.at += self.sink.write(p)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        table = self.pack(known.tobytes() + np.array([d or 0 for d in self.docs], dtype="<i8").tobytes() + np.array(self.lengths, dtype="<i8").tobytes())
        self.sink.write(table)
        index = json.dumps({"bits": self.bits, "n_ids": self.n_ids, "blocks": self.blocks, "docs": [self.at, len(table), len(self.docs)]}).encode()
        self.sink.write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_file(source) -> tuple[list, np.ndarray, object]:
    """(doc ids, lengths, iterator over the ids of the blocks) of one file; the source allows reads at any offset."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    source.seek(0, 2)
    end = source.tell()

    def at(offset: int, n: int) -> bytes:
        source.seek(offset)
        return source.read(n)

    tail = at(end - 16, 16)
    if tail[8:] != MAGIC or at(0, len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token planes")
    size = struct.unpack("<Q", tail[:8])[0]
    index = json.loads(at(end - 16 - size, size))
    offset, packed, n = index["docs"]
    raw = unpack(at(offset, packed))
    known, ids, lengths = np.frombuffer(raw[:n], np.uint8), np.frombuffer(raw[n : 9 * n], "<i8"), np.frombuffer(raw[9 * n :], "<i8")

    def blocks():
        for offset, count, sizes in index["blocks"]:
            raw = at(offset, sum(sizes))
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
            yield from_planes([unpack(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], count, index["bits"])

    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths, blocks()


def documents_of(source):
    """(doc id, start in the file, ids) of each document of a file, one after another; memory holds one block and one document."""
    docs, lengths, blocks = read_file(source)
    held, at, start = np.zeros(0, dtype=np.uint32), 0, 0
    for doc, n in zip(docs, lengths.tolist(), strict=True):
        parts, need = [], n
        while need:
            if at == len(held):
                held, at = next(blocks), 0
            take = min(need, len(held) - at)
            parts.append(held[at : at + take])
            at, need = at + take, need - take
        yield doc, start, np.concatenate(parts) if len(parts) != 1 else parts[0]
        start += n


def _open(uri: str, write: bool = False):
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
    if not write:
        return fs.open_input_file(path)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def write_files(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", bits: bool = False, added: bool = False) -> DataFrame:
    """Manifest (part, file, n_docs, n_ids) of files that hold the ids of all texts in ascending key order, nulls first.

    Each document's ids end with id 0; null texts are empty and have the end id only; rows that repeat a key stand in the
    order of their texts. ``added`` is the encoder's. The key is a long. Texts are dealt out by ranges of the key; each task writes one file under a new name, and
    the manifest names the files of the tasks that succeeded, so repeated attempts do no harm.
    """
    spark = docs.sparkSession
    folder = (folder or shared_folder(spark, "token-ids")).rstrip("/")

    def write(batches):
        part, uri = TaskContext.get().partitionId(), f"{folder}/part-{uuid.uuid4().hex}.planes"
        out = sink = None
        for b in bites(batches, size=1 << 20):
            if not b.num_rows:
                continue
            if out is None:
                sink = _open(uri, write=True)
                out = Writer(sink, bits)
            ids = encoder(tokenizer, added).encode(b.column(1))
            for doc, x in zip(b.column(0).to_pylist(), ids, strict=True):
                out.add(doc, np.append(x, np.uint32(END)))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": uri, "n_docs": len(out.docs), "n_ids": out.n_ids}], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ranged = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(key).sortWithinPartitions(key, text)
    return stored(ranged.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "manifest")


def _read(manifest: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(documents, first)`` of every file, ``first`` being the ids in all files before it; files are spread over the tasks."""
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    files = manifest.withColumn("first", before).select("part", "file", "first")

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                with _open(r["file"]) as source:
                    yield from rows(documents_of(source), r["first"])

    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "part").mapInArrow(read, schema)


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the files."""

    def rows(documents, first):
        held, size = [], 0
        for doc, start, ids in documents:
            held.append({"doc_id": doc, "start": first + start, "ids": ids})
            size += len(ids)
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _read(manifest, "doc_id long, start long, ids array<int>", rows)


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, from its decoded ids."""

    def rows(documents, first):
        held = []
        for doc, start, ids in documents:
            held.append((doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(held) == 10_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


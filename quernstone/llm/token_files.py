"""Token-ID files of patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents::

    magic "QPF1" | u32 docs | u64 ids | u32 blocks | u32 block size
    doc table:    i64 doc_id, u8 has_id, u64 first id (each as a column)
    block index:  u64 offset of each block in the body (plus the body's end)
    body:         blocks

A block holds up to ``BLOCK`` ids: u32 minimum | u8 width | u16 count - 1 | u16 exceptions | packed low bits |
u16 places and u32 whole values of the exceptions. Ids are stored as difference to the minimum in ``width`` bits, where
width covers the ``PERCENTILE`` of the block; larger differences go to the exception list. Any id range can be read by
seeking to its blocks. Numbers are little-endian.

Writing: documents are range-sorted by (doc_id, text hash); each task encodes its range and writes files of about
``ids_per_file`` ids to the shared folder under a name fixed by its place, first aside and then by a rename, so a
repeated task replaces a file with the same bytes. Small manifest rows give each file's place, and a running sum
over files the ids before it. Reading opens the files with Spark's binaryFile source.

Defined cases: null text encodes as empty (the end id alone); null doc_ids sort first and are kept; repeated
doc_ids follow each other; an empty table writes no file and reads back no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.text import HashMemo, column_bytes, column_words
from quernstone.runtime import new_folder, small_batches, staged

MAGIC, BLOCK, PERCENTILE = b"QPF1", 2048, 95
CACHE = 1_000_000  # distinct chunks that a worker keeps
LOWER = {i: i + 32 for i in range(65, 91)}
LOWER_BYTES = bytes(LOWER.get(i, i) for i in range(256))
CLOSING = b".,;:!?|*#$%&()[]{}"


# --- codec -------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each value, least significant bit first."""
    if width == 0:
        return b""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width == 0:
        return np.zeros(count, dtype=np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: width * count].reshape(count, width)
    full = np.zeros((count, 32), dtype=np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    diff = (ids - np.uint32(low)).astype(np.uint32)
    k = -(-len(diff) * PERCENTILE // 100) - 1
    width = int(np.partition(diff, k)[k]).bit_length()
    out = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.empty(0, dtype=np.int64)
    head = struct.pack("<IBHH", low, width, len(ids) - 1, len(out))
    return head + pack(diff, width) + out.astype("<u2").tobytes() + diff[out].astype("<u4").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    low, width, last, n_out = struct.unpack_from("<IBHH", data)
    count, at = last + 1, 9
    size = -(-width * count // 8)
    diff = unpack(bytes(data[at : at + size]), width, count)
    at += size
    places = np.frombuffer(data, "<u2", n_out, at)
    diff[places] = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    return diff + np.uint32(low)


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a shard file; ``ids`` is all documents' ids in order."""
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype("<u8") if lengths else np.empty(0, "<u8")
    index = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = MAGIC + struct.pack("<IQII", len(doc_ids), len(ids), len(blocks), BLOCK)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids) + first.tobytes()
    return head + table + index.tobytes() + b"".join(blocks)


class TokenFile:
    """A shard file in memory; decodes only the blocks that a range touches."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_ids, blocks, self.block = struct.unpack_from("<IQII", data, 4)
        at = 24
        ids = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.first = np.append(np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64), self.n_ids)
        at += 17 * docs
        self.index = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.empty(0, dtype=np.uint32)
        lo, hi = start // self.block, (end - 1) // self.block
        got = [decode_block(self.body[self.index[b] : self.index[b + 1]]) for b in range(lo, hi + 1)]
        return np.concatenate(got)[start - lo * self.block : end - lo * self.block]

    def documents(self, blocks_at_once: int = 64) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id, ids, crc32 of the ids) of each document, every block decoded once."""
        doc, crc, step = 0, 0, blocks_at_once * self.block
        for at in range(0, max(self.n_ids, 1), step):
            end = min(at + step, self.n_ids)
            some = self.ids(at, end).astype("<u4")
            pos = at
            while doc < len(self.doc_ids):
                upto = min(int(self.first[doc + 1]), end)
                crc = zlib.crc32(some[pos - at : upto - at].tobytes(), crc)
                pos = upto
                if int(self.first[doc + 1]) > end or (int(self.first[doc + 1]) == end and end < self.n_ids and int(self.first[doc + 1]) > upto):
                    break
                yield self.doc_ids[doc], int(self.first[doc]), int(self.first[doc + 1] - self.first[doc]), crc
                doc, crc = doc + 1, 0


# --- encoding texts ----------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts from the tokenizers library.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks between ASCII
    white space, one after the other; closing ASCII punctuation is a token run of its own. The library encodes each
    distinct chunk, many at once with a special token between them. Results lie in one array of ids; 64-bit hashes of
    chunks find their place there, so a batch is put together with array operations. The store is bounded: when it is
    full, it starts anew. This way is taken only for tokenizers whose pre-tokenizer removes white space (``by_chunk``), and
    for texts without special strings that lowering A-Z leaves normalised; other texts go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
        added = spec.get("added_tokens", [])
        lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.by_chunk = lower and any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "[^\\s" in s["pattern"].get("Regex", "") for s in steps)
        self.by_chunk &= bool(added) and all(t["special"] and t["content"].isascii() and not set(t["content"]) & set(" ") and not t["single_word"] for t in added)
        self.specials = [t["content"] for t in added]
        self.between, self.between_id = (added[0]["content"], added[0]["id"]) if added else ("", -1)
        self._reset()

    def _reset(self) -> None:
        self.memo = HashMemo(CACHE)  # chunk hash -> number
        self.cores: dict[bytes, bytes] = {}  # chunk without closing punctuation -> ids
        self.starts, self.sizes = np.zeros(CACHE + 1, np.int64), np.zeros(CACHE + 1, np.int64)
        self.store, self.used = np.zeros(CACHE * 4, np.uint32), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[bytes]) -> None:
        """Encode chunks without special strings into ``cores``."""
        groups = [parts[i : i + 64] for i in range(0, len(parts), 64)]  # short texts: the library's work grows faster than their length
        for some, ids in zip(groups, self._library([f"\n{self.between}\n".join([c.decode() for c in g]) for g in groups])):
            cuts = (np.flatnonzero(ids == self.between_id) * 4).tolist()
            raw = ids.tobytes()
            self.cores.update((c, raw[a:b]) for c, a, b in zip(some, [0, *[x + 4 for x in cuts]], [*cuts, len(raw)], strict=True))

    def _add(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Number new chunks and store their ids."""
        cut = []
        for c in chunks:
            core = c.rstrip(CLOSING)
            cut.append((core, c[len(core) :]) if core and 48 <= core[-1] < 128 and chr(core[-1]).isalnum() else (c, b""))
        want = dict.fromkeys(x for pair in cut for x in pair if x and x not in self.cores)
        self._learn(list(want))
        got = [self.cores[a] + (self.cores[b] if b else b"") for a, b in cut]
        sizes = np.array([len(g) // 4 for g in got], dtype=np.int64)
        first, n = len(self.memo), int(sizes.sum())
        while self.used + n > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + n] = np.frombuffer(b"".join(got), "<u4")
        self.starts[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(keys)] = sizes
        self.used += n
        self.memo.add(keys, np.arange(first, first + len(keys)))
        if len(self.cores) > CACHE // 8:
            self.cores.clear()

    def _plain(self, text: str, high: bool) -> bool:
        """Whether a text's chunks can be encoded on their own; ``high``: it has characters from U+0300 on, below which nothing combines."""
        if any(s in text for s in self.specials):
            return False
        return not high or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.translate(LOWER)))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        listed = [t or "" for t in texts.to_pylist()]
        raw, offsets = column_bytes(texts)
        high = np.diff(np.searchsorted(np.flatnonzero(raw >= 0xCC), offsets)) > 0
        plain = [self.by_chunk and self._plain(t, h) for t, h in zip(listed, high.tolist())]
        whole = iter(self._library([t for t, p in zip(listed, plain) if not p]))
        w = column_words(texts if all(plain) else pa.array([t for t, p in zip(listed, plain) if p], pa.large_string()))
        if not len(w.starts):
            made = iter([np.empty(0, np.uint32)] * len(w.sizes))
            return [next(made) if p else next(whole) for p in plain]
        keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.memo) + len(keys) > CACHE:
            self._reset()
        number, found = self.memo.find(keys)
        new = np.flatnonzero(~found)
        if len(new):
            data = w.raw.tobytes().translate(LOWER_BYTES)
            base = len(self.memo)
            self._add(keys[new], [data[a:b] for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())])
            number[new] = np.arange(base, base + len(new))
        number = number[inverse]
        sizes = self.sizes[number]
        total = np.cumsum(sizes)
        ids = self.store[np.repeat(self.starts[number] - (total - sizes), sizes) + np.arange(total[-1])]
        made = iter(np.split(ids, np.cumsum(w.per_text(sizes))[:-1]))
        return [next(made) if p else next(whole) for p in plain]


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One per worker process, so that caches last over tasks."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


# --- files -------------------------------------------------------------------------------------------------------


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all; ``folder`` is any URI that pyarrow opens, or a local path."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
    store.create_dir(path, recursive=True)
    aside = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(data)
    store.move(aside, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, *, end_id: int | None = 2, ids_per_file: int = 4_000_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files below ``folder``; the staged manifest of those files.

    Manifest: file, part, seq, docs, ids, base (ids in all files before).
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    end = np.array([] if end_id is None else [end_id], np.uint32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode
        part, seq, ids, lengths, held, total = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.qpf"
            put(folder, name, encode_file(ids, lengths, np.concatenate(held).astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["file", "part", "seq", "docs", "ids"])

        for batch in batches:
            for p, d, t in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                part = p
                ids.append(d)
                held += [t, end]
                lengths.append(len(t) + len(end))
                total += lengths[-1]
                if total >= ids_per_file:
                    yield flush()
                    seq, ids, lengths, held, total = seq + 1, [], [], [], 0
        if ids:
            yield flush()

    made = staged(ordered.mapInArrow(write, "file string, part int, seq int, docs long, ids long"), "tokens")
    # one row per file of millions of ids, so one running sum is small
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark, 256)
    schema = "file string, doc_id long, first long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["file"], pdf["content"]):
                got = list(TokenFile(data).documents())
                out = pd.DataFrame(got, columns=["doc_id", "first", "n_tokens", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                out.insert(0, "file", name)
                yield out

    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qpf").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = files.mapInPandas(read, schema)
    return docs.join(manifest.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_folder(spark: SparkSession) -> str:
    return new_folder(spark, "token-files")

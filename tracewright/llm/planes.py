"""Token ids in bit-plane shuffled files.

Ids are cut into fixed-size blocks.  A block is transposed into bit planes (or
byte planes): plane ``p`` holds bit ``p`` of every id, only as many planes as
the largest id of the block needs.  Each plane is compressed on its own with
zstandard, so that the slowly varying high planes shrink to almost nothing.
Byte planes are the default: on prose they came out smaller (1.33 bytes an id
against 1.54) and were written and read in less time.
A chunk index (position and length of every plane) and a document index (key
and number of ids of every document) close the file.

File, all numbers little-endian::

    b"TWPLANE1" | planes ... | zstd(index) | u64 index offset | u64 index length | b"TWPLANE1"

    index: u64 kind (1 bit, 8 byte) | u64 block | u64 ids | u64 blocks | u64 planes | u64 docs
           | blocks x u64 planes of the block
           | planes x (u64 offset, u64 length; length = raw size: stored raw)
           | docs x i64 key | docs x u8 key is null | docs x u64 ids of the document

A dataset is one file ("shard") per range of keys, in ascending order; the
manifest that the writer returns holds the number of ids of each shard, from
which global starts follow by one sum over shards.  Every attempt of a task writes
a file of its own name, and only the manifest of the attempt that counted names
it: a task that is run again, or twice at once, leaves files that nothing reads.

Edge cases: a null or empty text is a document with the end id alone; a null
key sorts first; rows that share a key are ordered by a hash of their text and
then by the text (so that their number is no limit of a shard), equal rows stay
side by side; a very long text is cut before blanks, where no token
crosses; an empty table gives no shards and no rows; further columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import scratch
from tracewright.llm.arrow import chunks, texts
from tracewright.llm.bpe import byte_alphabet

MAGIC = b"TWPLANE1"
BLOCK = 65_536
LEVEL = 3
#: Runs between blanks whose ids a worker process keeps; emptied when full.
CACHE_RUNS = 400_000

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_bytes", T.LongType())])


# --- blocks -----------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """Planes of a block of uint32 ids, least significant first."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    width = -(-bits // 8)
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == 8:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(width)]
    spread = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")[:, :bits]
    packed = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")
    return [p.tobytes() for p in packed]


def from_planes(planes: list[bytes], kind: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if kind == 8:
        raw = np.zeros((len(planes[0]), 4), np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").ravel()[:n]
    packed = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    spread = np.unpackbits(packed, axis=1, bitorder="little")
    width = -(-len(planes) // 8)
    if len(planes) % 8:
        spread = np.vstack([spread, np.zeros((8 * width - len(planes), spread.shape[1]), np.uint8)])
    low = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")
    raw = np.zeros((low.shape[0], 4), np.uint8)
    raw[:, :width] = low
    return raw.view("<u4").ravel()[:n]


class ShardWriter:
    """Streams ids of documents into one file."""

    def __init__(self, sink, kind: int = 8, block: int = BLOCK, level: int = LEVEL):
        import zstandard

        if kind not in (1, 8) or block % 8:
            raise ValueError("kind is 1 (bit planes) or 8 (byte planes), block a multiple of 8")
        self.sink, self.kind, self.block = sink, kind, block
        self.packer = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.per_block: list[int] = []
        self.index: list[tuple[int, int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for start in range(0, end, self.block):
            part = ids[start : min(start + self.block, end)]
            if len(part) < self.block:
                part = np.concatenate([part, np.zeros(self.block - len(part), "<u4")])
            planes = to_planes(part, self.kind)
            self.per_block.append(len(planes))
            for plane in planes:
                packed = self.packer.compress(plane)
                packed = packed if len(packed) < len(plane) else plane
                self.index.append((self.at, len(packed)))
                self.sink.write(packed)
                self.at += len(packed)
        self.pending = [ids[end:]]
        self.held = len(ids) - end

    def close(self) -> int:
        """Write the indexes; returns the size of the file."""
        self.flush(True)
        head = struct.pack("<6Q", self.kind, self.block, self.n_ids, len(self.per_block), len(self.index), len(self.keys))
        body = b"".join(
            [
                head,
                np.array(self.per_block, "<u8").tobytes(),
                np.array(self.index, "<u8").tobytes(),
                np.array([k or 0 for k in self.keys], "<i8").tobytes(),
                np.array([k is None for k in self.keys], "u1").tobytes(),
                np.array(self.lengths, "<u8").tobytes(),
            ]
        )
        packed = self.packer.compress(body)
        self.sink.write(packed + struct.pack("<2Q", self.at, len(packed)) + MAGIC)
        return self.at + len(packed) + 16 + len(MAGIC)


class ShardReader:
    """Random access to blocks, and a stream of documents."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        if size < 2 * len(MAGIC) + 16:
            raise ValueError("not a plane file: too short")
        source.seek(size - 24)
        at, length, magic = struct.unpack("<2Q8s", source.read(24))
        source.seek(0)
        if magic != MAGIC or source.read(8) != MAGIC:
            raise ValueError("not a plane file: wrong magic")
        source.seek(at)
        body = self.unpacker.decompress(source.read(length))
        self.kind, self.block, self.n_ids, blocks, planes, docs = struct.unpack_from("<6Q", body)
        pos = 48

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal pos
            got = np.frombuffer(body, kind, n, pos)
            pos += got.nbytes
            return got

        self.per_block = column("<u8", blocks)
        self.index = column("<u8", 2 * planes).reshape(-1, 2)
        self.first = np.concatenate([[0], np.cumsum(self.per_block)]).astype(int)
        keys, null, self.lengths = column("<i8", docs), column("u1", docs), column("<u8", docs)
        self.keys = [None if z else int(k) for k, z in zip(keys, null)]

    def read_block(self, b: int) -> np.ndarray:
        raw = self.block // 8 if self.kind == 1 else self.block
        span = self.index[self.first[b] : self.first[b + 1]]
        self.source.seek(int(span[0, 0]))
        held = memoryview(self.source.read(int(span[-1].sum() - span[0, 0])))
        planes = []
        for at, length in span - [span[0, 0], 0]:
            got = held[int(at) : int(at + length)]
            planes.append(bytes(got) if length == raw else self.unpacker.decompress(got, max_output_size=raw))
        return from_planes(planes, self.kind, min(self.block, self.n_ids - b * self.block))

    def crcs(self) -> Iterator[int]:
        """Unsigned crc32 of each document's ids, read block by block."""
        b, block = -1, np.zeros(0, "<u4")
        at = 0
        for length in map(int, self.lengths):
            crc = 0
            while length:
                if at == len(block):
                    b, at = b + 1, 0
                    block = self.read_block(b)
                take = min(length, len(block) - at)
                crc = zlib.crc32(block[at : at + take].tobytes(), crc)
                at, length = at + take, length - take
            yield crc

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = np.concatenate([self.read_block(b) for b in range(len(self.per_block))]) if len(self.per_block) else np.zeros(0, "<u4")
        ends = np.cumsum(self.lengths.astype(int))
        for key, length, end in zip(self.keys, self.lengths.astype(int), ends):
            yield key, ids[end - length : end]


# --- ids --------------------------------------------------------------------


class RunEncoder:
    """Ids of a byte-level vocabulary file by its own library, kept by runs between blanks.

    Byte-level split patterns attach one blank to the word behind it, so a text
    can be cut before any blank that a non-space character follows.  A run of
    plain Latin characters is split here, by the same pattern, and only words
    that are new go through the library's model; any other run goes through the
    library as a whole.  So do whole texts where the file names another split,
    a normaliser, or special tokens that do not begin with ``<|``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.known = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and spec.get("normalizer") is None and all(t["content"].startswith("<|") and not t.get("lstrip") and not t.get("rstrip") for t in spec.get("added_tokens", []))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.runs_seen: dict[str, bytes] = {}
        self.words_seen: dict[str, bytes] = {}
        self.loose = re.compile(r" (?=\s|\Z)").search
        self.cut = re.compile(r"(?= \S)").split
        self.odd = re.compile("[\u0250-\U0010ffff\x1c-\x1f]|<\\|").search
        numbers, letter = "0-9²³¹¼-¾", "[^\\W\\d_²³¹¼-¾]"
        other = f"(?:(?!{letter})[^\\s{numbers}])"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?[{numbers}]+| ?{other}+|\\s+(?!\\S)|\\s+").findall

    def word(self, word: str) -> bytes:
        shown = "".join([self.alphabet[b] for b in word.encode("utf-8")])
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def run(self, run: str) -> bytes:
        if self.odd(run):
            return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        seen, out = self.words_seen, []
        if len(seen) > CACHE_RUNS:
            seen.clear()
        for w in self.words(run):
            if (got := seen.get(w)) is None:
                got = self.word(w)
                if len(w) < 64:
                    seen[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "\x00" in text or self.loose(text) is not None:
            runs = self.cut(text)
        else:
            runs = text.replace(" ", "\x00 ").split("\x00")
        seen = self.runs_seen
        try:
            return b"".join(map(seen.__getitem__, runs))
        except KeyError:
            pass
        if len(seen) > CACHE_RUNS:
            seen.clear()
        out = []
        for r in runs:
            if (got := seen.get(r)) is None:
                got = self.run(r)
                if len(r) < 64:
                    seen[r] = got
            out.append(got)
        return b"".join(out)


_LOADED: dict[str, RunEncoder] = {}


def loaded(path: str) -> RunEncoder:
    if path not in _LOADED:
        _LOADED[path] = RunEncoder(path)
    return _LOADED[path]


# --- datasets ---------------------------------------------------------------


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(df: DataFrame, tokenizer: str, uri: str, key: str = "doc_id", column: str = "text", end_id: int = 0, kind: int = 8, block: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """Encode ``column`` and write shards in ascending ``key`` order; returns the manifest.

    One shuffle, by ranges of the key, so that shard numbers ascend with keys.
    The manifest is lazy: writing it (``scratch.store``) writes the shards.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = loaded(tokenizer), TaskContext.get().partitionId()
        end, writer, sink = np.array([end_id], "<u4").tobytes(), None, None
        name = f"shard-{shard:08d}-{uuid.uuid4().hex}.planes"
        store, root = filesystem(uri)
        for batch in batches:
            for part in chunks(batch, column):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(sink, kind, block, level)
                keys = part.column(part.schema.get_field_index(key)).to_pylist()
                for k, t in zip(keys, texts(part, column)):
                    writer.add(k, np.frombuffer(encoder.encode(t) + end, "<u4"))
        if writer is not None:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(writer.keys)]), pa.array([writer.n_ids]), pa.array([size])], names=MANIFEST.names)

    rows = df.select(F.col(key).cast("long").alias(key), column)
    order = [F.col(key).asc_nulls_first(), F.xxhash64(F.coalesce(column, F.lit(""))).asc(), F.col(column).asc_nulls_first()]
    return rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(kernel, MANIFEST)


def read(spark: SparkSession, manifest: DataFrame, uri: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Documents of the shards with global starts: key, start, n_tokens, ids_crc32 (and the ids)."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.BinaryType())] if ids else []))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(uri)
        for batch in batches:
            for file, start in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "start")]):
                with store.open_input_file(f"{root}/{file}") as source:
                    shard = ShardReader(source)
                    lengths = shard.lengths.astype(np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    cols = [pa.array(shard.keys, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(list(shard.crcs()), pa.int64())]
                    if ids:
                        cols.append(pa.array([x.tobytes() for _, x in shard.documents()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    # One row per shard: the sum over shards stays small however large the data.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("shard", "file", "start").repartitionByRange(tasks, "shard").mapInArrow(kernel, schema)


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``df`` below the shared folder and read the documents back."""
    spark = df.sparkSession
    uri = scratch.folder(spark, "planes")
    manifest = scratch.store(write(df, tokenizer, uri, **options), "planes-manifest")
    return read(spark, manifest, uri, options.get("key", "doc_id"))

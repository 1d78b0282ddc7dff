"""Alignment of two tokenizers over the same bytes.

Every text is encoded by a byte-level file (A) and by a piece model (B).  NumPy
works on the tokens of many texts at once: ends are the cumulative sums of token
bytes; places where both end (``intersect1d``) cut the bytes into groups;
``searchsorted`` gives every token its group and every A token the B tokens that
its bytes meet, and ``repeat`` expands these ranges into links.

How many documents hold a pair of ids linked is counted in two shuffles: by pair
and salt, then by pair, each summed before it is sent, so a pair of every
document is a few rows per task.  The counts go back to the documents' pairs by
a broadcast of checked size, or by a salted join.

Texts are encoded once: ids and pairs of a document are written to the shared
folder as an intermediate table.

Edge cases: null and empty texts, and texts whose tokens do not give
``space + text`` back (U+2581, characters that a file's normaliser changes),
have no tokens: zeros and an empty ``groups_sha256``; strings of special tokens
are plain text; repeated rows are documents each; rows without doc_id are
documents too; long texts are whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import scratch
from tracewright.llm.arrow import chunks, texts
from tracewright.llm.bpe import byte_alphabet
from tracewright.llm.planes import RunEncoder

#: Pairs with their counts (17 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 4_000_000
SALTS = 16
#: Runs kept with their ids.
CACHE_RUNS = 400_000
#: Bytes of texts aligned at once.
CHUNK_BYTES = 2_000_000


# --- ids and bytes ----------------------------------------------------------


class ByteLevel(RunEncoder):
    """Ids of a byte-level file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.tokenizer.get_vocab()
        self.tokens = np.empty(max(vocab.values()) + 1, object)
        self.tokens[:] = b""
        for token, i in vocab.items():
            self.tokens[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode("utf-8")

    def ids(self, spaced: str) -> np.ndarray:
        return np.frombuffer(self.encode(spaced), "<u4")


class Pieces:
    """Ids of a piece model that puts a space before the text.

    Where no piece holds a space behind another character, and the normaliser
    keeps texts as they are, runs between spaces are encoded apart and kept.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = np.empty(len(pieces), object)
        for i, p in enumerate(pieces):
            byte = re.fullmatch("<0x([0-9A-F]{2})>", p)
            self.tokens[i] = bytes([int(byte[1], 16)]) if byte else p.replace("▁", " ").encode("utf-8")
        probe = "  a ﬁ Ａ²é \tİẞ​\n "
        plain = not any(re.search("[^▁]▁", p) for p in pieces) and "▁" in pieces
        self.apart = plain and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.space = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()
        self.runs = re.compile(" +[^ ]+| +").findall
        self.loose = re.compile("  | \\Z").search
        self.seen: dict[str, bytes] = {"": self.space}

    def ids(self, spaced: str) -> np.ndarray:
        """``spaced`` is the space and the text."""
        if not self.apart or "▁" in spaced:
            return np.array(self.model.encode(spaced[1:]), "<u4")
        # A run loses its first space: the model puts it back.
        runs = spaced[1:].split(" ") if self.loose(spaced) is None else [r[1:] for r in self.runs(spaced)]
        seen = self.seen
        if len(seen) > CACHE_RUNS:
            seen.clear()
            seen[""] = self.space
        new = [r for r in set(runs) if r not in seen]
        if new:
            for r, got in zip(new, self.model.encode(new, num_threads=1)):
                seen[r] = np.array(got, "<u4").tobytes()
        return np.frombuffer(b"".join(map(seen.__getitem__, runs)), "<u4")


_LOADED: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def loaded(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    key = (path_a, path_b)
    if key not in _LOADED:
        _LOADED[key] = ByteLevel(path_a), Pieces(path_b)
    return _LOADED[key]


# --- alignment --------------------------------------------------------------


@dataclass(frozen=True)
class Links:
    """Groups of tokens, and links as indexes of tokens."""

    cuts: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Links:
    """Both sequences cover the same bytes; lengths are those of their tokens, all positive."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, ends_a - lengths_a, "right")
    last = np.searchsorted(ends_b, ends_a, "left")
    met = last - first + 1
    link_a = np.repeat(np.arange(len(ends_a)), met)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first, met)
    return Links(cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), link_a, link_b)


def _labels(n: int) -> np.ndarray:
    """Decimal ids, with each of the three signs that can follow one."""
    out = np.empty((3, n), object)
    for k, sign in enumerate(",|;"):
        out[k] = [f"{i}{sign}" for i in range(n)]
    return out


def group_texts(links: Links, ids_a: np.ndarray, ids_b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Tokens as text in the order of groups, A before B, each with the sign behind it."""
    n = len(links.cuts)
    first_a = np.searchsorted(links.group_a, np.arange(n + 1))
    first_b = np.searchsorted(links.group_b, np.arange(n + 1))
    out = np.empty(len(ids_a) + len(ids_b), object)
    ends_a = np.zeros(len(ids_a), np.int8)
    ends_a[first_a[1:] - 1] = 1
    ends_b = np.zeros(len(ids_b), np.int8)
    ends_b[first_b[1:] - 1] = 2
    out[np.arange(len(ids_a)) + first_b[links.group_a]] = labels[ends_a, ids_a]
    out[np.arange(len(ids_b)) + first_a[links.group_b + 1]] = labels[ends_b, ids_b]
    return out


ALIGNED = T.StructType(
    [
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)


def _aligned_texts(values: list[str], a: ByteLevel, b: Pieces, labels: np.ndarray) -> list[pa.Array]:
    """Columns of ``ALIGNED`` for some texts: ids of each, then all tokens as one sequence."""
    n = len(values)
    ids_a, ids_b, held = [], [], np.zeros(n, bool)
    for i, text in enumerate(values):
        if not text:
            continue
        spaced = " " + text
        x, y, want = a.ids(spaced), b.ids(spaced), spaced.encode("utf-8")
        if b"".join(a.tokens[x].tolist()) == want and b"".join(b.tokens[y].tolist()) == want:
            ids_a.append(x)
            ids_b.append(y)
            held[i] = True
    n_a, n_b, n_groups, n_links, n_pairs = (np.zeros(n, np.int64) for _ in range(5))
    digests = np.full(n, "", object)
    pairs = times = np.zeros(0, np.int64)
    if ids_a:
        n_a[held], n_b[held] = [len(x) for x in ids_a], [len(y) for y in ids_b]
        flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
        sizes_a, sizes_b = (np.array([len(t) for t in m.tokens], np.int64) for m in (a, b))
        links = align(sizes_a[flat_a], sizes_b[flat_b])
        # A text's last bytes end a group, so groups, tokens and links of texts follow one another.
        doc_of_a = np.repeat(np.arange(n), n_a)
        last_group = links.group_a[np.cumsum(n_a)[held] - 1] + 1
        n_groups[held] = np.diff(last_group, prepend=0)
        doc_of_link = doc_of_a[links.link_a]
        n_links = np.bincount(doc_of_link, minlength=n)
        shown = group_texts(links, flat_a, flat_b, labels)
        at = np.cumsum(n_a + n_b)
        for i in np.flatnonzero(held):
            digests[i] = hashlib.sha256("".join(shown[at[i] - n_a[i] - n_b[i] : at[i]].tolist())[:-1].encode()).hexdigest()
        # Equal links of a text meet once, with how often they occur.
        code = (doc_of_link * len(a.tokens) + flat_a[links.link_a].astype(np.int64)) * len(b.tokens) + flat_b[links.link_b]
        code, times = np.unique(code, return_counts=True)
        doc, pair = np.divmod(code, len(a.tokens) * len(b.tokens))
        n_pairs = np.bincount(doc, minlength=n)
        pairs = (pair // len(b.tokens) << 32) | pair % len(b.tokens)
    starts = pa.array(np.concatenate([[0], np.cumsum(n_pairs)]), pa.int32())
    return [
        *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)],
        pa.array(digests.tolist(), pa.string()),
        pa.ListArray.from_arrays(starts, pa.array(pairs, pa.int64())),
        pa.ListArray.from_arrays(starts, pa.array(times, pa.int32())),
    ]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Per row: the key, numbers of tokens, groups and links, their digest, and distinct pairs (A id above, B id below) with times."""
    schema = T.StructType([docs.schema[key], *ALIGNED.fields])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(path_a, path_b)
        labels = _labels(max(len(a.tokens), len(b.tokens)))
        for batch in batches:
            for part in chunks(batch, column, CHUNK_BYTES):
                found = _aligned_texts(texts(part, column), a, b, labels)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), *found], names=schema.names)

    return docs.select(key, column).mapInArrow(kernel, schema)


# --- counts -----------------------------------------------------------------


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold a pair, and whether no pair of its A id is held by more."""
    salted = rows.select(F.explode("pairs").alias("pair"), (F.spark_partition_id() % SALTS).alias("salt"))
    counts = salted.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("docs")).groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = scratch.store(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def report(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", column: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: its alignment, and its links against the counts of the corpus."""
    rows = aligned(docs, path_a, path_b, key, column).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.store(rows, "aligned")
    counts = scratch.store(pair_counts(rows), "pair-best")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    if counts.count() <= broadcast_rows:
        met = links.join(F.broadcast(counts), "pair")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    kept = rows.select("row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return kept.join(sums, "row", "left").select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")

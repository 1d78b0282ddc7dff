"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-bigrams (one or two words
left out) of the lower-cased text, and unigrams of word stems (the first four
and five letters, so that one weight serves all inflections), each counted as
present or absent, so a document has at most ``2 ** bits`` of them.  The proximal update keeps one
learning rate per coordinate and, through its L1 term, leaves most weights at
zero; the weights that remain are broadcast.  Their number is bounded by
``2 ** bits`` whatever the size of the corpus.

Training takes at most ``max_rows`` labelled rows per class, those with the
smallest seeded hash of their key (all rows where there are fewer), and of these
no more than have ``max_bytes`` of features per class in sum.  One Spark
task runs the passes over them, so that neither driver nor any other task holds
the sample.  Rows beyond the bound are not needed: held-out accuracy is tested.

Edge cases: null and empty texts score as the bias alone; null labels and keys
are never learnt from; with one class (or no labels) the score is the constant
0.0 (only clean rows, or none) or 1.0; a key with several labels counts once
for each, and rows that share key and text once; long texts are scored whole;
equal texts get equal scores; repeated rows and further columns pass through, but
a column of the name of the score is replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import columns
from tracewright.llm.arrow import chunks, texts

WORDS = re.compile(r"\w+").findall
#: Hashes of words that a worker process keeps; emptied when full.
CACHE_WORDS = 300_000
#: Lengths of the word beginnings that stand for a word's stem.
STEMS = (4, 5)
# Odd multipliers that tell the kinds of features apart.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    max_rows: int = 4000
    #: Bytes of features (four each, 2 ** bits features a text at most) that each class may give.
    max_bytes: int = 64 << 20
    epochs: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    #: L1 per square root of the rarer class's rows: the pull of chance on a feature grows so.
    l1: float = 2.5
    l2: float = 0.1
    seed: int = 11


class Hasher:
    """Feature numbers of a text."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.seen: dict[str, int] = {}
        self.hashes = np.zeros((1 << 16, 1 + len(STEMS)), np.uint64)

    def add(self, words: set[str]) -> None:
        from xxhash import xxh64_intdigest

        for w in words:
            if w not in self.seen:
                k = self.seen[w] = len(self.seen)
                if k == len(self.hashes):
                    self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                self.hashes[k] = [xxh64_intdigest(w.encode("utf-8")), *[xxh64_intdigest(w[:n].encode("utf-8"), n) for n in STEMS]]

    def words(self, text: str) -> np.ndarray:
        """One row per word: the hashes of the word and of its stems."""
        found = WORDS(text.lower())
        try:
            rows = np.fromiter(map(self.seen.__getitem__, found), np.int64, len(found))
        except KeyError:
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            self.add(set(found))
            rows = np.fromiter(map(self.seen.__getitem__, found), np.int64, len(found))
        return self.hashes.take(rows, axis=0)

    def features(self, text: str) -> np.ndarray:
        """Numbers of all grams, with repeats."""
        hashes = self.words(text)
        w = np.ascontiguousarray(hashes[:, 0])
        grams = [hashes.ravel() * MIX[0]]
        for gap in (1, 2, 3):
            if len(w) > gap:
                pair = (w[:-gap] * MIX[0]) ^ (w[gap:] * MIX[gap])
                grams.append((pair ^ (pair >> np.uint64(29))) * MIX[gap])
        return (np.concatenate(grams) >> self.shift).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights of the features that stay, and the bias.

    Each row is (distinct features, label); rows are visited in seeded order and
    both classes weigh the same in sum.
    """
    positive = sum(y for _, y in rows)
    rare = min(positive, len(rows) - positive)
    bar = s.l1 * math.sqrt(rare)
    weigh = {1: max(1.0, (len(rows) - positive) / positive), 0: max(1.0, positive / (len(rows) - positive))}
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(s.seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size, 0.0, bar)  # the bias is not held back
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    rows = [(np.append(f, size).astype(np.int64), y) for f, y in rows]
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            i, y = rows[k]
            w = weights(i)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
            g = (p - y) * weigh[y]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    used = np.flatnonzero(n[:size])
    w = weights(used)
    kept = w != 0
    return used[kept].astype(np.uint32), w[kept].astype(np.float32), float(weights(np.array([size]))[0])


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), key: str = "doc_id", column: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from labelled rows for which ``learn`` (on the key) holds."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn).select(key, F.col(label).cast("int").alias("_y"))
    marked = marked.withColumn("_h", F.xxhash64(F.lit(settings.seed), key))
    # Two distributed top-k: at most 2 * max_rows keys, so the join may broadcast them.
    picked = None
    for y in (0, 1):
        some = marked.where(F.col("_y") == y).distinct().orderBy("_h", key).limit(settings.max_rows)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select(key, F.coalesce(column, F.lit("")).alias(column)).join(F.broadcast(picked), key).select("_h", "_y", column)
    schema = T.StructType([T.StructField("i", T.BinaryType()), T.StructField("w", T.BinaryType()), T.StructField("bias", T.DoubleType()), T.StructField("n", T.LongType())])

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(settings.bits)
        for batch in batches:
            for part in chunks(batch, column):
                found = [np.unique(hasher.features(t)).tobytes() for t in texts(part, column)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["_h", "_y", "f"])

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left, bytes_left = [], {0: settings.max_rows, 1: settings.max_rows}, {0: settings.max_bytes, 1: settings.max_bytes}
        before = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                _, y, f = row
                if row == before or not left[y]:
                    continue  # the same key and text once more, or enough
                before, left[y], bytes_left[y] = row, left[y] - 1, bytes_left[y] - len(f)
                if bytes_left[y] >= 0:
                    rows.append((np.frombuffer(f, np.uint32), y))
                else:
                    left[y] = 0
        ys = {y for _, y in rows}
        if len(ys) < 2:
            bias = math.inf if ys == {1} else -math.inf
            i, w = np.zeros(0, np.uint32), np.zeros(0, np.float32)
        else:
            i, w, bias = fit(rows, settings)
        yield pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias]), pa.array([len(rows)])], names=schema.names)

    hashed = sample.mapInArrow(featurize, "_h long, _y int, f binary").repartition(1).sortWithinPartitions("_h", "_y", "f")
    got = hashed.mapInArrow(learn_all, schema).first()
    if got is None:  # nothing to learn from
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), -math.inf
    return np.frombuffer(got["i"], np.uint32), np.frombuffer(got["w"], np.float32), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: Settings = Settings(), column: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights, bias = shared.value
        dense = np.zeros(1 << settings.bits, np.float32)
        dense[numbers] = weights
        hasher = Hasher(settings.bits)
        for batch in batches:
            for part in chunks(batch, column):
                found = []
                for t in texts(part, column):
                    f = hasher.features(t)
                    hits = np.unique(f[dense[f] != 0])
                    margin = bias + float(dense[hits].astype(np.float64).sum())
                    found.append(float(bias > 0) if math.isinf(bias) else 1 / (1 + math.exp(-max(-35.0, min(35.0, margin)))))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in kept], pa.array(found, pa.float64())], names=schema.names)

    return docs.mapInArrow(kernel, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, ~held_out(), settings)
    got = score(docs.select("doc_id", "text"), model, settings)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    model = train(docs, labels, ~held_out(), settings)
    scored_docs = score(columns.pack(docs, ["text"]), model, settings, out="_toxicity")
    return columns.unpack(scored_docs.where(F.col("_toxicity") < threshold), docs.columns, ["text"])

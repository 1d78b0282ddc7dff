"""Byte-pair encoding and decoding with a contiguous rank array.

A word is an array of part boundaries beside an array of the ranks of adjacent
part pairs.  The smallest rank is found by a scan, its right boundary deleted
and the two neighbouring ranks refreshed, until no pair has a rank.  Words are
short, so the scan beats a heap, and the ids of frequent words are kept in a
bounded table per worker process.  Only a word of over ``LONG_WORD`` parts, for
which the scans would add up to a square, takes a heap, with the same ids.

The vocabulary file (model "BPE" of the tokenizers JSON format, byte level,
end-of-word suffix) is a parameter.  Its normaliser (NFC, white space to one
blank, lower case) and its split pattern are followed exactly; added special
tokens in a text become their ids, as in the library.

Edge cases: a null or empty text has no ids and decodes to ''.  Very long texts
are encoded whole.  Further columns, ties and repeated rows pass through
untouched, but a column of the name of an added one is replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm.arrow import chunks, texts

#: Words whose ids a worker process keeps; the table is emptied when full.
CACHE_WORDS = 400_000
NO_RANK = sys.maxsize
#: Parts of a word above which a heap replaces the scan.
LONG_WORD = 256
#: Below this code point the letter, digit and case tables of every library agree.
PLAIN_BELOW = "ɐ"


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(kept))
    return [shown[b] for b in range(256)]


def merge_word(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Parts of one word after all merges.

    ``bounds`` are start positions in ``parts`` (with the end); ``near[i]`` is
    the rank of the pair that starts at ``bounds[i]``.
    """
    n = len(parts)
    if n < 2:
        return parts
    bounds = list(range(n + 1))
    rank_of = ranks.get
    near = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
    parts = list(parts)
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        a, b = bounds[i], bounds[i + 1]
        parts[a] += parts[b]
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = rank_of((parts[a], parts[bounds[i + 1]]), NO_RANK)
        if i:
            near[i - 1] = rank_of((parts[bounds[i - 1]], parts[a]), NO_RANK)
    return [parts[b] for b in bounds[:-1]]


def merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """As ``merge_word``, for words too long for a scan per merge: a heap of ranks over linked parts."""
    parts, n = list(parts), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = ranks.get
    heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := rank_of((parts[i], parts[i + 1]))) is not None]
    heapify(heap)

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (rank := rank_of((parts[i], parts[j]))) is not None:
            heappush(heap, (rank, i, parts[i], parts[j]))

    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if j >= n or parts[i] != left or parts[j] != right:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = left + right, ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        import regex

        self.words = regex.compile(pattern).findall
        # The same pattern for plain texts: letters and numbers spelt out for the faster engine.
        numbers = "0-9²³¹¼-¾"
        letters = "[^\\W\\d_²³¹¼-¾]"
        self.plain_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|" + letters + "+|[" + numbers + f"]|(?:(?!{letters})[^\\s{numbers}])+").findall
        self.odd = re.compile(f"[{PLAIN_BELOW}-\U0010ffffİ\x1c-\x1f]").search
        self.separators = re.compile("[\x1c-\x1f]").search
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: Ids of words, and of whole runs between white space.
        self.words_seen: dict[str, bytes] = {}
        self.runs_seen: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Little-endian 32-bit ids of one word."""
        shown = [self.alphabet[b] for b in word.encode("utf-8")]
        shown[-1] += self.suffix
        vocab = self.vocab
        merge = merge_word if len(shown) <= LONG_WORD else merge_long
        return array("I", [vocab[p] for p in merge(shown, self.ranks)]).tobytes()

    def split(self, text: str) -> list[str]:
        if self.odd(text) is None:
            return self.plain_words(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Case is mapped character by character: no context rule for a final sigma.
        return self.words("".join([c.lower() for c in text]))

    def run(self, text: str) -> bytes:
        """Ids of a text that holds no white space, or of one with rare separators."""
        if "<|" in text and len(pieces := self.stops.split(text)) > 1:
            return b"".join([array("I", [self.special[p]]).tobytes() if i % 2 else self.run(p) for i, p in enumerate(pieces)])
        seen, out = self.words_seen, []
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in self.split(text):
            if (got := seen.get(w)) is None:
                got = self.word(w)
                if len(w) < 64:
                    seen[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text: no word of the split pattern crosses white space."""
        if self.separators(text):  # white space for str.split(), not for the pattern
            return self.run(text)
        runs, seen = text.split(), self.runs_seen
        try:
            return b"".join(map(seen.__getitem__, runs))
        except KeyError:
            pass
        if len(seen) > CACHE_WORDS:
            seen.clear()
        out = []
        for r in runs:
            if (got := seen.get(r)) is None:
                got = self.run(r)
                if len(r) < 64:
                    seen[r] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (little-endian 32-bit binary) and, on demand, the decoded text."""
    out = T.StructType([f for f in df.schema.fields if f.name not in (ids, decoded)] + [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    kept = [f for f in df.columns if f not in (ids, decoded)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in chunks(batch, column):
                got = [bpe.encode(t) for t in texts(part, column)]
                cols = [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(got, pa.binary())]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return df.mapInArrow(kernel, out)


def digests(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Per row: number of ids, digests of the ids and of the text decoded from them."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in chunks(batch, column):
                n, ids, back = [], [], []
                for t in texts(part, column):
                    got = bpe.encode(t)
                    n.append(len(got) // 4)
                    ids.append(hashlib.sha256(got).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(got).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=schema.names)

    return df.select(key, column).mapInArrow(kernel, schema)

"""Fuzzy search for short licence notices.

Base labels come from exact phrases of words.  The method adds notices that
were edited: a notice that may differ in up to ``k`` characters is split into
``k + 1`` pieces, and by the pigeonhole principle at least one piece occurs
unchanged in every acceptable place.  One Aho-Corasick automaton finds the
pieces of all notices; around each hit, unless it holds too few of the notice's
runs of three letters for ``k`` errors, the ``regex`` library checks the whole
notice with at most ``k`` errors and reports where it lies and how many errors
it took.

Notices that differ from a neighbour in one word (of the MIT, BSD or ISC
license; by-nc, by-sa) are as near to it as to an edited copy of themselves, so
such a telling word must be in the place: unchanged if it has three letters or
fewer, with one edit at most if it has more.  Versions do not tell licences apart.

Texts are compared as words (runs of ASCII letters and digits and of any other
characters above ASCII; A-Z lower-cased) joined by one blank, so line breaks
and punctuation inside a notice do not count as errors.

Edge cases: a null or empty text has no words, no labels and score 0; equal
rows and ties give equal results; long texts are searched whole; of overlapping
places of one notice the one with the fewest errors stays, the first on ties;
other columns pass through, but a column of the name of an added one is replaced;
an empty table stays empty.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm.arrow import chunks, texts

#: Phrases that label a text by themselves.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices, in the words that are compared, and their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("released under the bsd license", "bsd"),
    ("released under the isc license", "isc"),
    ("released under the zlib license", "zlib"),
)

GNU_RIVALS = "lesser affero library"
#: What tells a notice from its neighbours: words that its place must hold, and words that stand neither in it nor right behind it.
TELLING = {
    "this work is licensed under the gnu general public license": ("gnu general", GNU_RIVALS),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": ("gnu", GNU_RIVALS),
    "gnu lesser general public license": ("gnu lesser", ""),
    "gnu affero general public license": ("gnu affero", ""),
    "licensed under the apache license version 2 0": ("apache", ""),
    "released under the mit license": ("mit", ""),
    "this source code form is subject to the terms of the mozilla public license": ("mozilla", ""),
    "licensed under a creative commons attribution": ("attribution", "noncommercial non sharealike share noderivatives noderivs no"),
    "licensed under cc by nc 4 0": ("cc by nc", "sa nd"),
    "licensed under cc by sa 4 0": ("cc by sa", "nc nd"),
    "licensed under cc by nd 4 0": ("cc by nd", "nc sa"),
    "licensed under cc by nc sa 4 0": ("cc by nc sa", "nd"),
    "licensed under cc by nc nd 4 0": ("cc by nc nd", "sa"),
    "released under the bsd license": ("bsd", ""),
    "released under the isc license": ("isc", ""),
    "released under the zlib license": ("zlib", ""),
}

# Words: everything but ASCII other than digits and letters; A-Z become a-z.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


@dataclass(frozen=True)
class Place:
    """Where a notice lies, in words, with its errors."""

    label: str
    notice: int
    first_word: int
    last_word: int
    errors: int


class Scanner:
    """Phrases and notices compiled for a worker process."""

    def __init__(self, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], share: float):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = notices
        self.errors, self.patterns, self.grams, self.telling = [], [], [], []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, _) in enumerate(notices):
            k = max(1, int(len(notice) * share))
            self.errors.append(k)
            self.grams.append([notice[i : i + 3] for i in range(len(notice) - 2)])
            needs, rivals = TELLING.get(notice, ("", ""))
            self.telling.append(([regex.compile(regex.escape(w) if len(w) <= 3 else f"(?:{regex.escape(w)}){{e<=1}}") for w in needs.split()], set(rivals.split())))
            self.patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"))
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(notice[a:b], []).append((n, a))
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def base(self, joined: bytes) -> dict[str, list[int]]:
        """Word positions of every phrase; ``joined`` has a blank at both ends."""
        found: dict[str, list[int]] = {}
        for phrase, label in self.phrases:
            at, seen, words = joined.find(phrase), 0, 0
            while at >= 0:
                words += joined.count(b" ", seen, at)
                seen = at
                found.setdefault(label, []).append(words)
                at = joined.find(phrase, at + 1)
        return found

    def verify(self, n: int, text: str, starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, errors) of notice ``n`` near the places where a seed lets it start.

        Every seed's own window is searched: it is too short for two places side
        by side.  Overlapping places are then settled: fewest errors, then first.
        """
        notice, k = self.notices[n][0], self.errors[n]
        found: dict[tuple[int, int], int] = {}
        at = text.find(notice)
        while at >= 0:
            found[at, at + len(notice)] = 0
            at = text.find(notice, at + 1)
        same = sorted(a for a, _ in found)
        for start in dict.fromkeys(starts):
            near = bisect.bisect_left(same, start - k)
            if near < len(same) and same[near] <= start + k:
                continue  # an unchanged place, known already
            a, b = max(0, start - k), min(len(text), start + len(notice) + 2 * k)
            here = {text[i : i + 3] for i in range(a, b - 2)}
            if sum(map(here.__contains__, self.grams[n])) < len(self.grams[n]) - 3 * k:
                continue  # every error spoils three runs of three letters at most
            hit = self.patterns[n].search(text, a, b)
            if hit is not None:
                found[hit.span()] = sum(hit.fuzzy_counts)
        kept: list[tuple[int, int]] = []
        for span in sorted(found, key=lambda s: (found[s], s)):
            i = bisect.bisect_left(kept, span)
            if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or span[1] <= kept[i][0]):
                kept.insert(i, span)
        return [(a, b, found[a, b]) for a, b in kept]

    def told(self, place: Place, words: list[str]) -> bool:
        """Whether a place holds the words that tell its notice from others."""
        needs, rivals = self.telling[place.notice]
        here = words[place.first_word : place.last_word + 1]
        return all(any(need.fullmatch(w) for w in here) for need in needs) and rivals.isdisjoint(words[place.first_word : place.last_word + 2])

    def fuzzy(self, joined: str) -> list[Place]:
        """Best places of the notices, in order."""
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(joined):
            for n, offset in uses:
                starts.setdefault(n, []).append(end + 1 - size - offset)
        places: list[Place] = []
        if not starts:
            return places
        blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32).tolist()
        for n, seeds in starts.items():
            for start, end, errors in self.verify(n, joined, seeds):
                first = bisect.bisect_right(blanks, start)
                places.append(Place(self.notices[n][1], n, first, max(first, bisect.bisect_left(blanks, end)), errors))
        return sorted(places, key=lambda p: (p.first_word, p.notice))


@lru_cache(4)
def scanner(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], share: float) -> Scanner:
    return Scanner(phrases, notices, share)


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("errors", T.LongType())])
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(SPAN)),
]


def scan_text(text: str, tool: Scanner) -> tuple:
    """Values of the added columns for one text."""
    words = text.encode("utf-8").translate(FOLD).split()
    joined = b" ".join(words)
    base = tool.base(b" " + joined + b" ")
    places = tool.fuzzy(joined.decode("utf-8"))
    if places:
        named = joined.decode("utf-8").split(" ")
        places = [p for p in places if tool.told(p, named)]
    at = sorted(x for found in base.values() for x in found)
    best = max([1.0 if at else 0.0, *[1 - p.errors / len(tool.notices[p.notice][0]) for p in places]])
    spans = [{"label": p.label, "first_word": p.first_word, "last_word": p.last_word, "errors": p.errors} for p in places]
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted({*base, *[p.label for p in places]})), best, spans


def scan(df: DataFrame, column: str = "text", phrases: dict[str, str] | None = None, notices: tuple[tuple[str, str], ...] = NOTICES, share: float = 0.1) -> DataFrame:
    """Add labels, spans (in words, from 0) and scores.

    ``share``: errors that a notice may have, as a share of its characters (one at least).
    """
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in ADDED}]
    schema = T.StructType([*kept, *ADDED])
    wanted = tuple((PHRASES if phrases is None else phrases).items())
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64())]))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner(wanted, notices, share)
        for batch in batches:
            for part in chunks(batch, column):
                rows = [scan_text(t, tool) for t in texts(part, column)]
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=schema.names)

    return df.mapInArrow(kernel, schema)


def report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

"""Alignment of two tokenizers against a plain walk over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import alignment
from tracewright.llm.registry import tokenizer

PATHS = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, pairs string, pair int, times int, docs string, best string, salt int, n_a string"
TEXTS = [
    "Alpha beta, gamma: 12,345 deltas.",
    None,
    "",
    " ",
    "two  blanks and a tail ",
    "  lead",
    "line\n\nbreaks\r\n\ttabs\x1c\x85\xa0.",
    "naïve café Ñandú — 東京タワー 😀👩‍👩‍👧 ﬁ Ａ²",
    "a▁b",
    "<|endoftext|> and <s> </s> <unk> <0x0A>",
    "Alpha beta, gamma: 12,345 deltas.",
    "x" * 3000,
    "the " * 5000,
    "\x00nul",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(libraries, values):
    """The whole report, token by token."""
    a, b = libraries
    alphabet = {c: i for i, c in enumerate(alignment.byte_alphabet())}
    docs = []
    for text in values:
        if not text:
            docs.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(None)
            continue
        groups, links, i, j, at_a, at_b = [([], [])], [], 0, 0, 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            end_a, end_b = at_a + len(bytes_a[i]), at_b + len(bytes_b[j])
            if end_a <= end_b:
                groups[-1][0].append(ids_a[i])
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                groups[-1][1].append(ids_b[j])
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(([], []))
        docs.append((ids_a, ids_b, groups[:-1], links))
    held = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(held[p] == most[p[0]] for p in d[3]), sum(held[p] for p in d[3]), hashlib.sha256(shown.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast_rows", [alignment.BROADCAST_ROWS, 0])
def test_report_equals_a_plain_walk(spark, libraries, broadcast_rows):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, *["x", "y", 1, 2, "z", "b", 3, "n"]) for r in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.report(df, *PATHS, broadcast_rows=broadcast_rows).collect()}
    want = plain(libraries, TEXTS)
    assert got == {r[0]: w for r, w in zip(rows, want)}
    assert [w[0] > 0 for w in want].count(False) == 3 and want[8] == (0, 0, 0, 0, 0, 0, "")


def test_repeated_and_no_rows(spark, libraries):
    df = spark.createDataFrame([(1, "same text here")] * 3 + [(None, "same text here")], "doc_id long, text string")
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.report(df, *PATHS).collect()]
    assert got == plain(libraries, ["same text here"] * 4)
    assert alignment.report(df.limit(0), *PATHS).count() == 0


def test_both_encoders_equal_their_libraries(libraries):
    a, b = alignment.loaded(*PATHS)
    draw = random.Random(3)
    signs = [" ", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "e", "the", "ing", "Ñ", "東", "12", "'s", ".", "<|endoftext|>", "<s>", "▁", "😀", "﻿", "​", "ﬁ", "é"]
    assert b.apart
    for _ in range(3000):
        text = "".join(draw.choices(signs, k=draw.randint(1, 12)))
        spaced = " " + text
        assert a.ids(spaced).tolist() == libraries[0].encode(spaced, add_special_tokens=False).ids, repr(text)
        assert b.ids(spaced).tolist() == libraries[1].encode(text), repr(text)


def test_align_of_tokens_that_meet_several():
    got = alignment.align(np.array([1, 4, 1, 2]), np.array([2, 2, 2, 1, 1]))
    assert got.cuts.tolist() == [6, 8]
    assert got.group_a.tolist() == [0, 0, 0, 1] and got.group_b.tolist() == [0, 0, 0, 1, 1]
    assert list(zip(got.link_a.tolist(), got.link_b.tolist())) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 2), (3, 3), (3, 4)]

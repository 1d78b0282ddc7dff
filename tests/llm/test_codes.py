"""Integer product codes against a plain search."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tracewright.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x int, code string, of string, n long"


def plain(rows, parts=16, entries=64, rounds=2):
    held = [(i, [int(np.floor(256.0 * np.float32(c).astype(float))) for c in v], label) for i, v, label in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    if not held:
        return []
    width = len(held[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in held]
    order = sorted(range(len(held)), key=lambda k: (held[k][0] is None, held[k][0] or 0, held[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[best(c[p], books[p])[1]].append(c[p])
            for e, xs in members.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, errors = [], defaultdict(int)
    for (i, _, label), c in zip(held, cut):
        got = [best(c[p], books[p]) for p in range(parts)]
        errors[label] += sum(d for d, _ in got)
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
    return sorted(((i, code, d, errors[label], sha) for i, code, d, label in out), key=repr)


def rows_of(n, seed=1):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([0.0, 0.5, -0.25, draw.gauss(0, 1)]) for _ in range(64)], draw.choice([None, 1, 2, 3])) for i in range(n)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [None] * 64, 1), (1003, [float("nan")] + [0.0] * 63, 1), (1004, [float("inf")] * 64, 2), (1005, [-0.0] * 64, None)]
    return rows + bad + ([(None, rows[0][1], 2), (3, rows[1][1], 2), (4, rows[4][1], rows[4][2])] if n else [])


@pytest.mark.parametrize(("n", "broadcast_rows"), [(200, codes.BROADCAST_ROWS), (200, 0), (20, codes.BROADCAST_ROWS)])
def test_report_equals_a_plain_search(spark, n, broadcast_rows):
    rows = rows_of(n)
    df = spark.createDataFrame([(*r, "k", 1, "c", "o", 2) for r in rows], SCHEMA).repartition(3)
    got = codes.report(df, broadcast_rows=broadcast_rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_no_rows_odd_lengths_and_far_components(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert codes.report(spark.createDataFrame([], schema)).count() == 0
    assert codes.report(spark.createDataFrame([(1, None, "a"), (2, [float("nan")], "a")], schema)).count() == 0
    rows = [(1, [1e300, -1e300, 0.0], "a"), (2, [0.1, 0.2, 0.3], "a"), (3, [0.1], "b")]
    got = codes.report(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [1, 2] and {r["error"] for r in got} == {0} and len(got[0]["code"]) == 32


def test_partial_distance_search_keeps_ties_and_any_guess(spark):
    draw = np.random.default_rng(4)
    for width in (1, 2, 4, 7):
        x, book = draw.integers(-3, 4, (500, width)), draw.integers(-3, 4, (17, width))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        for guess in (None, draw.integers(0, 17, 500)):
            entry, least = codes.nearest(x, book, guess)
            assert (entry == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()

"""Benchmark windows in documents against every window tried at every place."""

import hashlib
import random
import re

import pytest

from tracewright.llm import contamination

DOCS = "doc_id long, text string, item string, a string, h long, pos int, part string, n_words string"
ITEMS = "item_id long, text string, key string, need int, b string"


def plain(documents, items, window=10):
    lower = str.maketrans(contamination.UPPER, contamination.LOWER)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    out = []
    for key, text in documents:
        w, hit, ids = words(text), set(), set()
        for item, sought in items:
            s = words(sought)
            n = min(window, len(s))
            for part in {tuple(s[i : i + n]) for i in range(len(s) - n + 1)} if s else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == part:
                        hit |= {*range(p, p + n)}
                        ids |= {str(item)} if item is not None else set()
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, documents, items, **how):
    docs = spark.createDataFrame([(*r, "i", "a", 1, 2, "p", "n") for r in documents], DOCS).repartition(3)
    sought = spark.createDataFrame([(*r, "k", 4, "b") for r in items], ITEMS)
    rows = contamination.report(docs, sought, **how).collect()
    assert [r.asDict().keys() for r in rows[:1]] in ([], [dict.fromkeys(["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).keys()])
    return sorted(map(tuple, rows), key=repr)


def cases():
    draw = random.Random(5)
    vocabulary = ["the", "of", "Ñandú", "é1", "x", "東京", "12", "B"]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, text(draw.randint(10, 40))) for i in range(12)]
    items += [(20, None), (21, " .,"), (22, "zebra"), (23, "one two"), (24, "odd THREE words"), (None, "the lost item of ten words and no id at all"), (3, text(15)), (3, text(15)), (25, "zebra")]
    docs = [(i, text(draw.randint(0, 60))) for i in range(40)]
    for i in range(40):
        t = draw.choice(items)[1] or ""
        w = t.split(" ")
        docs.append((100 + i, text(draw.randint(0, 5)) + " " + " ".join(w[draw.randint(0, 3) : draw.randint(13, 40)]).translate(str.maketrans(contamination.LOWER, contamination.UPPER)) + "\n" + text(draw.randint(0, 5))))
    long = text(30_000) + " " + items[0][1] + " " + text(10)
    docs += [(1, None), (2, ""), (None, items[1][1]), (5, items[2][1]), (5, items[2][1]), (6, "Zebra! zebra; one, two. Odd-three\twords"), (7, "the lost item of ten words and no id at all"), (8, long), (9, "a" * 5000)]
    return docs, items


@pytest.mark.parametrize("broadcast_rows", [contamination.BROADCAST_ROWS, 0])
def test_report_equals_all_windows_tried(spark, broadcast_rows):
    docs, items = cases()
    want = plain(docs, items)
    assert found(spark, docs, items, broadcast_rows=broadcast_rows) == want
    assert sum(r[-1] for r in want) > 15


def test_items_of_one_size(spark):
    docs, items = cases()
    long = [i for i in items if i[1] and len(i[1].split(" ")) >= 12]
    assert found(spark, docs, long) == plain(docs, long)
    assert found(spark, docs, long, window=4) == plain(docs, long, 4)


def test_empty_tables(spark):
    docs, items = cases()
    assert found(spark, [], items) == []
    assert found(spark, docs[:5], []) == plain(docs[:5], [])


def test_no_python_and_no_pairs_in_the_plan(spark):
    docs, items = cases()
    docs = spark.createDataFrame([(*r, "i", "a", 1, 2, "p", "n") for r in docs], DOCS)
    plan = contamination.matches(docs, spark.createDataFrame([(*r, "k", 4, "b") for r in items], ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)

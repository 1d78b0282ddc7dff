"""The corpus pipeline against a plain version of its stages, and on awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tracewright.llm import toxicity
from tracewright.llm.registry import tokenizer

FOOT = "Subscribe to our newsletter today"


def rows():
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(3000)]
    out, labels = [], []
    for i in range(160):
        t = [str(w) for w in rng.choice(words, 60)]
        bad = i % 5 == 0
        if bad:
            t[int(rng.integers(60))] = "horridness"
        text = " ".join(t[:30]) + "\n" + " ".join(t[30:])
        if i % 4 == 1:
            text += "\n" + FOOT
        out.append((i, text, "en", f"s{i % 4 if i % 4 != 1 else i % 7}"))
        labels.append((i, 1, int(bad)))
    near = out[2][1].split(" ")
    near[50] = "edit"
    out += [(200, " ".join(near), "en", "s9"), (201, out[3][1], "fr", "s1"), (202, None, "en", "s1"), (203, "", "en", "s2"), (204, " \n", None, None)]
    out += [(None, "no key " + " ".join(words[:20]), "en", "s1"), (None, out[6][1], "en", "s3"), (7, out[7][1], out[7][2], out[7][3])]
    out.append((205, " ".join(str(w) for w in rng.choice(words, 30_000)), "en", "s0"))
    return out, labels


def plain(docs, labels, spark):
    """The stages over lists, but for the classifier's weights."""
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    tagged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, tagged, ~toxicity.held_out())
    weights, hasher = dict(zip(model[0].tolist(), model[1].tolist())), toxicity.Hasher(20)
    margin = lambda t: model[2] + sum(weights.get(int(f), 0.0) for f in set(hasher.features(t or "").tolist()))
    docs = [d for d in docs if margin(d[1]) < 0]
    # Lines.
    seen, first = {}, {}
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    for k in order:
        for pos, line in enumerate((docs[k][1] or "").split("\n")):
            key = line.strip(" \t\r")
            if len(key) >= 15:
                seen.setdefault(key, set()).add(docs[k][3])
                first.setdefault(key, (docs[k][0], pos))
    out = []
    for i, text, lang, source in docs:
        if text is not None:
            text = "\n".join(line for pos, line in enumerate(text.split("\n")) if len(seen.get(key := line.strip(" \t\r"), ())) < 3 or first[key] == (i, pos))
        out.append((i, text, lang, source))
    # Near copies.
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, up = [shingles(d[1]) for d in out], list(range(len(out)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(out)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    kept = {}
    for k, d in enumerate(out):
        rank = (d[0] is None, d[0] or 0)
        if find(k) not in kept or rank < kept[find(k)][0]:
            kept[find(k)] = (rank, d)
    return [d for _, d in kept.values()]


def test_stages_equal_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = plain(docs, labels, spark)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), _ in zip(corpus_pipeline.STAGES, range(3)):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source"]
    got = [tuple(r) for r in frame.collect()]
    blank = lambda found: Counter(d if (d[1] or "").strip() else "blank" for d in found)
    assert blank(got) == blank(want) and len(want) < 140
    # Mixing and encoding: whole repetitions of what is left.
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_id = {}
    for i, text, _, _ in want:
        by_id[i] = hashlib.sha256(np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert all(by_id[r["doc_id"]] == r["ids_sha256"] for r in final)
    assert max(Counter(r["doc_id"] for r in final).values()) <= 2 and len(final) > len(want)


def test_the_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "source mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("some", [[], [(None, None, None, None)] * 3])
def test_empty_tables_and_rows_of_nulls(spark, tmp_path, some):
    spark.createDataFrame(some, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # nothing has words

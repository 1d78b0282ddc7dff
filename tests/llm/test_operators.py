"""Operators over small tables: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import bpe, chat, components, ivfpq, licenses, lines, minhash, mixing, planes, simhash, telephony, toxicity
from tracewright.llm.registry import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, removed int, size int, score string, target string, media string, ids int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def docs(spark, rows):
    extra = (7, "r", 1, 2, "s", "t", "m", 3)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *extra) for i, t, s in rows], SCHEMA)


ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta. eta", "a"),
    (2, None, "b"),
    (3, "", None),
    (4, "Alpha beta gamma delta epsilon zeta. eta", "c"),
    (4, "Alpha beta gamma delta epsilon zeta. eta", "c"),
    (None, "no id here at all", "a"),
    (5, LONG, "a"),
    (6, " \t\n", "b"),
    (7, "one two", "b"),
    (7, "two one", "b"),
]


def test_plane_round_trip_over_a_table(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = [tuple(r) for r in planes.round_trip(docs(spark, ROWS), tokenizer("byte_bpe_50k.json")).orderBy("start").collect()]
    want, start = [], 0
    for key, text, _ in by_key(spark, ROWS):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert planes.round_trip(docs(spark, []), tokenizer("byte_bpe_50k.json")).count() == 0


def by_key(spark, rows):
    """In the order of the files: key (null first), hash of the text, text."""
    hashed = spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t")).distinct().collect()
    h = dict(map(tuple, hashed))
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""], r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("kind", [1, 8])
def test_planes_of_both_kinds_give_the_ids_back(spark, tmp_path, kind):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = [*ROWS, *[(None, f"nameless {i}", "a") for i in range(20)]]
    uri = f"file://{tmp_path}/planes"
    manifest = planes.write(docs(spark, rows).repartition(3), tokenizer("byte_bpe_50k.json"), uri, kind=kind, block=64)
    manifest = spark.createDataFrame(manifest.collect(), planes.MANIFEST)
    got = planes.read(spark, manifest, uri, ids=True).orderBy("start").collect()
    want = [(k, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t, _ in by_key(spark, rows)]
    assert [(r["doc_id"], bytes(r["ids"])) for r in got] == want


def test_unknown_tokenizer_files_go_through_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "lower.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    encoder = planes.RunEncoder(path)
    text = "Some UPPER case\nand  MORE"
    assert not encoder.known
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_bpe_digests_and_columns(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = bpe.digests(docs(spark, ROWS), tokenizer("word_bpe_49k.json")).collect()
    want = []
    for key, text, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = bpe.encode(docs(spark, ROWS), tokenizer("word_bpe_49k.json"), decoded="back")
    assert set(full.columns) == {*docs(spark, []).columns, "back"} and full.count() == len(ROWS)
    assert bpe.digests(docs(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def toxic_corpus(spark, n=400):
    words = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, 40))
        if i % 4 == 0:
            t.insert(int(rng.integers(40)), "awfulness" if i % 8 else "awfully")
        rows.append((i, " ".join(t), "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(None, None, None), (1000, "", "b")]
    labels += [(None, 1, 1), (1001, 0, None), (1, None, 0)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learnt_without_the_held_out_rows(spark):
    d, labels = toxic_corpus(spark)
    rows = toxicity.scored(d, labels).collect()
    assert len(rows) == 402
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scored(d, flipped).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_toxicity_stage_keeps_clean_documents(spark):
    d, labels = toxic_corpus(spark)
    kept = toxicity.keep_clean(d, labels)
    assert kept.columns == d.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert sum(i % 4 != 0 for i in range(400) if i not in ids) == 0
    assert sum(i in ids for i in range(0, 400, 4)) <= 5
    none = labels.where("toxic = 0")
    assert toxicity.keep_clean(d, none).count() == 402
    assert toxicity.keep_clean(docs(spark, []), labels).count() == 0


FOOT = "Read our newsletter every week"


def boiler(spark):
    body = lambda i: "\n".join(f"body of document {i} line {j} has its own words {i * j}" for j in range(6))
    rows = [(i, f"{body(i)}\n {FOOT}\t", f"s{i % 4}" if i % 4 else None) for i in range(1, 30)]
    rows += [(100 + i, f"whole page copied line one\nwhole page copied line two {0}", f"s{i}") for i in range(5)]
    rows += [(200, f"{FOOT} once\n{body(200)}", "s1"), (201, f"{body(201)}\n{FOOT} once", "s1"), (202, None, "s2"), (203, "", "s2"), (30, f"{body(30)}\n{FOOT}", "s1"), (30, f"{body(30)}\n{FOOT}", "s1")]
    return docs(spark, rows)


def test_boilerplate_goes(spark):
    d = boiler(spark)
    before = {(r["doc_id"]): r["text"] for r in d.collect()}
    out = lines.cleaned(d)
    assert out.columns == d.columns
    after = out.collect()
    assert len(after) == d.count()
    for r in after:
        i, text = r["doc_id"], r["text"]
        if i is not None and 1 < i <= 30:
            assert FOOT not in text.split("\n")[-1] and text.count("body of document") == 6
            assert r["n_chars"] == len(text)
        elif i is not None and 100 < i < 105:
            assert text == ""  # a page copied across sites: the first stays whole
        else:
            assert text == before[i]
    assert lines.cleaned(docs(spark, [])).count() == 0


def test_boilerplate_equals_exact_counts(spark, monkeypatch):
    d = boiler(spark)
    for limit in (lines.BROADCAST_ROWS, 0):  # both ways to find occurrences
        monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
        got = sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in lines.report(d, min_sites=2).collect())
        seen = {}
        rows = sorted(((r["doc_id"], r["text"], r["source"]) for r in d.collect()), key=lambda r: r[0])
        for i, text, source in rows:
            for pos, line in enumerate((text or "").split("\n")):
                if len(line.strip(" \t\r")) >= 15:
                    first, sites = seen.setdefault(line.strip(" \t\r"), ((i, pos), set()))
                    sites.add(source)
        want = []
        for i, text, source in rows:
            out = [line.strip(" \t\r") for pos, line in enumerate((text or "").split("\n")) if len(seen.get(line.strip(" \t\r"), (0, ()))[1]) >= 2 and seen[line.strip(" \t\r")][0] != (i, pos)]
            # equal rows share the first place by their key, so neither loses it
            want.append((i, 0 if text is None else len(text.split("\n")), len(out)))
        assert got == sorted(want)


def test_pages_of_mostly_boilerplate_lose_it(spark):
    rows = [(i, f"{FOOT}\n{FOOT} as well\nown line of page {i}", f"s{i % 5}") for i in range(20)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.report(docs(spark, rows)).collect()}
    assert got == {i: 2 * (i > 0) for i in range(20)}


def slow_components(fps, radius):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    words = [f"t{i}" for i in range(500)]
    rows = list(ROWS)
    for k in range(12):
        base = list(rng.choice(words, 300))
        for c in range(6):
            t = list(base)
            for _ in range(c):
                t[int(rng.integers(300))] = "edit"
            rows.append((100 + 10 * k + c, " ".join(t), "z"))
    got = simhash.digests(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [simhash.fingerprint(t or "", 4, 42) for _, t, _ in rows]
    root = slow_components(fps, 4)
    least = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, f"{fp:016x}", least.get(r)) for (i, _, _), fp, r in zip(rows, fps, root)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_of_each_class_stays(spark):
    d = docs(spark, ROWS)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [(i, t) for i, t in rows if i in (1, 4)] == [(1, ROWS[0][1])]
    assert {i for i, t in rows if not (t or "").strip()} == {2}
    assert (None, "no id here at all") in rows and (5, LONG) in rows
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = dict(map(tuple, components.roots(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


def slow_targets(sizes, weights, share, cap):
    left, target = dict(weights), {}
    total = share * sum(sizes.values())
    while left:
        level = (total - sum(target.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > cap * sizes[s]]
        if not over:
            return target | {s: left[s] * level for s in left}
        for s in over:
            target[s] = cap * sizes[s]
            del left[s]
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", "é", None][min(4, i % 7)]) for i in range(700)]
    rows += [(900, None, "b"), (None, "x y z", "b")]
    d = docs(spark, rows)
    got = mixing.report(d).collect()
    assert len(got) == len(rows)
    sizes, weights = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for k, s in enumerate(["a", "b", "c", "é", None]):
        weights[s] = (3, 1, 2)[k % 3]
    want = slow_targets(sizes, weights, 1.5, 2.0)
    by_size = {sizes[s]: s for s in sizes}
    taken = {}
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sorted(map(tuple, mixing.report(d.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    mix = mixing.sampled(d)
    assert mix.columns == d.columns
    counts = {r[0]: r[1] for r in mix.groupBy("doc_id").count().collect()}
    assert all(counts.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in got)
    assert mixing.report(docs(spark, [])).count() == 0


def test_rows_that_differ_in_any_column_stay_apart(spark):
    rows = [(1, "a b c", lang, "s") for lang in ("en", "fr")] + [(2, "d e f", "de", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # One source at 1.5 times its size: each row once or twice.
    got = {r[0]: r[1] for r in mixing.sampled(d).groupBy("lang").count().collect()}
    assert set(got) == {"en", "fr", "de"} and set(got.values()) <= {1, 2}


def test_many_rows_without_key_are_many_lots(spark):
    d = docs(spark, [(None, f"w{i} w w", "s") for i in range(500)])
    rows = mixing.mixed(d).select("j", "n", F.col("row.a")).collect()
    assert sorted(r["j"] for r in rows) == list(range(500))


def test_mix_of_equal_rows(spark):
    d = docs(spark, [(1, "a b c", "s")] * 5 + [(2, "d", "t")])
    taken = sum(r["taken"] for r in mixing.report(d).collect())
    assert mixing.sampled(d).agg(F.sum(mixing.size_of())).first()[0] == taken


def test_licence_scan_over_a_table(spark):
    rows = [*ROWS, (20, "x\nReleased under the MIT  License.", "a"), (21, "Relesed under the MIT Licens", "a")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[20]["base_labels"] == "mit" and got[20]["first_word"] == 4
    assert got[21]["base_labels"] == "" and got[21]["labels"] == "mit" and 0.8 < got[21]["score"] < 1
    assert got[2]["n_words"] == 0 and got[5]["n_words"] == 60_000
    assert licenses.report(docs(spark, [])).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|> \\ [INST] x"), (1, 1, "assistant", "a\\<s>é🎉"), (1, 2, "assistant", None), (2, 5, "system", ""), (2, 5, None, "tie"), (None, 1, "assistant", "null id"), (3, 0, "user", "x" * 50_000)]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash")).withColumn("loss", F.lit(1))
    got = {r["conv_id"]: r for r in chat.report(table).collect()}
    assert set(got) == {1, 2, 3, 4, None, -1}
    own = chat.report(table.unionByName(table.where("conv_id = 1").withColumn("conv_id", F.lit(-1).cast("long")))).where("conv_id = -1").collect()
    assert sorted(r["n_turns"] for r in own) == [2, 3]  # the table's own conversation -1 and the added one
    for conv in got:
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv]) if conv != -1 else [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
        flat = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(flat.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees_rank_branches(spark):
    m = [("t", "a", None, "user", "q", 1.0), ("t", "b", "a", "assistant", "bad", 0.1), ("t", "c", "a", "assistant", "good", 0.9), ("t", "d", "c", "user", "more", 0.5), ("u", "e", "gone", "user", "orphan", None), ("v", "x", "y", "user", "loop", 1.0), ("v", "y", "x", "user", "loop", 1.0), ("v", "z", "x", "user", "below a loop", 1.0)]
    trees = spark.createDataFrame(m, "tree string, node string, parent string, role string, text string, score double")
    one = {r["tree"]: r for r in chat.read_back(chat.conversations(trees)).collect()}
    assert set(one) == {"t", "u"}
    assert [t["text"] for t in one["t"]["turns"]] == ["q", "good", "more"] and one["t"]["loss_text"] == "good"
    both = chat.conversations(trees, branches=2).where("tree = 't'").orderBy("branch").collect()
    assert [r["leaf"] for r in both] == ["d", "b"]
    assert chat.conversations(trees.where("false")).count() == 0


def test_search_over_a_table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)]
    rows += [(400, None, 0), (420, [0.0] * 16, 0), (440, [1.0] * 15 + [None], 0), (460, [1.0] * 15 + [float("nan")], 0), (480, [1.0] * 3, 0), (500, [float(v) for v in x[0]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = ivfpq.report(df).collect()
    ids = [*range(400), 500]
    full = np.vstack([x, x[:1]]).astype(np.float64)
    queries = [i for i in ids if i % 20 == 0]
    assert len(got) == 20 * len(queries)
    hits = 0
    for q in queries:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        score = full @ full[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:20]
        hits += len({r["vec_id"] for r in mine} & {i for _, i in order})
        assert all(abs(score[ids.index(r["vec_id"])] - r["score"]) < 1e-9 for r in mine)
    assert hits >= 0.9 * len(got)
    assert ivfpq.report(df.where("vec_id < 0")).count() == 0
    few = ivfpq.report(df.where("vec_id in (0, 1, 20)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]


def test_telephony_over_a_table(spark):
    rows = {r["doc_id"]: r for r in telephony.text_features(docs(spark, ROWS)).collect()}
    for i, text, _ in ROWS:
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = rows[i]
        if i != 7:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
            assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["media_bytes"] > len(padded)
    assert rows[1]["feature"] == rows[4]["feature"] and rows[1]["media_sha256"] == rows[4]["media_sha256"]
    assert telephony.text_features(docs(spark, [])).count() == 0
    media = [(1, telephony.wav(bytes(range(64)), telephony.ADPCM)), (2, None), (3, b"junk"), (4, telephony.wav(b"", telephony.ALAW))]
    got = {r["i"]: r for r in telephony.to_pcm(spark.createDataFrame(media, "i int, media binary")).collect()}
    assert len(telephony.unwav(bytes(got[1]["pcm"])).data) == 2 * 2 * 121
    assert got[2]["pcm"] is None and got[2]["error"] is None
    assert got[3]["pcm"] is None and "RIFF" in got[3]["error"]
    assert got[4]["pcm"] is not None


def test_pairs_do_not_depend_on_the_size_of_their_group(spark):
    """Texts of one template: below 0.8 similar to each other, but for one pair each, in groups of 2, 6 and 400."""
    rng = np.random.default_rng(11)
    words = [f"t{i}" for i in range(5000)]
    rows, gone = [], set()
    for g, size in enumerate((2, 6, 400)):
        base = list(rng.choice(words, 400))
        members = []
        for _ in range(size - 1):
            t = list(base)
            for at in range(0, 396, 40):  # two members share at most 346 of their 446 shingles
                t[at + int(rng.integers(5))] = str(rng.choice(words))
            members.append(t)
        twin = list(members[-1])
        twin[200] = "edit"
        members.append(twin)
        rows += [(1000 * g + i, " ".join(t), "z") for i, t in enumerate(members)]
        gone.add(1000 * g + size - 1)
    cut = {i: {tuple(t.split()[k : k + 5]) for k in range(396)} for i, t, _ in rows}
    near = {j for i in cut for j in cut if i < j and i // 1000 == j // 1000 and len(cut[i] & cut[j]) >= 0.8 * len(cut[i] | cut[j])}
    assert near == gone
    full = {r[0] for r in simhash.keep_one(docs(spark, rows)).select("doc_id").collect()}
    assert full == {i for i, _, _ in rows} - gone


def test_blocks_of_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(13)
    base = rng.integers(-(2**62), 2**62, 4)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(40, int(rng.integers(0, 9)), replace=False)) for b in base for _ in range(60)}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")

    def classes(**options):
        links = simhash.links(table, len(fps), 4, **options)
        assert all(0 < bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
        roots = dict(map(tuple, components.roots(links).collect()))
        return {f: roots.get(f, f) for f in fps}

    own = sorted(fps)
    want = dict(zip(own, [own[i] for i in slow_components(own, 4)]))
    groups = lambda found: {frozenset(f for f in found if found[f] == r) for r in set(found.values())}
    assert groups(classes()) == groups(classes(segments=3, block=7)) == groups(classes(segments=2, block=20)) == groups(want)


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segments_for(n, 4) for n in (0, 10**6, 10**8, 10**11)] == [4, 4, 3, 2]


def test_a_million_fingerprints(spark):
    """Planted pairs of four bits among random fingerprints are found, and little else."""
    n, twins = 1_000_000, 2_000
    made = spark.range(n, numPartitions=8).select(F.xxhash64("id").alias("fp"))
    flip = F.expr("shiftleft(1L, cast(id % 61 as int)) ^ shiftleft(1L, cast(id % 59 as int) + 2) ^ shiftleft(1L, cast(id % 7 as int) + 40) ^ shiftleft(1L, cast(id % 5 as int) + 20)")
    near = spark.range(twins).select(F.xxhash64("id").bitwiseXOR(flip).alias("fp"))
    distinct = made.union(near).distinct()
    got = simhash.links(distinct, n + twins)
    assert got.where("bit_count(a ^ b) > 4").count() == 0
    want = spark.range(twins).select(F.xxhash64("id").alias("x"), F.xxhash64("id").bitwiseXOR(flip).alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    assert want.where("bit_count(a ^ b) <= 4").join(got, ["a", "b"], "left_anti").count() == 0


def edited(rng, words, similar, size=200):
    """A text of ``size`` words and one that shares about ``similar`` of its five-word shingles, but no less."""
    base = list(rng.choice(words, size))
    cuts = [base[i : i + 5] for i in range(size - 4)]
    t, same = list(base), len(cuts)
    for at in rng.permutation(size):
        turn = [*t[:at], "edit", *t[at + 1 :]]
        left = sum(turn[i : i + 5] == c for i, c in enumerate(cuts))
        if left < similar * (2 * len(cuts) - left):
            break
        t, same = turn, left
    while same >= similar * (len(cuts) + len(t) + 1 - 4 - same):  # a word at the end costs one shingle
        t.append(f"more{len(t)}")
    return " ".join(base), " ".join(t)


def test_pairs_from_the_similarity_on_are_found(spark):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(5000)]
    rows = []
    # 180 of 200 words, 60 of 14 to 34 (10 to 30 shingles), 12 of 3,000.
    sizes = [200] * 180 + [14 + k % 21 for k in range(60)] + [3000] * 12
    for k, size in enumerate(sizes):
        base, t = edited(rng, words, (0.8, 0.85, 0.9)[k % 3], size)
        rows += [(10 * k + 1, base, "z"), (10 * k + 2, t, "z")]
    kept = {r[0] for r in simhash.keep_one(docs(spark, rows)).select("doc_id").collect()}
    assert kept == {10 * k + 1 for k in range(len(sizes))}


def test_every_pair_of_a_band_is_verified_on_demand(spark):
    """Without the filter by minima the same documents stay, though more pairs are looked at."""
    rng = np.random.default_rng(6)
    words = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(40):
        base, t = edited(rng, words, (0.6, 0.7, 0.8, 0.9)[k % 4], 60)
        rows += [(10 * k + 1, base, "z"), (10 * k + 2, t, "z")]
    kept = [{r[0] for r in simhash.keep_one(docs(spark, rows), deviations=d).select("doc_id").collect()} for d in (5.0, None)]
    assert kept[0] == kept[1] and {10 * k + 2 for k in range(40) if k % 4 > 1}.isdisjoint(kept[0])
    assert minhash.least_alike(0.8, 5.0) == 138 and minhash.least_alike(0.9, 5.0) > 138


def test_every_pair_of_a_bucket_is_tried_until_it_is_joined(spark):
    """Members of one bucket, of which only two are similar: all pairs are tried that the bound leaves, each once."""
    # Each set shares most members with the next, but too few for 0.8; 41 and 42 are alike.
    rows = [(i, list(range(4 * i, 4 * i + 10))) for i in range(1, 41)] + [(41, list(range(1000, 1010))), (42, list(range(1000, 1011))), (43, list(range(2000, 2010)))]
    sets = spark.createDataFrame([(i, bytearray(np.array(s, "<u8").tobytes())) for i, s in rows], "node long, set binary")
    own = {r["node"]: (r["size"], r["own"]) for r in minhash.own_counts(sets).collect()}
    flat = [x for _, s in rows for x in s]
    assert own == {i: (len(s), sum(flat.count(x) == 1 for x in s)) for i, s in rows}
    placed = minhash.members(spark.createDataFrame([(i, [7]) for i, _ in rows], "node long, bands array<long>"))
    none = spark.createDataFrame([], "a long, b long")
    tried = []

    def check(pairs):
        tried.extend(map(tuple, pairs.collect()))
        return simhash.verified(pairs, sets, 0.8)

    assert [tuple(r) for r in minhash.links(placed, sets, none, check, 0.8).collect()] == [(41, 42)]
    assert len(tried) == len(set(tried))

    def bound(i, j):
        most = min(own[i][0] - own[i][1], own[j][0] - own[j][1])
        return most >= 0.8 * (own[i][0] + own[j][0] - most)

    every = {(i, j) for i, _ in rows for j, _ in rows if i < j and bound(i, j)}
    # Once 41 and 42 are joined, a third need not meet both.
    assert set(tried) <= every and {p for p in every if not {41, 42} & set(p)} <= set(tried)


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.roots(chain, most_rounds=1)


def test_search_in_double_precision(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(80)]
    rows += [(80, [1e300] + [0.0] * 7), (81, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (40, [float(v) for v in 2 * x[40]])]
    got = ivfpq.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids, full = [*range(81), 40], np.vstack([x, [[1e300] + [0.0] * 7], 2 * x[40:41]])
    asks = {q: min((tuple(v) for i, v in zip(ids, full) if i == q)) for q in (0, 20, 40, 60, 80)}
    hits = 0
    for q, v in asks.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and all(r["vec_id"] != q for r in mine)
        score = [(-float((np.array(v) * w).sum()), i) for i, w in zip(ids, full) if i != q]
        hits += len({r["vec_id"] for r in mine} & {i for _, i in sorted(score)[:20]})
        known = {(i, -s) for s, i in score}
        assert all((r["vec_id"], r["score"]) in known for r in mine)
    assert hits >= 0.9 * len({(r["query_id"], r["vec_id"]) for r in got})


def test_shelves_do_not_change_a_search(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = ivfpq.search(df, lambda i: i % 5 == 0, settings=ivfpq.Settings(reach=1.0)).collect()
    dealt = ivfpq.search(df, lambda i: i % 5 == 0, settings=ivfpq.Settings(reach=1.0, shelf_bytes=16 * 8 * 4)).collect()
    assert sorted(whole) == sorted(dealt) and len(whole) == 60 * 20


def nearest_rows(kind):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 16))
    if kind == "groups":  # most of them rare, all of them tight
        x = x[np.minimum(rng.geometric(0.03, 1500), 199)] + 0.02 * x
    elif kind == "lengths":
        x *= np.exp(2 * rng.normal(size=(1500, 1)))
    elif kind == "copies":
        x[300:] = x[0] + 1e-4 * x[300:]
    elif kind == "far from zero":
        x += 1e4
    elif kind == "outliers":
        x[7::100] *= 1e12
    return x * {"small": 1e-30, "vanishing": 1e-170, "large": 1e30}.get(kind, 1.0)


@pytest.mark.parametrize("kind", ["even", "groups", "lengths", "copies", "far from zero", "outliers", "small", "vanishing", "large"])
def test_search_misses_nothing(spark, kind):
    x = nearest_rows(kind)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # As much smaller than the table as the sample, the shelves and the reranked entries are on large ones.
    s = ivfpq.Settings(least_sample=128, sample=128, shelves=3, rerank=24)
    got = ivfpq.search(df, lambda i: i % 20 == 0, settings=s).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, len(x), 20):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        want += [(q, r + 1, i, score[i]) for r, i in enumerate(order)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([r["score"] for r in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_features_of_unreadable_media(spark):
    media = [(1, None), (2, b"junk"), (3, telephony.wav(b"", telephony.MULAW)), (4, telephony.wav(telephony.payload("x"), telephony.MULAW))]
    table = spark.createDataFrame(media, "i int, media binary").withColumn("feature", F.lit("clash")).withColumn("text", F.lit("x"))
    got = {r["i"]: r for r in telephony.features(table).collect()}
    assert [got[i]["feature"] is None for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[3]["payload_bytes"] == 0 and got[4]["feature"] == telephony.feature(telephony.unwav(media[3][1]), 16_000)


def test_conversion_of_headers(spark):
    import struct

    tone = (8000 * np.sin(np.arange(1010) / 9)).astype(np.int16)
    small = telephony.wav(((tone >> 8) + 128).astype(np.uint8).tobytes(), telephony.PCM)
    small = small[:32] + struct.pack("<HH", 1, 8) + small[36:]  # 8 bits
    odd = telephony.wav(tone.tobytes(), telephony.PCM)
    odd = odd[:32] + struct.pack("<HH", 3, 24) + odd[36:]
    got = {r["i"]: r for r in telephony.to_pcm(spark.createDataFrame([(1, small), (2, odd)], "i int, media binary"), rate=8000).collect()}
    back = np.frombuffer(telephony.unwav(bytes(got[1]["pcm"])).data, "<i2")
    assert np.abs(back.astype(int) - tone).max() < 256
    assert got[2]["pcm"] is None and "24 bits" in got[2]["error"]


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark):
    d = docs(spark, [(1, f"awful text {i}", "a") for i in range(500)] + [(i, "fine words", "a") for i in range(2, 40)] + [(41, "word " * 9000 + LONG, "a")])
    labels = spark.createDataFrame([(1, 1, 1), (41, 1, 1)] + [(i, 1, 0) for i in range(2, 40)], "doc_id long, quality int, toxic int")

    def rows_of(**bounds):
        numbers, _, _ = toxicity.train(d, labels, F.lit(True), toxicity.Settings(**bounds))
        return len(numbers)

    one = toxicity.scored(d, labels.where("toxic = 1")).select("score").distinct().collect()
    none = toxicity.scored(d, labels.where("toxic = 0")).select("score").distinct().collect()
    assert [r[0] for r in one] == [1.0] and [r[0] for r in none] == [0.0]
    assert rows_of(max_rows=1) <= 40 and rows_of(max_bytes=400) <= 120


def test_mix_of_rows_that_repeat_more_than_a_lot(spark, monkeypatch):
    rows = [(1, "one two three", "a")] * 23 + [(2, "four five", "a")] * 2 + [(3, "six", "b")]
    want = sorted(tuple(r) for r in mixing.report(docs(spark, rows)).collect())
    mix = sorted(tuple(r) for r in mixing.sampled(docs(spark, rows)).select("doc_id", "text").collect())
    monkeypatch.setattr(mixing, "LOT", 4)
    assert sorted(tuple(r) for r in mixing.report(docs(spark, rows)).collect()) == want and len(want) == 26
    assert sorted(tuple(r) for r in mixing.sampled(docs(spark, rows)).select("doc_id", "text").collect()) == mix
    assert sum(r[4] for r in want) == sum(len(t.split()) for _, t in mix)


def test_links_keep_cells_of_neighbouring_buckets_apart(spark):
    values = [0, 1, 3, 1 << 40, (1 << 40) | 1, -1, -2, 77]
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    for block in (2, 16_384):
        rooted = components.roots(simhash.links(distinct, len(values), 4, block=block)).collect()
        groups = {}
        for r in rooted:
            groups.setdefault(r["root"], {r["root"]}).add(r["node"])
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(values) - {-1, -2}, frozenset({-1, -2})}

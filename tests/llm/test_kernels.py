"""Kernels that need no session: exact round trips and brute force."""

import dataclasses
import hashlib
import io
import math
import random
import time
import zlib

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import bpe, ivfpq, licenses, minhash, planes, simhash, telephony, toxicity
from tracewright.llm.registry import tokenizer

BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
ODD = ["", " ", "a  b   c \n d \n\n e ", "x<|endoftext|> y", "\x00 a\x00b  c", "日本 語 🎉🎉  x \x85 y\x1c z", "'s 't it's  'll", "It's ½ of x²! İstanbul ΣΑΣ <|startoftext|>", "ªº ǅ __a_b \xa0c", "tion" * 400]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), planes.RunEncoder(BYTE), bpe.WordBpe(WORD)


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(libraries, text):
    byte, word, runs, own = libraries
    assert np.frombuffer(runs.encode(text), "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids
    ids = word.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert own.decode(got) == word.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbtheE éÉßñ.,'!1 9²\n\t İ€字"), max_size=60))
def test_ids_equal_the_library_on_any_text(libraries, text):
    byte, word, runs, own = libraries
    assert np.frombuffer(runs.encode(text), "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids


def test_merge_takes_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert bpe.merge_word(list("abc"), ranks) == ["abc"]
    assert bpe.merge_word(list("ab"), ranks) == ["ab"]
    assert bpe.merge_word(["x"], ranks) == ["x"]


@pytest.mark.parametrize("kind", [1, 8])
@pytest.mark.parametrize("top", [1, 255, 256, 50_256, 2**32 - 1])
def test_plane_files_round_trip(kind, top):
    rng = np.random.default_rng(top)
    docs = [(k, rng.integers(0, top, n, endpoint=True).astype("<u4")) for k, n in enumerate([0, 1, 7, 70, 500, 3])] + [(None, np.array([top], "<u4"))]
    sink = io.BytesIO()
    writer = planes.ShardWriter(sink, kind, block=64)
    for key, ids in docs:
        writer.add(key, ids)
    size = writer.close()
    assert size == len(sink.getvalue())
    reader = planes.ShardReader(sink)
    assert list(reader.crcs()) == [zlib.crc32(ids.tobytes()) for _, ids in docs]
    back = list(reader.documents())
    assert [k for k, _ in back] == [k for k, _ in docs]
    assert all((a == b).all() for (_, a), (_, b) in zip(back, docs))


def test_plane_files_reject_other_bytes():
    with pytest.raises(ValueError, match="short"):
        planes.ShardReader(io.BytesIO(b"x"))
    with pytest.raises(ValueError, match="magic"):
        planes.ShardReader(io.BytesIO(b"x" * 100))


def slow_fingerprint(text, n):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c d", "A B c d e É f\xa0g h", "the same the same the same the same"])
def test_fingerprint_bit_by_bit(text):
    assert simhash.fingerprint(text, 4, 42) == slow_fingerprint(text, 4)


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (7, 4), (3, 5), (0, 1)])
def test_segment_radii_cover_the_radius(radius, segments):
    plan = simhash.plan(radius, segments)
    assert sum(w for _, w, _ in plan) == 64
    assert sum(r + 1 for _, _, r in plan) > radius


def test_bucket_links_give_exact_components():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 3)
    fps = {int(b) for b in base}
    for _ in range(400):  # one dense cluster of chains
        fps.add(int(rng.choice(list(fps)[:40])) ^ (1 << int(rng.integers(0, 63))))
    fps = np.array(sorted(fps))
    bucket, own = np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    a, b = simhash.bucket_links(bucket, fps, own, 4)
    assert len(a) < 2 * len(fps)
    assert (simhash.differing(a, b) <= 4).all()

    def parts(pairs):
        up = {int(f): int(f) for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for p, q in pairs:
            up[find(int(p))] = find(int(q))
        groups = {}
        for f in up:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    every = [(p, q) for i, p in enumerate(fps) for q in fps[:i] if bin(int(p) ^ int(q) & (2**64 - 1)).count("1") <= 4 or simhash.differing(np.array([p]), np.array([q]))[0] <= 4]
    assert parts(zip(a, b)) == parts(every)


def test_companding_tables():
    assert telephony.MU[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(telephony.STEPS) == 89


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[nibble])))
            out.append(value)
    return out


def test_adpcm_across_blocks_equals_one_by_one():
    data = np.random.default_rng(2).integers(0, 256, 64 * 9 + 5).astype(np.uint8)
    got = telephony.decode_adpcm(data)
    assert got.tolist() == [slow_adpcm(bytes(data[i : i + 64])) for i in range(0, 64 * 9, 64)]


def test_adpcm_follows_a_tone():
    tone = (8000 * np.sin(np.arange(1210) / 9)).astype(np.int16)
    back = telephony.decode(telephony.encode_adpcm(tone), telephony.ADPCM)[: len(tone)]
    assert np.abs(back.astype(int) - tone)[60:].mean() < 400


@pytest.mark.parametrize("rate", [16_000, 8_000, 11_025, 4_000])
def test_resampling_keeps_a_tone(rate):
    t = np.arange(4000) / 8000
    tone = (9000 * np.sin(2 * np.pi * 300 * t)).astype(np.int16)
    got = telephony.resample(tone, 8000, rate)
    want = 9000 * np.sin(2 * np.pi * 300 * np.arange(len(got)) / rate)
    assert len(got) == -(-len(tone) * rate // 8000)
    assert np.abs(got - want)[100:-100].max() < 450


@pytest.mark.parametrize("tag", [telephony.MULAW, telephony.ALAW, telephony.ADPCM, telephony.PCM])
def test_wav_round_trip(tag):
    data = telephony.payload("Ünïcode")
    assert len(data) == 64
    assert (lambda got: (got.tag, got.rate, bytes(got.data)))(telephony.unwav(telephony.wav(data, tag))) == (tag, 8000, data)
    with pytest.raises(ValueError):
        telephony.unwav(b"RIFF....AVI ")


def test_fuzzy_places_equal_a_search_without_seeds():
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    rng = random.Random(3)
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()
    for _ in range(12):
        n = rng.randrange(len(licenses.NOTICES))
        notice = list(licenses.NOTICES[n][0])
        for _ in range(rng.randrange(tool.errors[n] + 3)):
            i = rng.randrange(len(notice))
            notice[i : i + 1] = rng.choice([[], ["x"], [notice[i], "q"]])
        text = " ".join(rng.choices(filler, k=6)) + " " + "".join(notice) + " " + " ".join(rng.choices(filler, k=6))
        got = {p.notice for p in tool.fuzzy(text)}
        want = {i for i, pattern in enumerate(tool.patterns) if pattern.search(text)}
        assert got == want


def test_word_bpe_equals_the_library_on_control_characters():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), bpe.loaded(tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rng = random.Random(6)
    signs = [*map(chr, range(0x20)), "\x7f", "\x85", "\xa0", "\u2028", "\u200b", "\ufeff", "a", "b1", "É", "ß", "İ", "東", "'s", " ", "  ", "<|endoftext|>", "<|startoftext|>", "<|", "_", "¼"]
    for text in ["a\x1cb", "\x1c", "\x1f\x1e", "a \x1d b", *["".join(rng.choices(signs, k=rng.randint(1, 10))) for _ in range(6000)]]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_licence_scan_of_one_text():
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    n, base, first, last, own, labels, score, spans = licenses.scan_text("Foo: Licensd under the\nApache  Licence, Version 2.0! CC  BY. gnu general public license; CC BY", tool)
    assert (base, first, last, own) == (3, 9, 15, "cc-by,gpl")
    assert "apache" in labels.split(",") and score == 1.0
    assert spans[0]["label"] == "apache" and spans[0]["first_word"] == 1 and spans[0]["errors"] == 2
    assert licenses.scan_text("", tool)[:7] == (0, 0, None, None, "", "", 0.0)


NEIGHBOURS = {
    "released under the bsd license": "bsd",
    "released under the isc license": "isc",
    "released under the zlib license": "zlib",
    "released under the bmt license": "",
    "released under the permit license": "",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by,cc-by-nd",
    "licensed under CC BY-NC 3.0": "cc-by,cc-by-nc",
    "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
    "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd",
    "licensed under the apple license version 2 0": "",
    "this program is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License": "agpl",
    "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License": "gpl",
    "gnu library general public license": "",
    "this source code form is subject to the terms of the eclipse public license": "",
    "licensed under a creative commons attribution noncommercial license": "",
    "licensed under a creative commons attribution license": "cc-by",
}


@pytest.mark.parametrize(("text", "labels"), NEIGHBOURS.items())
def test_neighbouring_licences_keep_apart(text, labels):
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    assert licenses.scan_text(f"It is {text}, they say.", tool)[5] == labels


def test_edited_notices_are_still_found():
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    rng = random.Random(8)
    found = tried = 0
    for notice, label in licenses.NOTICES:
        needs = licenses.TELLING.get(notice, ("", ""))[0].split()
        free = [i for i, w in enumerate(notice.split(" ")) if w not in needs and len(w) > 3]
        for _ in range(20):
            words = notice.split(" ")
            i = rng.choice(free)
            at = rng.randrange(len(words[i]))
            words[i] = words[i][:at] + rng.choice(["", "q"]) + words[i][at + 1 :]
            tried += 1
            found += label in licenses.scan_text("so it is " + " ".join(words) + " and on", tool)[5].split(",")
    assert found == tried


def test_words_of_the_licence_scan():
    text = "A_b é-Ü 1x\x7fy\x00z"
    words = text.encode().translate(licenses.FOLD).split()
    folded = "".join(c.lower() if c.isascii() else c for c in text)
    assert [w.decode() for w in words] == regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_classifier_learns_and_is_sparse():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    hasher = toxicity.Hasher(18)
    rows = []
    for k in range(600):
        text = rng.choices(words, k=60)
        if k % 6 == 0:
            text.insert(rng.randrange(60), rng.choice(["vileness", "vilest"]))
        rows.append((np.unique(hasher.features(" ".join(text))), int(k % 6 == 0)))
    numbers, weights, bias = toxicity.fit(rows[:480], toxicity.Settings(bits=18))
    dense = np.zeros(1 << 18, np.float32)
    dense[numbers] = weights
    right = sum((bias + dense[f].sum() >= 0) == bool(y) for f, y in rows[480:])
    assert right >= 117 and len(numbers) < 2000


def test_lists_are_packed_into_shelves():
    start, first, span = ivfpq.pack(np.array([3, 4, 0, 25, 8, 5]), 10)
    assert start.tolist() == [0, 3, 7, 7, 32, 40] and first.tolist() == [0, 0, 0, 0, 3, 4] and span.tolist() == [1, 1, 1, 4, 1, 1]
    row, shelf, lists = ivfpq.addressed(np.array([[3, 1], [4, 5]], np.int32), first, span)
    assert list(zip(row.tolist(), shelf.tolist(), [v.tolist() for v in lists])) == [(0, 0, [1, 3]), (0, 1, [3]), (0, 2, [3]), (0, 3, [3]), (1, 3, [4]), (1, 4, [5])]


def test_index_recall_against_brute_force():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2900:] = x[0]  # copies
    s = ivfpq.Settings()
    index = ivfpq.fit(x[:2000], 14, s)
    place, codes = index.assign(x)
    queries = np.arange(0, 3000, 100)
    visits = index.visits(x[queries], 13)
    hits = total = 0
    count = np.bincount(place, minlength=14)
    start, first, span = ivfpq.pack(count, 400)
    shelf_of = np.floor((start[place] + count[place] * rng.integers(0, 2**31, 3000) / ivfpq.PARTS) / 400).astype(int)
    found_by = {q: [] for q in queries}
    row, shelf, lists = ivfpq.addressed(visits, first, span)
    assert len(set(zip(row.tolist(), shelf.tolist()))) == len(row)
    for n in np.unique(shelf):
        m = np.flatnonzero(shelf_of == n)
        assert len(m) <= 500
        m = m[np.argsort(place[m], kind="stable")]
        asks = np.flatnonzero(shelf == n)
        held = ivfpq.Shelf(index, place[m], m, x[m], codes[m])
        for q, i, score in zip(*held.search(queries[row[asks]], x[queries[row[asks]]], [lists[a] for a in asks], 20, s.rerank)):
            found_by[q].append((-score, i))
            assert place[i] in visits[list(queries).index(q)]
    for q in queries:
        found = found_by[q]
        exact = x.astype(np.float64) @ x[q].astype(np.float64)
        exact[q] = -9
        bar = np.sort(exact)[-20]
        best = sorted(found)[:20]
        hits += sum(-a >= bar - 1e-9 for a, _ in best)
        total += 20
        if q == 0:
            assert [int(i) for _, i in best] == list(range(2900, 2920))
    assert hits / total >= 0.9


@pytest.mark.parametrize("offset, factor, kind", [(0, 1, np.float32), (1000, 1, np.float32), (0, 1e-38, np.float32), (0, 1e37, np.float32), (0, 1e-150, float), (5, 1e100, float)])
def test_estimates_are_off_by_the_slack_at_most(offset, factor, kind):
    rng = np.random.default_rng(5)
    x = ((rng.normal(size=(600, 18)) + offset) * factor).astype(kind)
    x[::50] *= 10
    scale = 2.0 ** -float(np.round(np.log2(np.median(ivfpq.lengths(x.astype(float))))))
    index = dataclasses.replace(ivfpq.fit(ivfpq.clamped(x[:300], scale), 6, ivfpq.Settings()), scale=scale)
    place, codes = index.assign(ivfpq.clamped(x, scale))
    order = np.argsort(place, kind="stable")
    x, place, codes = x[order], place[order], codes[order]
    shelf = ivfpq.Shelf(index, place, np.arange(600), x, codes)
    slack, size = shelf.slack
    asked, unit = ivfpq.units(x[::7].astype(float))
    estimate = shelf.scores(unit, [np.arange(6)] * len(unit)).astype(float)
    exact = x[::7].astype(float) / asked[:, None] @ (x.astype(float) * scale).T
    assert (np.abs(exact - estimate) <= slack).all() and np.isfinite(slack).all()
    assert np.allclose(size, np.sqrt(((x.astype(float) / factor) ** 2).sum(1)) * factor, rtol=1e-6)
    # A list is ruled out only where none of its vectors reaches the bar.
    far, size = ivfpq.from_centers(x, index, lambda at: index.centroids[place[at]])
    of_list = lambda v: np.array([v[place == n].max(initial=0) for n in range(6)])
    for bar in np.quantile(exact, [0.5, 0.99, 1.0]):
        may = ivfpq.reachable(index, unit, np.full(len(unit), bar, np.float32), of_list(far), of_list(size * scale))
        assert all(may[q, place[i]] for q, i in zip(*np.nonzero(exact > bar + 1e-6 * abs(bar))))


def test_digest_of_ids():
    own = bpe.WordBpe(WORD)
    assert hashlib.sha256(own.encode("")).hexdigest() == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("similar", [0.8, 0.85, 0.9])
def test_bands_meet_from_the_similarity_on(similar):
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(2000):
        n = 400
        both = round(similar * n)
        own = (n - both) // 2
        h = rng.integers(0, 2**64, n, np.uint64)
        x, y = minhash.minima(h[: both + own]), minhash.minima(np.concatenate([h[:both], h[both + own :]]))
        met += (minhash.bands(x) == minhash.bands(y)).any()
    assert met >= 1996



def test_long_words_take_a_heap_with_the_same_parts():
    rng = random.Random(6)
    tool = bpe.loaded(tokenizer("word_bpe_49k.json"))
    for size in (1, 2, 3, 40, 900):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "etaoin", "aaaa"):
            word = [tool.alphabet[b] for b in "".join(rng.choices(letters, k=size)).encode()]
            word[-1] += tool.suffix
            assert bpe.merge_long(word, tool.ranks) == bpe.merge_word(word, tool.ranks)
    began = time.perf_counter()
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    ids = tool.encode(text)
    assert time.perf_counter() - began < 30 and tool.decode(ids).replace(" ", "") == text + tool.suffix


def test_every_place_of_a_notice_is_reported():
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    text = "relesd under the mit licens relesed under the mit license"
    assert [p.first_word for p in tool.fuzzy(text) if p.label == "mit"] == [0, 5]
    rng = random.Random(8)
    notice = licenses.NOTICES[5][0]
    for _ in range(30):
        pieces, count = [], rng.randrange(1, 5)
        for _ in range(count):
            t = list(notice)
            for at in rng.sample([i for i, c in enumerate(t) if c != " "], rng.randrange(0, 3)):
                t[at] = "q"
            pieces.append("".join(t))
        got = [p for p in tool.fuzzy(" ".join(pieces)) if p.notice == 5]
        assert [p.first_word for p in got] == [5 * i for i in range(count)]


def test_long_notices_may_have_a_tenth_of_errors():
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    n, notice = max(enumerate(licenses.NOTICES), key=lambda x: len(x[1][0]))
    text = list(notice[0])
    for at in range(5, 5 + 11 * tool.errors[n], 11):
        text[at] = "q"
    assert tool.errors[n] == len(notice[0]) // 10 > 4
    assert n in {p.notice for p in tool.fuzzy("".join(text))}


def slow_base(text, phrases):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({label for _, label in found}))


def test_base_counts_equal_a_search_word_by_word():
    tool = licenses.scanner(tuple(licenses.PHRASES.items()), licenses.NOTICES, 0.1)
    rng = random.Random(12)
    words = "gnu general public license apache mit cc by CC-BY License, é x_y \n".split(" ")
    for _ in range(200):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 60)))
        assert licenses.scan_text(text, tool)[:5] == slow_base(text, licenses.PHRASES)


def slow_ftrl(rows, s):
    """One coordinate after the other, from the update rules."""
    positive = sum(y for _, y in rows)
    bar = s.l1 * math.sqrt(min(positive, len(rows) - positive))
    weigh = {1: max(1.0, (len(rows) - positive) / positive), 0: max(1.0, positive / (len(rows) - positive))}
    z, n, order, bias = {}, {}, np.random.default_rng(s.seed), -1

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == bias else bar
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            features, y = [*map(int, rows[k][0]), bias], rows[k][1]
            w = {i: weight(i) for i in features}
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y) * weigh[y]
            for i in features:
                old = n.get(i, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def test_ftrl_equals_one_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 400, 30) + (200 if k % 3 else 0)).astype(np.uint32), int(k % 3 == 0)) for k in range(150)]
    s = toxicity.Settings(bits=10, l1=0.3)
    numbers, weights, bias = toxicity.fit(rows, s)
    want, want_bias = slow_ftrl(rows, s)
    assert set(numbers.tolist()) == set(want) and len(want) > 20
    assert all(abs(w - want[i]) < 1e-5 for i, w in zip(numbers.tolist(), weights.tolist())) and abs(bias - want_bias) < 1e-9


def test_adpcm_with_the_block_size_of_the_header():
    data = np.random.default_rng(2).integers(0, 256, 256 * 2).astype(np.uint8)
    got = telephony.decode(data.tobytes(), telephony.ADPCM, 256)
    assert got.tolist() == [x for i in (0, 256) for x in slow_adpcm(bytes(data[i : i + 256]))]


def test_features_equal_slow_ones(monkeypatch):
    text = "some text, long enough for a few blocks " * 9
    sound = telephony.unwav(telephony.wav(telephony.payload(text), telephony.MULAW))
    data = bytes(sound.data)
    mu, a = [int(telephony.MU[b]) for b in data], [int(telephony.A[b]) for b in data]
    adpcm = [x for i in range(0, len(data), 64) for x in slow_adpcm(data[i : i + 64])]

    def levels(x):
        return f"{max(map(abs, x))}/{sum(v * v for v in x) // len(x)}/{sum((p < 0) != (q < 0) for p, q in zip(x, x[1:]))}"

    bank = telephony.phases(2, 1)
    span, before = bank.shape[1], (bank.shape[1] - 1) // 2
    padded = [0] * before + mu + [0] * span
    pcm = [max(-32768, min(32767, round(sum(float(bank[p, k]) * padded[i + k] for k in range(span))))) for i in range(len(mu)) for p in (0, 1)]
    for step in (telephony.SLICE, 64):
        monkeypatch.setattr(telephony, "SLICE", step)
        said = telephony.feature(sound, 16_000)
        assert said.startswith(f"mulaw:{levels(mu)} alaw:{levels(a)} adpcm:{levels(adpcm)} pcm16000:{len(pcm)}/")
        assert np.abs(telephony.resample(telephony.decode(data, telephony.MULAW), 8000, 16_000) - np.array(pcm)).max() <= 1


@pytest.mark.parametrize("rate", [16_000, 11_025, 4_000])
def test_resampling_in_slices_changes_nothing(monkeypatch, rate):
    samples = np.random.default_rng(1).integers(-9000, 9000, 5000).astype(np.int16)
    whole = telephony.resample(samples, 8000, rate)
    monkeypatch.setattr(telephony, "SLICE", 700)
    assert np.array_equal(telephony.resample(samples, 8000, rate), whole)

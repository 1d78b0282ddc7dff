"""SimHash near-duplicates through multi-index hashing.

A fingerprint is cut into segments.  If two fingerprints differ in at most
``radius`` bits, then for radii ``r_i`` that add up to ``radius - segments + 1``
at least one segment differs in at most its ``r_i`` bits.  Every fingerprint
enters the table of each segment under its own value, and asks it for all
values of the Hamming ball of that segment's radius; whatever shares a value is
verified on all 64 bits.  The number of segments follows the number of
fingerprints (``segments_for``): fewer and wider segments have larger balls, but
buckets that stay small.

Equal fingerprints are collapsed before, so exact copies cost one row however
many they are.  A bucket never gives all its pairs: where links are dense, a
search from unvisited member to unvisited member finds the bucket's exact
components and emits their spanning trees only.  A bucket with more than
``BLOCK`` entries is dealt out in blocks of entries against blocks of rows, so
no task holds it whole.  Components of the whole table follow by star
contraction.

``keep_one`` removes near-duplicates by shingle sets: fingerprints near each
other, and texts that share a band of ``minhash``, are candidates, and every
link is verified on the sets of both texts, whatever else is in its bucket.

Edge cases: a null or empty text, or one of white space, has fingerprint zero
and links like any other; texts with fewer words than a shingle are one shingle;
rows with a null key get their group's component; a group without any key has
component null; repeated rows and keys are kept; long texts are hashed whole in
bounded slices; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import columns, components, minhash, scratch
from tracewright.llm.arrow import chunks, texts

BITS = 64
#: Shingles whose hashes are held at once.
SLICE = 200_000
#: Pairs checked side by side; pairs of one bucket above which it is searched on its own.
PAIRS, DENSE = 2_000_000, 262_144
#: Entries of a bucket above which it is dealt out in blocks.
BLOCK = 16_384
#: A fingerprint or text with more than this share of all rows is named by a broadcast: there are at most 1,000 of them.
HOT_SHARE = 0.001
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, repeats included, in slices; words are what ASCII white space separates."""
    from xxhash import xxh64_intdigest as xxh

    words = text.encode("utf-8").translate(LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([xxh(joined, seed)], "<u8")
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    first = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    last = ends[shingle - 1 :].tolist()
    for at in range(0, len(first), SLICE):
        yield np.array([xxh(joined[a:b], seed) for a, b in zip(first[at : at + SLICE], last[at : at + SLICE])], "<u8")


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """The 64-bit fingerprint: a bit is set if it is set in over half of the hashes."""
    return _sketch(text, shingle, seed, False)[0]


def _sketch(text: str, shingle: int, seed: int, banded: bool) -> tuple[int, np.ndarray | None]:
    """The fingerprint, and the minima of ``minhash`` if asked for."""
    ones, count = np.zeros(BITS, np.int64), 0
    least = minhash.minima(np.zeros(0, np.uint64)) if banded else None
    for hashes in shingle_hashes(text, shingle, seed):
        if banded:
            least = np.minimum(least, minhash.minima(hashes))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0]), least


def fingerprints(df: DataFrame, keys: list[str], column: str = "text", shingle: int = 4, seed: int = 42, banded: bool = False) -> DataFrame:
    """Keys and fingerprint (the 64 bits as a signed long) of every row, and its bands and planes of minima if asked for."""
    more = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "planes")] if banded else []
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("fp", T.LongType()), *more])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                made = [_sketch(t, shingle, seed, banded) for t in texts(part, column)]
                cols = [pa.array(np.array([fp for fp, _ in made], np.uint64).view(np.int64))]
                if banded:
                    cols += [pa.array([f(least) for _, least in made], pa.list_(pa.int64())) for f in (minhash.bands, minhash.planes)]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(k)) for k in keys], *cols], names=schema.names)

    return df.select(*keys, column).mapInArrow(kernel, schema)


def plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment."""
    if not 0 < segments <= BITS or radius < 0:
        raise ValueError("segments from 1 to 64, radius from 0")
    spare = max(0, radius - segments + 1)
    out, shift = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        # The balls that must be larger go to the later, narrower segments.
        ball = spare // segments + (segments - i <= spare % segments)
        out.append((shift, width, ball))
        shift += width
    return out


def segments_for(count: int, radius: int) -> int:
    """The number of segments with the least work for so many fingerprints.

    Work of one fingerprint: a row for every value of its balls, and a comparison
    (200 of which cost as much as a row) with everything evenly filled buckets
    hold.  Radius 4: four segments up to 17 million, three up to 5 billion, then two.
    """

    def work(segments: int) -> float:
        balls = [(sum(comb(width, r) for r in range(ball + 1)), width) for _, width, ball in plan(radius, segments)]
        return sum(rows + count * rows / 2**width / 200 for rows, width in balls)

    return min(range(1, max(2, radius + 1)), key=work)


def probes(distinct: DataFrame, radius: int, segments: int) -> DataFrame:
    """(bucket, fp, own): table rows (own) and ball rows of every fingerprint."""
    rows = []
    for number, (shift, width, ball) in enumerate(plan(radius, segments)):
        flips = [sum(1 << b for b in bits) for r in range(ball + 1) for bits in combinations(range(width), r)]
        rows += [(number, shift, (1 << width) - 1, flip) for flip in flips]
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(s).alias("s"), F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f")) for n, s, m, f in rows])).alias("e")
    value = F.expr("(shiftrightunsigned(fp, e.s) & e.m) ^ e.f")
    return distinct.select("fp", each).select((F.expr("shiftleft(e.n, 58)").bitwiseXOR(value)).alias("bucket"), "fp", (F.col("e.f") == 0).alias("own"))


def blocked(rows: DataFrame, tables: DataFrame, block: int) -> DataFrame:
    """``probes`` with a number ``cell``: buckets of over ``block`` entries (of ``tables``) are a grid of cells.

    Entries are dealt by a hash to ``k`` blocks, all rows to ``k`` others, and
    every pair of blocks is a cell; other buckets are one cell.
    """
    # At most one bucket in ``block`` table rows; the stored size decides whether the join broadcasts.
    hot = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    hot = scratch.store(hot.select("bucket", F.ceil(F.col("m") / block).cast("int").alias("k")), "crowded-buckets")
    if hot.isEmpty():
        return rows.withColumn("cell", F.lit(0))
    spread = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((spread * F.col("k") + i).alias("cell"), F.col("own").alias("own")))
    across = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((i * F.col("k") + spread).alias("cell"), F.lit(False).alias("own")))
    # An entry is a row as well: it asks all blocks of entries.
    cells = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("own").alias("own")))).when(F.col("own"), F.concat(each, across)).otherwise(across)
    return rows.join(hot, "bucket", "left").select("bucket", "fp", F.explode(cells).alias("c")).select("bucket", "fp", "c.own", "c.cell")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs (counted unsigned: numpy counts those of the absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (two arrays) of distinct fingerprints."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = np.arange(len(fps))
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop()
            near = differing(fps[todo], fps[at]) <= radius
            if near.any():
                hit = todo[near]
                left.append(np.full(len(hit), at))
                right.append(hit)
                front.extend(hit)
                todo = todo[~near]
    return fps[np.concatenate(left)], fps[np.concatenate(right)]


def bucket_links(bucket: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets that give their exact components; rows come by bucket, own rows first."""
    start = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    size = np.diff(np.append(start, len(bucket)))
    mine = np.add.reduceat(own.astype(np.int64), start)
    busy = (mine > 0) & (size > 1)
    start, size, mine = start[busy], size[busy], mine[busy]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def crowded(s: int, n: int) -> None:
        a, b = forest(np.unique(fps[s : s + n]), radius)
        left.append(a)
        right.append(b)

    small = size * mine <= DENSE
    for s, n in zip(start[~small], size[~small]):
        crowded(s, n)
    start, size, mine = start[small], size[small], mine[small]
    cost = np.cumsum(size * mine)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        s, n, m = start[at:to], size[at:to], mine[at:to]
        count = n * m
        group = np.repeat(np.arange(len(s)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i, j = s[group] + step // m[group], s[group] + step % m[group]
        ahead = i > j
        i, j, group = i[ahead], j[ahead], group[ahead]
        differ = differing(fps[i], fps[j])
        linked = (differ > 0) & (differ <= radius)
        i, j, group = i[linked], j[linked], group[linked]
        many = np.bincount(group, minlength=len(s)) > 2 * n
        for g in np.flatnonzero(many):
            crowded(s[g], n[g])
        few = ~many[group]
        left.append(fps[i[few]])
        right.append(fps[j[few]])
        at = to
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, count: int, radius: int = 4, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that give the exact components of ``radius`` over ``count`` distinct fingerprints."""
    segments = segments or segments_for(count, radius)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                bucket, cell, *rest = rows
                new = (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])
                a, b = bucket_links(np.concatenate([[0], np.cumsum(new)]), *rest, radius)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut == 0 and held and all(held[-1][c][-1] == rows[c][0] for c in (0, 1)):
                held.append(rows)  # the bucket goes on
                continue
            done = [*held, tuple(c[:cut] for c in rows)]
            yield from solve(tuple(np.concatenate(c) for c in zip(*done)))
            held = [tuple(c[cut:] for c in rows)]
        if held:
            yield from solve(tuple(np.concatenate(c) for c in zip(*held)))

    rows = probes(distinct, radius, segments)
    tables = probes(distinct, segments - 1, segments).where("own")  # without balls
    dealt = blocked(rows, tables, block).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", F.col("own").desc())
    return dealt.select("bucket", "cell", "fp", "own").mapInArrow(kernel, "a long, b long").distinct()


def named(rows: DataFrame, names: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` beside the entry of ``names`` for ``key`` (unique there, with ``n``, its number of rows), whatever the share of one value."""
    hot = names.where(F.col("n") > HOT_SHARE * total).drop("n")
    many = rows.join(F.broadcast(hot), key)
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names.where(F.col("n") <= HOT_SHARE * total).drop("n"), key).unionByName(many)


def classes(df: DataFrame, key: str = "doc_id", column: str = "text", shingle: int = 4, radius: int = 4, segments: int | None = None, seed: int = 42) -> DataFrame:
    """Per row: key, fp and component_id, the smallest key that links of up to ``radius`` bits lead to."""
    fps = scratch.store(fingerprints(df, [key], column, shingle, seed), "fingerprints")
    groups = scratch.store(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rooted = components.roots(links(groups.select("fp"), count, radius, segments))
    placed = groups.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = scratch.store(placed.join(ids, "root").select("fp", "n", "component_id"), "fingerprint-classes")
    return named(fps, by_fp, "fp", total).select(key, "fp", "component_id")


def digests(df: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 hex digits, component_id."""
    return classes(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by shingle sets ----------------------------------------


def shingle_sets(samples: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, set): the sorted distinct shingle hashes of texts (node, text), as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(t, shingle, seed)])).tobytes() for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), pa.array(found, pa.binary())], names=["node", "set"])

    return scratch.store(samples.select("node", "text").mapInArrow(sets, "node long, set binary"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, set) share at least ``least`` of their members."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= least * (len(p) + len(q) - both):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def similar_nodes(rows: DataFrame, column: str, shingle: int, radius: int, similar: float, seed: int, deviations: float | None) -> tuple[DataFrame, DataFrame]:
    """Distinct texts and the verified links between them.

    ``rows`` has ``_text`` (a digest that names the text), ``_best`` (what is
    smallest in the row to keep) and the text.  Texts come back as (node, _text,
    fp, best); links as (a, b) of nodes.
    """
    sketched = scratch.store(fingerprints(rows, ["_text", "_best"], column, shingle, seed, True), "fingerprints")
    distinct = sketched.groupBy("_text").agg(F.min("_best").alias("best"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    # The stored numbers name the texts from here on.
    nodes = scratch.store(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    banded = minhash.members(nodes)
    fps = scratch.store(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")), "fingerprint-hubs")
    count = fps.count()
    near = links(fps.select("fp"), count, radius)
    ends = [fps.select(F.col("fp").alias(fp), F.col("hub").alias(end)) for fp, end in (("p", "a"), ("q", "b"))]
    near = near.select(F.col("a").alias("p"), F.col("b").alias("q")).join(ends[0], "p").join(ends[1], "q").select("a", "b")
    # Texts of one fingerprint ask its smallest node.
    same = nodes.join(fps.where("n > 1"), "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    first = scratch.store(near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-pairs")
    wanted = banded.select("node").union(first.select("a")).union(first.select("b")).distinct()
    wanted = scratch.store(nodes.select("node", "_text").join(wanted, "node"), "wanted-texts")
    samples = rows.select("_text", F.col(column).alias("text")).join(wanted, "_text").groupBy("node").agg(F.first("text").alias("text"))
    sets = shingle_sets(samples, shingle, seed)
    return nodes, minhash.links(banded, sets, first, lambda pairs: verified(pairs, sets, similar), similar, nodes, deviations)


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 4, similar: float = 0.8, seed: int = 42, deviations: float | None = 5.0) -> DataFrame:
    """One document of each class: that with the smallest doc_id, with its own columns.

    Two texts are linked if their sets of ``shingle``-word shingles are at least
    ``similar`` by Jaccard's measure; classes are the components of these links.
    Candidates are fingerprints of up to ``radius`` differing bits and texts that
    share a band of ``minhash`` (0.9999 of the pairs at 0.8, more above); each
    link is verified on the whole sets, but for equal texts.  Pairs of a band of
    which fewer minima agree than ``deviations`` below what ``similar`` leads to
    expect (by calculation one similar pair in a million) are not verified; with
    None all are.

    Edge cases: null, empty and blank texts are one class; a null doc_id comes
    last; of rows that share the smallest doc_id the one with the smallest digest
    stays, and one of rows that are equal in all columns; an empty table stays
    empty.
    """
    used = ["doc_id", "text"]
    packed = columns.pack(docs, used)
    text = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    best = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text", columns.OTHERS).alias("row"))
    marked = packed.withColumn("_text", text).withColumn("_best", best)
    nodes, linked = similar_nodes(marked, "text", shingle, radius, similar, seed, deviations)
    rooted = components.roots(linked)
    placed = nodes.select("node", "_text", "best").join(rooted, "node", "left")
    kept = placed.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("best.nameless", "best.id", "_text", "best.row")).alias("k"))
    first = marked.withColumn("_row", F.col("_best.row")).join(kept.select(F.col("k._text").alias("_text"), F.col("k.row").alias("_row")), ["_text", "_row"])
    return columns.unpack(first.dropDuplicates(["_text", "_row"]), docs.columns, used)

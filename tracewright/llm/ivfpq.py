"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids split the vectors into lists; what a centroid leaves of a
vector is cut into short pieces, each stored as one byte.  A query visits the
lists whose centroids promise the largest inner products, sums one table look-up
per byte (asymmetric distances: the query itself stays exact) and reranks the
best candidates of every shelf by the original vectors in double precision.

That first visit yields each query's bar, the k-th best score found.  The second
one is exact: how far a vector lies from its centroid, and from what its code
stands for, is known, and by Cauchy and Schwarz no score exceeds its estimate by
more than that distance times the query's length.  Lists whose farthest vector
could reach the bar are visited, entries that could reach it are reranked, and
nothing else can be among the k nearest.  Rounding of the estimates is added to
the distance.

The quantisers are fitted on at most ``sample`` vectors, those with the smallest
seeded hash of their id; every vector is then indexed.  The number of lists grows
with the square root of the vectors, the sample with the lists.  How many lists a
query visits at first is measured: as many as hold ``reach`` of the true neighbours
among the sample's own vectors.  Lists are laid end to end and cut into shelves, about
``shelves`` of them, more where one would exceed ``shelf_bytes`` of vectors; which
of its shelves an entry is on, its hash says.  A query is sent to a shelf once, with the numbers of the
lists it visits there, however many they are, and queries stream past a shelf in
batches.  So neither a list that holds a third of all vectors nor very many
queries are ever held at once, no vector is stored in more than one place, and
what the queries move is at most ``shelves`` vectors each and visit until the
shelves are full.

Edge cases: rows without id and vectors that are null, zero, of another length
than most, or hold null or non-finite components take no part; the index sees
vectors scaled to the sample's median length and components clamped at 1e15, which
the distances include; ties go to the smaller id; a query never
finds its own id; rows that share an id are candidates each, and of those that
share a query id the smallest vector asks; with fewer than k candidates all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import scratch


@dataclass(frozen=True)
class Settings:
    #: Vectors that the quantisers are fitted on: eight a list, between these bounds.
    least_sample: int = 8_192
    sample: int = 65_536
    #: Dimensions of a piece; 256 values each.
    piece: int = 4
    #: Share of true neighbours, measured on the sample, that the lists of the first visit hold.
    reach: float = 0.98
    #: Candidates of a shelf that are reranked at the first visit.
    rerank: int = 256
    #: Shelves that the lists are packed into, and the most that one may hold.
    shelves: int = 32
    shelf_bytes: int = 32 << 20
    rounds: int = 6
    seed: int = 3


@dataclass
class Index:
    centroids: np.ndarray
    #: (pieces, 256, piece), zero-padded to whole pieces.
    books: np.ndarray
    #: A power of two; vectors are indexed times this.
    scale: float = 1.0

    def pieces(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        padded = np.zeros((len(x), m * d), np.float32)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, d)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        place = nearest(x, self.centroids)
        rest = self.pieces(x - self.centroids[place])
        codes = np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], 1)
        return place.astype(np.int32), codes.astype(np.uint8)

    def visits(self, queries: np.ndarray, count: int) -> np.ndarray:
        score = queries @ self.centroids.T
        return np.argpartition(-score, min(count, score.shape[1]) - 1, axis=1)[:, :count].astype(np.int32)

    def coded(self, codes: np.ndarray) -> np.ndarray:
        """What codes stand for, from the centroid on."""
        m, _, d = self.books.shape
        return self.books[np.arange(m), codes].reshape(len(codes), m * d)[:, : self.centroids.shape[1]]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pieces, 256) partial inner products."""
        return np.einsum("qmd,mkd->qmk", self.pieces(queries), self.books, optimize=True)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    bias = (centers * centers).sum(1) / 2
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = (x[a : a + 8192] @ centers.T - bias).argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centers (repeats where there are fewer distinct points)."""
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        at = nearest(x, centers)
        count = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            centers[:, d] = np.where(count > 0, np.bincount(at, x[:, d], minlength=k) / np.maximum(count, 1), centers[:, d])
    return centers


def fit(sample: np.ndarray, lists: int, s: Settings) -> Index:
    rng = np.random.default_rng(s.seed)
    centroids = kmeans(sample, lists, s.rounds, rng)
    rest = sample - centroids[nearest(sample, centroids)]
    m = -(-sample.shape[1] // s.piece)
    padded = np.zeros((len(rest), m * s.piece), np.float32)
    padded[:, : rest.shape[1]] = rest
    books = np.stack([kmeans(padded[:, i * s.piece : (i + 1) * s.piece], 256, s.rounds, rng) for i in range(m)])
    return Index(centroids, books)


def visits_for(index: Index, sample: np.ndarray, k: int, reach: float, most: int = 512) -> int:
    """Lists that queries must visit to meet ``reach`` of their k true neighbours, by the sample."""
    queries = sample[:most]
    place, order = nearest(sample, index.centroids), np.argsort(-(queries @ index.centroids.T), axis=1)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], 1)
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    few = min(k, len(sample) - 1)
    if few < 1:
        return len(index.centroids)
    best = np.argpartition(-score, few - 1, axis=1)[:, :few]
    met = np.sort(np.take_along_axis(turn, place[best], 1).ravel())
    return int(met[min(len(met) - 1, math.ceil(reach * len(met)))]) + 1


#: Parts of a list that its entries' hashes tell apart.
PARTS = 2.0**31


def pack(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists laid end to end and cut every ``room`` entries: where each starts, its first shelf and its number of shelves."""
    start = np.cumsum(counts) - counts
    first = start // room
    last = np.floor((start + counts * ((PARTS - 1) / PARTS)) / room).astype(np.int64)
    return start, first.astype(np.int32), (last - first + 1).astype(np.int32)


def addressed(to: np.ndarray, first: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of ``to`` (visited lists of each query) as (query, shelf, its lists there)."""
    return dealt_out(np.repeat(np.arange(len(to)), to.shape[1]), to.ravel(), first, span)


def dealt_out(row: np.ndarray, lists: np.ndarray, first: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Queries' rows and the lists that they visit as (query, shelf, its lists there)."""
    times = span[lists]
    row, lists, start = np.repeat(row, times), np.repeat(lists, times), np.repeat(first[lists], times)
    shelf = start + np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)
    order = np.lexsort((lists, shelf, row))
    row, shelf, lists = row[order], shelf[order], lists[order]
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[cut], shelf[cut], np.split(lists, cut[1:])


LEAST = np.finfo(np.float32).min
#: Longer vectors might overflow a score; they are compared with everything.
LONG = 1e140


def lengths(x: np.ndarray) -> np.ndarray:
    """In double precision, without overflow of squares; infinite where beyond."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(x).max(1, initial=0.0).astype(np.float64)
        size = most * np.sqrt(np.square(x / np.where(most > 0, most, 1.0)[:, None]).sum(1))
    return np.where(np.isnan(size), np.inf, size)


def from_centers(x: np.ndarray, index: Index, centers: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled vectors' distances from ``centers`` and the vectors' own lengths, a few rows at a time."""
    off, size, step = np.empty(len(x)), np.empty(len(x)), max(1, 2_000_000 // max(1, x.shape[1]))
    for a in range(0, len(x), step):
        at = slice(a, a + step)
        part = x[at].astype(np.float64)
        size[at] = lengths(part)
        with np.errstate(over="ignore"):
            off[at] = lengths(part * index.scale - centers(at))
    off[size >= LONG] = np.inf
    return off, size


def rounding(dimensions: int) -> float:
    """Relative error, with room to spare, of sums over that many dimensions in single precision."""
    return (2 * dimensions + 64) * 2.0**-23


def above(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def units(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and queries of length one in single precision."""
    size = lengths(queries)
    return size, (queries / size[:, None]).astype(np.float32)


def lowered(bars: np.ndarray, size: np.ndarray, index: Index) -> np.ndarray:
    """Scores as bars of the index's own estimates, rounded down; minus infinity where they rule nothing out."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        bar = bars / size * index.scale
        bar -= np.abs(bar) * 1e-12 + (index.centroids.shape[1] + 2) * np.maximum(1.0, 1.0 / size) * 5e-324 * index.scale
        bar = np.where(np.isfinite(bar) & (size < LONG), bar, -np.inf)
        return np.nextafter(bar.astype(np.float32), np.float32(-np.inf))


def reachable(index: Index, unit: np.ndarray, bars: np.ndarray, far: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """(queries, lists) whether a list's vectors, at most ``far`` from its centroid and ``longest`` (scaled), may reach the bar."""
    error = rounding(index.centroids.shape[1])
    slack = above(far * (1 + error) + error * lengths(index.centroids.astype(np.float64)))
    most = np.minimum(unit @ index.centroids.T + slack, above(longest * (1 + error)))
    return most >= bars[:, None]


@dataclass
class Shelf:
    """Entries by list and id, and where each list starts."""

    index: Index
    lists: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray

    def __post_init__(self) -> None:
        self.cuts = np.flatnonzero(np.r_[True, self.lists[1:] != self.lists[:-1], True])
        self.columns = np.ascontiguousarray(self.codes.T)

    @cached_property
    def slack(self) -> tuple[np.ndarray, np.ndarray]:
        """By how much an entry's score for a query of length one may exceed the estimate, and its length."""
        index, error = self.index, rounding(self.vectors.shape[1])
        known = np.empty(len(self.ids))

        def center(at: slice) -> np.ndarray:
            whole, rest = index.centroids[self.lists[at]].astype(np.float64), index.coded(self.codes[at]).astype(np.float64)
            known[at] = lengths(whole) + lengths(rest)
            return whole + rest

        off, size = from_centers(self.vectors, index, center)
        return above((1 + error) * off + error * known), size

    def scores(self, queries: np.ndarray, visited: list[np.ndarray]) -> np.ndarray:
        """(queries, entries) by centroid and look-up; minus infinity in lists that a query does not visit."""
        score = np.full((len(queries), len(self.ids)), -np.inf, np.float32)
        tables = self.index.tables(queries)
        owner, asked = np.repeat(np.arange(len(queries)), [len(v) for v in visited]), np.concatenate(visited)
        for a, b in zip(self.cuts, self.cuts[1:]):
            place = self.lists[a]
            who = owner[asked == place]
            if len(who):
                part = np.repeat((queries[who] @ self.index.centroids[place])[:, None], b - a, 1)
                for m, column in enumerate(self.columns):
                    part += tables[who, m].take(column[a:b], axis=1)
                score[who, a:b] = np.fmax(part, LEAST)  # sums that overflow still count as visited
        return score

    def search(self, query_ids: np.ndarray, queries: np.ndarray, visited: list[np.ndarray], k: int, rerank: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the best of the visited lists, each query's own id left out.

        ``rerank`` entries are compared exactly or, given the queries' bars, all that may reach them.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, 4_000_000 // max(1, len(self.ids)))
        for a in range(0, len(queries), step):
            asked = queries[a : a + step].astype(np.float64)
            size, unit = units(asked)
            low = None if bars is None else lowered(bars[a : a + step], size, self.index)
            for q, row in enumerate(self.scores(unit, visited[a : a + step])):
                row[self.ids == query_ids[a + q]] = -np.inf
                if bars is None:
                    best = self.likeliest(row, rerank)
                else:
                    with np.errstate(invalid="ignore"):
                        best = np.flatnonzero((row + self.slack[0] >= low[q]) & (row > -np.inf))
                    best = self.narrowed(best, asked[q], size[q], k, bars[a + q])
                if not len(best):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    got = (self.vectors[best].astype(np.float64) * asked[q]).sum(1)
                order = np.lexsort((self.ids[best], -got))[:k]
                out.append((np.full(len(order), query_ids[a + q]), self.ids[best[order]], got[order]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out))

    def likeliest(self, row: np.ndarray, rerank: int) -> np.ndarray:
        """Entries with the best estimates, ties by id."""
        few = min(rerank, int(np.count_nonzero(row > -np.inf)))
        if not few:
            return np.zeros(0, np.int64)
        bar = -np.partition(-row, few - 1)[few - 1]
        sure = np.flatnonzero(row > bar)
        ties = np.flatnonzero(row == bar)
        ties = ties[np.argsort(self.ids[ties], kind="stable")][: few - len(sure)]
        return np.concatenate([sure, ties])

    def narrowed(self, best: np.ndarray, asked: np.ndarray, size: float, k: int, bar: float) -> np.ndarray:
        """Those whose product may reach the bar and the k best of the shelf, whatever the order of its sum."""
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.vectors[best].astype(np.float64) @ asked
            off = (len(asked) + 2) * (2.0**-51 * size * self.slack[1][best] + 5e-324)
            if not (np.isfinite(rough).all() and np.isfinite(off).all()):
                return best
        if len(best) > k:
            bar = np.fmax(bar, np.partition(rough - off, len(best) - k)[len(best) - k])
        return best[~(rough + off < bar)]


def clamped(x: np.ndarray, scale: float) -> np.ndarray:
    """As the index sees vectors: single precision, within what it can square and sum."""
    with np.errstate(over="ignore"):
        return np.clip(x.astype(np.float64) * scale, -1e15, 1e15).astype(np.float32)


def usable(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that take part: key and vector (single precision if stored so, else double)."""
    x = F.col(column)
    kind = "float" if df.schema[column].dataType.simpleString() == "array<float>" else "double"
    inside = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    wide = df.select(F.col(key).cast("long").alias("id"), x.cast(f"array<{kind}>").alias(column))
    rows = wide.where(F.col("id").isNotNull() & x.isNotNull() & inside & F.exists(x, lambda v: v != 0)).select("id", F.col(column).alias("v"))
    size = rows.agg(F.mode(F.size("v"), True)).first()[0]
    return rows.where(F.size("v") == (size or 0))


def search(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each row where ``is_query``."""
    s, spark = settings, df.sparkSession
    rows = usable(df, key, column)
    n = rows.count()
    out = "query_id long, id long, score double"
    if not n:
        return spark.createDataFrame([], out).select("query_id", F.lit(0).alias("rank"), F.col("id").alias("vec_id"), "score")
    lists = max(1, min(s.sample // 8, round(math.sqrt(n) / 4)))
    # A bounded sample: 16 MB at 64 dimensions in single precision.
    size = min(s.sample, max(s.least_sample, 8 * lists))
    sample = rows.orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(size).select("v").toArrow()["v"].combine_chunks()
    wide = sample.flatten().to_numpy(zero_copy_only=False)
    kind = wide.dtype
    raw = wide.reshape(len(sample), -1)
    middle = np.median(lengths(raw.astype(np.float64)))
    scale = 2.0 ** -float(np.clip(np.round(np.log2(middle)), -1000, 1000))
    points = clamped(raw, scale)
    fitted = replace(fit(points, lists, s), scale=scale)
    visits = visits_for(fitted, points, k, s.reach)
    index = spark.sparkContext.broadcast(fitted)

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column(1)
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors(batch)
                place, codes = index.value.assign(clamped(x, scale))
                far, size = from_centers(x, index.value, lambda at: index.value.centroids[place[at]])
                with np.errstate(over="ignore"):
                    longest = np.where(size < LONG, size * scale, np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(longest)], names=["id", "list", "x", "code", "far", "longest"])

    entries = scratch.store(rows.mapInArrow(enter, "id long, list int, x binary, code binary, far double, longest double"), "ivf-entries")
    # One row per list, of which there are at most an eighth of the sample.
    counts, far, longest = np.zeros(lists, np.int64), np.zeros(lists), np.zeros(lists)
    for row in entries.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("longest").alias("longest")).collect():
        counts[row["list"]], far[row["list"]], longest[row["list"]] = row["n"], row["far"], row["longest"]
    room = max(1, min(-(-n // s.shelves), s.shelf_bytes // wide.itemsize // points.shape[1]))
    start, first, span = pack(counts, room)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries by shelf: at first without bar, for the likeliest lists, then with it, for all that may reach it."""
        for batch in batches:
            x = vectors(batch) if batch.num_rows else None
            for a in range(0, batch.num_rows, 1024):
                part = x[a : a + 1024]
                size, unit = units(part.astype(np.float64))
                if batch.num_columns == 2:
                    bars = np.full(len(part), np.nan)
                    row, shelf, to = addressed(index.value.visits(unit, visits), first, span)
                else:
                    bars = batch.column(2).slice(a, 1024).to_numpy()
                    may = reachable(index.value, unit, lowered(bars, size, index.value), far, longest) & (counts > 0)
                    row, shelf, to = dealt_out(*np.nonzero(may), first, span)
                held = [r.tobytes() for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(a, 1024).to_numpy()[row]), pa.array(shelf.astype(np.int32)), pa.array([held[r] for r in row], pa.binary()), pa.array([v.astype(np.int32).tobytes() for v in to], pa.binary()), pa.array(bars[row])], names=["id", "shelf", "x", "code", "bar"])

    places = spark.createDataFrame(pa.table({"list": np.arange(lists, dtype=np.int32), "start": start, "n": counts}))
    part = F.pmod(F.xxhash64("id", "x"), F.lit(int(PARTS))) / F.lit(PARTS)
    dealt = entries.join(F.broadcast(places), "list").withColumn("shelf", F.floor((F.col("start") + F.col("n") * part) / F.lit(float(room))).cast("int"))
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a shelf (with their list) come first and are held; its queries (with none) stream past them."""
        at, held, shelf = None, [], None

        def matrix(column: pa.Array, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(where, axis=0) != 0).any(1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if where[a, 0] != at:
                    at, held, shelf = where[a, 0], [], None
                part = batch.slice(a, b - a)
                if not where[a, 1]:
                    held.append(part)
                    continue
                if shelf is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks().sort_by([("list", "ascending"), ("id", "ascending")])
                    shelf, held = Shelf(index.value, table["list"].to_numpy(), table["id"].to_numpy(), matrix(table["x"], kind), matrix(table["code"], np.uint8)), []
                    del table
                visited = [np.frombuffer(v, np.int32) for v in part.column(4).to_pylist()]
                # The first visit has no bars, the second one has minus infinity at least.
                bars = part.column(5).to_numpy()
                got = shelf.search(part.column(2).to_numpy(), matrix(part.column(3), kind), visited, k, s.rerank, None if np.isnan(bars).any() else bars)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "id", "score"])

    names = ["shelf", "list", "id", "x", "code", "bar"]
    total = int((first + span).max())
    # Sums that overflow both ways are no number and come last.
    worth = F.nanvl("score", F.lit(float("-inf")))
    best = Window.partitionBy("query_id").orderBy(worth.desc(), "id")

    def visit(asking: DataFrame) -> DataFrame:
        asked = asking.mapInArrow(ask, "id long, shelf int, x binary, code binary, bar double")
        both = dealt.withColumn("bar", F.lit(None).cast("double")).select(*names).unionByName(asked.withColumn("list", F.lit(None).cast("int")).select(*names))
        found = both.repartitionById(total, F.col("shelf")).sortWithinPartitions("shelf", F.col("list").isNull()).mapInArrow(solve, out)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    bars = visit(queries).where(F.col("rank") == k).select(F.col("query_id").alias("id"), worth.alias("bar"))
    again = queries.join(bars, "id", "left").select("id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    return visit(again).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def report(df: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 20 asks for its 20 nearest."""
    return search(df, lambda i: i % 20 == 0)

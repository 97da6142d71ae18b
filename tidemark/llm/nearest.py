"""Approximate nearest neighbours: score-aware quantisation, four-bit table scans, exact reranking.

The square of a distance is |q'|^2 - 2 q'.r + |r|^2, where q' and r are query and vector, less the vector's nearest
centre (of a few hundred). So the nearest have the largest q'.r - |r|^2 / 2. Codes of r are four bits for each
pair of dimensions, of r's direction; its length is kept as it is, so that tight groups of vectors are told apart
like wide ones. Codes are trained and chosen to penalise the part of the residual that is parallel to r more than the
rest, as that part moves the large products. A second code, of what the first leaves out, is as long again.

A scan adds up table entries for two codes (a byte) at a time. With the length of what both codes leave out it
bounds each row's product: the k best lower bounds that a query has met decide which rows stay open. Only these are
fetched and measured on their vectors. A bound holds for all residuals with ``confidence`` at infinity (the result is exact
then); by default it holds for all but some 1 of 30,000 residuals whose direction has nothing to do with the query.

Every vector is coded and scanned, but of equal ones only those with the k + 1 least ids, as no query needs more.
A task scans one part of the codes for one bounded group of queries, run by run of a centre, in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spread import cut, scratch, spread_join

#: Queries in a group, rows that codebooks and centres are fitted on, pairs of a query and a row that a task scans (in the mean).
GROUP_QUERIES, SAMPLE_ROWS, TASK_PAIRS = 8_192, 8_192, 4_000_000_000
#: Rows of a part, at least: each part finds its own bounds, so small ones leave more open.
PART_ROWS = 4_096
CENTRES, ITERATIONS, SEED = 16, 6, 3
#: Most cells that the sample is cut into, and the sample's rows for each.
CELLS, CELL_ROWS = 256, 32
#: Share of a vector's norm that an inner product of interest reaches; sets the weight of parallel errors.
THRESHOLD = 0.25
#: Standard deviations of an error that a bound allows for, if what codes leave out points anywhere.
CONFIDENCE = 4.0
#: Pairs of a query and a row that are scanned at a time, and that are held open before they are looked through again.
PAIRS, HELD = 1 << 21, 1 << 22
#: Norms further than this (in powers of two) from the usual aren't coded: such rows are measured for all queries, such queries with all rows.
ODD = 40


class Quantiser:
    """Codebooks of 16 centres for each pair of dimensions (an odd last one is padded)."""

    def __init__(self, sample: np.ndarray, threshold: float = THRESHOLD, seed: int = SEED):
        self.size = sample.shape[1]
        x = self.padded(sample)
        self.parts = x.shape[1] // 2
        self.eta = max(1.0, (self.size - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        pairs = x.reshape(len(x), self.parts, 2)
        self.books = np.stack([pairs[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j] for j in range(self.parts)])
        for step in range(ITERATIONS):
            codes = self.encode(x, self.eta if step else 1.0)
            unit = self.unit(x).reshape(pairs.shape)
            residual = pairs - self.books[np.arange(self.parts), codes]
            along = np.einsum("njk,njk->nj", residual, unit)
            total = along.sum(1)
            for j in range(self.parts):  # the least of the loss in one codebook, the others held
                u, rest = unit[:, j], total - along[:, j]
                weight = self.eta - 1
                outer = weight * np.einsum("ni,nk->nik", u, u) + np.eye(2)
                target = pairs[:, j] + weight * u * (rest + np.einsum("nk,nk->n", pairs[:, j], u))[:, None]
                for c in range(CENTRES):
                    if (own := codes[:, j] == c).sum() > 2:
                        self.books[j, c] = np.linalg.solve(outer[own].sum(0), target[own].sum(0))
                change = np.einsum("nk,nk->n", pairs[:, j] - self.books[j, codes[:, j]], u)
                total, along[:, j] = rest + change, change
        self.books = self.books.astype(np.float32)

    def padded(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.zeros(len(x))]) if x.shape[1] % 2 else x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def encode(self, x: np.ndarray, eta: float | None = None) -> np.ndarray:
        """Codes that bring |r|^2 + (eta - 1) (r.u)^2 down, one pair of dimensions after the other, twice."""
        x = self.padded(x) if x.shape[1] == self.size else x
        pairs, u = x.reshape(len(x), self.parts, 2), self.unit(x).reshape(len(x), self.parts, 2)
        weight = (self.eta if eta is None else eta) - 1
        options = [((pairs[:, j, None] - self.books[j]), u[:, j]) for j in range(self.parts)]
        plain = [np.einsum("nck,nck->nc", r, r) for r, _ in options]
        codes = np.stack([p.argmin(1) for p in plain], 1)
        if weight <= 0:
            return codes
        along = [np.einsum("nck,nk->nc", r, v) for r, v in options]
        here = np.arange(len(x))
        total = sum(a[here, codes[:, j]] for j, a in enumerate(along))
        for _ in range(2):
            for j in range(self.parts):
                rest = total - along[j][here, codes[:, j]]
                codes[:, j] = (plain[j] + weight * (rest[:, None] + along[j]) ** 2).argmin(1)
                total = rest + along[j][here, codes[:, j]]
        return codes

    def packed(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.column_stack([codes, np.zeros(len(codes), np.uint8)])
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries and coded vectors."""
        q = self.padded(queries).reshape(len(queries), self.parts, 2).astype(np.float32)
        tables = np.einsum("qjk,jck->jqc", q, self.books)
        if self.parts % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:1])])
        out = np.zeros((len(queries), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            both = (tables[2 * j][:, :, None] + tables[2 * j + 1][:, None, :]).reshape(len(queries), 256)
            out += both[:, packed[:, j]]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.parts), codes].reshape(len(codes), -1)[:, : self.size].astype(np.float64)


class Codes:
    """Centres, and two codes of what is left of a vector without its centre: of its direction, and of what that leaves out."""

    def __init__(self, sample: np.ndarray):
        with np.errstate(all="ignore"):
            self.power = -int(np.frexp(np.median(np.abs(sample).max(1)))[1])  # brings the usual number near 1
            x, odd = self.scaled(sample)
        x = x[~odd]
        rng = np.random.default_rng(SEED)
        self.centres = x[rng.choice(len(x), max(1, min(CELLS, len(x) // CELL_ROWS)), replace=False)]
        for _ in range(ITERATIONS):
            own = self.nearest_centre(x)
            for c in np.unique(own):
                self.centres[c] = x[own == c].mean(0)
        r = x - self.centres[self.nearest_centre(x)]
        some = np.linalg.norm(r, axis=1) > 0
        u = Quantiser.unit(r[some]) if some.any() else np.eye(x.shape[1])
        self.first = Quantiser(u)
        left = u - self.first.decode(self.first.encode(u))
        self.second = Quantiser(Quantiser.unit(left), threshold=0.0)

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors near 1 in size, and which are too far from that."""
        x = np.ldexp(x.astype(np.float64), self.power)
        size = np.linalg.norm(x, axis=1)
        return x, ~((size < 2.0**ODD) & (size > 2.0**-ODD))

    def nearest_centre(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre (-1: not coded), both packed codes, and the lengths: of r, of what the first code leaves out, of what both do."""
        with np.errstate(all="ignore"):
            x, odd = self.scaled(vectors)
            x[odd] = 0
            centre = self.nearest_centre(x)
            r = x - self.centres[centre]
            length = np.linalg.norm(r, axis=1)
            u = Quantiser.unit(r)
            one = self.first.encode(u)
            left = u - self.first.decode(one)
            size = np.linalg.norm(left, axis=1)
            two = self.second.encode(Quantiser.unit(left))
            lost = np.linalg.norm(left - size[:, None] * self.second.decode(two), axis=1)
        packed = np.hstack([self.first.packed(one), self.second.packed(two)])
        return np.where(odd, -1, centre), packed, np.stack([length, length * size, length * lost], 1)


class Search:
    """A group of queries that codes stream past: what is open for each, by the best lower bounds met so far."""

    def __init__(self, codes: Codes, k: int, confidence: float, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.k, self.ids = codes, k, ids
        with np.errstate(all="ignore"):
            self.x, self.odd = codes.scaled(vectors)
        self.x[self.odd] = 0
        self.reach = min(1.0, confidence / math.sqrt(codes.first.size))
        self.best = np.full((len(ids), k), -np.inf)
        self.open: list[tuple[np.ndarray, ...]] = []
        self.size = self.scanned = 0

    def add(self, centre: int, name: np.ndarray, hashed: np.ndarray, packed: np.ndarray, sizes: np.ndarray) -> None:
        """Scans a run of coded rows that have one centre."""
        if centre < 0:
            self.take(np.arange(len(self.ids)), name, hashed)
            return
        if self.odd.any():
            self.take(np.flatnonzero(self.odd), name, hashed)
        q = self.x - self.codes.centres[centre]
        away = np.linalg.norm(q, axis=1)
        length, left, lost = sizes.T
        nearest = np.maximum(away - length.max() * (1 + 1e-9), 0)
        ask = np.flatnonzero(~self.odd & (-(nearest**2) / 2 * (1 - 1e-9) >= self.best.min(1)))
        half, width = self.codes.first, -(-self.codes.first.parts // 2)
        fuzz = (2 * half.parts + 16) * 2.0**-23
        for at in range(0, len(ask), step := max(1, PAIRS // len(name))):
            some = ask[at : at + step]
            far = away[some, None]
            score = half.scan(q[some], packed[:, :width]) * length + self.codes.second.scan(q[some], packed[:, width:]) * left
            score -= far**2 / 2 + length**2 / 2
            score[self.ids[some, None] == name] = -np.inf
            error = far * (self.reach * lost + fuzz * (length + left)) + fuzz * (far**2 + length**2) + 2.0**-50 * (far + length)
            self.scanned += score.size
            best = np.column_stack([self.best[some], np.partition(score - error, max(0, len(name) - self.k), axis=1)[:, -self.k :]])
            self.best[some] = np.partition(best, best.shape[1] - self.k, axis=1)[:, -self.k :]
            upper = score + error
            i, j = np.nonzero((upper >= self.best[some].min(1)[:, None]) & (score > -np.inf))
            self.hold(some[i], name[j], hashed[j], (score - error)[i, j], upper[i, j])

    def take(self, queries: np.ndarray, name: np.ndarray, hashed: np.ndarray) -> None:
        i, j = np.nonzero(self.ids[queries, None] != name)
        self.hold(queries[i], name[j], hashed[j], np.full(len(i), -np.inf), np.full(len(i), np.inf))

    def hold(self, *pairs: np.ndarray) -> None:
        self.open.append(pairs)
        self.size += len(pairs[0])
        if self.size > HELD:
            self.open = [self.left()]
            self.size = len(self.open[0][0])

    def left(self) -> tuple[np.ndarray, ...]:
        """Query, id, hash, lower and upper bound of the pairs that are open still."""
        query, *rest, upper = map(np.concatenate, zip(*self.open, strict=True))
        keep = upper >= self.best.min(1)[query]
        return tuple(c[keep] for c in (query, *rest, upper))

    def found(self) -> pa.RecordBatch:
        empty = np.zeros(0, np.int64)
        query, name, hashed, lower, upper = self.left() if self.open else (empty,) * 5
        columns = [pa.array(c.astype(np.int64)) for c in (self.ids[query] if len(query) else empty, name, hashed)]
        return pa.record_batch([*columns, pa.array(lower.astype(float)), pa.array(upper.astype(float))], ["query_id", "vec_id", "h", "lower", "upper"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of doubles) of the vectors that take part: with an id, finite, not zero, of the commonest length (of several, the least)."""
    x = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = whole.where(finite & F.exists("x", lambda v: v != 0))
    top = whole.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return whole.where(F.size("x") == (top[0]["n"] if top else 0))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, sample: int = SAMPLE_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance, double) of the k nearest found for each query.

    queries: a condition on vec_id that picks the queries among the vectors. Every other row is a candidate;
    rows that share a query's id are not, and of several the least vector is asked for. Equal rows are candidates each;
    ties go to the smaller id. Vectors that are null or zero, or hold nulls or non-finite numbers, take no part, nor do
    those of another length than most. Very large and very small numbers are fine. With fewer than k candidates all
    come. Other columns are left out; a table may be empty.
    """
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        whole = usable(vectors)
        fitted = whole.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample).select("x").toArrow()  # a bounded sample
        if not fitted.num_rows:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        nth = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
        held = whole.groupBy("x", "vec_id").agg(F.count(F.lit(1)).alias("n")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
        held = cut(held.select("vec_id", F.xxhash64("x").alias("h"), "x", F.least("n", F.lit(k)).cast("int").alias("n")))
        asked = cut(whole.where(queries).groupBy("vec_id").agg(F.min("x").alias("x")))
        found = cut(still_open(cut(candidates(held, asked, Codes(matrix(fitted.column("x"))), k, confidence)), k))
        rows = found.count()
        limit = max(1_000, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        table = held.join(found.groupBy("vec_id", "h").agg(F.count(F.lit(1)).alias("weight")), ["vec_id", "h"])
        pairs = spread_join(found, table, ["vec_id", "h"], "weight", limit).select("query_id", "vec_id", "n", "x")
        pairs = pairs.join(asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")
        measured = pairs.mapInArrow(measure, "query_id long, vec_id long, n int, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        each = measured.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
        ranked = each.withColumn("rank", place).where(F.col("rank") <= k)
        return keep(ranked.select("query_id", "rank", "vec_id", "score"))


def candidates(held: DataFrame, asked: DataFrame, codes: Codes, k: int, confidence: float) -> DataFrame:
    """query_id, vec_id, h and bounds of the rows that a part's codes leave open for each query. held: vec_id, h, x; asked: vec_id, x."""
    spark = held.sparkSession
    sent = spark.sparkContext.broadcast(codes)
    rows, queries = held.count(), asked.count()
    groups = max(1, math.ceil(queries / GROUP_QUERIES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * queries / TASK_PAIRS))
    parts = max(1, min(math.ceil(tasks / groups), rows // PART_ROWS))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                centre, packed, sizes = sent.value.encode(matrix(part.column("x")))
                lists_ = pa.FixedSizeListArray.from_arrays(pa.array(sizes.ravel()), 3).cast(pa.list_(pa.float64()))
                yield pa.record_batch([part.column("vec_id"), part.column("h"), pa.array(centre.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), lists_], ["vec_id", "h", "centre", "code", "x"])

    number = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    coded = held.select("vec_id", "h", "x").mapInArrow(code, "vec_id long, h long, centre int, code binary, x array<double>")
    coded = coded.withColumn("part", number(parts, SEED)).withColumn("group", every(groups)).withColumn("kind", F.lit(1))
    none = lambda kind: F.lit(None).cast(kind)
    sought = asked.select("vec_id", none("long").alias("h"), none("int").alias("centre"), none("binary").alias("code"), "x", every(parts).alias("part"))
    sought = sought.withColumn("group", number(groups, SEED + 1)).withColumn("kind", F.lit(0))
    both = coded.unionByName(sought).withColumn("pair", (F.col("group") * parts + F.col("part")).cast("int")).drop("group", "part")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, search, ids, x = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c, batch=batch: np.asarray(batch.column(c).fill_null(-2))
            of = np.stack([column("pair"), column("kind"), column("centre")])
            first = np.flatnonzero(np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(0)]))
            names, hashed = column("vec_id"), column("h")
            for a, b in zip(first, np.append(first[1:], batch.num_rows), strict=True):
                if pair != of[0, a]:
                    if search:
                        yield search.found()
                    pair, search, ids, x = of[0, a], None, [], []
                if of[1, a] == 0:
                    ids.append(names[a:b])
                    x.append(matrix(batch.column("x").slice(a, b - a)))
                elif ids:
                    if search is None:
                        search = Search(sent.value, k, confidence, np.concatenate(ids), np.concatenate(x))
                    packed = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in batch.column("code").slice(a, b - a)])
                    search.add(int(of[2, a]), names[a:b], hashed[a:b], packed, matrix(batch.column("x").slice(a, b - a)))
        if search:
            yield search.found()

    return both.repartition(groups * parts, "pair").sortWithinPartitions("pair", "kind", "centre").mapInArrow(scan, "query_id long, vec_id long, h long, lower double, upper double")


def still_open(found: DataFrame, k: int) -> DataFrame:
    """The rows that are open by the k best lower bounds of all parts."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    best = found.select("query_id", "lower").withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("least"))
    least = F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf"))
    return found.join(best, "query_id").where(F.col("upper") >= least).select("query_id", "vec_id", "h")


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of x and q, in double precision, whatever their size."""
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            with np.errstate(all="ignore"):
                x, q = matrix(part.column("x")), matrix(part.column("q"))
                square = ((x - q) ** 2).sum(1)
                score = np.sqrt(square)
                for i in np.flatnonzero(~((square > 1e-280) & (square < 1e300))):  # squares that are too large or too small
                    most = max(np.abs(x[i]).max(), np.abs(q[i]).max())
                    apart = np.abs(x[i] / 2 - q[i] / 2) if most > 1e300 else np.abs(x[i] - q[i])
                    top = apart.max()
                    score[i] = 0.0 if top == 0 else top * np.sqrt(((apart / top) ** 2).sum()) * (2 if most > 1e300 else 1)
            yield pa.record_batch([part.column("query_id"), part.column("vec_id"), part.column("n"), pa.array(score)], ["query_id", "vec_id", "n", "score"])


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten())
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)

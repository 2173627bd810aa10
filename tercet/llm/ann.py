"""Each vector's nearest neighbours by inner product, with anisotropic quantisation.

1. Vectors are assigned to the nearest of about sqrt(N) / 4 centroids (k-means on a sample). A vector's
   neighbours are sought in the cells whose centroids have the greatest inner products with it; how many cells are needed is measured: for
   `probes` sample vectors the true neighbours are found among all vectors, and as many cells are probed as hold `aim` of them.
2. A vector's residual to its centroid is quantised by a product code of four bits for each `width` coordinates. The loss is
   score-aware: of the residual error, the part parallel to the vector, which shifts the inner products that matter, weighs
   eta = (d - 1) t^2 / (1 - t^2) times as much as the part orthogonal to it. Codes are chosen by coordinate descent on this loss, and codebooks solve its normal equations.
3. A cell's task scans its codes for all queries sent there: a query's table of inner products with the codebook entries, in
   16 bits, is summed over the codes, two codes at a time. The cell's best `rerank` times k are ranked again with exact inner products, and a query's cells are merged.
   A cell of more than `block` vectors is scanned block by block, so that a hot one is spread over tasks.

The queries are the vectors whose id is divisible by `every`; all vectors are searched. Only the sample that trains centroids and codebooks and the sample that measures are bounded; they are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_buffer, least_hashed, reduce_partitions, sized, written

SCHEMA = "vec_id long, neighbour_id long, rank int, score double"


def vectors_of(table: DataFrame) -> DataFrame:
    """(vec_id, v), the rows that can be compared: with an id and coordinates without nulls and of finite value; one row an id, that of the least vector."""
    v = F.col("embedding").cast("array<float>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
        sums = np.add.reduceat(x[order], cuts, axis=0)
        centres[own[order][cuts]] = sums / np.diff(np.append(cuts, len(x)))[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Codebook:
    """entries: (places, 16, width); each place covers `width` coordinates, the last may be padded with zeros."""

    entries: np.ndarray
    d: int
    eta: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.entries.shape
        out = np.zeros((len(x), m * w), np.float32)
        out[:, : self.d] = x
        return out.reshape(len(x), m, w)

    def encoded(self, residual: np.ndarray, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of least score-aware loss: |e|^2 + (eta - 1) (e . x / |x|)^2, for the error e, place by place."""
        r, u = self.parts(residual), self.parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        squares = (self.entries**2).sum(2)
        plain = (r**2).sum(2)[:, :, None] - 2 * np.einsum("nmw,mkw->nmk", r, self.entries) + squares
        aside = np.einsum("nmw,nmw->nm", r, u)[:, :, None] - np.einsum("nmw,mkw->nmk", u, self.entries)  # e . u by place and entry
        codes = plain.argmin(2)
        rows = np.arange(len(r))
        places = np.arange(r.shape[1])
        along = aside[rows[:, None], places, codes].sum(1)
        for _ in range(rounds):
            for m in places:
                rest = along - aside[rows, m, codes[:, m]]
                codes[:, m] = (plain[:, m] + (self.eta - 1) * (rest[:, None] + aside[:, m]) ** 2).argmin(1)
                along = rest + aside[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.entries[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.d]

    def loss(self, residual: np.ndarray, x: np.ndarray, codes: np.ndarray) -> float:
        e = residual - self.decoded(codes)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return float(((e**2).sum(1) + (self.eta - 1) * (e * u).sum(1) ** 2).mean())

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Each query's inner products with all entries: (queries, places, 16)."""
        return np.einsum("qmw,mkw->qmk", self.parts(queries), self.entries)


def codebook_of(residual: np.ndarray, x: np.ndarray, *, width: int, threshold: float, rounds: int, rng: np.random.Generator) -> Codebook:
    n, d = x.shape
    m = -(-d // width)
    m += m % 2
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    book = Codebook(np.zeros((m, 16, width), np.float32), d, eta)
    r, u = book.parts(residual), book.parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    for j in range(m):
        some = r[rng.choice(n, 16, replace=n < 16), j]
        book.entries[j] = some + rng.normal(0, 1e-6, some.shape)
    for _ in range(rounds):
        codes = book.encoded(residual, x, 1)
        error = r - book.entries[np.arange(m), codes]
        along = (error * u).sum((1, 2))
        for j in range(m):
            rest = along - (error[:, j] * u[:, j]).sum(1)
            for k in range(16):
                own = codes[:, j] == k
                if not own.any():
                    continue
                uk, rk = u[own, j].astype(float), r[own, j].astype(float)
                left = own.sum() * np.eye(width) + (eta - 1) * uk.T @ uk
                right = rk.sum(0) + (eta - 1) * ((rest[own] + (rk * uk).sum(1))[:, None] * uk).sum(0)
                book.entries[j, k] = np.linalg.solve(left, right)
            error[:, j] = r[:, j] - book.entries[j, codes[:, j]]
            along = rest + (error[:, j] * u[:, j]).sum(1)
    return book


def scan(tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the tables' values at the codes, as integers (queries, vectors), and what one unit is for each query.
    codes: a byte for each two places."""
    q, m, _ = tables.shape
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(q, m // 2, 256)
    unit = np.maximum(np.abs(pairs).max(2).sum(1) / 32_000, 1e-30)
    pairs = np.rint(pairs / unit[:, None, None]).astype(np.int16)
    out = np.zeros((q, len(codes)), np.int16)
    for j in range(m // 2):
        out += pairs[:, j].take(codes[:, j], axis=1)
    return out, unit


@dataclass
class Index:
    centres: np.ndarray
    book: Codebook
    n_probe: int


def exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k true neighbours of a few queries among all vectors: their ids and vectors' places in order are merged on the driver from k a task."""
    d = queries.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best: np.ndarray | None = None
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
            scores = queries @ x.T
            scores[ids[:, None] == own] = -np.inf
            take = min(k, len(own))
            top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
            new = np.stack([np.take_along_axis(scores, top, 1).astype(np.float64), own[top].astype(np.int64).view(np.float64)])
            best = new if best is None else np.concatenate([best, new], 2)
            if best.shape[2] > k:
                top = np.argpartition(-best[0], k - 1, axis=1)[:, :k]
                best = np.stack([np.take_along_axis(b, top, 1) for b in best])
        if best is not None:
            n = best.shape[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), n)), pa.array(best[1].view(np.int64).ravel()), pa.array(best[0].ravel())], ["q", "id", "score"])

    rows = vectors.mapInArrow(run, "q long, id long, score double")
    top = rows.where(F.col("score") > float("-inf")).groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "id")))), 1, k).alias("t"))
    return top.select("q", F.explode("t.id").alias("vec_id"))


def index_of(vectors: DataFrame, k: int, *, sample: int = 20_000, probes: int = 256, aim: float = 0.98, width: int = 4, threshold: float = 0.2, seed: int = 3) -> Index:
    """vectors: (vec_id, v), all of one length."""
    n = vectors.count()
    rows = least_hashed(vectors, "vec_id", sample).toArrow()
    ids, d = rows.column(0).to_numpy(), len(rows.column(1)[0])
    x = matrix(rows.column(1), d)
    rng = np.random.default_rng(seed)
    centres = kmeans(x, min(len(x), max(1, round(n**0.5 / 4))), 8, rng)
    book = codebook_of(x - centres[nearest(x, centres)], x, width=width, threshold=threshold, rounds=6, rng=rng)
    queries = x[:probes]
    truth = exact(vectors, ids[:probes], queries, k).join(vectors, "vec_id").toArrow()
    if not truth.num_rows:
        return Index(centres, book, 1)
    cells = nearest(matrix(truth.column("v"), d), centres)
    places = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(places[truth.column("q").to_numpy(), cells]) + 1
    return Index(centres, book, int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]))


def _neighbours(vectors: DataFrame, k: int, every: int, rerank: int, block: int, options: dict) -> DataFrame:
    spark = vectors.sparkSession
    vectors = written(vectors)
    first = vectors.select("v").first()
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    d = len(first["v"])
    shared = spark.sparkContext.broadcast(index_of(vectors, k, **options))
    schema = "cell int, kind int, vec_id long, v binary"

    def packed(x: np.ndarray) -> pa.Array:
        offsets = np.arange(0, x.size * 4 + 1, d * 4, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float32))])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its cell (kind 0), and as a query (1) to the cells that it probes."""
        index = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x, index.centres), pa.int32()), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), packed(x)], ["cell", "kind", "vec_id", "v"])
            asked = ids % every == 0
            ids, x = ids[asked], x[asked]
            for a in range(0, len(ids), 1024):
                own = x[a : a + 1024]
                scores = own @ index.centres.T
                cells = np.argpartition(-scores, index.n_probe - 1, axis=1)[:, : index.n_probe]
                at = np.repeat(np.arange(len(own)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), pa.array(np.ones(len(at), np.int32)), pa.array(ids[a : a + 1024][at]), packed(own[at])], ["cell", "kind", "vec_id", "v"])

    rows = vectors.mapInArrow(routed, schema)
    # A cell's vectors are cut in blocks by hash; its queries go to each of them.
    sizes = written(rows.where("kind = 0").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    part = F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = rows.join(sized(sizes, 16), "cell").select("cell", F.explode(part).alias("part"), "kind", "vec_id", "v")  # a row a cell: no more than there are centroids

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        here, ids, x, codes, centre = None, np.zeros(0, np.int64), None, None, None
        gathered: list[tuple[np.ndarray, np.ndarray]] = []

        def found(queries: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = min(len(ids), k * rerank + 1)
            for a in range(0, len(q), 64):
                own, name = q[a : a + 64], queries[a : a + 64]
                if keep < len(ids):
                    sums, _ = scan(index.book.tables(own), codes)
                    top = np.argpartition(-sums, keep - 1, axis=1)[:, :keep]
                else:
                    top = np.broadcast_to(np.arange(len(ids)), (len(own), len(ids)))
                scores = np.einsum("qd,qrd->qr", own.astype(np.float64), x[top])
                scores[ids[top] == name[:, None]] = -np.inf
                order = np.lexsort((ids[top], -scores), axis=1)[:, :k]  # of rerank * k a query
                best, score = np.take_along_axis(ids[top], order, 1), np.take_along_axis(scores, order, 1)
                real = score.ravel() > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, order.shape[1])[real]), pa.array(best.ravel()[real]), pa.array(score.ravel()[real])], ["vec_id", "neighbour_id", "score"])

        for batch in batches:
            cells, parts, kinds, names = (batch.column(i).to_numpy() for i in range(4))
            q = as_buffer(batch.column(4))[0].view(np.float32).reshape(-1, d)
            edges = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])))
            for a, b in zip(edges, np.append(edges[1:], len(cells))):
                if (place := (int(cells[a]), int(parts[a]))) != here:
                    here, gathered, x = place, [], None
                if kinds[a] == 0:
                    gathered.append((names[a:b], q[a:b]))
                elif gathered:
                    if x is None:
                        ids, x = (np.concatenate(c) for c in zip(*gathered))
                        centre = index.centres[here[0]]
                        two = index.book.encoded(x - centre, x)
                        codes = two[:, 0::2] << 4 | two[:, 1::2]
                        x = x.astype(np.float64)
                    yield from found(names[a:b], q[a:b])

    n = reduce_partitions(spark)
    scored = placed.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(searched, "vec_id long, neighbour_id long, score double")
    best = scored.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "neighbour_id"))), 1, k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("place", "b")).select("vec_id", F.col("b.neighbour_id").alias("neighbour_id"), (F.col("place") + 1).cast("int").alias("rank"), (-F.col("b.minus")).alias("score"))


def neighbours(table: DataFrame, k: int = 10, *, every: int = 100, rerank: int = 8, block: int = 8192, **options: float) -> DataFrame:
    """(vec_id, neighbour_id, rank, score): for each vector whose id is divisible by `every` the k others of greatest inner product, ranks from 1.

    Rows with a null id, a null or empty vector, or a coordinate that is null or not finite are left out. Of rows that repeat a vec_id one counts, that of least vector. Vectors of
    several lengths are searched length by length. Of equal scores the lesser id comes first. Equal vectors of different ids are
    each other's neighbours. With fewer than k others there are fewer rows. Other columns aren't read; an empty table gives no rows.
    """
    vectors = vectors_of(table)
    sizes = [r[0] for r in vectors.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = [_neighbours(vectors.where(F.size("v") == d), k, every, rerank, block, options) for d in sizes]
    out = found[0] if found else table.sparkSession.createDataFrame([], SCHEMA)
    for f in found[1:]:
        out = out.unionByName(f)
    return out

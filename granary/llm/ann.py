"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half is quantised by a codebook of its own; a pair of centroids is a cell. For
a query, a heap yields cells by the sum of the two centroid distances until they hold enough vectors, and the entries of
these cells are reranked by exact distance. Codebooks are fitted on a bounded sample; every vector is indexed. Cells are
dealt to regions of bounded size, a large one to several, and queries to batches of bounded size, so neither side of a
group grows with the table. A query goes to a region once, with the distance that its cells reach to.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import K1, mix, pick, stored


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of vectors that take part: an id, no null or non-finite component, not zero. Of rows that share an id, the least vector counts."""
    v = pick(vectors, **{vec_id: "long", embedding: "array<double>"}).toDF("vec_id", "v")
    ok = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"
    return v.where(ok).groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from distinct points drawn from x."""
    points = np.unique(x, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    return centres


def _half_distances(x: np.ndarray, books: tuple) -> tuple[np.ndarray, np.ndarray]:
    d = x.shape[1] // 2
    return tuple(np.maximum(0, (p**2).sum(1)[:, None] - 2 * p @ c.T + (c**2).sum(1)) for p, c in zip((x[:, :d], x[:, d:]), books, strict=True))


def cells_in_order(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of one entry of each list, by the sum of their distances: a heap over the sorted lists."""
    i_order, j_order = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    x, y = a[i_order].tolist(), b[j_order].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:  # one open pair for each row that has been reached, and the first pair of the next row
        _, i, j = heap[0]
        yield i_order[i], j_order[j]
        if j + 1 < len(y):
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def cell_regions(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first region of each cell, and how many it is dealt over: neighbouring small cells share a region of about block vectors, a larger cell is cut."""
    first, parts = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    region = held = 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if held and held + n > block:
            region, held = region + 1, 0
        first[cell] = region
        if n > block:
            parts[cell] = -(-n // block)
            region += int(parts[cell])
        else:
            held += n
    return first, parts


class MultiIndex:
    """vectors: vec_id, v, all of one length.

    codes: centroids a half (half to all of the square root of the number of vectors, 1024 at most, if None); sample: rows that
    codebooks are fitted on; block: vectors searched together; batch: queries searched together.
    """

    def __init__(self, vectors: DataFrame, codes: int | None = None, sample: int = 20_000, block: int = 4096, batch: int = 4096) -> None:
        self.total, self.batch = vectors.count(), batch
        self.codes = codes or min(1024, 1 << max(2, math.ceil(math.log2(max(1, self.total)) / 2 - 1)))
        fitted = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]  # a bounded sample
        most = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
        scale = 1 / most if most else 1.0  # no square overflows where cells are found
        x = np.stack(list(fitted)) * scale if len(fitted) else np.zeros((0, 2))
        d = x.shape[1] // 2
        books = tuple(kmeans(p, self.codes) if p.shape[1] and len(p) else np.zeros((1, p.shape[1])) for p in (x[:, :d], x[:, d:]))
        context = vectors.sparkSession.sparkContext
        placed = stored(vectors.mapInArrow(_assigned(context.broadcast((books, scale)), self.codes), "vec_id long, v array<double>, cell int"))
        self.counts = np.zeros(self.codes**2, np.int64)
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # codes**2 rows at most
            self.counts[r.cell] = r.n
        self.shared = context.broadcast((books, scale, self.codes, self.counts, *cell_regions(self.counts, block)))
        self.entries = placed.mapInArrow(_dealt(self.shared), "vec_id long, v array<double>, cell int, region int")

    def search(self, queries: DataFrame, k: int = 10, share: float = 0.5, least: int = 30) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest entries of each query's cells, its own id left out.

        Cells are taken, nearest first, until they hold the share of all entries and least times k of them (all, if fewer).
        """
        enough = max(least * k, math.ceil(share * self.total)) + 1
        batches = max(1, -(-queries.count() // self.batch))
        of_batch = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(batches)).cast("int")
        probes = queries.mapInArrow(_probed(self.shared, enough), "query_id long, q array<double>, bound double, region int").withColumn("batch", of_batch)
        entries = self.entries.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        near = probes.groupBy("region", "batch").cogroup(entries.groupBy("region", "batch")).applyInPandas(_nearest(self.shared, k), "query_id long, vec_id long, score double")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _assigned(shared: object, codes: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, scale = shared.value
        for batch in batches:
            if batch.num_rows:
                a, b = _half_distances(_matrix(batch.column("v")) * scale, books)
                cell = pa.array((a.argmin(1) * codes + b.argmin(1)).astype(np.int32))
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), cell], ["vec_id", "v", "cell"])

    return f


def _dealt(shared: object) -> Callable:
    """The region of each entry; those of a large cell by a hash of their id."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, first, parts = shared.value
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            part = (mix(ids.astype(np.uint64) * K1) % parts[cell].astype(np.uint64)).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(first[cell] + part)], ["vec_id", "v", "cell", "region"])

    return f


def _probed(shared: object, enough: int) -> Callable:
    """Each query with the summed distance of its last cell, once for each region that holds one of its cells."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, scale, codes, counts, first, parts = shared.value
        held = counts.tolist()
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _half_distances(_matrix(batch.column("v")) * scale, books)
            row, bounds, regions = [], [], []
            for i in range(batch.num_rows):
                seen, cells = 0, []
                for x, y in cells_in_order(a[i], b[i]):
                    cell = x * codes + y
                    if held[cell]:
                        seen += held[cell]
                        cells.append(cell)
                        if seen >= enough:
                            break
                bound = float(a[i, cells[-1] // codes] + b[i, cells[-1] % codes])
                cells = np.array(cells)
                found = np.unique(first[cells]).tolist() + [int(first[c]) + p for c in cells[parts[cells] > 1].tolist() for p in range(1, int(parts[c]))]
                row += [i] * len(found)
                bounds += [bound] * len(found)
                regions += found
                if len(row) > 20_000 or i == batch.num_rows - 1:
                    at = pa.array(row, pa.int64())
                    yield pa.record_batch([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(bounds, pa.float64()), pa.array(regions, pa.int32())], ["query_id", "q", "bound", "region"])
                    row, bounds, regions = [], [], []

    return f


def _nearest(shared: object, k: int) -> Callable:
    """The k nearest entries of one region to each of its queries, among the cells within the query's bound."""

    def f(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(entries):
            books, scale, codes, *_ = shared.value
            entries = entries.sort_values("vec_id")
            ids, v, cell = entries["vec_id"].to_numpy(), np.stack(list(entries["v"])), entries["cell"].to_numpy()
            cells, which = np.unique(cell, return_inverse=True)
            for start in range(0, len(queries), 256):
                some = queries.iloc[start : start + 256]
                q = np.stack(list(some["q"]))
                a, b = _half_distances(q * scale, books)
                reach = a[:, cells // codes] + b[:, cells % codes] <= some["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12
                for query, x, inside in zip(some["query_id"], q, reach, strict=True):
                    at = np.flatnonzero(inside[which] & (ids != query))
                    with np.errstate(over="ignore"):
                        score = np.sqrt(((v[at] - x) ** 2).sum(1))
                    if len(score) > k:
                        low = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                        at, score = at[low], score[low]
                    order = np.argsort(score, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[order]], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})

    return f


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, share: float = 0.5, codes: int | None = None) -> DataFrame:
    """For every row whose vec_id is divisible by every, its k nearest others: query_id, rank, vec_id, score (Euclidean distance).

    Ties go to the smaller vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows without an id. Distances beyond the largest double are infinite, and rank last. Very long vectors are halved like any
    other. Vectors of different lengths have no distance: each length is searched by itself. Rows that share an
    id count once, with the least vector. Other columns are ignored, whatever their names; no rows give no rows.
    """
    v = stored(usable(vectors))
    found = None
    for r in v.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # an index for each length of vector
        alike = v.where(F.size("v") == r.n)
        part = MultiIndex(alike, codes).search(alike.where(F.col("vec_id") % every == 0), k, share)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return found

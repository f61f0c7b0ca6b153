"""Vector codes: product quantisation in whole numbers, the same wherever and however often a task runs.

Components become integers, vectors are cut into parts, and each part position has a codebook, which is broadcast. A task
computes the distances of a block of vectors to all entries by the expansion of norms, as int64 matrix products, and takes
the first least. It sums the parts of each entry over all its rows; a grouped shuffle merges the sums of all tasks, and
their floored means are the next codebook.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import quoted, stored

#: Vectors whose distances are in memory at a time.
BLOCK = 2048
#: Labels of at least this share of the rows get their sums by broadcast: no more than 1 / HOT of them.
HOT = 0.001


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lists are whole (not null, all components finite), the floored multiples of the components of those, and their lengths."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False) * float(scale)  # nulls are NaN here
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kept = ~np.asarray(lists.is_null().to_numpy(zero_copy_only=False))
    kept[owner[~np.isfinite(lists.flatten().to_numpy(zero_copy_only=False))]] = False
    values, sizes = np.floor(values[kept[owner]]), sizes[kept]
    if len(values) and np.abs(values).max() > limit(int(sizes.max())):
        raise ValueError(f"components beyond {limit(int(sizes.max())) / scale:.0f}: their squared distances don't fit in 64 bits")
    return kept, values.astype(np.int64), sizes


def limit(size: int) -> int:
    """The largest integer component with which squared distances of vectors of that length stay below 2**63."""
    return math.isqrt((2**63 - 1) // (4 * max(1, size)))


def padded(values: np.ndarray, sizes: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Rows x parts x width; components past a vector's end are 0."""
    out = np.zeros((len(sizes), parts * width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out.reshape(len(sizes), parts, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and squared distance to it, both rows x parts. books: parts x entries x width."""
    by_part = np.ascontiguousarray(x.transpose(1, 0, 2))
    far = (by_part * by_part).sum(2)[:, :, None] - 2 * np.matmul(by_part, books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    code = far.argmin(2)
    return code.T, np.take_along_axis(far, code[:, :, None], 2)[:, :, 0].T


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            some = batch.slice(a, BLOCK)
            kept, values, sizes = integers(some.column("vector"), scale)
            yield some.filter(pa.array(kept)), padded(values, sizes, parts, width)


def _sums(books: object, scale: int) -> Callable:
    """Task sums of the parts that each entry is nearest to."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = books.value
        parts, entries, width = known.shape
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, x in _blocks(batches, scale, parts, width):
            at = (nearest(x, known)[0] + entries * np.arange(parts)).ravel()
            n += np.bincount(at, minlength=len(n))
            flat = x.reshape(-1, width)
            for k in range(width):
                np.add.at(total[:, k], at, flat[:, k])
        used = np.flatnonzero(n)
        rows = np.repeat(used, width)
        yield pa.record_batch([pa.array(c) for c in (rows // entries, rows % entries, np.tile(np.arange(width), len(used)), total[used].ravel(), n[rows])], ["part", "entry", "at", "total", "n"])

    return f


def _codes(books: object, scale: int) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = books.value
        for some, x in _blocks(batches, scale, known.shape[0], known.shape[2]):
            code, far = nearest(x, known)
            text = code.astype(np.uint8).tobytes().hex()
            step = 2 * known.shape[0]
            yield pa.record_batch([some.column("vec_id"), some.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    return f


def _input(vectors: DataFrame, label: bool = True) -> DataFrame:
    own = quoted("label") if label and "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.select(quoted("vec_id").cast("long").alias("vec_id"), own.alias("label"), quoted("embedding").cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray | None:
    """Codebooks as integers, parts x entries x width; None if no vector is whole. See compress."""
    if not 0 < entries <= 256:
        raise ValueError("an entry has two hexadecimal digits")
    given = _input(vectors, label=False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values, sizes = integers(batch.column("vector"), scale)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
            yield pa.record_batch([batch.column("vec_id").filter(pa.array(kept)), lists], ["vec_id", "v"])

    kept = given.select("vec_id", "vector").mapInArrow(whole, "vec_id long, v array<long>")
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()  # as many as a codebook has entries
    if not seeds:
        return None
    width = -(-(kept.agg(F.max(F.size("v"))).first()[0]) // parts)
    flat, sizes = [x for r in seeds for x in r["v"]], np.array([len(r["v"]) for r in seeds])
    books = np.ascontiguousarray(padded(np.array(flat, np.int64), sizes, parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(books)
        sums = given.mapInArrow(_sums(sent, scale), "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # a row a component of an entry
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        sent.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """vec_id, label, code, error of each whole vector. code: the entry of each part, two hexadecimal digits each."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kind = _input(vectors).schema["label"].dataType.simpleString()
    return _input(vectors).mapInArrow(_codes(sent, scale), f"vec_id long, label {kind}, code string, error long")


def decode(code: str, books: np.ndarray, scale: int = 256) -> list[float]:
    """The vector that a code stands for."""
    return (books[np.arange(len(books)), np.frombuffer(bytes.fromhex(code), np.uint8)].ravel() / scale).tolist()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of vectors by codebooks of their own. Columns: vec_id, embedding, label (may be missing: all labels are null).

    A component x is floor(scale * x). A codebook starts as the parts of the smallest vec_ids (null ids come last, rows that
    share an id by their components; with fewer vectors than entries it has fewer). In each round every part goes to its
    nearest entry by squared distance, ties to the lower one, and each entry becomes the floored mean of its parts; entries
    without parts stay. Returns vec_id, label, code, error (squared distance to what the code stands for), label_error
    (errors summed over equal labels, nulls together) and codebooks_sha256.

    Null vectors and those that hold null or non-finite components are dropped. Very long vectors and ones of unequal length
    count as longer ones, with zeros at the end: up to the longest's length, or the next that can be cut. Repeated rows are
    each coded and count each time; other columns are ignored; no rows give none. A component so large that a squared
    distance could leave 64 bits (for 64 components, above 700,000) ends the job.
    """
    books = fit(vectors, parts, entries, rounds, scale)
    if books is None:
        kind = _input(vectors).schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(vectors, books, scale))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("label", "of")
    sums, alike = stored(sums), F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(sums.where(F.col("rows") >= HOT * coded.count()))  # at most 1 / HOT labels
    rest = coded.join(hot, alike, "left_anti").join(sums, alike)
    return coded.join(hot, alike).unionByName(rest).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

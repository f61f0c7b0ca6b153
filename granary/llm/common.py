"""Helpers shared by the corpus operators: hashing, shared storage, Arrow rows."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= K2
    x ^= x >> np.uint64(27)
    x *= K3
    x ^= x >> np.uint64(31)
    return x


def stir(x: np.ndarray) -> np.ndarray:
    """A cheaper mix, for the inner levels of gram hashes; changes x."""
    x *= K2
    x ^= x >> np.uint64(32)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which has no other machines, gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_WRITTEN: list[str] = []


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001, S110  the session has gone; the cluster clears its checkpoint folder
        pass


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: its lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    atexit.register(_drop, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_output(make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of make(); what else was stored on the way is deleted, as nothing reads it any more."""
    before = len(_WRITTEN)
    df = stored(make())
    for path in _WRITTEN[before:-1]:
        _drop(df.sparkSession, path)
    del _WRITTEN[before:-1]
    return df


class Shipped:
    """A broadcast value of any of this package's types, for tasks that can't import the package."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        if "read" not in self.__dict__:
            self.read = pickle.loads(self.sent.value)  # noqa: S301
        return self.read


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast, under internal names; other columns of df can't clash with an operator's own."""
    return df.select(*(quoted(name).cast(kind).alias(name) for name, kind in columns.items()))


def quoted(name: str) -> Column:
    """The column of that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if offsets is not None and n else np.zeros(n + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slabs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about the limit at most (one row alone may exceed it)."""
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE = mix(np.arange(1, 258, dtype=np.uint64) * K1)
_BASE = 0xD6E8FEB86659FD93
BLOCK = 1 << 21
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, mod 2**64, for texts of up to n bytes."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def spans_of(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where kept is true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, alike wherever the span stands. Spans are in order and apart."""
    if len(data) <= BLOCK:
        return _span_hashes(data, starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # a very long text in blocks, for memory
        j = int(np.searchsorted(starts, starts[i] + BLOCK))
        low = starts[i]
        out[i:j] = _span_hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * down[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * K1)


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows that at delimits in data, as starts, ends and row numbers. inside: which byte values words are made of."""
    kept = inside[data]
    kept = kept.copy() if not kept.flags.writeable else kept
    starts, ends = spans_of(kept)
    if len(at) > 2 and len(starts):  # a word may run across a row's end
        cuts = at[1:-1]
        owner = np.searchsorted(starts, cuts, "right") - 1
        bad = np.unique(cuts[(owner >= 0) & (cuts > starts[owner]) & (cuts < ends[owner])])
        if len(bad):
            starts, ends = np.sort(np.concatenate((starts, bad))), np.sort(np.concatenate((ends, bad)))
    return starts, ends, np.searchsorted(at, starts, "right") - 1

"""Tables on disk that change in place: buckets of rows, of which a batch rewrites those that it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import tables


@dataclass(frozen=True)
class BucketTable:
    """A Parquet table in folders by the hash of some columns.

    A change first writes the whole new content of the buckets that it touches beside the table, then puts it in their place.
    A change that was cut off in between is finished before the next one, so a lost driver loses nothing, and a batch whose
    number is known already changes nothing. One writer at a time.
    """

    spark: SparkSession = field(repr=False)
    path: str
    keys: tuple[str, ...]
    by: tuple[str, ...]
    buckets: int = 64

    def __post_init__(self) -> None:
        if not self.keys or not self.by or self.buckets < 1:
            raise ValueError("a table needs keys, columns to deal it by, and a bucket")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def _fs(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _drop(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _mark(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.create(where, True).close()

    def create(self, rows: DataFrame) -> BucketTable:
        """The table with these rows; there must be none yet."""
        if self._exists(self.path):
            raise ValueError(f"{self.path} exists")
        self._bucketed(rows).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data")
        self.spark.createDataFrame([], rows.schema).write.parquet(f"{self.path}/schema")
        return self

    def _all(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema.add("_bucket", "integer")).parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        return self._all().drop("_bucket")

    def applied(self, batch_id: int) -> bool:
        return self._exists(f"{self.path}/applied/{batch_id}")

    def recover(self) -> None:
        """Finishes a change that was written, but not put in place."""
        fs, where = self._fs(f"{self.path}/pending")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            name = status.getPath().getName()
            if self._exists(f"{self.path}/pending/{name}/ready"):
                self._place(name)
            else:
                self._drop(f"{self.path}/pending/{name}")

    def _place(self, name: str) -> None:
        pending = f"{self.path}/pending/{name}"
        touched = {r[0] for r in self.spark.read.parquet(f"{pending}/touched").collect()}  # at most one a bucket
        rows = self.spark.read.schema(self._all().schema).parquet(f"{pending}/rows")
        full = {r[0] for r in rows.select("_bucket").distinct().collect()}
        if full:
            rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/data")
        for bucket in touched - full:
            self._drop(f"{self.path}/data/_bucket={bucket}")
        if name != "once":
            self._mark(f"{self.path}/applied/{name}")
        self._drop(pending)

    def _change(self, touched: DataFrame, new: Callable[[DataFrame], DataFrame], batch_id: int | None) -> None:
        """Replaces the buckets of touched by new(what they hold)."""
        name = "once" if batch_id is None else str(batch_id)
        pending = f"{self.path}/pending/{name}"
        found = [r[0] for r in self._bucketed(touched.select(*self.by)).select("_bucket").distinct().collect()]
        if found:
            self.spark.createDataFrame([(b,) for b in found], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{pending}/touched")
            held = self._all().where(F.col("_bucket").isin(found)).drop("_bucket")  # no other folder is read
            self._bucketed(new(held).select(held.columns)).write.mode("overwrite").parquet(f"{pending}/rows")
            self._mark(f"{pending}/ready")
            self._place(name)
        elif batch_id is not None:
            self._mark(f"{self.path}/applied/{name}")

    def _latest(self, batch: DataFrame, latest: str | None) -> DataFrame:
        """One row a key: the one with the greatest latest, then the greatest of all columns' values as JSON."""
        if latest is None:
            return batch
        whole = F.struct(*batch.columns)
        return batch.groupBy(*self.keys).agg(F.max_by(whole, F.struct(F.col(latest), F.to_json(whole))).alias("row")).select("row.*")

    def upsert(self, batch: DataFrame, batch_id: int | None = None, kept: Sequence[str] = ("created_at",), latest: str | None = None) -> None:
        """Puts rows in by key; of a row that is replaced, the kept columns stay. latest: of rows that share a key in the batch, the one with the greatest value counts."""
        if not set(self.by) <= set(self.keys):
            raise ValueError("a key may change buckets: deal the table by columns of the key")
        self.recover()
        if batch_id is None or not self.applied(batch_id):
            rows = self._latest(batch, latest)
            self._change(rows, lambda held: tables.upsert(held, rows, self.keys, kept), batch_id)

    def replace(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Puts documents (rows alike in the columns that the table is dealt by) in the place of those of the batch, with all their rows."""
        self.recover()
        if batch_id is None or not self.applied(batch_id):
            gone = batch.select(*self.by).distinct()
            self._change(gone, lambda held: held.join(gone, list(self.by), "left_anti").select(held.columns).unionByName(batch.select(held.columns)), batch_id)

    def delete(self, ids: DataFrame, batch_id: int | None = None) -> None:
        """Takes out all rows that are alike in the columns of ids, which are some that the table is dealt by, or more."""
        if not set(self.by) <= set(ids.columns):
            raise ValueError(f"ids must have {self.by}")
        self.recover()
        if batch_id is None or not self.applied(batch_id):
            self._change(ids, lambda held: held.join(ids.distinct(), ids.columns, "left_anti"), batch_id)

    def sink(self, how: str = "upsert", **kw: object) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upsert, replace or delete by each batch, once."""
        change = getattr(self, how)

        def f(batch: DataFrame, batch_id: int) -> None:
            batch.persist()  # it is asked for its buckets, then for its rows
            try:
                change(batch, batch_id, **kw)
            finally:
                batch.unpersist()

        return f

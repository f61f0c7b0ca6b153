"""Chunk and vector tables as DataFrames: upsert, replace, delete, listings, checks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Only a local session that has none gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written once and read back: to the folder, or to a new shared one."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fingerprint(table: DataFrame) -> str:
    """What a table's files are now: their paths, sizes and times."""
    jvm, conf, out = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration(), []
    for name in sorted(table.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(out).encode()).hexdigest()


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt over all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], kept: Sequence[str] = ("created_at",)) -> DataFrame:
    """table with the rows of batch put in by key; of a row that is replaced, the kept columns stay."""
    stays = [c for c in kept if c in table.columns]
    fresh = batch
    if stays:
        old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in stays])
        fresh = batch.join(old, list(keys), "left")
        for c in stays:
            fresh = fresh.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return table.join(batch.select(*keys), list(keys), "left_anti").unionByName(fresh.select(table.columns))


def replace_documents(table: DataFrame, batch: DataFrame, document: str = "document_id") -> DataFrame:
    """table without any row of the batch's documents, and the batch."""
    return table.join(batch.select(document).distinct(), document, "left_anti").unionByName(batch)


def delete(table: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def delete_chunks(chunks: DataFrame, vectors: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and vectors without these chunk ids, and what went. Blank ids don't count; none left is an error."""
    real = [i for i in ids if i and i.strip()]
    if not real:
        raise ValueError("no chunk ids")
    gone = chunks.sparkSession.createDataFrame([(i,) for i in real], "chunk_id string").distinct()
    return delete(chunks, gone, ["chunk_id"]), delete(vectors, gone, ["chunk_id"]), chunks.join(gone, "chunk_id", "left_semi")


def repeated_keys(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a batch holds more than once; it must be empty before an upsert."""
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unbound(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks and embeddings that don't belong together, with the reason. Both: chunk_id, text."""
    e = embeddings.select(F.col("chunk_id").alias("text_id"), F.col("text").alias("embedded_text"))
    both = chunks.select("chunk_id", "text").join(e, F.col("chunk_id") == F.col("text_id"), "full")
    reason = F.when(F.col("text_id").isNull(), "no_embedding").when(F.col("chunk_id").isNull(), "no_chunk").when(F.col("text") != F.col("embedded_text"), "other_text")
    return both.select(F.coalesce("chunk_id", "text_id").alias("chunk_id"), reason.alias("reason")).where("reason is not null")


def one_space(vectors: DataFrame) -> DataFrame:
    """The embedding spaces in a batch; more than one row is an error."""
    return vectors.select("provider", "model", "dimensions").distinct()


def document_ids(table: DataFrame, document: str = "document_id") -> DataFrame:
    return table.select(document).distinct().orderBy(document)


def latest(table: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key: an append-only table read as upserts."""
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def page(table: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    return table.orderBy(*order).offset(offset).limit(limit)

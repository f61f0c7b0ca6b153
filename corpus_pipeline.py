"""The corpus pipeline: documents that the quality classifier rejects go, one of each group of near-duplicates stays,
contaminated documents go, secrets are cut out, and what is left is packed into training sequences.

Every stage takes what the one before has written. Rows without an id pass through: they are judged by their own text,
but never as duplicates. Rows that share an id but not a text are documents of their own; of equal ones one row stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, minhash, packing, quality, secrets
from granary.llm.common import quoted, stage_output, stored

TOKENIZER = "word_bpe_49k.json"


def _of(docs: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """docs that are (left_semi) or aren't (left_anti) among some, by doc_id and tag (the text's hash)."""
    return docs.join(some, docs["doc_id"].eqNullSafe(some["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == some["tag"]), how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return _of(docs, quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "tag"), "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id (then text hash) of each group, by five-word shingles at a similarity of 0.8.

    Each text of an id is a document of its own. Of rows equal in both, the least by its other columns as JSON stays; a row
    without an id stays.
    """
    found = stored(minhash.groups(docs, words=5))
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "tag", "again")).alias("least")).select(F.col("least.doc_id").alias("id"), "least.tag", "least.again")
    others = F.struct(F.lit(0), *(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))
    of_id = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("tag"))
    rows = docs.where("doc_id is not null").select(of_id.alias("key"), F.struct(*map(quoted, docs.columns)).alias("row"), others.alias("others")).select("key.*", "row", "others").join(kept, ["id", "tag"])
    one = rows.where("again").groupBy("id", "tag").agg(F.min_by("row", F.to_json("others")).alias("row"))
    return rows.where("not again").select("row.*").unionByName(one.select("row.*")).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark windows."""
    judged = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _of(docs, judged.where("contaminated").select("doc_id", "tag"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets cut out."""
    clean = docs.withColumn("text", secrets.redacted("text"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: A fitted classifier and a tokenizer have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage_output(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

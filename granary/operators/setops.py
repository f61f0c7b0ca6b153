"""Sets and duplicates: union, intersection, difference, containment, distinct content, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import without_space


def set_operations(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    return {"union": a.union(b).distinct(), "intersection": a.intersect(b), "difference": a.subtract(b), "symmetric": a.subtract(b).union(b.subtract(a))}


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def distinct_content(docs: DataFrame) -> DataFrame:
    """The least doc_id of each content without white space and case, and its copies. The key is hashed before the shuffle."""
    return docs.groupBy(F.sha2(without_space("text"), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("k")


def first_by_rank(sources: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    from pyspark.sql import Window

    return sources.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def counter(rows: DataFrame, items: Column) -> DataFrame:
    """How often each element of the arrays occurs, most frequent first."""
    return rows.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item")

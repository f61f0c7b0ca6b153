"""Shapes of the engine's tables, domains of their enumerations, and checks that raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed domains.
FILE_FORMATS = ("txt", "markdown", "docx", "pdf")
SOURCE_ROLES = ("reference_knowledge", "historical_material")
ELIGIBILITIES = ("current_evidence", "historical_context", "ineligible")
ELEMENT_KINDS = ("title", "paragraph", "list_item", "table", "code", "page")
CHUNK_KINDS = ("standalone", "parent", "child")
ROUTE_STATUSES = ("ran", "empty", "failed")

LOCATOR = "struct<kind:string,line_start:int,line_end:int,page_number:int,paragraph_index:int,table_index:int,heading_path:array<string>>"
ELEMENTS = "document_id string, document_version string, element_id string, kind string, text string, locator string, ordinal int, cleaning_actions array<string>"
CHUNKS = (
    "chunk_id string, kind string, document_id string, document_version string, original_filename string, file_format string, source_role string, evidence_eligibility string, text string, ordinal int, token_count int, "
    "source_spans array<struct<element_id:string,start_char:int,end_char:int,text:string>>, policy_name string, policy_version string, policy_fingerprint string, parent_chunk_id string, business_metadata map<string,string>, lexemes array<string>, lexical_config_ref string, created_at timestamp, updated_at timestamp"
)
VECTORS = "chunk_id string, embedding_space_ref string, provider string, config_ref string, model string, embedding_dimensions int, preprocessing_version string, embedding array<float>"
HITS = "query_id string, route string, chunk_id string, route_rank int, native_score_name string, native_score double, higher_is_better boolean"
MESSAGES = "conv_id long, turn long, role string, text string"


def in_domain(c: str, domain: Sequence[str]) -> Column:
    """The column; a value outside the domain raises when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"{c} can't be "), F.coalesce(F.col(c), F.lit("null")))).cast("string")
    return F.when(F.col(c).isin(*domain), F.col(c)).otherwise(wrong)


def checked_chunks(chunks: DataFrame) -> DataFrame:
    """chunks whose kinds are known, whose counts are positive, and whose children have parents."""
    child = (F.col("kind") == "child") == F.col("parent_chunk_id").isNotNull()
    rules = {"token_count": F.col("token_count") > 0, "ordinal": F.col("ordinal") > 0, "parent_chunk_id": child}
    out = chunks.withColumn("kind", in_domain("kind", CHUNK_KINDS))
    for name, holds in rules.items():
        out = out.withColumn(name, F.when(holds, F.col(name)).otherwise(F.raise_error(F.lit(f"bad {name}")).cast(dict(chunks.dtypes)[name])))
    return out


def checked_vectors(vectors: DataFrame) -> DataFrame:
    """vectors of the length that they claim, finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    ok = (F.size(v) == F.col("embedding_dimensions")) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("bad vector of "), "chunk_id")).cast(dict(vectors.dtypes)["embedding"])))


def document_text(elements: DataFrame) -> DataFrame:
    """document_id, document_version, text: elements in order, joined by an empty line."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))  # one document's elements
    return elements.groupBy("document_id", "document_version").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))

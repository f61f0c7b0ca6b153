"""Queries over files that are made from the documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.retrieval import read
from granary.sources import files, folders
from granary.sources.buckets import BucketTable
from granary.sources.tables import shared_folder, spread

LINES = 40


def pdf_file(body: str) -> bytes:
    """A PDF of a text's lines, so many a page; blank lines go. Codes are given to its characters as they come."""
    lines = [x for x in body.split("\n") if x.strip()] or [""]
    code = {c: i for i, c in enumerate(dict.fromkeys("".join(lines)))}
    chars = "\n".join(f"<{i:04x}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items())
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    shows = {c: f"{i:04x}" for c, i in code.items()}
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects: list[tuple[str, bytes | None]] = [("<< /Type /Catalog /Pages 2 0 R >>", None), (f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F 3 0 R >> >> >>", None), ("<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>", None), ("/Filter /FlateDecode", f"{len(code)} beginbfchar\n{chars}\nendbfchar".encode())]
    for i, page in enumerate(pages):
        shown = "\n".join(f"<{''.join(map(shows.__getitem__, line))}> Tj T*" for line in page)
        objects += [(f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>", None), ("/Filter /FlateDecode", f"BT /F 10 Tf 12 TL 72 720 Td\n{shown}\nET".encode())]
    out = [b"%PDF-1.5\n"]
    for number, (said, stream) in enumerate(objects, 1):
        packed = None if stream is None else zlib.compress(stream)
        value = said.encode() if packed is None else f"<< {said} /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream"
        out.append(f"{number} 0 obj\n".encode() + value + b"\nendobj\n")
    return b"".join([*out, b"trailer << /Root 1 0 R >>\n%%EOF\n"])


def pdf_pages(spark, d):
    """Documents written as PDF, and the text of their pages."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch["text"].map(lambda x: pdf_file(x or ""))
            yield pd.DataFrame({"path": batch["doc_id"].map(lambda i: f"docs/{i}.pdf"), "length": made.map(len), "content": made})

    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    manifest = docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".pdf")).alias("path"), F.col("doc_id").cast("string").alias("document_id"), F.lit("1").alias("document_version"), F.lit("reference_knowledge").alias("source_role"), F.lit("current_evidence").alias("evidence_eligibility"))
    loaded = files.load(docs.mapInPandas(f, "path string, length long, content binary"), manifest)
    plain = F.trim(F.regexp_replace("text", rf"[{T.SPACE}]+", " "))
    return loaded.elements.select(F.col("document_id").cast("long").alias("doc_id"), F.col("ordinal").alias("page"), F.md5(plain).alias("md5"))


def document_files(spark, d):
    """Documents written as files by tasks, and read back by the folder source, planned by bytes."""
    folder = shared_folder(spark, "documents")

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        for batch in batches:
            for i, body in zip(batch["doc_id"], batch["text"], strict=True):
                with where.open_output_stream(f"{root}/{i}.txt") as out:
                    out.write((body or "").encode())
            yield batch[["doc_id"]]

    spread(read(spark, d, "documents").select("doc_id", "text")).mapInPandas(f, "doc_id long").write.format("noop").mode("overwrite").save()
    spark.dataSource.register(folders.DocumentFolder)
    found = files.inspected(spark.read.format("document_folder").option("partition_bytes", 1 << 20).load(folder))
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "length", "sha256", "file_format", "error_code")


def bucket_upsert(spark, d):
    """A table of half of the customers, changed in place by a stream of all, which comes twice."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    table = BucketTable(spark, shared_folder(spark), ("c_custkey",), ("c_custkey",), 16).create(c.where("c_custkey % 2 = 0"))
    for _ in range(2):
        changes = spark.readStream.schema(read(spark, d, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(d).where("c_custkey % 3 = 0")
        changes = changes.select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("created_at"), F.lit(2).alias("updated_at"))
        changes.writeStream.foreachBatch(table.sink()).option("checkpointLocation", shared_folder(spark, "streams")).trigger(availableNow=True).start().awaitTermination()
    return table.read().withColumn("c_acctbal", F.round("c_acctbal", 4))


QUERIES = {f.__name__: f for f in (pdf_pages, document_files, bucket_upsert)}

SQL = {
    "document_files": "select doc_id, strlen(text)::bigint as length, sha256(text) as sha256, 'txt' as file_format, null::varchar as error_code from documents",
    "bucket_upsert": """select c_custkey, c_name, round(case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end, 4) as c_acctbal, case when c_custkey % 2 = 0 then 1 else 2 end as created_at, case when c_custkey % 3 = 0 then 2 else 1 end as updated_at
      from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""",
    "pdf_pages": rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
      k as (select doc_id, line, row_number() over (partition by doc_id order by i) - 1 as n from l where regexp_replace(line, '\s+', '', 'g') <> ''),
      p as (select doc_id, n // {LINES} + 1 as page, string_agg(line, ' ' order by n) as t from k group by all)
      select doc_id, page, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) as md5 from p""",
}

"""Files to elements: size and format checks, text, Markdown, DOCX and PDF parsers, cleaning, ids. Failures and warnings are rows, not exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import identity, text
from granary.sources import pdf

MAX_BYTES = 20 * 1024 * 1024
#: Fixed: formats by suffix, and how their files begin.
FORMATS = {".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".docx": "docx", ".pdf": "pdf"}
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ELEMENTS = "kind string, text string, locator_kind string, line_start int, line_end int, page_number int, paragraph_index int, table_index int, heading_path array<string>"


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)


def inspected(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files with filename, suffix, file_format, sha256, error_code and error_stage. Sizes are checked before contents."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    formats = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    f = files.withColumn("filename", name).withColumn("suffix", suffix).withColumn("file_format", F.try_element_at(formats, F.col("suffix")))
    content = F.when(F.col("length") <= max_bytes, F.col("content"))
    begins = lambda n: F.hex(F.substring(content, 1, n))
    code = (
        F.when(F.col("length") > max_bytes, "FILE_TOO_LARGE")
        .when(F.col("file_format").isNull(), "UNSUPPORTED_FORMAT")
        .when((F.col("file_format") == "pdf") & (begins(5) != "255044462D"), "FORMAT_MISMATCH")
        .when((F.col("file_format") == "docx") & (begins(2) != "504B"), "FORMAT_MISMATCH")
        .when(F.col("file_format").isin("txt", "markdown") & ~F.expr("is_valid_utf8(cast(content as string))"), "TEXT_DECODE_FAILED")
    )
    stage = F.when(F.col("error_code") == "FILE_TOO_LARGE", "read").when(F.col("error_code") == "TEXT_DECODE_FAILED", "parse").when(F.col("error_code").isNotNull(), "detect")
    return f.withColumn("sha256", F.sha2(content, 256)).withColumn("error_code", code).withColumn("error_stage", stage)


def directory_candidates(files: DataFrame, suffixes: tuple[str, ...] = (".txt", ".md", ".pdf")) -> DataFrame:
    """path, accepted, reason of every file, by lower-cased name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    reason = F.when(F.lower(name) == "readme.md", "readme").when(~suffix.isin(*suffixes), "unsupported suffix").otherwise("accepted")
    return files.select("path", (reason == "accepted").alias("accepted"), reason.alias("reason"), F.lower(name).alias("n")).orderBy("n", "path").drop("n")


def text_blocks(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """Blocks of lines between blank ones, with their line numbers: id columns, block, line_start, line_end, text."""
    lines = docs.select(*id_columns, F.posexplode(F.split(column, LINE_BREAKS)).alias("i", "line")).withColumn("blank", text.strip("line") == "")
    order = Window.partitionBy(*id_columns).orderBy("i")  # the lines of one document
    islands = lines.withColumn("island", F.sum(F.col("blank").cast("int")).over(order)).where(~F.col("blank"))
    blocks = islands.groupBy(*id_columns, "island").agg((F.min("i") + 1).alias("line_start"), (F.max("i") + 1).alias("line_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return blocks.select(*id_columns, F.row_number().over(Window.partitionBy(*id_columns).orderBy("line_start")).alias("block"), "line_start", "line_end", "text")


def _row(kind: str, body: str, locator: str, start: int | None = None, end: int | None = None, paragraph: int | None = None, table: int | None = None, path: list | None = None) -> tuple:
    return kind, body, locator, start, end, None, paragraph, table, list(path or [])


def txt_elements(body: str) -> Iterator[tuple]:
    block, first = [], 0
    for n, line in enumerate([*body.splitlines(), ""], 1):
        if line.strip():
            first = first if block else n
            block.append(line)
        elif block:
            yield _row("paragraph", "\n".join(block), "text_lines", first, n - 1)
            block = []


ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"^( *)(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")


def markdown_elements(body: str) -> Iterator[tuple]:
    """Headings, paragraphs, list items and code of a Markdown text, with the path of headings above them."""
    lines, path, i = body.splitlines(), [], 0
    held: list[str] = []
    first, in_item, indent = 0, False, 0

    def heading(level: int, title: str, a: int, b: int) -> tuple:
        path[level - 1 :] = [title.strip()]
        return _row("title", title.strip(), "markdown_block", a, b, path=path)

    def paragraph(end: int) -> list[tuple]:
        out = [_row("list_item" if in_item else "paragraph", "\n".join(held).rstrip(), "markdown_block", first, end, path=path)] if held else []
        held.clear()
        return out

    while i < len(lines):
        line = lines[i]
        n = i + 1
        stripped = re.sub(r"^(?: {0,3}> ?)+", "", line)
        atx, fence, item = ATX.match(stripped), FENCE.match(stripped), ITEM.match(stripped)
        if not stripped.strip():
            yield from paragraph(i)
            if i + 1 < len(lines) and in_item and lines[i + 1].strip() and not lines[i + 1].startswith(" " * indent) and not ITEM.match(lines[i + 1]):
                in_item = False
        elif fence:
            yield from paragraph(i)
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[j]):
                j += 1
            yield _row("code", "".join(x + "\n" for x in lines[i + 1 : j]), "markdown_block", n, min(j + 1, len(lines)), path=path)
            i = j
        elif atx and not (in_item and line.startswith(" " * 4)):
            yield from paragraph(i)
            yield heading(len(atx[1]), atx[2] or "", n, n)
            in_item = False
        elif held and not in_item and re.match(r"^ {0,3}(=+|-+)[ \t]*$", stripped):
            title = "\n".join(held)
            held.clear()
            yield heading(1 if "=" in stripped else 2, title, first, n)
        elif item and not re.match(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", stripped):
            yield from paragraph(i)
            in_item, indent, first = True, item.end(), n
            rest = stripped[item.end() :]
            if rest.strip():
                held.append(rest.strip())
        elif not held and not in_item and re.match(r"^(?: {4}|\t)", line):
            j = i
            while j < len(lines) and (re.match(r"^(?: {4}|\t)", lines[j]) or not lines[j].strip()):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            yield _row("code", "".join(re.sub(r"^(?: {4}|\t)", "", x) + "\n" for x in lines[i:j]), "markdown_block", n, j, path=path)
            i = j - 1
        elif re.match(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", stripped):
            yield from paragraph(i)
        else:
            if not held:
                first = n
            held.append(stripped.strip())
        i += 1
    yield from paragraph(len(lines))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(content: bytes) -> Iterator[tuple]:
    """Paragraphs and tables of a document in body order. Blank paragraphs count but give nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else ""
    said = lambda node: "".join("\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else x.text or "" for x in node.iter() if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr"))
    path: list[str] = []
    paragraphs = tables = 0
    for block in root.find(f"{W}body"):
        if block.tag == f"{W}p":
            paragraphs += 1
            body = said(block)
            if not body.strip():
                continue
            style = block.find(f"{W}pPr/{W}pStyle")
            m = re.fullmatch(r"heading (\d+)", styles.get(style.get(f"{W}val"), "").lower()) if style is not None else None
            if m:
                path[max(1, min(9, int(m[1]))) - 1 :] = [body.strip()]
            yield _row("title" if m else "paragraph", body, "docx_paragraph", paragraph=paragraphs, path=path)
        elif block.tag == f"{W}tbl":
            tables += 1
            rows = [" | ".join("\n".join(said(p) for p in cell.iter(f"{W}p")) for cell in row.findall(f"{W}tc")) for row in block.findall(f"{W}tr")]
            yield _row("table", "\n".join(rows), "docx_table", table=tables, path=path)


def pdf_elements(content: bytes) -> Iterator[tuple]:
    """Pages with text; a warning for each one without, and one on the order of reading."""
    found = 0
    for number, body in enumerate(pdf.pages(content), 1):
        if body.strip():
            found += 1
            yield "page", body, "pdf_page", None, None, number, None, None, [], None
        else:
            yield None, None, "pdf_page", None, None, number, None, None, [], "pdf_page_without_text"
    if not found:
        raise TextMissing
    yield *[None] * 8, [], "pdf_reading_order_not_guaranteed"


class TextMissing(ValueError):
    """A PDF without a text layer."""


#: Failures of parsers that have a code and a stage of their own.
FAILURES = {pdf.Encrypted: ("ENCRYPTED_PDF", "parse"), TextMissing: ("PDF_TEXT_LAYER_MISSING", "empty_content")}


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for document, version, kind, content in batch.itertuples(index=False):
            try:
                if kind == "pdf":
                    found = list(pdf_elements(bytes(content)))
                elif kind == "docx":
                    found = [(*e, None) for e in docx_elements(bytes(content))]
                else:
                    body = bytes(content).decode("utf-8-sig")
                    found = [(*e, None) for e in (txt_elements if kind == "txt" else markdown_elements)(body)]
                out += [(document, version, i, *e, None, None) for i, e in enumerate(found, 1)]
            except Exception as e:  # noqa: BLE001  any foreign failure is this file's, and a row
                out.append((document, version, 0, *[None] * 10, *FAILURES.get(type(e), ("DOCUMENT_PARSE_FAILED", "parse"))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])


PARSED = f"document_id string, document_version string, position int, {ELEMENTS}, warning_code string, error_code string, error_stage string"


def describe_locator() -> Column:
    """kind, lines, page, paragraph, table and headings that there are."""
    lines = F.when(F.col("line_end") > F.col("line_start"), F.concat(F.lit("lines="), F.col("line_start"), F.lit("-"), F.col("line_end"))).when(F.col("line_start").isNotNull(), F.concat(F.lit("lines="), F.col("line_start")))
    of = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c)))
    headings = F.when(F.size("heading_path") > 0, F.concat(F.lit("heading="), F.array_join("heading_path", " > ")))
    return F.concat_ws(", ", F.col("locator_kind"), lines, of("page", "page_number"), of("paragraph", "paragraph_index"), of("table", "table_index"), headings)


class Loaded(NamedTuple):
    """Clean elements with ids; a row for every file that failed; a row for every warning, with the page that it is about."""

    elements: DataFrame
    failures: DataFrame
    warnings: DataFrame


def load(files: DataFrame, manifest: DataFrame, max_bytes: int = MAX_BYTES) -> Loaded:
    """Elements, failures and warnings of files. manifest: path, document_id, document_version, source_role, evidence_eligibility.

    A historical source that claims to be current evidence is refused. Elements that cleaning empties are left out, and
    ordinals count the others.
    """
    known = inspected(files, max_bytes).join(manifest, "path")
    refused = F.when((F.col("source_role") == "historical_material") & (F.col("evidence_eligibility") == "current_evidence"), "HISTORICAL_AS_CURRENT")
    known = known.withColumn("error_code", F.coalesce(refused, "error_code")).withColumn("error_stage", F.when(refused.isNotNull(), "validate").otherwise(F.col("error_stage")))
    parsed = known.where("error_code is null").select("document_id", "document_version", "file_format", "content").mapInPandas(_parsed, PARSED)
    cleaned = text.clean_text(parsed.where("error_code is null and warning_code is null"), "text", "clean", "cleaning_actions").where("clean != ''")
    order = Window.partitionBy("document_id", "document_version").orderBy("position")
    numbered = cleaned.withColumn("ordinal", F.row_number().over(order)).withColumn("locator", describe_locator())
    ids = identity.element_id(F.col("document_id"), F.col("document_version"), F.col("ordinal"), F.col("locator"), F.col("clean"))
    elements = numbered.select("document_id", "document_version", ids.alias("element_id"), "kind", F.col("clean").alias("text"), "locator", "ordinal", "cleaning_actions")
    failures = known.where("error_code is not null").select("document_id", "error_code", "error_stage").unionByName(parsed.where("error_code is not null").select("document_id", "error_code", "error_stage"))
    return Loaded(elements, failures, parsed.where("warning_code is not null").select("document_id", "document_version", "warning_code", "page_number"))


def load_elements(files: DataFrame, manifest: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """load without the warnings."""
    return load(files, manifest, max_bytes)[:2]

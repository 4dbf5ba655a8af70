"""Files as tables: listing, admission, parsing by extension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text

MARKUP, MAIL, STORED_MAIL, PDF, SHEETS = ("html", "xml"), ("eml",), ("emlx",), ("pdf",), ("xlsx", "xls", "ods")


def scan(spark: SparkSession, folder: str, glob: str | None = None, depth: int = 10) -> DataFrame:
    """path, modified (s), size, content of the admitted files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/+", "/")
    root = folder.split(":", 1)[-1].rstrip("/")
    below = F.size(F.split(F.substring(plain, len(root) + 2, 1 << 20), "/"))
    relative = F.substring(plain, len(root) + 1, 1 << 20)
    admitted = labels.should_index(relative, F.col("length"))
    walked = ~F.exists(F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1), lambda p: p.isin(*labels.WALK_SKIP_DIRS))
    return files.select(plain.alias("path"), F.unix_seconds("modificationTime").alias("modified"), F.col("length").alias("size"), "content").where(admitted & walked & (below <= depth))


def _binary_text(kind: str):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else (pdf_text if kind == "pdf" else sheet_text)(b) for b in column.to_pylist()], pa.string())

    return extract


def pdf_text(data: bytes) -> str | None:
    """Text of a PDF, if a library for it is installed."""
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def sheet_text(data: bytes) -> str | None:
    """`## sheet` and its rows joined by bars, empty rows skipped, if a library for it is installed."""
    try:
        import io

        from openpyxl import load_workbook
    except ImportError:
        return None
    out = []
    for sheet in load_workbook(io.BytesIO(data), read_only=True, data_only=True):
        out.append(f"## {sheet.title}")
        rows = (["" if v is None else str(v) for v in row] for row in sheet.iter_rows(values_only=True))
        out += [" | ".join(r) for r in rows if any(r)]
    return "\n".join(out)


def parsed(files: DataFrame, compat_markup: bool = True) -> DataFrame:
    """files with their text by extension: markup stripped, mail to headers and body, sheets and PDFs by optional
    libraries, all else cleaned text. Bytes that are no UTF-8 give null."""
    ext = labels.extension(F.col("path"))
    raw = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    markup = text.strip_markup_compat if compat_markup else text.strip_markup
    parsed_text = (
        F.when(ext.isin(*MARKUP), text.clean_text(markup(raw))).when(ext.isin(*MAIL), text.rfc822_text(raw)).when(ext.isin(*STORED_MAIL), text.emlx_text(raw))
        .when(ext.isin(*PDF), text.clean_text(_binary_text("pdf")(F.when(ext.isin(*PDF), F.col("content"))))).when(ext.isin(*SHEETS), _binary_text("sheet")(F.when(ext.isin(*SHEETS), F.col("content"))))
        .otherwise(text.clean_text(raw))
    )
    return files.withColumn("ext", ext).withColumn("text", parsed_text)


def unchanged_removed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index doesn't have at their time of modification."""
    return files.join(index.select("path", "modified"), ["path", "modified"], "left_anti")


def gone_from(index: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows whose file is no longer there."""
    return index.join(files.select("path"), "path", "left_anti")


def enriched(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits (path) with size, time, number of lines and the first five lines of their file."""
    lines = F.split("text", "\n")
    facts = files.select("path", "size", F.timestamp_seconds("modified").alias("modified_at"), F.size(lines).cast("bigint").alias("lines"), F.array_join(F.slice(lines, 1, 5), "\n").alias("head"))
    return hits.join(facts, "path", "left")

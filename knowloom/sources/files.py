"""Local files: scan, registration, text extraction, and export of attachments."""

from __future__ import annotations

import functools
import logging
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.functions import ids
from knowloom.functions.text import basename

# Media types by suffix.
MIME_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "zip": "application/zip"}
DEFAULT_EXTENSIONS = (".pdf", ".txt", ".md")


def mime_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("application/octet-stream"))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, recursive: bool = False) -> DataFrame:
    """Files of a folder by suffix, in any case: path, modificationTime, length, content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return df.filter(suffix.isin([e.lower() for e in extensions]))


def registrations(files: DataFrame, registry: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """(new registry rows, local_files rows): the first path of each content that is not registered yet."""
    named = files.withColumn("content_id", ids.file_content_id(F.col("content")))
    fresh = named.join(registry.select("content_id"), "content_id", "left_anti")
    one = fresh.withColumn("_n", F.row_number().over(W.partitionBy("content_id").orderBy("path"))).filter("_n = 1")
    meta = F.to_json(F.struct(basename(F.col("path")).alias("filename"), F.col("path")))
    rows = one.select(
        "content_id",
        F.lit(None).cast("string").alias("message_id"),
        F.lit(None).cast("string").alias("attachment_id"),
        F.lit("local_file").alias("content_type"),
        mime_of(F.col("path")).alias("mime_type"),
        F.sha2("content", 256).alias("sha256"),
        created_at.alias("created_at"),
        meta.alias("metadata"),
    )
    local = one.select("content_id", "path", F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("modified_at"), meta.alias("metadata"))
    return rows, local


def registered(hashes: DataFrame, registry: DataFrame) -> DataFrame:
    """The hashes (column sha256) that the registry already holds."""
    return hashes.join(registry.select("sha256"), "sha256", "left_semi")


#: Page texts of a document's bytes; set by ``register_pdf_reader``.
_PDF_READER: list[Callable[[bytes], list[str]]] = []


def register_pdf_reader(reader: Callable[[bytes], list[str]]) -> None:
    """Use ``reader`` for PDF pages; blank pages are empty strings."""
    _PDF_READER[:] = [reader]


@functools.lru_cache(maxsize=1)
def _warn_of_no_reader() -> None:
    logging.getLogger(__name__).warning("no PDF reader is registered and pypdf is not installed: PDF contents give no pages")


def _default_reader(data: bytes) -> list[str]:
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        _warn_of_no_reader()
        return []
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def load(paths: DataFrame) -> DataFrame:
    """Files named in the column ``path`` with their bytes in ``data``, read by the executors from the shared file system; null where a file is gone."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            data = []
            for path in batch["path"]:
                try:
                    where, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":/" in path else (fs.LocalFileSystem(), path)
                    with where.open_input_stream(inside) as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield batch.assign(data=data)

    kept = paths.drop("data")
    return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField("data", T.BinaryType())]))


def _pages(reader: Callable[[bytes], list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, data in zip(pdf["content_id"], pdf["data"]):
                for n, text in enumerate(reader(bytes(data)) if data is not None else [], 1):
                    rows.append((key, n, text))
            yield pd.DataFrame(rows, columns=["content_id", "page", "text"])

    return run


def decoded(data: Column) -> Column:
    """Text of bytes: UTF-8 if well formed, Latin-1 otherwise."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def page_texts(contents: DataFrame) -> DataFrame:
    """(content_id, page, text) of contents (content_id, mime_type, filename, data).

    PDF by type or suffix goes to the PDF reader; text types and ``.txt``/``.md``
    give one page; all else gives none.
    """
    is_pdf = (F.col("mime_type") == "application/pdf") | F.lower("filename").endswith(".pdf")
    is_text = F.col("mime_type").startswith("text/") | F.lower("filename").rlike(r"\.(txt|md)$")
    schema = T.StructType([T.StructField("content_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
    reader = _PDF_READER[0] if _PDF_READER else _default_reader
    pdfs = contents.filter(F.coalesce(is_pdf, F.lit(False))).select("content_id", "data").mapInPandas(_pages(reader), schema)
    plain = contents.filter(F.coalesce(is_text & ~is_pdf, F.coalesce(is_text, F.lit(False)) & ~F.coalesce(is_pdf, F.lit(False))))
    return plain.select("content_id", F.lit(1).alias("page"), decoded(F.col("data")).alias("text")).unionByName(pdfs)


def export_names(attachments: DataFrame) -> DataFrame:
    """Attachments with ``export_name``: equal file names get ``_1``, ``_2`` before the suffix."""
    n = F.row_number().over(W.partitionBy("filename").orderBy("message_id", "id")) - 1
    stem, suffix = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    return attachments.withColumn("export_name", F.when(n == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix)))


def export(attachments: DataFrame, folder: str) -> None:
    """Write attachment bytes into a shared folder, one task per partition."""

    def write(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, os.path.basename(r["export_name"])), "wb") as f:
                f.write(bytes(r["data"] or b""))

    export_names(attachments).select("export_name", "data").foreachPartition(write)

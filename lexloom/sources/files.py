"""Files to page rows: (path, page_number, text)."""
from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom import vocab
from lexloom.functions import text as T

PageExtractor = Callable[[bytes], list[str]]
PLAIN = [".txt", ".md"]
PAGE_SCHEMA = "path string, page_number int, text string"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of every file below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; the last character when there is no dot, as a slice from -1 gives."""
    return F.regexp_extract(F.lower(path), r"(\.[^.]*)$", 1)


def _mime(df: DataFrame) -> Column:
    return F.col("mime_type") if "mime_type" in df.columns else F.lit(None).cast("string")


def split_supported(files: DataFrame, max_bytes: int = vocab.MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with column reason): known type by MIME or extension, not empty, not too large."""
    known = _mime(files).isin(*vocab.SUPPORTED_MIME_TYPES) | extension(F.col("path")).isin(*vocab.SUPPORTED_EXTENSIONS)
    reason = F.when(~F.coalesce(known, F.lit(False)), "unsupported file type").when(F.col("length") <= 0, "file is empty") \
        .when(F.col("length") > max_bytes, "file too large")
    marked = files.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def office_text(content: bytes) -> list[str]:
    """Text of a zipped-XML office file as one page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = sorted(n for n in z.namelist() if re.match(r"(word/document|ppt/slides/slide\d+|xl/sharedStrings|content)\.xml$", n))
        lines = []
        for part in parts:
            for node in ElementTree.fromstring(z.read(part)).iter():
                tag = node.tag.rsplit("}", 1)[-1]
                if tag in ("p", "si", "h"):
                    line = "".join(t.text or "" for t in node.iter() if t.tag.rsplit("}", 1)[-1] in ("t", "p", "span", "h"))
                    if line.strip():
                        lines.append(line)
    return ["\n".join(lines)]


def _extracted(files: DataFrame, extract: PageExtractor, keep_blank: bool) -> DataFrame:
    """Pages from a per-file library; a failing file gives one row with page_number null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = extract(bytes(content))
                except Exception as exc:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path, None, f"{type(exc).__name__}: {exc}"))
                    continue
                rows += [(path, i, t) for i, t in enumerate(pages, 1) if keep_blank or t.strip()]
            out = pd.DataFrame(rows, columns=["path", "page_number", "text"])
            yield out.astype({"page_number": "Int32"})
    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def extract_pages(files: DataFrame, pdf: PageExtractor | None = None, office: PageExtractor = office_text, keep_blank: bool = False) -> DataFrame:
    """Pages of every file by its kind. Plain text and HTML stay in the JVM; PDF and office
    files go through the given per-file extractors, batch by batch. Empty texts are dropped,
    blank PDF pages kept only with ``keep_blank`` (page numbers always count them). Without
    a PDF extractor every PDF gives one failed row (page_number null, text the reason).
    """
    mime, ext = _mime(files), extension(F.col("path"))
    kind = F.when((mime == "text/plain") | (mime == "text/markdown") | ext.isin(*PLAIN), "plain") \
        .when((mime == "text/html") | (ext == ".html"), "html").when((mime == "application/pdf") | (ext == ".pdf"), "pdf").otherwise("office")
    marked = files.withColumn("__kind", kind)
    body = F.decode("content", "UTF-8")
    text = F.when(F.col("__kind") == "plain", T.trim_ws(body)).otherwise(T.strip_html(body))
    out = marked.where(F.col("__kind").isin("plain", "html")).select("path", F.lit(1).alias("page_number"), text.alias("text")).where(F.col("text") != "")
    pdfs = marked.where(F.col("__kind") == "pdf")
    failed = pdfs.select("path", F.lit(None).cast("int").alias("page_number"), F.lit("no PDF extractor given").alias("text"))
    out = out.unionByName(failed if pdf is None else _extracted(pdfs, pdf, keep_blank))
    return out.unionByName(_extracted(marked.where(F.col("__kind") == "office"), office, True))


def new_files(listing: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files whose (user_id, file_name) is not loaded yet."""
    return listing.join(loaded.select("user_id", "file_name"), ["user_id", "file_name"], "left_anti")


def with_token_counts(pages: DataFrame, encoder: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """token_count per page: length / 4 rounded up, or an exact tokenizer built once per task."""
    if encoder is None:
        return pages.withColumn("token_count", T.estimate_tokens(F.col("text")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoder()
        for pdf in batches:
            yield pdf.assign(token_count=[count(t) if t else 0 for t in pdf["text"]])
    return pages.mapInPandas(run, f"{schema}, token_count bigint")

"""Reading document files: text natively in Spark, Word and PDF files in Arrow batches.

Every file gives one row, readable or not; what is wrong with it is in the column `error`, so one
bad file never fails a batch.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import cleaning
from ..settings import DEFAULT, Settings

PAGES = "array<struct<page_number:int,text:string,char_start:int,char_end:int>>"
DOCUMENT = f"source_path string, format string, full_text string, pages {PAGES}, metadata map<string,string>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, settings: Settings = DEFAULT, glob: str | None = None) -> DataFrame:
    """The files below `path` (one file works too): source_path, length, format, content, error.

    Too large files and unsupported kinds keep their row without content, which is not read for them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"\.([^./]+)\z", 1)
    format = F.lower(name)
    error = F.when(~format.isin(*settings.extensions), F.concat(F.lit("unsupported format: "), format)).when(
        F.col("length") > settings.max_upload_bytes, F.concat(F.lit("larger than "), F.lit(str(settings.max_upload_bytes)), F.lit(" bytes"))
    )
    return found.select(F.col("path").alias("source_path"), "length", format.alias("format"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def _one_page(text) -> F.Column:
    return F.array(F.struct(F.lit(1).alias("page_number"), text.alias("text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end")))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8, or Latin-1 where they are not; any line end becomes a newline."""
    raw = F.when(is_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(raw, r"\r\n?", "\n")


def text_documents(found: DataFrame) -> DataFrame:
    """Rows of plain text: UTF-8, or Latin-1 where it is not; any line end becomes a newline."""
    utf8, text = is_utf8(F.col("content")), decoded(F.col("content"))
    row = found.where("format = 'txt' AND error IS NULL").select(
        "source_path", "format", text.alias("full_text"), F.map_from_arrays(F.array(F.lit("encoding_used")), F.array(F.when(utf8, "utf-8").otherwise("latin-1"))).alias("metadata")
    )
    return row.select("source_path", "format", "full_text", _one_page(F.col("full_text")).alias("pages"), "metadata", F.when(strip(F.col("full_text")) == "", "no text").alias("error"))


def read_docx(data: bytes) -> tuple[list[str], dict[str, str]]:
    """One page of the non-blank paragraphs of a Word file, and its properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        paragraphs = []
        for p in body.findall(f"{_W}p") if body is not None else ():
            parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
            text = "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)
            if text.strip():
                paragraphs.append(text)
        properties = {"paragraph_count": str(len(paragraphs))}
        if "docProps/core.xml" in z.namelist():
            for e in ET.fromstring(z.read("docProps/core.xml")):
                if e.text:
                    properties[e.tag.split("}")[-1]] = e.text
    return ["\n".join(paragraphs)], properties


def no_pdf(data: bytes) -> tuple[list[str], dict[str, str]]:
    """The reader used when none is given: this package has no PDF library of its own."""
    raise ValueError("no PDF reader given")


Reader = Callable[[bytes], tuple[list[str], dict[str, str]]]


def binary_documents(found: DataFrame, readers: dict[str, Reader]) -> DataFrame:
    """Rows of the formats that have a reader of bytes, which gives page texts and properties.

    Empty pages go, page numbers stay those of the file, pages are joined without a separator.
    """
    schema = pa.schema([
        ("source_path", pa.string()), ("format", pa.string()), ("full_text", pa.string()),
        ("pages", pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())]))),
        ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string()),
    ])

    def one(path: str, format: str, data: bytes) -> dict:
        row = {"source_path": path, "format": format, "full_text": None, "pages": [], "metadata": [], "error": None}
        try:
            texts, properties = readers[format](data)
        except Exception as e:  # any broken file keeps its row
            return row | {"error": f"{type(e).__name__}: {e}"}
        pages, at = [], 0
        for i, t in enumerate(texts):
            if t:
                pages.append({"page_number": i + 1, "text": t, "char_start": at, "char_end": at + len(t)})
                at += len(t)
        full = "".join(p["text"] for p in pages)
        return row | {"full_text": full, "pages": pages, "metadata": [*properties.items()], "error": None if full.strip() else "no text"}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # files may be large: one at a time
                path, format, data = (b.column(k)[i].as_py() for k in range(3))
                yield pa.RecordBatch.from_pylist([one(path, format, data)], schema=schema)

    rows = found.where(F.col("format").isin(*readers) & F.col("error").isNull()).select("source_path", "format", "content")
    return rows.mapInArrow(run, DOCUMENT)


def load(spark: SparkSession, path: str, settings: Settings = DEFAULT, pdf_reader: Reader = no_pdf, glob: str | None = None) -> DataFrame:
    """All documents below `path`: source_path, format, full_text, pages, metadata, error."""
    found = files(spark, path, settings, glob)
    bad = found.where("error IS NOT NULL").select(
        "source_path", "format", F.lit(None).cast("string").alias("full_text"), F.array().cast(PAGES).alias("pages"), F.create_map().cast("map<string,string>").alias("metadata"), "error"
    )
    return text_documents(found).unionByName(binary_documents(found, {"docx": read_docx, "pdf": pdf_reader})).unionByName(bad)


def ingest(spark: SparkSession, path: str, settings: Settings = DEFAULT, pdf_reader: Reader = no_pdf, validate: bool = True) -> DataFrame:
    """Loaded and cleaned documents with doc_id (the path), text, pages, provenance and error."""
    loaded = load(spark, path, settings, pdf_reader).withColumn("doc_id", F.col("source_path"))
    pages = loaded.where("error IS NULL").select("doc_id", F.inline("pages"))
    docs = loaded.where("error IS NULL").select("doc_id", "format", F.col("full_text").alias("text"), F.length("full_text").alias("original_chars"), F.size("pages").alias("page_count"), "metadata")
    cleaned = cleaning.clean_documents(docs, pages, settings).withColumn("cleaned_chars", F.length("text")).withColumn("error", F.lit(None).cast("string"))
    if validate:
        cleaned = cleaning.accepted(cleaned, settings)
    bad = loaded.where("error IS NOT NULL").select("doc_id", "format", "metadata", "error")
    return cleaned.unionByName(bad, allowMissingColumns=True)


def upload_name(name: str, token: str) -> str:
    """A unique name to store an upload under."""
    return f"{token}_{re.sub(r'[^A-Za-z0-9._-]', '_', name)}"

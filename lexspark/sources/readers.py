"""Readers: text, HTML, JSON and JSONL, DOCX and PDF files to ``(doc_id, record)`` rows, record being JSON.

All go through Spark's own file sources, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text

SUFFIXES = {".txt": "text", ".md": "text", ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx", ".json": "json", ".jsonl": "jsonl"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in order; a table row is ``[TABLE] a | b``, cells merged across rows count once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def words(p: ElementTree.Element) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(x.tag.removeprefix(_W), "") for x in p.iter())

    out = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p" and words(block).strip():
            out.append(words(block))
        for row in block.findall(f"{_W}tr") if block.tag == f"{_W}tbl" else ():
            cells = [" ".join(filter(None, (words(p).strip() for p in cell.findall(f"{_W}p")))) for cell in row.findall(f"{_W}tc")]
            shown = [c for c, before in zip(cells, [None, *cells]) if c and c != before]
            if shown:
                out.append("[TABLE] " + " | ".join(shown))
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    try:
        import pymupdf
    except ImportError:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("PDF files need the pymupdf or pypdf package") from e
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    with pymupdf.open(stream=data, filetype="pdf") as doc:
        return "\n".join(page.get_text("text") or "" for page in doc)


def _decoded(kind: str):  # noqa: ANN202
    turn = {"text": lambda b: b.decode("utf-8", "replace"), "html": lambda b: html_text(b.decode("utf-8", "replace")), "docx": docx_text, "pdf": pdf_text}[kind]
    newline = (lambda s: s.replace("\r\n", "\n").replace("\r", "\n")) if kind in ("text", "html") else (lambda s: s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stems = pdf["path"].str.rsplit("/", n=1).str[-1].str.replace(r"\.[^.]*$", "", regex=True)
            texts = [newline(turn(bytes(b))) for b in pdf["content"]]
            yield pd.DataFrame({"doc_id": stems, "record": [json.dumps({"document_id": s, "title": s, "content": t, "source": p}, ensure_ascii=False) for s, t, p in zip(stems, texts, pdf["path"])]})

    return run


def _checked(record: Column, ok: Column, message: Column) -> Column:
    return F.when(ok, record).otherwise(F.raise_error(message).cast("string"))


def _key(record: Column) -> Column:
    """A record's own id; records without one share a hash of their text, which needn't be unique: rows are parsed one by one."""
    m = F.from_json(record, "map<string,string>")
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in ("document_id", "id", "doc_id")], F.concat(F.lit("row-"), F.sha2(record, 256)))


def read_jsonl(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped, a bad line fails with its file and text.

    ``numbered`` says the line's number too.  It reads each file in one piece, so it is for files that fit into a task; by
    default files are split.
    """
    file = F.col("_metadata.file_path")
    if numbered:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "value"), file.alias("name"))
        rows = whole.select("value", F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(" of "), "name").alias("file"))
    else:
        rows = spark.read.text(path).select("value", file.alias("file"))
    rows = rows.filter(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    ok = parsed.isNotNull() & (F.schema_of_variant(parsed).startswith("OBJECT"))
    why = F.when(parsed.isNull(), "Invalid JSONL").otherwise("JSONL line is not an object")
    record = _checked(F.col("value"), F.coalesce(ok, F.lit(False)), F.concat(why, F.lit(" in "), "file", F.lit(": "), F.substring("value", 1, 80)))
    return rows.select(record.alias("record")).select(_key(F.col("record")).alias("doc_id"), "record")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one object or an array of objects."""
    rows = spark.read.text(path, wholetext=True)
    parsed = F.parse_json("value")
    kind = F.schema_of_variant(parsed)
    items = F.when(kind.startswith("OBJECT"), F.array(parsed)).when(kind.startswith("ARRAY"), parsed.cast("array<variant>")).otherwise(F.raise_error(F.lit("JSON must be an object or an array of objects")).cast("array<variant>"))
    each = rows.select(F.explode(items).alias("v"))
    record = _checked(F.to_json("v"), F.schema_of_variant("v").startswith("OBJECT"), F.lit("JSON array items must be objects"))
    return each.select(record.alias("record")).select(_key(F.col("record")).alias("doc_id"), "record")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob leads to anything, in whichever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_records(spark: SparkSession, path: str, suffix: str | None = None, numbered: bool = False) -> DataFrame:
    """``(doc_id, record)`` of a file, folder or glob; ``suffix`` names the format where the path doesn't, ``numbered`` is for ``read_jsonl``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = (suffix or (name[name.rfind(".") :] if "." in name else "")).lower()
    kind = SUFFIXES.get(suffix)
    if kind is None:
        raise ValueError(f"Unsupported input format: {suffix}")
    if kind == "jsonl":
        return read_jsonl(spark, path, numbered)
    if kind == "json":
        return read_json(spark, path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_decoded(kind), "doc_id string, record string")

"""Readers: plain text, Markdown and Word files as document tables; files of other kinds as rejected rows.

Kinds are told by the lower-cased suffix. A broken file gives a row with an error, never a failed job.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.blocks import docx_blocks, text_blocks
from lexmill.operators.formatting import marked_paragraphs

TEXT_KINDS = ("txt", "md")
_MAIN, _STYLES, _RELS, _NUMBERS = "word/document.xml", "word/styles.xml", "word/_rels/document.xml.rels", "word/numbering.xml"
_CORE, _HEADER = "docProps/core.xml", "word/header1.xml"
_MEDIA = "word/media/"
#: What a damaged archive raises, be it in its directory, a part's data or the way it is packed.
_BROKEN = (zipfile.BadZipFile, zlib.error, struct.error, OSError, EOFError, RuntimeError, ValueError)


def _key(df: DataFrame) -> DataFrame:
    """doc_id from the path: stable across runs and partitions."""
    return df.withColumn("doc_id", F.xxhash64("path")).withColumn("kind", F.lower(F.substring_index("path", ".", -1)))


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, kind, content of every file under a path or pattern."""
    return _key(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def text_documents(found: DataFrame) -> DataFrame:
    """doc_id, path, kind, text, blocks of the text and Markdown files; the text as it is, a byte order mark dropped."""
    texts = found.where(F.col("kind").isin(*TEXT_KINDS)).withColumn("text", F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", ""))
    return text_blocks(texts).select("doc_id", "path", "kind", "text", "blocks")


def unzip(content: bytes | None) -> dict:
    """The parts of a Word file that matter, or an error."""
    out = {"document_xml": None, "styles_xml": "", "rels_xml": "", "has_numbering": False, "media": [], "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            names = set(z.namelist())
            if _MAIN not in names:
                return out | {"error": "no document part"}
            read = lambda n: z.read(n).decode("utf-8", "replace") if n in names else ""
            out |= {"document_xml": read(_MAIN), "styles_xml": read(_STYLES), "rels_xml": read(_RELS), "has_numbering": _NUMBERS in names}
            out["media"] = [n.removeprefix("word/") for n in z.namelist() if n.startswith(_MEDIA) and not n.endswith("/")]
    except _BROKEN as e:
        return out | {"error": f"unreadable archive: {type(e).__name__}"}
    return out


def docx_parts(found: DataFrame) -> DataFrame:
    """doc_id, path, the XML parts, media names and error of the Word files."""

    def run(batches):
        for b in batches:
            parts = pd.DataFrame([unzip(c) for c in b["content"]], index=b.index)
            yield pd.concat([b[["doc_id", "path"]], parts], axis=1)

    schema = "doc_id long, path string, document_xml string, styles_xml string, rels_xml string, has_numbering boolean, media array<string>, error string"
    return found.where("kind = 'docx'").select("doc_id", "path", "content").mapInPandas(run, schema)


def docx_sheets(found: DataFrame) -> DataFrame:
    """styles_xml of the Word files, as ``docx_parts`` has it: each sheet once for every batch of files, none for damaged ones."""

    def run(batches):
        for b in batches:
            sheets = set()
            for content in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        sheets.add(z.read(_STYLES).decode("utf-8", "replace") if _STYLES in z.NameToInfo else "")
                except _BROKEN:
                    continue
            yield pd.DataFrame({"styles_xml": sorted(sheets)}, dtype=object)

    return found.where("kind = 'docx'").select("content").mapInPandas(run, "styles_xml string")


def docx_media(found: DataFrame) -> DataFrame:
    """doc_id, target, data of every media file in the Word files."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(doc_id, n.removeprefix("word/"), z.read(n)) for n in z.namelist() if n.startswith(_MEDIA) and not n.endswith("/")]
                except _BROKEN:
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "target", "data"])

    return found.where("kind = 'docx'").select("doc_id", "content").mapInPandas(run, "doc_id long, target string, data binary")


def docx_properties(found: DataFrame) -> DataFrame:
    """doc_id, document_xml, core_xml, header_xml: the text, the properties and the first header of the Word files, read in one pass.

    Null where a file has no such part or is damaged.
    """

    def part(content: bytes | None, name: str) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                return z.read(name).decode("utf-8", "replace") if name in z.namelist() else None
        except _BROKEN:
            return None

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: [part(x, name) for x in b["content"]] for c, name in (("document_xml", _MAIN), ("core_xml", _CORE), ("header_xml", _HEADER))}}, index=b.index)

    return found.where("kind = 'docx'").select("doc_id", "content").mapInPandas(run, "doc_id long, document_xml string, core_xml string, header_xml string")


def docx_documents(found: DataFrame, marks: bool = False) -> DataFrame:
    """doc_id, path, kind, text, blocks, has_numbering of the Word files that could be read; with ``marks``, bold and italics as inline marks."""
    parts = docx_parts(found).where("error is null")
    return parts.select("doc_id", "path").join(docx_blocks(parts, marked_paragraphs(parts) if marks else None), "doc_id").select("doc_id", "path", F.lit("docx").alias("kind"), "text", "blocks", "has_numbering")


def documents(found: DataFrame) -> DataFrame:
    """doc_id, path, kind, text, blocks of every file of a known kind that could be read."""
    return text_documents(found).unionByName(docx_documents(found).drop("has_numbering"))


def rejected(found: DataFrame) -> DataFrame:
    """doc_id, path, reason of files of another kind and of broken Word files."""
    other = found.where(~F.col("kind").isin(*TEXT_KINDS, "docx")).select("doc_id", "path", F.lit("unsupported format").alias("reason"))
    return other.unionByName(docx_parts(found).where("error is not null").select("doc_id", "path", F.col("error").alias("reason")))

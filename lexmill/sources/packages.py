"""Word packages from parts and media: a multi-part sink that keeps every image byte and table cell.

Media are addressed by content: equal bytes in a document are one part, named by their digest, and every relationship that led
to any of them leads there. Relationships to other things, and media that no relationship names, stay. Names and relationships are
columns; Python only writes the archives, one document's parts at a time.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import blocks as B

_DECL = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_MEDIA = "array<struct<target:string,data:binary>>"


def links(parts: DataFrame, media: DataFrame) -> DataFrame:
    """doc_id, rel_id, target, data of every relationship to a media file that is there, and of media without one (null rel_id).

    parts: doc_id, rels_xml. media: doc_id, target, data. A relationship to media that are missing gives no row.
    """
    rels = parts.select("doc_id", F.explode(B.relationships(F.col("rels_xml"))).alias("rel_id", "target")).where(F.startswith("target", F.lit("media/")))
    # both sides grow with the documents: merged, however well their bytes pack
    return media.join(rels.hint("merge"), ["doc_id", "target"], "left").select("doc_id", "rel_id", "target", "data")


def addressed(rows: DataFrame) -> DataFrame:
    """``links`` with part: where the bytes go, the same place for equal bytes of a document and kind of file."""
    name = F.element_at(F.split("target", "/"), -1)
    kind = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))).otherwise("")
    return rows.withColumn("part", F.concat(F.lit("media/"), F.sha2("data", 256), kind))


def readdressed(parts: DataFrame, media: DataFrame) -> DataFrame:
    """``parts`` with rels_xml led to content addresses, and ``media`` array<struct<target, data>>, each content once."""
    rows = addressed(links(parts, media))
    held = rows.groupBy("doc_id", "part").agg(F.first("data").alias("data")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("target"), "data"))).alias("media"))
    # ids are read as they are written, targets decoded
    tag = F.concat(F.lit('<Relationship Id="'), F.col("rel_id"), F.lit(f'" Type="{_OFFICE}/image" Target="'), T.escape_xml(F.col("part")), F.lit('"/>'))
    led = rows.where("rel_id IS NOT NULL").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(tag)), "").alias("led"))
    tags = F.regexp_extract_all(F.coalesce("rels_xml", F.lit("")), F.lit(r"<Relationship\b[^>]*>"), F.lit(0))
    other = F.array_join(F.filter(tags, lambda t: ~t.rlike(r'\bTarget="media/')), "")
    whole = F.concat(F.lit(f'<Relationships xmlns="{_PACKAGE}/relationships">'), other, F.coalesce("led", F.lit("")), F.lit("</Relationships>"))
    out = parts.drop("media").join(led.hint("merge"), "doc_id", "left").join(held.hint("merge"), "doc_id", "left")
    return out.withColumn("rels_xml", whole).withColumn("media", F.coalesce("media", F.array().cast(_MEDIA))).drop("led")


def package(document: str, styles: str | None, rels: str | None, numbering: str | None, media: list[tuple[str, bytes]]) -> bytes:
    """A Word file of its parts. Equal parts give equal bytes."""
    kinds = sorted({t.rsplit(".", 1)[1].lower() for t, _ in media if "." in t.rsplit("/", 1)[-1]})
    types = "".join(f"<Default Extension={quoteattr(k)} ContentType={quoteattr(_mime(k))}/>" for k in kinds)
    bare = "".join(f'<Override PartName={quoteattr("/word/" + t)} ContentType="application/octet-stream"/>' for t, _ in media if "." not in t.rsplit("/", 1)[-1])
    named = [(n, k) for n, k, x in (("styles", "styles", styles), ("numbering", "numbering", numbering)) if x]
    parts = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{_MAIN}.{k}+xml"/>' for n, k in named)
    files = {
        "[Content_Types].xml": f'{_DECL}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}<Override PartName="/word/document.xml" ContentType="{_MAIN}.document.main+xml"/>{parts}{bare}</Types>',
        "_rels/.rels": f'{_DECL}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": document,
    }
    files |= {f"word/{n}": x for n, x in (("styles.xml", styles), ("_rels/document.xml.rels", rels), ("numbering.xml", numbering)) if x}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [(n, x.encode()) for n, x in files.items()] + [(f"word/{t}", bytes(d)) for t, d in media]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _mime(kind: str) -> str:
    from lexmill.functions import values as V

    return V.MIME_TYPES.get(kind, "application/octet-stream")


def packed(parts: DataFrame) -> DataFrame:
    """doc_id, docx of parts (doc_id, document_xml, styles_xml, rels_xml, numbering_xml, media array<struct<target, data>>)."""

    def run(batches):
        for b in batches:
            made = [package(d or "", s, r, n, [(m["target"], m["data"]) for m in media] if media is not None else []) for d, s, r, n, media in zip(b["document_xml"], b["styles_xml"], b["rels_xml"], b["numbering_xml"], b["media"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "docx": made}, index=b.index)

    return parts.select("doc_id", "document_xml", "styles_xml", "rels_xml", "numbering_xml", "media").mapInPandas(run, "doc_id long, docx binary")

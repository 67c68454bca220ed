"""Sinks: rendered Word files as one table of bytes, or as single files through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.layout import layout_rows, layout_runs, render


def rendered(works: DataFrame, as_of_year: int, logo: bytes | None = None) -> DataFrame:
    """doc_id, file_name, docx of every work record; ``logo`` is a PNG or JPEG file for the covers, or the institution's name stands there."""
    files = render(layout_runs(layout_rows(works, as_of_year, logo is not None)), logo, titles=works.select("doc_id", "title"))
    return works.select("doc_id", T.safe_file_name(F.col("title")).alias("file_name")).join(files, "doc_id")


def write_table(files: DataFrame, path: str) -> None:
    """The files as Parquet rows: the form for large numbers of them."""
    files.write.mode("overwrite").parquet(path)


def write_files(files: DataFrame, path: str) -> int:
    """Each file on its own under ``path`` (doc_id before its name), streamed through the driver; for small sets."""
    spark, n = files.sparkSession, 0
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in files.toLocalIterator():
        target = hadoop.Path(f"{path.rstrip('/')}/{r['doc_id']}-{r['file_name']}")
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            stream.write(bytes(r["docx"]))
        finally:
            stream.close()
        n += 1
    return n

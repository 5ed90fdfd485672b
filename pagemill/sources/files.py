"""Pages, templates and recognized lines from files."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Image
from pagemill.operators import images as pixels

TEMPLATE = "document_type string, name string, description string, field_types array<string>, layout_hints map<string,string>, _bad string"
LINE = "line_idx int, text string, confidence double, x int, y int, w int, h int, region_type string"


def _listed(path: Column, formats: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(rf"({'|'.join(f.replace('.', chr(92) + '.') for f in formats)})$")


def scan(spark: SparkSession, folder: str, formats: tuple[str, ...] = Image().allowed_formats) -> DataFrame:
    """Image files of a folder, not below it, any case of suffix, by path; content is read only if used."""
    files = spark.read.format("binaryFile").load(folder)
    return files.filter(_listed(F.col("path"), formats)).orderBy("path")


def images(spark: SparkSession, folder: str, formats: tuple[str, ...] = Image().allowed_formats) -> DataFrame:
    """Decoded images of the listed suffixes; one that cannot be decoded has height -1."""
    return spark.read.format("image").load(folder).filter(_listed(F.col("image.origin"), formats))


FLAT = "origin string, height int, width int, nChannels int, mode int, data binary"


def _decode_flat(frames):
    for frame in frames:
        out = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            try:
                own = pixels.decode(bytes(content))
                own = own[..., None] if own.ndim == 2 else own[..., ::-1]
                out.append((path, *own.shape, 0 if own.shape[2] == 1 else 16, own.tobytes()))
            except Exception:  # as the image source has it
                out.append((path, -1, -1, -1, -1, b""))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLAT.split(", ")])


def from_bytes(content: DataFrame) -> DataFrame:
    """Rows of the image source from rows of path and content; what cannot be decoded has height -1."""
    flat = content.select("path", "content").mapInPandas(_decode_flat, FLAT)
    return flat.select(F.struct(*[c.split()[0] for c in FLAT.split(", ")]).alias("image"))


def decoded(content: DataFrame) -> DataFrame:
    """Add success and error to rows of the image source."""
    ok = F.col("image.height") > 0
    return content.withColumn("success", ok).withColumn("error", F.when(~ok, "cannot decode image"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of all JSON files; the type is the file's stem if it has none, bad files are left out."""
    path = F.input_file_name()
    rows = spark.read.schema(TEMPLATE).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*.json")
    rows = rows.withColumn("document_type", F.coalesce("document_type", F.regexp_extract(path, r"([^/]+)\.json$", 1)))
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def pages_of_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: lines in order, full_text by newline, mean confidence or 0."""
    line = F.struct(*[c for c in ("line_idx", "text", "confidence", "x", "y", "w", "h", "region_type") if c in lines.columns])
    pages = lines.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    return pages.withColumn("full_text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))


def engine_words(words: DataFrame) -> DataFrame:
    """Words of an engine that counts confidence to 100: blank, unsure and empty boxes go."""
    kept = words.filter((F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "") != "") & (F.col("conf") >= 0) & (F.col("w") > 0) & (F.col("h") > 0))
    return kept.withColumn("confidence", F.col("conf") / 100.0).drop("conf")


def quads_to_lines(quads: DataFrame, blanks: bool = False) -> DataFrame:
    """Lines of an engine that gives corners and confidence as text."""
    from pagemill.operators.boxes import points_to_box

    rows = quads.withColumn("b", points_to_box(F.col("pts"))).withColumn("confidence", F.col("conf").try_cast("double"))
    rows = rows if blanks else rows.filter(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "") != "")
    return rows.select("doc_id", F.col("idx").cast("int").alias("line_idx"), "text", "confidence", "b.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

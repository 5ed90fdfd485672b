"""Results as files: JSON, CSV or both, HTML reports and overlays, and logging."""

from __future__ import annotations

import logging
import sys
import zlib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import report
from pagemill.operators.extract import fields_long
from pagemill.operators.images import pixels_of, png


def write_json(extracted: DataFrame, folder: str, key: str = "doc_id") -> None:
    """A JSON line a document."""
    row = F.struct(F.col(key), report.extraction(extracted).alias("result"))
    extracted.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def write_csv(extracted: DataFrame, folder: str, key: str = "doc_id") -> None:
    """A CSV line a field."""
    rows = fields_long(extracted, key)
    rows.select(key, "document_type", "rank", "field_type", "value", "confidence", "source_text", "source_line", "bbox.*").write.mode("overwrite").option("escape", '"').csv(folder, header=True)


def write(extracted: DataFrame, folder: str, form: str = "json", key: str = "doc_id") -> None:
    """form: json, csv or both."""
    if form not in ("json", "csv", "both"):
        raise ValueError(f"unknown form {form}")
    if form in ("json", "both"):
        write_json(extracted, f"{folder}/json", key)
    if form in ("csv", "both"):
        write_csv(extracted, f"{folder}/csv", key)


def write_reports(results: DataFrame, folder: str, key: str = "path") -> None:
    """A row a processed document with its HTML report and SVG overlay, as Parquet."""
    marks = F.concat(report.region_marks(F.col("regions")), report.annotations(F.col("fields")))
    page = report.html(F.col(key), F.col("document_type"), F.col("fields"), F.col("full_text"))
    results.filter("success").select(key, page.alias("html"), report.svg(F.col("width"), F.col("height"), marks).alias("svg")).write.mode("overwrite").parquet(folder)


def _saver(folder: str):
    def save(frames):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            out = []
            for _, row in frame.iterrows():
                data = png(pixels_of(row))
                file = f"{base}/{row['origin'].rsplit('/', 1)[-1].rsplit('.', 1)[0]}-{zlib.crc32(row['origin'].encode()):08x}.png"
                with store.open_output_stream(file) as f:
                    f.write(data)
                out.append((row["origin"], file, len(data)))
            yield pd.DataFrame(out, columns=["path", "file", "size"])

    return save


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Write rows of the image source as PNG files; path, file and size of each.

    Names end in a hash of the path, so those of equal stems do not meet, and a
    repeated task writes the same file again.  The folder is one that pyarrow
    can open, and exists.
    """
    rows = images.filter("image.height > 0").select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInPandas(_saver(folder), "path string, file string, size bigint")


def logger(name: str, level: str = "INFO", file: str | None = None) -> logging.Logger:
    """A logger with one handler of each kind, however often it is asked for."""
    out = logging.getLogger(name)
    out.setLevel(level)
    form = logging.Formatter("%(asctime)s [%(levelname)s] %(name)s: %(message)s")
    if not any(type(h) is logging.StreamHandler for h in out.handlers):
        out.addHandler(logging.StreamHandler())
    if file and not any(isinstance(h, logging.FileHandler) for h in out.handlers):
        out.addHandler(logging.FileHandler(file, encoding="utf-8"))
    for h in out.handlers:
        h.setFormatter(form)
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""From page images to results: clean-up, boxes, layout, lines, text, fields.

Boxes and lines are two branches, joined by path at the end: recognition reads
the whole page.  A page that fails in either branch is a result with its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.functions.text import process_lines
from pagemill.operators import boxes, images, report
from pagemill.operators.extract import extract
from pagemill.sources import files, ocr


def regions(analysed: DataFrame, settings: Settings) -> DataFrame:
    """path and regions: boxes that stay, classified, in reading order."""
    d = settings.detection
    found = analysed.select("path", F.explode("regions").alias("r")).select("path", "r.*")
    kept = boxes.reading_order(boxes.suppress(boxes.filter_by_size(found, d.min_region_area, d.max_region_area, d.min_aspect_ratio, d.max_aspect_ratio), "path", d.nms_threshold), "path")
    layout = analysed.select("path", F.explode("layout").alias("l")).select("path", "l.*")
    sized = kept.join(analysed.select("path", "height", "width"), "path")
    classed = boxes.classify(sized, layout, F.col("height"), F.col("width"), "path")
    each = F.struct("order", "region_idx", "x", "y", "w", "h", "confidence", "region_type")
    return classed.groupBy("path").agg(F.array_sort(F.collect_list(each)).alias("regions"))


def fields(lines: DataFrame, settings: Settings, profile: str = "standard") -> DataFrame:
    """path, lines, full_text, avg_confidence, document_type and fields of rows of lines."""
    least = settings.ocr.confidence_threshold
    lines = lines.filter("line_idx >= 0")
    pages = files.pages_of_lines(lines if least is None else lines.filter(F.col("confidence") >= least), "path")
    if profile == "standard":
        pages = pages.withColumn("lines", process_lines("lines")).withColumn("full_text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    return extract(pages.withColumn("hint", F.lit(settings.extraction.document_type)), profile, hint="hint").drop("hint")


def process(pages: DataFrame, lines: DataFrame | None = None, settings: Settings | None = None, profile: str = "standard") -> DataFrame:
    """One result a row of the image source.

    lines: path, line_idx, text, confidence, x, y, w, h of pages recognized
    elsewhere; without them the engine of the settings reads the images.
    """
    settings = settings or Settings()
    analysed = images.analyse(pages, settings, profile)
    read = ocr.recognize(pages, settings.ocr.engine, settings) if lines is None else lines.withColumn("success", F.lit(True)).withColumn("error", F.lit(None).cast("string")).withColumn("took", F.lit(None).cast("double"))
    told = read.groupBy("path").agg(F.bool_and("success").alias("_read"), F.max("error").alias("_why"), F.max("took").alias("_took"))
    found = fields(read.filter("success").select("path", "line_idx", "text", "confidence", "x", "y", "w", "h"), settings, profile)
    both = analysed.drop("regions").join(regions(analysed, settings), "path", "left").join(told, "path", "left").join(found, "path", "left")
    none = F.array()
    return both.select(
        "path",
        (F.col("success") & F.coalesce("_read", F.lit(True))).alias("success"),
        F.coalesce("error", "_why").alias("error"),
        report.empty_page(F.coalesce("lines", none.cast(both.schema["lines"].dataType))).alias("warning"),
        "height", "width", "crop_x", "crop_y", "angle", "hash",
        F.when(F.col("_took").isNull(), F.col("timings")).otherwise(F.map_concat("timings", F.create_map(F.lit("ocr"), F.col("_took")))).alias("timings"),
        F.coalesce("regions", none.cast(both.schema["regions"].dataType)).alias("regions"),
        "layout",
        F.coalesce("lines", none.cast(both.schema["lines"].dataType)).alias("lines"),
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("fields", none.cast(both.schema["fields"].dataType)).alias("fields"),
    )


def result_json(results: DataFrame, settings: Settings | None = None) -> Column:
    """The JSON text of a processed document; error and warnings only where there are any."""
    settings = settings or Settings()
    ok = F.col("success")
    parts = [
        F.col("success"),
        F.col("path").alias("image_path"),
        F.when(ok, F.struct(F.size("regions").alias("total_regions"), F.transform("regions", lambda r: r["region_type"]).alias("types"))).alias("detection"),
        F.when(ok, F.struct(F.size("lines").alias("total_lines"), F.round("avg_confidence", 3).alias("avg_confidence"), F.col("full_text"))).alias("ocr"),
        F.when(ok, report.extraction(results, settings.extraction.confidence_threshold)).alias("extraction"),
        F.col("timings").alias("processing_times_ms"),
    ]
    json = lambda *more: F.to_json(F.struct(*parts, *more), {"ignoreNullFields": "false"})
    return F.when(~ok, json(F.col("error"))).when(F.col("warning").isNotNull(), json(F.array("warning").alias("warnings"))).otherwise(json())

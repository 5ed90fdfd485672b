"""Results for people and programs: colours, overlays, HTML, JSON, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.plans import catalog

# Colours as red, green, blue numbers.
REGION_COLORS = {
    "title": (0, 165, 255),
    "header": (255, 165, 0),
    "body": (0, 255, 0),
    "table": (255, 0, 255),
    "seal": (0, 0, 255),
    "footer": (128, 128, 128),
    "sidebar": (255, 255, 0),
    "unknown": (200, 200, 200),
}
CATEGORY_COLORS = {
    "monetary": (0, 0, 220),
    "identification": (220, 120, 0),
    "entity": (0, 180, 0),
    "temporal": (200, 0, 200),
    "contact": (0, 200, 200),
    "metadata": (128, 128, 128),
}


def _rgb(c: tuple[int, int, int]) -> Column:
    return F.lit(f"rgb({c[0]},{c[1]},{c[2]})")


def confidence_color(confidence: Column) -> Column:
    """green from 0.8, orange from 0.6, else red."""
    return F.when(confidence >= 0.8, _rgb((0, 200, 0))).when(confidence >= 0.6, _rgb((0, 165, 255))).otherwise(_rgb((0, 0, 255)))


def percent(confidence: Column) -> Column:
    """Whole percent, halves to even."""
    return F.bround(confidence * 100, 0).cast("int")


def percent_color(confidence: Column) -> Column:
    p = percent(confidence)
    return F.when(p >= 80, "#28a745").when(p >= 60, "#fd7e14").otherwise("#dc3545")


def region_color(kind: Column) -> Column:
    out = _rgb(REGION_COLORS["unknown"])
    for k, c in REGION_COLORS.items():
        out = F.when(kind == k, _rgb(c)).otherwise(out)
    return out


def type_title(kind: Column) -> Column:
    """The name of a document type; an unlisted type is its own name."""
    out = kind
    for k, name in catalog.TYPE_TITLES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def titled(f: Column, profile: str = "standard") -> Column:
    """The display name of a field struct."""
    out = f["field_type"]
    for x in catalog.PROFILES[profile]:
        out = F.when(f["field_type"] == x.name, x.title).otherwise(out)
    return out


def category(f: Column, profile: str = "standard") -> Column:
    out = F.lit("metadata")
    for x in catalog.PROFILES[profile]:
        out = F.when(f["field_type"] == x.name, x.category).otherwise(out)
    return out


def annotations(fields: Column, text_height: int = 12) -> Column:
    """Boxes and labels of fields that have a box: what an overlay draws."""
    seen = F.filter(fields, lambda f: (f["bbox"]["w"] > 0) | (f["bbox"]["h"] > 0) | (f["bbox"]["x"] > 0) | (f["bbox"]["y"] > 0))
    return F.transform(
        seen,
        lambda f: F.struct(
            *[f["bbox"][k].alias(k) for k in "xywh"],
            F.concat(titled(f), F.lit(": "), F.substring(f["value"], 1, 20)).alias("label"),
            F.greatest(f["bbox"]["y"] - 5, F.lit(text_height + 5)).alias("label_y"),
            confidence_color(f["confidence"]).alias("color"),
        ),
    )


def region_marks(regions: Column) -> Column:
    """Boxes of regions in the colour of their type, labelled with it."""
    return F.transform(
        regions,
        lambda r: F.struct(*[r[k].alias(k) for k in "xywh"], r["region_type"].alias("label"), F.greatest(r["y"] - 5, F.lit(17)).alias("label_y"), region_color(r["region_type"]).alias("color")),
    )


def svg(width: Column, height: Column, marks: Column) -> Column:
    """An overlay of annotations as an SVG text, to lie over the page image."""
    shape = lambda m: F.format_string(
        '<rect x="%d" y="%d" width="%d" height="%d" fill="none" stroke="%s" stroke-width="2"/><text x="%d" y="%d" fill="%s">%s</text>',
        m["x"], m["y"], m["w"], m["h"], m["color"], m["x"], m["label_y"], m["color"], escape(m["label"]),
    )
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', width, height)
    return F.concat(head, F.array_join(F.transform(marks, shape), ""), F.lit("</svg>"))


def html(doc: Column, kind: Column, fields: Column, text: Column) -> Column:
    """A report: summary, fields with colours, and the first 2,000 characters read."""
    row = lambda f: F.concat(
        F.lit("<tr><td>"), escape(titled(f)), F.lit("</td><td>"), escape(f["value"]), F.lit('</td><td style="color:'), percent_color(f["confidence"]), F.lit('">'), percent(f["confidence"]).cast("string"), F.lit("%</td></tr>"),
    )
    return F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><h1>'), escape(doc.cast("string")), F.lit("</h1><p>"), escape(type_title(kind)), F.lit(": "), F.size(fields).cast("string"), F.lit("</p><table>"),
        F.array_join(F.transform(fields, row), ""), F.lit("</table><pre>"), escape(F.substring(F.coalesce(text, F.lit("")), 1, 2000)), F.lit("</pre></body></html>"),
    )


def field_json(f: Column) -> Column:
    return F.struct(f["field_type"].alias("field_type"), titled(f).alias("display_name"), f["value"].alias("value"), F.round(f["confidence"], 3).alias("confidence"), f["source_text"].alias("source_text"), category(f).alias("category"))


def extraction(extracted: DataFrame, high: float = 0.6) -> Column:
    """What is said of a document's fields; fields is a map in order of confidence."""
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field_type"], field_json(f))))
    return F.struct("document_type", F.size("fields").alias("total_fields"), F.size(F.filter("fields", lambda f: f["confidence"] >= high)).alias("high_confidence_fields"), fields.alias("fields"))


def extraction_json(extracted: DataFrame) -> Column:
    """One JSON text a document."""
    return F.to_json(extraction(extracted), {"ignoreNullFields": "false"})


def result_json(success: Column, error: Column, body: Column) -> Column:
    """A result text; error is there only if it is not empty, body even if null."""
    with_error = F.to_json(F.struct(success.alias("success"), body.alias("extraction"), error.alias("error")), {"ignoreNullFields": "false"})
    without = F.to_json(F.struct(success.alias("success"), body.alias("extraction")), {"ignoreNullFields": "false"})
    return F.when(F.coalesce(error, F.lit("")) != "", with_error).otherwise(without)


def preview(text: Column, visual: bool = False) -> Column:
    """The text of a response: 500 characters, 2,000 in a visual one."""
    return F.substring(text, 1, 2000 if visual else 500)


def response(extracted: DataFrame, visual: bool = False) -> DataFrame:
    return extracted.select("doc_id", F.lit(True).alias("success"), "document_type", F.size("fields").cast("int").alias("total_fields"), F.size(F.filter("fields", lambda f: f["confidence"] >= 0.6)).cast("int").alias("high_confidence_fields"), preview(F.col("full_text"), visual).alias("ocr_text"))


def batch_summary(results: DataFrame) -> DataFrame:
    """total, successful and failed of rows with success."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.coalesce("success", F.lit(False))).alias("successful")).select("total", "successful", (F.col("total") - F.col("successful")).alias("failed"))


def console_lines(extracted: DataFrame) -> Column:
    """A line a field as the console shows it."""
    return F.transform("fields", lambda f: F.concat(titled(f), F.lit(": "), F.substring(f["value"], 1, 40), F.lit(" ("), percent(f["confidence"]).cast("string"), F.lit("%)")))


def empty_page(lines: Column) -> Column:
    """What the lite profile says of a page without text: a warning, else null."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, "no text was recognized")


def templates(spark, profile: str = "standard") -> DataFrame:
    rows = [(k, name, about, own if own is not None else catalog.ROUTES[profile][k]) for k, name, about, own in catalog.TEMPLATES[profile]]
    return spark.createDataFrame(rows, "document_type string, name string, description string, field_types array<string>")


def health(engine: str | None, profile: str = "standard") -> dict:
    """Lite is degraded without an OCR engine; standard is always healthy."""
    return {"status": "degraded" if profile == "lite" and engine is None else "healthy", "ocr_available": engine is not None, "engine": engine}

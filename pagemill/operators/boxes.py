"""Boxes: filters, suppression, classes, and merging of text on one line.

Boxes are structs or columns x, y, w, h.  Order-dependent steps are folds over
the boxes of one document, an array of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import is_blank


def area(b: Column | None = None) -> Column:
    w, h = (F.col("w"), F.col("h")) if b is None else (b["w"], b["h"])
    return w.cast("bigint") * h.cast("bigint")


def aspect() -> Column:
    return F.col("w") / F.greatest("h", F.lit(1))


def with_derived(df: DataFrame) -> DataFrame:
    """Add area, aspect_ratio, center_x and center_y; centres are cut down."""
    return df.withColumns(
        {"area": area(), "aspect_ratio": aspect(), "center_x": (F.col("x") + F.floor(F.col("w") / 2)).cast("int"), "center_y": (F.col("y") + F.floor(F.col("h") / 2)).cast("int")}
    )


def points_to_box(points: Column) -> Column:
    """The upright box of an array of struct(x, y), cut to whole numbers."""
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k].cast("int")))
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k].cast("int")))
    return F.struct(low("x").alias("x"), low("y").alias("y"), (high("x") - low("x")).alias("w"), (high("y") - low("y")).alias("h"))


def filter_by_size(df: DataFrame, min_area: int = 100, max_area: int = 50_000, min_aspect: float = 0.1, max_aspect: float = 10.0) -> DataFrame:
    return df.filter(area().between(min_area, max_area) & aspect().between(min_aspect, max_aspect))


def filter_by_confidence(df: DataFrame, least: float = 0.5) -> DataFrame:
    return df.filter(F.col("confidence") >= least)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 if the union is empty."""
    side = lambda k, n: F.greatest(F.lit(0), F.least(a[k] + a[n], b[k] + b[n]) - F.greatest(a[k], b[k])).cast("bigint")
    inter = side("x", "w") * side("y", "h")
    union = area(a) + area(b) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def suppress(df: DataFrame, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Keep boxes in order of confidence that overlap no kept one by the threshold or more."""
    box = F.struct((-F.col("confidence")).alias("o"), *[F.col(c) for c in ("region_idx", "x", "y", "w", "h", "confidence")])
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", none, lambda k, c: F.when(F.exists(k, lambda o: iou(o, c) >= threshold), k).otherwise(F.concat(k, F.array(c))))
    return grouped.select(key, F.explode(kept).alias("b")).select(key, *[f"b.{c}" for c in ("region_idx", "x", "y", "w", "h", "confidence")])


def reading_order(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add order, from 0, by y, then x, then the given index."""
    return df.withColumn("order", F.row_number().over(Window.partitionBy(key).orderBy("y", "x", "region_idx")) - 1)


def detect(found: DataFrame, key: str = "doc_id", **sizes) -> DataFrame:
    """The steps after box finding: size filter, suppression, reading order."""
    return reading_order(suppress(filter_by_size(found, **sizes), key), key)


def class_by_position(height: Column | int, width: Column | int) -> Column:
    """title, header, footer or body by where and how large a box is."""
    h, w = (F.lit(v) if isinstance(v, int) else v for v in (height, width))
    ratio = (F.col("y") + F.col("h") / 2) / h
    return (
        F.when(ratio < 0.15, F.when(F.col("h") > h * 0.03, "title").otherwise("header"))
        .when(ratio > 0.90, "footer")
        .when((ratio < 0.4) & (F.col("w") > w * 0.5), "title")
        .otherwise("body")
    )


def layout_class(height: Column | int, width: Column | int) -> Column:
    """header, footer, sidebar, table or body by whole-number centre, shape and share."""
    h, w = (F.lit(v) if isinstance(v, int) else v for v in (height, width))
    cy = F.col("y") + F.floor(F.col("h") / 2)
    return (
        F.when(cy < h * 0.15, "header")
        .when(cy > h * 0.85, "footer")
        .when((aspect() < 0.2) | (aspect() > 5.0), "sidebar")
        .when(area() / (w * h) > 0.3, "table")
        .otherwise("body")
    )


def class_by_overlap(regions: DataFrame, layout: DataFrame, key: str = "doc_id") -> DataFrame:
    """The class of the layout region that covers most of a box; the first of equals, else body.

    Layout regions of a document are one short array, so the join is one to one.
    """
    own = layout.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layout_idx", "x", "y", "w", "h", "region_type"))).alias("_l"))
    side = lambda lr, k, n: F.greatest(F.lit(0), F.least(F.col(k) + F.col(n), lr[k] + lr[n]) - F.greatest(F.col(k), lr[k])).cast("bigint")
    share = F.transform("_l", lambda lr: F.struct((side(lr, "x", "w") * side(lr, "y", "h") / F.greatest(area(), F.lit(1))).alias("s"), (-lr["layout_idx"]).alias("i"), lr["region_type"].alias("t")))
    best = F.array_max(F.filter(share, lambda c: c["s"] > 0))
    return regions.drop("region_type").join(own, key, "left").withColumn("region_type", F.coalesce(best["t"], F.lit("body"))).drop("_l")


def classify(regions: DataFrame, layout: DataFrame, height: Column | int, width: Column | int, key: str = "doc_id") -> DataFrame:
    """By overlap in documents that have layout regions, else by position."""
    has = layout.select(key).distinct().withColumn("_has", F.lit(True))
    by_overlap = class_by_overlap(regions, layout, key)
    return by_overlap.join(has, key, "left").withColumn("region_type", F.when(F.col("_has"), F.col("region_type")).otherwise(class_by_position(height, width))).drop("_has")


def count_types(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    return regions.groupBy(key, "region_type").agg(F.count("*").alias("n"))


def _on_lines(lines: Column, gap: int) -> Column:
    """Groups of boxes whose y is within gap of the group's first, in order of y, x."""
    ordered = F.array_sort(F.transform(lines, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["idx"].alias("idx"), b["w"].alias("w"), b["h"].alias("h"), b["text"].alias("text"), b["confidence"].alias("confidence"))))
    none = F.transform(F.slice(ordered, 1, 0), lambda b: F.struct(b["y"].alias("anchor"), F.array(b).alias("own")))

    def step(groups: Column, b: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joins = F.coalesce(F.abs(b["y"] - last["anchor"]) <= gap, F.lit(False))
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(last["anchor"].alias("anchor"), F.concat(last["own"], F.array(b)).alias("own"))))
        return F.when(joins, grown).otherwise(F.concat(groups, F.array(F.struct(b["y"].alias("anchor"), F.array(b).alias("own")))))

    return F.transform(F.aggregate(ordered, none, step), lambda g: g["own"])


def _across(group: Column) -> Column:
    """A group from left to right; equals keep the order of y."""
    return F.array_sort(F.transform(group, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["text"].alias("text"))))


def merge_lines(lines: Column, gap: int = 10) -> Column:
    """Boxes of array<struct<idx,x,y,w,h,text,confidence>> merged into text lines; blank ones are dropped."""

    def merged(g: Column) -> Column:
        low = lambda k: F.array_min(F.transform(g, lambda b: b[k]))
        high = lambda k, n: F.array_max(F.transform(g, lambda b: b[k] + b[n]))
        total = F.aggregate(F.array_sort(F.transform(g, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["confidence"].alias("c")))), F.lit(0.0), lambda s, b: s + b["c"])
        return F.struct(
            F.array_join(F.transform(F.filter(_across(g), lambda b: ~is_blank(b["text"])), lambda b: b["text"]), " ").alias("text"),
            (total / F.size(g)).alias("confidence"),
            low("x").alias("x"),
            low("y").alias("y"),
            (high("x", "w") - low("x")).alias("w"),
            (high("y", "h") - low("y")).alias("h"),
        )

    return F.filter(F.transform(_on_lines(lines, gap), merged), lambda m: ~is_blank(m["text"]))


def merge_texts(lines: Column, gap: int = 5) -> Column:
    """The texts of merged lines only; white space counts as text in a line of others."""
    joined = F.transform(_on_lines(lines, gap), lambda g: F.array_join(F.transform(F.filter(_across(g), lambda b: b["text"] != ""), lambda b: b["text"]), " "))
    return F.filter(joined, lambda t: ~is_blank(t))

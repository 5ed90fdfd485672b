"""Pixel rules on small grids as columns: gray values, hash, threshold, strips.

A grid is height, width and px, an array of gray values row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rgb_to_gray(rgb: Column) -> Column:
    """Luma of array<struct<r,g,b>>, rounded."""
    return F.transform(rgb, lambda p: F.floor(p["r"] * 0.299 + p["g"] * 0.587 + p["b"] * 0.114 + 0.5).cast("int"))


def gray_to_rgb(gray: Column) -> Column:
    return F.transform(gray, lambda v: F.struct(v.alias("r"), v.alias("g"), v.alias("b")))


def ensure_bytes(values: Column) -> Column:
    """Fractions up to 1 become 0 to 255; other numbers are cut."""
    scale = F.when(F.array_max(values) <= 1, F.lit(255.0)).otherwise(F.lit(1.0))
    return F.transform(values, lambda v: F.floor(v * scale).cast("int"))


def estimate_dpi(height: Column, width: Column) -> Column:
    """Dots an inch if the page is A4, from 72 to 600."""
    guess = F.floor(F.lit(72.0) * F.sqrt(height.cast("double") * width / F.lit(595.0 * 842.0))).cast("int")
    return F.greatest(F.lit(72), F.least(F.lit(600), guess))


def difference_hash(px: Column, n: int = 8) -> Column:
    """Hex digits of n * n bits: whether a pixel is darker than the one to its right.

    px has n rows of n + 1 pixels.
    """
    bit = lambda i: (F.get(px, F.floor(i / n).cast("int") * (n + 1) + i % n + 1) > F.get(px, F.floor(i / n).cast("int") * (n + 1) + i % n)).cast("int")
    nibble = lambda k: bit(k * 4) * 8 + bit(k * 4 + 1) * 4 + bit(k * 4 + 2) * 2 + bit(k * 4 + 3)
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n * n // 4 - 1)), lambda k: F.hex(nibble(k))), ""))


def otsu(grids: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and threshold: the gray value that splits the pixels with most variance between; the least of equals."""
    levels = grids.select(key, F.explode("px").alias("v")).groupBy(key, "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    s = levels.select(
        key,
        "v",
        F.sum("n").over(upto).alias("n0"),
        F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("all"),
        F.sum(F.col("n") * F.col("v")).over(whole).alias("total"),
    )
    n1 = F.col("all") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("total") - F.col("s0")) / F.when(n1 > 0, n1)
    between = F.coalesce(F.col("n0").cast("double") * n1 * gap * gap, F.lit(0.0))
    return s.groupBy(key).agg(F.max_by("v", F.struct(between.alias("b"), (-F.col("v")).alias("t"))).alias("threshold"))


def strip_box(height: Column, width: Column, px: Column, bottom: bool = False) -> Column:
    """The box of the page's top or bottom strip if over 5 % of it is dark, else null.

    A pixel of 255 is light.  Header and footer detection.
    """
    rows = F.least(F.greatest(F.floor(height / 20), F.lit(20)), height).cast("int")
    start = F.when(F.lit(bottom), height - rows).otherwise(F.lit(0))
    own = F.slice(px, start * width + 1, rows * width)
    light = F.size(F.filter(own, lambda v: v == 255)) / F.size(own)
    return F.when(light < 0.95, F.struct(F.lit(0).alias("x"), start.alias("y"), width.alias("w"), rows.alias("h"), F.lit("footer" if bottom else "header").alias("region_type"), F.lit(0.6).alias("confidence")))


def skew_angle(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and angle: the median of line angles folded into -45 to 45 degrees; 0 below half a degree."""
    raw = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    folded = F.when(raw > 45, raw - 90).when(raw < -45, raw + 90).otherwise(raw)
    return lines.groupBy(key).agg(F.median(folded).alias("a")).select(key, F.when(F.abs("a") < 0.5, F.lit(0.0)).otherwise(F.col("a")).alias("angle"))


def is_red(hue: Column, saturation: Column, value: Column) -> Column:
    """The colour of seals: hue of 0 to 180, saturation and value of 0 to 255."""
    return (hue.between(0, 10) | hue.between(160, 180)) & (saturation >= 70) & (value >= 50)

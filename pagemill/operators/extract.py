"""Document types and typed fields of texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import FLAGS, is_blank, strip
from pagemill.plans import catalog


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, which no later projection undoes."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def type_scores(seen: Column, profile: str = "standard") -> dict[str, Column]:
    """How many listed words of each type a text holds."""
    return {k: sum((F.contains(seen, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in catalog.KEYWORDS[profile].items()}


def document_type(text: Column, profile: str = "standard", hint: Column | None = None) -> Column:
    """The type of the highest score, the first of equals; unknown without a word.

    Lite minds case.  A hint other than "auto" decides alone.
    """
    best = lambda seen: F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("i"), F.lit(k).alias("type")) for i, (k, s) in enumerate(type_scores(seen, profile).items())]))
    found = let(text if profile == "lite" else F.lower(text), lambda seen: let(best(seen), lambda b: F.when(b["score"] > 0, b["type"]).otherwise("unknown")))
    return found if hint is None else F.when(F.coalesce(hint, F.lit("auto")) != "auto", hint).otherwise(found)


def routed(document_type: Column, profile: str = "standard") -> Column:
    """The fields of a type in their order."""
    out = F.array(*[F.lit(x) for x in catalog.ROUTES[profile]["unknown"]])
    for k, names in catalog.ROUTES[profile].items():
        out = F.when(document_type == k, F.array(*[F.lit(x) for x in names])).otherwise(out)
    return out


def _found(text: Column, f: catalog.Field, i: int, profile: str) -> Column:
    """The first match of a field's pattern with its score, or null.

    The pattern runs once over the text; the capture is taken from the match,
    and blank matches do not occur.
    """
    s, pattern = catalog.SCORING[profile], FLAGS + f.patterns[i]

    def scored(match: Column, value: Column) -> Column:
        total = F.lit(s.base + (s.label if f.labelled[i] else 0.0)) + F.when(F.char_length(value) >= s.least, F.lit(s.length)).otherwise(F.lit(0.0))
        if f.valid and profile == "standard":
            total = total + F.when(F.rlike(value, F.lit(FLAGS + f.valid)), F.lit(s.valid)).otherwise(F.lit(0.0))
        return F.struct(F.lit(f.name).alias("field"), F.lit(i).alias("i"), value.alias("value"), F.least(total, F.lit(s.cap)).alias("confidence"), match.alias("source_text"))

    return let(F.regexp_extract(text, pattern, 0), lambda match: F.when(match != "", let(strip(F.regexp_extract(match, pattern, 1)), lambda value: scored(match, value))))


def _candidates(text: Column, kind: Column, profile: str, every: bool) -> Column:
    """The scored matches of the wanted fields' patterns.

    A pattern is only run where the text holds one of its labels, in any case.
    """
    routes, own = catalog.ROUTES[profile], catalog.PROFILES[profile]
    bits = {k: sum(1 << j for j, f in enumerate(own) if f.name in names) for k, names in routes.items()}
    # A type's fields as the bits of one number, which is looked up once a text.
    mask = F.lit(bits["unknown"])
    for k in routes:
        mask = F.when(kind == k, F.lit(bits[k])).otherwise(mask)

    def of(seen: Column, wanted: Column) -> Column:
        out = []
        for j, f in enumerate(own):
            for i, pattern in enumerate(f.patterns if every or any(b >> j & 1 for b in bits.values()) else ()):
                needs = [F.contains(seen, F.lit(x)) for x in catalog.literals(pattern)]
                can = reduce(Column.__or__, needs) if needs else F.lit(True)
                out.append(F.when(can if every else (wanted.bitwiseAND(F.lit(1 << j)) != 0) & can, _found(text, f, i, profile)))
        return F.filter(F.array(*out), lambda c: c.isNotNull())

    # Letters that only case folding makes equal to Latin ones.
    return let(F.lower(F.translate(text, "ſİıK", "siik")), lambda seen: let(mask, lambda wanted: of(seen, wanted)))


def extract(pages: DataFrame, profile: str = "standard", hint: str | None = None, every: bool = False, aligned: bool = False) -> DataFrame:
    """Add document_type and fields to rows of full_text and, if there, lines.

    fields: array of struct(field_type, value, confidence, source_text,
    source_line, bbox), best first (lite: in route order).  The source line
    counts non-blank lines; the box is the one at that number among all lines,
    or with ``aligned`` the one of the line itself.  An empty full_text is made
    of the non-blank lines.
    """
    has_lines = "lines" in pages.columns
    full = F.coalesce(F.col("full_text"), F.lit("")) if "full_text" in pages.columns else F.lit("")
    own = F.transform("lines", lambda x: x["text"]) if has_lines else F.split(full, "\n")
    both = let(F.filter(own, lambda t: ~is_blank(t)), lambda lines: let(F.when(full == "", F.array_join(lines, "\n")).otherwise(full), lambda text: let(document_type(text, profile, F.col(hint) if hint else None), lambda kind: _extracted(text, lines, kind, has_lines, profile, every, aligned))))
    # The row generator keeps later projections from working the fields out once more each.
    return pages.select("*", F.inline(F.array(both)))


def _extracted(text: Column, lines: Column, kind: Column, has_lines: bool, profile: str, every: bool, aligned: bool) -> Column:
    """struct(document_type, fields)."""
    no_box = F.struct(*[F.lit(0).alias(k) for k in "xywh"])
    digits = catalog.SCORING[profile].digits

    def box_of(at: Column) -> Column:
        if not has_lines:
            return no_box
        rows = F.filter("lines", lambda x: ~is_blank(x["text"])) if aligned else F.col("lines")
        return F.when(at >= 0, let(F.get(rows, at), lambda x: F.struct(*[x[k].cast("int").alias(k) for k in "xywh"]))).otherwise(no_box)

    def best(scored: Column) -> Column:
        better = lambda o, c: (o["field"] == c["field"]) & ((o["confidence"] > c["confidence"]) | ((o["confidence"] == c["confidence"]) & (o["i"] < c["i"])))
        return F.filter(scored, lambda c: ~F.exists(scored, lambda o: better(o, c)))

    def ranked(found: Column, order: Column) -> Column:
        line_of = lambda value: F.coalesce(F.array_position(F.transform(lines, lambda t: F.contains(t, value)), True).cast("int") - 1, F.lit(-1))
        row = lambda c: F.struct(
            (F.lit(0.0) if profile == "lite" else -c["confidence"]).alias("o"),
            F.array_position(order, c["field"]).alias("r"),
            c["field"].alias("field_type"),
            c["value"].alias("value"),
            (F.round(c["confidence"], digits) if digits else c["confidence"]).alias("confidence"),
            c["source_text"].alias("source_text"),
            line_of(c["value"]).alias("source_line"),
        )
        keep = ("field_type", "value", "confidence", "source_text", "source_line")
        return F.transform(F.array_sort(F.transform(found, row)), lambda c: F.struct(*[c[k].alias(k) for k in keep], box_of(c["source_line"]).alias("bbox")))

    order = F.array(*[F.lit(f.name) for f in catalog.PROFILES[profile]]) if every else routed(kind, profile)
    fields = let(_candidates(text, kind, profile, every), lambda found: let(best(found), lambda chosen: let(order, lambda o: ranked(chosen, o))))
    return F.struct(kind.alias("document_type"), fields.alias("fields"))


def summary(extracted: DataFrame, profile: str = "standard") -> DataFrame:
    """Add total_fields and high_confidence_fields."""
    high = catalog.SCORING[profile].high
    return extracted.withColumn("total_fields", F.size("fields")).withColumn("high_confidence_fields", F.size(F.filter("fields", lambda f: f["confidence"] >= high)))


def fields_long(extracted: DataFrame, *keys: str) -> DataFrame:
    """One row a field, with its rank."""
    return extracted.select(*keys, "document_type", F.posexplode("fields").alias("rank", "f")).select(*keys, "document_type", "rank", "f.*")


def get_field(name: str) -> Column:
    """The value of a field of an extracted row, or null."""
    return F.get(F.filter("fields", lambda f: f["field_type"] == name), F.lit(0))["value"]


def metadata_frame(spark, profile: str = "standard") -> DataFrame:
    return spark.createDataFrame([(f.name, f.title, f.title_en, f.category) for f in catalog.PROFILES[profile]], "field_type string, display_name string, display_name_en string, category string")


def value_boxes(extracted: DataFrame) -> Column:
    """The box of each field by text: the first line text that holds the value or lies in it.

    Lines of equal stripped text count once, where the first stands, with the last one's box.
    """

    def boxes(texts: Column, back: Column) -> Column:
        hit = lambda value: F.get(F.filter(texts, lambda t: F.contains(t, value) | F.contains(value, t)), F.lit(0))
        last = lambda text: F.get("lines", (F.size(texts) - F.array_position(back, text)).cast("int"))
        box = lambda f: let(hit(f["value"]), lambda text: let(last(text), lambda own: F.struct(f["field_type"].alias("field_type"), *[own[k].alias(k) for k in "xywh"])))
        return F.transform("fields", box)

    # Bound once a document: a line is stripped once, not for each field, line and side of a box anew.
    return let(F.transform("lines", lambda x: strip(x["text"])), lambda texts: let(F.reverse(texts), lambda back: boxes(texts, back)))

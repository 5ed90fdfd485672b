"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the top bits of the hash pick a bin and each
bin keeps its least hash.  Empty bins borrow from others by optimal
densification: bin b tries other bins in an order drawn from a hash of (b,
attempt), the same for every document, until it finds a filled one.  The low
bits of each bin's value are kept, and likeness is the share of equal bins,
corrected for the chance that low bits agree.

Defined results: a null or blank text has no shingles and the fingerprint "";
it is like another blank text (1.0) and unlike any other text (0.0).  A text of
fewer words than a shingle is one shingle.  Equal texts have equal
fingerprints; a repeated doc_id gives as many rows.  An empty table gives no
rows; extra columns are ignored; very long texts are read whole.  Only Spark
expressions run here.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import let, words

BINS = 256
BITS = 8
SHINGLE = 5
#: Random attempts of a bin before it takes the filled bin of the least hash.
ATTEMPTS = 16


def shingle_hashes(word_list: Column, n: int = SHINGLE) -> Column:
    """Sorted 64-bit hashes of all n-word shingles."""
    starts = F.when(F.size(word_list) > 0, F.sequence(F.lit(0), F.greatest(F.size(word_list) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(n)])))


def _signature(text: Column) -> Column:
    """One low byte a bin, or an empty array for a blank text.

    ``let`` binds each step once; a column named inside a lambda would be
    worked out again for every element.
    """
    bin_of = lambda h: F.shiftright(h, 56).cast("int") + F.lit(BINS // 2)

    def firsts(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))

    def slots(least: Column) -> Column:
        none = F.lit(None).cast("long")
        gap = lambda h, i: bin_of(h) - F.when(i == 0, 0).otherwise(bin_of(F.get(least, i - 1)) + 1)
        filled = F.flatten(F.transform(least, lambda h, i: F.concat(F.array_repeat(none, gap(h, i)), F.array(h))))
        return F.concat(filled, F.array_repeat(none, F.lit(BINS - 1) - bin_of(F.element_at(least, -1))))

    def dense(least: Column, slot: Column) -> Column:
        last = lambda b: F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("o"), h.alias("h"))))["h"]
        tried = lambda b: [F.get(slot, F.xxhash64(b, F.lit(a)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for a in range(ATTEMPTS)]
        full = F.transform(slot, lambda h, b: F.coalesce(h, *tried(b), last(b)))
        return F.transform(full, lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1)) - F.lit(1 << (BITS - 1))).cast("tinyint"))

    def signed(least: Column) -> Column:
        return F.when(F.size(least) > 0, let(slots(least), lambda slot: dense(least, slot))).otherwise(F.array().cast("array<tinyint>"))

    return let(words(text), lambda w: let(shingle_hashes(w), lambda h: let(firsts(h), signed)))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, _signature(F.col(text)))


def packed(signature: Column) -> Column:
    """The signature as lower-case hex digits."""
    return F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v.cast("int") + F.lit(1 << (BITS - 1))), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two signatures, corrected for chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    share = (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance)
    both_blank = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_blank, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )


def ranged(df: DataFrame, order: str, tie: str) -> DataFrame:
    """Deal rows to ranges of about equal size, one a partition.

    Rows follow each other in descending order, in a ring.  The first row of
    each range is copied, as a ghost, to the end of the range before it, so no
    range needs another's rows.  Ties are ordered by the hash of a column; a
    null comes last.  A key that fills several ranges is dealt by that hash, so
    only rows equal in both stay together.  The driver sees one key a range.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_k", F.coalesce(F.col(order), F.lit(-(2**63)))).withColumn("_t", F.xxhash64(tie))
    cuts = df.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    often = {c: n for c, n in Counter(cuts if parts > 1 else []).items() if n > 1}
    bounds = sorted({*(cuts if parts > 1 else []), *(c + 1 for c in often)})
    most = max(often.values(), default=1)
    share = F.create_map(*[F.lit(x) for c, n in often.items() for x in (c, n)]) if often else None
    inside = F.floor((F.col("_t") / F.lit(2.0**64) + 0.5) * F.coalesce(F.try_element_at(share, F.col("_k")), F.lit(1))).cast("int") if often else F.lit(0)
    df = df.withColumn("_r", _bucket(F.col("_k"), bounds) * most + F.least(inside, F.lit(most - 1)))
    tops = sorted(((r["_r"], r["m"]["_k"], r["m"]["_t"]) for r in df.groupBy("_r").agg(F.max(F.struct("_k", "_t")).alias("m")).collect()))
    ranges = [t[0] for t in tops]
    ghosts = spark.createDataFrame([(k, t, ranges[(i + 1) % len(ranges)]) for i, (_, k, t) in enumerate(tops)], "_k long, _t long, _g int")
    own, copy = F.struct(F.col("_r").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_g").alias("r"), F.lit(1).alias("g"))
    both = df.join(F.broadcast(ghosts), ["_k", "_t"], "left").withColumn("_c", F.explode(F.when(F.col("_g").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    both = both.withColumn("_r", F.col("_c.r")).withColumn("_ghost", F.col("_c.g")).drop("_c", "_g")
    return both.repartitionByRange(max(1, len(ranges)), "_r")


def followed(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column> of each row that ranged() has dealt; no shuffle, as a range is in one partition."""
    ring = Window.partitionBy("_r").orderBy(F.col("_ghost"), F.col("_k").desc(), F.col("_t").desc())
    return dealt.select("*", *[F.lead(c).over(ring).alias(f"next_{c}") for c in columns]).filter("_ghost = 0").drop("_r", "_ghost", "_k", "_t")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edit, whose last third comes from the next.

    Keeps doc_id; a repeated doc_id gives as many rows.  One document is its
    own next.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ringed = followed(with_signature(ranged(base, "doc_id", "text"), "text", "sig"), ["text", "sig"])
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    edited = ringed.withColumn("n_chars", n).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - tail), F.substr("next_text", F.lit(1), tail))).drop("text", "next_text")
    edited = with_signature(edited, "edited", "edited_sig")
    return edited.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )

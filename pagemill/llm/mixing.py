"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the wanted total by weight, at most ``cap``
times its size; what is cut off is shared again by weight until no source is
above.  Every document first gets the whole copies that target / size holds;
what is left is filled by order sampling: with U uniform from a hash of doc_id
and p the wanted inclusion probability, documents are ranked by
(U / (1 - U)) / (p / (1 - p)) and taken from the least while the middle of the
next one is below the words still wanted.

p is min(1, c w), w a document's weight and c such that the words expected are
those wanted.  Unless given, w is size ** -1/4, so that a few long documents do
not make up a source's sample.  Weights are rounded to 16 steps an octave, which
makes c a matter of one row a step; one of null or below 2 ** -50 counts as
that.

Source weights go round the sources in code point order, null last.  A null or
blank text has size 0 and is never counted.  A document without an id draws by
its text.  Repeated rows of one doc_id and text share one draw, and are taken
together.  Reruns agree: there is no other randomness.  An empty table gives no
rows; extra columns are ignored by ``mix`` and kept by ``mixed_documents``.

Only Spark expressions run here; rows of a source are never gathered, only sums
for each of 4,096 rank buckets, and the rows of the one bucket that the cut
falls in: about one in 4,096, as the cut lies near rank 1/2, where at most an
even share of the ranks does.  One row a source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import lookup_join, materialise, shielded

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


#: Steps of a weight's octave, and the least step.
STEPS, LEAST = 16, -800


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, u in (0, 1), step of the weight and a tie-breaking hash."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.hex(F.xxhash64("text"))))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        u.alias("u"),
        F.xxhash64("text").alias("tie"),
        *([] if weight is None else [weight.cast("double").alias("weight")]),
    )
    octaves = F.log2("size") * -0.25 if weight is None else F.log2("weight")
    step = F.greatest(F.coalesce(F.round(octaves * STEPS), F.lit(float(LEAST))), F.lit(float(LEAST))).cast("int")
    return rows.withColumn("step", step).drop("weight")


def _weight(step: Column) -> Column:
    return F.pow(F.lit(2.0), step / float(STEPS))


def targets(narrow: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target, whole copies, words wanted beyond them and scale, one row a source."""
    steps = materialise(narrow.groupBy("source", "step").agg(F.sum("size").alias("n")), "mix-steps")
    by = steps.groupBy("source").agg(F.sum("n").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    turn = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(turn) - 1) % len(weights)))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    rising = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    by = by.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    by = by.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    by = by.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = by.withColumn("whole", F.floor(copies)).withColumn("wanted", F.col("target") - F.floor(copies) * F.col("source_size"))
    # Steps above some are certain; the first that is not, with those below it, gives the scale.
    own = steps.withColumnRenamed("source", "_s").join(F.broadcast(by.select("source", "wanted")), F.col("_s").eqNullSafe(F.col("source"))).filter("n > 0")
    falling = Window.partitionBy("source").orderBy(F.col("step").desc())
    above = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("n") * _weight(F.col("step"))).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = own.withColumn("c", (F.col("wanted") - above) / mass)
    scale = own.filter(F.col("c") * _weight(F.col("step")) <= 1).groupBy("source").agg(F.max("c").alias("scale"))
    joined = by.join(F.broadcast(scale.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select("source", "source_size", "target", "whole", "wanted", F.coalesce("scale", F.lit(0.0)).alias("scale"))


def _ranked(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """The Pareto rank z in (0, 1) of the fractional copy."""
    rows = lookup_join(rows, per_source, "source")
    p = F.col("scale") * _weight(F.col("step"))
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    q = (F.col("u") / (1.0 - F.col("u"))) / (p / (1.0 - p))
    return rows.withColumn("z", q / (1.0 + q))


def _cuts(ranked: DataFrame) -> DataFrame:
    """The greatest (z, tie) that each source takes; no row if it takes none."""
    bucketed = ranked.filter((F.col("size") > 0) & (F.col("wanted") > 0)).withColumn("b", F.floor(F.col("z") * BUCKETS))
    sums = bucketed.groupBy("source", "b").agg(F.sum("size").alias("n"), F.first("wanted").alias("wanted"))
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    edge = materialise(sums.filter((F.col("before") < F.col("wanted"))).groupBy("source").agg(F.max_by(F.struct("b", "before"), "b").alias("e")).select("source", F.col("e.b").alias("edge"), F.col("e.before").alias("before")), "mix-edge")
    close = lookup_join(bucketed, edge, "source")
    close = close.filter(F.col("b") == F.col("edge"))
    order = Window.partitionBy("source").orderBy("z", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    close = close.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    taken = close.filter(F.col("ahead") + F.col("size") / 2 < F.col("wanted"))
    last = taken.groupBy("source").agg(F.max(F.struct("z", "doc_id", "tie")).alias("cut"))
    joined = edge.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select("source", (F.col("edge") / BUCKETS).alias("floor"), "cut")


def decide(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The ranked rows, narrow, and the cut of each source."""
    narrow = materialise(sized(docs, weight), "mix-sizes")
    per_source = materialise(targets(narrow, weights, share, cap), "mix-targets")
    ranked = _ranked(narrow, per_source)
    cuts = materialise(_cuts(ranked), "mix-cuts")
    return lookup_join(ranked, cuts, "source"), per_source


def taken_copies() -> Column:
    """Copies of a row that decide() has ranked."""
    at = F.struct("z", "doc_id", "tie")
    inside = (F.col("z") < F.col("floor")) | F.coalesce(at <= F.col("cut"), F.lit(False))
    extra = F.when((F.col("size") > 0) & (F.col("wanted") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return (F.col("whole") + extra).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted)."""
    rows, _ = decide(docs, **options)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * taken_copies()).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    docs, back = shielded(docs, "doc_id", "text", "source")
    rows, _ = decide(docs, **options)
    kept = rows.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tie").alias("_tie"), F.when(F.col("size") > 0, taken_copies()).otherwise(F.lit(0)).alias("_copies")).filter("_copies > 0").distinct()
    keyed = docs.withColumn("_t", F.xxhash64("text"))
    both = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_id"]) & keyed["source"].eqNullSafe(kept["_source"]) & (keyed["_t"] == kept["_tie"]))
    return back(both.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))


_SIZED_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM s),
r AS (SELECT *, source_size * 2e0 AS most, source_size * 2e0 / w AS ratio FROM w),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - coalesce(sum(most) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
         / sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (SELECT source, source_size, least(most, coalesce((SELECT max(level) FROM l WHERE level <= ratio) * w, most)) AS target FROM l),
h AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS wanted
  FROM t),
e AS (SELECT *, CASE WHEN size > 0 THEN greatest(-800, CAST(round(log2(size) * -4e0) AS INT)) ELSE -800 END AS step FROM d),
g AS (SELECT source, step, pow(2e0, step / 16e0) AS weight, sum(size) AS n FROM e WHERE size > 0 GROUP BY source, step),
k AS (
  SELECT g.source, weight,
         (wanted - coalesce(sum(n) OVER (PARTITION BY g.source ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(n * weight) OVER (PARTITION BY g.source ORDER BY step DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source),
m AS (SELECT source, max(c) AS scale FROM k WHERE c * weight <= 1 GROUP BY source),
p AS (
  SELECT e.doc_id, e.size, e.u, h.source, h.source_size, h.target, h.whole, h.wanted,
         least(greatest(coalesce(m.scale, 0e0) * pow(2e0, e.step / 16e0), 1e-15), 1e0 - 1e-15) AS p
  FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source LEFT JOIN m ON e.source IS NOT DISTINCT FROM m.source),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM p)
"""

ORACLE = (
    _SIZED_SQL
    + """
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND ahead + size / 2e0 < wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
)

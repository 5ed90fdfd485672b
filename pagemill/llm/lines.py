"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words (case folded, white space apart).
Equal lines are one line from the start.  A line of ``MIN_WORDS`` words or more
is also a copy of a line within one word edit (insertion, deletion or
substitution): every line emits the hash of itself and of itself without each
one word; lines that share a hash are one edit apart exactly if one is whole,
or both lack the word at the same place.  So for each hash and place the
earliest line is enough, no pairs are made, and what is found is verified on
the words.

A copy is dropped if it, or a line within one edit of it, stands earlier (by
doc_id, null last, then text hash, then line number), kept or not.  Blank lines
are kept.  Lines that cannot have a partner are left out first, without loss:
two lines within one edit agree on their first or last 2**(e-1) words, where
2**e is at most the length of the shorter.

A variant's hash is the exclusive or of its words' hashes by place, so all
variants of a line take one pass.  Keys that many lines share (a template's
variant, a common line) are counted first and dealt over tasks.

A null or empty text is one blank line.  Repeated rows of one doc_id and text
are one document; an empty table gives no rows; extra columns are kept by
``deduplicate`` and otherwise ignored.  Only Spark expressions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import counted_join, discard, let, materialise, shielded, words

MIN_WORDS = 8
LAST = 2**63 - 1


def _line_words(line: Column) -> Column:
    """Lower-cased words; a line with plain spaces alone needs no pattern."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    return F.when(odd, words(F.lower(line))).otherwise(F.array_remove(F.split(F.lower(line), " "), ""))


def _halves(w: Column) -> Column:
    """Hashes of the first and the last 2**(e-1) words, and of the class below at a power of two."""
    n = F.size(w)
    e = F.floor(F.log2(n.cast("double") + 0.5)).cast("int")
    of = lambda k: [
        F.xxhash64(k, F.lit(0), F.slice(w, F.lit(1), F.shiftright(F.pow(F.lit(2), k).cast("int"), 1))),
        F.xxhash64(k, F.lit(1), F.slice(w, n - F.shiftright(F.pow(F.lit(2), k).cast("int"), 1) + 1, F.shiftright(F.pow(F.lit(2), k).cast("int"), 1))),
    ]
    both = F.concat(F.array(*of(e)), F.when(n == F.pow(F.lit(2), e).cast("int"), F.array(*of(e - 1))).otherwise(F.array().cast("array<bigint>")))
    return F.when(n >= MIN_WORDS, both).otherwise(F.array().cast("array<bigint>"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Each line: doc_id, k, tie, no, its hash in two parts, n words, and half hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("k"), F.xxhash64(text).alias("tie"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    info = let(_line_words(F.col("line")), lambda w: F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2"), F.size(w).alias("n"), _halves(w).alias("halves")))
    return rows.withColumn("i", info).select("doc_id", "k", "tie", "no", "i.*")


def _within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart."""
    n, m = F.size(a), F.size(b)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")

    def rest(q: Column) -> Column:
        tail = lambda w, at: F.slice(w, at, F.greatest(F.size(w) - at + 1, F.lit(0)))
        return (
            F.when(q == 0, True)
            .when(n == m, tail(a, q + 1) == tail(b, q + 1))
            .when(n == m + 1, tail(a, q + 1) == tail(b, q))
            .when(n + 1 == m, tail(a, q) == tail(b, q + 1))
            .otherwise(False)
        )

    return let(differ, rest)


def _variants(w: Column) -> Column:
    """struct(whole, without): the hash of an array of words, and of it without each one word."""
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("a"), none.alias("b"), F.lit(0).alias("i"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, word: Column) -> Column:
        # Words before the gap keep their place; those after it move up by one.
        moved = s["b"].bitwiseXOR(F.xxhash64(word, s["i"] - 1))
        return F.struct(s["a"].bitwiseXOR(F.xxhash64(word, s["i"])).alias("a"), moved.alias("b"), (s["i"] + 1).alias("i"), F.array_append(s["out"], s["a"].bitwiseXOR(moved)).alias("out"))

    done = lambda s: F.struct(s["a"].alias("whole"), F.transform(s["out"], lambda x: x.bitwiseXOR(s["b"])).alias("without"))
    return F.aggregate(w, start, step, done)


def near_lines(docs: DataFrame, lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """h1, h2 and witness of each line within one edit of an earlier one.

    repeated: k, tie and rows of documents that docs has more than once.
    """
    filed = lines.filter(F.col("n") >= MIN_WORDS).select("h1", "h2", F.posexplode("halves").alias("i", "half"))
    shared = materialise(filed.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1"), "line-halves")
    # Where the first words agree the edit is after them; where the last do, before.
    some = counted_join(filed, shared, ["half"], "c").groupBy("h1", "h2").agg(F.max(F.col("i") % 2 == 0).alias("start"), F.max(F.col("i") % 2 == 1).alias("end"))
    wanted = lines.join(some, ["h1", "h2"]).select("h1", "h2", "first.*", "start", "end")
    by_doc = wanted.groupBy("k", "tie").agg(F.collect_list(F.struct("no", "h1", "h2", "start", "end")).alias("wanted"))
    by_doc = materialise(by_doc.join(repeated, ["k", "tie"], "left").withColumn("rows", F.coalesce("rows", F.lit(1))), "line-wanted")
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    found = counted_join(own, by_doc, ["k", "tie"], "rows").withColumn("w", F.explode("wanted")).select("k", "tie", "w.*", _line_words(F.get(F.split("text", "\n"), F.col("w.no"))).alias("words"))
    texts = materialise(found.select("h1", "h2", F.struct("k", "tie", "no").alias("first"), "start", "end", "words").dropDuplicates(["h1", "h2"]), "line-words")
    discard(by_doc)
    n = F.size("words")
    same = F.shiftright(F.pow(F.lit(2.0), F.floor(F.log2(n - 0.5))).cast("int"), 1)
    place = lambda i: (F.col("start") & (i > same)) | (F.col("end") & (i <= n - same))
    without = lambda v: F.filter(F.transform(v["without"], lambda h, i: F.struct(h.alias("key"), (i + 1).alias("at"))), lambda x: place(x["at"]))
    every = let(_variants(F.col("words")), lambda v: F.concat(F.array(F.struct(v["whole"].alias("key"), F.lit(0).alias("at"))), without(v)))
    variants = materialise(texts.select("h1", "h2", F.explode(every).alias("v")).select("h1", "h2", "v.*"), "line-variants")
    several = variants.groupBy("key").agg(F.count("*").alias("c"), F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("x"), F.max("h2").alias("y"))
    several = materialise(several.filter("a <> b or x <> y").select("key", "c"), "line-several")
    joined = materialise(counted_join(variants, several, ["key"], "c").join(texts.select("h1", "h2", "first"), ["h1", "h2"]), "line-shared")
    discard(variants)
    firsts = joined.groupBy("key", "at").agg(F.count("*").alias("c"), F.min("first").alias("same"))
    firsts = materialise(firsts, "line-firsts")
    sides = firsts.groupBy("key").agg(F.sum("c").alias("c"), F.min(F.when(F.col("at") == 0, F.col("same"))).alias("w"), F.min(F.when(F.col("at") > 0, F.col("same"))).alias("d"))
    sides = materialise(sides, "line-sides")
    both = counted_join(counted_join(joined, firsts, ["key", "at"], "c"), sides, ["key"], "c")
    earlier = F.least(F.when(F.col("at") > 0, F.col("same")), F.when(F.col("at") > 0, F.col("w")).otherwise(F.col("d")))
    witness = both.withColumn("witness", earlier).filter(F.col("witness") < F.col("first")).groupBy("h1", "h2").agg(F.min("witness").alias("witness"))
    a = materialise(witness, "line-witness")
    asked = materialise(a.groupBy("witness").agg(F.count("*").alias("c")), "line-asked")
    b = asked.join(texts.select(F.col("first").alias("witness"), F.col("words").alias("other")), "witness")
    mine = a.join(texts.select("h1", "h2", "words"), ["h1", "h2"])
    return counted_join(mine, b, ["witness"], "c").filter(_within_one(F.col("words"), F.col("other"))).select("h1", "h2", "witness")


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, tie, rows, n_lines, n_kept and the numbers of dropped lines, from 0."""
    occ = materialise(occurrences(docs), "line-occurrences")
    place = F.struct("k", "tie", "no")
    lines = occ.filter("n > 0").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.count("*").alias("c"))
    lines = materialise(lines, "lines")
    repeated = materialise(occ.filter("no = 0").groupBy("k", "tie").agg(F.count("*").alias("rows")).filter("rows > 1"), "line-repeated")
    near = near_lines(docs, lines, repeated).select("h1", "h2", F.lit(True).alias("near"))
    info = lines.join(near, ["h1", "h2"], "left").filter("near or first <> last").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), "c")
    told = counted_join(occ.withColumn("halves", F.lit(None)), materialise(info, "line-info"), ["h1", "h2"], "c", "left")
    dropped = (F.col("n") > 0) & F.coalesce(F.col("near") | (F.col("first") != place), F.lit(False))
    return (
        told.select("doc_id", "tie", "no", dropped.alias("gone"))
        .groupBy("doc_id", "tie")
        .agg(F.max("no").alias("last"), F.count(F.when(F.col("no") == 0, 1)).alias("rows"), F.collect_set(F.when(F.col("gone"), F.col("no"))).alias("dropped"))
        .select("doc_id", "tie", "rows", (F.col("last") + 1).cast("long").alias("n_lines"), (F.col("last") + 1 - F.size("dropped")).cast("long").alias("n_kept"), F.sort_array("dropped").alias("dropped"))
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped, the line numbers joined by commas."""
    return decide(docs).select("doc_id", "n_lines", "n_kept", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, all columns kept."""
    docs, back = shielded(docs, "doc_id", "text")
    keyed = docs.withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = materialise(decide(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("tie").alias("_tie"), "rows", F.col("dropped").alias("_gone")), "line-told")
    keyed = keyed.withColumn("_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("_none", F.col("doc_id").isNull())
    both = counted_join(keyed, told, ["_id", "_none", "_tie"], "rows", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return back(both.withColumn("text", kept))


#: For doc_ids that do not repeat.
ORACLE = rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
o AS (
  SELECT doc_id, no, coalesce(doc_id, {LAST}) AS p, list_filter(string_split_regex(lower(l[no + 1]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS no FROM t) x),
u AS (SELECT w, min((p, no)) AS first FROM o WHERE len(w) > 0 GROUP BY w),
v AS (
  SELECT w, first, 0 AS place, hash(array_to_string(w, ' ')) AS k FROM u WHERE len(w) >= {MIN_WORDS}
  UNION ALL
  SELECT w, first, i, hash(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) FROM (SELECT w, first, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= {MIN_WORDS}) x),
m AS (SELECT k, place, min(first) AS same FROM v GROUP BY k, place),
s AS (SELECT k, min(same) FILTER (place = 0) AS whole, min(same) FILTER (place > 0) AS lacking FROM m GROUP BY k),
g AS (
  SELECT DISTINCT v.w FROM v JOIN m ON m.k = v.k AND m.place = v.place JOIN s ON s.k = v.k
  WHERE v.place > 0 AND m.same < v.first OR CASE WHEN v.place > 0 THEN s.whole ELSE s.lacking END < v.first)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT gone) AS n_kept, coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (gone), '') AS dropped
FROM (SELECT o.doc_id, o.no, len(o.w) > 0 AND (g.w IS NOT NULL OR u.first <> (o.p, o.no)) AS gone FROM o LEFT JOIN u ON u.w = o.w LEFT JOIN g ON g.w = o.w) x
GROUP BY doc_id
"""

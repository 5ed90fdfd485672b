"""Chat formatting with Spark expressions only.

Turns of a conversation are collected and sorted (ties by role, then text),
adjacent turns of one role are merged into one block, and blocks are joined:

    ### role: text</part>text</turn>\\n

A backslash escapes: \\\\ for itself, <\\/ for </, #\\# for ##, and \\: for a
colon in a role.  No escaped text can hold a mark, so the original turns are
read back exactly.  The loss mask is a list of code point spans of the
formatted text: each assistant text, without marks.

A null text is empty; a null role is empty; a null turn comes first; rows of a
null conv_id are one conversation; repeated rows are turns of their own; an
empty table gives no rows; extra columns are ignored.  A conversation is one
string, so its turns meet in one task by definition; the work is nearly linear
in them (see ``_ends``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import let

END, PART = "</turn>\n", "</part>"
TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</"), F.lit("<\\/"))
    return F.replace(text, F.lit("##"), F.lit("#\\#"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as struct(role, texts)."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    return let(
        starts,
        lambda at: F.transform(
            at,
            lambda s, k: F.struct(
                F.get(turns, s - 1)["role"].alias("role"),
                F.transform(F.slice(turns, s, F.coalesce(F.get(at, k + 1), F.size(turns) + 1) - s), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )


def _pieces(blocks: Column) -> Column:
    """Marks and escaped texts in order, with whether each is under the loss."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))

    def of(block: Column) -> Column:
        inner = F.flatten(
            F.transform(
                block["texts"],
                lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(PART)), F.lit(False)), piece(escape(t), block["role"] == "assistant")),
            )
        )
        return F.concat(F.array(piece(_header(block["role"]), F.lit(False))), inner, F.array(piece(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(blocks, lambda b: of(b)))


#: Numbers that are summed up in one array before it is joined to others.
CHUNK = 512


def _running(numbers: Column) -> Column:
    """Running sums; each step copies the array so far."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(numbers, none, lambda s, x: F.struct((s["n"] + x).alias("n"), F.array_append(s["out"], s["n"] + x).alias("out")), lambda s: s["out"])


def _ends(numbers: Column) -> Column:
    """Running sums of a long array: of each chunk, moved by the sum of those before it."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int")), lambda k: F.slice(numbers, k * CHUNK + 1, F.lit(CHUNK)))
    return let(
        chunks,
        lambda own: let(
            _running(F.transform(own, total)),
            lambda upto: F.flatten(F.transform(own, lambda c, k: let(F.coalesce(F.get(upto, k - 1), F.lit(0).cast("long")), lambda base: F.transform(_running(c), lambda x: x + base)))),
        ),
    )


def _spans(pieces: Column) -> Column:
    """struct(start, length) of each piece under the loss; start counts from 1."""
    sizes = F.transform(pieces, lambda p: F.char_length(p["s"]).cast("long"))
    spans = lambda n, ends: F.transform(pieces, lambda p, i: F.when(p["loss"], F.struct((F.get(ends, i) - F.get(n, i) + 1).alias("start"), F.get(n, i).alias("length"))))
    return let(sizes, lambda n: let(_ends(n), lambda ends: F.filter(spans(n, ends), lambda x: x.isNotNull())))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans, one row a conversation."""
    blank = F.lit("")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")))).alias("turns"))
    both = let(_blocks(F.col("turns")), lambda b: let(_pieces(b), lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), _spans(p).alias("loss_spans"))))
    return turns.select("conv_id", both.alias("f")).select("conv_id", "f.formatted", "f.loss_spans")


def parse(formatted: Column) -> Column:
    """The turns as array<struct<role, text>>, read back from the format."""

    def of(block: Column) -> Column:
        header = F.regexp_extract(block, r"(?s)^### ((?:[^\\:]|\\.)*): ", 0)
        role = unescape(F.substr(header, F.lit(5), F.char_length(header) - 6))
        body = F.substr(block, F.char_length(header) + 1)
        return let(role, lambda r: F.transform(F.split(body, PART), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    blocks = F.split(formatted, END)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: of(b)))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what the formatted texts and their masks hold."""
    turns = parse(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    return formatted.select(
        "conv_id",
        let(
            turns,
            lambda t: F.struct(
                F.size(t).cast("long").alias("n_turns"),
                F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            ),
        ).alias("t"),
        let(loss, lambda x: F.struct(F.char_length(x).cast("long").alias("loss_chars"), F.sha2(x.cast("binary"), 256).alias("loss_sha256"))).alias("l"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "t.*", "l.*", "formatted_chars")


#: A conversation whose texts hold the template's own control strings.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

ORACLE = r"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '</', '<\/'), '##', '#\#')) AS n,
         length(replace(replace(replace(replace(role, '\', '\\'), '</', '<\/'), '##', '#\#'), ':', '\:')) AS r,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS head
  FROM a)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN head THEN r + 6 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""

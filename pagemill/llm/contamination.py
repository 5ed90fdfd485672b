"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: a shard holds the postings of the documents
that bring it to ``SHARD_WORDS`` words, as sorted terms, their offsets and
their positions (delta-coded, compressed), so no term's list is ever gathered
from everywhere and a common word costs no more than its share.  Benchmark
terms are looked up in each shard; windows that miss a term are gone at once,
the rest start from the postings of their rarest term and are intersected with
the offset-adjusted lists of the others, from rare to common.  The same lists
answer proximity searches: all terms within a span, in any order.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  A window is ``WINDOW`` consecutive words of an item; a shorter
item that has words is one window.  A document word inside any occurrence of a
window is hit.

A null or blank text has no words; an item with a null id is hit like any other
but not counted or named; equal items are each counted; item ids are of any
type and compared as strings, doc_ids are integers.  A repeated document gives
repeated rows; an empty table gives no rows, an empty benchmark no hits; a very
long text is one document of one shard; extra columns are ignored, or kept by
``clean_documents``.  The benchmark is a stated query set: it is taken in blocks
of ``BLOCK`` windows, one broadcast at a time, and hits of several blocks are
joined per document.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, materialise, share, shared_value, shielded, ship

WINDOW = 10
SHARD_WORDS = 1 << 18
#: Windows of one broadcast, at most about 100 MB with their terms.
BLOCK = 500_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _cut(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes of non-ASCII characters are never ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


INDEX_SCHEMA = "part long, shard long, n_words long, doc_ids binary, known binary, lengths binary, terms binary, ends binary, postings binary"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _indexer(gap: int, shard_words: int):
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "known", "lengths", "terms", "ends", "postings")]])

    def build(batches):
        part, shard = TaskContext.get().partitionId(), 0
        ids, lengths, numbers, n_words = [], [], [], 0
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__

        def flush():
            nonlocal shard, ids, lengths, numbers, n_words, vocabulary
            size = np.array(lengths, np.int64)
            starts = np.cumsum(size + gap) - (size + gap)
            word = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(word))
            terms = sorted(vocabulary)
            place = np.empty(len(terms), np.int32)
            place[np.fromiter((vocabulary[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms))
            rank = place[word]
            order = np.argsort(rank, kind="stable")
            ends = np.cumsum(np.bincount(rank, minlength=len(terms)))
            postings = at[order].astype(np.int32)
            delta = np.diff(postings, prepend=0).astype(np.int32)
            row = [part, shard, n_words, _packed(np.array([d or 0 for d in ids], np.int64)), _packed(np.array([d is not None for d in ids], np.uint8)), _packed(size.astype(np.int32)), zstandard.ZstdCompressor(level=1).compress(b" ".join(terms)), _packed(ends.astype(np.int32)), _packed(delta)]
            shard, ids, lengths, numbers, n_words = shard + 1, [], [], [], 0
            vocabulary = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _cut(text.as_py())
                ids.append(d)
                lengths.append(len(own))
                numbers.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
                n_words += len(own)
                if n_words >= shard_words or len(ids) >= 1 << 16:
                    yield flush()
        if ids:
            yield flush()

    return build


def build_index(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of docs, stored in the shared folder, one row a shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(lean(_indexer(window, shard_words)), INDEX_SCHEMA), "posting-index")


class Queries:
    """Windows as numbers of terms, padded with -1, and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        found: dict[tuple[int, ...], set[str]] = {}
        for item, own in items:
            numbers = [vocabulary[w] for w in own]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                named = found.setdefault(tuple(numbers[at : at + window]), set())
                if item is not None:
                    named.add(item)
        self.terms = list(vocabulary)
        self.items = list(found.values())
        self.windows = np.full((len(found), window), -1, np.int32)
        for i, w in enumerate(found):
            self.windows[i, : len(w)] = w
        self.lengths = (self.windows >= 0).sum(axis=1)


class Postings:
    """One shard's lists of the query's terms."""

    def __init__(self, row: dict, terms: list[bytes]):
        self.known = _unpacked(row["known"], np.uint8)
        self.doc_ids, self.lengths = _unpacked(row["doc_ids"], np.int64), _unpacked(row["lengths"], np.int32).astype(np.int64)
        own = zstandard.ZstdDecompressor().decompress(row["terms"]).split(b" ")
        place = dict(zip(own, range(len(own)), strict=True))
        self.slot = np.fromiter((place.get(t, -1) for t in terms), np.int64, len(terms))
        self.ends = _unpacked(row["ends"], np.int32).astype(np.int64)
        if not len(self.ends):
            self.slot[:] = -1
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.at = np.cumsum(_unpacked(row["postings"], np.int32), dtype=np.int64)
        # Lists one after the other, each moved past the one before: one sorted array.
        self.span = int(self.at.max()) + 2 if len(self.at) else 1
        sizes = self.ends - self.starts[: len(self.ends)]
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * self.span + self.at

    def frequency(self) -> np.ndarray:
        out = np.zeros(len(self.slot), np.int64)
        here = self.slot >= 0
        out[here] = self.ends[self.slot[here]] - self.starts[self.slot[here]]
        return out

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        ok = (at >= 0) & (at < self.span - 1)
        key = self.slot[term] * self.span + np.where(ok, at, 0)
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return ok & (self.keys[spot] == key)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of each term, and which of the terms each is of."""
        slot = self.slot[term]
        size = self.ends[slot] - self.starts[slot]
        owner = np.repeat(np.arange(len(term)), size)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return self.at[self.starts[slot][owner] + offset], owner


def _alive(postings: Postings, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Windows all of whose terms are here, and their offsets by rarity."""
    often = np.append(postings.frequency(), np.iinfo(np.int64).max)
    seen = often[q.windows]
    alive = np.flatnonzero((seen > 0).all(axis=1))
    return alive, np.argsort(seen[alive], axis=1, kind="stable")


def phrases(postings: Postings, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Start and window of every exact occurrence."""
    alive, order = _alive(postings, q)
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = order[:, 0]
    at, owner = postings.lists(q.windows[alive, first])
    start, window = at - first[owner], owner
    for k in range(1, q.windows.shape[1]):
        if not len(start):
            break
        offset = order[window, k]
        term = q.windows[alive[window], offset]
        ok = (term < 0) | postings.has(np.maximum(term, 0), start + offset)
        start, window = start[ok], window[ok]
    return start, alive[window]


def near(postings: Postings, q: Queries, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and window of every stretch of ``span`` words with all terms.

    A stretch starts at a term of the window; repeated terms count once.
    """
    alive, order = _alive(postings, q)
    starts, windows = [], []
    for i, w in enumerate(alive):
        terms = list(dict.fromkeys(int(q.windows[w, o]) for o in order[i] if q.windows[w, o] >= 0))
        rare = postings.lists(np.array(terms[:1]))[0]
        lists = [postings.lists(np.array([t]))[0] for t in terms]
        begin = np.unique(np.concatenate(lists))
        spot = np.searchsorted(rare, begin)
        begin = begin[(spot < len(rare)) & (rare[np.minimum(spot, len(rare) - 1)] < begin + span)]
        for own in lists:
            spot = np.searchsorted(own, begin)
            begin = begin[(spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] < begin + span)]
        starts.append(begin)
        windows.append(np.full(len(begin), w))
    return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


FOUND_SCHEMA = "part long, shard long, at long, doc_id long, n_words long, spans binary, items binary"


def _finder(shared, gap: int, span: int | None):
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.binary())])

    def find(batches):
        q = shared_value(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                p = Postings(row, q.terms)
                starts, windows = phrases(p, q) if span is None else near(p, q, span)
                begin = np.cumsum(p.lengths + gap) - (p.lengths + gap)
                doc = np.searchsorted(begin, starts, side="right") - 1
                spans, items = [b""] * len(begin), [b""] * len(begin)
                order = np.argsort(doc, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                    d = int(doc[own[0]])
                    size = q.lengths[windows[own]] if span is None else np.full(len(own), span)
                    spans[d] = np.stack([starts[own] - begin[d], np.minimum(starts[own] - begin[d] + size, p.lengths[d])], axis=1).astype(np.int64).tobytes()
                    items[d] = _named(set().union(*[q.items[w] for w in np.unique(windows[own])]))
                n = len(begin)
                ids = pa.array(p.doc_ids, pa.int64(), mask=p.known == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["shard"])), pa.array(np.arange(n)), ids, pa.array(p.lengths), pa.array(spans, pa.binary()), pa.array(items, pa.binary())], schema=schema)

    return find


def _named(names: set[str]) -> bytes:
    """Names in bytes that may follow others, each after its length."""
    return b"".join(struct.pack("<I", len(n)) + n for n in (x.encode() for x in sorted(names)))


def _names(data: bytes) -> set[str]:
    out, at = set(), 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at)[0]
        out.add(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        hits, counts, names = [], [], []
        for n, spans, items in zip(*[batch.column(c).to_pylist() for c in ("n_words", "spans", "items")], strict=True):
            if not spans:
                hits.append(0)
                counts.append(0)
                names.append(none)
                continue
            edges = np.frombuffer(spans, np.int64).reshape(-1, 2)
            step = np.bincount(edges[:, 0], minlength=n + 1) - np.bincount(edges[:, 1], minlength=n + 1)
            hits.append(int((np.cumsum(step)[:n] > 0).sum()))
            own = sorted(_names(items))
            counts.append(len(own))
            names.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], schema=schema)


def query_blocks(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK):
    """The benchmark's windows, a bounded block at a time."""
    own, size, any_block = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = _cut(r["text"])
        own.append((r["item_id"], words))
        size += max(0, len(words) - window + 1) or bool(words)
        if size >= block:
            yield Queries(own, window)
            own, size, any_block = [], 0, True
    if own or not any_block:
        yield Queries(own, window)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None, block: int = BLOCK) -> DataFrame:
    """Spans and items by document: exact phrases, or within ``span`` words."""
    spark, every, waiting = index.sparkSession, None, None

    def of(shared) -> DataFrame:
        return index.mapInArrow(lean(_finder(shared, window, span)), FOUND_SCHEMA)

    def written(shared) -> DataFrame:
        nonlocal every
        found = materialise(of(shared), "posting-hits")
        shared.destroy()
        return found if every is None else every.unionByName(found)

    for q in query_blocks(benchmark, window, block):
        every = written(waiting) if waiting is not None else every
        waiting = share(spark, q)
    if every is None:
        return of(waiting)
    every = written(waiting)
    joined = lambda c: F.unhex(F.array_join(F.transform(F.collect_list(c), F.hex), "")).alias(c)
    return every.groupBy("part", "shard", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), joined("spans"), joined("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row a document."""
    found = search(build_index(docs, window), benchmark, window, span, block)
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that no window of the benchmark occurs in.

    A doc_id whose rows have different texts is judged text by text.
    """
    docs, back = shielded(docs, "doc_id", "text")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    judged = contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark)
    hit = judged.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return back(keyed.join(hit, "_key", "left_anti"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[j:j + {WINDOW - 1}], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS j FROM b WHERE len(w) > 0) x),
s AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d JOIN (SELECT DISTINCT n FROM q) z ON len(w) >= n),
f AS (SELECT s.r, s.j, s.n, q.item_id FROM s JOIN q ON q.n = s.n AND q.k = array_to_string(s.w[s.j:s.j + s.n - 1], ' ')),
h AS (SELECT r, count(DISTINCT at_word) AS n FROM (SELECT r, unnest(range(j, j + n)) AS at_word FROM f) x GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM f WHERE item_id IS NOT NULL) x GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN i ON i.r = d.r
"""


ship(__name__)

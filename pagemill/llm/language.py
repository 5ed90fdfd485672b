"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text.  A text
is parsed from left to right into the longest phrases that the automaton
accepts; the language that needs the fewest phrases, each weighed by the
log of its sample's length, wins.  Ties go to the first language by code point.

Texts are lower-cased and each run of non-letters is one space, then read as
UTF-8 bytes, so any script works.  Long texts are cut into pieces that are parsed
side by side; each piece is then taken up again in the state that the piece
before it ends in, until both parses meet, so the phrases are those of the whole
text.

The model is fitted on a bounded sample, ``DOCS`` documents a language by the
hash of doc_id and text, each taken whole.  Its table takes about 300 bytes for
each byte of the sample.  There is one automaton a language: a column of more
than ``MOST_LANGS`` different labels is refused.

Every document is predicted over its whole text.  A null text, or one without a
letter, is ``und`` with score 0; so is every text if no label is known.
Repeated rows are predicted each, and learned once; an empty table gives no
rows; extra columns are ignored, or kept as they are by ``keep_identified``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, share, shared_value, ship

DOCS = 16
MOST_LANGS = 1000
PIECE = 2048
UNKNOWN = "und"
GAPS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """The text as it is parsed; empty if it has no letter."""
    plain = GAPS.sub(" ", (text or "").lower()).strip()
    return f" {plain} ".encode("utf-8", "replace") if any(map(str.isalpha, plain)) else b""


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of data, state 0 the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in data:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            to = go[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(go)
                go.append(dict(go[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and go[at].get(c) == to:
                    go[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return go


class Model:
    """All automata as one table of 2 * next row + (a phrase ends here)."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples, key=lambda s: [ord(c) for c in s])
        used = sorted({c for s in samples.values() for c in s})
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        rows, self.roots, base = [], [], 0
        for lang in self.langs:
            go = automaton(samples[lang])
            start = np.full(width, base * width, np.int64)
            for c, to in go[0].items():
                start[self.classes[c]] = (base + to) * width
            table = np.tile(start * 2 + 1, (len(go), 1))
            # From the start, and after an unseen byte, which is a phrase alone, every byte begins a phrase.
            for s, out in enumerate(go[1:], 1):
                for c, to in out.items():
                    table[s, self.classes[c]] = (base + to) * width * 2
            rows.append(table)
            self.roots.append(base * width)
            base += len(go)
        self.table = np.concatenate(rows).ravel().astype(np.int32) if rows else np.zeros(0, np.int32)
        self.weights = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, texts: list[bytes], size: int = PIECE) -> np.ndarray:
        """Phrases of each text by each language."""
        pieces = [(i, a, t[a : a + size]) for i, t in enumerate(texts) for a in range(0, len(t), size)]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not pieces or not self.langs:
            return out
        pieces.sort(key=lambda p: -len(p[2]))
        lengths = np.array([len(p[2]) for p in pieces])
        flat = self.classes[np.frombuffer(b"".join(p[2].ljust(lengths[0]) for p in pieces), np.uint8)].reshape(len(pieces), -1).T
        flat = np.ascontiguousarray(flat)
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(pieces), axis=1)
        count = np.zeros((len(self.langs), len(pieces)), np.int32)
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for t in range(lengths[0]):
            n = live[t]
            step = self.table.take(state[:, :n] + flat[t, :n].astype(np.int32))
            count[:, :n] += step & 1
            state[:, :n] = step >> 1
        place = {p[:2]: k for k, p in enumerate(pieces)}
        before = np.array([place.get((i, a - size), -1) for i, a, _ in pieces])
        self._join(flat, lengths, before, state, count)
        owner = np.array([p[0] for p in pieces])
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, count[k], len(texts))
        return out

    def _join(self, flat, lengths, before, state, count) -> None:
        """Mend counts and last states of pieces that do not start a text.

        Each is parsed from the last state of the piece before it, beside the
        parse from the root, until both are in one state.  Where they do not
        meet, the last state changes, and the piece after is taken up again.
        """
        roots = np.array(self.roots, np.int32)
        entered = np.repeat(roots[:, None], len(before), axis=1)
        todo = np.repeat((before >= 0)[None, :], len(roots), axis=0)
        after = np.full(len(before), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        while todo.any():
            lang, piece = np.nonzero(todo)
            old, new = entered[lang, piece], state[lang, before[piece]]
            entered[lang, piece] = new
            todo[:] = False
            t, differ = 0, old != new
            lang, piece, old, new = lang[differ], piece[differ], old[differ], new[differ]
            while len(piece):
                own = flat[t, piece].astype(np.int32)
                a, b = self.table.take(old + own), self.table.take(new + own)
                np.add.at(count, (lang, piece), (b & 1) - (a & 1))
                old, new, t = a >> 1, b >> 1, t + 1
                done = lengths[piece] == t
                if done.any():
                    last = done & (old != new)
                    state[lang[last], piece[last]] = new[last]
                    again = after[piece[last]]
                    todo[lang[last][again >= 0], again[again >= 0]] = True
                go = ~done & (old != new)
                lang, piece, old, new = lang[go], piece[go], old[go], new[go]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; a score is the winner's share of exp(-bits / 16)."""
        data = [normal(t) for t in texts]
        bits = self.phrases(data) * self.weights
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        share = np.exp(-(bits - bits.min(axis=1, keepdims=True)) / 16)
        score = 1 / share.sum(axis=1)
        known = [bool(d) for d in data]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], np.where(known, score, 0.0)


def fit(rows: DataFrame, docs: int = DOCS) -> Model:
    """Fit on rows of doc_id, text and lang; null langs and texts are left out."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return Model({})
    # About eight times the rows wanted, equal rows once; the first of them are taken.
    limits = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 8 * docs / n) * (1 << 62)))])
    near = rows.filter(F.col("draw") < F.element_at(limits, F.col("lang"))).select("lang", "draw").distinct()
    draws: dict[str, list[int]] = {}
    for r in near.collect():
        draws.setdefault(r["lang"], []).append(r["draw"])
    wanted = [d for own in draws.values() for d in sorted(own)[:docs]]
    samples = dict.fromkeys(sizes, b"")
    for r in sorted(rows.filter(F.col("draw").isin(wanted)).dropDuplicates(["lang", "draw"]).collect(), key=lambda r: r["draw"]):
        samples[r["lang"]] += normal(r["text"])
    return Model({k: s for k, s in samples.items() if s})


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def _predictor(shared, text_at: int, keep: int):
    def predict(batches):
        model = shared_value(shared)
        for batch in batches:
            column = batch.column(text_at)
            langs, scores, at = [], [np.zeros(0)], 0
            while at < len(column):
                texts, chars = [], 0
                while at < len(column) and (not texts or chars < 1 << 21):
                    texts.append(column[at].as_py())
                    chars += len(texts[-1] or "")
                    at += 1
                own, score = model.predict(texts)
                langs += own
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))],
                names=[*batch.schema.names[:keep], "lang_pred", "score"],
            )

    return predict


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of keep as _0, _1, ..., and lang_pred and score; only text is looked at."""
    shared = share(docs.sparkSession, model)
    columns = list(keep) if "text" in keep else [*keep, "text"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    kinds = "".join(f"{c} {t}, " for c, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(lean(_predictor(shared, columns.index("text"), len(keep))), f"{kinds}lang_pred string, score double")


def learned(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rest."""
    out = predict(docs, learned(docs), "doc_id").withColumnRenamed("_0", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is not unknown."""
    out = predict(docs, learned(docs), *docs.columns).filter(F.col("lang_pred") != UNKNOWN)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


ship(__name__)

"""Toxicity by a linear classifier over scaled character n-grams.

Features are the 4- and 5-byte grams of the text (lower-cased, runs of
non-letters one space), present or not, hashed to 2**21 buckets; none is left
out.  Each is scaled by its naive Bayes log-count ratio

    r = log((p + a) / |p|) - log((q + a) / |q|)

p and q being the numbers of toxic and other training texts that have it, |p|
and |q| those of all toxic and other texts plus 2 a.  A text's scaled features
are divided by their length, and a logistic regression with an L2 penalty is
fitted by dual coordinate descent.  Its margins on texts left out, in ``FOLDS``
folds, give the slope and offset that turn margins into probabilities.

The model is fitted on a bounded sample of labelled rows, about ``ROWS`` a
label by hash of doc_id, each taken whole (at most 2**21 buckets a row).  Of a
repeated doc_id the text of least hash is learned from; of conflicting labels
the greater.  Every document is scored over its whole text, repeated rows each;
an empty table gives no rows; extra columns are ignored.  A null text is empty;
an empty text gets the score of no features.  Without labels of both kinds,
every score is the only label, or 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, share, shared_value, ship
from pagemill.llm.language import held_out

ROWS = 2000
#: Smoothing of counts, cost of a training error, passes over the sample.
ALPHA, COST, PASSES = 1.0, 10.0, 5
FOLDS = 3
BUCKETS = 21
LENGTHS = (4, 5)
GAPS = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """The buckets of all grams of a text, repeats included."""
    data = np.frombuffer(f" {GAPS.sub(' ', (text or '').lower()).strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = [np.zeros(0, np.uint32)]
    for n in LENGTHS:
        h = np.full(max(0, len(data) - n + 1), n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= data[k : k + len(h)]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - BUCKETS)
        out.append(h)
    return np.concatenate(out).astype(np.int32)


def bag(text: str | None) -> np.ndarray:
    """The distinct buckets of a text."""
    return np.unique(grams(text))


def _bags(batches):
    for batch in batches:
        own = [bag(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([b.tobytes() for b in own], pa.binary())], names=["toxic", "bag"])


class Model:
    """A weight and a squared ratio by bucket, and the log-odds without features."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, bias: float):
        self.table, self.bias = np.stack([weights, squares], axis=1).astype(np.float32), bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), float(self.bias))
        last = np.zeros(1 << BUCKETS, np.int32)
        for i, text in enumerate(texts):
            h = grams(text)
            # Each bucket once: the place that was written last.
            at = np.arange(len(h), dtype=np.int32)
            last[h] = at
            weight, square = self.table[h[last[h] == at]].sum(axis=0, dtype=np.float64)
            total[i] += weight / np.sqrt(square) if square > 0 else 0.0
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def ratios(bags: list[np.ndarray], labels: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Log-count ratios by bucket; 0 where no text has one."""
    count = lambda k: sum((np.bincount(b, minlength=1 << BUCKETS) for b, y in zip(bags, labels, strict=True) if y == k), np.zeros(1 << BUCKETS))
    p, q = count(1), count(0)
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    out = np.log((p + alpha) / (n1 + 2 * alpha)) - np.log((q + alpha) / (n0 + 2 * alpha))
    out[p + q == 0] = 0
    return out.astype(np.float32)


def descend(bags: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights of scaled features and the bias of the penalised logistic regression.

    Each step finds one text's dual variable z in (0, cost) exactly, by halving:
    the zero of size * (z - old) + margin + log(z / (cost - z)).
    """
    w, bias = np.zeros(1 << BUCKETS), 0.0
    unit = [x / max(float(np.sqrt(x @ x)), 1e-9) for x in (ratio[b].astype(np.float64) for b in bags)]
    unit = [x.astype(np.float32) for x in unit]
    sign, dual = np.where(labels == 1, 1.0, -1.0).tolist(), [0.0] * len(bags)
    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(bags)).tolist():
            b, x, y, old = bags[i], unit[i], sign[i], dual[i]
            margin = y * (float(w[b] @ x) + bias)
            size, low, high = 1.0 + float(x @ x), 0.0, cost
            for _ in range(40):
                z = (low + high) / 2
                if size * (z - old) + margin + math.log(z / (cost - z)) > 0:
                    high = z
                else:
                    low = z
            z = (low + high) / 2
            w[b] += (z - old) * y * x
            bias += (z - old) * y
            dual[i] = z
    return w, bias


def margins(bags: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(bags), bias)
    for i, b in enumerate(bags):
        x = ratio[b].astype(np.float64)
        size = float(x @ x)
        out[i] += float(w[b] @ x) / math.sqrt(size) if size > 0 else 0.0
    return out


def calibrate(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton's steps."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        miss, bend = weight * (p - labels), weight * p * (1 - p)
        cross = (bend * margin).sum()
        hessian = np.array([[(bend * margin**2).sum() + 1e-3, cross], [cross, bend.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(miss * margin).sum() + 1e-3 * (slope - 1), miss.sum()])
        step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        slope, offset = slope - step[0], offset - step[1]
    return float(slope), float(offset)


def train(bags: list[np.ndarray], labels: np.ndarray, prior: float | None = None) -> Model:
    """Fit ratios, the regression, and the curve from margins to probabilities.

    prior is the share of toxic texts among all that are labelled.
    """
    none = np.zeros(1 << BUCKETS, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model(none, none, 30.0 if share else -30.0)
    fold = np.empty(len(labels), np.int64)
    for k in (0, 1):
        own = np.flatnonzero(labels == k)
        fold[own] = np.arange(len(own)) % FOLDS
    left_out, asked = np.zeros(len(labels)), np.zeros(len(labels), bool)
    for f in range(FOLDS):
        learn, ask = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if 0 < labels[learn].mean() < 1:
            some = [bags[i] for i in learn]
            ratio = ratios(some, labels[learn])
            left_out[ask] = margins([bags[i] for i in ask], ratio, *descend(some, labels[learn], ratio))
            asked[ask] = True
    ratio = ratios(bags, labels)
    w, bias = descend(bags, labels, ratio)
    prior = share if prior is None else prior
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    slope, offset = calibrate(left_out[asked], labels[asked], weight[asked]) if 0 < (labels[asked].mean() if asked.any() else 0) < 1 else (1.0, 0.0)
    return Model(slope * w * ratio, ratio**2, slope * bias + offset)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents; labels: doc_id, toxic 0 or 1, nulls left out."""
    labels = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    limit = F.lit(0)
    for k, n in sizes.items():
        limit = F.when(F.col("toxic") == k, F.lit(int(min(1.0, ROWS / n) * (1 << 30)))).otherwise(limit)
    taken = labels.filter(draw < limit)
    # About 2 * ROWS rows by the draw above, one text each.
    rows = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("t")).join(F.broadcast(taken), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).select("toxic", "t.text")
    found = rows.mapInArrow(lean(_bags), "toxic int, bag binary").collect()
    found.sort(key=lambda r: (r["toxic"], bytes(r["bag"])))
    return train([np.frombuffer(r["bag"], np.int32) for r in found], np.array([r["toxic"] for r in found]), sizes.get(1, 0) / max(1, sum(sizes.values())))


def _scorer(shared):
    def score(batches):
        model = shared_value(shared)
        for batch in batches:
            out = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score; only text is looked at."""
    shared = share(docs.sparkSession, model)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(_scorer(shared)), f"doc_id {kind}, score double")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, learned from the rest."""
    learned = fit(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic"))
    out = score(docs, learned)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship(__name__)

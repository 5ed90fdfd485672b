"""SimHash near-duplicates by the general pigeonhole principle.

A text's fingerprint has a bit set where over half the 64-bit hashes of its
4-word shingles have it set.  Fingerprints at most ``radius`` bits apart are
linked, and the linked ones form components.

Search: bits that go together over all fingerprints are grouped into m
partitions; thresholds t_1..t_m (-1: not searched) that sum to radius - m + 1
are chosen by dynamic programming on the estimated work of probing and
verifying; m itself is the cheapest of 2 to 5.  Two fingerprints within the
radius differ in at most t_i bits of some partition i, so they agree on one of
its values with t_i bits masked.  Each fingerprint is filed once under each
such value; those filed together are verified.  Of what is verified only a
spanning forest is kept, never all pairs of a group.  The members of a group
above ``BLOCK`` are filed anew, by the same principle, under their key and each
of radius + 1 parts of its free bits, until no group is too large; no task holds
more than a block and a batch, or compares more than a block.

Exact copies are one fingerprint from the start.  A null or blank text has the
fingerprint zero and is linked like any other.  Ties: a component is named by
its least doc_id (null only if all are null).  Repeated rows give repeated
rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, lean, lookup_join, materialise, shielded, ship

SHINGLE = 4
SEED = 42
#: Members of a group that are compared in one piece.
BLOCK = 4096
#: Work of filing one key and of verifying one pair, in the same unit.
FILE_COST, VERIFY_COST = 1.0, 0.05


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0] + [e + 1 for e in ends[: max(0, len(words) - n)]]
    cuts = map(slice, starts, ends[n - 1 :] or ends[-1:])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        found = np.fromiter((fingerprint(x) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep and fp, the fingerprint as a signed long."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, "text").mapInArrow(lean(_fingerprints), f"{kinds}, fp long")


def _bit_counts(batches):
    both = np.zeros((64, 64))
    for batch in batches:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += bits.T @ bits
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel())], names=["i", "j", "n"])


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits how many have both."""
    both = np.zeros((64, 64))
    for r in nodes.select("fp").mapInArrow(_bit_counts, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    return nodes.count(), both


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about 64 / parts bits; a bit joins the one it goes with most."""
    p = both.diagonal() / max(total, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    link = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        room = 64 // parts + (k < 64 % parts)
        seed = max(sorted(left), key=lambda b: link[b, sorted(left)].sum())
        own = [seed]
        left.discard(seed)
        while len(own) < room:
            best = max(sorted(left), key=lambda b: link[b, own].sum())
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def allocate(total: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, the cheapest by estimate."""
    from math import comb

    p = both.diagonal() / max(total, 1)
    agree = p**2 + (1 - p) ** 2
    best, cheapest = [], float("inf")
    for m in range(2, 6):
        groups = group_bits(total, both, m)
        want = radius - m + 1
        if want < -m:
            continue
        # States: thresholds so far -> (cost, choice).
        states = {0: (0.0, ())}
        for bits in groups:
            near = np.zeros(len(bits) + 1)
            near[0] = 1.0
            for b in bits:  # the distribution of differing bits of two fingerprints
                near[1:] = near[1:] * agree[b] + near[:-1] * (1 - agree[b])
                near[0] *= agree[b]
            costs = {-1: 0.0} | {t: total * comb(len(bits), t) * FILE_COST + total**2 / 2 * near[: t + 1].sum() * VERIFY_COST * (1 if t == 0 else len(bits) / 4) for t in range(min(radius, 3) + 1)}
            states = _least({s + t: (c + costs[t], (*choice, t)) for s, (c, choice) in [x] for t in costs} for x in states.items())
        if want in states and states[want][0] < cheapest:
            cheapest, choice = states[want]
            best = [(bits, t) for bits, t in zip(groups, choice, strict=True) if t >= 0]
    return best


def _least(tables) -> dict:
    out: dict = {}
    for table in tables:
        for s, x in table.items():
            if s not in out or x < out[s]:
                out[s] = x
    return out


def masks_of(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits that must agree, for each way to mask t bits of a partition."""
    from itertools import combinations

    out = []
    for bits, t in plan:
        whole = sum(1 << b for b in bits)
        out += [whole - sum(1 << b for b in gone) for gone in combinations(bits, t)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _forest(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Edges of a spanning forest of the linked members, breadth first."""
    left, edges = np.unique(fps), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[:256], front[256:]
            near = np.bitwise_count(at[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                parent = at[near[:, hit].argmax(axis=0)]
                edges.append(np.stack([parent, left[hit]]))
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return edges


def _verifier(radius: int, block: int, free: list[int]):
    """Verify rows pid, value, fp in runs of one key; free: the bits that a key of each pid leaves open."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])

    def rows(edges, hot=False):
        both = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.uint64).view(np.int64)), pa.array(both[1].astype(np.uint64).view(np.int64)), pa.array(np.full(both.shape[1], hot))], schema=schema)

    def star(fp):
        return np.stack([np.full(len(fp) - 1, fp[0]), fp[1:]])

    def runs(pid, value, fp):
        """Verify full runs of one key each."""
        new = np.ones(len(fp), bool)
        new[1:] = (pid[1:] != pid[:-1]) | (value[1:] != value[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        edges, hot = [], []
        short = np.repeat(size <= 8, size)
        run = np.cumsum(new)
        for gap in range(1, 8):
            if len(fp) <= gap:
                break
            ok = short[gap:] & (run[gap:] == run[:-gap])
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(fp[at] ^ fp[at + gap]) <= radius]
            edges.append(np.stack([fp[at], fp[at + gap]]))
        for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            if n <= block:
                edges += _forest(fp[s : s + n], radius)
            elif free[pid[s]] <= radius:
                edges.append(star(fp[s : s + n]))
            else:
                hot.append(np.array([[np.uint64(pid[s])], [value[s]]], np.uint64))
        return edges, hot

    def verify(batches):
        """A run may go over several batches; of one that is too large only its key goes on."""
        kept, gone = None, None
        for batch in batches:
            now = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            now = [now[0], now[1].view(np.uint64), now[2].view(np.uint64)]
            if gone is not None:
                new = (now[0] != gone[0]) | (now[1] != gone[1])
                first = int(new.argmax()) if new.any() else len(new)
                now = [x[first:] for x in now]
            if not len(now[0]):
                continue
            gone = None
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = [x[cut:].copy() for x in now]
            edges, hot = runs(*[x[:cut] for x in now])
            if len(kept[0]) > block and free[kept[0][0]] <= radius:
                edges.append(star(kept[2]))
                kept = [x[:1] for x in kept]
            elif len(kept[0]) > block:
                gone, kept = (kept[0][0], kept[1][0]), None
                hot.append(np.array([[np.uint64(gone[0])], [gone[1]]], np.uint64))
            yield rows(edges)
            yield rows(hot, True)
        if kept is not None:
            edges, hot = runs(*kept)
            yield rows(edges)
            yield rows(hot, True)

    return verify


def finer(mask: int, parts: int) -> list[int]:
    """Masks with one of about equal parts of the free bits each, as signed longs."""
    free = [b for b in range(64) if not mask >> b & 1]
    out = [(mask & (2**64 - 1)) | sum(1 << b for b in free[i::parts]) for i in range(parts)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _filed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    ways = F.array(*[F.struct(F.lit(i).alias("pid"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(ways).alias("w")).select(F.col("w.pid").alias("pid"), F.col("fp").bitwiseAND(F.col("w.mask")).alias("value"), "fp")


def links(nodes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges a, b that join all fingerprints within the radius, directly or not."""
    total, both = bit_statistics(nodes)
    masks = masks_of(allocate(total, both, radius))
    filed, edges = _filed(nodes, masks), None
    while True:
        free = [64 - (m & (2**64 - 1)).bit_count() for m in masks]
        found = filed.repartition("pid", "value").sortWithinPartitions("pid", "value").mapInArrow(lean(_verifier(radius, block, free)), "a long, b long, hot boolean")
        found = materialise(found, "simhash-links")
        own = found.filter("not hot").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        hot = found.filter("hot").select(F.struct(F.col("a").cast("int").alias("pid"), F.col("b").alias("value")).alias("key"), F.lit(True).alias("hot"))
        pids = sorted(r["pid"] for r in hot.select("key.pid").distinct().collect())
        if not pids:
            return edges.distinct()
        # Two within the radius agree on one of radius + 1 parts of what their key leaves open.
        new = [(p, m) for p in pids for m in finer(masks[p], radius + 1)]
        members = lookup_join(filed.withColumn("key", F.struct("pid", "value")), hot, "key").filter("hot").select("pid", "fp")
        ways = F.create_map(*[x for p in pids for x in (F.lit(p), F.array(*[F.struct(F.lit(i).alias("pid"), F.lit(m).cast("long").alias("mask")) for i, (q, m) in enumerate(new) if q == p]))])
        members = members.select("fp", F.explode(F.element_at(ways, F.col("pid"))).alias("w"))
        filed = materialise(members.select("w.pid", F.col("fp").bitwiseAND(F.col("w.mask")).alias("value"), "fp"), "simhash-hot")
        masks = [m for _, m in new]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of an edge can reach.

    Alternates large-star and small-star; each round is written, the round
    before it deleted, until a round changes nothing.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        sign = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = new
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign


def _classes(docs: DataFrame, radius: int, keep: tuple[str, ...]) -> DataFrame:
    """keep, fp, component_id and root, the component's own name, one row a row of docs."""
    fps = materialise(fingerprints(docs, *keep), "simhash-fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = materialise(components(links(nodes, radius)), "simhash-roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id", "root")
    return fps.join(classes, "fp", "left").select(*keep, "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id, one row a row of docs."""
    return _classes(docs, radius, ("doc_id",)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of each component: the one of the least doc_id, then text hash."""
    docs, back = shielded(docs, "doc_id", "text")
    tagged = docs.withColumn("_tie", F.xxhash64("text"))
    found = materialise(_classes(tagged, radius, ("doc_id", "_tie")), "simhash-classes")
    kept = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), F.col("_tie"), F.col("doc_id"))).alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m._tie").alias("_t"), F.lit(True).alias("_kept")).distinct()
    same = tagged["doc_id"].eqNullSafe(kept["_id"]) & (tagged["_tie"] == kept["_t"])
    rows = tagged.join(kept, same, "left_semi")
    repeated = rows.groupBy("doc_id", "_tie").count().filter("count > 1").isEmpty()
    return back(rows if repeated else rows.dropDuplicates(["doc_id", "_tie"]))


ship(__name__)

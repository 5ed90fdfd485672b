"""SimHash, decontamination and line dedup against brute force."""

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import contamination, lines, simhash


def test_fingerprint_is_the_contract():
    text = "One two\tTHREE four  five"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 2)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b é') x").first().x & (2**64 - 1)
    assert got == xxhash.xxh64_intdigest("a b é".encode(), 42)


def brute_components(rows, radius=4):
    rows = [(i, simhash.fingerprint(t)) for i, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
                    label[b] = label[a] = min(label[a], label[b])
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(k))) for (i, f), k in zip(rows, label, strict=True))


def test_near_duplicates(nasty, empty):
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(nasty).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in nasty.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_blocks_of_hot_groups_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(2**62))
    fps = [base] + [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (60, 2))] + [int(x) for x in rng.integers(2**62, size=100)]
    nodes = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    stars = lambda block: {(r.node, r.root) for r in simhash.components(simhash.links(nodes, 4, block)).collect()}
    small, large = stars(7), stars(4096)
    assert small == large and len({r for _, r in large}) == 1


def joined(edges):
    """The least member of each member's component."""
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def batches(pid, value, fp, size):
    import pyarrow as pa

    for at in range(0, len(fp), size):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + size]) for x in (pid, value, fp)], names=["pid", "value", "fp"])


def test_a_hot_run_is_not_held():
    """Of ten blocks of one key only the key goes on, in the memory of a block."""
    import tracemalloc

    n = 10 * simhash.BLOCK
    fp = np.arange(n + 2, dtype=np.int64) << 20
    pid, value = np.zeros(n + 2, np.int32), np.r_[np.full(n, 7), [8, 8]].astype(np.int64)
    fp[-1] = fp[-2] ^ 1
    verify = simhash._verifier(4, simhash.BLOCK, [48])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    got = [tuple(r.values()) for b in verify(batches(pid, value, fp, 500)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert got == [(0, 7, True), (int(fp[-2]), int(fp[-1]), False)]
    assert peak < 8 * simhash.BLOCK * 20


def test_chains_hold_over_finer_keys(spark):
    """Chains of fingerprints 4 bits apart in groups that are filed anew, some more than once."""
    rng = np.random.default_rng(6)
    chains = [[((1 << 4 * i) - 1) ^ (c << 40) for i in range(9)] for c in (0, 0xFFFFF)]
    noise = [int(x) & 0xFFFFFF | 0x1F << 58 for x in rng.integers(0, 1 << 24, 100)]
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in sum(chains, []) + noise})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = joined([(a, b) for i, a in enumerate(fps) for b in fps[i:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    for block in (12,):
        edges = [(r.a, r.b) for r in simhash.links(nodes, 4, block).collect()]
        got = joined(edges) | {f: f for f in fps if not any(f in e for e in edges)}
        assert got == want


def test_finer_masks_cover_what_is_free():
    for mask in (0, 0xFFFF, -1 << 20, (1 << 63) - 1 - 31):
        finer = [m & (2**64 - 1) for m in simhash.finer(mask, 5)]
        assert all(m & mask & (2**64 - 1) == mask & (2**64 - 1) for m in finer)
        union = 0
        for m in finer:
            union |= m
        assert union == 2**64 - 1


def test_thresholds_follow_the_pigeonhole(spark):
    bits = np.eye(64) * 500 + 250
    for total in (10**4, 10**7, 10**9):
        plan = simhash.allocate(total, bits * total / 1000, 4)
        assert all(t >= 0 for _, t in plan)
        parts = {2: 3, 3: 2, 4: 1, 5: 0}
        assert any(sum(t for _, t in plan) - (m - len(plan)) == s for m, s in parts.items() if m >= len(plan))


def test_one_of_each(nasty):
    kept = simhash.one_of_each(nasty)
    assert kept.columns == nasty.columns
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in nasty.collect()])}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def bench(spark, nasty):
    texts = [r.text for r in nasty.orderBy("doc_id").collect() if r.text]
    items = [(1, texts[3]), (2, "w1"), (3, None), (4, "..."), (10, texts[9].upper()), (11, texts[9]), (12, "not there"), (13, "ünder é"), (14, " ".join(texts[20].split()[-12:]))]
    return spark.createDataFrame(items, "item_id long, text string"), items


def test_contamination(spark, nasty, empty):
    frame, items = bench(spark, nasty)
    want = brute_hits([(r.doc_id, r.text) for r in nasty.collect()], items)
    for block in (contamination.BLOCK, 3):
        got = contamination.contamination(nasty, frame, block=block).collect()
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == want
    assert contamination.contamination(empty, frame).count() == 0
    assert contamination.contamination(nasty, frame.limit(0)).filter("contaminated").count() == 0
    clean = contamination.clean_documents(nasty, frame)
    assert clean.columns == nasty.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "red x y z a b green blue"), (3, "blue green red")], "doc_id long, text string")
    query = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    found = contamination.search(contamination.build_index(docs), query, span=5)
    assert sorted(r.doc_id for r in found.collect() if r["items"]) == [1, 3]


def brute_lines(rows):
    order = sorted({(2**63 if i is None else i, t or "", i) for i, t in rows}, key=lambda r: r[0])
    occ, first = [], {}
    for k, t, i in order:
        for no, line in enumerate(t.split("\n")):
            w = tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line.lower()) if x)
            occ.append((k, i, no, w))
            if w:
                first.setdefault(w, (k, no))

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    long = [w for w in first if len(w) >= lines.MIN_WORDS]
    near = {a for a in long if any(first[b] < first[a] and one(a, b) for b in long)}
    out = {}
    for k, i, no, w in occ:
        n, gone = out.setdefault(str(i), [0, []])
        out[str(i)][0] += 1
        if w and (first[w] != (k, no) or w in near):
            gone.append(no)
    return {i: (n, n - len(g), ",".join(map(str, g))) for i, (n, g) in out.items()}


def test_line_report(spark, nasty, empty):
    a = "one two three four five six seven eight nine"
    extra = [(900, a + "\n" + a), (901, a.upper() + " ten\n\nshort"), (902, a.replace("five", "5") + "\nshort"), (903, a.replace("one ", "")), (904, "one five " + a)]
    docs = nasty.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {str(r.doc_id): (r.n_lines, r.n_kept, r.dropped) for r in lines.line_report(docs).collect()}
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert lines.line_report(empty).count() == 0


def test_lines_of_hot_keys(spark, monkeypatch):
    """One template, one common line and one repeated document, dealt over several tasks."""
    from pagemill.llm import common

    template = "page {} of the long report on all of it and more"
    rows = [(i, template.format(f"x{i}") + "\nthe very common line of all the documents here") for i in range(40)]
    rows += [(99, "repeated text of some eight words or a few more")] * 30 + [(100 + i, f"same same same same same same same same w{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for most, broadcast in ((4000, 100_000), (3, 100_000), (3, 1)):
        monkeypatch.setattr(common, "MOST", most)
        monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
        got = {str(r.doc_id): (r.n_lines, r.n_kept, r.dropped) for r in lines.line_report(docs).collect()}
        assert got == want
    kept = lines.deduplicate(docs)
    assert kept.count() == len(rows) and kept.filter("doc_id = 7").first().text == ""


def test_a_long_line_takes_seconds(spark):
    import time

    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9000] + ["other"] + words[9001:])), (3, " ".join(words[5:]))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n_kept for r in lines.line_report(docs).collect()}
    assert got == {1: 1, 2: 0, 3: 1} and time.time() - began < 60


def test_deduplicated_texts(spark):
    docs = spark.createDataFrame([(1, "a\nb\na", "k"), (2, "b\nc", "l"), (3, None, "m")], "doc_id long, text string, _tie string")
    got = {r.doc_id: (r.text, r._tie) for r in lines.deduplicate(docs).collect()}
    assert got == {1: ("a\nb", "k"), 2: ("c", "l"), 3: (None, "m")}


def test_items_without_an_id_are_hit_but_not_named(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c d e"), (3, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (7, "d e"), (None, "d e"), (None, None)], "item_id long, text string").coalesce(1)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    named = spark.createDataFrame([("a,b", "b c"), ("é", "c d")], "item_id string, text string")
    assert {r.doc_id: r.items_sha256 for r in contamination.contamination(docs, named).collect()}[1] == sha("a,b,é".encode())
    for block in (contamination.BLOCK, 1):
        got = sorted(map(tuple, contamination.contamination(docs, items, block=block).collect()))
        assert got == [(1, 4, 2, 0, sha(b""), True), (2, 3, 2, 1, sha(b"7"), True), (3, 2, 0, 0, sha(b""), False)]


def test_one_of_each_without_ids(spark):
    """Near copies with no doc_id are one component; others stay apart."""
    text = " ".join(f"w{i}" for i in range(400))
    near = text + " w1"
    assert 0 < (simhash.fingerprint(text) ^ simhash.fingerprint(near)).bit_count() <= 4
    docs = spark.createDataFrame([(None, text), (None, near), (None, "something else"), (3, "with an id")], "doc_id long, text string").coalesce(1)
    kept = {r.text for r in simhash.one_of_each(docs).collect()}
    assert len(kept) == 3 and len(kept & {text, near}) == 1

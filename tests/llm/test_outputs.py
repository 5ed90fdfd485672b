"""Token shards, chat format, mixing, fingerprints and URL filters."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, fingerprints, mixing, tokens, urls

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_encode_as_whole_texts():
    rng = random.Random(3)
    parts = list("ab Cé1.,!'’  \n\t\r\x0b\x0c\x85\x1c中文٣²_") + ["\u3000", "\u200b", "\u2028", "'s", " '", "n't", "<|endoftext|>", "  ", "\n\n", " \n", "\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    want = [e.ids + [2] for e in tokens.tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [list(map(int, x)) for x in tokens.encode_texts(texts, PATH, 2)] == want


def own_words():
    """No words remembered from other tests."""
    cache = tokens.worker_cache()
    for key in [k for k in cache if isinstance(k, tuple)]:
        del cache[key]


def test_words_in_use_are_asked_of_the_model_once(monkeypatch):
    own_words()
    made, asked = tokens._Words.made, []
    monkeypatch.setattr(tokens._Words, "made", lambda self, word: asked.append(word) or made(self, word))
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(k, k + 1000)) for k in range(0, 350_000, 1000)]
    for _ in range(2):
        for k in range(0, len(texts), 50):
            tokens.encode_texts(texts[k : k + 50], PATH, 2)
    assert len(asked) == len(set(asked)) >= 350_000
    own_words()


def test_texts_cut_together_encode_as_whole_texts(monkeypatch):
    own_words()
    rng = random.Random(5)
    parts = ["a", "b", "Cé", "1", "²", "½", ".", "!", "'", "’", "×", "÷", "€", " ", "\xa0", "\n", "\t", "\r", "\x0b", "\x0c", "'s", "'S", "'ll", "'ve", "'re", "'r", "'t", "'m", "'d", "l", "e", "s", "ª", "ɏ", "_", "—", "\n\n", " \n", "\n ", "\x7f", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    want = [e.ids + [7] for e in tokens.tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.encode_texts(texts, PATH, 7)] == want
    monkeypatch.setattr(tokens, "CACHE", 40)  # forgets much of the time
    got = [x.tolist() for k in range(0, len(texts), 10) for x in tokens.encode_texts(texts[k : k + 10], PATH, 7)]
    words = tokens.worker_cache()["words", PATH, 7]
    assert got == want and all(map(words.plain, texts)) and len(words.known) <= 40
    own_words()


@pytest.mark.parametrize("n,symbols", [(0, 1), (1, 1), (511, 2), (512, 3), (5000, 700)])
def test_wavelet_answers(n, symbols):
    ids = np.random.default_rng(n).integers(0, symbols, n).astype(np.uint16) * 7
    shard = tokens.Shard.from_bytes(tokens.Shard.build([None], [ids]).to_bytes())
    assert shard.doc_ids == [None] and (shard.ids() == ids).all()
    for at in sorted({0, n // 2, n - 1} & set(range(n))):
        v = int(ids[at])
        assert shard.access(at) == v
        assert shard.occurrences(v) == np.flatnonzero(ids == v).tolist()
        assert shard.count(v, at // 2, at) == int((ids[at // 2 : at] == v).sum())
    assert shard.count(3) == 0 and shard.occurrences(60_001) == []
    with pytest.raises(ValueError):
        tokens.Shard.from_bytes(b"short")


def test_shards_round_trip(nasty, empty):
    got = tokens.token_digests(nasty, PATH, shard_tokens=500).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in nasty.collect()), key=lambda r: r[:2])
    at, want = 0, []
    for _, d, t in rows:
        ids = tokens.tokenizer(PATH).encode(t, add_special_tokens=False).ids + [2]
        want.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == want
    assert tokens.token_digests(empty, PATH).count() == 0


def test_chat_reads_back_what_was_said(spark):
    rng = random.Random(9)
    marks = ["\\", "</turn>", "</part>", "### user: ", "##", "#", "<", "/", ":", "\n", "x", "é", None]
    rows = []
    for c in [1, 2, None]:
        for t in range(30):
            text = None if rng.random() < 0.1 else "".join(m or "" for m in rng.choices(marks, k=8))
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "a:b\\", None]), text, "extra"))
    frame = spark.createDataFrame(rows + [(5, None, "user", "first", ""), (5, 0, "user", "second", "")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    for c in [1, 2, None]:
        own = [(r or "", x or "") for k, _, r, x, _ in rows if k == c]
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == 30
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[5].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\nsecond\n").hexdigest()
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_repeated_turns_and_a_long_conversation(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, i, "assistant" if i % 2 else "user", f"t{i} ##") for i in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\na\n" * 3).hexdigest()
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert got[2].n_turns == 5000 and got[2].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    spans = formatted.filter("conv_id = 2").first()
    assert all(spans.formatted[s.start - 1 :].startswith(f"t{2 * i + 1} #") for i, s in enumerate(spans.loss_spans))


def test_adjacent_turns_are_one_block(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(frame).first()
    assert r.formatted == "### user: a</part>b</turn>\n### assistant: c</turn>\n"
    assert [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans] == ["c"]


def reshared(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 30))), rng.choice("aaaaabbcdé") if i % 17 else None) for i in range(900)] + [(1000, None, "a"), (1001, " ", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, of = reshared(sizes, (3, 1, 2), 1.5, 2), {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and abs(r.target - want[of[r.doc_id]]) < 1e-6 and r.source_size == sizes[of[r.doc_id]]
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 30 for s in taken)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    copies = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken}
    assert mixing.mix(empty).count() == 0


def test_long_documents_are_taken_less_often(spark):
    """Inclusion frequencies by size are the wanted probabilities."""
    rows = [(i, "w " * (1, 16, 81, 256)[i % 4], "a") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, share=1.4).collect()
    total = sum(r.size for r in got)
    weight = {n: 2 ** (round(-4 * math.log2(n)) / 16) for n in (1, 16, 81, 256)}
    low, high = 0.0, 100.0
    for _ in range(100):
        c = (low + high) / 2
        low, high = (c, high) if sum(r.size * min(1, c * weight[r.size]) for r in got) < 0.4 * total else (low, c)
    for n, w in weight.items():
        own, p = [r for r in got if r.size == n], min(1, c * w)
        assert abs(sum(r.taken > n for r in own) / len(own) - p) < 4 * math.sqrt(p * (1 - p) / len(own)) + 2e-3, (n, p)
    assert abs(sum(r.taken for r in got) - 1.4 * total) <= 256


def test_weights_given_by_column(spark):
    rows = [(i, "w " * 10, "a", 8.0 if i % 2 else 1.0) for i in range(2000)] + [(5000, "w", "a", None), (5001, "w", "a", -1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, favour double")
    got = mixing.mix(docs, share=0.2, weight=F.col("favour")).collect()
    often = [sum(r.taken > 0 for r in got if r.doc_id % 2 == k and r.doc_id < 5000) for k in (0, 1)]
    assert 6 < often[1] / often[0] < 11 and abs(sum(r.taken for r in got) - 0.2 * 20_002) <= 10


def test_mix_of_repeated_rows_and_no_ids(spark):
    rows = [(None, f"word{i} " * (i % 7 + 1), "a") for i in range(400)] + [(3, "same text", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, share=0.5).collect()
    assert len(got) == len(rows)
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7


def test_mixed_documents_keep_columns(nasty):
    assert mixing.mixed_documents(nasty).columns == nasty.columns


def test_fingerprints(nasty, empty):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in nasty.dropDuplicates(["doc_id"]).collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(nasty.dropDuplicates(["doc_id"])).collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    errors = []
    for i, (known, d, text) in enumerate(rows):
        r, after = got[d if known else None], rows[(i + 1) % len(rows)][2]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, a, b in ((r.near_edited, text, edited), (r.near_next, text, after)):
            a, b = shingles(a), shingles(b)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.02
    assert got[5].fingerprint == got[60].fingerprint != got[6].fingerprint
    assert fingerprints.fingerprint_edits(empty).count() == 0


def brute_fingerprint(text):
    """Bins, borrowed bins and low bits one by one."""
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    bins = {}
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        b = (signed(h) >> 56) + 128
        bins[b] = min(bins.get(b, 1 << 63), signed(h))
    number = lambda n, seed: xxhash.xxh64_intdigest(struct.pack("<i", n), seed)
    out = []
    for b in range(256 if bins else 0):
        tried = [b] * (b in bins) + [t for t in (number(a, number(b, 42)) & 255 for a in range(fingerprints.ATTEMPTS)) if t in bins]
        chosen = tried[0] if tried else min(bins, key=lambda k: signed(number(k, number(b, 42))))
        out.append(f"{bins[chosen] & 255:02x}")
    return "".join(out)


def test_fingerprints_are_the_brute_ones(spark, nasty):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))) for i, n in enumerate((1, 2, 5, 6, 30, 300, 3000))]
    rows += [(7, "é ünder\tThe\x0bEND."), (8, None), (8, "twice"), (8, "twice"), (None, "none")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), brute_fingerprint(t)) for i, t in rows)
    for r in got:
        a, b = (bytes.fromhex(x) for x in (r.fingerprint, r.edited_fingerprint))
        if a and b:
            same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
            assert abs(r.near_edited - min(1, max(0, (same - 1 / 256) / (1 - 1 / 256)))) < 1e-12


def test_rows_of_one_id_are_dealt(spark):
    """Half of the rows have one id, as many none; each row still has its one next."""
    rows = [(7, f"t{i} " * 4) for i in range(120)] + [(None, f"n{i} " * 4) for i in range(60)] + [(100 + i, f"d{i} " * 4) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = fingerprints.ranged(docs, "doc_id", "text")
    assert max(r["count"] for r in dealt.filter("_ghost = 0").groupBy("_r").count().collect()) < 100
    ring = fingerprints.followed(dealt, ["text"]).collect()
    nexts = {r.text: r.next_text for r in ring}
    assert len(ring) == len(nexts) == len(rows)
    at, seen = rows[0][1], []
    for _ in rows:
        seen.append(at)
        at = nexts[at]
    assert at == rows[0][1] and sorted(seen) == sorted(t for _, t in rows)
    of = {t: -1 if i is None else i for i, t in rows}
    order = [of[t] for t in seen]
    assert sum(a < b for a, b in zip(order, order[1:] + order[:1])) == 1


def test_one_document_is_its_own_next(spark):
    r = fingerprints.fingerprint_edits(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_url_parts_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        (3, "ftp://xcom/", "xcom", "/", None, "allow"),
        (4, "http://a.com", "a.com", "", None, "allow"),
        (5, "x://b.net/fr/1://2?3", "b.net", "/fr/1://2", "net/fr/", "block"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme/com/", "", "", None, "allow"),
        (8, "http://?com/", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], None, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(pages).collect()}
    assert got == {r[0]: r[2:] for r in rows}
    assert urls.judge_pages(pages.limit(0)).count() == 0


def brute_walk(hosts, edges):
    """Scores by plain power steps: host -> (trust, distrust), and the number of hosts."""
    related = set()
    for h in set(hosts) | {b for _, b in edges}:
        labels = h.split(".")
        while len(labels) > 2 and len(h) <= 253 and not labels[-1].split(":")[0].isdigit():
            related.add((".".join(labels), ".".join(labels[1:])))
            labels = labels[1:]
    nodes = set(hosts) | {b for _, b in edges} | {p for _, p in related}
    out = {h: {} for h in nodes}, {h: {} for h in nodes}
    for way in (0, 1):
        linked, joined = ({h: {} for h in nodes} for _ in "ab")
        for e, n in edges.items():
            linked[e[way]][e[1 - way]] = n
        for a, b in related:
            joined[a][b] = joined[b][a] = 1
        for h in nodes:
            share = urls.STRUCTURE if linked[h] and joined[h] else 1.0
            for to, n in joined[h].items():
                out[way][h][to] = out[way][h].get(to, 0) + share * n / len(joined[h])
            for to, n in linked[h].items():
                out[way][h][to] = out[way][h].get(to, 0) + (1 - share if joined[h] else 1.0) * n / sum(linked[h].values())
    scores = []
    for way in (0, 1):
        total = sum(hosts[h][way] for h in hosts)
        now = {h: hosts[h][way] / total for h in hosts} if total else {}
        score = dict.fromkeys(nodes, 0.0)
        for _ in range(400):
            new = {}
            for h, m in now.items():
                score[h] += (1 - urls.DAMPING) * m
                for to, share in out[way][h].items():
                    new[to] = new.get(to, 0) + urls.DAMPING * m * share
            now = new
        scores.append(score)
    return {h: (scores[0][h], scores[1][h]) for h in nodes}, len(nodes)


def page(url, *hrefs):
    return url, "<p>" + "".join(f'<a href="{h}">.</a>' for h in hrefs)


def test_links_decide_where_no_rule_does(spark):
    rows = [
        page("http://good.com/", "http://friend.org/x", "//friend.org/y", "http://GOOD.com", "/own", "mailto:a@b.net"),
        page("http://friend.org/", "http://far.org/"),
        page("http://far.org/", "#top"),
        page("http://bad.net/es/"),
        page("http://feeder.org/", "http://bad.net/x"),
        page("http://sub.deep.bad.net/xx"),
        ("http://alone.org/", None),
        ("http://10.0.0.1/", "<a href=/x>"),
        page("http://" + "a." * 200 + "bad.net/"),
        ("http://feeder.org/" + "y" * 100_000, "<a class=b href='http://bad.net/z'>b</A>"),
    ]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(4, *rows[4])]
    got = urls.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    hosts = {h: [0, 0] for h in ("good.com", "friend.org", "far.org", "bad.net", "feeder.org", "sub.deep.bad.net", "alone.org", "10.0.0.1", "a." * 200 + "bad.net")}
    hosts["good.com"][0] = hosts["bad.net"][1] = 1
    edges = {("good.com", "friend.org"): 2, ("good.com", "good.com"): 2, ("friend.org", "far.org"): 1, ("far.org", "far.org"): 1, ("feeder.org", "bad.net"): 3, ("10.0.0.1", "10.0.0.1"): 1}
    want, n = brute_walk(hosts, edges)
    for r in got:
        trust, distrust = want[r.host]
        assert abs(r.host_trust - trust) < 2 * urls.TOLERANCE and abs(r.host_distrust - distrust) < 2 * urls.TOLERANCE, r.host
        assert r.verdict == ("allow" if r.rule == "com/" else "block" if r.rule or distrust - trust > urls.MARGIN / n else "allow"), r.host
    assert {r.host for r in got if r.verdict == "block"} == {"bad.net", "feeder.org"}
    assert all(r.host_distrust > 0 for r in got if r.host.endswith(".deep.bad.net"))


def test_hosts_without_a_rule_get_scores_on_the_supplied_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = urls.judge_pages(pages).collect()
    ruled = {r.host for r in got if r.rule}
    other = [r for r in got if r.host not in ruled and r.host.endswith(".net")]
    assert other and all(r.host_distrust > 0 for r in other)


def test_hubs_are_dealt_without_loss(spark, monkeypatch):
    rows = [(i, f"http://h{i % 40}.org/", '<a href="http://hub.net/">x</a>') for i in range(80)] + [(99, "http://hub.net/es/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, urls.judge_pages(pages).collect()))
    monkeypatch.setattr(urls, "HUB", 7)
    assert sorted(map(tuple, urls.judge_pages(pages).collect())) == whole


def test_links_without_a_scheme_count(spark):
    html = '<a href="//One.org/x">a</a> <A class=b href=\'http://two.org\'>b</A> <a href=//three.org>c</a> <a href="/path//four.org">d</a> <a href="five.org/x">e</a> <a href="javascript:go()">f</a><a href="">g</a>'
    found = urls.links(spark.createDataFrame([("own", html)], "host string, html string")).collect()
    assert {r.dst: r.n for r in found} == {"one.org": 1, "two.org": 1, "three.org": 1, "own": 3}

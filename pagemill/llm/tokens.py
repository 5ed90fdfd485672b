"""Token-ID output: one wavelet matrix file for each shard of documents.

Documents are ordered by doc_id (null first, ties by text hash), encoded with a
given public tokenizer, and each ends with an end id.  A shard closes at the
document that brings it to ``SHARD_TOKENS`` ids.  Its file holds the sorted
distinct ids, the documents' ids and lengths, and a wavelet matrix of the ids'
ranks: one packed bit-plane a level with a directory of ones before every 512
bits.  ``Shard`` gives access, rank, select, counting and occurrence lookup
from that file alone.

A null text is empty and has just the end id.  Repeated rows are encoded as
often as they occur; an empty table gives no file.  A special token's string
in a text is that token, as the tokenizer's default is.

A byte-level tokenizer's pre-tokens are cut by its own pattern, worked out for
Latin text on the bytes of many texts at once (``cuts``), and each distinct one
is encoded by the tokenizer's model; the last in use are remembered, ``CACHE`` a
worker.  Texts with other characters (see ``plain``) or with special tokens, and
other tokenizers, are encoded whole.
Extra columns are ignored; a very long text is one document of one shard; doc_ids
are integers.  The shared folder is one that pyarrow can open as well as Spark.
"""

from __future__ import annotations

import json
import re
import zlib
from codecs import charmap_decode
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import lean, materialise, new_path, ship, worker_cache

SHARD_TOKENS = 1 << 18
CACHE = 400_000
#: Characters of texts that are cut at once, but for a longer text.
CHARS = 1 << 21
#: Pre-tokens whose ids are gathered at once.
BLOCK = 1 << 16
# The byte-level pattern's letters and numbers below U+0250.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: All but Latin and marks that are neither letters, numbers nor spaces.
OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
#: Characters that regex engines class differently.
CONTROLS = "\x1c\x1d\x1e\x1f\x85"
#: Ends a text where many are cut at once; one of CONTROLS, so in none of them.
STOP = b"\x1c"
_MARK, _LETTER, _NUMBER, _SPACE, _STOP = range(5)
MAGIC = b"PMWAVE01"
STEP = 512


class Wavelet:
    """Bit-planes of a sequence of ranks below 2**levels, with rank directories."""

    def __init__(self, n: int, levels: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.levels, self.planes, self.ones = n, levels, planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ranks: np.ndarray, levels: int) -> Wavelet:
        now, planes, ones = ranks, [], []
        for level in range(levels):
            bit = (now >> (levels - 1 - level)) & 1 == 1
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane)
            ones.append(directory(plane))
            now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
        return cls(len(ranks), levels, planes, ones)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last level up."""
        now = np.zeros(self.n, np.uint16)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            out = np.empty(self.n, np.uint16)
            out[np.flatnonzero(~bit)] = now[:zeros]
            out[np.flatnonzero(bit)] = now[zeros:] | np.uint16(1 << (self.levels - 1 - level))
            now = out
        return now

    def _rank1(self, level: int, at: int) -> int:
        block = at // STEP
        plane = self.planes[level][block * (STEP // 8) : at // 8 + 1].copy()
        if len(plane):
            plane[-1] &= (1 << (at % 8)) - 1 if len(plane) == at // 8 + 1 - block * (STEP // 8) else 255
        return int(self.ones[level][block]) + int(np.bitwise_count(plane).sum())

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = self.planes[level][at // 8] >> (at % 8) & 1
            one = self._rank1(level, at)
            value = value << 1 | int(bit)
            at = self.zeros[level] + one if bit else at - one
        return value

    def rank(self, value: int, at: int) -> int:
        """How often value stands before position at."""
        low = 0
        for level in range(self.levels):
            a, b = self._rank1(level, low), self._rank1(level, at)
            if value >> (self.levels - 1 - level) & 1:
                low, at = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, at = low - a, at - b
        return at - low

    def select(self, value: int, k: int) -> int:
        """The position of the k-th value, from 0."""
        low, path = 0, []
        for level in range(self.levels):
            one = self._rank1(level, low)
            bit = value >> (self.levels - 1 - level) & 1
            low = self.zeros[level] + one if bit else low - one
            path.append(bit)
        at = low + k
        for level in reversed(range(self.levels)):
            at = self._select(level, path[level], at - self.zeros[level] if path[level] else at)
        return at

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th bit of a kind on a level, from 0."""
        before = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * STEP, self.n) - self.ones[level].astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (STEP // 8) : (block + 1) * (STEP // 8)], bitorder="little")
        return block * STEP + int(np.flatnonzero(bits == bit)[k - int(before[block])])


def directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of STEP bits, and at the end."""
    padded = np.zeros(-(-len(plane) // (STEP // 8)) * (STEP // 8), np.uint8)
    padded[: len(plane)] = plane
    each = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(each)]).astype(np.uint32)


class Shard:
    """One file: documents, symbols and the wavelet matrix of their ids."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, symbols: np.ndarray, wavelet: Wavelet):
        self.doc_ids, self.lengths, self.symbols, self.wavelet = doc_ids, lengths, symbols, wavelet

    @classmethod
    def build(cls, doc_ids: list[int | None], ids: list[np.ndarray]) -> Shard:
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        seen = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
        seen[flat] = True
        symbols = np.flatnonzero(seen).astype(np.uint32)
        if len(symbols) > 1 << 16:
            raise ValueError("a shard holds at most 65,536 distinct ids")
        ranks = (np.cumsum(seen) - 1).astype(np.uint16)[flat]
        levels = max(1, int(len(symbols) - 1).bit_length())
        return cls(doc_ids, np.array([len(x) for x in ids], np.uint32), symbols, Wavelet.build(ranks, levels))

    def to_bytes(self) -> bytes:
        w = self.wavelet
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        head = np.array([w.n, w.levels, len(self.symbols), len(ids)], "<u8")
        parts = [MAGIC, head.tobytes(), self.symbols.astype("<u4").tobytes(), ids.tobytes(), known.tobytes(), self.lengths.astype("<u4").tobytes()]
        for plane, ones in zip(w.planes, w.ones, strict=True):
            parts += [plane.tobytes(), ones.astype("<u4").tobytes()]
        body = b"".join(parts)
        return body + zlib.crc32(body).to_bytes(4, "little")

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole shard file")
        at = 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        n, levels, n_symbols, n_docs = (int(x) for x in take("<u8", 4))
        symbols, ids, known, lengths = take("<u4", n_symbols), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        planes, ones = [], []
        for _ in range(levels):
            planes.append(take("u1", -(-n // 8)))
            ones.append(take("<u4", -(-n // STEP) + 1))
        return cls([int(d) if k else None for d, k in zip(ids, known, strict=True)], lengths, symbols, Wavelet(n, levels, planes, ones))

    def ids(self) -> np.ndarray:
        """All ids in order."""
        return self.symbols[self.wavelet.decode()]

    def access(self, at: int) -> int:
        return int(self.symbols[self.wavelet.access(at)])

    def _rank_of(self, token: int) -> int | None:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and self.symbols[k] == token else None

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token id in positions [low, high)."""
        k = self._rank_of(token)
        high = self.wavelet.n if high is None else high
        return 0 if k is None else self.wavelet.rank(k, high) - self.wavelet.rank(k, low)

    def occurrences(self, token: int) -> list[int]:
        """All positions of a token id."""
        k = self._rank_of(token)
        return [] if k is None else [self.wavelet.select(k, i) for i in range(self.wavelet.rank(k, self.wavelet.n))]


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        cache["tokenizer", path] = Tokenizer.from_file(path)
    return cache["tokenizer", path]


def _visible_bytes() -> str:
    """The character for each byte, as byte-level tokenizers write them: others follow 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))


def _kind(char: str) -> int:
    if char == STOP.decode():
        return _STOP
    return next((k for k, of in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_SPACE, r"\s")) if re.match(f"[{of}]", char)), _MARK)


#: Kinds of the characters below U+0250, and of bytes (not ASCII: a mark until looked at).
KINDS = np.array([_kind(chr(c)) for c in range(0x250)], np.uint8)
BYTE_KINDS = np.concatenate([KINDS[:128], np.full(128, _MARK, np.uint8)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the bytes of plain texts, STOP after each text.

    As the pattern has it: 's 't 'm 'd 'll 've 're, or letters, or numbers, or marks,
    the last three with the one blank before them; else space, of which the last
    character stands alone if anything but space follows.
    """
    kind = BYTE_KINDS[data]
    far = np.flatnonzero(data >= 0x80)
    lead = far[(data[far] >= 0xC0) & (data[far] < 0xE0)]
    kind[lead] = KINDS[(data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63]
    tail = far[data[far] < 0xC0]
    kind[tail] = kind[tail - 1]
    start = kind == _STOP
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != _STOP))
    start[last[data[last] == ord(" ")] + 1] = False
    start[last - (data[last] >= 0x80)] = True  # a no-break space has two bytes
    quote = np.flatnonzero(data[:-2] == ord("'"))
    quote = quote[start[quote] & (kind[quote + 1] == _LETTER)]
    one, two = data[quote + 1], data[quote + 2]
    short = quote[np.isin(one, list(b"sdmt"))]
    long = quote[(one == ord("l")) & (two == ord("l")) | np.isin(one, list(b"vr")) & (two == ord("e"))]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    return np.flatnonzero(start)


class _Words:
    """Ids of pre-tokens, by the tokenizer's model; the last in use are remembered.

    STOP stands for the end id, in row 0.  The ids of row r are
    pool[bounds[r]:bounds[r + 1]].
    """

    def __init__(self, tok, kind: type, end_id: int):
        model, self.kind, self.table = tok.model, kind, _visible_bytes()
        self.known = pa.array([STOP], pa.large_binary())
        self.pool, self.bounds = np.array([end_id], kind), np.array([0, 1])
        self.used, self.turn = np.zeros(1, np.int64), 0
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # words are remembered here; theirs costs more than it saves
        self.tokenize = model.tokenize
        self.marks = [t.content for t in tok.get_added_tokens_decoder().values()]
        told = json.loads(tok.to_str())
        cut = told["pre_tokenizer"] or {}
        self.own = told["model"]["type"] == "BPE" and not told["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]

    def made(self, word: bytes) -> list[int]:
        return [t.id for t in self.tokenize(charmap_decode(word, "strict", self.table)[0])]

    def rows(self, words: pa.Array) -> np.ndarray:
        """The rows of distinct pre-tokens; the model makes those not remembered."""
        found = pc.index_in(words, value_set=self.known)
        new = words.filter(found.is_null())
        rows = found.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            rows[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
            ids = [self.made(w) for w in new.to_pylist()]
            self._append(new, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), self.kind))
        self.turn += 1
        self.used[rows] = self.turn
        return rows

    def _append(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, words])
        self.pool = np.concatenate([self.pool, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.zeros(len(sizes), np.int64)])

    def _forget(self) -> None:
        """Keep row 0 and the last used half of CACHE."""
        rows = np.concatenate([[0], np.sort(1 + np.argsort(-self.used[1:], kind="stable")[: CACHE // 2])])
        self.pool, sizes = self._ids(rows)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.known, self.used = self.known.take(pa.array(rows)), self.used[rows]

    def _ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after the other, and how many each has."""
        each, parts = np.diff(self.bounds), []
        for low in range(0, len(rows), BLOCK):
            some = rows[low : low + BLOCK]
            sizes = each[some]
            at = np.repeat(self.bounds[some] - (np.cumsum(sizes) - sizes), sizes)
            at += np.arange(len(at))
            parts.append(self.pool[at])
        return np.concatenate(parts), each[rows]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, the end id last."""
        data = STOP.join([b"", *[t.encode() for t in texts], b""])
        seen = np.frombuffer(data, np.uint8)
        starts = np.append(cuts(seen), len(seen))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        rows = self.rows(words.dictionary)[words.indices.to_numpy()]
        flat, sizes = self._ids(rows)
        upto = np.cumsum(sizes)[rows == 0].tolist()
        if len(self.known) > CACHE:
            self._forget()
        del words
        pa.default_memory_pool().release_unused()  # the tables of both searches
        return [flat[a:b] for a, b in zip(upto, upto[1:])]

    def plain(self, text: str) -> bool:
        """Whether ``cuts`` cuts a text as the tokenizer does."""
        if not self.own or any(m in text for m in self.marks) or any(c in text for c in CONTROLS):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return OTHER.search(text) is None
        return True


def encode_texts(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text as uint16 (or uint32 for large ids), the end id last."""
    tok = tokenizer(path)
    kind = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
    cache = worker_cache()
    if ("words", path, end_id) not in cache:
        cache["words", path, end_id] = _Words(tok, kind, end_id)
    words = cache["words", path, end_id]
    plain = [words.plain(t) for t in texts]
    cut = iter(words.encode([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
    return [next(cut) if p else np.array([*tok.encode(t, add_special_tokens=False).ids, end_id], kind) for t, p in zip(texts, plain, strict=True)]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, path: str, end_id: int, shard_tokens: int):
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        task = TaskContext.get()
        part, shard, ids, rows, size = task.partitionId(), 0, [], [], 0
        store, base = _open(folder)

        def flush():
            nonlocal shard, ids, rows, size
            name = f"part-{part:08d}-{shard:08d}.wm"
            draft = f"{base}/_{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(Shard.build(rows, ids).to_bytes())
            store.move(draft, f"{base}/{name}")
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, name, len(rows), size)], schema=schema)
            shard, ids, rows, size = shard + 1, [], [], 0
            return out

        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            at = 0
            while at < len(docs):
                upto, chars = at, 0
                while upto < len(docs) and (upto == at or chars < CHARS):
                    chars += sizes[upto]
                    upto += 1
                some = [t or "" for t in texts.slice(at, upto - at).to_pylist()]
                for d, x in zip(docs[at:upto], encode_texts(some, path, end_id), strict=True):
                    rows.append(d)
                    ids.append(x)
                    size += len(x)
                    if size >= shard_tokens:
                        yield flush()
                at = upto
        if rows:
            yield flush()

    return write


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        store, base = _open(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    shard = Shard.from_bytes(f.read())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    return read


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """Write the files; returns their folder and the manifest.

    A task writes a draft and renames it, and a repeated task writes the same
    bytes under the same name, so lost executors leave no half files.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "wavelet")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    manifest = dealt.select("doc_id", "text").mapInArrow(lean(_writer(folder, tokenizer_path, end_id, shard_tokens), keeps=True), "part long, shard long, file string, n_docs long, n_tokens long")
    return folder, materialise(manifest, "wavelet-manifest")


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the files."""
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    placed = manifest.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.select("file", "start").repartition(spread).mapInArrow(lean(_reader(folder), keeps=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    return read_shards(*write_shards(docs, tokenizer_path, end_id, shard_tokens))


ship(__name__)

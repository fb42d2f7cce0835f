"""Packing documents into training sequences by lexical retrieval.

1. Corpus counts. One scan counts in how many documents each hashed word stands, the words of all documents, and the bytes of each lexical bucket. A bucket is
   made of the first bits of a document's min-hashes over its words, so documents that share many words tend to share it.
2. Parts. Neighbouring buckets are joined to parts of about PART_BYTES; a bucket with more, such as that of very many copies, is dealt over several parts. Inside a part
   documents stand in the order of their min-hashes, and shards are runs of at most SHARD_DOCS of them.
3. Retrieval. A shard has an inverted index with BM25 weights (document frequencies and mean length of the whole corpus). The first unused document seeds a window of WINDOW tokens;
   its best unused neighbours (BM25 with all of the seed's words as query) follow until the window is full. The document at which a window ends is cut there, goes on
   in the next window and is the seed of that one. Where no unused document shares a word, the next unused one follows.

Every window but a part's last is full. The tail of a part is cut into sequences of powers of two, which
need no padding. A sequence_id has the part in its upper and a running number in its lower 32 bits; parts follow from the documents (copies
in a heavy bucket: also from their place in the input), so neither shuffle partitions nor retried tasks change an id.

Tokens are those of `tokenizers` with byte_bpe_50k.json, then id 0; a special token's string in a text is that token, as the library has it by default. The same merges are
applied by a faster library from byte_bpe_50k.tiktoken, which gives the same ids (a test compares them).

Defined cases: a null or empty text is the one id 0; a document longer than a window fills several; equal rows are separate
documents with pieces of their own; a null doc_id is kept; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.session import bounded_batches

WINDOW, END = 1024, 0
SHARD_DOCS, SHARD_CHARS = 1024, 16_000_000
#: Bytes of a part, with ROW_BYTES for each document, and buckets of hashed words and of lexical keys (their tables go to the driver and to every task).
PART_BYTES, ROW_BYTES, WORD_BUCKETS, KEY_BITS = 4 << 20, 64, 1 << 18, 9
K1, B = 1.2, 0.75
#: The vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc_id long"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
_BASE, _CHUNK = 0xD6E8FEB86659FD93, 1 << 20
_kept: list[np.ndarray] = []
_FACTORS = np.random.default_rng(3).integers(0, 2**63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
_encoders: dict[str, object] = {}


def encoder(path: str | None = None):
    """The tokenizer, loaded once a process. path: a .tiktoken file of the vocabulary; by default the public one."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    text, own = text or "", encoder(path)
    special = any(x in text for x in SPECIAL)
    ids = own.encode(text, allowed_special="all") if special else own.encode_ordinary(text)
    ids.append(END)
    return np.frombuffer(array("I", ids), "<u4")  # twice as fast as np.array


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse modulo 2**64."""
    if len(_kept) == 0 or len(_kept[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 2 * _CHUNK), base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _kept[:] = made
    return _kept[0][:n], _kept[1][:n]


def _hashed(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash, of 39 bits, and start of every word of a text that ends with a blank. A word's hash is its polynomial in _BASE, taken from running sums."""
    data = np.frombuffer(joined.translate(_LOWER), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers)])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(25)).astype(np.int64), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and how many words each has. About _CHUNK bytes are hashed at a time, cut between words."""
    hashes, counts = [np.empty(0, np.int64)], np.zeros(len(texts), np.int64)
    held, size = [], 0

    def ready() -> None:
        nonlocal size
        if held:
            h, starts = _hashed(b" ".join(x for _, x in held) + b" ")
            ends = np.cumsum([len(x) + 1 for _, x in held])
            np.add.at(counts, [k for k, _ in held], np.diff(np.searchsorted(starts, ends), prepend=0))
            hashes.append(h)
            held.clear()
            size = 0

    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > _CHUNK:
            cut = _BLANK.search(text, at + _CHUNK)
            if not cut:
                break
            held.append((k, text[at : cut.start()]))
            ready()
            at = cut.end()
        held.append((k, text[at:] if at else text))
        size += len(text) - at
        if size >= _CHUNK:
            ready()
    ready()
    return np.concatenate(hashes), counts


def lexical_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Min-hashes of 63 bits over each text's word hashes, a row for each text; zeros without words."""
    out = np.zeros((len(counts), len(_FACTORS)), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        x = hashes.astype(np.uint64)
        x = (x ^ x >> np.uint64(15)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        begins = (np.cumsum(counts) - counts)[some]
        for j, f in enumerate(_FACTORS):
            out[some, j] = np.minimum.reduceat(x * f, begins) >> np.uint64(1)
    return out


def buckets_of(keys: np.ndarray) -> np.ndarray:
    """The first KEY_BITS bits of the first two min-hashes."""
    return keys[:, 0] >> 63 - KEY_BITS << KEY_BITS | keys[:, 1] >> 63 - KEY_BITS


@dataclass(frozen=True)
class CorpusCounts:
    """documents, words: of the corpus; df: documents by hashed word; first_part, parts: where a lexical bucket's documents go."""

    documents: int
    words: int
    df: np.ndarray
    first_part: np.ndarray
    parts: np.ndarray


def parts_of(weights: np.ndarray, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each bucket: neighbouring buckets share a part until it's full, a heavy one has parts of its own."""
    first, parts = np.zeros(len(weights), np.int64), np.ones(len(weights), np.int64)
    at, filled = 0, 0
    for k in np.flatnonzero(weights).tolist():
        w = int(weights[k])
        if filled and filled + w > part_bytes:
            at, filled = at + 1, 0
        first[k], parts[k] = at, max(1, -(-w // part_bytes))
        if parts[k] > 1:
            at, filled = at + int(parts[k]), 0
        else:
            filled += w
    return first, parts


def corpus_counts(narrow: DataFrame, part_bytes: int = PART_BYTES) -> CorpusCounts:
    """Counts over (doc_id, text); a task yields at most a row for each bucket."""
    keys = 1 << 2 * KEY_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(WORD_BUCKETS + keys + 2, np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            hashes, counts = word_hashes(texts)
            words, ends = hashes % WORD_BUCKETS, np.cumsum(counts).tolist()
            for begin, end in zip([0, *ends], ends):
                n[words[begin:end]] += 1  # once a document, however many of its words share a bucket
            np.add.at(n, WORD_BUCKETS + buckets_of(lexical_keys(hashes, counts)), [len(t) + ROW_BYTES for t in texts])
            n[-2:] += (len(texts), len(hashes))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    total = np.zeros(WORD_BUCKETS + keys + 2, np.int64)
    found = narrow.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return CorpusCounts(int(total[-2]), int(total[-1]), total[:WORD_BUCKETS].astype(np.float64), *parts_of(total[WORD_BUCKETS:-2], part_bytes))


class ShardIndex:
    """Inverted BM25 index of one shard. counts: those of the corpus; without, the shard is the corpus."""

    def __init__(self, texts: list[bytes], counts: CorpusCounts | None = None):
        hashes, sizes = word_hashes(texts)
        n, lengths = len(texts), sizes.astype(float)
        pairs = hashes << 24 | np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique(pairs, return_counts=True)
        terms, docs = pairs >> 24, pairs & 0xFFFFFF
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
        df = np.diff(np.append(first, len(terms)))
        term_of = np.repeat(np.arange(len(first)), df)
        if counts is None:
            idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), lengths.mean() if n else 1.0
        else:
            spread = counts.df[terms[first] % WORD_BUCKETS]
            idf, mean = np.log1p((counts.documents - spread + 0.5) / (spread + 0.5)), counts.words / counts.documents
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        self.first, self.df, self.docs = first, df, docs
        self.weight = idf[term_of] * tf * (K1 + 1) / (tf + norm[docs])
        # Per document, its words that other documents share.
        shared = np.flatnonzero(df[term_of] > 1)  # a word of one document finds none
        by_doc = shared[np.argsort(docs[shared], kind="stable")]
        self.terms = term_of[by_doc]
        self.bounds = np.searchsorted(docs[by_doc], np.arange(n + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document against all of the seed's shared words."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        sizes = self.df[terms]
        ends = np.cumsum(sizes)
        spans = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[terms] - ends + sizes, sizes)  # postings of all terms
        return np.bincount(self.docs[spans], self.weight[spans], self.n)


def reading_order(texts: list[bytes], sizes: list[int], filled: int, window: int = WINDOW, counts: CorpusCounts | None = None) -> list[tuple[int, int]]:
    """(document, seed) in the order in which they fill windows; `filled` tokens already stand in the first window."""
    index, n = ShardIndex(texts, counts), len(texts)
    used = np.zeros(n, bool)
    out: list[tuple[int, int]] = []
    following = 0
    seed, ranked = -1, iter(())
    at = filled % window
    while len(out) < n:
        chosen = next((k for k in ranked if not used[k]), -1) if seed >= 0 else -1
        if chosen < 0:
            while used[following]:
                following += 1
            chosen = following
        out.append((chosen, seed if seed >= 0 else chosen))
        used[chosen] = True
        before, at = at, at + sizes[chosen]
        if seed < 0 or at >= window:  # a new window began with or inside this document, which seeds it
            seed, at = chosen, at % window
            if len(out) < n:
                scores = index.scores(seed)
                scores[used] = 0
                near = np.flatnonzero(scores > 0)
                ranked = iter(near[np.argsort(-scores[near], kind="stable")].tolist())
    return out


class _Packer:
    """Cuts a stream of token arrays into windows and lists the pieces."""

    def __init__(self, base: int):
        self.base, self.sequence, self.at = base, 0, 0
        self.rows: list[tuple] = []
        self.tail: list[tuple] = []  # pieces of the window that isn't full

    def add(self, doc: int | None, ids: np.ndarray, seed: int | None) -> None:
        start, size = 0, len(ids)
        while start < size:
            length = min(size - start, WINDOW - self.at)
            self.tail.append((doc, start, ids[start : start + length], size, seed))
            start, self.at = start + length, self.at + length
            if self.at == WINDOW:
                self._close(self.tail)
                self.tail, self.at = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, size, seed in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), size, self.base + self.sequence, offset, seed))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Cut the unfinished window into sequences of powers of two."""
        left, total = self.tail, self.at
        for power in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
            if not total & power:
                continue
            pieces, room = [], power
            while room:
                doc, start, ids, size, seed = left[0]
                pieces.append((doc, start, ids[:room], size, seed))
                left = left[1:] if len(ids) <= room else [(doc, start + room, ids[room:], size, seed), *left[1:]]
                room -= min(room, len(ids))
            self._close(pieces)
        self.tail, self.at = [], 0


def packed(docs: DataFrame, tokenizer_path: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The pieces of all documents."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(corpus_counts(narrow, part_bytes))  # tables of fixed size

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, row = shared.value, 0
        for batch in batches:
            keys = lexical_keys(*word_hashes([t or b"" for t in batch.column(1).to_pylist()]))
            buckets, salts = buckets_of(keys), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            salts = (salts + np.arange(row, row + len(salts)).astype(np.uint64) * np.uint64(0x9E3779B9)) >> np.uint64(1)
            row += len(salts)
            parts = counts.first_part[buckets] + salts.astype(np.int64) % counts.parts[buckets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), *(pa.array(keys[:, j]) for j in range(3))], names=["doc_id", "text", "h", "part", "k0", "k1", "k2"])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        held: list[tuple[int | None, bytes]] = []
        size, part = 0, None

        def shard() -> pa.RecordBatch:
            nonlocal size
            ids = [token_ids(t.decode("utf-8", "replace"), tokenizer_path) for _, t in held]
            for k, seed in reading_order([t for _, t in held], [len(x) for x in ids], packer.at, counts=shared.value):
                packer.add(held[k][0], ids[k], held[seed][0])
            held.clear()
            size = 0
            rows, packer.rows = packer.rows, []
            return table(rows)

        for batch in batches:
            for of, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if of != part:
                    if packer:
                        yield shard()
                        packer.finish()
                        yield table(packer.rows)
                    packer, part = _Packer(of << 32), of
                held.append((doc, text or b""))
                size += len(held[-1][1])
                if len(held) >= SHARD_DOCS or size >= SHARD_CHARS:
                    yield shard()
        if packer:
            yield shard()
            packer.finish()
            yield table(packer.rows)

    keyed = narrow.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(placed, "doc_id long, text binary, h long, part long, k0 long, k1 long, k2 long")
    return keyed.repartition("part").sortWithinPartitions("part", "k0", "k1", "k2", "h", "doc_id").select("part", "doc_id", "text").mapInArrow(pack, SCHEMA)

"""Suffix-array dedup by prefix-free parsing: every byte under a string of `length` bytes that also starts elsewhere goes.

1. Cores. A rolling hash of TRIGGER bytes runs over each text. Of the `reach` hashes that begin in a window's first `reach` bytes, the smallest
   (the rightmost of equals) is the window's anchor. Equal windows have equal anchors at equal offsets, and no window is without one. All windows
   of one anchor share the core of length - reach + 1 bytes that follows it, so the anchor with its windows is one entry.
2. Counts. A core that occurs once in the corpus can't be in a repeated window: its entries are settled as unique. An entry that occurs twice
   with all the bytes of its windows is settled as repeated. What remains are cores with different bytes around them, the edges of repeats; each different entry is
   one piece of text from its first window's start to its last window's end.
3. Prefix-free parsing of the pieces (`repeated_windows`). Rolling-hash triggers of a fixed residue cut them into phrases that overlap by a trigger, so no phrase suffix is
   a prefix of another. The distinct phrases in sorted order are the dictionary; the pieces as numbers of phrases are the parse. The suffix array of the dictionary orders what
   is left of a window's first phrase, the suffix array of the parse orders what follows it, and both together give the windows' corpus order, in which
   equal windows are neighbours. Neighbours are compared byte by byte.

Pieces are dealt by core, for equal windows share one. A core with more than CORE_LIMIT pieces is split (`_split`): its windows are halved by their
distance from the anchor, and each half is dealt by the longer string that all of its windows hold; halves that agree in all bytes are settled by
counting. Half by half that ends, at the latest with one window a piece, whose string is the whole window. So no task gets more than CORE_LIMIT pieces of one key.

Steps 1 and 2 tell strings apart by 128 bits of hash. Texts are shuffled twice, to cut out the pieces and to remove what was found.

Passages that repeat but are too short to be removed are counted beside (`dedup_with_passages`): the steps run with their shorter strings, and what
is removed is then sought only in the text under long enough runs of these (`longer_spans`), where every longer repeat lies.

Defined cases: a null text is empty; a text shorter than `length` keeps all its bytes; equal rows are separate documents,
so from `length` bytes on they remove each other whole; a null doc_id is kept; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.session import bounded_batches, discard, written

LENGTH, TRIGGER = 400, 16
#: A passage: a run of at least so many words under strings of so many bytes that also start elsewhere (50 words of under four letters).
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200
#: Mean bytes of a phrase.
PHRASE = 64
#: Pieces of one key that a task sorts, and pieces that it sorts at a time.
CORE_LIMIT, BATCH = 4_000, 4_000
#: Positions hashed at a time, so that the arrays stay in a core's cache.
_PIECE = 1 << 15
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)

_PARSED = "c long, u long, doc_id long, h long, lo int, hi int, off int, n int"
_FOUND = "doc_id long, h long, lo int, hi int"


@dataclass(frozen=True)
class Shape:
    """length: bytes of a string that counts as repeated, 64 or more; reach: first bytes of a window in which its anchor begins."""

    length: int = LENGTH

    @property
    def reach(self) -> int:
        return 1 << (self.length * 2 // 3).bit_length() - 1

    @property
    def core(self) -> int:
        return self.length - self.reach + 1


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER bytes from each position on."""
    h = data.astype(np.uint64) + np.uint64(1)
    width, factor = 1, _BASE
    while width < TRIGGER:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = width * 2, factor * factor % (1 << 64)
    h ^= h >> np.uint64(29)
    return h * _MIX


def _anchors(data: np.ndarray, shape: Shape) -> np.ndarray:
    """For each position a with length bytes after it, the anchor of the window that starts at a."""
    n, reach = len(data) - shape.length + 1, shape.reach
    out = np.empty(max(0, n), np.int64)
    for at in range(0, n, _PIECE):
        some = min(_PIECE, n - at)
        h = _rolling(data[at : at + some + reach - 1 + TRIGGER - 1])
        # smallest hash first, then the largest position
        key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        width = 1
        while width < reach:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        out[at : at + some] = at + (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return out


def parse(texts: list[bytes], shape: Shape = Shape()) -> list[list[tuple[int, int, int]]]:
    """Entries (first window, last window, anchor) of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    if len(buffer) < shape.length:
        return out
    anchor = _anchors(buffer, shape)
    ends = np.cumsum([len(t) for t in texts])
    for k, (end, text) in enumerate(zip(ends.tolist(), texts, strict=True)):
        begin, n = end - len(text), len(text) - shape.length + 1
        if n <= 0:
            continue
        own = anchor[begin : begin + n]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        los = [0, *cuts.tolist()]
        out[k] = list(zip(los, [*(x - 1 for x in los[1:]), n - 1], (own[los] - begin).tolist(), strict=True))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _entries(doc, h, text: bytes, cuts: list[tuple[int, int, int]], shape: Shape = Shape()) -> Iterator[tuple]:
    """Rows of _PARSED. In periodic texts, entries that are equal inside the document are settled here (c null) and only one of them goes on."""
    digest = xxhash.xxh3_64_intdigest
    dense = len(cuts) * 16 > len(text)
    seen: dict[tuple[int, int], int] = {}
    rows: list[tuple] = []
    repeats: list[tuple[int, int]] = []
    for lo, hi, t in cuts:
        c, u = digest(text[t : t + shape.core]), digest(text[lo : hi + shape.length], t - lo)
        if dense:
            first = seen.setdefault((c, u), len(rows))
            if first < len(rows):
                rows[first] = (*rows[first][:-1], 2)
                if repeats and repeats[-1][1] + 1 == lo:
                    repeats[-1] = (repeats[-1][0], hi)
                else:
                    repeats.append((lo, hi))
                continue
        rows.append((_signed(c), _signed(u), doc, h, lo, hi, t - lo, 1))
    yield from rows
    for lo, hi in repeats:
        yield None, None, doc, h, lo, hi, None, None


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: a row's key is its id with a hash of its text, so equal ids with other texts stay apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _parsed(keyed: DataFrame, shape: Shape) -> DataFrame:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            rows = [r for doc, h, text, cuts in zip(ids, hashes, texts, parse(texts, shape), strict=True) for r in _entries(doc, h, text, cuts, shape)]
            yield _batch(rows, kinds, names)

    return keyed.where(F.octet_length("text") >= shape.length).mapInArrow(cut, _PARSED)


def _doubled(rank: np.ndarray, room: np.ndarray, width: int) -> np.ndarray:
    """Ranks (from 1) of all suffixes by prefix doubling, from ranks of their first `width` units; room: units up to the end of the suffix's string."""
    classes = int(rank.max(initial=0))
    while width < room.max(initial=0):
        far = np.zeros(len(rank), np.int64)
        on = np.flatnonzero(room > width)
        far[on] = rank[on + width]
        distinct, finer = np.unique(rank << 32 | far, return_inverse=True)
        if len(distinct) == classes:
            break
        rank, classes, width = finer + 1, len(distinct), 2 * width
    return rank


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number in their order; data ends with eight more bytes."""
    out = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[k : len(data) - 8 + k]
    return out


def _dictionary_order(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary's suffix array, as the rank of every suffix (equal strings have equal ranks) of the joined phrases, and where each phrase begins."""
    sizes = np.array([len(p) for p in phrases], np.int64)
    begins = np.cumsum(sizes) - sizes
    room = np.repeat(begins + sizes, sizes) - np.arange(sizes.sum())
    words, near = _packed(np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)), np.minimum(room, 8)
    words &= np.uint64(0xFFFFFFFFFFFFFFFF) << (8 * (8 - near)).astype(np.uint64)  # nothing beyond the phrase's end
    order = np.lexsort((near, words))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (near[order[1:]] != near[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return _doubled(rank, room, 8), begins


def repeated_windows(pieces: list[bytes], first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of every window, those that start from first to last in each piece, whose `length` bytes also start another one."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    begins, text = ends - sizes, b"".join(pieces)
    data = np.frombuffer(text + bytes(max(8, TRIGGER)), np.uint8)
    # Phrases: from a trigger, or a piece's start, to the end of the next trigger, or the piece's end.
    cuts = (_rolling(data)[: len(text)] >> np.uint64(32)) % np.uint64(PHRASE) == 0
    cuts &= np.arange(len(text)) + TRIGGER <= np.repeat(ends, sizes)
    cuts[begins] = True
    starts = np.flatnonzero(cuts)
    end = np.repeat(ends, sizes)[starts]
    stops = np.minimum(np.append(starts[1:], len(text)) + TRIGGER, end)
    words = [text[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    dictionary = sorted(set(words))
    number = {w: k for k, w in enumerate(dictionary, 1)}
    parse_of = np.array([number[w] for w in words], np.int64)
    # The suffix array of the parse: phrases up to the piece's end, compared by their place in the dictionary.
    room = np.searchsorted(starts, end) - np.arange(len(starts))
    parse_rank = _doubled(parse_of, room, 1)
    # The windows, each in its phrase.
    counts = last - first + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = (begins + first)[piece] + np.arange(counts.sum()) - (np.cumsum(counts) - counts)[piece]
    phrase = np.searchsorted(starts, at, "right") - 1
    owners, owner = np.unique(parse_of[phrase], return_inverse=True)
    suffix_rank, phrase_begins = _dictionary_order([dictionary[k - 1] for k in owners.tolist()])
    rest = suffix_rank[phrase_begins[owner] + at - starts[phrase]]
    follows = np.where(room[phrase] > 1, parse_rank[np.minimum(phrase + 1, len(starts) - 1)], 0)
    key = rest << 32 | follows
    order = np.argsort(key, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    equal = key[order[:-1]] == key[order[1:]]  # alike to their pieces' ends
    packed, open_ = _packed(data), np.flatnonzero(~equal)
    for k in [*range(0, length - 8, 8), length - 8]:
        open_ = open_[packed[a[open_] + k] == packed[b[open_] + k]]
    equal[open_] = True
    found = np.zeros(len(at), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    return piece[found], (at - begins[piece])[found]


#: A piece: key, document, anchor, whether its windows are settled, the distances from the anchor that its windows have, the bytes before and from the anchor on.
_CUT = "key long, u long, doc_id long, h long, t int, settled boolean, l0 int, l1 int, left binary, right binary"
_CUT_NAMES = [x.split()[0] for x in _CUT.split(", ")]
_CUT_KINDS = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _cut_out(keyed: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """The pieces of wanted entries (c, doc_id, h, lo, hi, off, settled)."""
    by_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("c", "lo", "hi", "off", "settled")).alias("entries")).withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    held = keyed.where(F.octet_length("text") >= shape.length).join(by_doc, F.expr("doc_id <=> _doc and h = _h")).select("doc_id", "h", "text", "entries")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, text, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(entries), 4096):
                    rows = []
                    for e in entries[at : at + 4096]:
                        lo, hi, t = e["lo"], e["hi"], e["lo"] + e["off"]
                        rows.append((e["c"], 0, doc, h, t, e["settled"], t - hi, t - lo, text[lo:t], text[t : hi + shape.length]))
                    yield _batch(rows, _CUT_KINDS, _CUT_NAMES)

    return held.mapInArrow(cut, _CUT)


def _halves(rows: DataFrame, width: int, shape: Shape) -> DataFrame:
    """Pieces whose windows are within one stretch of `width` distances from the anchor, dealt by the string that all windows of the stretch hold."""
    digest = xxhash.xxh3_64_intdigest

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, doc, h, t, settled, l0, l1, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(l0 // width * width, l1 + 1, width):
                    a, b = max(l0, low), min(l1, low + width - 1)
                    before, after = left[len(left) - b :], right[: shape.length - a]
                    shared = before[len(before) - low :] + after[: shape.length - (low + width - 1)]
                    out.append((_signed(digest(shared, low * 1024 + width)), _signed(digest(before + after, a * 1024 + b)), doc, h, t, settled, a, b, before, after))
            yield _batch(out, _CUT_KINDS, _CUT_NAMES)

    return rows.mapInArrow(halved, _CUT)


def _split(pieces: DataFrame, crowded: DataFrame, shape: Shape, core_limit: int) -> tuple[DataFrame, DataFrame]:
    """(pieces of no crowded key, windows found on the way)."""
    here, rest = pieces.join(crowded, "key", "left_anti"), pieces.join(crowded, "key", "left_semi").select(*_CUT_NAMES)
    found, width = None, shape.reach
    while True:
        width //= 2
        rows = written(_halves(rest, width, shape).dropDuplicates(["key", "u", "doc_id", "h", "t"]), "halves")
        alike = written(rows.groupBy("key", "u").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "t", "settled", "l0", "l1", "left", "right")).alias("at")), "alike")
        again = rows.join(alike.where("n > 1").select("key", "u"), ["key", "u"], "left_semi").where("not settled")
        spans = again.select("doc_id", "h", (F.col("t") - F.col("l1")).alias("lo"), (F.col("t") - F.col("l0")).alias("hi"))
        found = spans if found is None else found.unionByName(spans)
        one = alike.select("key", "u", "at.doc_id", "at.h", "at.t", ((F.col("n") > 1) | F.col("at.settled")).alias("settled"), "at.l0", "at.l1", "at.left", "at.right")
        sizes = alike.groupBy("key").agg(F.count("*").alias("different")).where("different > 1")
        here = here.select(*_CUT_NAMES).unionByName(one.join(sizes.where(F.col("different") <= core_limit).select("key"), "key", "left_semi").select(*_CUT_NAMES))
        crowded = sizes.where(F.col("different") > core_limit).select("key")
        if width == 1 or crowded.isEmpty():
            return here, found
        rest = one.join(crowded, "key", "left_semi").select(*_CUT_NAMES)


def _sorted_out(pieces: DataFrame, shape: Shape) -> DataFrame:
    """Repeated windows of pieces that aren't settled, by the corpus order of the pieces of a key."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(row[0], *row[2:5], row[6]): row for row in rows}.values())  # equal rows of the corpus give a piece twice
        spans = []
        if len(rows) > 1:
            left = np.array([len(r[8]) for r in rows], np.int64)
            l0, l1 = (np.array([r[k] for r in rows], np.int64) for k in (6, 7))
            piece, start = repeated_windows([r[8] + r[9] for r in rows], left - l1, left - l0, shape.length)
            new = np.ones(len(piece), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            for k, lo, hi in zip(piece[at].tolist(), start[at].tolist(), start[np.append(at[1:], len(piece)) - 1].tolist(), strict=True):
                _, _, doc, h, t, settled, *_ = rows[k]
                if not settled:
                    begin = t - int(left[k])
                    spans.append((doc, h, begin + lo, begin + hi))
        return _batch(spans, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["doc_id", "h", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                held.append(row)
        yield solved(held)

    return pieces.select(*_CUT_NAMES).repartition("key").sortWithinPartitions("key").mapInArrow(sort, _FOUND)


def repeated_spans(docs: DataFrame, shape: Shape = Shape(), core_limit: int = CORE_LIMIT) -> DataFrame:
    """(doc_id, h, lo, hi): in the document with this key, every window that starts from lo to hi also starts elsewhere."""
    return _repeated(_keyed(docs), shape, core_limit)


def longer_spans(docs: DataFrame, spans: DataFrame, shape: Shape, longer: Shape, core_limit: int = CORE_LIMIT) -> DataFrame:
    """repeated_spans(docs, longer) from spans, those of shape: a longer repeated window lies, as does its equal, under a run of shorter ones. Only the text under long enough runs is read again."""
    by_doc = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    held = _keyed(docs).where(F.octet_length("text") >= longer.length).join(by_doc, F.expr("doc_id <=> _doc and h = _h")).select("doc_id", "h", "text", "spans")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, h, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found):
                    if merged and lo <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                rows += [(doc, h, lo, text[lo : hi + shape.length]) for lo, hi in merged if hi - lo >= longer.length - shape.length]
            yield _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["doc_id", "whole", "begin", "text"])

    made = held.mapInArrow(runs, "doc_id long, whole long, begin int, text binary")
    regions = written(made.withColumn("h", F.xxhash64("whole", "begin")), "regions")
    found = _repeated(regions.select("doc_id", "h", "text"), longer, core_limit)
    origin = regions.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "whole", "begin").distinct()
    return found.join(origin, F.expr("doc_id <=> _doc and h = _h")).select("doc_id", F.col("whole").alias("h"), (F.col("lo") + F.col("begin")).alias("lo"), (F.col("hi") + F.col("begin")).alias("hi"))


def _repeated(keyed: DataFrame, shape: Shape, core_limit: int) -> DataFrame:
    parsed = written(_parsed(keyed, shape), "parse")
    whole = ["doc_id", "h", "lo", "hi"]
    entries = parsed.where("c is not null")
    cores = entries.groupBy("c").agg(F.sum("n").alias("total"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("total > 1").select("c", (F.col("u0") != F.col("u1")).alias("mixed"))
    settled = parsed.where("c is null").withColumn("mixed", F.lit(False))
    repeated = written(entries.join(cores, "c").unionByName(settled), "repeated", parsed.count())
    discard(parsed)
    most = repeated.count()
    alike = repeated.where("not mixed").select(*whole)
    mixed = repeated.where("mixed").drop("mixed")
    phrases = written(mixed.groupBy("c", "u").agg(F.sum("n").alias("total"), F.min(F.struct("doc_id", "h", "lo", "hi", "off")).alias("at")), "phrases", most)
    again = mixed.join(phrases.where("total > 1").select("c", "u"), ["c", "u"], "left_semi").select(*whole)
    sizes = phrases.groupBy("c").agg(F.count("*").alias("different"), F.min("total").alias("least")).where("least = 1")
    wanted = phrases.join(sizes.select("c"), "c", "left_semi").select("c", "at.*", (F.col("total") > 1).alias("settled"))
    pieces = _cut_out(keyed, wanted, shape)
    found = alike.unionByName(again)
    if (sizes.agg(F.max("different")).first()[0] or 0) > core_limit:
        pieces, spans = _split(written(pieces, "pieces"), sizes.where(F.col("different") > core_limit).select(F.col("c").alias("key")), shape, core_limit)
        found = found.unionByName(spans)
    return found.unionByName(_sorted_out(pieces, shape))


def remove(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH, least_words: int = 0) -> tuple[bytes, int, int]:
    """Bytes kept, bytes removed and removed runs, for windows that start in spans (first, last). Runs of fewer than least_words words stay."""
    if not spans:
        return text, 0, 0
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, [lo for lo, _ in spans], 1)
    np.add.at(change, [hi + length for _, hi in spans], -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
    if least_words:
        for a, b in edges:
            if len(text[a:b].split()) < least_words:
                gone[a:b] = False
        edges = [(a, b) for a, b in edges if gone[a]]
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(edges)


def _removed(docs: DataFrame, keep: bool, length: int = LENGTH, least_words: int = 0, passages: tuple[int, int] | None = None) -> DataFrame:
    """The digest of every row, with the kept text and a struct `rest` of the other columns if asked to keep them. passages: bytes and words of those that are counted."""
    bounded_batches(docs.sparkSession)
    if passages:
        shorter = written(repeated_spans(docs, Shape(passages[0])), "spans")
        found = longer_spans(docs, shorter, Shape(passages[0]), Shape(length)).withColumn("passage", F.lit(False)).unionByName(shorter.withColumn("passage", F.lit(True)))
    else:
        found = repeated_spans(docs, Shape(length))
    spans = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*found.columns[2:])).alias("spans")).withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if keep else []
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    joined = keyed.join(spans, F.expr("doc_id <=> _doc and h = _h"), "left").select("doc_id", "text", "spans", "rest")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes", "kept", "rest"]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.string()]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                kept, n, runs = remove(text, [(x["lo"], x["hi"]) for x in found or () if not x.get("passage")], length, least_words)
                _, covered, count = remove(text, [(x["lo"], x["hi"]) for x in found or () if x.get("passage")], *passages) if passages else (None, None, None)
                rows.append((doc, len(text), n, runs, hashlib.sha256(kept).hexdigest(), count, covered, kept.decode("utf-8", "ignore") if keep else None))
            made = _batch(rows, kinds, names[:-1])
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column(3)], names=names)

    return joined.mapInArrow(removed, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long, kept string, rest {joined.schema['rest'].dataType.simpleString()}")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return _removed(docs, False, length).drop("n_passages", "n_passage_bytes", "kept", "rest")


def dedup_with_passages(docs: DataFrame, length: int = LENGTH, passage_bytes: int = PASSAGE_BYTES, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """As dedup, with n_passages and n_passage_bytes: the repeated passages that a text holds and the bytes under them. They are counted, not removed."""
    if passage_bytes > length:
        raise ValueError("passages are sought by strings that are no longer than those removed")
    return _removed(docs, False, length, passages=(passage_bytes, passage_words)).drop("kept", "rest")


def dedup_documents(docs: DataFrame, length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """docs with the kept text, same columns. A character that a removed run cuts in two goes with the run. least_words: runs of fewer words stay."""
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    return _removed(docs, True, length, least_words).select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))

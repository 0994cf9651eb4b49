"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts and items are compared as UTF-8 bytes, with A-Z lower-cased and each white space byte a blank. A document
contains an item if a part of it lies within ``share`` of the item's length in edit distance.

Windows start at every word and at places that four bytes choose by their hash (one in 16, for texts without words).
From each start of a document WALKS random CGK walks of STEPS steps embed what follows: a step copies the byte under
the pointer, and a random bit for (step, byte) moves the pointer on, so that the Hamming distance of two walks
follows the edit distance of what they walk over. TABLES tables for each walk sample SAMPLED positions; windows
of a document and of an item that agree in one table are a hit, and a hit places a window of the item's size in the
document. An item is entered with up to ENTERED of its starts, spread over its length. Each start is one more trial, so
the chance to miss an item falls with the number of its starts. For what a hit places, shared three-byte strings bound the edit
distance from below, which no match fails, and an exact approximate-matching pass confirms the rest.

What windows miss (texts and items with few starts, items under SHORT bytes, and chance) is found exactly, so that no match is lost.
One of an item's S segments has at most 1 / S of the permitted edits, and is cut into one piece more than these. Some piece then
stands unchanged with one edit at most in the piece behind it: by the cycle lemma one can start at a piece, and go on round the end, such
that the first n pieces have fewer than n edits for every n. Places where both hold are confirmed as those of windows
are, but for what windows have searched already.

Items are handled in blocks of BLOCK_BYTES; each block is one scan of the documents. A worker's memory for a block grows
with its items' starts, not with the longest item. Null or empty texts match nothing; items that are null or blank
are never matched; repeated items and rows each give their own results; empty tables give empty results. Documents are
processed whole, whatever their length, and other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, new_key, once, small_batches, text_slices

SHARE = 0.1
#: Steps of a walk, which cover about half as many bytes; independent walks, tables of each and positions sampled by a table.
STEPS, WALKS, TABLES, SAMPLED = 40, 2, 3, 16
#: Starts of an item that are entered, and length under which items are found by their pieces.
ENTERED, SHORT = 64, 64
BLOCK_BYTES = 2 << 20
#: Bytes of a piece that are looked up, and most of a segment.
GRAM, SEGMENT = 8, 512
#: Hits that are worked on at once.
HITS = 1 << 20
#: Bytes of texts that are searched at once.
SLICE = 1 << 19
_NORMAL = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of three-byte strings.
_BUCKETS = 2048
_MOVES = [np.random.default_rng(7_000 + w).integers(0, 2, (STEPS, 256), dtype=np.int64) for w in range(WALKS)]
_PLACES = [np.stack([np.random.default_rng((w, t)).permutation(STEPS)[:SAMPLED] for t in range(TABLES)]) for w in range(WALKS)]


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, white space as blanks; places stay."""
    return text.translate(_NORMAL)


def padded(data: np.ndarray) -> np.ndarray:
    """``data`` with bytes that no text holds behind it, as many as a walk may read."""
    return np.concatenate([data, np.full(STEPS + GRAM, 0xFF, np.uint8)])


def words_of(data: np.ndarray, size: int, count: int) -> np.ndarray:
    """The 4 or 8 bytes from each of the first ``count`` places on as one number; ``data`` is padded."""
    return np.ndarray((count,), f"<u{size}", data, strides=(1,))


def starts_of(data: np.ndarray, count: int) -> np.ndarray:
    """Where windows start among the first ``count`` places: at words and where four bytes' hash says so."""
    word = _WORD[data[:count]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    chosen = (words_of(data, 4, count) * np.uint32(0x9E3779B1)) >> np.uint32(28) == 0
    return np.flatnonzero(first | (chosen & word))


def cgk(data: np.ndarray, at: np.ndarray, move: np.ndarray) -> np.ndarray:
    """CGK embedding of what follows each place of ``at``: (steps, places) bytes."""
    out, at = np.empty((len(move), len(at)), np.uint8), at.copy()
    for j, bits in enumerate(move):
        c = data[at]
        out[j] = c
        at += bits[c]
    return out


def window_keys(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each table the keys of the windows that start at ``at``: the sampled bytes of a walk, hashed with the table."""
    for move, places in zip(_MOVES, _PLACES):
        embedded = cgk(data, at, move)
        for table, sampled in enumerate(places):
            x = np.ascontiguousarray(embedded[sampled].T).view("<u4").astype(np.uint64)
            h = np.full(len(at), int(move[:, 0] @ (1 << np.arange(STEPS) % 60)) * TABLES + table, np.uint64)
            for column in x.T:
                h = (h ^ column) * _SPREAD
                h ^= h >> np.uint64(29)
            yield h * _SPREAD


class Lookup:
    """Sorted keys with their entries, behind a bit filter."""

    def __init__(self, keys: np.ndarray, entries: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.entries = entries[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.shift = np.uint64(64 - max(16, len(keys).bit_length() + 4))
        slot = self._slot(self.keys)
        self.bits = np.zeros((1 << (64 - int(self.shift))) // 8, np.uint8)
        np.bitwise_or.at(self.bits, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the key, entry) of all entries of all ``keys``, about HITS at a time."""
        slot = self._slot(keys)
        hit = np.flatnonzero((self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        at = np.searchsorted(self.keys, keys[hit])
        at = np.minimum(at, len(self.keys) - 1)
        same = self.keys[at] == keys[hit] if len(self.keys) else np.zeros(0, bool)
        hit, at = hit[same], at[same]
        for i, j in cuts(self.first[at + 1] - self.first[at], HITS):
            own, entry = ranges(self.first[at[i:j]], self.first[at[i:j] + 1])
            yield hit[i:j][own], self.entries[entry]


def best_match(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a part of ``text``, end of the first such part), by bit-parallel columns."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(x | up)) & mask
        minus = up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & mask
        minus = minus << 1 & mask
        y = eq | down
        up = (minus | ~(y | plus)) & mask
        down = plus & y
        if score < best:
            best, end = score, j
    return best, end


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of the ranges [lo, hi)."""
    n = np.maximum(0, hi - lo)
    return np.repeat(np.arange(len(lo)), n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of ``sizes`` that sum to ``limit`` at most, or have one member."""
    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def histograms(bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How often each bucket occurs at the places of each range."""
    own, at = ranges(lo, hi)
    return np.bincount(own * _BUCKETS + bucket[at], minlength=len(lo) * _BUCKETS).reshape(len(lo), _BUCKETS)


def trigrams(data: np.ndarray, count: int) -> np.ndarray:
    return ((words_of(data, 4, count) & np.uint32(0xFFFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(21)).astype(np.int64)


class Parts(NamedTuple):
    """Items or segments: where they begin in the joined items, their sizes and the edits that each may have."""

    base: np.ndarray
    size: np.ndarray
    allowed: np.ndarray


class Pieces(NamedTuple):
    """Pieces by the bytes that are looked up: segment and offset in it, and four bytes of each half of the piece behind it, with their distances from it (0: none)."""

    lookup: Lookup
    segment: np.ndarray
    offset: np.ndarray
    half: np.ndarray
    ahead: np.ndarray


class ItemIndex:
    """Benchmark items: LSH tables of their windows, and the pieces of their segments."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = SHARE):
        #: Items by number.
        self.items = [(i, t) for i, t in ((i, normal(t).strip(b" ")) for i, t in items) if t]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.allowed = (share * self.size).astype(np.int64)
        joined = b"\xff".join(t for _, t in self.items)
        #: Where items begin in the joined items.
        self.base = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        self.data = padded(np.frombuffer(joined, np.uint8))
        self.bucket = trigrams(self.data, len(joined))
        at = starts_of(self.data, len(joined))
        item = np.searchsorted(self.base, at, "right") - 1
        # A walk covers STEPS / 2 bytes mostly; from places nearer the end it would leave the item.
        inside = (self.size[item] >= SHORT) & (at - self.base[item] <= self.size[item] - STEPS // 2)
        at, item = at[inside], item[inside]
        n = np.bincount(item, minlength=len(self.items))
        nth = np.arange(len(item)) - np.concatenate([[0], np.cumsum(n)])[item]
        most = np.minimum(n[item], ENTERED)
        # Of n starts that many, evenly: those at which the running share reaches the next whole number.
        spread = (nth * most) // np.maximum(1, n[item]) != ((nth - 1) * most) // np.maximum(1, n[item])
        at, item = at[spread], item[spread]
        #: Item and offset of each entry.
        self.item, self.offset = item, at - self.base[item]
        keys = list(window_keys(self.data, at)) if len(at) else [np.empty(0, np.uint64)]
        self.windows = Lookup(np.concatenate(keys), np.tile(np.arange(len(at), dtype=np.int32), len(keys) if len(at) else 0))
        self.parts = Parts(self.base, self.size, self.allowed)
        self._cut()

    def _cut(self) -> None:
        """Cuts items into segments, and these into pieces."""
        count = np.maximum(1, -(-self.size // SEGMENT))
        #: Item of each segment, and where it begins in it.
        self.of = np.repeat(np.arange(len(self.items)), count)
        nth = np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)
        self.begin = self.size[self.of] * nth // count[self.of]
        end = self.size[self.of] * (nth + 1) // count[self.of]
        self.segments = Parts(self.base[self.of] + self.begin, end - self.begin, (self.allowed // count)[self.of])
        self.whole = (count == 1)[self.of]
        n = self.segments.allowed + 1
        segment = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        size, n = self.segments.size[segment], n[segment]
        a, b, c = (size * (nth + i) // n for i in range(3))
        # The piece behind, if it has two halves of four bytes.
        ahead = np.stack([b - a, (b + c) // 2 - a]) * ((nth + 1 < n) & (c - b >= 8))
        at = self.segments.base[segment] + a
        word = words_of(self.data, 4, len(self.data) - 3)
        half = word[np.minimum(at + ahead, len(word) - 1)]
        key, length = words_of(self.data, GRAM, len(self.data) - GRAM + 1)[at], np.minimum(b - a, GRAM)
        self.pieces = {}
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            lookup = Lookup(key[own] & np.uint64((1 << 8 * k) - 1), np.arange(len(own), dtype=np.int32))
            self.pieces[k] = Pieces(lookup, segment[own], a[own], half[:, own], ahead[:, own])

    def hits(self, data: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
        """(place, item, offset, 0) where a window of an item agrees with the padded ``data``."""
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]
        if len(self.item):
            at = starts_of(data, count)
            for keys in window_keys(data, at):
                found.extend((at[k], self.item[entry], self.offset[entry], np.zeros(len(k), np.int64)) for k, entry in self.windows.find(keys))
        return tuple(np.concatenate(x) for x in zip(*found))

    def piece_hits(self, data: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(place, segment, offset, more) where a piece stands in the padded ``data`` and the one behind it has one edit at most, about HITS at a time.

        In a run of one byte all places see the same as far as a hit looks: the first one is looked up, with the number of those behind it.
        """
        key, word = words_of(data, GRAM, count), words_of(data, 4, len(data) - 3)
        more, kept = np.zeros(count, np.int64), None
        same = np.flatnonzero(key[1:] == key[:-1])
        if len(same):
            first = np.flatnonzero(np.append(True, same[1:] != same[:-1] + 1))
            run = np.diff(np.append(first, len(same))) + GRAM
            first = same[first]
            more[first] = np.maximum(0, run - max(GRAM, *(int(own.ahead.max()) + 5 for own in self.pieces.values())))
            kept = np.delete(np.arange(count), ranges(first + 1, first + 1 + more[first])[1])
            key = key[kept]
        found, n = [], 0
        for k, own in self.pieces.items():
            for lo in range(0, len(key), SLICE):
                for at, entry in own.lookup.find(key[lo : lo + SLICE] & np.uint64((1 << 8 * k) - 1)):
                    at = at + lo if kept is None else kept[at + lo]
                    (first, second), (one, two) = own.half[:, entry], own.ahead[:, entry]
                    fits = one == 0
                    fits |= word[np.minimum(at + one, len(word) - 1)] == first
                    for shift in (-1, 0, 1):
                        fits |= word[np.clip(at + two + shift, 0, len(word) - 1)] == second
                    at, entry = at[fits], entry[fits]
                    found.append((at, own.segment[entry], own.offset[entry], more[at]))
                    n += len(at)
                    if n >= HITS:
                        yield tuple(np.concatenate(x) for x in zip(*found))
                        found, n = [], 0
        if n:
            yield tuple(np.concatenate(x) for x in zip(*found))

    def places(self, hits: tuple[np.ndarray, ...], parts: Parts, bounds: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, part, lo, hi): where a part may stand in a text; ``bounds``: where texts start. No match around a hit is left out."""
        at, item, offset, more = hits
        text = np.searchsorted(bounds, at, "right") - 1
        diagonal = at - offset
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal, end = text[order], item[order], diagonal[order], (diagonal + more)[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        # The farthest diagonal of a text and item so far: each pair's diagonals are moved beyond those of the pair before.
        beyond = (np.cumsum(new) - 1) * (int(bounds[-1]) + int(parts.size.max()) + 1)
        end = np.maximum.accumulate(end + beyond) - beyond
        new[1:] |= diagonal[1:] - end[:-1] > parts.allowed[item[1:]] + 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text)) - 1 if len(first) else first
        text, item = text[first], item[first]
        a, size = parts.allowed[item], parts.size[item]
        lo = np.maximum(bounds[text], diagonal[first] - a)
        hi = np.minimum(bounds[text + 1] - 1, end[last] + size + 2 * a)
        # An edit changes three strings of three bytes at most.
        need = size - 2 - 3 * a
        keep = np.zeros(len(item), bool)
        for i, j in cuts(hi - lo + size + _BUCKETS, 1 << 20):
            base = parts.base[item[i:j]]
            mine = histograms(self.bucket, base, base + np.maximum(0, size[i:j] - 2))
            keep[i:j] = np.minimum(histograms(bucket, lo[i:j], np.maximum(lo[i:j], hi[i:j] - 2)), mine).sum(axis=1) >= need[i:j]
        return text[keep], item[keep], lo[keep], hi[keep]

    def rest(self, joined: bytes, data: np.ndarray, bounds: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, lo, hi) as of places(), for every match of every item, by pieces."""
        for hits in self.piece_hits(data, len(joined)):
            text, segment, lo, hi = self.places(hits, self.segments, bounds, bucket)
            base, size, allowed = (x[segment] for x in self.segments)
            keep = self.whole[segment]
            for i in np.flatnonzero(~keep).tolist():
                own = self.data[base[i] : base[i] + size[i]].tobytes()
                keep[i] = best_match(own, joined[lo[i] : hi[i]])[0] <= allowed[i]
            text, segment, lo, hi = text[keep], segment[keep], lo[keep], hi[keep]
            item, cut = self.of[segment], ~self.whole[segment]
            a = self.allowed[item]
            lo = np.maximum(bounds[text], lo - cut * (self.begin[segment] + a))
            hi = np.minimum(bounds[text + 1] - 1, hi + cut * (self.size[item] - self.begin[segment] + 2 * a))
            # Segments of one match place the item alike: what overlaps is searched once.
            order = np.lexsort((lo, item, text))
            text, item, lo, hi = text[order], item[order], lo[order], hi[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
            first = np.flatnonzero(new)
            yield text[first], item[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its (item number, distance, start, end), the best place of each item."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        joined = b"\xff".join([*map(normal, texts), b""])
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        data = padded(np.frombuffer(joined, np.uint8))
        bucket = trigrams(data, len(joined))
        searched: dict[tuple[int, int], list[tuple[int, int]]] = {}
        by_windows = self.places(self.hits(data, len(joined)), self.parts, bounds, bucket)
        for t, k, lo, hi in (x for found in chain([by_windows], self.rest(joined, data, bounds, bucket)) for x in zip(*(x.tolist() for x in found))):
            done = searched.setdefault((t, k), [])
            if any(a <= lo and hi <= b for a, b in done):
                continue
            done.append((lo, hi))
            pattern, near, start = self.items[k][1], joined[lo:hi], lo - int(bounds[t])
            at = near.find(pattern)
            if at >= 0:
                hit = (0, start + at, start + at + len(pattern))
            else:
                distance, end = best_match(pattern, near)
                if distance > self.allowed[k]:
                    continue
                hit = (distance, start + end - best_match(pattern[::-1], near[:end][::-1])[1], start + end)
            found[t][k] = min(hit, found[t].get(k, hit))
        return [[(k, *own[k]) for k in sorted(own)] for own in found]


def item_blocks(benchmark: DataFrame, share: float) -> Iterator[Callable[[], ItemIndex]]:
    """For each block of items a function that gives a worker its index, made once."""
    spark = small_batches(benchmark.sparkSession)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        sent = spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in own])
        yield lambda sent=sent, key=new_key(): once("items", key, lambda: ItemIndex(sent.value, share))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, distance, start, end): every item that a document contains, at its best place (byte offsets)."""
    out = None
    for made in item_blocks(benchmark, share):

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            index = made()
            for batch in batches:
                for part in text_slices(batch, "text", SLICE):
                    ids = part.column("doc_id").cast(pa.int64()).to_pylist()
                    rows = [(i, index.items[k][0], d, a, b) for i, own in zip(ids, index.search(as_bytes(part.column("text")))) for k, d, a, b in own]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 5)], ["doc_id", "item_id", "distance", "start", "end"])

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all columns stay, whatever their names, and nothing is shuffled.

    Each row is judged by its own text: rows with a null or empty text stay, and so do rows with a null doc_id and a clean text.
    """
    for made in item_blocks(benchmark, share):

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            index = made()
            for batch in batches:
                for part in text_slices(batch, "text", SLICE):
                    yield part.filter(pa.array([not own for own in index.search(as_bytes(part.column("text")))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Exact substring removal by suffix arrays that are built by two-stage sorting.

Every string of ``length`` bytes belongs to one anchor: the leftmost smallest hash among the ``GRAM``-byte
strings inside it. Equal strings have equal anchors at equal places, so only strings around equal anchors
need comparing, and each run of strings that share an anchor is one segment of text. Of equal segments (by a 128-bit
hash of their bytes) one goes on with their number; its entries in the suffix array count for two. A suffix
array of a block of segments finds what they share: suffixes smaller than their successors are sorted directly, the
others are induced by scans over the buckets, and adjacent common prefixes of ``length`` bytes mark repeated strings.
Anchors with more than GIANT different segments are dealt out before that: strings whose anchor stands in the left or right half of its range also share the bytes that all of
that half have in common, so each half is a group by those bytes, and groups still too large are halved again.

Matches never cross texts. Null texts count as empty, texts shorter than ``length`` have no spans, and repeated rows
are copies of each other. Results depend on a text and on the other texts, not on ids, which may repeat or be null.
Empty tables give empty results; other columns do not matter, whatever their names. Very long texts are cut into
segments block by block; the bytes of a text and its segments are what a task holds of it. Texts are shuffled only if
a fixed-size filter says that they may hold repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_filter, maybe, prefix_hash, small_batches, span_hash, staged, text_slices

LENGTH, GRAM = 400, 200
#: Different segments of one group that are sorted in one task; larger groups are halved.
GIANT = 400
#: Bytes that are sorted at once, and starts of strings that are anchored at once.
BLOCK, STARTS = 128 << 10, 1 << 18


# -- suffix array -------------------------------------------------------------------------------------------


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix after them: the byte after a run of equal bytes decides for the whole run; the end is smallest."""
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(rises, np.diff(ends, prepend=-1))


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of ``text``, compared on their first ``depth`` bytes at least.

    Two-stage sorting: suffixes smaller than their successors are sorted directly. Then the buckets of first bytes are scanned
    in order: a bucket's other suffixes stand in front of its sorted ones, in the order of their successors, which are in
    earlier buckets or, within a run of the bucket's own byte, were placed just before. Suffixes that agree on ``depth``
    bytes stand together, in any order.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    direct = smaller_than_next(text)
    chosen = _direct_sort(text, np.flatnonzero(direct), depth)
    follow = np.append(text[1:].astype(np.int16), -1)
    # Of the induced suffixes those that end a run; the others follow from them.
    last = np.flatnonzero(~direct & (follow != text))
    by = np.argsort(text[last], kind="stable")
    last, cuts = last[by], np.searchsorted(text[last][by], np.arange(257))
    sorted_cuts = np.searchsorted(text[chosen], np.arange(257))
    rank, order, at = np.full(n + 1, -1, np.int64), np.empty(n, np.int64), 0
    for c in range(256):
        own = last[cuts[c] : cuts[c + 1]]
        own = own[np.argsort(rank[own + 1], kind="stable")]
        while len(own):
            order[at : at + len(own)] = own
            rank[own] = np.arange(at, at + len(own))
            at += len(own)
            own = own[own > 0] - 1
            own = own[text[own] == c]
        own = chosen[sorted_cuts[c] : sorted_cuts[c + 1]]
        order[at : at + len(own)] = own
        rank[own] = np.arange(at, at + len(own))
        at += len(own)
    return order


#: Rounds of eight bytes in which suffixes are sorted together before those that still agree are compared whole.
ROUNDS = 4


def _eights(text: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray((len(text) + 1,), f"{order}u8", padded, strides=(1,))


def _direct_sort(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the first ``depth`` bytes of the suffixes there; a shorter suffix precedes its extensions."""
    raw, eight, out = text.tobytes(), _eights(text, ">"), np.empty(len(places), np.int64)
    order, group, slot = places, np.zeros(len(places), np.int64), np.arange(len(places))
    for turn in range(min(ROUNDS, depth // 8)):
        # Suffixes that agree so far are a group; each round sorts the groups by their next eight bytes, those that are alone are done.
        key = eight[np.minimum(order + 8 * turn, len(text))].astype(np.uint64)
        by = np.lexsort((key, group))
        order, key, group = order[by], key[by], group[by]
        out[slot] = order
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])[: len(key)]) - 1
        tied = np.bincount(group)[group] > 1
        order, group, slot = order[tied], group[tied], slot[tied]
        if len(order) == 0:
            return out
    cuts = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(group)]
    held, done = order.tolist(), []
    for a, b in zip(cuts, cuts[1:]):
        done += sorted(held[a:b], key=lambda i: raw[i : i + depth])
    out[slot] = done
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, exact: bool = True) -> np.ndarray:
    """For each suffix in ``order`` the length, up to ``most``, of what it shares with the one before it; if not ``exact``, lengths below ``most`` - 7 in steps of eight."""
    n = len(text)
    eight = _eights(text, "<")
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    room = np.minimum(n - np.maximum(order[1:], order[:-1]), most)
    # Eight bytes at a time as far as they agree, then single bytes.
    while len(live):
        at = out[live]
        same = (at + 8 <= room[live - 1]) & (eight[np.minimum(order[live] + at, n)] == eight[np.minimum(order[live - 1] + at, n)])
        live = live[same]
        out[live] += 8
    live = np.arange(1, len(order)) if exact else np.flatnonzero(out > most - 8)
    for _ in range(7):
        at = out[live]
        live = live[at < room[live - 1]]
        at = out[live]
        live = live[text[order[live] + at] == text[order[live - 1] + at]]
        out[live] += 1
    return out


# -- anchors and segments -------------------------------------------------------------------------------------


def _anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Place of the anchor of each string of ``length`` bytes: by blocks of the window's size, from both sides."""
    window = length - gram + 1
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(sums, at, at + gram)
    # The low bits are places, so equal hashes go from left to right.
    bits = np.uint64(24)
    key = np.full(-(-len(h) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = ((h >> bits) << bits) | at.astype(np.uint64)
    grid = key.reshape(-1, window)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(h) - window + 1
    low = np.minimum(right[:count], left[window - 1 : window - 1 + count])
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    return np.stack([place, h[place].view(np.int64)])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor place, anchor hash) of the runs of strings of ``length`` bytes that share an anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(data) - length + 1, STARTS):
        place, h = _anchors(data[lo : lo + STARTS + length - 1], length, gram)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:] - 1, len(place) - 1)
        if out and out[-1][2][-1] == place[0] + lo:
            # The run goes on from the block before.
            out[-1][1][-1] = last[0] + lo
            first, last = first[1:], last[1:]
        if len(first):
            out.append((first + lo, last + lo, place[first] + lo, h[first]))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def text_keys(texts: list[bytes]) -> np.ndarray:
    """The two halves of each text's md5."""
    return np.frombuffer(b"".join(hashlib.md5(t).digest() for t in texts), "<i8").reshape(-1, 2)


def content_keys(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


KEY = ["t1", "t2"]
KIND = ["anchor", "c1", "c2"]


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, anchor, c1, c2, first, last, place): one row for each segment of each whole text; t is the text's key, c that of the segment's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = []
                for text in as_bytes(part.column("text")):
                    if len(text) >= length:
                        first, last, place, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                        key = np.broadcast_to(text_keys([text]), (len(first), 2))
                        content = content_keys([text[a : b + length] for a, b in zip(first.tolist(), last.tolist())])
                        found.append((key[:, 0], key[:, 1], h, content[:, 0], content[:, 1], first, last, place))
                if found:
                    columns = [np.concatenate(x) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:5]), *(pa.array(x.astype(np.int32)) for x in columns[5:])], [*KEY, *KIND, "first", "last", "place"])

    return docs.select("text").mapInArrow(run, "t1 long, t2 long, anchor long, c1 long, c2 long, first int, last int, place int")


RUNS = "array<struct<a:int,b:int>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def sorted_runs(kinds: DataFrame, length: int) -> DataFrame:
    """(anchor, c1, c2, runs): strings, by first and last start in the segment, that another segment of the group holds too.

    ``kinds`` (anchor, c1, c2, n, bytes): different segments, one row each, and how often each occurs. Whole groups are gathered into blocks.
    """

    def sort_block(block: list[tuple]) -> pa.RecordBatch:
        parts = [np.frombuffer(r[3], np.uint8) for r in block]
        text = np.concatenate(parts)
        base = np.cumsum([0, *map(len, parts)])
        order = two_stage_suffix_array(text, length)
        # Strings may not run over a segment's end: only starts of whole strings count.
        start = np.zeros(len(text), bool)
        for lo, p in zip(base, parts):
            start[lo : lo + len(p) - length + 1] = True
        # Suffixes that agree on ``length`` bytes stand together, so those that are no starts can be left out first.
        order = order[start[order]]
        same = common_prefixes(text, order, length, exact=False) >= length
        # An entry of a segment that occurs more than once stands for two suffixes side by side whose common prefix is the whole segment's rest.
        twice = same | np.array([r[4] > 1 for r in block])[np.searchsorted(base, order, "right") - 1]
        twice[:-1] |= same[1:]
        hit = np.zeros(len(text) + 1, bool)
        hit[order[twice]] = True
        rows = []
        for r, lo, p in zip(block, base, parts):
            own = np.diff(np.concatenate([[0], hit[lo : lo + len(p)].astype(np.int8), [0]]))
            a, b = np.flatnonzero(own == 1), np.flatnonzero(own == -1) - 1
            if len(a):
                rows.append((*r[:3], [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())]))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, [pa.int64()] * 3 + [_RUNS])], [*KIND, "runs"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in (*KIND, "bytes", "n"))):
                if group and r[0] != group[0][0]:
                    yield group
                    group = []
                group.append(r)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for group in groups(batches):
            if len(group) == 1 and group[0][4] == 1:  # nothing to share with
                continue
            if size >= BLOCK:
                yield sort_block(block)
                block, size = [], 0
            block += group
            size += sum(len(r[3]) for r in group)
        if block:
            yield sort_block(block)

    dealt = kinds.select(*KIND, "bytes", "n").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, f"anchor long, c1 long, c2 long, runs {RUNS}")


def halves(kinds: DataFrame, length: int) -> DataFrame:
    """(anchor, c1, c2, shift, g, d1, d2, lo, hi, low, high, n, bytes): each segment of ``kinds`` as its strings with the anchor in either half of the group's range.

    A string's offset is the anchor's place in it; a segment's offsets go from ``hi`` at its first start to ``lo`` at its last. ``low`` and ``high``
    bound the group's offsets. All strings with offsets in [low, high] hold the bytes around the anchor that g is a hash of.
    """
    names = [*KIND, "shift", "g", "d1", "d2", "lo", "hi", "low", "high", "n", "bytes"]
    kinds_ = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, c1, c2, lo, hi, low, high, n, text in zip(*(batch.column(c).to_pylist() for c in (*KIND, "lo", "hi", "low", "high", "n", "bytes"))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    own_lo, own_hi = max(lo, a), min(hi, b)
                    if own_lo > own_hi or a > b:
                        continue
                    shift = hi - own_hi
                    part = text[shift : hi - own_lo + length]
                    core = text[hi - a : hi - b + length]  # that is a to the left of the anchor, as it stands at ``hi``, to the end of string ``b``
                    g = xxhash.xxh3_64_intdigest(core + b"%d:%d:%d" % (anchor, a, b)) - (1 << 63)
                    rows.append((anchor, c1, c2, shift, g, *content_keys([part])[0].tolist(), own_lo, own_hi, a, b, n, part))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(names), kinds_)], names)

    return kinds.mapInArrow(run, "anchor long, c1 long, c2 long, shift int, g long, d1 long, d2 long, lo int, hi int, low int, high int, n long, bytes binary")


def shared_runs(kinds: DataFrame, length: int, depth: int = 0) -> DataFrame:
    """(anchor, c1, c2, runs) as sorted_runs(), for groups of any size; ``kinds`` (anchor, c1, c2, n, lo, hi, low, high, bytes) is a written table."""
    # Only the anchors of large groups are sent, one for every GIANT segments at most, and no task gathers such a group: its segments are halved where they are read.
    large = staged(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > GIANT).select("anchor"), f"suffix-large-{depth}")
    if large.isEmpty():
        return sorted_runs(kinds, length)
    found = sorted_runs(kinds.join(F.broadcast(large), "anchor", "left_anti"), length)
    parts = staged(halves(kinds.join(F.broadcast(large), "anchor"), length), f"suffix-halves-{depth}")
    whole = parts.groupBy("g", "d1", "d2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("lo", "hi", "low", "high", "bytes")))
    whole = staged(whole, f"suffix-parts-{depth}")
    renamed = {"g": "anchor", "d1": "c1", "d2": "c2"}
    inner = staged(shared_runs(whole.withColumnsRenamed(renamed), length, depth + 1), f"suffix-runs-{depth}")
    own = inner.withColumnsRenamed({v: k for k, v in renamed.items()})
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
    back = parts.drop("bytes").join(own, ["g", "d1", "d2"]).select(*KIND, moved.alias("runs")).groupBy(*KIND).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return found.unionByName(back)


def segment_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, c1, c2, n, lo, hi, bytes) of the segments in ``wanted`` (t1, t2, anchor, c1, c2, n, first, last, place), a written table."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("t1").distinct(), "t1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [t for t in as_bytes(part.column("text")) if len(t) >= length]
                keys = text_keys(texts)
                rows = []
                for k in np.flatnonzero(maybe(bits, np.ascontiguousarray(keys[:, 0]))).tolist() if texts else ():
                    key = tuple(keys[k].tolist())
                    if key not in seen:  # one of a task's copies is enough
                        seen.add(key)
                        rows.append((*key, texts[k]))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.binary()))], [*KEY, "text"])

    own = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*KIND, "n", "first", "last", "place")).alias("own"))
    rows = docs.select("text").mapInArrow(run, "t1 long, t2 long, text binary").join(own, KEY).select("text", F.explode("own").alias("x"))
    cut = F.substring(F.col("text"), F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + length)
    return rows.select("x.anchor", "x.c1", "x.c2", "x.n", (F.col("x.place") - F.col("x.last")).alias("lo"), (F.col("x.place") - F.col("x.first")).alias("hi"), cut.alias("bytes"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, spans array<struct<a, b>>): first and last starts of strings of ``length`` bytes that also start elsewhere."""
    found = staged(segments(docs, length, gram), "suffix-segments")
    twice = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Segments whose anchor occurs once go. Both sides and the result are written tables, so that a common anchor's rows can be split among tasks.
    rows = staged(found.join(staged(twice, "suffix-anchors"), "anchor"), "suffix-repeats")
    # All first() see the same rows in the same order, so they give one segment's values.
    kinds = rows.groupBy(*KIND).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*KEY, "first", "last", "place")))
    cuts = staged(segment_bytes(docs, staged(kinds, "suffix-kinds"), length), "suffix-cuts")
    cuts = cuts.dropDuplicates(KIND).withColumns({"low": F.lit(0), "high": F.lit(length - gram)})
    runs = staged(shared_runs(staged(cuts, "suffix-bytes"), length), "suffix-runs")
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    hits = rows.join(runs, KIND).select(*KEY, F.explode(moved).alias("x"))
    # Copies of a text have equal segments, so each is gathered once.
    return hits.distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every row; bytes of a character that a span cuts are no part of the text."""
    spark = small_batches(docs.sparkSession)
    spans = staged(repeated_starts(docs, length, gram), "suffix-spans")
    sent = spark.sparkContext.broadcast(id_filter(spans, "t1"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def results(ids: pa.Array, texts: list[bytes], spans: list) -> pa.RecordBatch:
        rows = []
        for text, own in zip(texts, spans):
            kept, removed, merged, at = [], 0, 0, -1
            for s in own or ():
                lo, hi = s["a"], s["b"] + length
                if lo > at:
                    merged += 1
                    kept.append(text[max(at, 0) : lo])
                removed += hi - max(lo, at) if hi > at else 0
                at = max(at, hi)
            kept.append(text[max(at, 0) :])
            left = b"".join(kept)
            rows.append((len(text), removed, merged, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None)[: 4 + keep_text])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                texts = as_bytes(part.column("text"))
                keys = text_keys(texts)
                yield part, texts, keys, maybe(sent.value, np.ascontiguousarray(keys[:, 0]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, _, hit in parted(batches):
            if not hit.all():
                at = np.flatnonzero(~hit)
                yield results(part.column("doc_id").take(pa.array(at)), [texts[i] for i in at.tolist()], [None] * len(at))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, keys, hit in parted(batches):
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), part.column("doc_id").take(pa.array(at)).cast(pa.int64()), pa.array([texts[i] for i in at.tolist()], pa.binary())], [*KEY, "doc_id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                yield results(part.column("doc_id"), part.column("text").to_pylist(), part.column("spans").to_pylist())

    rows = docs.select("doc_id", "text")
    touched = rows.mapInArrow(some, "t1 long, t2 long, doc_id long, text binary").join(spans, KEY, "left")
    return rows.mapInArrow(whole, schema).unionByName(touched.select("doc_id", "text", "spans").mapInArrow(cut, schema))

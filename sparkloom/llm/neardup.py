"""MinHash near-duplicates by an LSH forest.

A text's set holds the 64-bit hashes of its distinct word shingles (A-Z lower-cased, words between ASCII
white space; a shorter text is one shingle). Equal sets are one node, so exact copies never multiply.
Each node gets a MinHash signature. The forest is ORDERS sorted orders, each of another sequence of DEPTH
signature values: rows that share the first LEAST values are a region, sorted by the rest, so that a
row's neighbours are those with the longest common prefix. How deep a prefix decides thus follows from how
crowded the region is. Neighbours whose signatures agree enough are candidates; full sets confirm them:
100 * intersection >= THRESHOLD * union. A first round links nearest neighbours of a few orders; a second
takes NEIGHBOURS neighbours in all orders, for pairs that the first left apart. Links give components.
Where a region holds more rows than that and they are in several components, an exact join on the rarest
shingles of their full sets decides the pairs that no order looked at, so crowded regions lose no link.

Rows without words (null, empty or blank texts) have an empty set and are linked with nothing. Rows with
equal doc_id are one document. Rows with a null doc_id are not linked: their component_id is null and they
are kept. Other columns do not matter, whatever their names. Empty tables give empty results. Very long texts
and words are handled whole, hashed in blocks, so that a worker needs a few times the text and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, components, distinct, id_filter, maybe, mix, small_batches, staged, text_slices, word_hashes

VALUES, ORDERS, DEPTH, LEAST = 64, 32, 8, 4
FIRST_ORDERS, NEIGHBOURS = 6, 4
#: Share of equal signature values below which a pair is no candidate: at a similarity of 0.8 that is six deviations low, missed once in ten million pairs.
ESTIMATE = 0.5
#: Bytes of text that a task works on at once.
SLICE = 1 << 18
THRESHOLD = 80
#: Bits of the marks that bound from below how many shingles only one of two sets has.
MARKS = 512

_RANDOM = np.random.default_rng(20240101)
_FACTORS = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
#: The signature positions that each order sorts by.
SEQUENCES = np.stack([_RANDOM.permutation(VALUES)[:DEPTH] for _ in range(ORDERS)])


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    start, word = word_hashes(data)
    del data
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, bounds)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    if len(word) >= words:
        shingle = np.zeros(len(word) - words + 1, np.uint64)
        for k in range(words):
            shingle += word[k : k + len(shingle)] * factors[k]
        shingle = mix(shingle)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(distinct(shingle[a : b - words + 1]))
        elif b > a:
            out.append(mix((word[a:b] * factors[: b - a]).sum(dtype=np.uint64)[None] + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set: VALUES 32-bit values."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        own = hashes[i : i + 1024, None] ^ _MASKS
        own *= _FACTORS
        np.minimum(low, own.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def parity_marks(hashes: np.ndarray) -> bytes:
    """For each of MARKS hash values whether an odd number of the set's shingles has it: where two marks differ, only one of the sets has some shingle."""
    return np.packbits(np.bincount((hashes % np.uint64(MARKS)).astype(np.int64), minlength=MARKS).astype(np.uint8) & 1).tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, marks) of every row; all but the first two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                sets = shingle_sets(as_bytes(part.column("text")), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([parity_marks(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "signature", "marks"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, marks binary")


def forest(nodes: DataFrame) -> DataFrame:
    """(region, rest, place, node): each node at its place in every order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), ">u4").reshape(-1, VALUES)
                n = len(sig)
                took = sig[:, SEQUENCES].transpose(1, 0, 2)  # order, node, depth
                region = np.broadcast_to(mix(np.arange(1, ORDERS + 1, dtype=np.uint64))[:, None], (ORDERS, n)).copy()
                for d in range(LEAST):
                    region = mix(region ^ took[:, :, d].astype(np.uint64))
                rest = np.ascontiguousarray(took[:, :, LEAST:]).astype(">u4").reshape(ORDERS * n, DEPTH - LEAST)
                raw = rest.tobytes()
                width = 4 * (DEPTH - LEAST)
                node = part.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(region.reshape(-1).view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), ORDERS * n, [None, pa.py_buffer(raw)]).cast(pa.binary()),
                        pa.array(np.repeat(np.arange(ORDERS, dtype=np.int32), n)),
                        pa.array(np.tile(node, ORDERS)),
                    ],
                    ["region", "rest", "place", "node"],
                )

    return nodes.select("node", "signature").mapInArrow(run, "region long, rest binary, place int, node long")


ROW = "kind int, region long, node long, other long, place int, task int, at long"
PAIR, CROWDED, EDGE = range(3)


def _beside(region: np.ndarray, node: np.ndarray, place: np.ndarray, task: np.ndarray, at: np.ndarray, known: int, across: bool) -> pa.RecordBatch:
    """Rows of ROW for sorted rows, those from ``known`` on being new: neighbours in a region, and rows whose regions go on beyond NEIGHBOURS.

    ``across``: only what lies in different tasks.
    """
    out = []
    for k in range(1, NEIGHBOURS + 2):
        i = np.flatnonzero(region[k:] == region[:-k]) if len(region) > k else np.empty(0, np.int64)
        i = i[i + k >= known]
        if across:
            i = i[task[i] != task[i + k]]
        if k <= NEIGHBOURS:
            out.append((np.full(len(i), PAIR), region[i], node[i], node[i + k], np.where(k == 1, place[i], ORDERS), task[i], at[i]))
        else:
            out += [(np.full(len(i), CROWDED), region[j], node[j], node[j], place[j], task[j], at[j]) for j in (i, i + k)]
    return _rows(*(np.concatenate(x) for x in zip(*out)))


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ROW.split(", ")])


def neighbours(nodes: DataFrame) -> DataFrame:
    """Rows of ROW: neighbours (PAIR; place is ORDERS unless they are next to each other) and rows whose regions hold more (CROWDED).

    All orders are sorted as one, by ranges, so a region of any size is dealt over as many tasks as it needs. Each
    task hands on its first and last rows (EDGE), which are linked across tasks after that: a few rows for each task.
    """
    reach = NEIGHBOURS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = TaskContext.get().partitionId(), 0
        tail = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([t, batch.column(c).to_numpy().astype(np.int64)]) for t, c in zip(tail, ("region", "node", "place"))]
            known, n = len(tail[0]), len(rows[0])
            index = np.arange(at - known, at - known + n)
            yield _beside(*rows, np.full(n, own), index, known, False)
            head = (index < reach) & (index >= at)
            yield _rows(np.full(head.sum(), EDGE), rows[0][head], rows[1][head], rows[1][head], rows[2][head], np.full(head.sum(), own), index[head])
            at += n - known
            tail = [x[-reach:] for x in rows]
        index = np.arange(at - len(tail[0]), at)
        last = index >= reach
        yield _rows(np.full(last.sum(), EDGE), tail[0][last], tail[1][last], tail[1][last], tail[2][last], np.full(last.sum(), own), index[last])

    def run_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, np.int64)] * 5
        for batch in batches:
            rows = [np.concatenate([t, batch.column(c).to_numpy().astype(np.int64)]) for t, c in zip(tail, ("region", "node", "place", "task", "at"))]
            yield _beside(*rows, len(tail[0]), True)
            tail = [x[-reach:] for x in rows]

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["region", "rest", "node"]
    dealt = forest(nodes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    inner = staged(dealt.select("region", "node", "place").mapInArrow(run, ROW), "neardup-neighbours")
    edges = inner.where(F.col("kind") == EDGE).coalesce(1).sortWithinPartitions("task", "at").mapInArrow(run_edges, ROW)
    return inner.where(F.col("kind") != EDGE).unionByName(edges)


def candidates(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, first): neighbours in some order whose signatures agree in ESTIMATE of their values and whose marks allow THRESHOLD; ``first``: in the first round."""
    pairs = near.where((F.col("kind") == PAIR) & (F.col("node") != F.col("other")))
    pairs = pairs.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.max(F.col("place") < FIRST_ORDERS).alias("first"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"), F.col("marks").alias(f"m{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, VALUES) for c in ("sa", "sb"))
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MARKS // 8) for c in ("ma", "mb"))
            differ = np.unpackbits(u ^ v, axis=1).sum(axis=1, dtype=np.int64)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = pa.array(((x == y).mean(axis=1) >= ESTIMATE) & ((100 + THRESHOLD) * differ <= (100 - THRESHOLD) * total))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "first")], ["a", "b", "first"])

    return both.mapInArrow(agree, "a long, b long, first boolean")


def undecided(near: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, group): nodes whose crowded regions hold several groups, so that pairs of them were not looked at."""
    group = groups.select(F.col("id").alias("node"), "component")
    crowded = near.where(F.col("kind") == CROWDED).select("region", "node").distinct().join(group, "node", "left").withColumn("group", F.coalesce("component", "node"))
    mixed = crowded.groupBy("region").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("region")
    return crowded.join(mixed, "region", "left_semi").select("node", "group").distinct()


def with_marks(sets: DataFrame) -> DataFrame:
    """``sets`` (node, hashes) with their parity_marks() as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            marks = np.frombuffer(b"".join(parity_marks(values[i:j]) for i, j in zip(bounds[:-1], bounds[1:])), np.int64)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (MARKS // 64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(marks))], ["node", "hashes", "marks"])

    return sets.mapInArrow(run, "node long, hashes array<long>, marks array<long>")


def exact_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, group) from different groups that may reach THRESHOLD; no such pair is missed.

    Prefix filtering: of two sets that are similar enough, the rarest (1 - THRESHOLD) of each, and one more, have a shingle in
    common. Shingles that only one group has come first in the order, as they link nothing; most sets end within them.
    Two bounds hold for every similar pair, and pairs beyond them are not made: at the first shingle in common, what follows
    it in each set bounds the intersection; and marks that differ are shingles that only one of the sets has.
    """
    own = with_marks(sets).join(nodes, "node").select("node", "group", "marks", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    shared = own.groupBy("h").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("h", "n")
    held = own.join(shared, "h").groupBy("node", "group", "size").agg(F.first("marks").alias("marks"), F.collect_list(F.struct("n", "h")).alias("x"))
    room = F.expr(f"size - (size * {THRESHOLD} + 99) div 100 + 1 - (size - size(x))").cast("int")
    first = held.withColumn("room", room).where("room > 0").select("node", "group", "size", "marks", F.size("x").alias("left"), F.posexplode(F.slice(F.array_sort("x"), F.lit(1), F.col("room"))["h"]).alias("at", "h"))
    first = staged(first.withColumn("left", F.col("left") - F.col("at")).drop("at"), "neardup-prefixes")
    ends = staged(first.groupBy("h").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi"), "neardup-buckets")
    # Written, so that a bucket's rows are dealt anew on both sides of the join and can be split among tasks.
    held = staged(first.join(ends, "h"), "neardup-held")
    # With two groups in a bucket, each side holds one of them.
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "group", "size", "marks", "left")]
    a = held.where("group < hi").select("h", *side("a"))
    b = held.where("group > lo").select("h", *side("b"))
    follows = f"{100 + THRESHOLD} * least(left_a, left_b) >= {THRESHOLD} * (size_a + size_b)"
    differ = " + ".join(f"bit_count(marks_a[{i}] ^ marks_b[{i}])" for i in range(MARKS // 64))
    near = f"group_a < group_b and {follows} and {100 + THRESHOLD} * ({differ}) <= {100 - THRESHOLD} * (size_a + size_b)"
    return a.join(b, "h").where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes) for the ids in ``wanted`` (node), a written table.

    Texts are not shuffled: a fixed-size filter of the wanted ids is sent, tasks make the sets of the texts that it lets pass, and a
    join of the sets drops those that are not wanted. As long as the filter is not full, nearly only wanted sets are shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column("doc_id")))
            ids = known.column("doc_id").cast(pa.int64()).to_numpy()
            for part in text_slices(known.filter(pa.array(maybe(bits, ids))), "text", SLICE):
                sets = shingle_sets(as_bytes(part.column("text")), words)
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "hashes"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "node long, hashes array<long>")
    return rows.join(wanted, "node", "left_semi").dropDuplicates(["node", "hashes"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach THRESHOLD."""
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"node": "b", "hashes": "hb"}), "b")
    # The lesser set bounds the similarity, so sizes come first.
    sized = both.where(100 * F.least(F.size("ha"), F.size("hb")) >= THRESHOLD * F.greatest(F.size("ha"), F.size("hb")))
    shared = sized.select("a", "b", (F.size("ha") + F.size("hb")).alias("total"), F.size(F.array_intersect("ha", "hb")).alias("n"))
    return shared.where(100 * F.col("n") >= THRESHOLD * (F.col("total") - F.col("n"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    small_batches(docs.sparkSession)
    rows = staged(sketches(docs, words), "neardup-sketches")
    linkable = rows.where("doc_id is not null and set_key is not null")
    nodes = staged(linkable.groupBy("set_key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("signature", "marks", "n_shingles"))), "neardup-nodes")
    near = staged(neighbours(nodes), "neardup-near")
    found = staged(candidates(near, nodes), "neardup-candidates")
    wanted = staged(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "neardup-wanted")
    sets = staged(full_sets(docs, wanted, words), "neardup-sets")
    links = staged(confirmed(found.where("first"), sets), "neardup-links-1")
    groups = components(links, "neardup-groups-1")
    group = lambda side: groups.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    apart = found.where("not first").join(group("a"), "a", "left").join(group("b"), "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    more = staged(confirmed(apart, sets), "neardup-links-2")
    groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "neardup-groups-2")
    rest = staged(undecided(near, groups), "neardup-undecided")
    sets = staged(full_sets(docs, rest, words), "neardup-sets-3")
    exact = staged(confirmed(staged(exact_pairs(sets, rest), "neardup-exact"), sets), "neardup-links-3")
    # Rows of one document with different sets are one document, too.
    same = linkable.select("set_key", "doc_id").distinct().join(nodes.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(exact).unionByName(same), "neardup-groups-3")
    found = rows.select("doc_id", "n_shingles").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` without the documents that near_duplicates() does not keep; all columns stay."""
    gone = near_duplicates(docs, words).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")

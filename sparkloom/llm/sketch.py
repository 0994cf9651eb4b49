"""Document fingerprints by threshold-scaled sketches: of the hashes of a text's shingles all below a fixed fraction of their range are kept.

Whether a shingle is kept depends on its hash alone, so sketches of texts of any length can be compared: the share of a small text's hashes
that a large text's sketch holds estimates the share of its shingles that the large text has, whatever the sizes. The sketch of a union is the
union of the sketches. A text none of whose hashes is below the fraction keeps its smallest one, so that only texts without words have an
empty sketch. Shingles are WORDS words long, of words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a shorter text is one shingle.

A sketch needs its own text only: one pass, no shuffle. Null texts count as empty: no hashes. Two empty sketches have a likeness of 1, an empty
and another one of 0. Repeated rows, null ids and further columns do not matter; very long texts are hashed in blocks of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged, text_slices
from .neardup import shingle_sets

#: One hash in FRACTION is kept.
FRACTION, WORDS = 8, 5


def sketches(texts: list[bytes], fraction: int = FRACTION, words: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes that each text keeps."""
    limit, out = np.uint64((1 << 64) // fraction - 1), []
    for own in shingle_sets(texts, words):
        kept = own[: np.searchsorted(own, limit, "right")]
        out.append(kept if len(kept) else own[:1])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other text holds."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def packed(hashes: np.ndarray) -> bytes:
    """A sketch as bytes: its hashes in order, eight bytes each."""
    return hashes.astype(">u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def fingerprint(raw: Column) -> Column:
    """The text form of a packed sketch: 16 hex digits for each hash."""
    return F.lower(F.hex(raw))


def fingerprints(docs: DataFrame, fraction: int = FRACTION, words: int = WORDS) -> DataFrame:
    """(doc_id, n_hashes, sketch binary) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = sketches(as_bytes(part.column("text")), fraction, words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(map(len, own), pa.int64()), pa.array(map(packed, own), pa.binary())], ["doc_id", "n_hashes", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_hashes long, sketch binary")


def hashes(found: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches as rows (keys, hash string): the form in which they are merged and joined, so that no set is held whole."""
    each = F.regexp_extract_all(F.hex("sketch"), F.lit("([0-9A-F]{16})"), 1)
    return found.select(*keys, F.explode(each).alias("hash"))


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of all texts of a group as one: the distinct rows (by, hash) of ``rows``."""
    return rows.select(*by, "hash").distinct()


def containments(small: DataFrame, large: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, shared, share) of all sketches of ``small`` (a, hash) and ``large`` (b, hash) that share a hash: ``share`` estimates how much of a is in b."""
    sizes = small.groupBy(a).agg(F.count("*").alias("size"))
    pairs = small.join(large, "hash").groupBy(a, b).agg(F.count("*").alias("shared"))
    return pairs.join(sizes, a).select(a, b, "shared", (F.col("shared") / F.col("size")).alias("share"))


# -- documents against edits of themselves ----------------------------------------------------------------------------


def _judged(doc_id: int | None, text: str, own: np.ndarray, after: str, other: np.ndarray, fraction: int, words: int) -> tuple:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + after[:cut]).encode()
    new = sketches([edited], fraction, words)[0]
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), packed(own), packed(new), likeness(own, new), likeness(own, other)


_RESULT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "sketch": pa.binary(), "edited_sketch": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double"
#: What a sorted part gives: finished rows, its first document (for the part before), its last one (which waits for the part after).
DONE, FIRST, LAST = 0, 1, 2


def edit_trial(docs: DataFrame, fraction: int = FRACTION, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next): each text's sketch against that of an edit and of the next text.

    The edit replaces the last third of a text by the start of the next document, in descending order of ids (null ids last, rows with equal ids
    by a hash of their texts), the first document after the last one. Texts are shuffled once, into sorted parts; of each part only the first and last
    document wait for another part.
    """
    spark = small_batches(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                texts = as_bytes(piece.column("text"))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(map(len, texts), pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in texts], pa.binary())], ["doc_id", "tie", "row", "size", "text"])

    # Texts cross the shuffle compressed one by one, better than its own codec does.
    rows = rows.mapInArrow(pressed, "doc_id long, tie long, row long, size long, text binary")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.string(), *_RESULT.values()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "kind", "text", *_RESULT])

        waiting = lambda kind, doc_id, text, own: (part, kind, text, doc_id, None, None, packed(own), None, None, None)
        for batch in batches:
            for piece in text_slices(batch, "text", 1 << 18):
                raw = [pa.decompress(x, n, "zstd", asbytes=True) if n else b"" for x, n in zip(piece.column("text").to_pylist(), piece.column("size").to_pylist())]
                out = []
                for now in zip(piece.column("doc_id").to_pylist(), [x.decode() for x in raw], sketches(raw, fraction, words)):
                    if held is None:
                        out.append(waiting(FIRST, *now))
                    else:
                        out.append((part, DONE, None, *_judged(*held, *now[1:], fraction, words)))
                    held = now
                if out:
                    yield made(out)
        if held is not None:
            yield made([waiting(LAST, *held)])

    found = staged(dealt.mapInArrow(run, f"part int, kind int, text string, {_SCHEMA}"), "sketch-trial")
    done = found.where(F.col("kind") == DONE).select(*_RESULT)
    # One number for each part.
    parts = sorted(r["part"] for r in found.where(F.col("kind") == FIRST).select("part").collect())
    if not parts:
        return done
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follower int")
    last = found.where(F.col("kind") == LAST).select("part", "doc_id", "text", "sketch").join(follows, "part")
    first = found.where(F.col("kind") == FIRST).select(F.col("part").alias("follower"), F.col("text").alias("after"), F.col("sketch").alias("other"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row = _judged(r["doc_id"], r["text"], unpacked(r["sketch"]), r["after"], unpacked(r["other"]), fraction, words)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _RESULT.values())], list(_RESULT))

    return done.unionByName(last.join(first, "follower").select("doc_id", "text", "sketch", "after", "other").mapInArrow(ends, _SCHEMA))

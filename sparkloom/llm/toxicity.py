"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Each document is the set of its lower-cased character n-grams, hashed to BUCKETS. Labelled texts
give each n-gram the ratio r = log((p + 0.5) / (n + 1)) - log((q + 0.5) / (m + 1)) of its smoothed document
counts p among the n toxic and q among the m other documents; the ``keep`` n-grams with the strongest evidence (chi-square
of presence against the label) among those in ``least`` sampled documents or more stay, and logistic regression is fitted on the set features times r. Labels, language, source and id are no inputs.

Training uses about ``sample_rows`` labelled rows at most (chosen by a hash of the id); scoring covers
all rows and whole texts. Null and empty texts get the score of a text without any n-gram. Rows with
a null label or without a text do not train; several labels of one id count as their maximum. Repeated
rows get equal scores. Without both classes among the labels every score is the share of toxic labels. Very long texts
are scored whole, with work space in proportion to the longest one. Empty tables give empty results. Other columns pass
as they are; only a column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, distinct, small_batches, staged, text_slices

SIZES = (3, 4, 5, 6)
BITS = 19
BUCKETS = 1 << BITS
#: Features of the model, and sampled documents that one must occur in.
KEEP, LEAST = 3_000, 3
SAMPLE_ROWS = 8_000


@dataclass
class ToxicityModel:
    """Feature number of each bucket (-1: none), feature weights and intercept."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float


def hashed_ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of the n-gram at each character, document of each character) for each n of SIZES."""
    points = [np.frombuffer(t.decode().lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    chars, doc = np.concatenate(points), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(chars) - n + 1] if n > 1 else h
        if len(h) == 0:
            return
        h = h * np.uint32(0x01000193) + chars[n - 1 :]
        if n in SIZES:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            inside = doc[: len(h)] == doc[n - 1 :]
            yield np.where(inside, x >> np.uint32(32 - BITS), BUCKETS).astype(np.int32), doc


def present(texts: list[bytes], feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; ``feature`` maps buckets and, last, the mark of n-grams across two texts."""
    found = [np.empty(0, np.int64)]
    for bucket, doc in hashed_ngrams(texts):
        f = feature[bucket]
        at = np.flatnonzero(f >= 0)
        found.append(doc[at].astype(np.int64) << 32 | f[at])
    pair = distinct(np.concatenate(found))
    return (pair >> 32).astype(np.int64), (pair & 0xFFFFFFFF).astype(np.int64)


def document_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents with each bucket among (other, toxic) rows and the number of those rows; BUCKETS rows come back at most."""
    everything = np.arange(BUCKETS + 1, dtype=np.int32)
    everything[-1] = -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 18):
                label = part.column("toxic").to_numpy()
                doc, bucket = present(as_bytes(part.column("text")), everything)
                for y in (0, 1):
                    total[y, :BUCKETS] += np.bincount(bucket[label[doc] == y], minlength=BUCKETS)
                    total[y, BUCKETS] += int((label == y).sum())
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "other", "toxic"])

    found = sample.mapInArrow(count, "bucket int, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    for y, name in enumerate(("other", "toxic")):
        out[y, found.column("bucket").to_numpy()] = found.column(name).to_numpy()
    return out[0, :BUCKETS], out[1, :BUCKETS], int(out[0, BUCKETS]), int(out[1, BUCKETS])


def fit_logistic(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of L2-regularised logistic regression on sparse rows whose values are ``scale[col]`` (Adam, full batch)."""
    n, k, value = len(y), len(scale), scale[col]
    w = np.zeros(k + 1)
    w[k] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col] * value, minlength=n) + w[k]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.append(np.bincount(col, weights=d[row] * value, minlength=k) + l2 * w[:k] / 2, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * 0.985 ** (t / 2) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:k], float(w[k])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep: int = KEEP, least: int = LEAST) -> ToxicityModel:
    """Fits on the rows of ``docs`` that ``labels`` (doc_id, toxic) marks, about ``sample_rows`` of them at most, with ``keep`` features."""
    small_batches(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample's size is bounded by sample_rows, so the broadcast is, too.
    sample = staged(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")
    other, toxic, n0, n1 = document_counts(sample)
    feature = np.full(BUCKETS + 1, -1, np.int32)
    if not n0 or not n1:
        share = (n1 + 1e-3) / (n0 + n1 + 2e-3)
        return ToxicityModel(feature, np.zeros(0), float(np.log(share / (1 - share))))
    p, q = toxic + 0.5, other + 0.5
    r = np.log(p / (n1 + 1)) - np.log(q / (n0 + 1))
    # Evidence is the chi-square of presence against the label.
    seen, both = (other + toxic).astype(float), float(n0 + n1)
    strength = (toxic * (n0 - other.astype(float)) - other * (n1 - toxic.astype(float))) ** 2 * both / ((seen + 1) * (both - seen + 1) * n0 * n1)
    at = np.sort(np.argsort(-np.where(seen >= least, strength, 0), kind="stable")[:keep])
    feature[at] = np.arange(len(at))
    lookup = feature

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                doc, f = present(as_bytes(part.column("text")), lookup)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = pa.array([f[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([own, part.column("toxic")], ["features", "toxic"])

    data = sample.mapInArrow(rows, "features binary, toxic int").toArrow()
    lists = [np.frombuffer(x, "<i4") for x in data.column("features").to_pylist()]
    row, col = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
    scale = r[at]
    w, b = fit_logistic(row, col, scale, data.column("toxic").to_numpy().astype(float))
    return ToxicityModel(feature, w * scale, b)


def score(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """``docs`` with the probability ``out`` (0 to 1) that each whole text is toxic; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model.feature, model.weight, model.bias))
    docs = docs.drop(out)
    names = [*docs.columns, out]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, weight, bias = sent.value
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                doc, f = present(as_bytes(part.column("text")), feature)
                z = np.bincount(doc, weights=weight[f], minlength=part.num_rows) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names)

    return docs.mapInArrow(run, schema)

"""Exact k-means over integer vectors with Drake's adaptive bounds.

Each vector keeps an upper bound of its distance to its own centroid, lower bounds of its distances to the next nearest ones (``ids``, ``low``) and one
lower bound for all the rest. When centroids move, bounds give way by the distances moved. A vector whose upper bound is below all
lower ones stays; else its own distance is computed, then those of the listed centroids that could be nearer, and only where the bound of the rest
does not hold are all centroids scanned again. The number of bounds starts at a quarter of the centroids and falls, down to an eighth, to the most
that a vector of the round before needed. Bounds are floating-point numbers and give way by a little more than they must;
every distance that decides is computed in integers, so the result is that of full scans, ties (the smaller number) included.

Vectors with a null, a non-finite component or another length are left out; rows with equal or null ids are vectors of their own. An empty table
has an empty result, fewer vectors than centroids give fewer centroids. Repeated vectors are equal in all but their ids. Components too large
for exact floating-point products are worked on as Python integers; a distance or inertia that does not fit a long is null. Further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Integers up to this are exact in all products and sums of SIZE components.
EXACT = 1 << 20
#: By how much bounds give way to rounding.
SLACK = 1e-9


def usable(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, x array<double>): vectors of ``size`` finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return kept.where((F.size("x") == size) & F.forall("x", finite))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) / scale, for a power of two: exact, and without overflow."""
    wide = np.abs(x) >= 2.0**52
    return np.where(wide, x, np.floor(np.where(wide, 0.0, x) * scale) / scale)


def integers(y: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``y`` times ``scale`` as floating-point numbers where all are exact, else as Python integers."""
    if y.size == 0 or np.abs(y).max() * scale <= EXACT:
        return y * scale
    return np.array([[int(v) * scale if abs(v) >= 2.0**52 else int(v * scale) for v in row] for row in y.tolist()], object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    if x.dtype == object or c.dtype == object:
        return np.stack([((x.astype(object) - row) ** 2).sum(axis=1) for row in c.astype(object)], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to the same row of ``c``."""
    d = x - c
    return (d * d).sum(axis=-1)


def root_of(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def centroid_array(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(v) > EXACT for row in rows for v in row)
    return np.array(rows, object if big else np.float64)


class Bounds:
    """What is known of each vector: its centroid, the upper bound, listed centroids with lower bounds, the bound of the rest, how many bounds it needed."""

    NAMES = ["cluster", "upper", "ids", "low", "rest", "used"]

    def __init__(self, n: int, width: int):
        self.cluster, self.upper, self.rest = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.ids, self.low, self.used = np.zeros((n, width), np.int64), np.zeros((n, width)), np.zeros(n, np.int64)

    def scan(self, at: np.ndarray, x: np.ndarray, c: np.ndarray) -> None:
        """All distances of the vectors ``at``, and fresh bounds."""
        if len(at) == 0:
            return
        d, width = squared(x[at], c), self.ids.shape[1]
        order = np.argsort(d, axis=1, kind="stable")
        far = root_of(np.take_along_axis(d, order, axis=1))
        self.cluster[at], self.upper[at] = order[:, 0], far[:, 0] * (1 + SLACK)
        self.ids[at], self.low[at] = order[:, 1 : width + 1], far[:, 1 : width + 1] * (1 - SLACK)
        self.rest[at] = far[:, width + 1] * (1 - SLACK) if len(c) > width + 1 else np.inf

    def move(self, moved: np.ndarray) -> None:
        """Gives way to centroids that moved so far."""
        self.upper = (self.upper + moved[self.cluster]) * (1 + SLACK)
        self.low = self.low - moved[self.ids] - SLACK * np.abs(self.low)
        self.rest = self.rest - moved.max() - SLACK * np.where(np.isinf(self.rest), 0, np.abs(self.rest))

    def narrow(self, width: int) -> None:
        """Keeps the ``width`` smallest lower bounds; the others join the rest."""
        if width < self.ids.shape[1]:
            order = np.argsort(self.low, axis=1, kind="stable")
            self.ids, self.low = np.take_along_axis(self.ids, order, axis=1), np.take_along_axis(self.low, order, axis=1)
            self.rest = np.minimum(self.rest, self.low[:, width])
            self.ids, self.low = self.ids[:, :width], self.low[:, :width]

    def assign(self, x: np.ndarray, c: np.ndarray) -> int:
        """Nearest centroids of all vectors; gives how many were scanned in full."""
        self.used[:] = 0
        least = np.minimum(self.low.min(axis=1, initial=np.inf), self.rest)
        at = np.flatnonzero(self.upper >= least)
        own = paired(x[at], c[self.cluster[at]])
        self.upper[at] = root_of(own) * (1 + SLACK)
        open_ = self.upper[at] >= least[at]
        at, own = at[open_], own[open_]
        lost = self.rest[at] <= self.upper[at]
        again = at[lost]
        at, own = at[~lost], own[~lost]
        # Listed centroids that could be nearer; all others are farther for certain.
        near = self.low[at] <= self.upper[at][:, None]
        rows, slots = np.nonzero(near)
        d = paired(x[at[rows]], c[self.ids[at[rows], slots]])
        self.low[at[rows], slots] = root_of(d) * (1 - SLACK)
        self.used[at] = near.sum(axis=1)
        best, where = own.copy(), np.full(len(at), -1)
        for row, slot, value in zip(rows.tolist(), slots.tolist(), d.tolist()):
            held = self.cluster[at[row]] if where[row] < 0 else self.ids[at[row], where[row]]
            if value < best[row] or value == best[row] and self.ids[at[row], slot] < held:
                best[row], where[row] = value, slot
        row = np.flatnonzero(where >= 0)
        i, slot, old = at[row], where[row], self.cluster[at[row]]
        self.cluster[i], self.ids[i, slot] = self.ids[i, slot], old
        self.low[i, slot] = root_of(own[row]) * (1 - SLACK)
        self.upper[i] = root_of(best[row]) * (1 + SLACK)
        self.scan(again, x, c)
        self.used[again] = self.ids.shape[1]
        return len(again)


_STATE = "vec_id long, y array<double>, cluster int, upper double, ids array<short>, low array<double>, rest double, used int, scanned int, distance decimal(38,0)"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def _state(ids: pa.Array, y: np.ndarray, b: Bounds, scanned: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    exact = pa.array([int(v) if v < 10**38 else None for v in distance.tolist()], pa.decimal128(38, 0))
    columns = [ids, _lists(y, pa.float64()), pa.array(b.cluster, pa.int32()), pa.array(b.upper), _lists(b.ids, pa.int16()), _lists(b.low, pa.float64()), pa.array(b.rest), pa.array(b.used, pa.int32()), pa.array(scanned, pa.int32()), exact]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _STATE.split(", ")])


def first_assignment(vectors: DataFrame, centroids: list[list[int]], width: int, scale: int = SCALE) -> DataFrame:
    """The state of every vector (vec_id, x) after a full scan."""
    c, size = centroid_array(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(_matrix(batch.column("x"), size), scale)
            x, b = integers(y, scale), Bounds(len(y), width)
            b.scan(np.arange(len(y)), x, c)
            yield _state(batch.column("vec_id"), y, b, np.ones(len(y)), paired(x, c[b.cluster]))

    return vectors.mapInArrow(run, _STATE)


def next_assignment(state: DataFrame, before: list[list[int]], centroids: list[list[int]], width: int, scale: int = SCALE) -> DataFrame:
    """The state after the centroids moved from ``before``; bounds beyond ``width`` join the rest."""
    c, size = centroid_array(centroids), len(centroids[0])
    moved = np.array([math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b))) * (1 + SLACK) for a, b in zip(before, centroids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = _matrix(batch.column("y"), size)
            x, n = integers(y, scale), batch.num_rows
            held = len(batch.column("ids").flatten()) // n
            b = Bounds(n, held)
            b.cluster, b.upper, b.rest = (batch.column(k).to_numpy().copy() for k in ("cluster", "upper", "rest"))
            b.cluster = b.cluster.astype(np.int64)
            b.ids, b.low = _matrix(batch.column("ids"), held).astype(np.int64), _matrix(batch.column("low"), held)
            b.move(moved)
            b.narrow(width)
            scanned = b.assign(x, c)
            yield _state(batch.column("vec_id"), y, b, np.arange(n) < scanned, paired(x, c[b.cluster]))

    return state.mapInArrow(run, _STATE)


def means(state: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Centroids moved to floor(sum / count) of their vectors; empty ones stay. Sums are exact, made by each task, then by each cluster."""
    size = len(centroids[0])
    schema = "cluster int, n long, sums array<string>"

    def packed(totals: dict[int, list]) -> pa.RecordBatch:
        rows = [(k, v[0], [str(int(x)) for x in v[1]]) for k, v in sorted(totals.items())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.int64(), pa.list_(pa.string())))], ["cluster", "n", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            x, cluster = integers(_matrix(batch.column("y"), size), scale), batch.column("cluster").to_numpy()
            for k in np.unique(cluster).tolist():
                own = totals.setdefault(k, [0, [0] * size])
                mine = x[cluster == k]
                own[0] += len(mine)
                own[1] = [p + int(q) for p, q in zip(own[1], mine.sum(axis=0).tolist())]
        yield packed(totals)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for k, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
                own = totals.setdefault(k, [0, [0] * size])
                own[0] += n
                own[1] = [p + int(q) for p, q in zip(own[1], sums)]
        yield packed(totals)

    found = state.select("y", "cluster").mapInArrow(partial, schema).repartition("cluster").mapInArrow(combine, schema).collect()  # one row for each centroid
    moved = [list(c) for c in centroids]
    for r in found:
        moved[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return moved


def seeds(vectors: DataFrame, k: int = CENTROIDS, scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors (vec_id, x) with the smallest sha256 of ``1:<vec_id>``, in that order; null ids last, equal ids by their components."""
    rank = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select("x", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in integers(whole(np.array([r["x"]], np.float64), scale), scale)[0].tolist()] for r in chosen]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """The state of every usable vector of ``vectors`` (vec_id, embedding) after ``rounds`` moves of the centroids, and the centroids."""
    small_batches(vectors.sparkSession)
    kept = usable(vectors, size)
    centroids = seeds(kept, k, scale)
    if not centroids:
        return kept.sparkSession.createDataFrame([], _STATE), []
    least, width = max(1, len(centroids) // 8), max(1, len(centroids) // 4)
    width = min(width, len(centroids) - 1)
    state = staged(first_assignment(kept, centroids, width, scale), "drake-0")
    for turn in range(rounds):
        moved = means(state, centroids, scale)
        state = staged(next_assignment(state, centroids, moved, width, scale), f"drake-{turn + 1}")
        centroids = moved
        width = min(width, max(least, state.agg(F.max("used")).first()[0]))
    return state, centroids


def _long(c):
    return F.when(c <= (1 << 63) - 1, c).cast("long")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    state, centroids = cluster(vectors, k, rounds, size, scale)
    own = state.groupBy("cluster").agg(F.try_sum("distance").alias("s"), F.count_if(F.col("distance").isNull()).alias("none")).collect()  # one row for each centroid
    sums = {r["cluster"]: None if r["none"] else r["s"] for r in own}
    every = None if None in sums.values() else sum(sums.values())
    fits = lambda v: None if v is None or v >= 1 << 63 else int(v)
    told = [(i, fits(sums.get(i)), fits(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    facts = state.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", _long(F.col("distance")).alias("distance")).join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB, with the rounds written out."""
    near = "a{0} AS (SELECT vec_id, e, min(row(d, c))[2] AS c, min(d) AS d FROM (SELECT v.vec_id, v.e, c.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.e, c.e)]) AS d FROM v CROSS JOIN c{0} c) GROUP BY vec_id, e)"
    move = "c{1} AS (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{0} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM (SELECT c, i, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS i FROM a{0}) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)"
    steps = [near.format(0)]
    for turn in range(rounds):
        steps += [move.format(turn, turn + 1), near.format(turn + 1)]
    return f"""WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < 16),
{", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


SQL = _sql()

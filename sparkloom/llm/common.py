"""What several operators of this subpackage share: staging tables, batch slicing, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where none is set and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch: what a worker and its executor hold of a batch at once is small beside what they need anyway.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(spark: SparkSession) -> SparkSession:
    """``spark`` with Arrow batches no larger than BATCH_ROWS and BATCH_BYTES from now on; smaller settings stay."""
    for name, most in _LIMITS.items():
        found = spark.conf.get(name).lower().removesuffix("b")
        if not found.isdigit() or not 0 < int(found) <= most:
            spark.conf.set(name, str(most))
    return spark


#: Folders that were staged within each open scope of this thread, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """A scope for staged tables: those made within it are removed at its end, and no others.

    What reads them must have been written by then. Tables staged outside any scope stay, as results that are still open may read them.
    """
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield own
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    for own in _SCOPES.get()[-1:]:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name`` with a mark in front that makes it differ from all of ``taken``, whatever their case."""
    own, low = f"__{name}", {x.lower() for x in taken}
    while own.lower() in low:
        own = f"_{own}"
    return own


_OWN: dict[str, tuple[str, object]] = {}


def once(kind: str, key: str, make):
    """What ``make`` returns, made once by each worker for ``key``; a new key of the same ``kind`` replaces the old one."""
    if kind not in _OWN or _OWN[kind][0] != key:
        _OWN[kind] = (key, make())
    return _OWN[kind][1]


def new_key() -> str:
    return uuid.uuid4().hex


def held_out(column: str, folds: int):
    """True for rows that learning must not see: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts sum to about ``limit`` bytes, so that work space stays bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at least, but for the last, put together from small ones: for rows of a few bytes that are worked on many at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    if len(x) == 0:
        return x
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each bit of 64 over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            full = np.full(size, base & _MASK, np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums p with p[j] - p[i] = hash of data[i:j] times BASE**i (modulo 2**64); bytes count from 1."""
    return prefix_sums(data, powers(len(data))[0])


def prefix_sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    own = sums[1:]
    own[:] = data
    own += np.uint64(1)
    own *= up[: len(data)]
    np.cumsum(own, out=own)
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


#: Which bytes part words: \\x20 and \\x09-\\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of ``data``, block by block: work space does not grow with its length.

    A word that goes on in the next block is carried over as the sum of its bytes so far.
    """
    starts, hashes = [], []
    size, total, begin = 0, np.uint64(0), 0  # of the word that the last block left open; size 0: none
    for lo in range(0, max(1, len(data)), block):
        part = data[lo : lo + block]
        start, end = word_spans(part)
        if size and not (len(start) and start[0] == 0):
            starts.append(np.array([begin]))
            hashes.append(np.array([total]))
            size, total = 0, np.uint64(0)
        if len(start) == 0:
            continue
        up, down = powers(len(part) + 1)
        sums = prefix_sums(part, up)
        own = (sums[end] - sums[start]) * down[start]
        at = start + lo
        if size:
            own[:1] = own[:1] * np.uint64(pow(BASE, size, 1 << 64)) + total
            at[0] = begin
        if end[-1] == len(part):
            size, total, begin = int(end[-1] - start[-1]) + (size if len(start) == 1 else 0), own[-1], int(at[-1])
            own, at = own[:-1], at[:-1]
        else:
            size, total = 0, np.uint64(0)
        starts.append(at)
        hashes.append(own)
    if size:
        starts.append(np.array([begin]))
        hashes.append(np.array([total]))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts).astype(np.int64), mix(np.concatenate(hashes).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not white space."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACES[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Bits of the fixed-size filter of ids.
FILTER_BITS = 26


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each id."""
    h = mix(ids.view(np.uint64) + np.uint64(BASE & _MASK))
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bit filter of FILTER_BITS bits (8 MB) with two bits for each id: it never misses one, and tells others apart as long as it is not full.

    Its size does not depend on the number of ids; the parts of tasks are put together by their 64-bit words, 2**20 at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for batch in batches:
            for at in _places(np.ascontiguousarray(batch.column(0).to_numpy())):
                np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at].view(np.int64))], ["word", "bits"])

    found = ids.select(column).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def maybe(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ``ids`` the filter may hold."""
    a, b = _places(ids)
    has = lambda at: (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return (has(a) & has(b)).astype(bool)


#: Links, of 16 bytes, that one task unites by itself; more are dealt over all tasks.
ONE_TASK = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all links (u, v) of a task, by hooking trees to smaller roots and halving their height."""
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ids, at = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    u, v = at[: len(table)], at[len(table) :]
    root = np.arange(len(ids))
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        ru, rv = root[u], root[v]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    for i in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(ids[root[i : i + (1 << 16)]])], ["id", "component"])


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of ``links`` (a, b long): rows (id, component), the smallest id that ``id`` reaches.

    Large-star and small-star steps alternate until nothing changes; each step is a written table.
    A star's centre gets its smallest neighbour by a pre-aggregated minimum, so hubs gather in no task.
    As soon as no more than ONE_TASK links are left, a task unites them, which gives the same components.
    """
    spark = links.sparkSession
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    state = None
    for turn in range(100):
        seen = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen[0] <= ONE_TASK:
            return staged(edges.coalesce(1).mapInArrow(_united, "id long, component long"), f"{name}-found")
        if seen == state:
            break
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, f"{name}-{turn}")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return staged(stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct(), f"{name}-found")

"""Incremental state: file diffs, retained rows, debounced events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.math import epoch_ms


def file_diff(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state): new, modified, deleted or same; equal mtimes settle it, else hashes do. Both sides (path, mtime, hash)."""
    a = disk.select("path", F.col("mtime").alias("m1"), F.col("hash").alias("h1"), F.lit(True).alias("on_disk"))
    b = index.select("path", F.col("mtime").alias("m2"), F.col("hash").alias("h2"), F.lit(True).alias("in_index"))
    state = F.when(F.col("in_index").isNull(), "new").when(F.col("on_disk").isNull(), "deleted").when(F.col("m1") == F.col("m2"), "same").when(F.col("h1") == F.col("h2"), "same").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def merge(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` outside ``changed`` (key), plus ``new``."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def reusable(chunks: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """``chunks`` (id, content) with the stored vector of equal content and version, null where it must be made anew."""
    keyed = chunks.withColumn("fingerprint", F.sha2(F.concat(F.lit(version), "content"), 256))
    return keyed.join(stored.select("fingerprint", "embedding").dropDuplicates(["fingerprint"]), "fingerprint", "left")


def debounce(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """(key, released, events): one row for each run of events less than ``gap_ms`` apart, in their nearest milliseconds; a pause of ``gap_ms`` or more starts a new run."""
    order = Window.partitionBy(key).orderBy(ts)
    ms = epoch_ms(events, ts)
    starts = events.withColumn("_new", (F.coalesce(ms - F.lag(ms).over(order), F.lit(gap_ms)) >= gap_ms).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.max(ts).alias("released"), F.count("*").alias("events")).drop("_run")


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root, state): roots that a configuration adds or removes."""
    added = new.select("root").distinct().join(old, "root", "left_anti").withColumn("state", F.lit("added"))
    return added.unionByName(old.select("root").distinct().join(new, "root", "left_anti").withColumn("state", F.lit("removed")))


def below_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (path, ...) that lie in one of the folders (root): by their own folders, not by pairs with all roots."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = files.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return files.join(held, "path", "left_semi")


def cleanup(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (files, symbols, relationships, imports, chunks, vectors) without what belongs to the files ``gone`` (path).

    Relationships go with either end, chunks with their file, vectors with their chunk.
    """
    out = dict(tables)
    lost = gone.select(F.col("path").alias("file_path")).distinct()
    for name in ("symbols", "imports", "chunks"):
        if name in out:
            out[name] = out[name].join(lost, "file_path", "left_anti")
    if "files" in out:
        out["files"] = out["files"].join(gone.select("path").distinct(), "path", "left_anti")
    if "relationships" in out and "symbols" in tables:
        ids = tables["symbols"].join(lost, "file_path", "left_semi")
        out["relationships"] = out["relationships"].join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    if "vectors" in out and "chunks" in out:
        out["vectors"] = out["vectors"].join(out["chunks"].select(F.col("chunk_id").alias("id")), "id", "left_semi")
    return out


def rebuild_chunks(old: DataFrame, new: DataFrame, changed: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """(chunk_id, file_path, content, fingerprint, embedding, state): chunks after a change of the files ``changed`` (file_path).

    ``retained``: of other files, as they are; ``reused``: made anew with the vector of equal content and version; ``to_encode``: without one.
    """
    kept = old.join(changed.select("file_path").distinct(), "file_path", "left_anti").select("chunk_id", "file_path", "content")
    both = kept.withColumn("kept", F.lit(True)).unionByName(new.select("chunk_id", "file_path", "content", F.lit(False).alias("kept")))
    keyed = reusable(both, stored, version)
    state = F.when(F.col("kept"), "retained").when(F.col("embedding").isNotNull(), "reused").otherwise("to_encode")
    return keyed.select("chunk_id", "file_path", "content", "fingerprint", "embedding", state.alias("state"))


def rebuild_stats(rebuilt: DataFrame, old: DataFrame) -> DataFrame:
    """(retained, removed, encoded, reused) of rebuild_chunks()."""
    n = lambda s: F.count_if(F.col("state") == s)
    before = old.agg(F.count("*").alias("before"))
    return rebuilt.agg(n("retained").alias("retained"), n("to_encode").alias("encoded"), n("reused").alias("reused")).join(F.broadcast(before)).select("retained", (F.col("before") - F.col("retained")).alias("removed"), "encoded", "reused")

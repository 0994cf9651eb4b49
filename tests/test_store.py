"""Segments, tombstones and manifests of a written index."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.store import IndexStore


def made(rows):
    symbols = rows.select("path", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    ids = F.xxhash64("path", "i")
    return {
        "files": rows,
        "symbols": symbols.select(ids.alias("id"), F.concat("path", F.lit("#"), "i").alias("name"), F.col("path").alias("file_path")),
        "relationships": symbols.select(ids.alias("from_id"), F.xxhash64(F.lit("f0"), "i").alias("to_id"), F.lit("Calls").alias("kind")),
        "chunks": symbols.select(ids.alias("chunk_id"), F.col("path").alias("file_path")),
        "vectors": symbols.select(ids.alias("id"), F.array(F.lit(1.0)).alias("embedding")),
    }


def disk(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, mtime long, content_hash string")


def bytes_of(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files}


def rows_of(store):
    return {name: sorted(map(str, store.read(name).collect())) for name in ("files", "symbols", "relationships", "chunks", "vectors")}


@pytest.fixture
def store(spark, tmp_path):
    own = IndexStore(spark, f"file://{tmp_path}/index")
    own.refresh(disk(spark, *((f"f{i}", 1, "h") for i in range(400))), made)
    return own


def test_one_file_costs_what_it_is(spark, store, tmp_path):
    before = bytes_of(tmp_path / "index")
    store.refresh_one(disk(spark, ("f7", 2, "new")), "f7", made)
    after = bytes_of(tmp_path / "index")
    assert all(after.get(f) == size for f, size in before.items() if "states" not in f and "manifest" not in f)
    assert sum(size for f, size in after.items() if f not in before) < 0.35 * sum(before.values())
    fresh = IndexStore(spark, f"file://{tmp_path}/fresh")
    fresh.refresh(disk(spark, *((f"f{i}", 2 if i == 7 else 1, "new" if i == 7 else "h") for i in range(400))), made)
    assert rows_of(store) == rows_of(fresh)
    store.refresh_one(disk(spark, ("f0", 1, "h")).limit(0), "f0", made)
    assert store.read("files").count() == 399 and store.read("symbols").count() == 399 * 20 and store.read("relationships").count() == 0


def test_a_manifest_that_is_cut_short_does_not_count(spark, store, tmp_path):
    want = rows_of(store)
    number = store.metadata()["number"]
    with open(tmp_path / "index" / f"manifest-{number + 1:012d}.json", "w") as f:
        f.write('{"version": 2, "tables": {"fil')
    assert rows_of(store) == want and store.metadata()["number"] == number
    store.delete_where("files", "path", ["f1"])
    assert store.read("files").count() == 399 and store.metadata()["number"] == number + 2


def test_the_second_of_two_writers_fails(spark, store, monkeypatch):
    want, number = rows_of(store), store.metadata()["number"]
    monkeypatch.setattr(store, "_numbers", lambda: [number - 1] if number > 1 else [])
    with pytest.raises(Exception, match="(?i)exist"):
        store._publish(store.metadata(), {}, {}, {})
    monkeypatch.undo()
    assert rows_of(store) == want


def test_an_open_reader_outlives_a_commit(spark, store):
    held = store.read("symbols")
    store.refresh_one(disk(spark, ("f3", 9, "x")), "f3", made)
    assert held.count() == 8_000


def test_compaction_keeps_the_rows(spark, store, tmp_path):
    for i in range(12):
        store.append("imports", spark.createDataFrame([(f"f{i}", "m")], "file_path string, path string"))
    store.delete_where("imports", "file_path", ["f2", "f11"])
    store.append("imports", spark.createDataFrame([("f2", "again")], "file_path string, path string"))
    want = sorted((r["file_path"], r["path"]) for r in store.read("imports").collect())
    left = store.compact("imports")
    assert left <= 8 and sorted((r["file_path"], r["path"]) for r in store.read("imports").collect()) == want
    while store.compact("imports", 1) > 1:
        pass
    assert sorted((r["file_path"], r["path"]) for r in store.read("imports").collect()) == want and ("f2", "again") in want and "imports" not in store.metadata()["gone"]
    folders = {d for d in os.listdir(tmp_path / "index") if d.startswith("imports-") and not d.startswith("imports-gone")}
    assert len(folders) <= 4  # what this manifest and the one before name


def test_indexes_of_version_1_are_read(spark, tmp_path):
    spark.createDataFrame([("a", "py", "h", 1, 2)], "path string, language string, content_hash string, mtime long, indexed_at long").write.parquet(f"{tmp_path}/old/files-1")
    (tmp_path / "old" / "CURRENT.json").write_text(json.dumps({"version": 1, "tables": {"files": "files-1"}, "facts": {"roots": ["x"]}}))
    store = IndexStore(spark, f"file://{tmp_path}/old")
    assert store.read("files").count() == 1
    store.append("files", disk(spark, ("b", 1, "h")))
    assert store.read("files").count() == 2 and store.metadata()["facts"] == {"roots": ["x"]}
    store.clear()
    assert store.read("files").count() == 0 and store.metadata()["facts"] == {}

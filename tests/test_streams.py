"""Streams: debouncing with cancelling, joins with bounded state, file events."""

import os
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import stateful
from sparkloom.streaming.file_events import FileEvents

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def batches(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        for f in os.listdir(f"{folder}/{i}"):
            if f.endswith(".parquet"):
                os.rename(f"{folder}/{i}/{f}", f"{folder}/in/{i}.parquet")
                os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def run_stream(spark, df, folder, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, spark.table(name).collect()


EVENTS = "path string, action string, ts timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_debounce_resets_cancels_and_takes_late_rows(rocks, tmp_path):
    spark, gap = rocks, 10
    os.makedirs(tmp_path / "in")
    parts = [
        [("a", "modify", at(0)), ("a", "modify", at(5)), ("b", "modify", at(1)), ("c", "modify", at(2)), ("d", "modify", at(3)), ("d", "delete", at(3))],
        [("b", "delete", at(6)), ("a", "modify", at(13)), ("e", "modify", at(20)), ("c", "modify", at(21))],
        # Out of order, but within the watermark's delay of 30 s: restarts e's timer backwards and parts c's changes.
        [("e", "modify", at(12)), ("c", "modify", at(11)), ("f", "modify", at(60))],
        [("e", "modify", at(-100)), ("g", "modify", at(200))],  # the first is behind the watermark
        [("end", "modify", at(1000))],
    ]
    batches(spark, str(tmp_path), parts, EVENTS)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _, rows = run_stream(spark, stateful.debounced_changes(events, "path", "ts", "action", gap * 1000, "30 seconds"), str(tmp_path), "debounced_test")
    got = Counter((r["path"], r["action"], r["changed"]) for r in rows)
    every = [e for p in parts for e in p if e[2] != at(-100) and e[0] != "end"]
    want = Counter()
    for path in {e[0] for e in every}:
        own = {}
        for _, action, ts in sorted((e for e in every if e[0] == path), key=lambda e: (e[2], e[1] == "delete")):
            own[ts] = action
        times = sorted(own)
        for t, after in zip(times, times[1:] + [None]):
            if own[t] == "delete" or after is None or after - t >= timedelta(seconds=gap):
                want[path, own[t], t] += 1
    assert got == want
    assert ("b", "modify", at(1)) not in got and ("a", "modify", at(13)) in got


def test_interval_join_equals_batch_and_forgets(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    schema = "user long, kind string, ts timestamp"
    parts = [[(u, k, at(1000 * b + 7 * i + u)) for i in range(20) for u in range(3) for k in ("view", "buy")] for b in range(6)]
    batches(spark, str(tmp_path), parts, schema)
    read = lambda r: r.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sides = lambda d: (d.where("kind = 'view'").select("user", F.col("ts").alias("seen")), d.where("kind = 'buy'").select("user", F.col("ts").alias("bought")))
    a, b = sides(read(spark.readStream))
    q, rows = run_stream(spark, stateful.interval_join(a, b, "user", "seen", "bought", "30 seconds", "60 seconds"), str(tmp_path), "joined_test")
    c, d = sides(spark.read.schema(schema).parquet(f"{tmp_path}/in"))
    want = c.join(d, "user").where("bought >= seen and bought <= seen + interval 30 seconds").collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, want)) and len(rows) > 100
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 3 * 120 and held[-1] <= 2 * 120  # 720 rows went in


def test_file_events(spark, tmp_path):
    spark.dataSource.register(FileEvents)
    root = tmp_path / "tree"
    os.makedirs(root / "sub" / ".hidden")
    write = lambda name, text, when: (open(root / name, "w").write(text), os.utime(root / name, (when, when)))
    stream = lambda: spark.readStream.format("file_events").option("path", f"file:{root}").option("state", f"file:{tmp_path}/state").option("suffixes", ".py,.md").load()
    seen = []

    def once():
        found = []
        q = stream().writeStream.foreachBatch(lambda df, i: found.extend((r["path"], r["action"]) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted(found))

    write("a.py", "1", 1_700_000_000)
    write("sub/b.md", "1", 1_700_000_000)
    write("sub/.hidden/c.py", "1", 1_700_000_000)
    write("d.txt", "1", 1_700_000_000)
    once()
    once()  # a restart without changes
    write("a.py", "22", 1_700_000_000)  # the size alone
    write("sub/e.py", "1", 1_700_000_005)
    os.remove(root / "sub" / "b.md")
    once()
    assert seen == [[("a.py", "create"), ("sub/b.md", "create")], [], [("a.py", "modify"), ("sub/b.md", "delete"), ("sub/e.py", "create")]]
    assert len([f for f in os.listdir(tmp_path / "state") if f.endswith(".done")]) <= 2
    batch = spark.read.format("file_events").option("path", f"file:{root}").load()
    assert {r["path"] for r in batch.collect()} == {"a.py", "sub/e.py", "d.txt"}

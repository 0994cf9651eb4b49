"""Operators on small cases worked out by hand."""

from pyspark.sql import functions as F

from sparkloom.functions import math as M
from sparkloom.functions import text as T
from sparkloom.operators import chunks, evaluate, graph, incremental, resolve, search
from sparkloom.sources import files
from sparkloom.streaming import watch

CALLS = [(2, 1), (3, 2), (4, 5), (4, 2), (6, 3), (6, 4), (7, 7), (8, 9), (9, 8)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def edges(spark):
    return spark.createDataFrame(CALLS, "src long, dst long")


def test_identifiers(spark):
    got = one(spark, *(T.split_identifier(F.lit(x)) for x in ("get_user_by_id", "getHTTPResponse", "XMLParser", "simple")))
    assert list(got) == [["get", "user", "by", "id"], ["get", "HTTP", "Response"], ["XML", "Parser"], ["simple"]]
    assert one(spark, T.expand_identifiers(F.lit("fn get_user_by_id(conn)")))[0].startswith("fn get_user_by_id(conn) get user by id")


def test_ranks_and_vectors(spark):
    got = one(spark, M.downrank(F.lit(1.0), F.lit(0.5)), M.downrank(F.lit(-1.0), F.lit(0.5)), M.uprank(F.lit(1.0), F.lit(1.5)), F.round(M.uprank(F.lit(-1.0), F.lit(1.5)), 4), M.sigmoid(F.lit(0.0)), M.weighted(F.lit(0.8), F.lit(0.6), 0.7))
    assert list(got) == [0.5, -2.0, 1.5, -0.6667, 0.5, 0.74]
    v = F.array(*map(F.lit, [1.0, -1.0, 0.5, 0.0, -0.5, 2.0, 0.0, -3.0]))
    assert one(spark, M.sign_words(v, 8))[0] == [37]
    assert one(spark, M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))))[0] == 0.0


def test_globs_and_paths(spark):
    import re

    assert re.match(T.glob_regex("node_modules/**"), "a/node_modules/x/y.js")
    assert not re.match(T.glob_regex("*.md"), "a/b.md.txt")
    assert list(one(spark, T.is_test_path(F.lit("a/tests/x.py")), T.is_test_path(F.lit("a/x.spec.ts")), T.is_test_path(F.lit("a/x.py")))) == [True, True, False]


def test_impact_and_tree(spark):
    got = lambda start, d: {r["id"]: r["depth"] for r in graph.impact(edges(spark), spark.range(start, start + 1), d).collect()}
    assert got(1, 1) == {2: 1}
    assert got(1, 3) == {2: 1, 3: 2, 4: 2, 6: 3}
    assert got(9, 5) == {8: 1}
    tree = graph.call_tree(edges(spark), 7, 3).where("depth > 0").collect()
    assert [(r["path"], r["reason"]) for r in tree] == [([7, 7], "recursive")]


def test_critical_path(spark):
    got = graph.critical_paths(edges(spark), spark.range(6, 7)).orderBy("hop").collect()
    assert [r["id"] for r in got] == [6, 3, 2, 1]


def test_as_of(spark):
    defs = spark.createDataFrame([(1, 5, 50), (1, 15, 51)], "f long, line long, def long")
    uses = spark.createDataFrame([(1, 12, 1), (1, 25, 2), (1, 2, 3)], "f long, at long, use long")
    got = {r["use"]: r["def"] for r in resolve.as_of(uses, defs, "f", "at", "line", "def").collect()}
    assert got == {1: 50, 2: 51, 3: None}


def test_resolution(spark):
    s = spark.createDataFrame([(1, "f", 1, "py", "m", "Public", 5), (2, "f", 1, "py", "m", "Public", 15), (3, "g", 2, "py", "n", "Public", 1), (4, "h", 2, "rs", "n", "Public", 1), (5, "k", 3, "py", "q", "Public", 1), (6, "k", 4, "py", "r", "Public", 1)], "id long, name string, file_id long, language string, module string, visibility string, line int")
    u = spark.createDataFrame([(1, "f", 1, "py", "m", 12), (2, "f", 1, "py", "m", 25), (3, "g", 1, "py", "m", 1), (4, "h", 1, "py", "m", 1), (5, "k", 1, "py", "m", 1)], "rel_id long, to_name string, file_id long, language string, module string, line int")
    imports = spark.createDataFrame([(9, "x", None)], "file_id long, path string, alias string")
    got = {r["rel_id"]: (r["to_id"], r["status"]) for r in resolve.resolve_names(u, s, imports).collect()}
    assert got == {1: (1, "resolved"), 2: (2, "resolved"), 3: (3, "resolved"), 4: (None, "no_candidates"), 5: (None, "ambiguous")}


def test_chunks():
    text = "# Chapter 1\n\nalpha\n\n## Section 1.1\n\nbeta\n\n## Section 1.2\n\ngamma\n\n# Chapter 2\n\ndelta\n"
    heads = {c[3].strip().split("\n")[-1]: c[2] for c in chunks.document_chunks(text)}
    assert heads["gamma"] == ["Chapter 1", "Section 1.2"] and heads["delta"] == ["Chapter 2"]
    parts = chunks.token_split(["a b c d e"] * 6, 12, 16, 4)
    assert len(parts) >= 2 and all(5 * (b - a) <= 16 for a, b in parts) and parts[-1][1] == 6
    assert [a for a, _ in chunks.pack_lines(["x" * 10] * 5, 25, 1)] == [0, 1, 2, 3]


def test_metrics(spark):
    runs = spark.createDataFrame([("q", 1, 11), ("q", 2, 99), ("q", 3, 22)], "query_id string, rank int, id long")
    qrels = spark.createDataFrame([("q", 11, 2), ("q", 22, 1)], "query_id string, id long, grade int")
    r = evaluate.metrics(runs, qrels).first()
    assert r["hit1"] == 1 and r["ndcg10"] > 0.9 and r["recall5"] == 1
    p = spark.createDataFrame([("a", 0.70, 300), ("b", 0.75, 400), ("c", 0.60, 500)], "name string, quality double, cost int")
    assert {x["name"] for x in evaluate.pareto(p).collect()} == {"a", "b"}


def test_prefilter(spark):
    h = spark.createDataFrame([(1, 0.30), (2, 0.10), (3, 0.09), (4, 0.08)], "id long, score double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = search.prefilter(h, ids(1, 2, 3), ids(1, 3, 4), 2, 0.01, 1)
    assert {r["id"] for r in got.collect()} == {1, 2, 3}


def test_fuzzy(spark):
    s = spark.createDataFrame([(1, "handle"), (2, "hnadle"), (3, "other")], "id long, name string")
    assert {r["id"] for r in search.fuzzy_names(s, "handle").collect()} == {1, 2}


def test_incremental(spark):
    a = spark.createDataFrame([("x", 1, "h"), ("y", 2, "h2"), ("z", 1, "n")], "path string, mtime long, hash string")
    b = spark.createDataFrame([("x", 1, "old"), ("y", 1, "h1"), ("w", 1, "h")], "path string, mtime long, hash string")
    assert {r["path"]: r["state"] for r in incremental.file_diff(a, b).collect()} == {"x": "same", "y": "modified", "z": "new", "w": "deleted"}


def test_python_extraction():
    found = files.extract("python", "import os\nclass A(B):\n    def f(self):\n        return g()\n")
    assert ("symbol", "f", "Method", 3, 4, None) in found and ("call", "f", "Call", 4, 4, "g") in found and ("extends", "A", "Class", 2, 2, "B") in found
    assert files.extract("python", "def (") == []


def test_file_scan(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "a.py").write_text("def f(): pass\n")
    (tmp_path / "tests" / "b.py").write_text("x = 1\n")
    (tmp_path / "c.bin").write_text("no")
    got = files.scan_files(spark, str(tmp_path), tests=False)
    assert [r["language"] for r in got.collect()] == ["python"]
    assert files.parse_files(got).count() == 1


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:00:00", "edit"), ("a", "2024-01-01 00:00:00.2", "edit"), ("b", "2024-01-01 01:00:00", "edit")], "path string, ts string, action string").select("path", F.col("ts").cast("timestamp").alias("ts"), "action").write.parquet(str(src))
    stream = spark.readStream.schema("path string, ts timestamp, action string").parquet(str(src))
    seen = []
    q = watch.refresh(watch.debounced(stream, "path", "ts"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r["path"], r["events"]) for r in seen if r["path"] == "a"] == [("a", 2)]
    assert watch.route("delete", "x.py") == "remove_code"

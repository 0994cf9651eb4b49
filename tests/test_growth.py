"""Work that must not grow with the square of a group: rows made by the joins of a plan."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import imports, lookup, resolve, search, subword, vectors
from sparkloom.operators.graph import cut
from sparkloom.plans.registry import edges
from sparkloom.streaming import stateful


def joined_rows(df):
    """(rows, most rows that one join or explode of the plan made)."""
    query = df._jdf.queryExecution()
    rows = df.collect()
    most, open_ = 0, [query.executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            open_.append(node.plan())
            continue
        if "Join" in name or name == "Generate":
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return rows, most


def test_scopes_meet_one_row_for_each_scope(spark):
    n = 400
    scoped = spark.createDataFrame([(1, "x", "local" if i % 2 else "module", i + 5) for i in range(n)], "file_id long, name string, scope string, id long")
    uses = spark.createDataFrame([(i, 1, "x", "rust") for i in range(n)], "use_id long, file_id long, name string, language string")
    rows, most = joined_rows(resolve.resolve_in_scopes(uses, scoped))
    assert len(rows) == n and {(r["id"], r["scope"]) for r in rows} == {(6, "local")}
    assert most <= 2 * n


def test_debouncing_calls_no_python(spark, tmp_path):
    events = spark.readStream.schema("path string, action string, ts timestamp").parquet(str(tmp_path))
    plan = stateful.debounced_changes(events, "path", "ts", "action", 1000)._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan and "PythonUDF" not in plan


def test_references_meet_one_row_for_each_place(spark):
    n = 300
    symbols = spark.createDataFrame([(i, "f", "a.py", 1, 9) for i in range(n)], "id long, name string, file_path string, start_line int, end_line int")
    references = spark.createDataFrame([(i, ["f", "g"][i % 2], "a.py", 2, 9) for i in range(n)], "ref_id long, name string, file_path string, start_line int, end_line int")
    rows, most = joined_rows(lookup.sources_of(references, symbols))
    assert {(r["ref_id"] % 2, r["id"], r["step"]) for r in rows} == {(0, 0, 2), (1, 0, 3)} and len(rows) == n
    assert most <= 2 * n


def test_exports_follow_names_not_symbols(spark, monkeypatch):
    n, cuts = 500, []
    monkeypatch.setattr(imports, "cut", lambda rows: cuts.append(cut(rows)) or cuts[-1])
    symbols = spark.createDataFrame([(i, "f", "a") for i in range(n)], "id long, name string, module string")
    passed = spark.createDataFrame([("b", "f", "a", "f"), ("c", None, "b", None), ("b", None, "c", None)], "module string, name string, target string, taken string")
    rows = imports.exported(symbols, passed).collect()
    assert {(r["module"], r["name"]) for r in rows} == {("a", "f"), ("b", "f"), ("c", "f")} and len(rows) == 3 * n
    assert max(x.count() for x in cuts) < n


def test_index_counts_terms_within_the_row(spark, monkeypatch, tmp_path):
    texts = ["b a b", None, "", "the The THE cat", "x" + " y z" * 50, "--"]
    docs = spark.createDataFrame([(i, t, f"f{i}") for i, t in enumerate(texts)], "id long, text string, path string")
    seen, real = [], search.hash_vectors
    monkeypatch.setattr(search, "hash_vectors", lambda rows, *a: seen.append(rows) or real(rows, *a))
    index = search.TextIndex.build(docs, "id", "text", "path", f"file://{tmp_path}/index", 3)
    want = search.postings(docs, "id", F.col("text"))
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: sum(r["embedding"]) for r in index.vectors.collect()} == {r["id"]: r["dl"] for r in index.docs.collect()} == {0: 3, 1: 0, 2: 0, 3: 4, 4: 101, 5: 0}


def test_clusters_are_fitted_on_a_bounded_sample(spark, monkeypatch):
    v = spark.range(3_000).select("id", F.array(*(F.cos(F.col("id") * (i + 1)) for i in range(8))).alias("embedding"))
    assert vectors.sampled(v, 3_000).shape == (3_000, 8) and 200 <= len(vectors.sampled(v, 3_000, 300)) <= 400
    seen, real = [], vectors.lloyd
    monkeypatch.setattr(vectors, "sampled", lambda rows, n, real=vectors.sampled: real(rows, n, 300))
    monkeypatch.setattr(vectors, "lloyd", lambda x, *a, **b: seen.append(len(x)) or real(x, *a, **b))
    assigned, centroids = search.kmeans_assign(v, 20)
    assert assigned.count() == 3_000 and len(centroids) == 20 and max(seen) <= 400
    assert {r["cluster"] for r in assigned.select("cluster").distinct().collect()} <= set(range(1, 21))
    assert search.kmeans_assign(v.limit(0), 0)[0].count() == 0


def test_nearest_codes_hold_the_best_only(spark):
    """What is shuffled is some places of each query for each task, whatever the number of rows; many equal codes and ties included."""
    v = spark.range(0, 6_000, 1, 4).select("id", F.array(*(F.cos((F.col("id") % 500) * (i + 1)) for i in range(16))).alias("embedding"))
    found = vectors.nearest_codes(v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 16, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    rows = found.collect()
    assert len(rows) == 5 * 120
    assert all(r["distance"] == 0 for r in rows) and all(r["id"] <= r["query_id"] % 500 for r in rows if r["rank"] == 1)


def test_search_in_blocks_equals_plain_search(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2_000, 6)), np.repeat(rng.normal(size=(1, 6)), 2_500, 0), np.zeros((2, 6)), np.full((1, 6), np.nan)])
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "id long, embedding array<double>")
    for k in (1, 9):
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.batch_knn(v.where("id % 50 = 0 and id < 4502").withColumnRenamed("id", "query_id"), v, k).collect()}
        y = vectors.unit(x[:-1])
        for q in range(0, 4_502, 50):
            s = np.round(y @ y[q], 6)
            assert [got[q, i + 1] for i in range(k)] == [(int(j), s[j]) for j in np.lexsort((np.arange(len(s)), -s))[:k]]


def test_contexts_are_summed_in_blocks(spark, monkeypatch):
    import public_tokenizers

    path, texts = public_tokenizers.path("word_bpe_49k.json"), ["the red cat, don't sit", None, "", "a", "it's\x1cTHE red cat 42 " * 9, "x" * 90 + " red"]
    known, index = subword.vocabulary(path), subword.index_vectors(subword.vocabulary(path).size, 8).astype(np.int64)
    counts, sums = np.zeros(known.size, np.int64), np.zeros((known.size, 8), np.int64)
    for text in texts:
        ids = [p for w in known.words.findall((text or "").lower()) for p in known.pieces(w)]
        assert known.encode(text) == ids
        for i, p in enumerate(ids):
            counts[p] += 1
            sums[p] += sum((index[ids[j]] for j in range(max(0, i - 2), min(len(ids), i + 3)) if j != i), np.zeros(8, np.int64))
    rows = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(60)
    monkeypatch.setattr(subword, "BLOCK", 7)
    seen, real = [], subword.in_blocks
    monkeypatch.setattr(subword, "in_blocks", lambda x: seen.append(real(x)) or seen[-1])
    got = subword.context_sums(rows, "text", path, 8, 2)
    assert (got[0] == 3 * counts).all() and (got[1] == 3 * sums).all()
    assert seen[0].rdd.getNumPartitions() == 24


def test_equal_relations_are_resolved_once(spark, monkeypatch):
    schema = "to_name string, file_id int, language string, module string, line int, uses long"
    uses = spark.createDataFrame([("f", 1, "x", "m", 2, 1)] * 50 + [("f", 2, "x", "m", 2, 3), ("f", 2, "y", "m", 2, 4), ("g", None, "x", None, 2, 5)], schema)
    symbols = spark.createDataFrame([(1, "f", 1, "x", "m", "Private", 1), (2, "f", 3, "x", "n", "Public", 1)], "id long, name string, file_id int, language string, module string, visibility string, line int")
    imports_ = spark.createDataFrame([], "file_id int, path string, alias string")
    seen, real = [], resolve.resolve_names
    monkeypatch.setattr(resolve, "resolve_names", lambda rows, *a: seen.append(rows) or real(rows, *a))
    got = {(r["status"], r["tier"]): r["n"] for r in resolve.resolution_counts(uses, symbols, imports_).collect()}
    assert seen[0].count() == 4
    each = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(r for r in uses.collect() for _ in range(r["uses"]))], "rel_id long, to_name string, file_id int, language string, module string, line int")
    assert got == {(r["status"], r["tier"]): r["n"] for r in resolve.resolution_stats(real(each, symbols, imports_)).collect()}


def test_hits_are_searched_for_once(spark, monkeypatch):
    from sparkloom import tools

    calls = []
    embed = lambda c: calls.append(1) or search.hash_embedding(c)
    symbols = spark.createDataFrame([(i, f"f{i}", "red widget" if i % 2 else None, "x") for i in range(20)], "id long, name string, doc string, signature string")
    edges = spark.createDataFrame([(i, i - 1, "Calls") for i in range(1, 20)] * 2, "from_id long, to_id long, kind string")
    found = tools.CodeIndex(symbols, edges, embed=embed).semantic_search_with_context("red widget", 2)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == len(calls) == 2 and all(r["impacted"] == 2 and r["callers"] == [f"f{r['id'] + 1}"] and r["id"] % 2 for r in rows)
    vector = F.array(F.lit(1.0), F.lit(2.0))
    assert spark.range(1).select(search.M.cosine(vector, F.array(F.lit(0.0), F.lit(0.0))).alias("z"), F.round(search.M.cosine(vector, vector), 9).alias("o")).first().asDict() == {"z": 0.0, "o": 1.0}


def test_imports_of_whole_modules_are_shuffled_and_written_as_blocks(spark, monkeypatch):
    n, m, cuts = 3000, 40, []
    monkeypatch.setattr(imports, "cut", lambda rows: cuts.append(cut(rows)) or cuts[-1])
    symbols = spark.range(2 * m).selectExpr("id", "concat('s', id) as name", "'python' as language", "concat('m', id % 2) as module")
    asked = spark.range(2 * n).selectExpr("id as import_id", "id div 2 as file_id", "'python' as language", "'app' as module", "concat('m', id % 2, '.*') as path", "cast(null as string) as alias")
    found = imports.imported_names(asked.unionByName(asked), symbols)
    assert sum(rows.count() for rows in cuts) <= 2 * imports.WAYS  # files of a module and a way are one row
    rows = found.collect()
    assert len(rows) == 2 * n * m and len(set(rows)) == len(rows)
    changes = sum(a["to_id"] != b["to_id"] for a, b in zip(rows, rows[1:]))
    assert changes <= len(rows) / 50  # a column that stays the same costs no disk where it is written


class Lines:
    def __init__(self, lineitem):
        self.lineitem = lineitem


def test_edges_shuffle_what_tells_parts_apart(spark):
    rows = [(1, 1, 7, 2, 5.0), (1, 1, 7, 1, 9.0), (1, 1, 3, 4, 1.0), (1, 2, 3, 4, 1.0), (1, 2, 9, 1, None), (1, 1, 7, 1, 2.0), (2, 1, 5, 1, 1.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
    found = edges(Lines(lines))
    assert sorted(map(tuple, found.collect())) == sorted([(3, 7), (7, 7), (7, 7), (7, 3), (3, 9)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "l_extendedprice" not in plan.split("LogicalRDD")[0]

"""Ranks, scales and cuts of all hits: no task's window holds them, and they are what plain Python gives."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluate, resolve, search


def scores(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([round(rng.random() * 8, 1), 3.0])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, score double").repartition(7)


def best(rows):
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def test_in_order(spark):
    rows, df = scores(spark)
    got = sorted(search.in_order(df, [F.desc("score"), F.col("id")], "score").collect(), key=lambda r: r["r"])
    want = best(rows)
    assert [(r["r"], r["id"], r["score"], r["prev"]) for r in got] == [(i + 1, *want[i], want[i - 1][1] if i else None) for i in range(len(want))]
    assert search.in_order(df.limit(0), [F.desc("score")], "score").count() == 0


@pytest.mark.parametrize("drop, least", [(0.3, 1), (0.3, 5), (9.0, 1), (0.05, 1)])
def test_score_cut(spark, drop, least):
    rows, df = scores(spark, 120, 3)
    want, out = best(rows), []
    for i, (k, s) in enumerate(want):
        if s < want[0][1] - 2.0 or i >= least and want[i - 1][1] - s >= drop:
            break
        out.append(k)
    assert [r["id"] for r in search.score_cut(df, 2.0, drop, least).orderBy("r").collect()] == out


def test_prefilter(spark):
    rows, df = scores(spark, 90, 4)
    both = {k for k, _ in rows if k % 6 == 0}
    for gap in (0.0, 100.0):
        got = {r["id"] for r in search.prefilter(df, df.where("id % 2 = 0"), df.where("id % 3 = 0"), 20, gap, 4).collect()}
        want = best(rows)
        head = [k for k, _ in want[:20]]
        tail = [k for k, _ in want[20:] if k in both][:4]
        assert got == ({k for k, _ in rows} if want[19][1] - want[20][1] < gap else {*head, *tail})


def test_diverse_and_evidence(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abbbbbbc"), round(rng.random(), 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, file string, score double")
    ranked, seen = [], {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[r[1]] = seen.get(r[1], 0) + 1
        ranked.append((seen[r[1]] > 2, -r[2], r[0]))
    assert [r["id"] for r in search.diverse(df, 2, 12).collect()] == [k for *_, k in sorted(ranked)[:12]]
    got = {r["file"]: r["score"] for r in search.file_evidence(df).collect()}
    for f in "abc":
        own = sorted((r[2] for r in rows if r[1] == f), reverse=True)[:6]
        assert abs(got[f] - own[0] - 0.5 * sum(s / (i + 2) for i, s in enumerate(own[1:]))) < 1e-9


def test_gate(spark):
    rows = [(1, 0.1, 0.01, False), (2, 0.1, 0.02, True), (3, 0.1, 0.02, True), (4, 0.1, 0.02, True)]
    df = lambda rows: spark.createDataFrame(rows, "id long, score double, fused double, dual boolean")
    ask = lambda rows: search.gate(df(rows), F.col("fused"), F.col("dual")).count()
    assert ask(rows) == 0 and ask([(1, 9.0, 0.01, False), *rows[1:]]) == 4 and ask([(1, 0.1, 0.01, True), *rows[1:]]) == 4 and ask([]) == 0


def test_no_window_over_all_hits(spark):
    _, df = scores(spark)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    for x in (search.rrf([df, df]), search.convex(df, df), search.score_cut(df)):
        lines = plan(x).split("\n")
        assert not any("SinglePartition" in a and any("Window" in b for b in lines[max(0, i - 3) : i]) for i, a in enumerate(lines))


def test_upper_stats(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(50))])) for _ in range(300)] + [("one", 4.0)]
    got = {r["k"]: (r["n"], r["median"], r["p90"]) for r in evaluate.upper_stats(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    for k in ("a", "b", None, "one"):
        own = sorted(v for g, v in rows if g == k and v is not None)
        assert got[k] == (len(own), own[len(own) // 2], own[min(int(0.9 * len(own)), len(own) - 1)])


def test_reranking_options(spark):
    def length_model(query, texts):
        return [float(len(t) - 5) for t in texts]

    def slow_model(query, texts):
        import time

        time.sleep(0.3)
        return [float(len(t)) for t in texts]

    rows = [(i, "x" * (i + 1), 10.0 - i) for i in range(8)]
    hits = spark.createDataFrame(rows, "id long, text string, score double")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search.reranked(hits, "q", length_model, 3)) == [7, 6, 5]
    assert ids(search.reranked(hits, "q", length_model, 3, top_n=4)) == [3, 2, 1]
    got = search.reranked(hits, "q", length_model, 8, normalise="sigmoid").collect()
    assert [r["id"] for r in got] == list(range(7, -1, -1)) and abs(got[3]["score"] - 0.5) < 1e-9 and all(0 < r["score"] < 1 for r in got)
    assert ids(search.reranked(hits, "q", slow_model, 3, seconds=0.1)) == [0, 1, 2]  # what was before decides
    assert ids(search.reranked(hits, "q", slow_model, 3, seconds=60)) == [7, 6, 5]
    assert ids(search.reranked(hits.drop("score"), "q", length_model, 2)) == [7, 6]
    with pytest.raises(ValueError):
        search.reranked(hits, "q", length_model, 3, normalise="other")


@pytest.mark.parametrize(("language", "scopes"), [("kotlin", ["local", "class", "companion", "file", "imported", "global"]), ("swift", ["local", "class", "extension", "protocol", "module", "imported"]), ("cpp", ["using", "local", "module", "imported", "global"]), ("cobol", ["local", "module", "package", "global"])])
def test_scope_order(spark, language, scopes):
    df = spark.createDataFrame([(language, s) for s in [*scopes, "nowhere"]], "language string, scope string")
    got = {r["scope"]: r["k"] for r in df.withColumn("k", resolve.scope_rank(F.col("language"), F.col("scope"))).collect()}
    assert got == {s: i + 1 for i, s in enumerate(scopes)} | {"nowhere": None}

"""Written indexes, subword vectors, dictionaries and sketches against plain Python."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fuzzy, positional, search, sketches, subword, vectors
from sparkloom.plans import retrieval
from sparkloom.plans.registry import Tables

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def pieces_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- positions ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(1500)]
    return [*rows, (2000, None), (2001, ""), (2002, "w0 " * 3000), (2003, "w0 w1 w0 w1 w0"), (2004, "w250 w251 w252"), (-5, "w250 w251 w252")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    old = positional.SEGMENT_DOCS, positional.RANGE
    positional.SEGMENT_DOCS, positional.RANGE = 256, 16
    yield positional.PositionalIndex.build(docs, "doc_id", "text", f"file:{tmp_path_factory.mktemp('positions')}/index")
    positional.SEGMENT_DOCS, positional.RANGE = old


QUERIES = [(1, "w0 w7 w250"), (2, "w299"), (3, "w1 w1 w2"), (4, "nothing here"), (5, ""), (6, None), (7, "w250 w251 w252"), (8, " ".join(f"w{i}" for i in range(120)))]


def test_best_of_index_are_those_of_all_scores(spark, corpus, index):
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in index.bm25(asked).collect()}
    every = search.bm25(docs, "doc_id", "text", asked).select("query_id", "id", F.round("score", 4).alias("score")).collect()
    want = {}
    for q in {r["query_id"] for r in every}:
        own = sorted(((-r["score"], r["id"]) for r in every if r["query_id"] == q))[:10]
        want |= {(q, i + 1): (doc, -score) for i, (score, doc) in enumerate(own)}
    assert got == want and {q for q, _ in got} == {1, 2, 3, 7, 8}


def test_ranges_are_skipped(spark, index):
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    seen = {r["query_id"]: (r["scored"], r["skipped"]) for r in index.bm25(asked, 3, counts=True).collect()}
    assert seen[7][1] > 0 and sum(s for _, s in seen.values()) > 0.2 * sum(map(sum, seen.values()))
    assert index.docs.count() >= 6


def test_phrases_by_brute_force(spark, corpus, index):
    asked = [(1, "w0 w1"), (2, "w0 w0"), (3, "w250 w251 w252"), (4, "W1, w0!"), (5, "w3"), (6, "missing w0"), (7, "")]
    got = {(r["query_id"], r["id"]): r["hits"] for r in index.phrases(spark.createDataFrame(asked, "query_id long, text string")).collect()}
    want = {}
    for (q, phrase), (doc, text) in itertools.product(asked, corpus):
        p, t = [w.strip(",!").lower() for w in phrase.split()], (text or "").split()
        hits = sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) if p else 0
        if hits:
            want[q, doc] = hits
    assert got == want and got[3, -5] == 1


def test_a_refreshed_index_searches_like_a_fresh_one(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(positional, "SEGMENT_DOCS", 300)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = positional.PositionalIndex.build(frame(corpus[:900]), "doc_id", "text", f"file:{tmp_path}/one")
    index = index.refresh(frame([(5, "w0 w7 w250 w250"), (3000, "w250 w251 w252"), *corpus[900:]]), "doc_id", "text", spark.createDataFrame([(7,), (11,), (99_999,)], "id long"))
    before = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "one") for f in files)
    index = index.refresh(frame([(6, "w3 w250")]), "doc_id", "text", spark.createDataFrame([(3000,)], "id long"))
    after = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "one") for f in files)
    assert after - before < 0.2 * before
    now = [r for r in corpus if r[0] not in (5, 6, 7, 11)] + [(5, "w0 w7 w250 w250"), (6, "w3 w250")]
    fresh = positional.PositionalIndex.build(frame(now), "doc_id", "text", f"file:{tmp_path}/two")
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.bm25(asked)) == rows(fresh.bm25(asked)) and rows(index.phrases(asked)) == rows(fresh.phrases(asked))


def test_empty_index(spark, tmp_path):
    none = positional.PositionalIndex.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", f"file:{tmp_path}/none")
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert none.bm25(asked).count() == 0 and none.phrases(asked).count() == 0


# -- subwords ----------------------------------------------------------------------------------------------------------


def plain_pieces(known, letters, vocab, word):
    raw = "".join(letters[b] for b in word.encode())
    out, at = [], 0
    while at < len(raw):
        for end in range(len(raw), at, -1):
            piece = raw[at:end] + ("</w>" if end == len(raw) else "")
            if piece in vocab:
                out.append(vocab[piece])
                break
        else:
            end = at + 1
        at = end
    return out


def test_subword_vectors_by_plain_python(spark):
    import json

    path = pieces_file()
    known, vocab = subword.Vocabulary(path), json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    letters = {b: c for c, b in subword.byte_letters().items()}
    model = subword.train(Tables(spark, SMALL).documents, "text", path, dims=16)
    rows = [(r["doc_id"], r["text"]) for r in Tables(spark, SMALL).documents.collect()] + [(900, None), (901, ""), (902, "Ünïcode it's 3x ☃!? 漢字")]
    found = subword.embed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", model, None).collect()
    texts = dict(rows)
    for r in found:
        ids = [p for m in known.words.finditer((texts[r["id"]] or "").lower()) for p in plain_pieces(known, letters, vocab, m.group())]
        sums = model.rows[ids].astype(int).sum(axis=0) if ids else np.zeros(16, int)
        assert r["n_pieces"] == len(ids) and r["sums"] == sums.tolist()
        size = np.linalg.norm(sums)
        assert np.allclose(r["embedding"], sums / size if size else 0, atol=1e-9)
    assert len(found) == len(rows)


def test_subword_model_does_not_depend_on_the_deal(spark):
    docs = Tables(spark, SMALL).documents
    a, b = (subword.train(docs.repartition(n), "text", pieces_file(), dims=8).rows for n in (1, 5))
    assert (a == b).all() and a.any()


def test_subword_cut(spark):
    known = subword.Vocabulary(pieces_file())
    assert known.encode("a b " * 5000, 512) == known.encode("a b " * 5000)[:512]
    assert len(known.encode("river " * 5000, 512)) == -(-512 * known.median // 6)  # cut by characters first
    assert len(known.encode("a" * 100_000, 4)) <= 4 and known.encode(None) == []
    assert known.pieces("river") == [max(known.pieces("river"))] or len(known.pieces("river")) >= 1


# -- dictionaries ------------------------------------------------------------------------------------------------------


def plain_one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) == 1 or len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_near_names_by_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(250)] + ["ab", "ba", "AB", None, "", "a", "é", "eé", "a.b", "ab.", "xyxy", "yxxy"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["asked"], r["name"]): (r["n"], r["distance"]) for r in fuzzy.near_names(rows.select(F.col("name").alias("asked")), fuzzy.keyed(fuzzy.dictionary(rows, F.col("name")))).collect()}
    count = Counter(n.lower() for n in names if n is not None)
    assert got == {(a, b): (count[b], int(a != b)) for a in count for b in count if plain_one_edit(a, b)}


# -- vectors -----------------------------------------------------------------------------------------------------------


def test_stored_index_recall_and_reads(spark):
    """Recall at 10 of vectors with id % 50 = 0 at sf0.1: 0.9 at least, with a twentieth of the vectors read."""
    v = retrieval.vectors(Tables(spark, LARGE))
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = retrieval.vector_index(spark, LARGE)
    assert index.rows.count() == v.count()
    got = {(r["query_id"], r["id"]) for r in index.search(asked).collect()}
    want = {(r["query_id"], r["id"]) for r in search.batch_knn(asked, v, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    kept = index.candidates(asked, 100, 12).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert kept <= v.count() / 5


def test_repeated_and_zero_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 6) for i in range(300)] + [(i, rng.normal(size=6).tolist()) for i in range(300, 500)] + [(500, [0.0] * 6)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = vectors.VectorIndex.build(v, f"file:{tmp_path}/vectors", clusters=8)
    asked = v.where("id in (3, 300, 500)").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in index.search(asked, 5, 400, 1.0).collect()}
    want = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 5)) for r in search.batch_knn(asked, v, 5).collect()}
    assert {k: (i, round(s, 5)) for k, (i, s) in got.items() if k[0] != 300} == {k: x for k, x in want.items() if k[0] != 300}
    assert index.rows.count() == 501


def test_nearest_codes_by_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 20))
    x = [*(base[i % 60] + rng.normal(size=20) * 0.4 for i in range(400)), *([np.ones(20)] * 90), -np.ones(20), np.zeros(20)]
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "id long, embedding array<double>")
    for k in (1, 7, 600):
        got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in vectors.nearest_codes(v.where("id % 50 = 0 or id > 488").withColumnRenamed("id", "query_id"), v, 20, k).collect()}
        bits = np.array(x) > 0
        want = {}
        for q in [*range(0, len(x), 50), *range(489, len(x))]:
            d = (bits != bits[q]).sum(1)
            want |= {(q, i + 1): (int(j), int(d[j])) for i, j in enumerate(np.lexsort((np.arange(len(x)), d))[:k])}
        assert got == want


# -- sketches ----------------------------------------------------------------------------------------------------------


def test_merged_sketches_are_as_good_as_one_pass(spark):
    rows = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(40)).alias("file"), (F.col("id") % 17_000).alias("item"), (F.pow(F.col("id") % 997, 2)).alias("value")).withColumn("module", F.col("file") % 3)
    files = sketches.sketched(rows, ["module", "file"], F.col("item"), F.col("value"))
    merged = {r["module"]: r for r in sketches.estimates(sketches.rolled_up(files, ["module"]), ["module"]).collect()}
    once = {r["module"]: r for r in sketches.estimates(sketches.sketched(rows, ["module"], F.col("item"), F.col("value")), ["module"]).collect()}
    exact = {r["module"]: r for r in rows.groupBy("module").agg(F.count("*").alias("n"), F.countDistinct("item").alias("d")).collect()}
    for m, r in exact.items():
        values = np.sort([x["value"] for x in rows.where(F.col("module") == m).select("value").collect()])
        for found in (merged[m], once[m]):
            assert found["n"] == r["n"] and abs(found["distinct"] / r["d"] - 1) < 3 * 1.04 / 2 ** (sketches.LOG / 2)
            for p, rank in (("p50", 0.5), ("p90", 0.9)):
                low, high = np.searchsorted(values, found[p], "left") / len(values), np.searchsorted(values, found[p], "right") / len(values)
                assert low - 0.03 <= rank <= high + 0.03


def test_changed_files_come_and_go(spark):
    rows = spark.range(9_000).select((F.col("id") % 9).alias("file"), F.col("id").alias("item"), F.col("id").cast("double").alias("value"))
    stored = sketches.sketched(rows, ["file"], F.col("item"), F.col("value"))
    new = sketches.sketched(rows.where("file = 2 and item < 4500").unionByName(spark.range(300).select(F.lit(20).cast("long").alias("file"), (F.col("id") + 50_000).alias("item"), F.lit(1.0).alias("value"))), ["file"], F.col("item"), F.col("value"))
    after = sketches.refreshed(stored, new, spark.createDataFrame([(5,)], "file long"), ["file"])
    assert {r["file"]: r["n"] for r in after.collect()} == {f: 500 if f == 2 else 300 if f == 20 else 1000 for f in (0, 1, 2, 3, 4, 6, 7, 8, 20)}
    total = sketches.estimates(sketches.rolled_up(after.withColumn("all", F.lit(1)), ["all"]), ["all"]).first()
    assert total["n"] == 7_800 and abs(total["distinct"] / 7_800 - 1) < 0.05

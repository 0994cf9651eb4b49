"""Merkle manifests, scaled sketches and bounded k-means against plain Python."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.llm import drake, merkle, sketch
from sparkloom.llm.neardup import shingle_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, node string, proof string, sketch string, part int, kind int, tie long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "p", "s", 1, 2, 3) for r in rows], DOCS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle", "op13_drake_clusters"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    found, wanted = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns) and len(found)
    assert sorted(map(tuple, found[sorted(found.columns)].values.tolist())) == sorted(map(tuple, wanted[sorted(found.columns)].values.tolist()))


# -- Merkle -----------------------------------------------------------------------------------------------------------------


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, arity):
    """Root of ``nodes`` and for each one its steps (left, right)."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // arity * arity : i // arity * arity + arity]
            steps[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        at = [i // arity for i in at]
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], steps


def plain_manifest(rows, arity=2):
    trees = {}
    for doc_id, text, lang, source, n in rows:
        leaf = lambda n: H(*map(field, (doc_id, source, lang, n, text)))
        trees.setdefault(lang, []).append((-1 if doc_id is None else doc_id, leaf(n), leaf(None if n is None else n + 1), doc_id))
    names = sorted(trees, key=lambda x: b"" if x is None else b"1" + x.encode())
    built = {}
    for name in names:
        trees[name].sort()
        built[name] = climb([r[1] for r in trees[name]], arity)
    root, upper = climb([built[x][0] for x in names], arity)
    out = Counter()
    for name, own in zip(names, upper):
        for (_, leaf, altered, doc_id), steps in zip(trees[name], built[name][1]):
            told = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            fold = altered if told else leaf
            for a, b in steps + own:
                fold = H(a, fold, b)
            out[doc_id, leaf, built[name][0], root, H(*(a + b for a, b in steps + own)), fold, fold == root] += 1
    return out


def made_rows(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "a b", "κόσμος " * 9, None]), rng.choice(["en", "en", "en", "de", "ü", "", None]), rng.choice(["s", None]), rng.choice([i, None, 2**63 - 1])) for i in range(n)]
    return rows + [(5, "same", "en", "s", 1)] * 6 + [(None, None, None, None, None)] * 3 + [(None, "no id", "en", "s", 4), (10**18, "x" * 200_000, "one leaf", "s", 4)]


@pytest.mark.parametrize("arity, levels, n", [(2, 10, 60), (2, 2, 230), (3, 2, 120), (2, 1, 33)])
def test_manifest_by_brute_force(spark, arity, levels, n):
    rows = made_rows(n)
    got = merkle.verified(merkle.manifest(documents(spark, rows).repartition(5), arity, levels)).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(rows, arity)
    assert not all(r["verified"] for r in got) and any(r["verified"] for r in got)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(documents(spark, []).limit(0)).count() == 0
    one = [(7, "t", "en", "s", 1)]
    assert Counter(tuple(r) for r in merkle.verified(merkle.manifest(documents(spark, one))).collect()) == plain_manifest(one)


def test_a_parent_completes_in_any_order():
    leaves = [H(str(i)).encode() for i in range(7)]
    root, _ = climb([x.decode() for x in leaves], 2)
    for seed in range(5):
        parents, order = merkle.PartialParents(merkle.block_sizes(7, True, 2, 10), 2), list(range(7))
        random.Random(seed).shuffle(order)
        for k, i in enumerate(order):
            assert parents.top is None
            parents.add(i, leaves[i])
        assert parents.top.decode() == root and not parents.open


# -- sketches ---------------------------------------------------------------------------------------------------------------


def words_of(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def plain_sketch(text):
    own = shingle_sets([text.encode()], 5)[0].tolist()
    return sorted([h for h in own if h < (1 << 64) // sketch.FRACTION] or own[:1])


def test_trial_by_brute_force(spark):
    rows = [(i, words_of(i * 7 % 90, i), "en", "s", 1) for i in range(0, 160, 2)] + [(31, None, None, None, None), (33, "", "en", "s", 0), (35, "one", "en", "s", 0), (37, words_of(60, 4) + " é" * 50_000, "en", "s", 0), (39, words_of(300, 7), "en", "s", 0), (41, words_of(300, 7), "en", "s", 0), (None, "no id", "en", "s", 0)]
    got = {r["doc_id"]: r for r in sketch.edit_trial(documents(spark, rows).repartition(6)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for (doc_id, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new, other = map(plain_sketch, (text, edited, after))
        like = lambda a, b: float(len(a) == len(b)) if not a or not b else len({*a} & {*b}) / min(len(a), len(b))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert sketch.unpacked(r["sketch"]).tolist() == own and sketch.unpacked(r["edited_sketch"]).tolist() == new
        assert r["near_edited"] == like(own, new) and r["near_next"] == like(own, other)
    assert got[39]["sketch"] == got[41]["sketch"]


def test_trial_of_few_and_repeated_rows(spark):
    assert sketch.edit_trial(documents(spark, []).limit(0)).count() == 0
    one = sketch.edit_trial(documents(spark, [(4, "a b c d e f g h i", "en", "s", 1)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d e fa b c").hexdigest()[:0] + hashlib.sha256(("a b c d e f g h i"[:12] + "a b c").encode()).hexdigest()
    same = sketch.edit_trial(documents(spark, [(4, "a b c d e f", "en", "s", 1)] * 50).repartition(7)).collect()
    assert len(same) == 50 and {r["near_next"] for r in same} == {1.0}


def test_containment_of_unequal_texts_is_estimated(spark):
    large, small = words_of(40_000, 1), None
    parts = large.split(" ")
    small = " ".join(parts[500:1500]) + " " + words_of(1000, 2)
    a, b = sketch.sketches([large.encode(), small.encode()])
    assert abs(sketch.likeness(a, b) - 0.5) < 0.1
    rows = sketch.hashes(sketch.fingerprints(documents(spark, [(1, large, "en", "s", 1), (2, small, "en", "s", 1), (3, " ".join(parts[:20_000]), "de", "s", 1), (4, " ".join(parts[20_000:]), "de", "s", 1), (5, "", "de", "s", 1)])), ["doc_id"])
    r = sketch.containments(rows.where("doc_id = 2"), rows.where("doc_id = 1").withColumnRenamed("doc_id", "other"), "doc_id", "other").first()
    assert r["share"] == len({*a.tolist()} & {*b.tolist()}) / len(b)
    # A union's sketch is the union of the sketches, but for the shingles across the cut.
    both = sketch.merged(rows.where("doc_id in (3, 4)").withColumn("all", F.lit(1)), ["all"])
    assert abs(both.count() - len(a)) <= 4


def test_kept_share(spark):
    own = shingle_sets([words_of(30_000, 9).encode()], 5)[0]
    assert abs(len(sketch.sketches([words_of(30_000, 9).encode()])[0]) / len(own) * sketch.FRACTION - 1) < 0.1


# -- k-means ----------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size=64):
    kept = [(i, [int(x) * 64 if abs(x) >= 2**52 else int(np.floor(64 * x)) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centers = [e for _, e in sorted(kept, key=rank)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        own = [min(range(len(centers)), key=lambda c: (far(e, centers[c]), c)) for _, e in kept]
        if turn < rounds:
            groups = {c: [e for (_, e), o in zip(kept, own) if o == c] for c in range(len(centers))}
            centers = [[sum(x) // len(g) for x in zip(*g)] if (g := groups[c]) else centers[c] for c in range(len(centers))]
    d = [far(e, centers[c]) for (_, e), c in zip(kept, own)]
    fit = lambda x: x if x < 2**63 else None
    total = {c: sum(x for x, o in zip(d, own) if o == c) for c in own}
    return Counter((i, c, fit(x), fit(total[c]), fit(sum(d)), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for (i, _), c, x in zip(kept, own, d))


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, "c", "y") for i, e in rows], "vec_id long, embedding array<double>, label int, cluster string, distance string")


def blobs(n, seed=5, groups=9, spread=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (groups, 64))
    return [(i, (base[i % groups] + rng.normal(0, spread, 64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows, k, rounds", [
    (blobs(500), 16, 3), (blobs(300, 6, 4, 1.5), 40, 6), (blobs(120, 7), 16, 0), (blobs(9), 16, 3), (blobs(1), 16, 3),
    ([(i, [float(i % 3)] * 64) for i in range(60)], 16, 3), ([(i, [float((i * 7) % 5 - 2)] * 32 + [0.0] * 32) for i in range(80)], 5, 4),
    (blobs(40) + [(3, [0.5] * 64)] * 5 + [(None, [0.25] * 64), (60, None), (61, []), (62, [1.0] * 63), (63, [None] + [1.0] * 63), (64, [float("nan")] + [1.0] * 63), (65, [float("-inf")] + [1.0] * 63)], 16, 3),
    (blobs(30) + [(70, [1e6] * 64), (71, [-3e38] + [0.0] * 63), (72, [1e6 + 1 / 64] * 64)], 6, 3),
], ids=["blobs", "spread", "no-round", "few", "one", "ties", "grid", "edges", "huge"])
def test_clusters_by_brute_force(spark, rows, k, rounds):
    got = drake.clusters(vectors(spark, rows).repartition(3), k, rounds).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows, k, rounds)


def test_no_vectors(spark):
    assert drake.clusters(vectors(spark, [(1, None)])).count() == 0
    assert drake.clusters(vectors(spark, []).limit(0)).count() == 0


def test_bounds_save_scans(spark):
    """Most vectors of well-parted groups are settled by their bounds."""
    state, centroids = drake.cluster(vectors(spark, blobs(2_000, 5, 12, 0.2)), 16, 4)
    assert state.agg(F.sum("scanned")).first()[0] < 400
    assert state.agg(F.max(F.size("ids"))).first()[0] <= 4


def test_other_widths_and_scales(spark):
    rows = [(i, [x[0], x[1]]) for i, (_, x) in enumerate(blobs(80))]
    got = drake.clusters(vectors(spark, rows), 7, 3, size=2).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows, 7, 3, size=2)

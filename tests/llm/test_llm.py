"""Dealt operators: hand-made cases, brute force, round trips."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import audio, bpe, common, contamination, htmltext, lattice, neardup, pii, suffix, toxicity, urlrules
from sparkloom.llm.common import components
from sparkloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, rest string, score int, toxic int"
RNG = random.Random(5)
WORDS = ["the", "of", "and", "ing", "tion", "here", "ether", "stone", "river", "Über", "señal", "κόσμος"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "x", 1, 0) for i, t in enumerate(texts, start)], SCHEMA)


EDGES = [None, "", " ", "a", "word " * 4_000, "x" * 30_000, "same text here now", "same text here now"]


@pytest.fixture(scope="module")
def edge_rows(spark):
    return frame(spark, EDGES).unionByName(spark.createDataFrame([(None, "no id at all here", None, None, None)], SCHEMA))


# -- edge cases: every operator gives every row ------------------------------------------------------------------


@pytest.mark.parametrize("run", [
    lambda d: neardup.near_duplicates(d), lambda d: suffix.remove_repeats(d), lambda d: audio.audio_columns(d), lambda d: bpe.encode_documents(d, tokenizer("byte_bpe_50k.json")),
    lambda d: pii.personal_spans(d), lambda d: lattice.score_documents(d, tokenizer("piece_bpe_32k.model"), F.lit(False)), lambda d: toxicity.score(d, toxicity.ToxicityModel(np.full(toxicity.BUCKETS + 1, -1, np.int32), np.zeros(0), 0.0)), lambda d: pii.redact(d),
], ids=["neardup", "suffix", "audio", "bpe", "pii", "lattice", "toxicity", "redact"])
def test_edges_and_empty(spark, edge_rows, run):
    assert run(edge_rows).count() == len(EDGES) + 1
    assert run(edge_rows.limit(0)).count() == 0


def test_edges_of_others(spark, edge_rows):
    items = spark.createDataFrame([(1, "same text here now"), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.matches(edge_rows, items).collect()}
    assert got == {(6, 1), (7, 1)}
    assert contamination.matches(edge_rows, items.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (2, "http://a", "<p>x")], "page_id long, url string, html string")
    assert urlrules.judge_urls(pages).count() == 3 and htmltext.visible_text(pages).count() == 3


# -- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_learns(spark):
    texts = [prose(40) + (" you fool " if i % 4 == 0 else " ") + prose(40) for i in range(400)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    rated = toxicity.score(docs, toxicity.train(docs, labels), "p").where("doc_id >= 300").collect()
    assert np.mean([(r["p"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rated]) > 0.95


def test_toxicity_by_brute_force(spark):
    """Document counts of n-grams and scores, n-gram by n-gram."""
    texts = ["You FOOL, you", "über Zé", "", None, "fool", prose(9)]
    docs = frame(spark, texts)

    def buckets(text):
        found = set()
        points = [ord(c) for c in (text or "").lower()]
        for n in toxicity.SIZES:
            for i in range(len(points) - n + 1):
                h = 0
                for c in points[i : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                found.add((((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        return found

    marked = docs.select("text", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    other, toxic, n0, n1 = toxicity.document_counts(marked)
    for y, got in ((0, other), (1, toxic)):
        want = Counter(b for i, t in enumerate(texts) if i % 2 == y for b in buckets(t))
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)
    assert (n0, n1) == (3, 3)
    feature = np.full(toxicity.BUCKETS + 1, -1, np.int32)
    at = sorted(set.union(*map(buckets, texts)))
    feature[at] = np.arange(len(at))
    weight = np.random.default_rng(1).normal(size=len(at))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.ToxicityModel(feature, weight, -0.3)).collect()}
    for i, t in enumerate(texts):
        assert np.isclose(got[i], 1 / (1 + np.exp(0.3 - sum(weight[feature[b]] for b in buckets(t)))))


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())


# -- language model -----------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    names = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "ab", "▁a", "ba", "</s>"]
    scores = np.append(np.zeros(256), -np.arange(6.0))
    model = lattice.Pieces(names, lattice.prior(scores, np.arange(262) < 256))
    p = dict(zip(names, np.exp(model.logp)))
    assert np.isclose(sum(p.values()), 1) and p["▁"] > p["a"] > p["ba"] > p["<0x00>"]
    assert np.allclose(np.diff(lattice.prior(np.array([-0.5, -1.5, 0.0]), np.array([False, False, True])))[:1], -1)

    def every(s):
        if not s:
            return 1.0
        spelled = np.prod([p[f"<0x{b:02X}>"] for b in s[0].encode()])
        return spelled * every(s[1:]) + sum(p[s[:n]] * every(s[n:]) for n in range(1, len(s) + 1) if s[:n] in p)

    for word in ("abab", "b", "acb"):
        ((_, x),) = lattice.grids([word.encode()])
        assert np.isclose(np.exp(model.forward(x)[0][0, -1]), every("▁" + word), rtol=1e-9)


def test_lm_base_by_brute_force(spark):
    texts = [prose(30) for _ in range(60)] + [None]
    got = {r["doc_id"]: r for r in lattice.score_documents(frame(spark, texts), tokenizer("piece_bpe_32k.model"), F.col("doc_id") % 10 == 0).collect()}
    count, split = Counter(), lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in enumerate(texts):
        count.update(split(t) if i % 10 else [])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        base = sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))
        assert np.isclose(base, got[i]["base_score"]) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(count[w] > 0 for w in split(t)) and got[i]["score"] < 0


def test_lm_score_by_brute_force(spark):
    """Scores by a recursion over all segmentations of each whole text's words, with weights by an EM step done by hand."""
    texts = ["river stone", "the river", None, "stone the Zé", ""]
    names, start = lattice.load_pieces(tokenizer("piece_bpe_32k.model"))
    known = {n: i for i, n in enumerate(names[:-1]) if not n.startswith("<0x")}
    spelled = lambda c: [names.index(f"<0x{b:02X}>") for b in c.encode()]

    def ways(s):
        if not s:
            return [[]]
        return [spelled(s[0]) + w for w in ways(s[1:])] + [[known[s[:n]]] + w for n in range(1, len(s) + 1) if s[:n] in known for w in ways(s[n:])]

    words = Counter("▁" + w for t in texts if t for w in t.encode().lower().decode().split())
    logp = start
    n = np.zeros(len(start))
    for w, c in words.items():
        own = ways(w)
        p = np.exp([logp[x].sum() for x in own])
        for x, share in zip(own, p / p.sum()):
            np.add.at(n, x, c * share)
    n[-1] += len(texts)
    logp = np.log(0.5 * np.exp(start) + 0.5 * n / n.sum())
    got = {r["doc_id"]: r["score"] for r in lattice.score_documents(frame(spark, texts), tokenizer("piece_bpe_32k.model"), F.lit(False), rounds=1).collect()}
    for i, t in enumerate(texts):
        want = logp[-1] + sum(np.log(sum(np.exp(logp[x].sum()) for x in ways("▁" + w))) for w in (t or "").encode().lower().decode().split())
        assert np.isclose(got[i], want / np.log(10), rtol=1e-9)


# -- suffix arrays ------------------------------------------------------------------------------------------------


def test_scores_of_the_vocabulary_keep_their_share():
    """Whatever the counts, no piece weighs less than half of what its score says, and without counts the scores are all."""
    _, start = lattice.load_pieces(tokenizer("piece_bpe_32k.model"))
    for scale in (1, 10**6, 10**12):
        counts = np.zeros(len(start))
        counts[5] = scale
        found = lattice.weights(start, counts)
        assert np.allclose(found[6:20], start[6:20] + np.log(lattice.SHARE)) and abs(np.exp(found).sum() - 1) < 1e-6 and found[5] > np.log(0.5)
    assert (lattice.weights(start, np.zeros(len(start))) == start).all()
    assert abs(np.exp(start).sum() - 1) < 1e-6



@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, [2, 3, 256, 2, 1, 4][seed], 300).astype(np.uint8)
    order = suffix.two_stage_suffix_array(text, len(text))
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix.common_prefixes(text, order, 1000)
    for a, b, n in zip(order[:-1], order[1:], lcp[1:]):
        assert raw[a : a + n] == raw[b : b + n] and raw[a + n : a + n + 1] != raw[b + n : b + n + 1]


@pytest.mark.parametrize("giant", [400, 1])
def test_repeats_by_brute_force(spark, monkeypatch, giant):
    monkeypatch.setattr(suffix, "GIANT", giant)
    rng, size = random.Random(giant), 40
    shared = [prose(12, rng) for _ in range(4)]
    texts = [prose(8, rng) + rng.choice(shared)[rng.randrange(9) :] + prose(5, rng) for _ in range(30)] + ["ab" * 60, prose(9, rng), shared[0], shared[0]]
    blobs = [t.encode() for t in texts]
    count = Counter(b[i : i + size] for b in blobs for i in range(len(b) - size + 1))
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame(spark, texts), size, 20).collect()}
    for k, b in enumerate(blobs):
        mark = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                mark[i : i + size] = 1
        kept = bytes(x for x, m in zip(b, mark) if not m)
        assert (got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (mark.sum(), (np.diff(np.concatenate([[0], mark])) == 1).sum(), hashlib.sha256(kept).hexdigest())


def test_repeats_are_decided_by_sorting(spark):
    """A lone segment that occurs twice is found by its second copy; one that occurs once isn't."""
    body = bytes(range(65, 91)) * 20
    kinds = spark.createDataFrame([(1, 5, 6, 2, body), (2, 7, 8, 1, bytes(range(48, 58)) * 3 + body), (3, 9, 9, 1, body[:401])], "anchor long, c1 long, c2 long, n long, bytes binary").coalesce(1)
    got = {r["anchor"]: [(x["a"], x["b"]) for x in r["runs"]] for r in suffix.sorted_runs(kinds.where("anchor = 1"), 400).collect()}
    assert got == {1: [(0, len(body) - 400)]}


def test_large_groups_are_not_gathered(spark, monkeypatch):
    """Segments of an anchor with more than GIANT of them are halved without a shuffle by that anchor; a lone segment that occurs once goes unsorted."""
    monkeypatch.setattr(suffix, "GIANT", 2)
    written, stage = {}, suffix.staged
    monkeypatch.setattr(suffix, "staged", lambda df, name: stage(written.setdefault(name, df), name))
    rng, size, gram = random.Random(8), 24, 20
    core = bytes(rng.choices(range(97, 123), k=gram))
    own = lambda n: bytes(rng.choices(range(97, 123), k=n))
    left = own(size - gram)
    # Only the strings at the first start are equal.
    texts = [(1, left + core + b"%d" % k + own(size - gram - 1)) for k in range(5)] + [(2, left + core + own(size - gram))]
    rows = [(a, 0, k, 1, 0, size - gram, 0, size - gram, t) for k, (a, t) in enumerate(texts)]
    kinds = spark.createDataFrame(rows, "anchor long, c1 long, c2 long, n long, lo int, hi int, low int, high int, bytes binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["anchor"], r["c2"]): {(x["a"], x["b"]) for x in r["runs"]} for r in suffix.shared_runs(stage(kinds, "kinds"), size).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, k): {(0, 0)} for k in range(5)}
    plans = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in written.items() if "bytes" in df.columns}
    assert "suffix-halves-0" in plans
    assert not [k for k, plan in plans.items() if re.search(r"hashpartitioning\(anchor#\d+L?,", plan)]


def test_kept_text(spark):
    rows = spark.createDataFrame([(1, "é" * 10 + "x" * 30), (2, "ü" + "x" * 30 + "y"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.remove_repeats(rows, 25, 10, keep_text=True).collect()}
    assert [got[i]["kept_text"] for i in (1, 2, 3)] == ["é" * 10, "üy", ""]
    assert got[2]["kept_sha256"] == hashlib.sha256("üy".encode()).hexdigest()


# -- near duplicates ----------------------------------------------------------------------------------------------


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        words = prose(rng.randrange(30, 90), rng).split()
        for _ in range(rng.randrange(1, 9)):
            own = words.copy()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = prose(1, rng)
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.lower().encode().split() for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, texts), words=4).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert all(got[i]["n_shingles"] == len(s) for i, s in enumerate(sets))


def test_neighbours_in_crowded_regions(spark):
    """Rows are next to each other, or marked, across tasks as within them."""
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 2, (60, neardup.VALUES)).astype(">u4")
    sig[:, ::2] = 7  # many equal prefixes
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "node long, signature binary").repartition(3)
    got = neardup.neighbours(nodes).collect()
    rows = sorted((r["region"], bytes(r["rest"]), r["node"], r["place"]) for r in neardup.forest(nodes).collect())
    pairs, crowded = Counter(), set()
    for k in range(1, neardup.NEIGHBOURS + 2):
        for x, y in zip(rows, rows[k:]):
            if x[0] == y[0] and k <= neardup.NEIGHBOURS:
                pairs[x[2], y[2], x[3] if k == 1 else neardup.ORDERS] += 1
            elif x[0] == y[0]:
                crowded |= {(x[0], x[2]), (x[0], y[2])}
    assert len(pairs) > 100 and len(crowded) > 100
    assert Counter((r["node"], r["other"], r["place"]) for r in got if r["kind"] == neardup.PAIR) == pairs
    assert {(r["region"], r["node"]) for r in got if r["kind"] == neardup.CROWDED} == crowded


def test_exact_pairs_by_brute_force(spark):
    """No pair of different groups that reaches the threshold is missed, and pairs inside a group are not made."""
    rng = random.Random(4)
    common = [rng.getrandbits(40) for _ in range(300)]
    sets = []
    for i in range(120):
        own = common[: rng.choice([20, 60, 100])] if i % 3 else rng.sample(common, rng.choice([5, 20, 21]))
        sets.append(sorted({*own, *(rng.getrandbits(40) for _ in range(rng.choice([0, 1, 4, 30])))}))
    group = [i % 7 if i < 60 else i for i in range(120)]
    frame_ = spark.createDataFrame(list(enumerate(sets)), "node long, hashes array<long>")
    nodes = spark.createDataFrame(list(enumerate(group)), "node long, group long")
    pairs = neardup.exact_pairs(frame_, nodes)
    made = {(min(r), max(r)) for r in pairs.collect()}
    assert all(group[a] != group[b] for a, b in made)
    want = set()
    for a in range(120):
        for b in range(a + 1, 120):
            n = len({*sets[a]} & {*sets[b]})
            if group[a] != group[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                want.add((a, b))
    assert len(want) > 50 and want <= made
    assert {(min(r), max(r)) for r in neardup.confirmed(pairs, frame_).collect()} == want


def test_undecided(spark):
    near = spark.createDataFrame([(neardup.CROWDED, 1, 5), (neardup.CROWDED, 1, 6), (neardup.CROWDED, 2, 5), (neardup.CROWDED, 2, 7), (neardup.PAIR, 3, 9)], "kind int, region long, node long")
    groups = spark.createDataFrame([(5, 5), (6, 5)], "id long, component long")
    assert {tuple(r) for r in neardup.undecided(near, groups).collect()} == {(5, 5), (7, 7)}


@pytest.mark.parametrize("one_task", [0, common.ONE_TASK])
def test_components(spark, monkeypatch, one_task):
    """Links dealt over tasks and those united by one give the same components; no links, none."""
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links, "test").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100}
    assert components(links.where("a < 0"), "test").count() == 0


def test_components_at_random():
    """The links of one task, against a search from each id."""
    rng = random.Random(5)
    for size in (1, 5, 200):
        links = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(size)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])
        got = {i: c for part in common._united(iter([batch])) for i, c in zip(part["id"].to_pylist(), part["component"].to_pylist())}
        for start in got:
            seen = {start}
            while more := {y for a, b in links for x, y in ((a, b), (b, a)) if x in seen} - seen:
                seen |= more
            assert got[start] == min(seen)


# -- audio ----------------------------------------------------------------------------------------------------------


def test_audio_round_trip(spark):
    texts = ["", prose(3), prose(700), "é" * 576]
    for r in audio.audio_columns(frame(spark, texts), keep_tensors=True).collect():
        data = texts[r["doc_id"]].encode()
        pay = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert audio.from_wav(bytes(r["media"])) == pay
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()


def test_resample_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 4), (3, 1)):
        y = audio.resample(x, up, down)
        peak = np.abs(np.fft.rfft(y)).argmax() * (16_000 * up / down) / len(y)
        assert abs(peak - 440) < 2 and 0.8 < np.abs(y[500:-500]).max() < 1.2


@pytest.mark.parametrize(("up", "down"), [(3, 4), (1, 2), (2, 1), (5, 3)])
def test_resample_by_brute_force(up, down):
    """Zeros between inputs, the whole filter at the higher rate, then every ``down``-th value."""
    x, taps = np.random.default_rng(up).normal(size=203), audio.TAPS
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, audio.low_pass(up, down, taps))[taps * up :][: len(x) * up]
    want = np.array([full[m * down] for m in range(audio.resampled_size(len(x), up, down))])
    assert np.allclose(audio.resample(x.astype(np.float32), up, down), want, atol=1e-4)
    assert np.allclose(audio.resample(x.astype(np.float32), up, down, lo=31, hi=77), want[31:77], atol=1e-4)


@pytest.mark.parametrize("step", [3, audio.STEP])
def test_features_by_direct_transform(monkeypatch, step):
    """Frames by a direct Fourier sum over the whole resampled signal; tensors and time spans read back from the stored stream."""
    monkeypatch.setattr(audio, "STEP", step)
    data = b"".join(prose(400).encode()[:3_000] + b"\x80" * 2_000 for _ in range(3))[: 576 * 21]
    payload = audio.pad_payload(data)
    x = audio.resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    rate, n = audio.RATE * audio.UP / audio.DOWN, audio.frame_count(len(x))
    x = np.concatenate([x, np.zeros((n - 1) * audio.HOP + audio.FRAME - len(x))])
    t, bank = np.arange(audio.FRAME), audio.mel_bank(rate)
    wave_ = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), t) / audio.FRAME)
    frames = [x[i * audio.HOP : i * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME) for i in range(n)]
    want = np.array([np.log(np.abs(wave_ @ f) ** 2 @ bank + 1e-6) for f in frames])
    array, spans, active, count = audio.features(payload)
    table = pa.ipc.open_stream(audio.tensor_stream(array, spans)).read_all()
    got = table["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert count == n and n > audio.FRAMES and got.shape == (2 * audio.FRAMES, audio.MELS)
    assert np.abs(got[:n] - want).max() < 0.02 and not got[n:].any()
    assert table["start_s"].to_pylist() == [0, audio.FRAMES * audio.HOP / rate] and table["end_s"].to_pylist()[-1] == ((n - 1) * audio.HOP + audio.FRAME) / rate
    energy, on, spans_ = np.array([np.mean(f * f) for f in frames]), False, []
    for i, e in enumerate(energy):
        if not on and e > audio.HIGH * energy.mean():
            spans_.append([i, n])
            on = True
        elif on and e < audio.LOW * energy.mean():
            spans_[-1][1] = i
            on = False
    assert len(spans_) > 1 and np.allclose(active, [[a * audio.HOP / rate, ((b - 1) * audio.HOP + audio.FRAME) / rate] for a, b in spans_])


def test_hysteresis():
    assert audio.hysteresis(np.array([0, 0, 9, 3, 3, 0, 9, 9.0]), 1.2, 0.5).tolist() == [[2, 5], [6, 8]]


# -- HTML -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("page", "text"), [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<title>T</title><script>x<p></script><div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("a<br>b &amp; c <b>bold</b>, d", "a\nb & c bold, d"),
    ("<pre>  keep\n   this</pre>", "  keep\n   this"),
    ("plain text", "plain text"),
    ("", ""),
    ("a<svg><title>no</title><text>one</text><text>two</text><path d=x /></svg>b", "a one two b"),
    ("<math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math>", "x="),
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no</div>", "yes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>bb<td>y</table>", "wide      x\na     bb  y"),
    ("<p title='a>b' class=\"c\">x</p><b don't>y</b>", "x\n\ny"),
    ("<noscript>no</noscript><object>no</object>a < b </> c", "a < b c"),
    ("x<!-- never ends <p>y", "x"),
    ("x<a href='never ends>y</a>z", "xyz"),
    ("x<a never ends", "x"),
])
def test_html(page, text):
    assert htmltext.render(page) == text


def test_broken_pages_take_linear_time():
    for page in ("<a " * 200_000, "<a href='" * 100_000, '<a "' * 100_000 + ">", "<!--" * 100_000, "</" * 200_000, "<" * 200_000, "<script>" * 50_000, "<p>" * 100_000, "<b>" * 100_000, "&" * 200_000, "<td>" * 50_000, "<table>" * 20_000, "<div hidden>" * 50_000, "<tr><td rowspan=9999>" * 5_000):
        began = time.time()
        htmltext.render(page)
        assert time.time() - began < 8, page[:20]


def test_hidden_beyond_the_deepest_level():
    page = "<div>" * 450 + "<p hidden>SECRET<p>no</p></p>seen<i style='visibility:hidden'>SECRET</i> end"
    assert "SECRET" not in htmltext.render(page) and "seen" in htmltext.render(page)


def test_rendering_by_brute_force():
    """Random trees of blocks, inline elements, breaks and invisible parts, against text collected by plain rules."""
    rng = random.Random(12)

    def tree(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["text", "text", "br", "div", "p", "span", "hidden", "unseen", "seen"]) if depth < 4 else "text"
            inner = rng.choice(WORDS) if kind == "text" else [] if kind == "br" else tree(depth + 1)
            out.append((kind, [x for x in inner if x[0] not in ("div", "p")] if kind == "p" else inner))
        return out

    tags = {"div": ("<div>", "</div>"), "p": ("<p>", "</p>"), "span": ("<span>", "</span>"), "hidden": ("<span hidden>", "</span>"), "unseen": ("<span style=visibility:hidden>", "</span>"), "seen": ("<span style='visibility:visible'>", "</span>")}

    def source(nodes):
        return "".join(x if k == "text" else "<br>" if k == "br" else tags[k][0] + source(x) + tags[k][1] for k, x in nodes)

    def flat(nodes):  # no block inside inline parts or paragraphs, as HTML would move it
        return [(k, x if k == "text" else [y for y in flat(x) if k == "div" or y[0] not in ("div", "p")]) for k, x in nodes]

    def collect(nodes, seen, out):
        for k, x in nodes:
            if k == "text":
                out.append(x if seen else "")
            elif k == "br":
                out.append("\n")  # hidden text still has its lines
            elif k != "hidden":
                edge = {"div": "<", "p": "<<"}.get(k, "")
                out.append(edge)
                collect(x, {"unseen": False, "seen": True}.get(k, seen), out)
                out.append(edge)
        return out

    for _ in range(300):
        nodes = flat(tree(0))
        want = "".join(collect(nodes, True, [])).replace("<", "\n").split("\n")
        assert [s for s in htmltext.render(source(nodes)).split("\n") if s] == [s for s in want if s]


# -- personal data ----------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_by_brute_force(spark):
    rng = random.Random(8)
    bits = ["a@b.co", "x_@y-z.org.uk", "a@b.com_x@y.org", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+49.30.123", "12", "é", "𝄞", ".", "@", "+", " ", "\n", "007.000255.1.1"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(12)) for _ in range(150)]
    got = {r["doc_id"]: r["s"] for r in pii.personal_spans(frame(spark, texts)).select("doc_id", pii.span_list(F.col("base")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_spans(t) for t in texts]


def test_bootstrapping_finds_unseen_identifiers(spark):
    texts = [f"contact: u{i}@mail.com today" for i in range(30)] + ["contact: badge-77123x today", "river: badge-77999x stone"]
    spans = {r["doc_id"]: r["s"] for r in pii.personal_spans(frame(spark, texts)).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()}
    assert spans[30] == "id:9:21" and spans[31] == "" and spans[3].startswith("email:")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    assert clean[3] == "contact: <EMAIL> today" and clean[30] == "contact: <ID> today" and clean[31] == texts[31]


# -- decontamination --------------------------------------------------------------------------------------------------


def test_leaks_with_edits(spark):
    rng = random.Random(2)
    items = [prose(30, rng) for _ in range(20)]
    texts, wanted = [], set()
    for i in range(60):
        body = [prose(60, rng), prose(60, rng)]
        if i % 2:
            k = rng.randrange(20)
            own = list(items[k])
            for _ in range(rng.randrange(0, len(own) // 20)):
                own[rng.randrange(len(own))] = rng.choice(["", "q", "zz"])
            body.insert(1, "".join(own).upper() if i % 4 == 1 and items[k].isascii() else "".join(own))
            wanted.add((i, k))
        texts.append(" ".join(body))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.matches(frame(spark, texts), bench).collect()}
    assert got == wanted


def test_best_match():
    assert contamination.best_match(b"kitten", b"xx sitting yy") == (2, 9)
    assert contamination.best_match(b"abc", b"zabcz") == (0, 4)


# -- URL rules ----------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = [("http://A.Example.NET/en/1?x", "example.net/en/", "allow"), ("http://net/x", "net/", "block"), ("http://planet/x", None, "allow"), ("http://x.net", None, "allow"), ("http://a.org/fr/", "org/fr/", "allow"), ("http://a.org/FR/", None, "allow"), ("http://x.example.com/de/1", "example.com/de/", "block"), ("http://casino-win.example.com/en/", None, "block"), ("net/x", None, "allow"), ("a://b.net/?://c.org/fr/", "net/", "block")]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(cases))] == [(r, v) for _, r, v in cases]


def test_filter_lists(spark, monkeypatch):
    """Lists of rules, as a literal of the plan and as a table, against every rule tried on every URL."""
    rng = random.Random(6)
    words = ["ads", "shop", "news", "track", "img", "a1", "x"]
    hosts = [".".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + rng.choice([".com", ".net"]) for _ in range(30)]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(words)}/{rng.choice(words)}{rng.choice(['', '.html', '?q', '/'])}" for _ in range(150)] + [None, "", "no url"]
    lines = ["! comment", "", *{f"||{rng.choice(hosts)}/{rng.choice(['', 'ads/'])}" for _ in range(12)}, ".track.", "/ads/*.html", "@@/ads/news*", "*shop*img*", "@@||a1.com/x/"]
    rules = urlrules.parse_list("\n".join(lines))
    assert len(rules) == len(lines) - 2

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest).group()
        target = host.lower() + re.match("[^?#]*", rest[len(host) :]).group()
        return max(((r.weight, r.pattern, r.verdict) for r in rules if re.search(r.pattern, target)), default=(0, "", "allow"))[2]

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    want = {i: judge(u) for i, u in enumerate(urls)}
    assert {"allow", "block"} == set(want.values())
    for most in (urlrules.LITERAL, 0):
        monkeypatch.setattr(urlrules, "LITERAL", most)
        assert {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(pages, rules).collect()} == want


# -- BPE ----------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.BpeCodec(open(path, encoding="utf-8").read())
    rng = random.Random(4)
    letters = list("abc XYZ 0189 \n\t'.,!-_\u00a0\u2003éßñ漢字🙂") + ["<|endoftext|>", "'ll", "\x1c", "\u0085", "ing ", "the "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)] + ["a" * 5000, "ab" * 3000, ""]
    for text, ids in zip(texts, ours.encode_batch(texts)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False) == text

"""Every stage of the pipeline against a brute-force version of it, and its edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import contamination, neardup, pii, toxicity
from sparkloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def toxic_scores(spark, rows):
    """Scores of the classifier that the stage fits, n-gram by n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = {}
    for r in rows:
        points, found = [ord(c) for c in (r["text"] or "").lower()], set()
        h = [0] * len(points)
        for n in range(1, max(toxicity.SIZES) + 1):
            h = [(h[i] * 0x01000193 + points[i + n - 1]) & 0xFFFFFFFF for i in range(len(points) - n + 1)]
            if n in toxicity.SIZES:
                found |= {(((x ^ (x >> 15)) * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF) >> (32 - toxicity.BITS) for x in h}
        f = [int(model.feature[b]) for b in found]
        out[r["doc_id"]] = 1 / (1 + math.exp(-sum(model.weight[i] for i in f if i >= 0) - model.bias))
    return out


def first_of_groups(rows):
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def leaks(rows, items):
    """Documents that hold a part within a tenth of an item's length: all pairs, but those whose three-byte strings forbid it."""
    grams = lambda t: Counter(t[i : i + 3] for i in range(len(t) - 2))
    items = [(t, grams(t)) for t in (contamination.normal(x.encode()).strip(b" ") for x in items if x) if t]
    out = set()
    for r in rows:
        text = contamination.normal((r["text"] or "").encode())
        own = grams(text)
        for t, g in items:
            most = len(t) // 10
            if sum((g & own).values()) >= len(t) - 2 - 3 * most and contamination.best_match(t, text)[0] <= most:
                out.add(r["doc_id"])
    return out


def spans_of(texts):
    """Spans of each text, with a graph of patterns and instances in dictionaries."""
    case = lambda w: "none" if not w else "digit" if w[0].isdigit() else "upper" if w[0].isupper() else "lower"
    spans, others, graph, seeds, never = {}, {}, set(), set(), set()
    for text in texts:
        found, raw = [], []
        for k, (kind, pattern) in enumerate(BASE.items()):
            for m in re.finditer(pattern, text):
                raw.append(m.span())
                digits = re.sub("[^0-9]", "", m.group())
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
                if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                    found.append((m.start(), k, m.end()))
        spans[text], others[text] = sorted(found), []
        entities = [(a, b, True) for a, _, b in found]
        for m in re.finditer(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{8,}", text):
            if not any(a < m.end() and m.start() < b for a, _, b in found):
                entities.append((*m.span(), False))
                others[text].append(m.span())
                never |= {m.group()} if any(a <= m.start() and m.end() <= b for a, b in raw) else set()
        for a, b, seed in entities:
            left, right, own = re.search(r"([^\W_]+)(?:\W|_)*$", text[:a]), re.match(r"(?:\W|_)*([^\W_]+)", text[b:]), text[a:b]
            left, right = left.group(1) if left else "", right.group(1) if right else ""
            seeds |= {own} if seed else set()
            prefix = re.match("[A-Za-z]{3,}", own)
            graph |= {(k, p, own) for k, p in (("L", left.lower()), ("R", right.lower()), ("C", case(left) + case(right)), ("P", prefix.group()[:4] if prefix else "")) if p}
    trust = {x: float(x in seeds) for _, _, x in graph}
    for _ in range(pii.TURNS):
        scored = defaultdict(list)
        for k, p, x in graph:
            scored[k, p].append(trust[x])
        scored = {p: (sum(v) / (len(v) + pii.SMOOTH), len(v)) for p, v in scored.items() if len(v) > 1}
        doubt, strong = defaultdict(lambda: 1.0), set()
        for k, p, x in graph:
            if (k, p) in scored:
                doubt[x] *= max(1e-9, 1 - scored[k, p][0])
                if k != "C" and scored[k, p][0] >= pii.STRONG and scored[k, p][1] >= pii.SUPPORT:
                    strong.add(x)
        trust = {x: 1.0 if x in seeds else 0.0 if x in never else 1 - doubt[x] for x in trust}
    ids = {x for x in trust if x not in seeds and x not in never and trust[x] >= pii.TRUST and x in strong}
    return {t: sorted(spans[t] + [(a, 4, b) for a, b in others[t] if t[a:b] in ids]) for t in spans}


def redacted(text, spans):
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{pii.KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def test_stages_by_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    scores = toxic_scores(spark, rows)
    # The least distance to the threshold says that rounding decides nothing.
    assert min(abs(s - 0.5) for s in scores.values()) > 1e-6
    rows = [r for r in rows if scores[r["doc_id"]] < 0.5]
    kept = first_of_groups(rows)
    rows = [r for r in rows if r["doc_id"] in kept]
    gone = leaks(rows, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [r for r in rows if r["doc_id"] not in gone]
    assert gone and 50 < len(rows) < docs.count()
    spans = spans_of({r["text"] for r in rows if r["text"] is not None})
    assert any(spans.values())
    theirs, want = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), {}
    for r in rows:
        text = redacted(r["text"], spans[r["text"]]) if r["text"] is not None else ""
        ids = np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_discovered_by_brute_force(spark):
    """Spans of a corpus with identifiers that stand beside seeds, beside patterns, in rejected numbers, and nowhere."""
    texts = [f"mail u{i}@x.org or call +49 30 1234{i:03d} now" for i in range(25)] + [f'the token = "{i:x}9a7bcdef0123" is new' for i in range(700, 712)]
    texts += [f"password={i}bd7c5a91x of" for i in range(12)] + ["number 1234567890123456 of", "only q7w8e9r0t1 here", "", "token=4111111111111112 or", "AKIA12345678 stands alone."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = spans_of(set(texts))
    got = {r["doc_id"]: [(x["s"], x["k"], x["e"]) for x in r["spans"]] for r in pii.personal_spans(docs).collect()}
    assert got == {i: want[t] for i, t in enumerate(texts)}
    assert sum(k == 4 for v in want.values() for _, k, _ in v) >= 20
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean == {i: redacted(t, want[t]) for i, t in enumerate(texts)}


ODD = "doc_id long, text string, __toxicity int, __key string, __place long, __spans string, n_chars int, rank string"
LONG = "word " * 30_000
ROWS = [(i, t, 1, "k", 2, "s", 7, "r") for i, t in enumerate([None, "", " \n", "a", LONG, "x" * 40_000, "write to a@b.org now", "write to a@b.org now"])] + [(None, "no id at all", None, None, None, None, None, None)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_edges(spark, name, stage):
    """Null, empty, blank and very long texts, a null id, repeated rows, clashing names, and no rows at all."""
    docs = spark.createDataFrame(ROWS, ODD)
    out = stage(spark, docs, SF)
    got = sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    if name == "bpe":
        assert [r["n_tokens"] > 0 for r in got] == [False, False, *[True] * 7]
    else:
        assert out.columns == docs.columns
        kept = [r for r in ROWS if not (name == "near_duplicates" and r[0] == 7)]
        if name == "pii":
            kept = [(r[0], "write to <EMAIL> now", *r[2:6], 20, r[7]) if r[0] in (6, 7) else r for r in kept]
        assert [tuple(r) for r in got] == kept
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_results_that_are_open_outlive_the_pipeline(spark):
    """A frame made before a run of the pipeline reads its own staged tables after it."""
    sf = "/root/testdata/sf0.001"
    held = neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), words=4)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert held.count() == spark.read.parquet(f"{sf}/documents.parquet").count()

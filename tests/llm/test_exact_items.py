"""Decontamination of items that few or no windows fit: no match within the permitted edits is lost."""

import random

import pytest

from sparkloom.llm import contamination

LETTERS, SIGNS = b"abcdefghijklmnopqrstuvwxyz", b"+-*/=<>()[]{}|&^%$#@!~;:,.?"


def edited(t, kind, at, rng, letters):
    """``t`` with a single-byte edit at each place of ``at``."""
    out = bytearray()
    for i, c in enumerate(t):
        own = "" if i not in at else kind if kind != "mixed" else rng.choice(["insert", "delete", "substitute"])
        new = bytes([rng.choice(letters)])
        out += {"": bytes([c]), "insert": bytes([c]) + new, "delete": b"", "substitute": new}[own]
    return bytes(out)


def some(n, rng, letters):
    return bytes(rng.choices(letters, k=n))


def phrase(n, rng):
    return b" ".join(some(rng.randrange(1, 9), rng, LETTERS) for _ in range(n))[:n].strip()


@pytest.mark.parametrize("make", ["signs", "one word", "words"])
@pytest.mark.parametrize("size", [64, 70, 99, 300, 520, 1_700, 4_000])
def test_none_lost(make, size):
    """Every item with as many edits as permitted, at random and even places, is found: with no word, in the midst of a word, and in words."""
    rng = random.Random(f"{make} {size}")
    letters = SIGNS if make == "signs" else LETTERS
    own = (lambda: phrase(size, rng)) if make == "words" else lambda: some(size, rng, letters)
    items = [(i, own()) for i in range(30 if size < 1_000 else 3)]
    index = contamination.ItemIndex(items)
    texts, wanted = [], []
    for k, (_, t) in enumerate(items):
        most = len(t) // 10
        even = {(2 * j + 1) * len(t) // (2 * most) for j in range(most)}
        for kind in ("insert", "delete", "substitute", "mixed"):
            for at in (even, set(rng.sample(range(len(t)), most)), set()):
                texts.append(some(90, rng, letters) + edited(t, kind, at, rng, letters) + some(90, rng, letters))
                wanted.append(k)
    assert all(k in [i for i, *_ in found] for k, found in zip(wanted, index.search(texts)))
    far = [edited(t, "substitute", set(range(0, len(t), 4)), rng, b"\x01") for _, t in items]
    assert index.search(far) == [[] for _ in items]


def test_equals_brute_force_among_chance_matches():
    """On texts over three letters, full of chance matches, every item has its least distance."""
    rng = random.Random(5)
    items = [(i, some(rng.randrange(1, 90), rng, b"ab ") + b"c") for i in range(40)]
    items += [(40, some(600, rng, b"abc ") + b"c"), (41, some(1_100, rng, b"ab"))]
    index = contamination.ItemIndex(items)
    texts = [some(rng.randrange(300), rng, b"abc ") for _ in range(30)] + [some(50, rng, b"abc") + edited(t, "mixed", set(rng.sample(range(len(t)), len(t) // 10)), rng, b"abc") for _, t in items]
    wanted = [[(k, contamination.best_match(t, text)[0]) for k, (_, t) in enumerate(index.items) if contamination.best_match(t, text)[0] <= len(t) // 10] for text in texts]
    assert sum(map(len, wanted)) > 100
    assert [[(k, d) for k, d, *_ in own] for own in index.search(texts)] == wanted


def test_best_place():
    """Where a text holds an item twice, the nearer one is reported, though a window starts in the other one only."""
    rng = random.Random(9)
    item = b"word " + some(195, rng, SIGNS)
    farther, nearer = edited(item, "substitute", {30, 60, 90, 120}, rng, b"0"), b"=" + item[1:150] + b"0" + item[151:]
    index = contamination.ItemIndex([(1, item)])
    assert index.search([farther]) == [[(0, 4, 0, 200)]]
    assert index.search([farther + some(40, rng, SIGNS) + nearer])[0][0][:2] == (0, 2)


def test_few_hits_at_once(monkeypatch):
    """Results do not depend on how many hits are worked on at once."""
    rng = random.Random(3)
    items = [(i, some(100, rng, b"ab ") + b"c") for i in range(10)] + [(10, some(1_300, rng, LETTERS))]
    texts = [some(2_000, rng, b"ab ") + t + some(50, rng, b"ab ") for _, t in items]
    wanted = contamination.ItemIndex(items).search(texts)
    monkeypatch.setattr(contamination, "HITS", 7)
    assert contamination.ItemIndex(items).search(texts) == wanted and all(wanted)


def test_runs_of_one_byte():
    """Items and texts with long runs of one byte: results are those of brute force, and a run is one hit of a piece, not one at each place."""
    rng = random.Random(12)
    items = [(i, some(rng.randrange(5, 60), rng, LETTERS) + b"-" * rng.randrange(9, 150) + some(rng.randrange(5, 60), rng, LETTERS)) for i in range(20)]
    items += [(20, b"-" * 40), (21, b"-" * 90 + b"=" * 30), (22, b"-" * 700)]
    index = contamination.ItemIndex(items)
    texts = [b"-" * 900, b"x" + b"-" * 60 + b"=" * 80, b"ab" + b"-" * 645 + b"yz"] + [b"-" * 300 + edited(t, "mixed", set(rng.sample(range(len(t)), len(t) // 10)), rng, b"-a") + b"-" * 200 for _, t in items]
    wanted = [[(k, contamination.best_match(t, text)[0]) for k, (_, t) in enumerate(index.items) if contamination.best_match(t, text)[0] <= len(t) // 10] for text in texts]
    assert [[(k, d) for k, d, *_ in own] for own in index.search(texts)] == wanted
    rule = contamination.padded(contamination.np.full(100_000, ord("-"), contamination.np.uint8))
    assert sum(len(at) for at, *_ in index.piece_hits(rule, 100_000)) < 20_000

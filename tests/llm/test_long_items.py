"""Decontamination of long items whose edits all go one way."""

import random

import pytest

from sparkloom.llm import contamination


def words(n, rng):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n)).encode()


@pytest.mark.parametrize("size", [3_000, 8_000, 16_000])
def test_one_way_edits(size):
    rng = random.Random(size)
    items = [(i, words(size // 5, rng)[:size].strip()) for i in range(3)]
    index = contamination.ItemIndex(items)
    texts, wanted = [], []
    for k, (_, t) in enumerate(items):
        most = len(t) // 10
        gone = set(rng.sample(range(len(t)), most - 2))
        shorter = bytes(c for i, c in enumerate(t) if i not in gone)
        more = set(rng.sample(range(len(t)), most - 2))
        longer = b"".join(bytes([c, 113]) if i in more else bytes([c]) for i, c in enumerate(t))
        kept, left = [], most
        for w in t.split(b" "):
            if len(w) < left and rng.random() < 0.12:
                left -= len(w) + 1
            else:
                kept.append(w)
        for edited in (shorter, longer, b" ".join(kept)):
            texts.append(words(100, rng) + b" " + edited + b" " + words(100, rng))
            wanted.append([k])
    texts.append(words(size // 5, rng))
    assert [[k for k, *_ in own] for own in index.search(texts)] == [*wanted, []]


def test_short_items():
    items = [(1, b"Yes"), (2, b"4 + 3"), (3, b" "), (4, b"yes"), (5, b"a passage of some length"), (6, b"e"), (7, b"seven b")]
    index = contamination.ItemIndex(items)
    texts = [b"no", b"oh YES, yes", b"is 4 + 3 odd", b"", b"a passage of some length", b"4 + ", b"3", b"in seven b"]
    got = [[(index.items[k][0], *rest) for k, *rest in own] for own in index.search(texts)]
    assert sorted(got[1]) == [(1, 0, 3, 6), (4, 0, 3, 6), (6, 0, 4, 5)]
    assert [sorted(i for i, *_ in own) for own in got] == [[], [1, 4, 6], [2], [], [5, 6], [], [], [6, 7]]
    assert contamination.ItemIndex([(1, b"yes")]).search([b"say yes", b"no"])[0] == [(0, 0, 4, 7)]


def edited(t, kind, most, rng):
    """``t`` with ``most`` single-byte edits at random places."""
    at, letter = set(rng.sample(range(len(t)), most)), lambda: rng.choice(b"abcdefghijklmnopqrstuvwxyz")
    out = bytearray()
    for i, c in enumerate(t):
        own = kind if kind != "mixed" else rng.choice(["insert", "delete", "substitute"])
        if i not in at:
            out.append(c)
        elif own == "insert":
            out += bytes([c, letter()])
        elif own == "substitute":
            out.append(letter())
    return bytes(out)


@pytest.mark.parametrize("size", [40, 70, 100, 250, 980, 2_290, 5_000])
def test_recall(size):
    """Of items with edits of up to a tenth of their length, at least 0.9 are found, whatever the kind of edit; those with more are not."""
    rng = random.Random(size)
    items = [(i, words(size // 4, rng)[:size].strip()) for i in range(10 if size > 2_000 else 40)]
    index = contamination.ItemIndex(items)
    for kind in ("insert", "delete", "substitute", "mixed"):
        texts = [words(30, rng) + b" " + edited(t, kind, len(t) // 10, rng) + b" " + words(30, rng) for _, t in items]
        found = index.search(texts)
        assert sum(any(k == i for k, *_ in own) for i, own in enumerate(found)) >= 0.9 * len(items), kind
        assert all(d <= index.allowed[k] for own in found for k, d, *_ in own)
    assert index.search([edited(t, "substitute", len(t) // 3, rng) for _, t in items]) == [[] for _ in items]


def test_equals_brute_force():
    """Every found item has its least distance, and no item is found where the plain distance forbids it."""
    rng = random.Random(11)
    items = [(i, words(rng.randrange(2, 25), rng)) for i in range(15)]
    index = contamination.ItemIndex(items)
    texts = [words(10, rng) + b" " + edited(items[i % 15][1], "mixed", len(items[i % 15][1]) // 12, rng) + words(8, rng) for i in range(30)]

    def least(pattern, text):
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            before, row = row, [i]
            for j, c in enumerate(text, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != c)))
        return min(row)

    wanted = [[(k, least(t, text)) for k, (_, t) in enumerate(index.items) if least(t, text) <= len(t) // 10] for text in texts]
    assert sum(map(len, wanted)) >= 30
    assert [[(k, d) for k, d, *_ in own] for own in index.search(texts)] == wanted

"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

Each leaf of the tree holds the rank of the pair that starts at one symbol; the root holds the
smallest rank and, among equals, the leftmost place. One merge changes three leaves, so it costs
a logarithmic number of updates, and merging ends when the root holds no rank. New pre-tokens of
a batch are merged together: one row of the tree array for each pre-token.

The vocabulary is a ``tokenizers`` JSON file, whose path is a parameter. Nothing is trained.
Null texts count as empty; an empty text has no ids and decodes to the empty text. Long texts
without a break cost n log n. Rows are independent, so repeated rows and ties need no rule. Empty tables give empty
results; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, new_key, once, small_batches, text_slices

#: How byte-level vocabularies split a text before merging (fixed pattern of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 62
#: Pre-tokens whose ids are kept by a worker; beyond it the store starts anew. It changes speed only.
KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeCodec:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        model, letters = data["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.pieces = [b""] * size
        for token, i in model["vocab"].items():
            self.pieces[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        by_bytes = {p: i for i, p in enumerate(self.pieces) if i not in self.special.values()}
        self.start = np.array([by_bytes.get(bytes([b]), -1) for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        self.keys, self.ranks = keys, order[first].astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ids: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair has no merge."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; all words share one array of trees, so they should be of like length."""
        n, longest = len(words), max(map(len, words))
        width = 1 << max(1, (longest - 1).bit_length())
        bits = np.int64(width.bit_length())
        sizes = np.fromiter(map(len, words), np.int64, n)
        symbol = np.full((n, width), -1, np.int64)
        symbol[np.arange(width) < sizes[:, None]] = self.start[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((n, 2 * width), NONE, np.int64)
        place = np.arange(width, dtype=np.int64)
        pairs = symbol[:, 1:] >= 0
        ranks = self.rank(symbol[:, :-1][pairs], symbol[:, 1:][pairs])
        leaf = np.full((n, width - 1), NONE, np.int64)
        leaf[pairs] = np.where(ranks < NONE, (ranks << bits) | np.broadcast_to(place[:-1], pairs.shape)[pairs], NONE)
        tree[:, width : 2 * width - 1] = leaf
        at = width
        while at > 1:
            at >>= 1
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        after[np.arange(n), sizes - 1] = -1
        rows = np.flatnonzero(tree[:, 1] < NONE)
        mask = (np.int64(1) << bits) - 1
        while len(rows):
            root = tree[rows, 1]
            pos = root & mask
            gone = after[rows, pos]
            symbol[rows, pos] = self.merged[root >> bits]
            symbol[rows, gone] = -1
            new = after[rows, gone]
            after[rows, pos] = new
            follow = new >= 0
            before[rows[follow], new[follow]] = pos[follow]
            self._touch(tree, symbol, rows, pos, new, width, bits)
            tree[rows, width + gone] = NONE
            self._raise(tree, rows, width + gone)
            prior = before[rows, pos]
            has = prior >= 0
            self._touch(tree, symbol, rows[has], prior[has], pos[has], width, bits)
            rows = rows[tree[rows, 1] < NONE]
        return [s[s >= 0] for s in symbol]

    def _touch(self, tree, symbol, rows, left, right, width, bits) -> None:
        """Sets the leaf of the pair (left, right) and what stands above it."""
        value = np.full(len(rows), NONE, np.int64)
        there = right >= 0
        rank = self.rank(symbol[rows[there], left[there]], symbol[rows[there], right[there]])
        value[there] = np.where(rank < NONE, (rank << bits) | left[there], NONE)
        tree[rows, width + left] = value
        self._raise(tree, rows, width + left)

    @staticmethod
    def _raise(tree, rows, node) -> None:
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def learn(self, tokens) -> None:
        """Puts the ids of new pre-tokens into the store."""
        if len(self.ids) + len(tokens) > KEPT:
            self.ids.clear()
        classes: dict[int, list[str]] = {}
        for t in tokens:
            classes.setdefault(max(2, len(t.encode()) - 1).bit_length(), []).append(t)
        for group in classes.values():
            step = max(1, (1 << 17) // max(2, len(group[0].encode())))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for t, found in zip(part, self.merge([t.encode() for t in part])):
                    self.ids[t] = found.astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split, cut, parts = self.split, self.specials, []
        for text in texts:
            if cut is None or not cut.search(text):
                parts.append(split(text))
            else:
                own, at = [], 0
                for m in cut.finditer(text):
                    own += [*split(text[at : m.start()]), self.special[m.group()]]
                    at = m.end()
                parts.append(own + split(text[at:]))
        wanted = {t for own in parts for t in own if t.__class__ is str}
        fresh = wanted - self.ids.keys()
        if fresh:
            if len(self.ids) + len(fresh) > KEPT:
                fresh = wanted
            self.learn(fresh)
        get = self.ids
        return [b"".join([get[t] if t.__class__ is str else t.to_bytes(4, "little") for t in own]) if cut else b"".join([get[t] for t in own]) for own in parts]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids; special tokens stay, wrong UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary]).

    The file at ``tokenizer_path`` is read by the driver and sent along (its size does not depend on the data).
    Null texts count as empty; other columns of ``docs`` are left out.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    key = new_key()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once("bpe", key, lambda: BpeCodec(definition.value))
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = codec.encode_batch([b.decode() for b in as_bytes(part.column("text"))])
                out = [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)

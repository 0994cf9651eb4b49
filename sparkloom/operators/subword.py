"""Static embeddings by subwords: longest-match pieces of a real vocabulary, int8 rows, integer sums. The rows are learned from a corpus.

A vocabulary is the JSON file of a byte-pair tokenizer whose pieces mark the end of a word. Words are split as that file says and cut
into the longest pieces that a trie holds, from left to right; what no piece begins is dropped by a byte. A text's vector is the mean of its
pieces' rows at unit length. Null and empty texts, and texts without a known piece, have a zero vector.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkloom.operators.vectors import in_blocks

#: Tokens of a text that a model of fixed length sees; None: all.
MOST = 512
#: Words, and runs without a space, whose pieces a worker remembers, and letters of the longest run.
CACHED, LONGEST = 1 << 18, 64
#: A pattern of words that hold no space.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTROLS = frozenset("\x1c\x1d\x1e\x1f")
#: Pieces whose contexts are summed at once, and at whose number texts are put together.
BLOCK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Pieces of a vocabulary in a trie over bytes: each node may end a piece within a word and one at its end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pieces, mark = model["model"]["vocab"], model["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words, self.apart = regex.compile(pattern), pattern == SPACED
        self.size = max(pieces.values()) + 1
        self.median = int(median(len(p.removesuffix(mark)) for p in pieces))
        self.trie: dict = {}
        for piece, number in pieces.items():
            body = piece.removesuffix(mark) if mark else piece
            if body and all(c in letters for c in body):
                node = self.trie
                for c in body:
                    node = node.setdefault(letters[c], {})
                node["last" if mark and piece != body else "inner"] = number
        self.cache: dict[str, list[int]] = {}
        self.runs: dict[str, list[int]] = {}

    def pieces(self, word: str) -> list[int]:
        """Numbers of the pieces of one word."""
        raw, at, out = word.encode(), 0, []
        while at < len(raw):
            node, best, end = self.trie, None, at + 1
            for i in range(at, len(raw)):
                node = node.get(raw[i])
                if node is None:
                    break
                found = node.get("last" if i + 1 == len(raw) else "inner")
                if found is not None:
                    best, end = found, i + 1
            if best is not None:
                out.append(best)
            at = end
        return out

    def known(self, word: str) -> list[int]:
        """pieces() of a word, remembered."""
        own = self.cache.get(word)
        if own is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            own = self.cache[word] = self.pieces(word)
        return own

    def encode(self, text: str | None, most: int | None = None) -> list[int]:
        """Pieces of a text, of the first ``most`` at most; a long text is cut at ``most`` times the median length of a piece before."""
        text = (text or "")[: most * self.median if most else None]
        text = unicodedata.normalize("NFC", text).lower()
        out: list[int] = []
        # What lies between spaces is looked up as a whole where no word can hold a space. Four controls are spaces for split() only.
        for run in text.split() if self.apart and not CONTROLS.intersection(text) else [text] if text else []:
            own = self.runs.get(run)
            if own is None:
                own = [p for w in self.words.findall(run) for p in self.known(w)]
                if len(run) <= LONGEST:
                    if len(self.runs) >= CACHED:
                        self.runs.clear()
                    self.runs[run] = own
            out += own
        return out[:most] if most else out


@dataclass
class SubwordModel:
    """``path`` of the vocabulary, which every worker can read, and the rows of its pieces, int8."""

    path: str
    rows: np.ndarray


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def context_sums(docs: DataFrame, text_col: str, path: str, dims: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by piece: how often it occurs, and the sum of the index vectors of the pieces up to ``reach`` places off.

    A few tasks for each core hand on their sums, one row for each piece they saw, so these do not grow with the texts; tasks that share a piece are summed by piece. What comes to the driver is one
    row for each piece of the vocabulary.
    """
    size = vocabulary(path).size
    schema = "piece int, n long, sums array<long>"

    def rows(counts: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(counts)
        for i in range(0, len(held), 4096):
            at = held[i : i + 4096]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dims, pa.int32()), pa.array(sums[at].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at]), lists], ["piece", "n", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The number after the last piece parts texts; its index vector is zero.
        known, index = vocabulary(path), np.concatenate([index_vectors(size, dims), np.zeros((1, dims), np.int8)])
        counts, sums = np.zeros(size + 1, np.int64), np.zeros((size + 1, dims), np.int64)
        gap = [size] * reach

        def add(ids: list[int]) -> None:
            whole = np.array(gap + ids, np.int32)
            for i in range(reach, len(whole) - reach, BLOCK):
                end = min(i + BLOCK, len(whole) - reach)
                near = np.zeros((end - i, dims), np.int16)
                for off in range(1, reach + 1):
                    near += index[whole[i - off : end - off]]
                    near += index[whole[i + off : end + off]]
                own = whole[i:end]
                order = np.argsort(own, kind="stable")
                held, starts, n = np.unique(own[order], return_index=True, return_counts=True)
                counts[held] += n
                sums[held] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)

        waiting: list[int] = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting += known.encode(text) + gap
                if len(waiting) >= BLOCK:
                    add(waiting)
                    waiting = []
        add(waiting)
        yield from rows(counts[:size], sums[:size])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(size, np.int64), np.zeros((size, dims), np.int64)
        for batch in batches:
            at = batch.column("piece").to_numpy()
            np.add.at(counts, at, batch.column("n").to_numpy())
            np.add.at(sums, at, batch.column("sums").flatten().to_numpy().reshape(len(at), dims))
        yield from rows(counts, sums)

    found = in_blocks(docs.select(text_col)).mapInArrow(partial, schema).repartition("piece").mapInArrow(combine, schema).toArrow()
    counts, sums = np.zeros(size, np.int64), np.zeros((size, dims), np.int64)
    at = found.column("piece").to_numpy()
    counts[at] = found.column("n").to_numpy()
    sums[at] = np.array(found.column("sums").combine_chunks().flatten()).reshape(len(at), dims)
    return counts, sums


def index_vectors(size: int, dims: int, seed: int = 11) -> np.ndarray:
    """A fixed random vector of -1, 0 and 1 for each piece."""
    return np.random.default_rng(seed).integers(-1, 2, (size, dims)).astype(np.int8)


def train(docs: DataFrame, text_col: str, path: str, dims: int = 64, reach: int = 2, rare: float = 1e-3) -> SubwordModel:
    """Rows by random indexing: a piece's contexts beyond what its frequency alone explains, weighed down for common pieces, as int8.

    All texts count. The sums are integers, so the model does not depend on how the rows are dealt out.
    """
    counts, sums = context_sums(docs, text_col, path, dims, reach)
    total = max(1, int(counts.sum()))
    expected = sums.sum(axis=0) / total
    own = sums - counts[:, None] * expected[None]
    length = np.linalg.norm(own, axis=1)
    weight = rare / (rare + counts / total)
    unit = own / np.maximum(length, 1e-12)[:, None] * weight[:, None]
    return SubwordModel(path, np.rint(127 * unit / max(np.abs(unit).max(), 1e-12)).astype(np.int8))


def embed(docs: DataFrame, id_col: str, text_col: str, model: SubwordModel, most: int | None = MOST) -> DataFrame:
    """(id, n_pieces, sums array<int>, embedding array<double>) of every text: integer sums of its pieces' rows, and their direction."""
    sent, dims = docs.sparkSession.sparkContext.broadcast((model.path, model.rows)), model.rows.shape[1]
    schema = "id long, n_pieces long, sums array<int>, embedding array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = sent.value
        known = vocabulary(path)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(x.reshape(-1), kind))
        for batch in batches:
            ids = [np.array(known.encode(t, most), np.int64) for t in batch.column(1).to_pylist()]
            sums = np.array([rows[i].sum(axis=0, dtype=np.int32) for i in ids], np.int32).reshape(len(ids), dims)
            mean = sums / np.maximum([[len(i)] for i in ids], 1).reshape(-1, 1)
            unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(len, ids), pa.int64()), lists(sums, pa.int32()), lists(unit, pa.float64())], ["id", "n_pieces", "sums", "embedding"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)

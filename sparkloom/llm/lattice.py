"""LM scoring by the likelihood of a subword lattice.

The pieces of an existing subword vocabulary weigh all segmentations by their scores: where these are log
probabilities they count as they are; where they are merge ranks, as in vocabularies of byte-pair kind, a rank counts as
its Zipf probability. A piece's weight is SHARE times that and, for the rest, what expectation-maximisation over all segmentations
of the training words, each by its count, gives it: the vocabulary's scores keep their share at every size, and what is
learned grows with the corpus. A text is the sequence of its words (A-Z
lower-cased, between ASCII white space), each with the mark of a word's start in front, then one end. No piece crosses a
word's start, so the sum over all segmentations of a text is the product of those of its words: a forward recursion in log
space over the lattice of each distinct word gives its marginal probability, and counts of words do the rest. Characters without a
piece are spelled as byte pieces, so every text has a probability. ``score`` is the log10 of that probability.

``mixed_score`` is another column: there the lattice of a word has one more edge, the whole word, whose weight is the word's count c in
the training texts. With L the sum over the pieces' segmentations, N all tokens and V the distinct ones, a word then has
(c + (V + 1) * L) / (N + V + 1). As L sums to 1 at most over all words, so does this.

Words are counted over all texts. The most frequent words, at most FREQUENT of them, are sent to every worker;
all others are joined. Null and empty texts are the end alone. Repeated rows each get their score; ids may be null
(then they are training rows). Without training texts all pieces keep their prior. Empty tables give empty results. Very long words
are handled whole: time and memory grow in proportion to their length, some 300 bytes a character. Other columns do
not matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, gathered, mix, new_key, once, small_batches, staged, text_slices

FREQUENT = 1 << 18
ROUNDS = 2
#: Share of a piece's weight that the vocabulary's own scores have, whatever the size of the corpus.
SHARE = 0.5
MARK = "▁"
#: Distinct words whose lattices are worked on together.
WORDS = 20_000
#: Words that a task counts before it hands them on.
HELD = 400_000
_BLOOM_BITS = 20


class Pieces:
    """A piece vocabulary with log probabilities; piece numbers are places in ``names``, the end comes last."""

    def __init__(self, names: list[str], logp: np.ndarray):
        self.names = names
        self.byte = np.array([names.index(f"<0x{b:02X}>") for b in range(256)])
        special = set(self.byte.tolist())
        keys, ids = [], []
        self.longest = 1
        for i, name in enumerate(names):
            if i in special or MARK in name[1:] or not name or i == len(names) - 1:
                continue
            x = np.array([ord(c) for c in name], np.uint64)
            keys.append(self._hash(x[None], len(name))[0, 0])
            ids.append(i)
            self.longest = max(self.longest, len(name))
        order = np.argsort(np.array(keys, np.uint64))
        self.keys, self.ids = np.array(keys, np.uint64)[order], np.array(ids)[order]
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[self.keys >> np.uint64(64 - _BLOOM_BITS)] = True
        self.logp = logp

    @staticmethod
    def _hash(x: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` characters from each column on."""
        h = np.full((x.shape[0], x.shape[1] - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + x[:, k : k + h.shape[1]]
        return mix(h)

    def lattice(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Length -> piece number at each (word, place), len(names) where there is none."""
        out = {}
        h = np.zeros(x.shape, np.uint64)
        for n in range(1, min(self.longest, x.shape[1]) + 1):
            h = h[:, : x.shape[1] - n + 1] * np.uint64(0x100000001B3) + x[:, n - 1 :]
            key = mix(h + np.uint64(n * pow(0x100000001B3, n) % (1 << 64)))
            at = np.flatnonzero(self.bloom[(key >> np.uint64(64 - _BLOOM_BITS)).reshape(-1)])
            own = key.reshape(-1)[at]
            place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = self.keys[place] == own
            if hit.any():
                piece = np.full(key.size, len(self.names), np.int32)
                piece[at[hit]] = self.ids[place[hit]]
                out[n] = piece.reshape(key.shape)
        return out

    def spelled(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each character as bytes."""
        x = x.astype(np.int64)
        table = np.zeros(int(x.max()) + 1)
        for v in np.flatnonzero(np.bincount(x.reshape(-1))).tolist():
            table[v] = self.logp[self.byte[list(chr(v).encode("utf-8", "surrogatepass"))]].sum()
        return table[x]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
        """(log probability of each prefix, lattice, weights of its edges, weights of spelled characters)."""
        pieces, logp = self.lattice(x), np.append(self.logp, -np.inf)
        weight = {n: logp[p] for n, p in pieces.items()}
        spelled = self.spelled(x)
        both = np.logaddexp(weight[1], spelled) if 1 in weight else spelled
        alpha = np.full((x.shape[0], x.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, x.shape[1] + 1):
            terms = [alpha[:, j - 1] + both[:, j - 1]] + [alpha[:, j - n] + w[:, j - n] for n, w in weight.items() if 1 < n <= j]
            top = np.maximum.reduce(terms)
            total = np.zeros(len(top))
            for t in terms:
                total += np.exp(t - top)
            alpha[:, j] = top + np.log(total)
        return alpha, pieces, weight, spelled

    def expected(self, x: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected number of uses of each piece in the words of ``x`` to ``total``."""
        alpha, pieces, weight, spelled = self.forward(x)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        both = np.logaddexp(weight[1], spelled) if 1 in weight else spelled
        size = x.shape[1]
        for i in range(size - 1, -1, -1):
            terms = [beta[:, i + 1] + both[:, i]] + [beta[:, i + n] + w[:, i] for n, w in weight.items() if 1 < n <= size - i]
            top = np.maximum.reduce(terms)
            s = np.zeros(len(top))
            for t in terms:
                s += np.exp(t - top)
            beta[:, i] = top + np.log(s)
        lead = np.log(count)[:, None] - alpha[:, -1:]
        for n, w in weight.items():
            at = np.flatnonzero((pieces[n] < len(self.names)).reshape(-1))
            use = np.exp((alpha[:, : size - n + 1] + w + beta[:, n:] + lead).reshape(-1)[at])
            total[: len(self.names)] += np.bincount(pieces[n].reshape(-1)[at], weights=use, minlength=len(self.names))
        use = np.exp(alpha[:, :-1] + spelled + beta[:, 1:] + lead)
        by_character = np.bincount(x.astype(np.int64).reshape(-1), weights=use.reshape(-1))
        for v in np.flatnonzero(by_character).tolist():
            np.add.at(total, self.byte[list(chr(v).encode("utf-8", "surrogatepass"))], by_character[v])


def grids(words: list[bytes], cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, characters with the word mark in front) for words of one length at a time."""
    texts = [MARK + w.decode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for own in np.split(order, cuts):
        if len(own) == 0:
            continue
        n = int(sizes[own[0]])
        step = max(1, cells // n)
        for i in range(0, len(own), step):
            part = own[i : i + step]
            joined = "".join([texts[k] for k in part])
            yield part, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n).astype(np.uint64)


def prior(scores: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces with ``scores``, the end last; ``spelled``: which of them stand for bytes and have no score of their own."""
    own = scores[~spelled]
    if len(own) and np.array_equal(own, np.round(own)):
        logp = -np.log(50.0 - scores)  # merge ranks, counted from 0 downwards
    else:
        logp = scores.astype(float).copy()
    top = logp[~spelled].max() if len(own) else 0.0
    logp[spelled] = top - 16
    logp = np.append(logp, top)
    return logp - np.log(np.exp(logp - logp.max()).sum()) - logp.max()


def load_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """(names, log probabilities) of a sentencepiece vocabulary's pieces, then the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    scores, spelled = np.array([model.get_score(i) for i in usable]), np.array([model.is_byte(i) for i in usable])
    return [*(model.id_to_piece(i) for i in usable), "</s>"], prior(scores, spelled)


def count_words(docs: DataFrame, held: Column) -> DataFrame:
    """(word, c): every distinct word of all texts with its number among the training texts, 0 if only others have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        other: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            rest = [w for w in other if w not in seen]
            out = pa.RecordBatch.from_arrays([pa.array([*seen, *rest], pa.binary()), pa.array([*seen.values(), *([0] * len(rest))], pa.int64())], ["word", "c"])
            seen.clear()
            other.clear()
            return out

        for batch in batches:
            for part in text_slices(batch, "text"):
                for text, out in zip(as_bytes(part.column("text")), part.column("held_out").to_pylist()):
                    (other if out else seen).update(text.lower().split())
                if len(seen) + len(other) > HELD:
                    yield flush()
        yield flush()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text", held.alias("held_out")).mapInArrow(run, "word binary, c long")
    return rows.repartition(parts, "word").groupBy("word").agg(F.sum("c").alias("c"))


def weights(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces: SHARE of the vocabulary's (``start``, log probabilities), the rest by expected ``counts``; without counts the vocabulary's alone."""
    total = counts.sum()
    return np.log(SHARE * np.exp(start) + (1 - SHARE) * counts / total) if total > 0 else start


def estimate(words: DataFrame, names: list[str], start: np.ndarray, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces after ``rounds`` rounds of expectation-maximisation over the training words and their ``ends``, from ``start``."""
    spark = words.sparkSession
    logp, train = start, words.where("c > 0")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((names, logp))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Pieces(*sent.value)
            total = np.zeros(len(own.names))
            for batch in gathered(batches, WORDS):
                count = batch.column("c").to_numpy().astype(float)
                for part, x in grids(batch.column("word").to_pylist()):
                    own.expected(x, count[part], total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

        # One row for each piece comes back.
        found = train.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(start))
        n[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        n[-1] += ends
        logp = weights(start, n)
    return logp


def with_whole(count: np.ndarray, spelled: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Log probability of tokens whose lattices have a whole-token edge of weight ``count`` besides segmentations that sum to exp(``spelled``)."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(count), np.log(kinds + 1) + spelled) - np.log(total + kinds + 1)


def score_words(words: DataFrame, names: list[str], logp: np.ndarray, total: int, kinds: int) -> DataFrame:
    """``words`` with lp and mp, the log10 probabilities of each word by its pieces and with its whole edge; ``total`` training tokens of ``kinds`` different ones."""
    sent = words.sparkSession.sparkContext.broadcast((names, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*sent.value)
        for batch in gathered(batches, WORDS):
            out = np.empty(batch.num_rows)
            for part, x in grids(batch.column("word").to_pylist()):
                out[part] = own.forward(x)[0][:, -1]
            mixed = with_whole(batch.column("c").to_numpy().astype(float), out, total, kinds)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(out / np.log(10)), pa.array(mixed / np.log(10))], ["word", "c", "lp", "mp"])

    return words.mapInArrow(run, "word binary, c long, lp double, mp double")


def frequent_floor(words: DataFrame, most: int = FREQUENT) -> int:
    """The least count at which no more than ``most`` words have that count or more, to an eighth of a power of two."""
    steps = words.where("c > 0").groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, floor = 0, 1 << 62
    for r in steps:  # one row for each eighth of a power of two
        total += r["n"]
        if total > most:
            break
        floor = int(np.ceil(2 ** (r["step"] / 8) - 1e-9))
    return floor


class _Numbers(dict):
    def __missing__(self, key):
        return -1


def score_documents(docs: DataFrame, vocabulary_path: str, held: Column, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of every row; learns from rows that are not ``held``."""
    spark = small_batches(docs.sparkSession)
    names, start = load_pieces(vocabulary_path)
    words = staged(count_words(docs, held), "lattice-words")
    ends = docs.where(~held).count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    bottom = float(np.log10(total + 0.1 * (distinct + 1)))
    logp = estimate(words, names, start, ends, rounds)
    rated = staged(score_words(words, names, logp, total, distinct), "lattice-rated")
    floor = frequent_floor(words)
    top = rated.where(F.col("c") >= floor).toArrow()  # FREQUENT rows at most
    known = top.column("word").to_pylist()
    base = np.log10(top.column("c").to_numpy() + 0.1) - bottom
    sent = spark.sparkContext.broadcast((known, np.stack([base, top.column("lp").to_numpy(), top.column("mp").to_numpy()])))
    last = np.array([np.log10(ends + 0.1) - bottom, logp[-1] / np.log(10), with_whole(np.array(float(ends)), logp[-1], total, distinct) / np.log(10)])
    key = new_key()
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, values = sent.value
        number = once("frequent", key, lambda: _Numbers(zip(own, range(len(own)))))
        values = np.append(values, np.zeros((3, 1)), axis=1)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for text in as_bytes(part.column("text")):
                    tokens = text.lower().split()
                    at = np.array(list(map(number.__getitem__, tokens)), np.int64)
                    miss = np.flatnonzero(at < 0)
                    rare = Counter([tokens[i] for i in miss.tolist()]) if len(miss) else {}
                    out.append((row, len(tokens) + 1, len(tokens) - len(miss) + (ends > 0), *(values[:, at].sum(axis=1) + last).tolist(), [{"word": w, "n": n} for w, n in rare.items()]))
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), rare_type]
                found = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), *found], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "lp", "mp", "rare"])

    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, lp double, mp double, rare array<struct<word:binary,n:long>>"
    rows = staged(docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, schema), "lattice-rows")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    joined = rare.join(rated.where(F.col("c") < floor), "word")
    n = F.col("n")
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("known2"), F.sum(n * (F.log10(F.col("c") + 0.1) - bottom)).alias("base2"), F.sum(n * F.col("lp")).alias("lp2"), F.sum(n * F.col("mp")).alias("mp2")
    )
    zero = F.lit(0.0)
    return rows.drop("rare").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        (F.col("lp") + F.coalesce("lp2", zero)).alias("score"),
        (F.col("mp") + F.coalesce("mp2", zero)).alias("mixed_score"),
    )

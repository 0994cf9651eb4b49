"""Lexical and vector retrieval, fusion and re-ranking. Every operator takes and returns DataFrames."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import math as M
from sparkloom.functions import text as T
from sparkloom.operators.graph import cut

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Inverted index (term, id, tf, dl); lengths are counted before exploding, so no second pass is needed."""
    rows = docs.select(F.col(id_col).alias("id"), T.tokens(text).alias("terms"))
    return rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def counted_terms(terms: Column) -> Column:
    """array<struct<term, tf>>: the different values of ``terms``, ascending, and how often each occurs; runs of the sorted array, without leaving the row."""
    # Arrays that are read by place are bound as a lambda's variable, so they are computed once for each text.
    bound = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)

    def counts(own: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == F.size(own)) | (F.get(own, i) != F.get(own, i - 1)))
        return bound(ends, lambda e: F.transform(e, lambda end, k: F.struct(F.get(own, end - 1).alias("term"), (end - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("tf"))))

    return F.when(F.size(terms) > 0, bound(F.sort_array(terms), counts))


def _scored(tf: DataFrame, total: DataFrame, asked: DataFrame, boost: float = 1.0) -> DataFrame:
    """(query_id, id, score) of postings ``tf`` (term, id, tf, dl) for ``asked`` (query_id, term); ``total`` (n_docs, avg_dl) is one row."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # Distinct terms of the queries: a few rows for each query.
    idf = df.join(F.broadcast(total)).select("term", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return tf.join(idf, "term").join(asked, "term").groupBy("query_id", "id").agg((boost * F.sum(part)).alias("score"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


#: Terms of queries, together, that are a literal of the plan, so that other tokens go before they are exploded.
LITERAL_TERMS = 2_000


def bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query of ``queries`` (query_id, text).

    Tokens that no query asks for are dropped inside the row: only postings of query terms are exploded and shuffled. The corpus
    statistics are one aggregated row.
    """
    rows = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("terms"))
    asked = _asked(queries)
    total = rows.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_dl"))
    wanted = asked.select("term").distinct()
    known = [r["term"] for r in wanted.limit(LITERAL_TERMS + 1).collect()]  # LITERAL_TERMS words at most
    if len(known) <= LITERAL_TERMS:
        own = F.filter("terms", lambda t: t.isin(known)) if known else F.expr("cast(array() as array<string>)")
        held = rows.select("id", F.size("terms").alias("dl"), F.explode(own).alias("term"))
    else:
        held = rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    tf = held.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return _scored(tf, total, asked)


def indexed_bm25(index: DataFrame, total: DataFrame, queries: DataFrame) -> DataFrame:
    """As bm25(), over written postings ``index`` (term, id, tf, dl) and their ``total`` (n_docs, avg_dl): terms that no query asks for are not read further than the filter."""
    asked = _asked(queries)
    known = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    tf = index.where(F.col("term").isin(known)) if len(known) <= LITERAL_TERMS else index.join(asked.select("term").distinct(), "term", "left_semi")
    return _scored(tf, total, asked)


#: Boosts of a chunk's and a symbol's fields, and of phrases in a chunk's (fixed values).
CHUNK_FIELDS = {"signature": 3.0, "doc": 2.2, "snippet": 1.2, "parent_scope": 1.4}
CHUNK_WHOLE = {"file_path": 1.5, "chunk_type": 0.8}
CHUNK_PHRASES = {"signature": 3.8, "doc": 3.0, "snippet": 2.2}
SYMBOL_FIELDS = {"signature": 2.5, "doc": 1.5, "context": 1.0}
NAME_GRAMS, NAME_EXACT, NAME_FUZZY, GRAM_FUZZY = 4.0, 12.0, 0.6, 0.35


def field_bm25(docs: DataFrame, id_col: str, fields: dict[str, float], queries: DataFrame, whole: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score): the sum over ``fields`` of a field's BM25 times its boost; fields of ``whole`` are one untokenised term each.

    All fields go through one aggregation, a term and its field being the key. A document counts for a field's statistics if it has the field.
    """
    columns = [(c, boost, T.tokens(F.col(c))) for c, boost in fields.items()] + [(c, boost, F.array(F.col(c))) for c, boost in (whole or {}).items()]
    parts = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.lit(boost).alias("boost"), terms.alias("terms"))) for c, boost, terms in columns))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).select("id", "x.field", "x.boost", "x.terms", F.size("x.terms").alias("dl"))
    asked = _asked(queries).unionByName(queries.select("query_id", F.explode(F.split("text", r"\s+")).alias("term"))).distinct()
    total = rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    tf = rows.select("id", "field", "boost", "dl", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "field", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("boost").alias("boost"))
    df = tf.groupBy("term", "field").agg(F.count("*").alias("df"))
    # One row for each field.
    idf = df.join(F.broadcast(total), "field").select("term", "field", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("boost") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return tf.join(idf, ["term", "field"]).join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def phrase_boost(docs: DataFrame, id_col: str, fields: dict[str, float], query: str) -> DataFrame:
    """(id, boost): the sum of the boosts of the fields that hold the query's words one after the other; none for queries of one word. Words are lower-cased."""
    words = " ".join(w for w in re.split("[^a-z0-9]+", query.lower()) if w)
    if " " not in words:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("boost")).limit(0)
    joined = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(F.col(c)), " "), F.lit(" "))
    total = sum((F.when(F.contains(joined(c), F.lit(f" {words} ")), F.lit(b)).otherwise(0.0) for c, b in fields.items()), F.lit(0.0))
    return docs.select(F.col(id_col).alias("id"), total.alias("boost")).where("boost > 0")


def chunk_search(chunks: DataFrame, query: str, limit: int = 500, language: str | None = None) -> DataFrame:
    """(id, score): lexical search over chunks (id, signature, doc, snippet, parent_scope, file_path, chunk_type, language) by boosted fields and phrases."""
    if language:
        chunks = chunks.where(F.col("language") == language)
    asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
    found = field_bm25(chunks, "id", CHUNK_FIELDS, asked, CHUNK_WHOLE).join(phrase_boost(chunks, "id", CHUNK_PHRASES, query), "id", "left")
    score = F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6)
    return found.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def phrase_hits(docs: DataFrame, id_col: str, text_col: str, phrase: str) -> DataFrame:
    """(id, hits): how often the words of ``phrase`` stand one after the other."""
    words = " ".join(w for w in phrase.lower().split() if w.isalnum())
    joined = F.concat(F.lit(" "), F.array_join(T.tokens(F.col(text_col)), " "), F.lit(" "))
    # A look-ahead counts places, so phrases that share a word count apart.
    return docs.select(F.col(id_col).alias("id"), F.regexp_count(joined, F.lit(f"(?= {words} )")).cast("long").alias("hits")).where("hits > 0")


def fuzzy_names(symbols: DataFrame, name: str) -> DataFrame:
    """Rows whose name is within one edit of ``name``; a transposition counts as one."""
    return symbols.where(within_one_edit(F.col("name"), name))


def within_one_edit(name: Column, asked: str) -> Column:
    """Whether ``name``, lower-cased, is ``asked`` but for one insertion, deletion, substitution or swap of neighbours."""
    low, asked = F.lower(name), asked.lower()
    swaps = [asked[:i] + asked[i + 1] + asked[i] + asked[i + 2 :] for i in range(len(asked) - 1)]
    near = F.abs(F.length(name) - len(asked)) <= 1
    return near & ((F.levenshtein(low, F.lit(asked)) <= 1) | low.isin(swaps) if swaps else F.levenshtein(low, F.lit(asked)) <= 1)


def symbol_search(symbols: DataFrame, query: str, limit: int = 10, kind: str | None = None, module: str | None = None, language: str | None = None) -> DataFrame:
    """(id, name, score): symbols (id, name, kind, module, language, signature, doc, context) by BM25 over their names' n-grams and their texts.

    The name's n-grams (case stays) count 4.0, signature 2.5, doc 1.5, context 1.0; an exact name adds 12, a name within one edit 0.6, an n-gram
    within one edit of the query 0.35. Filters come first, so statistics are those of the symbols that may be found.
    """
    for column, value in (("kind", kind), ("module", module), ("language", language)):
        if value is not None:
            symbols = symbols.where(F.col(column) == value)
    spark = symbols.sparkSession
    texts = {c: b for c, b in SYMBOL_FIELDS.items() if c in symbols.columns}
    asked = spark.createDataFrame([(0, query)], "query_id long, text string")
    words = field_bm25(symbols, "id", texts, asked).select("id", F.col("score").alias("words"))
    grams = symbols.select("id", T.ngrams(F.col("name")).alias("terms"))
    rows = grams.select("id", F.size("terms").alias("dl"), "terms")
    total = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    own = sorted({query[i : i + n] for n in range(3, 11) for i in range(len(query) - n + 1)})
    held = rows.select("id", "dl", F.explode(F.filter("terms", lambda t: t.isin(own) if own else F.lit(False))).alias("term"))
    tf = held.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    names = _scored(tf, total, spark.createDataFrame([(0, g) for g in own] or [(0, "")], "query_id long, term string")).select("id", (NAME_GRAMS * F.col("score")).alias("grams"))
    # Only n-grams about as long as the query can be within one edit of it.
    near = F.exists(T.ngrams(F.col("name"), max(3, len(query) - 1), min(10, len(query) + 1)), lambda g: within_one_edit(g, query)) if 2 <= len(query) <= 11 else F.lit(False)
    extra = F.when(F.col("name") == query, NAME_EXACT).otherwise(0.0) + F.when(within_one_edit(F.col("name"), query), NAME_FUZZY).otherwise(0.0) + F.when(near, GRAM_FUZZY).otherwise(0.0)
    both = symbols.select("id", "name", extra.alias("extra")).join(words, "id", "left").join(names, "id", "left")
    score = F.col("extra") + F.coalesce("words", F.lit(0.0)) + F.coalesce("grams", F.lit(0.0))
    return both.select("id", "name", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def knn(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(id, score): the most similar vectors by cosine; the query is a literal in the plan."""
    asked = F.array(*map(F.lit, query))
    return vectors.select("id", F.round(M.cosine(F.col("embedding"), asked), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def two_phase_knn(vectors: DataFrame, query: list[float], limit: int, share: float = 0.0) -> DataFrame:
    """As knn(), among the max(5 * limit, 100) vectors, or ``share`` of all if that is more, whose sign bits differ least from the query's."""
    asked = F.array(*map(F.lit, query))
    dims = len(query)
    near = vectors.withColumn("distance", M.hamming(M.sign_words(F.col("embedding"), dims), M.sign_words(asked, dims)))
    kept = max(5 * limit, 100, math.ceil(share * vectors.count()) if share else 0)
    return knn(near.orderBy("distance", "id").limit(kept), query, limit)


#: Queries that meet the vectors at once; more go in further passes.
QUERY_BLOCK = 16_384


def batch_knn(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank) for many queries: blocks of vectors meet blocks of queries as matrices; each task hands on its best only.

    Queries are counted before any is collected and come in blocks of QUERY_BLOCK, each one pass over the vectors. A score is looked at only if it
    may enter a query's best so far. Vectors with a component that is no number are like none.
    """
    import numpy as np

    from sparkloom.operators import vectors as stored

    def matrix(column):
        return stored.unit(np.array(column.flatten(), float).reshape(len(column), -1)) if len(column) else np.empty((0, 0))

    spark, out = vectors.sparkSession, None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for number in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        asked = own.select(F.col("query_id").cast("long"), "embedding").orderBy("query_id").toArrow()  # about QUERY_BLOCK rows
        if not len(asked):
            continue
        sent = spark.sparkContext.broadcast((asked["query_id"].to_numpy(), matrix(asked["embedding"].combine_chunks())))

        def run(batches, sent=sent):
            names, q = sent.value
            best, (tall, wide) = stored.Nearest(len(q), limit), stored.TILE
            for batch in batches:
                for i in range(0, batch.num_rows, wide):
                    part = batch.slice(i, wide)
                    ids, v = part.column(0).to_numpy(), matrix(part.column(1))
                    order = np.argsort(ids)
                    order = order[np.isfinite(v[order]).all(axis=1)]
                    ids, v = ids[order], v[order].T
                    for k in range(0, len(q), tall):
                        # Millionths below zero, so the most similar cost least.
                        best.add(k, (q[k : k + tall] @ v) * -1e6, ids, np.rint)
            yield from best.batches(names, lambda cost: -cost / 1e6, "score")

        rows = vectors.select(F.col("id").cast("long"), "embedding")
        one = stored.in_blocks(rows).mapInArrow(run, "query_id long, id long, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def in_order(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``rows`` with their place ``r`` in the order of all, from 1, and ``prev``, the ``value`` of the row before (null for the first).

    A range sort over all tasks; of each sorted part only its size and last value come to the driver. The sorted rows are a checkpoint, as
    places must not change between the two passes.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.max_by(value, "at").alias("last")).orderBy("part").collect()  # one row for each part
    starts, done, last = [], 0, None
    for p in parts:
        starts.append((p["part"], done, last))
        done, last = done + p["n"], p["last"]
    kind = dict(rows.dtypes)[value]
    ahead = rows.sparkSession.createDataFrame(starts, f"part int, done long, ahead {kind}")
    prev = F.lag(value).over(Window.partitionBy("part").orderBy("at"))
    out = placed.withColumn("prev", prev).join(F.broadcast(ahead), "part")
    return out.withColumns({"r": F.col("done") + F.col("at") + 1, "prev": F.coalesce("prev", "ahead")}).drop("part", "at", "done", "ahead")


def rrf(lists: list[DataFrame], k: int = 60, pools: bool = False) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over lists (id, score); ranks count from 1. ``pools`` says that the lists are limited to a few rows each."""
    order = [F.desc("score"), F.col("id")]
    placed = lambda x: x.withColumn("r", F.row_number().over(Window.orderBy(*order))) if pools else in_order(x.select("id", "score"), order, "score")
    ranked = [placed(x).select("id", (1 / (k + F.col("r"))).alias("part")) for x in lists]
    out = ranked[0]
    for x in ranked[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def convex(dense: DataFrame, lexical: DataFrame, alpha: float = 0.8) -> DataFrame:
    """(id, score): alpha * dense + (1 - alpha) * lexical, each scaled to [0, 1] within its list; missing counts 0. Least and greatest are one aggregated row each."""

    def scaled(x: DataFrame, name: str) -> DataFrame:
        low, high = x.agg(F.min("score")).scalar(), x.agg(F.max("score")).scalar()
        return x.select("id", ((F.col("score") - low) / F.greatest(high - low, F.lit(1.1920929e-07))).alias(name))

    both = scaled(dense, "d").join(scaled(lexical, "l"), "id", "full_outer")
    return both.select("id", (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))).alias("score"))


def file_evidence(hits: DataFrame, alpha: float = 0.5, tail: int = 5) -> DataFrame:
    """(file, score): a file's best score plus alpha times its next ones, each divided by its rank plus one. Each task hands on a file's best tail + 1 only."""
    order = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= tail + 1)
    rest = F.when(F.col("r") > 1, F.col("score") / F.col("r"))
    return ranked.groupBy("file").agg((F.max(F.when(F.col("r") == 1, F.col("score"))) + alpha * F.coalesce(F.sum(rest), F.lit(0.0))).alias("score"))


def diverse(hits: DataFrame, per_file: int, limit: int) -> DataFrame:
    """The best ``limit`` hits with at most ``per_file`` of a file first; others fill up what is missing. Each task hands on a file's best ``per_file`` only, and its best ``limit`` others."""
    order = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    best = [F.desc("score"), F.col("id")]
    first = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_file).drop("r")
    rest = hits.join(first.select("id"), "id", "left_anti").select(*hits.columns)
    both = first.orderBy(*best).limit(limit).withColumn("late", F.lit(0)).unionByName(rest.orderBy(*best).limit(limit).withColumn("late", F.lit(1)))
    return both.orderBy("late", *best).limit(limit).drop("late")


def score_cut(hits: DataFrame, delta: float = 0.8, drop: float = 1.2, least: int = 1) -> DataFrame:
    """(id, score, r): hits within ``delta`` of the best, up to the first fall of ``drop`` or more after ``least`` hits."""
    # A fall below the bound cuts nothing that the bound leaves.
    near = hits.select("id", "score").where(F.col("score") >= hits.agg(F.max("score")).scalar() - delta)
    ranked = in_order(near, [F.desc("score"), F.col("id")], "score")
    cliff = ranked.where((F.col("r") > least) & (F.col("prev") - F.col("score") >= drop)).agg(F.min("r")).scalar()
    return ranked.where(cliff.isNull() | (F.col("r") < cliff)).select("id", "score", "r")


def prefilter(hits: DataFrame, lexical: DataFrame, dense: DataFrame, target: int, gap: float, tail: int) -> DataFrame:
    """(id, score): what a re-ranker should see: the best ``target``, all if the next is within ``gap``, and up to ``tail`` more that both arms found."""
    best = [F.desc("score"), F.col("id")]
    own = hits.select("id", "score")
    head = own.orderBy(*best).limit(target + 1)
    ranked = cut(head.withColumn("r", F.row_number().over(Window.orderBy(*best))))  # target + 1 rows
    at = {r["r"]: r["score"] for r in ranked.where(F.col("r") >= target).collect()}
    if target in at and target + 1 in at and at[target] - at[target + 1] < gap:
        return own
    first = ranked.where(F.col("r") <= target).select("id", "score")
    both = lexical.select("id").join(dense.select("id"), "id", "left_semi").distinct()
    more = own.join(first.select("id"), "id", "left_anti").join(both, "id", "left_semi").orderBy(*best).limit(tail)
    return first.unionByName(more.select("id", "score"))


def gate(hits: DataFrame, rrf_score: Column, dual: Column, least_prob: float = 0.34, least_rrf: float = 0.018) -> DataFrame:
    """All hits, or none if the best is doubtful: low softmax share among the first five, low fused score, one source only. Five rows decide."""
    first = hits.withColumn("doubt", (rrf_score < least_rrf) & ~dual).orderBy(F.desc("score"), "id").limit(5)
    facts = first.agg((1 / F.sum(F.exp(F.col("score") - first.agg(F.max("score")).scalar()))).alias("share"), F.max_by("doubt", F.struct("score", -F.col("id"))).alias("weak"))
    doubtful = facts.select(F.coalesce((F.col("share") < least_prob) & F.col("weak"), F.lit(False))).scalar()
    return hits.where(~doubtful)


#: An embedding of texts: a column of vectors from a column of texts.
Embedder = Callable[[Column], Column]


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """Deterministic stand-in for a dense model: counts of tokens by hash bucket; cosine needs no unit length."""
    bucket = F.transform(T.tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dims)))
    # The buckets are bound as a lambda's variable, so they are computed once for each text; none is null, so what array_remove() takes away is a bucket's count.
    counts = lambda own: F.array(*((F.size(own) - F.size(F.array_remove(own, F.lit(i).cast("long")))).cast("double") for i in range(dims)))
    return F.element_at(F.transform(F.array(bucket), counts), 1)


def embedded(spark: SparkSession, embed: Embedder, text: str) -> Column:
    """The vector of one text as a literal, so it is computed once and not for each row it meets."""
    return F.array(*map(F.lit, spark.range(1).select(embed(F.lit(text)).cast("array<double>")).first()[0]))


def hash_vectors(postings: DataFrame, dims: int = 32) -> DataFrame:
    """(id, embedding) as hash_embedding() gives them, from postings (term, id, tf): a term is hashed once for each posting, and buckets are summed in one aggregation."""
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(dims))
    rows = postings.select("id", "tf", bucket.alias("b"))
    sums = [F.sum(F.when(F.col("b") == i, F.col("tf")).otherwise(0)).cast("double").alias(f"b{i}") for i in range(dims)]
    return rows.groupBy("id").agg(*sums).select("id", F.array(*(f"b{i}" for i in range(dims))).alias("embedding"))


def by_evidence(hits: DataFrame, limit: int, per_file: int = 1, alpha: float = 0.5) -> DataFrame:
    """(id, file, score, rank): files in the order of their evidence, up to ``per_file`` hits of each; what is missing is filled by the best hits left over.

    ``hits`` (id, file, score) is a pool of bounded size. Ties go by file and id.
    """
    order = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("r", F.row_number().over(order)).join(file_evidence(hits, alpha).withColumnRenamed("score", "evidence"), "file")
    late = (F.col("r") > per_file).cast("int")
    first = lambda c: F.when(late == 0, c)
    keys = [late, F.desc(first(F.round("evidence", 6))), first(F.col("file")), first(F.col("r")), F.desc("score"), "id"]
    chosen = ranked.orderBy(*keys).limit(limit)
    return chosen.select("id", "file", "score", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("rank"))


def fused_hits(lexical: DataFrame, dense: DataFrame, files: DataFrame, limit: int, per_file: int = 1, alpha: float = 0.8, ignore: tuple[str, ...] = T.HARD_IGNORE) -> DataFrame:
    """(id, file, score, rank) from two pools (id, score): convex fusion, no ignored files, evidence by file, diversity and back-filling."""
    fused = convex(dense, lexical, alpha).select("id", F.round("score", 6).alias("score"))
    hits = fused.join(files.select("id", "file"), "id").where(~T.matches_any(F.col("file"), ignore))
    return by_evidence(hits, limit, per_file).select("id", "file", F.round("score", 6).alias("score"), "rank")


def hybrid_search(docs: DataFrame, id_col: str, text_col: str, file_col: str, query: str, limit: int = 20, pool: int = 500, per_file: int = 1, embed: Embedder = hash_embedding) -> DataFrame:
    """(id, file, score, rank): BM25 and dense arms of ``pool`` hits each, then fused_hits(), without an index."""
    asked = docs.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
    best = lambda x: x.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(pool)
    vectors = docs.select(F.col(id_col).alias("id"), embed(F.col(text_col)).alias("embedding"))
    dense = vectors.select("id", M.cosine(F.col("embedding"), embedded(docs.sparkSession, embed, query)).alias("score"))
    return fused_hits(best(bm25(docs, id_col, text_col, asked)), best(dense), docs.select(F.col(id_col).alias("id"), F.col(file_col).alias("file")), limit, per_file)


class TextIndex:
    """A written index of texts: ``postings`` (term, id, tf, dl), sorted by term, ``vectors`` (id, embedding), ``docs`` (id, file, dl) and ``total`` (n_docs, avg_dl).

    Tables of one folder; a query reads the postings of its terms, the vectors and the names of what it found.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name in ("postings", "vectors", "docs", "total"):
            setattr(self, name, spark.read.parquet(f"{path}/{name}"))

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, file_col: str, path: str, parts: int | None = None) -> TextIndex:
        """Terms are counted within the row, so postings are shuffled once, by term; vectors and lengths come from the texts. Ids of ``docs`` are unique."""
        spark = docs.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows = docs.select(F.col(id_col).alias("id"), F.col(file_col).alias("file"), T.tokens(F.col(text_col)).alias("terms"))
        own = rows.select("id", F.size("terms").alias("dl"), F.inline(counted_terms(F.col("terms")))).select("term", "id", "tf", "dl")
        write(own.repartitionByRange(parts, "term").sortWithinPartitions("term", "id"), "postings")
        write(rows.select("id", "file", F.greatest(F.lit(0), F.coalesce(F.size("terms"), F.lit(0))).alias("dl")), "docs")
        # A text's terms are in one row, so a task hands on one row for each of its texts.
        write(hash_vectors(rows.select("id", F.inline_outer(counted_terms(F.col("terms"))))), "vectors")
        write(spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")), "total")
        return cls(spark, path)

    def bm25(self, queries: DataFrame) -> DataFrame:
        return indexed_bm25(self.postings, self.total, queries)

    def hybrid(self, query: str, limit: int = 20, pool: int = 500, per_file: int = 1) -> DataFrame:
        """hybrid_search() over the index."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        best = lambda x: x.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(pool)
        dense = self.vectors.select("id", M.cosine(F.col("embedding"), embedded(self.spark, hash_embedding, query)).alias("score"))
        return fused_hits(best(self.bm25(asked)), best(dense), self.docs, limit, per_file)


def rescored(hits: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``hits`` (id, score, file, chunk_type, line_start, line_end, parent_scope, signature, doc, snippet, kind, fan, name) with heuristic scores.

    Weights of source class and chunk type, a penalty for single lines, a boost for blocks, a penalty where fewer than half of two terms or more occur,
    and a bounded adjustment by the symbol's kind and calls. Without a symbol, kind is null.
    """
    w = {"impl": 1.0, "types": 0.7, "tests": 0.5, "generated": 0.3, "single": 0.72, "block": 1.12, "coherence": 0.75, "symbol": 0.2} | (weights or {})
    source, score, lines = T.source_class(F.col("file")), F.col("score"), F.col("line_end") - F.col("line_start") + 1
    score = M.downrank(score, F.when(source == "generated", w["generated"]).when(source == "tests", w["tests"]).when(source == "types", w["types"]).otherwise(w["impl"]))
    out = hits.withColumn("score", score)
    out = out.withColumn("score", M.downrank(F.col("score"), M.chunk_weight(F.col("chunk_type"))))
    out = out.withColumn("score", F.when(lines <= 1, M.downrank(F.col("score"), F.lit(w["single"]))).when(M.is_block(F.col("chunk_type"), lines), M.uprank(F.col("score"), F.lit(w["block"]))).otherwise(F.col("score")))
    if len(terms) >= 2:
        text = F.concat_ws(" ", "file", "chunk_type", "parent_scope", "signature", "doc", "snippet")
        low = T.coverage(F.array(*map(F.lit, terms)), text) < 0.5
        out = out.withColumn("score", F.when(low, M.downrank(F.col("score"), F.lit(w["coherence"]))).otherwise(F.col("score")))
    signal = M.symbol_signal(F.col("kind"), F.col("fan"), F.lower("name").isin(*T.TRIVIAL_NAMES))
    most = F.greatest(F.abs("score"), F.lit(1.0)) * max(0.0, min(0.25, w["symbol"]))
    return out.withColumn("score", F.round(F.col("score") + (signal - 0.5) * 2 * most, 6))


def strongest(hits: DataFrame, limit: int, per_file: int = 1, delta: float = 0.8, drop: float = 1.2, least: int = 1) -> DataFrame:
    """Rescored ``hits``, a pool of bounded size: the best of equal places (file, line_start, line_end), ``per_file`` of a file, within ``delta`` of the best, before a fall of ``drop``."""
    place = Window.partitionBy("file", "line_start", "line_end").orderBy(F.desc("score"), "id")
    own = hits.withColumn("_p", F.row_number().over(place)).where("_p = 1").drop("_p")
    own = own.withColumn("_f", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "id"))).where(F.col("_f") <= per_file).drop("_f")
    kept = score_cut(own.select("id", "score"), delta, drop, least).orderBy("r").limit(limit)
    return own.join(kept.select("id", F.col("r").cast("long").alias("rank")), "id")


def document_search(chunks: DataFrame, vectors: DataFrame, query: str, collection: str | None = None, source: str | None = None, limit: int = 5, embed: Embedder = hash_embedding) -> DataFrame:
    """(id, source_path, score, preview): chunks (id, collection, source_path, content) of a collection and source by cosine, with the words in context."""
    for column, value in (("collection", collection), ("source_path", source)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    own = vectors.join(chunks.select("id"), "id", "left_semi")
    best = own.select("id", F.round(M.cosine(F.col("embedding"), embedded(own.sparkSession, embed, query)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    words = F.array(*map(F.lit, [w for w in query.split() if len(w) > 1] or [""]))
    return best.join(chunks.select("id", "source_path", T.preview(F.col("content"), words, 120, "...").alias("preview")), "id")


def hybrid_symbols(symbols: DataFrame, vectors: DataFrame, query: str, limit: int = 10, k: int = 60, embed: Embedder = hash_embedding) -> DataFrame:
    """(id, score): lexical and dense candidates of symbols, max(3 * limit, 20) of each, by reciprocal ranks."""
    pool = max(3 * limit, 20)
    lexical = symbol_search(symbols, query, pool).select("id", "score")
    dense = vectors.select("id", F.round(M.cosine(F.col("embedding"), embedded(vectors.sparkSession, embed, query)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(pool)
    return rrf([lexical, dense], k, pools=True).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


#: What a re-ranker is: scores for pairs of a query and texts, in batches.
Reranker = Callable[[str, list[str]], list[float]]


def reranked(hits: DataFrame, query: str, model: Reranker, limit: int, top_n: int | None = None, normalise: str = "none", seconds: float | None = None) -> DataFrame:
    """``hits`` (id, text, ...) with scores by ``model``, the best ``limit`` first; the model is called on Arrow batches.

    With ``top_n`` only the best so many by their score until then are given to the model, and no others are left. ``normalise`` is none or sigmoid. With ``seconds`` a task
    gives up when its calls took longer; if one does, the scores until then decide for all.
    """
    import pandas as pd

    best = [F.desc("score"), F.col("id")]
    pool = hits.orderBy(*best).limit(top_n) if top_n else hits
    had = "score" in hits.columns
    own = [f for f in pool.schema.fields if f.name != "score"]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in own)}, score double, _before double, _late boolean"

    def run(batches):
        left = seconds
        for pdf in batches:
            before = pdf["score"].astype(float) if had else pd.Series(0.0, index=pdf.index)
            late = left is not None and left <= 0
            begun = time.monotonic()
            found = before if late else pd.Series(model(query, pdf["text"].tolist()), dtype=float, index=pdf.index)
            left = None if left is None else left - (time.monotonic() - begun)
            yield pdf.drop(columns=["score"], errors="ignore").assign(score=found, _before=before, _late=late or (left is not None and left < 0))

    rows = pool.mapInPandas(run, schema)
    if seconds is not None:
        rows = cut(rows)  # the model is asked once
        if rows.agg(F.bool_or("_late")).first()[0]:
            rows = rows.withColumn("score", F.col("_before"))
            normalise = "none"
    if normalise == "sigmoid":
        rows = rows.withColumn("score", M.sigmoid(F.col("score")))
    elif normalise != "none":
        raise ValueError(f"normalise is none or sigmoid, not {normalise}")
    return rows.drop("_before", "_late").orderBy(*best).limit(limit)


def rerank_text(parts: dict[str, Column], caps: dict[str, int] | None = None, most: int = 1400) -> Column:
    """``name: value`` lines of the values that are there, each up to its cap, ``most`` characters in all."""
    caps = {"signature": 256, "doc": 384, "context": 512, "snippet": 1024} | (caps or {})
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), F.left(c, F.lit(caps.get(name, most))))) for name, c in parts.items()]
    return F.left(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit(most))


def token_embedding(docs: DataFrame, id_col: str, text_col: str, table: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(id, embedding): static embedding: the mean of the vectors of a text's tokens, of its first ``most_chars`` characters if given, at unit length; unknown tokens are left out.

    ``table`` (term, vector) is the model; whole numbers of one scale give the same direction as what they stand for. Texts without a known token have no row.
    """
    words = docs.select(F.col(id_col).alias("id"), F.posexplode(T.tokens(F.left(text_col, F.lit(most_chars)) if most_chars else F.col(text_col))).alias("n", "term"))
    parts = words.join(table, "term").select("id", F.posexplode("vector").alias("i", "x")).groupBy("id", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("v")).select("id", M.normalised(F.col("v")).alias("embedding"))


def max_sim(tokens: DataFrame, query_tokens: list[list[float]]) -> DataFrame:
    """(id, score): for each vector of the query the most similar one of the text's ``tokens`` (id, embedding), summed."""
    asked = [F.max(M.cosine(F.col("embedding"), F.array(*map(F.lit, q)))).alias(f"s{i}") for i, q in enumerate(query_tokens)]
    return tokens.groupBy("id").agg(*asked).select("id", sum((F.col(f"s{i}") for i in range(len(asked))), F.lit(0.0)).alias("score"))


def feedback_terms(index: DataFrame, total: DataFrame, hits: DataFrame, top: int = 10) -> DataFrame:
    """(term, weight): pseudo-relevance feedback: the terms that the best ``hits`` (id) hold and others do not, by tf times idf; a few hits are asked."""
    own = index.join(hits.select("id"), "id", "left_semi").groupBy("term").agg(F.sum("tf").alias("tf"))
    df = index.join(own.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return own.join(df, "term").join(F.broadcast(total)).where(F.length("term") > 2).select("term", F.round(weight, 6).alias("weight")).orderBy(F.desc("weight"), "term").limit(top)


def coordinate_ascent(rows: DataFrame, features: list[str], steps: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0), rounds: int = 2) -> dict[str, float]:
    """Weights of ``features`` by which the most queries have a relevant hit first: one weight at a time takes the best of ``steps`` times itself.

    ``rows`` (query_id, id, relevant, features...). Every choice is one aggregation over all rows; only counts come back.
    """
    weights = dict.fromkeys(features, 1.0)
    for _ in range(rounds):
        for f in features:
            tried = [weights | {f: step * (weights[f] or 1.0)} for step in steps]
            scores = [sum((w[x] * F.col(x) for x in features), F.lit(0.0)) for w in tried]
            best = [F.max_by("relevant", F.struct(s, -F.col("id"))).alias(f"r{i}") for i, s in enumerate(scores)]
            found = rows.groupBy("query_id").agg(*best).agg(*(F.sum(F.col(f"r{i}").cast("int")).alias(f"r{i}") for i in range(len(tried)))).first()
            weights = tried[max(range(len(tried)), key=lambda i: (found[i] or 0, -abs(tried[i][f] - weights[f])))]
    return weights


def cluster_members(assigned: DataFrame) -> DataFrame:
    """(cluster, members): how many vectors each cluster holds."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("members"))


def kmeans_assign(vectors: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """((id, cluster), centroids): cosine k-means, clusters counted from 1.

    Fitted on about vectors.SAMPLE_ROWS rows, which is all that the driver is sent; every row is assigned, to the most similar centroid.
    """
    import numpy as np
    import pyarrow as pa

    from sparkloom.operators import vectors as stored

    x = stored.sampled(vectors, vectors.count())
    centroids = stored.unit(stored.lloyd(x, min(k, len(x)), seed=seed)[0]) if len(x) else x
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = stored.nearest(stored.unit(np.array(batch.column(1).to_pylist(), float)), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(own + 1, pa.int32())], ["id", "cluster"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, cluster int"), [(j + 1, c.tolist()) for j, c in enumerate(centroids)]


def nearest_centroid(vectors: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """(id, cluster): the most similar of a few centroids, the first among equals; the centroids are literals."""
    scored = F.array(*(F.struct(M.cosine(F.col("embedding"), F.array(*map(F.lit, c))).alias("s"), F.lit(-i).alias("i")) for i, c in centroids))
    return vectors.select("id", (-F.array_max(scored)["i"]).alias("cluster"))


def ivf_search(vectors: DataFrame, assigned: DataFrame, centroids: list[tuple[int, list[float]]], query: list[float], limit: int, probes: int = 1) -> DataFrame:
    """knn() within the ``probes`` clusters whose centroids are most similar to the query."""

    def similar(c: list[float]) -> float:
        size = math.hypot(*c) * math.hypot(*query)
        return sum(a * b for a, b in zip(c, query)) / size if size else 0.0

    probed = [i for i, _ in sorted(centroids, key=lambda c: (-similar(c[1]), c[0]))[:probes]]
    return knn(vectors.join(assigned.where(F.col("cluster").isin(probed)).select("id"), "id"), query, limit)

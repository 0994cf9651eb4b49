"""All queries of the engine's own operators over the test tables, each with its DuckDB SQL.

Tables stand in for a code corpus: parts are symbols (name, kind = type, module = brand), consecutive lines of an order
are calls between parts, documents are files (module = source), events are changes of files (path = user).
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import math as M
from sparkloom.functions import text as T
from sparkloom.operators import chunks, evaluate, graph, incremental, resolve, search

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PROSE = "with the and from worthless"
PROBE = [round(((i * 37) % 23 - 11) / 23, 4) for i in range(64)]
#: Shares of clusters probed and of vectors kept by sign bits, at which measured top-10 recall over vectors with id % 50 = 0 is above 0.9.
PROBED, KEPT = 0.7, 0.3
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def edges(t: Tables) -> DataFrame:
    # SQL orders by l_suppkey and l_extendedprice, too; lines that only these tell apart have the same l_partkey, so its sequence is the same without them, and fewer columns are shuffled.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t.lineitem.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")


def symbols(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("module"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


EDGES = "edges AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
TERMS = "terms AS (SELECT doc_id AS id, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS terms FROM documents)"
BM25 = f"""{TERMS}, total AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_dl FROM terms),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM terms) WHERE term IN ('with', 'the', 'and', 'from', 'worthless') GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT id, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM tf JOIN df USING (term), total GROUP BY id)"""
COSINE = f"cosines AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 6) AS score, label FROM embeddings)"


def asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(0, PROSE)], "query_id long, text string")


def lexical(t: Tables) -> DataFrame:
    return text_index(t.spark, t.dir).bm25(asked(t)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = search.bm25(t.documents, "doc_id", "text", asked(t))
    return found.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH {TERMS} SELECT id, hits FROM (SELECT id, len([i for i in range(1, len(terms)) if terms[i] = 'of' AND terms[i + 1] = 'the'])::BIGINT AS hits FROM terms) WHERE hits > 0")
def phrase_search(spark, sf_dir):
    return search.phrase_hits(Tables(spark, sf_dir).documents, "doc_id", "text", "of the")


@query(f"WITH {COSINE} SELECT id, score FROM cosines ORDER BY score DESC, id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return search.knn(vectors(Tables(spark, sf_dir)), PROBE, 10)


@query(f"""WITH d AS (SELECT vec_id AS id, embedding, (SELECT count(*) FROM range(1, 65) r(i) WHERE (embedding[i] > 0) <> (({PROBE_SQL})[i] > 0)) AS distance FROM embeddings),
near AS (SELECT id, embedding FROM d ORDER BY distance, id LIMIT 100)
SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 6) AS score FROM near ORDER BY score DESC, id LIMIT 10""")
def knn_two_phase(spark, sf_dir):
    return search.two_phase_knn(vectors(Tables(spark, sf_dir)), PROBE, 10)


@query(f"""WITH d AS (SELECT vec_id AS id, embedding, (SELECT count(*) FROM range(1, 65) r(i) WHERE (embedding[i] > 0) <> (({PROBE_SQL})[i] > 0)) AS distance FROM embeddings),
near AS (SELECT id, embedding FROM (SELECT *, row_number() OVER (ORDER BY distance, id) AS r, count(*) OVER () AS n FROM d) WHERE r <= greatest(100, ceil({KEPT}::DOUBLE * n)))
SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 6) AS score FROM near ORDER BY score DESC, id LIMIT 10""")
def knn_two_phase_wide(spark, sf_dir):
    return search.two_phase_knn(vectors(Tables(spark, sf_dir)), PROBE, 10, KEPT)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    v = vectors(Tables(spark, sf_dir))
    found = search.batch_knn(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), v, 5)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {BM25}, a AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM (SELECT id, round(score, 6) AS score FROM scored)), {COSINE},
b AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM cosines)
SELECT id, round(sum(part), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_fusion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dense = vectors(t).select("id", F.round(M.cosine(F.col("embedding"), F.array(*map(F.lit, PROBE))), 6).alias("score"))
    return search.rrf([lexical(t), dense]).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, l AS (SELECT id, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1.1920929e-07) AS l FROM (SELECT id, round(score, 6) AS score FROM scored)), {COSINE},
d AS (SELECT id, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1.1920929e-07) AS d FROM cosines)
SELECT id, round(0.8::DOUBLE * coalesce(d, 0) + 0.2::DOUBLE * coalesce(l, 0), 6) AS score FROM d FULL JOIN l USING (id)""")
def convex_fusion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dense = vectors(t).select("id", F.round(M.cosine(F.col("embedding"), F.array(*map(F.lit, PROBE))), 6).alias("score"))
    return search.convex(dense, lexical(t)).select("id", F.round("score", 6).alias("score"))


def hits(t: Tables) -> DataFrame:
    return lexical(t).join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("file")), "id")


HITS = f"{BM25}, hits AS (SELECT s.id, round(s.score, 6) AS score, source AS file FROM scored s JOIN documents d ON s.id = d.doc_id)"


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM hits)
SELECT file, round(max(CASE WHEN r = 1 THEN score END) + 0.5::DOUBLE * coalesce(sum(CASE WHEN r BETWEEN 2 AND 6 THEN score / r END), 0), 4) AS score FROM r GROUP BY file""")
def file_evidence(spark, sf_dir):
    return search.file_evidence(hits(Tables(spark, sf_dir))).select("file", F.round("score", 4).alias("score"))


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM hits)
SELECT id, file, score FROM r ORDER BY (r > 2), score DESC, id LIMIT 60""")
def diversity(spark, sf_dir):
    return search.diverse(hits(Tables(spark, sf_dir)), 2, 60).select("id", "file", "score")


@query(f"""WITH {BM25}, h AS (SELECT id, round(score, 6) AS score FROM scored), r AS (SELECT *, row_number() OVER w AS r, lag(score) OVER w - score AS fall, max(score) OVER () AS top FROM h WINDOW w AS (ORDER BY score DESC, id)),
c AS (SELECT *, min(CASE WHEN r > 1 AND fall >= 1.2 THEN r END) OVER () AS cliff FROM r)
SELECT id, score FROM c WHERE score >= top - 0.8 AND (cliff IS NULL OR r < cliff)""")
def score_cut(spark, sf_dir):
    return search.score_cut(lexical(Tables(spark, sf_dir))).select("id", "score")


@query("""SELECT id, round(cov, 6) AS coverage FROM (SELECT doc_id AS id, (contains(lower(text), 'worthless')::INT + contains(lower(text), 'clown')::INT + contains(lower(text), 'idiot')::INT) / 3.0::DOUBLE AS cov FROM documents)""")
def query_coverage(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return docs.select(F.col("doc_id").alias("id"), F.round(T.coverage(T.query_terms(F.lit("the worthless clown of an idiot")), F.col("text")), 6).alias("coverage"))


@query(f"WITH {EDGES} SELECT DISTINCT src AS node, p_partkey AS id, p_name AS name, p_type AS kind FROM edges JOIN part ON dst = p_partkey")
def callees(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.neighbours(edges(t), symbols(t)).select("node", "id", "name", "kind")


@query(f"WITH {EDGES} SELECT DISTINCT dst AS node, p_partkey AS id, p_name AS name, p_type AS kind FROM edges JOIN part ON src = p_partkey")
def callers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.neighbours(edges(t), symbols(t), incoming=True).select("node", "id", "name", "kind")


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), walk AS (SELECT 7::BIGINT AS id, 0 AS depth UNION SELECT e.src, depth + 1 FROM walk JOIN e ON e.dst = walk.id WHERE depth < 2)
SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id HAVING min(depth) > 0""")
def impact_radius(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.impact(edges(t), spark.range(7, 8), 2)


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), walk AS (SELECT [7::BIGINT] AS path, 0 AS depth, false AS again UNION ALL
SELECT list_append(path, dst), depth + 1, list_contains(path, dst) FROM walk JOIN e ON src = path[-1] WHERE NOT again AND depth < 2)
SELECT array_to_string(path, '>') AS path, depth::BIGINT AS depth, again AS recursive FROM walk""")
def call_tree(spark, sf_dir):
    tree = graph.call_tree(edges(Tables(spark, sf_dir)), 7, 2, most=None)
    return tree.select(F.array_join("path", ">").alias("path"), "depth", F.coalesce(F.col("reason") == "recursive", F.lit(False)).alias("recursive"))


@query(f"WITH {EDGES} SELECT a.p_brand AS from_module, b.p_brand AS to_module, count(*) AS calls FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY 1, 2 HAVING count(*) >= 20 ORDER BY calls DESC, 1, 2 LIMIT 15")
def module_graph(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.module_graph(edges(t), symbols(t), 20, 15)


@query(f"WITH {EDGES} SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY id")
def fan_in_out(spark, sf_dir):
    return graph.fans(edges(Tables(spark, sf_dir)))


@query(f"""WITH {EDGES}, m AS (SELECT a.p_brand AS f, b.p_brand AS t, count(*) AS n FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY 1, 2),
x AS (SELECT module, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT t AS module, n AS i, 0 AS o FROM m UNION ALL SELECT f, 0, n FROM m) GROUP BY module)
SELECT *, CASE WHEN regexp_matches(lower(module), 'test|mock|fixture|script|[.]github|ci|spec|bench|example|third_party|third-party|vendor') THEN 'Infrastructure' WHEN contains(lower(module), '/core/') OR starts_with(lower(module), 'core/') THEN 'Processing' WHEN fan_in + fan_out = 0 THEN 'Infrastructure' WHEN fan_in >= 25 AND fan_out >= 30 THEN 'Processing'
WHEN fan_in / (fan_in + fan_out) >= 0.75 THEN 'Data' WHEN fan_in < 25 AND fan_out >= 30 THEN 'Interface' WHEN fan_in / (fan_in + fan_out) > 0.65 THEN 'Data' WHEN fan_in / (fan_in + fan_out) < 0.35 THEN 'Interface' ELSE 'Processing' END AS layer FROM x""")
def layers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.layers(edges(t), symbols(t))


@query(f"""WITH {EDGES}, c AS (SELECT dst AS id, count(*) AS callers, count(DISTINCT p_brand) AS modules FROM edges JOIN part ON src = p_partkey GROUP BY dst)
SELECT *, CASE WHEN callers > 1000 OR modules > 20 THEN 'CRITICAL' WHEN callers > 500 OR modules > 10 THEN 'HIGH' WHEN callers > 100 OR modules > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c ORDER BY callers DESC, id LIMIT 5""")
def blast_radius(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.blast_radius(edges(t), symbols(t))


@query()
def critical_path(spark, sf_dir):
    return graph.critical_paths(edges(Tables(spark, sf_dir)), spark.range(1, 4))


@query(f"""WITH {EDGES}, o AS (SELECT src AS id, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS callees FROM edges JOIN part ON dst = p_partkey GROUP BY src),
i AS (SELECT dst AS id, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS callers FROM edges JOIN part ON src = p_partkey GROUP BY dst)
SELECT p_partkey AS id, callees, callers FROM part LEFT JOIN o ON p_partkey = o.id LEFT JOIN i ON p_partkey = i.id""")
def symbol_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = graph.symbol_context(edges(t), symbols(t), symbols(t).select("id"))
    return found.select("id", *(F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("callees", "callers")))


@query("""SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'view' AND c.ts <= a.ts)) AS view_id
FROM events a WHERE a.event_type = 'purchase'""")
def as_of_join(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    return resolve.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "seen", "view_id").select("event_id", "view_id")


@query("""WITH r AS (SELECT o_orderkey AS range_id, o_custkey AS k, o_orderkey - (o_orderkey % 97) * 20 AS lo, o_orderkey + (o_orderkey % 89) * 20 AS hi FROM orders), p AS (SELECT o_orderkey AS point_id, o_custkey AS k, o_orderkey AS at FROM orders)
SELECT point_id, range_id FROM (SELECT point_id, range_id, row_number() OVER (PARTITION BY point_id ORDER BY hi - lo, range_id) AS n FROM p JOIN r ON p.k = r.k AND p.at BETWEEN r.lo AND r.hi) WHERE n = 1""")
def containment_join(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    ranges = o.select(F.col("o_orderkey").alias("range_id"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") - (F.col("o_orderkey") % 97) * 20).alias("lo"), (F.col("o_orderkey") + (F.col("o_orderkey") % 89) * 20).alias("hi"))
    return resolve.containing(o.select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at")), ranges, "k").where("range_id is not null")


@query("""WITH s AS (SELECT s_name AS name, s_nationkey AS f, s_acctbal > 0 AS public FROM supplier), u AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, s_name AS name, c_nationkey AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT CASE WHEN u.f = s.f THEN 1 WHEN public THEN 3 END AS tier FROM u JOIN s USING (name)) SELECT CASE WHEN tier IS NULL THEN 'no_candidates' ELSE 'resolved' END AS status, tier::BIGINT AS tier, count(*) AS n FROM t GROUP BY ALL""")
def resolution_tiers(spark, sf_dir):
    """Every line refers to its supplier by name, from its customer's nation; nations are files and modules."""
    t = Tables(spark, sf_dir)
    constant = F.lit("x").alias("language")
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("file_id"), constant, F.col("s_nationkey").cast("string").alias("module"), F.when(F.col("s_acctbal") > 0, "Public").otherwise("Private").alias("visibility"), F.lit(1).alias("line"))
    # Of each table what counts, once; then a line is its supplier and its customer's nation, and those are counted before they are named.
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").repartition("l_orderkey").distinct()
    homes = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey").distinct()
    used = lines.join(homes, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "c_nationkey").agg(F.count("*").alias("uses"))
    u = used.join(t.supplier.select("s_suppkey", "s_name").distinct(), F.col("l_suppkey") == F.col("s_suppkey"))
    u = u.select(F.col("s_name").alias("to_name"), F.col("c_nationkey").alias("file_id"), constant, F.concat(F.lit("of "), "c_nationkey").alias("module"), F.lit(2).alias("line"), "uses")
    imports = spark.createDataFrame([], "file_id int, path string, alias string")
    return resolve.resolution_counts(u, s, imports)


HOME = "home AS (SELECT n_nationkey AS nation, CAST(n_regionkey AS VARCHAR) AS language, n_name AS module FROM nation)"
NAMES = f"""{HOME}, s AS (SELECT s_suppkey AS id, s_name AS name, nation AS f, language, module, CASE WHEN s_acctbal > 0 THEN 'Public' ELSE 'Private' END AS v FROM supplier JOIN home ON s_nationkey = nation),
u AS (SELECT o_orderkey AS rel_id, 'Supplier#' || lpad(CAST(o_orderkey % 100 + 1 AS VARCHAR), 9, '0') AS name, nation AS f, language, module FROM orders JOIN customer ON o_custkey = c_custkey JOIN home ON c_nationkey = nation),
c AS (SELECT rel_id, id, CASE WHEN u.f = s.f THEN 1 WHEN u.name = 'Supplier#000000001' AND u.language = s.language AND contains('NATION_1::Supplier#000000001', s.module) THEN 2
 WHEN u.language = s.language AND (u.module = s.module OR s.v = 'Public') THEN 3 END AS tier FROM u JOIN s USING (name)),
b AS (SELECT rel_id, min(tier) AS tier FROM c WHERE tier IS NOT NULL GROUP BY rel_id),
n AS (SELECT rel_id, tier, count(*) AS n, min(id) AS id FROM b JOIN c USING (rel_id, tier) GROUP BY rel_id, tier),
r AS (SELECT rel_id, CASE WHEN n = 1 OR tier = 1 THEN n.id END AS to_id, tier FROM u LEFT JOIN n USING (rel_id))"""


@query(f"WITH {NAMES} SELECT rel_id, to_id, CASE WHEN tier IS NULL THEN 'no_candidates' WHEN to_id IS NULL THEN 'ambiguous' ELSE 'resolved' END AS status, CAST(tier AS BIGINT) AS tier FROM r")
def name_resolution(spark, sf_dir):
    """Orders refer to suppliers by name; nations are files, regions languages."""
    t = Tables(spark, sf_dir)
    home = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("string").alias("language"), F.col("n_name").alias("module"))
    s = t.supplier.join(home, F.col("s_nationkey") == F.col("nation")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("nation").alias("file_id"), "language", "module", F.when(F.col("s_acctbal") > 0, "Public").otherwise("Private").alias("visibility"), F.lit(1).alias("line"))
    c = t.customer.join(home, F.col("c_nationkey") == F.col("nation"))
    u = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("rel_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("o_orderkey") % 100 + 1).cast("string"), 9, "0")).alias("to_name"), F.col("nation").alias("file_id"), "language", "module", F.lit(2).alias("line"))
    imports = home.select(F.col("nation").alias("file_id"), F.lit("NATION_1::Supplier#000000001").alias("path"), F.lit(None).cast("string").alias("alias"))
    return resolve.resolve_names(u, s, imports)


@query("SELECT doc_id AS id, i::BIGINT AS chunk_no, (i * 1400)::BIGINT AS start, md5(substr(text, i * 1400 + 1, 1500)) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1500) / 1400.0))::BIGINT + 1)) AS i FROM documents)")
def window_chunks(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    rows = docs.select(F.col("doc_id").alias("id"), F.posexplode(chunks.window_chunks(F.col("text"), 1500, 100)).alias("n", "x"))
    return rows.select("id", F.col("n").cast("long").alias("chunk_no"), "x.start", F.md5("x.content").alias("content"))


@query()
def document_chunks(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunks.chunk_documents(docs, "doc_id", "text")


@query()
def token_chunks(spark, sf_dir):
    return chunks.split_long(Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("snippet")), 200, 300, 24)


@query("SELECT user_id AS file_id, event_id + 1 AS lo, nxt - 1 AS hi FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt > event_id + 1")
def line_gaps(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return chunks.gaps(e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("id"), F.col("event_id").alias("start_line"), F.col("event_id").alias("end_line")))


@query("SELECT doc_id, text_hash, lang FROM (SELECT doc_id, md5(text) AS text_hash, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.md5("text").alias("text_hash"), "lang")
    return chunks.dedup_chunks(rows, ["text_hash"], [F.col("doc_id")])


METRICS = """WITH runs AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_id AS id FROM events),
qrels AS (SELECT user_id AS query_id, event_id AS id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS grade FROM events),
judged AS (SELECT * FROM qrels WHERE grade > 0), ideal AS (SELECT query_id, sum((2 ** grade - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM judged) WHERE r <= 10 GROUP BY query_id),
size AS (SELECT query_id, count(*) AS relevant FROM judged GROUP BY query_id),
h AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS hit1, max(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank END) AS rr10, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS h10 FROM runs JOIN judged USING (query_id, id) GROUP BY query_id)
SELECT query_id, coalesce(hit1, 0) AS hit1, round(coalesce(rr10, 0), 6) AS rr10, round(coalesce(dcg / ideal, 0), 6) AS ndcg10, round(coalesce(h10 / relevant, 0), 6) AS recall10 FROM size JOIN ideal USING (query_id) LEFT JOIN h USING (query_id)"""


@query(METRICS)
def retrieval_metrics(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    runs = e.select(F.col("user_id").alias("query_id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"), F.col("event_id").alias("id"))
    qrels = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("grade"))
    found = evaluate.metrics(runs, qrels)
    return found.select("query_id", "hit1", *(F.round(c, 6).alias(c) for c in ("rr10", "ndcg10", "recall10")))


@query("SELECT p_partkey AS name, p_size AS quality, p_retailprice AS cost FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def pareto_frontier(spark, sf_dir):
    return evaluate.pareto(Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("name"), F.col("p_size").alias("quality"), F.col("p_retailprice").alias("cost")))


@query("""WITH b AS (SELECT user_id, avg(value) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT user_id, avg(value) AS y FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT count(*) FILTER (y > x) AS wins, count(*) FILTER (y < x) AS losses, count(*) FILTER (y = x) AS ties, round(avg(y - x), 6) AS delta FROM b JOIN c USING (user_id)""")
def paired_comparison(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("query_id")).agg(F.avg("value").alias("value"))
    return evaluate.paired(side(0), side(1)).drop("accepted")


@query("SELECT o_orderpriority AS profile, round(avg(o_totalprice), 3) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.95), 2) AS p95 FROM orders GROUP BY 1")
def percentiles(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.groupBy(F.col("o_orderpriority").alias("profile")).agg(F.round(F.avg("o_totalprice"), 3).alias("mean"), F.round(F.percentile("o_totalprice", 0.5), 2).alias("p50"), F.round(F.percentile("o_totalprice", 0.95), 2).alias("p95"))


@query("""WITH a AS (SELECT doc_id AS path, n_chars AS m, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE n_chars + 1 END AS m, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE 'old' END AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN a.m = b.m OR a.h = b.h THEN 'same' ELSE 'modified' END AS state FROM a FULL JOIN b USING (path)""")
def incremental_diff(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    disk = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"), F.md5("text").alias("hash"))
    index = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 1).alias("mtime"), F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise("old").alias("hash"))
    return incremental.file_diff(disk, index)


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER w < 3600000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM n)
SELECT user_id, max(ts) AS released, count(*) AS events FROM r GROUP BY user_id, run""")
def debounce(spark, sf_dir):
    return incremental.debounce(Tables(spark, sf_dir).events, "user_id", "ts", 3_600_000)


@query("SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS share FROM documents GROUP BY lang")
def language_share(spark, sf_dir):
    total = Window.partitionBy()
    return Tables(spark, sf_dir).documents.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(total), 0))


@query(f"WITH {TERMS} SELECT term, count(*) AS n FROM (SELECT unnest(terms) AS term FROM terms) WHERE length(term) > 2 AND term NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}) GROUP BY term ORDER BY n DESC, term LIMIT 50")
def keyword_frequency(spark, sf_dir):
    rows = Tables(spark, sf_dir).documents.select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return rows.where((F.length("term") > 2) & ~F.col("term").isin(*T.STOPWORDS)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("SELECT p_brand AS module, count(*) AS symbols, count(*) FILTER (p_size > 25) AS large, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1")
def module_stats(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("module"), "p_size", "p_type")
    return rows.groupBy("module").agg(F.count("*").alias("symbols"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_distinct("p_type").alias("kinds"))


@query("SELECT p_partkey AS id, array_to_string([x for x in string_split(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' ') if x <> ''], '|') AS parts FROM part")
def split_identifiers(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.array_join(T.split_identifier(F.col("p_name")), "|").alias("parts"))


@query("SELECT o_orderpriority, l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority, l_returnflag)")
def rollup_quantities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).rollup("o_orderpriority", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unused_anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE levenshtein(lower(p_name), (SELECT lower(min(p_name)) FROM part)) <= 1")
def fuzzy_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    name = t.part.agg(F.min("p_name")).first()[0]
    return search.fuzzy_names(symbols(t), name).select("id", "name")


def ivf_index(v: DataFrame) -> tuple[DataFrame, list[tuple[int, list[float]]], int]:
    """(assignment, centroids, clusters to probe): ceil(sqrt n) clusters, of which PROBED are looked at."""
    k = math.ceil(math.sqrt(v.count()))
    return *search.kmeans_assign(v, k), math.ceil(PROBED * k)


@query()
def ivf_search(spark, sf_dir):
    v = vectors(Tables(spark, sf_dir))
    assigned, centroids, probes = ivf_index(v)
    return search.ivf_search(v, assigned, centroids, PROBE, 10, probes)


PATH_SQL = "CASE WHEN source = 'src7' THEN 'build/' || lang || '/src7' ELSE 'docs/' || lang || '/' || source END"


def text_index(spark: SparkSession, sf_dir: str) -> search.TextIndex:
    """The written index of the documents of ``sf_dir``, made once for each application; a part of the paths is one that searches ignore."""
    folder = f"{store_root(spark)}/text-index-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    if (spark.sparkContext.applicationId, sf_dir) not in _INDEXES:
        docs = Tables(spark, sf_dir).documents.withColumn("path", F.expr(PATH_SQL))
        _INDEXES[spark.sparkContext.applicationId, sf_dir] = search.TextIndex.build(docs, "doc_id", "text", "path", folder)
    return _INDEXES[spark.sparkContext.applicationId, sf_dir]


_INDEXES: dict[tuple[str, str], search.TextIndex] = {}


def store_root(spark: SparkSession) -> str:
    """A folder of this application in the shared folder of spark.checkpoint.dir; a temporary one where none is set and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}"
    return f"{found.rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over the indexed documents: both arms, fusion, no ignored files, evidence by file, one of each file first, back-filling."""
    return text_index(spark, sf_dir).hybrid(PROSE)


HASHED = "[len([w for w in string_split_regex(lower({}), '[^a-z0-9]+') if w <> '' AND ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 = i])::DOUBLE for i in range(0, 32)]"


@query(f"""WITH {BM25}, l0 AS (SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 500),
v AS (SELECT doc_id AS id, {HASHED.format('text')} AS e FROM documents), q AS (SELECT {HASHED.format(repr(PROSE))} AS q),
d0 AS (SELECT id, round(coalesce(CASE WHEN list_sum(e) = 0 THEN 0 ELSE list_cosine_similarity(e, q) END, 0), 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 500),
l AS (SELECT id, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1.1920929e-07) AS l FROM l0), d AS (SELECT id, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1.1920929e-07) AS d FROM d0),
f AS (SELECT id, {PATH_SQL} AS file, round(0.8::DOUBLE * coalesce(d, 0) + 0.2::DOUBLE * coalesce(l, 0), 6) AS score FROM d FULL JOIN l USING (id) JOIN documents ON id = doc_id),
g AS (SELECT * FROM f WHERE NOT regexp_matches(file, '(^|/)(target|node_modules|[.]venv|venv|[.]venv-quant|[.]next|[.]nuxt|[.]svelte-kit|dist|build|out)/') AND NOT regexp_matches(file, '^(.*/)?evals/') AND NOT regexp_matches(file, '[.]eval[.][^/]*$')),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM g),
e AS (SELECT file, round(max(CASE WHEN r = 1 THEN score END) + 0.5::DOUBLE * coalesce(sum(CASE WHEN r BETWEEN 2 AND 6 THEN score / r END), 0), 6) AS evidence FROM r GROUP BY file),
o AS (SELECT id, file, score, row_number() OVER (ORDER BY (r > 1), CASE WHEN r = 1 THEN evidence END DESC, CASE WHEN r = 1 THEN file END, score DESC, id) AS rank FROM r JOIN e USING (file))
SELECT id, file, score, rank FROM o WHERE rank <= 20""")
def hybrid_search(spark, sf_dir):
    return FLAGSHIP(spark, sf_dir)

"""Queries that go through CodeIndex, the tools a caller has, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import search
from sparkloom.plans.catalog import CODE, RELATIONS, code_chunks, corpus, joined
from sparkloom.plans.catalog import _field as chunk_field
from sparkloom.plans.registry import HASHED, Tables, query, text_index
from sparkloom.tools import CodeIndex

_ASKED = "the red widget"
_HITS = f"""v AS (SELECT id, name, {HASHED.format("name || ' ' || coalesce(signature || ' ', '') || doc")} AS e FROM code WHERE doc IS NOT NULL), q AS (SELECT {HASHED.format(repr(_ASKED))} AS q),
hits AS (SELECT id, name, round(CASE WHEN list_sum(e) = 0 THEN 0 ELSE list_cosine_similarity(e, q) END, 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 5)"""
_AFFECTS = "a AS (SELECT DISTINCT from_id, to_id FROM rels WHERE kind IN ('Calls', 'Uses', 'Implements', 'Extends'))"
_CALLS = "calls AS (SELECT DISTINCT from_id, to_id FROM rels WHERE kind = 'Calls')"


@query(f"""WITH RECURSIVE {CODE}, {RELATIONS}, {_HITS}, {_AFFECTS}, {_CALLS}, walk AS (SELECT id AS hit, id, 0 AS depth FROM hits UNION SELECT hit, from_id, depth + 1 FROM walk JOIN a ON to_id = walk.id WHERE depth < 2),
n AS (SELECT hit, count(DISTINCT id) AS impacted FROM walk WHERE id <> hit GROUP BY hit)
SELECT hits.id, name, score, coalesce((SELECT string_agg(DISTINCT c.name, ',' ORDER BY c.name) FROM calls JOIN code c ON to_id = c.id WHERE from_id = hits.id), '') AS callees,
coalesce((SELECT string_agg(DISTINCT c.name, ',' ORDER BY c.name) FROM calls JOIN code c ON from_id = c.id WHERE to_id = hits.id), '') AS callers, coalesce(impacted, 0) AS impacted FROM hits LEFT JOIN n ON hit = hits.id""")
def semantic_search_with_context(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).semantic_search_with_context(_ASKED).select("id", "name", "score", joined("callees"), joined("callers"), "impacted")


_TERMS = "'the', 'red', 'widget'"
_DENSE = HASHED.format("coalesce(signature || ' ', '') || coalesce(doc || ' ', '') || snippet")


@query(f"""WITH {CODE}, ch AS (SELECT id, signature, doc, 'part ' || p_name || ' in line ' || CAST(start_line AS STRING) AS snippet, class_name AS parent_scope, file_path, lower(kind) AS chunk_type FROM code),
f AS ({' UNION ALL '.join(chunk_field(c, b) for c, b in search.CHUNK_FIELDS.items())} UNION ALL {' UNION ALL '.join(chunk_field(c, b, True) for c, b in search.CHUNK_WHOLE.items())}),
total AS (SELECT field, count(*) AS nd, avg(len(terms)) AS av FROM f GROUP BY field), tf AS (SELECT id, field, boost, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, field, boost, len(terms) AS dl, unnest(terms) AS term FROM f) WHERE term IN ({_TERMS}) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
b AS (SELECT id, sum(boost * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))) AS s FROM tf JOIN df USING (field, term) JOIN total USING (field) GROUP BY id),
w AS (SELECT id, array_to_string([x for x in string_split_regex(lower(coalesce(signature, '')), '[^a-z0-9]+') if x <> ''], ' ') AS sg, array_to_string([x for x in string_split_regex(lower(coalesce(doc, '')), '[^a-z0-9]+') if x <> ''], ' ') AS dc, array_to_string([x for x in string_split_regex(lower(snippet), '[^a-z0-9]+') if x <> ''], ' ') AS sn FROM ch),
l0 AS (SELECT b.id, round(s + CASE WHEN contains(' ' || sg || ' ', ' the red widget ') THEN 3.8::DOUBLE ELSE 0 END + CASE WHEN contains(' ' || dc || ' ', ' the red widget ') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains(' ' || sn || ' ', ' the red widget ') THEN 2.2::DOUBLE ELSE 0 END, 6) AS score FROM b JOIN w ON b.id = w.id ORDER BY score DESC, b.id LIMIT 500),
v AS (SELECT id, {_DENSE} AS e FROM ch), q AS (SELECT {HASHED.format(repr(_ASKED))} AS q), d0 AS (SELECT id, round(CASE WHEN list_sum(e) = 0 THEN 0 ELSE list_cosine_similarity(e, q) END, 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 500),
l AS (SELECT id, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1.1920929e-07) AS l FROM l0), d AS (SELECT id, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1.1920929e-07) AS d FROM d0),
g AS (SELECT id, file_path AS file, round(0.8::DOUBLE * coalesce(d, 0) + 0.2::DOUBLE * coalesce(l, 0), 6) AS score FROM d FULL JOIN l USING (id) JOIN ch USING (id) WHERE NOT regexp_matches(file_path, '(^|/)(target|node_modules|[.]venv|venv|[.]venv-quant|[.]next|[.]nuxt|[.]svelte-kit|dist|build|out)/') AND NOT regexp_matches(file_path, '^(.*/)?evals/') AND NOT regexp_matches(file_path, '[.]eval[.][^/]*$')),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM g),
e AS (SELECT file, round(max(CASE WHEN r = 1 THEN score END) + 0.5::DOUBLE * coalesce(sum(CASE WHEN r BETWEEN 2 AND 6 THEN score / r END), 0), 6) AS evidence FROM r GROUP BY file),
o AS (SELECT id, file, score, row_number() OVER (ORDER BY (r > 1), CASE WHEN r = 1 THEN evidence END DESC, CASE WHEN r = 1 THEN file END, score DESC, id) AS rank FROM r JOIN e USING (file))
SELECT id, file, score, rank FROM o WHERE rank <= 20""")
def semantic_search_chunks(spark, sf_dir):
    chunks = code_chunks(Tables(spark, sf_dir)).withColumnRenamed("file_path", "file")
    vectors = chunks.select("id", search.hash_embedding(F.concat_ws(" ", "signature", "doc", "snippet")).alias("embedding"))
    return CodeIndex(None, None, chunks=chunks, vectors=vectors).semantic_search_chunks(_ASKED)


@query(f"""WITH RECURSIVE {CODE}, {RELATIONS}, {_AFFECTS}, {_CALLS}, walk AS (SELECT 8::BIGINT AS id, 0 AS depth UNION SELECT from_id, depth + 1 FROM walk JOIN a ON to_id = walk.id WHERE depth < 2), m AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0)
SELECT 'symbol' AS part, id, name FROM code WHERE id = 8 UNION ALL SELECT 'callees', c.id, c.name FROM calls JOIN code c ON to_id = c.id WHERE from_id = 8 UNION ALL SELECT 'callers', c.id, c.name FROM calls JOIN code c ON from_id = c.id WHERE to_id = 8
UNION ALL SELECT * FROM (SELECT 'impact', id, name FROM m JOIN code USING (id) ORDER BY depth, id LIMIT 20)""")
def get_feature_context(spark, sf_dir):
    parts = corpus(Tables(spark, sf_dir)).get_feature_context(8)
    out = None
    for name in ("symbol", "callees", "callers", "impact"):
        one = parts[name].select(F.lit(name).alias("part"), "id", "name")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {CODE}, e AS (SELECT *, CASE WHEN name = 'main' THEN 'main' WHEN starts_with(file_path, 'bin/') AND visibility = 'Public' THEN 'cli' END AS type FROM code WHERE kind = 'Function' AND NOT regexp_matches(file_path, 'test|spec|mock|fixture|example|script|bench|eval|[.]github|ci')),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS r FROM e WHERE type IS NOT NULL) WHERE r = 1)
SELECT 'entry_points' AS part, name || ' ' || file_path AS item, start_line::BIGINT AS n FROM s UNION ALL SELECT * FROM (SELECT 'languages', CASE language WHEN 'rust' THEN 'Rust' WHEN 'python' THEN 'Python' WHEN 'typescript' THEN 'TypeScript' ELSE 'Go' END AS l, count(DISTINCT file_path) AS n FROM code GROUP BY language ORDER BY n DESC, l LIMIT 3)""")
def get_project_overview(spark, sf_dir):
    parts = corpus(Tables(spark, sf_dir)).get_project_overview(show_graph=False)
    starts = parts["entry_points"].select(F.lit("entry_points").alias("part"), F.concat_ws(" ", "name", "file_path").alias("item"), F.col("start_line").cast("long").alias("n"))
    return starts.unionByName(parts["languages"].select(F.lit("languages").alias("part"), F.col("language").alias("item"), F.col("n").cast("long").alias("n")))


@query(f"""WITH RECURSIVE {RELATIONS}, e AS (SELECT from_id AS src, to_id AS dst FROM rels WHERE kind = 'Calls'), walk AS (SELECT [8::BIGINT] AS path, 0 AS depth, false AS again UNION ALL SELECT list_append(path, dst), depth + 1, list_contains(path, dst) FROM walk JOIN e ON src = path[-1] WHERE NOT again AND depth < 3)
SELECT path[-2] AS parent, path[-1] AS callee, count(*) AS n, min(depth)::BIGINT AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2""")
def get_call_tree(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).get_call_tree(8, 3, max_nodes=None, show_trivial=True, show_external=True)


@query(f"""WITH v AS (SELECT doc_id AS id, source, {HASHED.format('text')} AS e FROM documents WHERE lang = 'en'), q AS (SELECT {HASHED.format("'the and of worthless'")} AS q)
SELECT id, source AS source_path, round(CASE WHEN list_sum(e) = 0 THEN 0 ELSE list_cosine_similarity(e, q) END, 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 5""")
def search_documents(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), F.col("source").alias("source_path"), F.col("text").alias("content"))
    tools = CodeIndex(None, None, documents=docs, document_vectors=text_index(spark, sf_dir).vectors)
    return tools.search_documents("the and of worthless", "en").select("id", "source_path", "score")

"""Everything a caller can ask of an indexed code corpus, one function each; every answer is a DataFrame.

CodeIndex holds the tables: ``symbols`` (id, name, kind, file_path, module, language, visibility, start_line, end_line, signature, doc, class_name),
``relationships`` (from_id, to_id, kind), ``files`` (path, language, content), ``chunks`` (id, file, line_start, line_end, chunk_type, parent_scope, signature, doc, snippet,
language, symbol_id), ``vectors`` (id, embedding) of the chunks, ``documents`` (id, collection, source_path, content) and ``document_vectors`` (id, embedding).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.functions import math as M
from sparkloom.functions import text as T
from sparkloom.operators import graph, lookup, overview, search
from sparkloom.sources import parse

#: Least similarity of a hit that a threshold by name asks for.
SIMILAR = {"strict": 0.75, "default": 0.60, "loose": 0.40}


@dataclass
class CodeIndex:
    symbols: DataFrame
    relationships: DataFrame
    files: DataFrame | None = None
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    documents: DataFrame | None = None
    document_vectors: DataFrame | None = None
    embed: search.Embedder = search.hash_embedding

    def _edges(self, *kinds: str) -> DataFrame:
        return self.relationships.where(F.col("kind").isin(*kinds)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))

    def _ids(self, name: str | None = None, id: int | None = None) -> DataFrame:
        return lookup.find_symbols(self.symbols, id=id, name=name).select("id")

    # -- symbols and calls ---------------------------------------------------------------------------------------

    def find_symbol(self, name: str, language: str | None = None) -> DataFrame:
        """(id, name, kind, file_path, start_line, signature, n_callers, n_callees) of every symbol of that name."""
        found = lookup.find_symbols(self.symbols, name=name, language=language).select("id", "name", "kind", "file_path", "start_line", "signature")
        calls = self._edges("Calls").distinct()
        into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_callers"))
        out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_callees"))
        return found.join(into, "id", "left").join(out, "id", "left").fillna(0, ["n_callers", "n_callees"])

    def get_calls(self, name: str | None = None, id: int | None = None) -> DataFrame:
        """(node, id, name, kind): what the symbol calls."""
        edges = self._edges("Calls").join(self._ids(name, id).withColumnRenamed("id", "src"), "src", "left_semi")
        return graph.neighbours(edges, self.symbols)

    def find_callers(self, name: str | None = None, id: int | None = None) -> DataFrame:
        """(node, id, name, kind): what calls the symbol."""
        edges = self._edges("Calls").join(self._ids(name, id).withColumnRenamed("id", "dst"), "dst", "left_semi")
        return graph.neighbours(edges, self.symbols, incoming=True)

    def analyze_impact(self, name: str | None = None, id: int | None = None, max_depth: int = 3) -> DataFrame:
        """(kind, n, nearest) of what changes of the symbol may reach."""
        return graph.impact_by_kind(self._edges(*graph.AFFECTS), self.symbols, self._ids(name, id), max_depth)

    def get_call_tree(self, id: int, max_depth: int = 4, max_nodes: int = 100, collapse_duplicates: bool = True, show_trivial: bool = False, show_external: bool = False) -> DataFrame:
        """(parent, callee, n, depth), or (path, depth, reason) without collapsing; each level keeps ``max_nodes`` paths, the tree's stated limit."""
        tree = graph.filtered_tree(graph.call_tree(self._edges("Calls"), id, max_depth, max_nodes), self.symbols, show_trivial, show_external)
        return graph.collapse_calls(tree) if collapse_duplicates else tree

    def get_source(self, ids: list[int], context_lines: int = 0) -> DataFrame:
        return lookup.source_lines(self.symbols, self.files, ids, context_lines)

    def get_module_exports(self, file_path: str) -> DataFrame:
        """(label, names) of the public symbols of the file whose path ends so."""
        return overview.export_groups(lookup.exports(self.symbols, file_path))

    def get_type_fields(self, id: int) -> DataFrame:
        """(id, fields, methods)."""
        return overview.type_members(self.relationships.where(F.col("from_id") == id), self.symbols)

    def get_state_graph(self, id: int) -> DataFrame:
        """(hook, names, line): React hooks in a component's source."""
        source = lookup.source_lines(self.symbols, self.files, [id])

        def run(batches):
            import pandas as pd

            for pdf in batches:
                rows = [(h, n, line + first - 1) for text, first in zip(pdf["source"], pdf["first_line"]) for h, n, line in parse.hooks(text or "")]
                yield pd.DataFrame(rows, columns=["hook", "names", "line"])

        return source.mapInPandas(run, "hook string, names string, line long")

    def get_index_info(self) -> DataFrame:
        """(name, n): rows of each table."""
        held = {n: getattr(self, n) for n in ("symbols", "relationships", "files", "chunks", "vectors", "documents") if getattr(self, n) is not None}
        return overview.counts(**held)

    # -- search -----------------------------------------------------------------------------------------------------

    def search_symbols(self, query: str, limit: int = 10, kind: str | None = None, module: str | None = None, language: str | None = None) -> DataFrame:
        """(id, name, score)."""
        return search.symbol_search(self.symbols, query, limit, kind, module, language)

    def semantic_search_docs(self, query: str, limit: int = 10, threshold: float | None = None, language: str | None = None) -> DataFrame:
        """(id, name, score): symbols by the similarity of their signatures and docs to the query."""
        rows = self.symbols.where(F.col("doc").isNotNull())
        if language:
            rows = rows.where(F.col("language") == language)
        text = F.concat_ws(" ", "name", "signature", "doc")
        hits = rows.select("id", "name", F.round(M.cosine(self.embed(text), search.embedded(rows.sparkSession, self.embed, query)), 6).alias("score"))
        hits = hits if threshold is None else lookup.at_least(hits, threshold)
        return hits.orderBy(F.desc("score"), "id").limit(limit)

    def semantic_search_chunks(self, query: str, limit: int = 20, threshold: float | None = None, language: str | None = None) -> DataFrame:
        """(id, file, score, rank): hybrid search over chunks, one of each file first."""
        rows = self.chunks if language is None else self.chunks.where(F.col("language") == language)
        lexical = search.chunk_search(rows.withColumnRenamed("file", "file_path"), query)
        dense = self.vectors.join(rows.select("id"), "id", "left_semi").select("id", F.round(M.cosine(F.col("embedding"), search.embedded(rows.sparkSession, self.embed, query)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(500)
        hits = search.fused_hits(lexical, dense, rows, limit)
        return hits if threshold is None else lookup.at_least(hits, threshold)

    def semantic_search_with_context(self, query: str, limit: int = 5, threshold: float | None = None, language: str | None = None, depth: int = 2) -> DataFrame:
        """(id, name, score, callees, callers, impacted): hits with the sorted names around them and how many symbols their changes reach within ``depth`` steps."""
        # What is found is used many times; it is searched for once.
        hits = graph.cut(self.semantic_search_docs(query, limit, threshold, language))
        around = graph.symbol_context(self._edges("Calls"), self.symbols, hits.select("id"))
        edges = self._edges(*graph.AFFECTS)
        # Each hit's frontier goes with it, so hits do not mix. Equal edges are one after the few that touch a frontier are found.
        seen = hits.select(F.col("id").alias("hit"), "id")
        front = seen
        for _ in range(depth):
            front = front.join(edges.withColumnRenamed("dst", "id"), "id").select("hit", F.col("src").alias("id")).distinct().join(seen, ["hit", "id"], "left_anti")
            seen = seen.unionByName(front)
        reached = seen.where("hit <> id").groupBy(F.col("hit").alias("id")).agg(F.count("*").alias("impacted"))
        return hits.join(around, "id").join(reached, "id", "left").fillna(0, ["impacted"])

    def search_documents(self, query: str, collection: str | None = None, limit: int = 5) -> DataFrame:
        """(id, source_path, score, preview)."""
        return search.document_search(self.documents, self.document_vectors, query, collection, None, limit, self.embed)

    # -- overviews ----------------------------------------------------------------------------------------------------

    def get_feature_context(self, id: int, max_impact: int = 20, impact_depth: int = 2, max_examples: int = 3, context_lines: int = 5) -> dict[str, DataFrame]:
        """source, callees, callers, impact (the nearest ``max_impact``), examples of one symbol."""
        reach = graph.impact(self._edges(*graph.AFFECTS), self._ids(id=id), impact_depth).join(self.symbols.select("id", "name", "kind"), "id").orderBy("depth", "id").limit(max_impact)
        out = {"symbol": self._ids(id=id).join(self.symbols, "id"), "callees": self.get_calls(id=id), "callers": self.find_callers(id=id), "impact": reach}
        if self.files is not None:
            out |= {"source": self.get_source([id]), "examples": graph.call_examples(self._edges("Calls"), self.symbols, self.files, id, max_examples, context_lines)}
        return out

    def get_project_overview(self, show_graph: bool = True, module_depth: int = 2, path: str = "") -> dict[str, DataFrame]:
        """modules, languages, keywords, domains, entry points, layers, blast radius, module graph and critical paths below ``path``."""
        own = self.symbols.where(T.in_subtree(F.col("file_path"), path)).withColumn("module", T.module_of(F.col("file_path"), module_depth))
        words = overview.keywords(own, 20)
        starts = lookup.entry_points(own)
        out = {"modules": overview.modules_of(own, module_depth).join(overview.module_stats(own).drop("files", "symbols"), "module"), "keywords": words, "domains": overview.word_domains(words), "entry_points": starts}
        out["languages"] = overview.language_shares(own.select(F.col("file_path").alias("path")).distinct())
        if show_graph:
            edges = self._edges("Calls")
            first = starts.orderBy("priority", "id").limit(3).select("id")
            out |= {"module_graph": graph.module_graph(edges, own, 20, 15), "layers": graph.layers(edges, own), "blast_radius": graph.blast_radius(edges, own), "critical_paths": graph.critical_paths(edges, first, 6, own)}
        return out


def as_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, data): an overview's tables as one, a JSON object for each row."""
    out = None
    for name, rows in sorted(parts.items()):
        one = rows.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(rows.columns))).cast(StringType()).alias("data"))
        out = one if out is None else out.unionByName(one)
    return out

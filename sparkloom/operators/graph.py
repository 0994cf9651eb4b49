"""Graph operators over edges (src, dst) and symbols (id, name, kind, module)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import math as M
from sparkloom.functions import text as T


def neighbours(edges: DataFrame, symbols: DataFrame, incoming: bool = False) -> DataFrame:
    """(node, id, name, kind): callees, or callers if ``incoming``; edges to unknown symbols are dropped."""
    node, other = ("dst", "src") if incoming else ("src", "dst")
    return edges.select(F.col(node).alias("node"), F.col(other).alias("id")).distinct().join(symbols.select("id", "name", "kind"), "id")


def relationships_of(edges: DataFrame, node: int, outgoing: list[str], incoming: list[str]) -> DataFrame:
    """(other, kind, direction): a node's edges of some kinds each way."""
    out = edges.where((F.col("src") == node) & F.col("kind").isin(outgoing)).select(F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"))
    return out.unionByName(edges.where((F.col("dst") == node) & F.col("kind").isin(incoming)).select(F.col("src").alias("other"), "kind", F.lit("in").alias("direction")))


def impact(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): everything that reaches ``start`` (id) within ``depth`` steps, by its least depth; the start is left out."""
    seen = start.select("id").distinct().withColumn("depth", F.lit(0).cast("long"))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        front = step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d).cast("long"))
        seen = seen.unionByName(front)
        if d % 3 == 0 and d < depth:
            seen = cut(seen)
            front = seen.where(F.col("depth") == d)
    return seen.where("depth > 0")


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint in the shared folder, so that lineage does not double with depth."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-"))
    return rows.checkpoint()


def call_tree(edges: DataFrame, root: int, depth: int, most: int | None = 100) -> DataFrame:
    """(path, depth, reason): calls from ``root`` by path; a repeated node is recorded as ``recursive`` and not expanded.

    Each level keeps at most ``most`` nodes in path order (the tree's stated limit), or all if it is None; those at the last level that call on are marked ``depth``.
    """
    spark = edges.sparkSession
    level = spark.createDataFrame([([root],)], "path array<long>").withColumn("reason", F.lit(None).cast("string"))
    out = level.withColumn("depth", F.lit(0).cast("long"))
    calls = edges.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        open_ = level.where("reason is null").withColumn("src", F.element_at("path", -1))
        step = open_.join(calls, "src").select(F.concat("path", F.array("dst")).alias("path"), F.when(F.array_contains("path", F.col("dst")), "recursive").alias("reason"))
        level = step if most is None else step.orderBy("path").limit(most)
        out = out.unionByName(level.withColumn("depth", F.lit(d).cast("long")))
    more = calls.select(F.col("src").alias("last")).distinct().withColumn("more", F.lit(True))
    out = out.withColumn("last", F.element_at("path", -1)).join(more, "last", "left")
    return out.select("path", "depth", F.coalesce("reason", F.when(F.col("more") & (F.col("depth") == depth), "depth")).alias("reason"))


def collapse_calls(tree: DataFrame) -> DataFrame:
    """(parent, callee, n, depth): repeated calls of one parent as one row."""
    rows = tree.where("depth > 0").select(F.element_at("path", -2).alias("parent"), F.element_at("path", -1).alias("callee"), "depth")
    return rows.groupBy("parent", "callee").agg(F.count("*").alias("n"), F.min("depth").alias("depth"))


def module_graph(edges: DataFrame, symbols: DataFrame, least: int = 20, top: int | None = None) -> DataFrame:
    """(from_module, to_module, calls) across modules, at least ``least`` calls."""
    own = symbols.select("id", "module")
    joined = edges.join(own.withColumnsRenamed({"id": "src", "module": "from_module"}), "src").join(own.withColumnsRenamed({"id": "dst", "module": "to_module"}), "dst")
    out = joined.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("calls")).where(F.col("calls") >= least)
    return out.orderBy(F.desc("calls"), "from_module", "to_module").limit(top) if top else out


def fans(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) by one aggregation over both ends of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def layers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out, layer) of the module graph."""
    between = module_graph(edges, symbols, least=1)
    total_in = between.groupBy(F.col("to_module").alias("module")).agg(F.sum("calls").alias("fan_in"))
    total_out = between.groupBy(F.col("from_module").alias("module")).agg(F.sum("calls").alias("fan_out"))
    both = total_in.join(total_out, "module", "full_outer").select("module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.withColumn("layer", M.layer(F.col("module"), F.col("fan_in"), F.col("fan_out")))


def blast_radius(edges: DataFrame, symbols: DataFrame, top: int = 5) -> DataFrame:
    """(id, callers, modules, risk) of the symbols with the most callers."""
    own = symbols.select(F.col("id").alias("src"), F.col("module").alias("caller_module"))
    counted = edges.join(own, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count_distinct("caller_module").alias("modules"))
    return counted.withColumn("risk", M.risk(F.col("callers"), F.col("modules"))).orderBy(F.desc("callers"), "id").limit(top)


def critical_paths(edges: DataFrame, starts: DataFrame, hops: int = 6, symbols: DataFrame | None = None) -> DataFrame:
    """(start, hop, id): from each start the unvisited callee with the greatest fan-in, then the smallest id, hop by hop.

    With ``symbols`` (id, name, file_path), callees that only log or convert, and those of utility modules, are not gone through.
    """
    calls = edges.select("src", "dst").distinct()
    weight = edges.groupBy(F.col("dst").alias("next")).agg(F.count("*").alias("fan"))
    if symbols is not None:
        passed = symbols.where(~T.is_trivial_step(F.col("name"), F.col("file_path")) & ~T.is_utility(F.col("file_path")))
        weight = weight.join(passed.select(F.col("id").alias("next")), "next", "left_semi")
    path = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    best = F.max_by("next", F.struct("fan", -F.col("next")))
    for hop in range(hops):
        step = path.withColumn("src", F.element_at("path", -1)).join(calls.withColumnRenamed("dst", "next"), "src").where(~F.array_contains("path", F.col("next"))).join(weight, "next")
        chosen = step.groupBy("start").agg(best.alias("next"))
        path = path.where(F.size("path") == hop + 1).join(chosen, "start", "left").select("start", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path")).unionByName(path.where(F.size("path") != hop + 1))
        if hop % 2 and hop < hops - 1:
            path = cut(path)
    return path.select("start", F.posexplode("path").alias("hop", "id")).select("start", F.col("hop").cast("long").alias("hop"), "id")


def by_relation(relationships: DataFrame, symbols: DataFrame, kind: str, incoming: bool = False) -> DataFrame:
    """(node, id, name, symbol_kind) of one kind of relationship (from_id, to_id, kind), either way."""
    edges = relationships.where(F.col("kind") == kind).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return neighbours(edges, symbols, incoming).withColumnRenamed("kind", "symbol_kind")


DEPENDS, DEPENDED, AFFECTS = ("Calls", "Uses", "Implements", "Defines"), ("Calls", "Uses", "Implements"), ("Calls", "Uses", "Implements", "Extends")


def dependencies(relationships: DataFrame, symbols: DataFrame, incoming: bool = False) -> DataFrame:
    """(node, kind, names): sorted names that each symbol depends on, by kind of relation; those that depend on it if ``incoming``."""
    node, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    names = symbols.select(F.col("id").alias(other), "name")
    rows = relationships.where(F.col("kind").isin(*(DEPENDED if incoming else DEPENDS))).join(names, other)
    return rows.groupBy(F.col(node).alias("node"), "kind").agg(F.array_sort(F.collect_set("name")).alias("names"))


def relationship_context(relationships: DataFrame, symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, kind, direction, names): all relations of the asked symbols (id), Defines only outwards."""
    own = lambda node, other, direction, rows: rows.join(ids.withColumnRenamed("id", node), node).join(symbols.select(F.col("id").alias(other), "name"), other).groupBy(F.col(node).alias("id"), "kind").agg(F.array_sort(F.collect_set("name")).alias("names")).withColumn("direction", F.lit(direction))
    out = own("from_id", "to_id", "out", relationships)
    return out.unionByName(own("to_id", "from_id", "in", relationships.where("kind <> 'Defines'"))).select("id", "kind", "direction", "names")


def impact_by_kind(edges: DataFrame, symbols: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(kind, n, nearest): what reaches ``start``, by the symbols' kind, with the least distance."""
    return impact(edges, start, depth).join(symbols.select("id", "kind"), "id").groupBy("kind").agg(F.count("*").alias("n"), F.min("depth").alias("nearest"))


def filtered_tree(tree: DataFrame, symbols: DataFrame, trivial: bool = False, external: bool = False) -> DataFrame:
    """Rows of a call tree (path, depth, reason) without calls of trivial symbols and without what lies below external ones, and those themselves unless asked for.

    ``symbols`` (id, name, kind, module, class_name, file_path).
    """
    qualified = T.qualified_name(F.col("class_name"), F.col("module"), F.col("name"))
    marks = symbols.select("id", T.is_trivial_call(qualified, F.col("kind")).alias("trivial"), T.is_external(F.col("file_path")).alias("external"))
    steps = tree.select("path", "depth", "reason", F.posexplode("path").alias("at", "id")).where("at > 0").join(marks, "id", "left")
    below = F.bool_or(F.coalesce("external", F.lit(True)) & ((F.col("at") < F.col("depth")) | F.lit(not external)))
    dull = F.bool_or(F.coalesce("trivial", F.lit(False)))
    flags = steps.groupBy("path").agg(below.alias("below"), dull.alias("dull"))
    gone = F.coalesce("below", F.lit(False)) | (F.coalesce("dull", F.lit(False)) & F.lit(not trivial))
    return tree.join(flags, "path", "left").where(~gone).select("path", "depth", "reason")


def call_examples(edges: DataFrame, symbols: DataFrame, files: DataFrame, callee: int, most: int = 3, context: int = 3) -> DataFrame:
    """(caller, line, snippet): the first ``most`` callers by id, with ``context`` lines around where the callee's name first occurs in their lines."""
    name = symbols.where(F.col("id") == callee).select(F.col("name").alias("callee_name"))
    callers = edges.where(F.col("dst") == callee).select(F.col("src").alias("id")).distinct().orderBy("id").limit(most)
    own = callers.join(symbols, "id").join(F.broadcast(name)).join(files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("lines")), "file_path")
    body = F.slice("lines", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1))
    at = F.array_position(F.transform(body, lambda x: F.contains(x, F.col("callee_name"))), True)
    line = F.col("start_line") + F.greatest(F.lit(1), at).cast("int") - 1
    lo, hi = F.greatest(F.lit(1), F.col("line") - context), F.least(F.size("lines"), F.col("line") + context)
    rows = own.withColumn("line", line)
    return rows.select(F.col("id").alias("caller"), F.col("line").cast("long").alias("line"), F.array_join(F.slice("lines", lo, F.greatest(F.lit(0), hi - lo + 1)), "\n").alias("snippet"))


def ancestors(edges: DataFrame, depth: int) -> DataFrame:
    """(id, ancestor, depth): transitive closure of ``extends`` edges to ``depth`` steps, each pair at its least depth."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("ancestor")).distinct()
    found = step.withColumn("depth", F.lit(1).cast("long"))
    front = found
    for d in range(2, depth + 1):
        front = front.select("id", F.col("ancestor").alias("via")).join(step.select(F.col("id").alias("via"), "ancestor"), "via").where("id <> ancestor").select("id", "ancestor").distinct()
        front = front.join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(d).cast("long"))
        found = found.unionByName(front)
        if d % 3 == 0 and d < depth:
            found = cut(found)
            front = found.where(F.col("depth") == d)
    return found


def symbol_context(edges: DataFrame, symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, callees, callers): sorted names on either side of each asked symbol."""
    names = symbols.select("id", "name")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src").join(names.withColumnsRenamed({"id": "dst", "name": "callee"}), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst").join(names.withColumnsRenamed({"id": "src", "name": "caller"}), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    none = F.expr("cast(array() as array<string>)")
    return ids.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))

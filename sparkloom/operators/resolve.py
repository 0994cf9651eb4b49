"""Joins that resolve names and places: tiers, as-of, containment, and longest folder prefix."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import cut


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row of its key at or before its time.

    Both sides go into one sorted stream per key, so no pair of rows is built: one shuffle, one running maximum.
    """
    a = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*(F.col(c).alias(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = Window.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_t", "_side", "_v")


def containing(points: DataFrame, ranges: DataFrame, key: str, grid: int = 64) -> DataFrame:
    """(point_id, range_id): the smallest range of the same key that holds the point, ties by id; null without one.

    ``points`` (point_id, key, at), ``ranges`` (range_id, key, lo, hi); with a column ``until`` a point is the stretch from ``at`` to there. Ranges are cut at the cells of a grid whose width is that of the
    next power of ``grid`` that covers them, so a point meets a few cells of each width instead of all ranges of its key. Equal ranges are one, that of the least id, and equal points are one.
    """
    ranges = ranges.groupBy(key, "lo", "hi").agg(F.min("range_id").alias("range_id"))
    span = F.col("hi") - F.col("lo") + 1
    level = F.greatest(F.lit(0), F.ceil(F.log(span.cast("double")) / math.log(grid) - 1e-9)).cast("int")
    width = F.pow(F.lit(float(grid)), F.col("level")).cast("long")
    cells = ranges.where("lo <= hi").withColumn("level", level)
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    # Few widths occur: one row for each.
    levels = F.broadcast(cells.select("level").distinct())
    points = points.withColumn("end", F.greatest("at", "until") if "until" in points.columns else F.col("at"))
    own = points.select(key, "at", "end").distinct().join(levels).withColumn("cell", F.floor(F.col("at") / width))
    held = own.join(cells, [key, "level", "cell"]).where((F.col("at") >= F.col("lo")) & (F.col("end") <= F.col("hi")))
    near = held.groupBy(key, "at", "end").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("size"), "range_id")).alias("near"))
    best = points.join(near, [key, "at", "end"]).groupBy("point_id").agg(F.min("near")["range_id"].alias("range_id"))
    return points.select("point_id").distinct().join(best, "point_id", "left")


LAST_PART = r"::|\.|/|\\"


def resolve_names(unresolved: DataFrame, symbols: DataFrame, imports: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(rel_id, to_id, status, tier): the symbol that a name means, tier by tier.

    1: same file; 2: imported (alias or last path part equals the name, module and path contain one another, same language);
    3: same language, and the same module or public. In tier 1 several candidates are settled by the closest definition at
    or before the use; in the others several are ambiguous (no id). Nothing crosses languages.
    ``unresolved`` (rel_id, to_name, file_id, language, module, line), ``symbols`` (id, name, file_id, language, module, visibility, line),
    ``imports`` (file_id, path, alias).

    With ``matched`` (file_id, local, to_id), as imports.matched_imports() gives it, tier 2 goes by the languages' own rules instead.

    Each tier is a join on its own keys, for what the tiers before left: a common name meets the symbols of its file, then those of its
    imports. In tier 3 all that is asked is how many symbols fit, so they are counted by name, language and module first and no pairs are made.
    """
    s = symbols.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("file_id").alias("s_file"), "language", F.col("module").alias("s_module"), "visibility", F.col("line").alias("s_line"))
    local = unresolved.join(s.drop("language").withColumnRenamed("s_file", "file_id"), ["to_name", "file_id"])
    before = F.when(F.col("s_line") <= F.col("line"), F.col("s_line"))
    own = local.groupBy("rel_id").agg(F.count_distinct("to_id").alias("n"), F.max(F.struct(before.alias("at"), (-F.col("to_id")).alias("neg"))).alias("close"), F.min("to_id").alias("low"))
    first = own.select("rel_id", F.when(F.col("n") == 1, F.col("low")).when(F.col("close.at").isNotNull(), -F.col("close.neg")).alias("to_id"), F.lit(1).alias("tier"))

    left = unresolved.join(first.select("rel_id"), "rel_id", "left_anti")
    named = imports.select("file_id", F.coalesce("alias", F.element_at(F.split("path", LAST_PART), -1)).alias("to_name"), "path").distinct()
    known = s.select("to_id", "language")
    through = left.join(matched.select("file_id", F.col("local").alias("to_name"), "to_id"), ["file_id", "to_name"]).join(known, ["to_id", "language"]) if matched is not None else left.join(named, ["file_id", "to_name"]).join(s, ["to_name", "language"]).where(F.contains("path", "s_module") | F.contains("s_module", "path"))
    second = through.groupBy("rel_id").agg(F.count_distinct("to_id").alias("n"), F.min("to_id").alias("low")).select("rel_id", F.when(F.col("n") == 1, F.col("low")).alias("to_id"), F.lit(2).alias("tier"))

    left = left.join(second.select("rel_id"), "rel_id", "left_anti")
    public, counted = F.col("visibility") == "Public", [F.count("*").alias("n"), F.min("to_id").alias("low")]
    everywhere = s.where(public).groupBy("to_name", "language").agg(*counted)
    inside = s.where(~public | F.col("visibility").isNull()).groupBy("to_name", "language", F.col("s_module").alias("module")).agg(F.count("*").alias("m"), F.min("to_id").alias("near"))
    both = left.join(everywhere, ["to_name", "language"], "left").join(inside, ["to_name", "language", "module"], "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
    third = both.where(total > 0).select("rel_id", F.when(total == 1, F.coalesce("low", "near")).alias("to_id"), F.lit(3).alias("tier"))

    found = first.unionByName(second).unionByName(third)
    out = unresolved.select("rel_id").join(found, "rel_id", "left")
    return out.select("rel_id", "to_id", F.when(F.col("tier").isNull(), "no_candidates").when(F.col("to_id").isNull(), "ambiguous").otherwise("resolved").alias("status"), F.col("tier").cast("long").alias("tier"))


def resolve_in_order(unresolved: DataFrame, symbols: DataFrame, imports: DataFrame, commit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """resolve_names() in two phases: relations of kind Defines first, written by ``commit``, which gives back what was written, then all others.

    ``unresolved`` also has kind. Gives (rel_id, to_id, status, tier, kind).
    """
    named = lambda rows: resolve_names(rows, symbols, imports).join(rows.select("rel_id", "kind"), "rel_id")
    defines = commit(named(unresolved.where("kind = 'Defines'")))
    return defines.unionByName(named(unresolved.where("kind <> 'Defines'")))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """(status, tier, n)."""
    return resolved.groupBy("status", "tier").agg(F.count("*").alias("n"))


def resolution_counts(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """resolution_stats() of resolve_names() for ``uses`` (to_name, file_id, language, module, line, uses), each of which stands for ``uses`` relations.

    Relations with the same name, file, language, module and line mean the same, so each is resolved once and only numbers go through the tiers.
    """
    same = uses.groupBy("to_name", "file_id", "language", "module", "line").agg(F.sum("uses").alias("uses"))
    own = cut(same.withColumn("rel_id", F.monotonically_increasing_id()))
    return resolve_names(own, symbols, imports).join(own.select("rel_id", "uses"), "rel_id").groupBy("status", "tier").agg(F.sum("uses").alias("n"))


#: Order in which scopes are searched for a name (fixed values); names of other scopes are not found.
SCOPES = {
    "rust": ("local", "imported", "module", "crate"), "python": ("local", "enclosing", "module", "imported", "builtin"), "typescript": ("block", "hoisted", "imported", "module", "type", "global"),
    "javascript": ("block", "hoisted", "imported", "module", "global"), "go": ("local", "package", "imported"), "java": ("local", "class", "file", "imported", "package"),
    "kotlin": ("local", "class", "companion", "file", "imported", "global"), "csharp": ("local", "class", "namespace", "imported", "global"), "php": ("local", "class", "namespace", "global"), "swift": ("local", "class", "extension", "protocol", "module", "imported"),
    "lua": ("local", "imported", "module", "global"), "gdscript": ("local", "class", "module", "imported", "global"), "c": ("local", "module", "imported", "global"), "cpp": ("using", "local", "module", "imported", "global"),
}
DEFAULT_SCOPES = ("local", "module", "package", "global")
#: What parts of a module's path are joined by (fixed values).
SEPARATORS = {"rust": "::", "c": "::", "cpp": "::", "go": "/", "gdscript": "/", "php": "\\"}


def scope_rank(language: Column, scope: Column) -> Column:
    """Place of a scope in the search order of a language, null where it is not searched."""
    ranks = lambda scopes: F.array_position(F.array(*map(F.lit, scopes)), scope)
    out = ranks(DEFAULT_SCOPES)
    for name, scopes in SCOPES.items():
        out = F.when(language == name, ranks(scopes)).otherwise(out)
    return F.nullif(out, F.lit(0))


def resolve_in_scopes(uses: DataFrame, scoped: DataFrame) -> DataFrame:
    """(use_id, id, scope): the first symbol, by its language's scopes and then by id, that a name means in a file.

    ``uses`` (use_id, file_id, name, language), ``scoped`` (file_id, name, scope, id). A name of two parts, ``A.b`` or ``A::b``, that no scope has as a whole means the
    member b of what A means: the row of ``scoped`` with name b, scope ``member:<id of A>``. Of the symbols of one file, name and scope only the least id can be meant, so a use
    meets one row for each scope, however often a name is defined there.
    """
    scoped = scoped.groupBy("file_id", "name", "scope").agg(F.min("id").alias("id"))

    def first(rows: DataFrame) -> DataFrame:
        near = rows.join(scoped, ["file_id", "name"]).withColumn("rank", scope_rank(F.col("language"), F.col("scope"))).where("rank is not null")
        return near.groupBy("use_id").agg(F.min_by(F.struct("id", "scope"), F.struct("rank", "id")).alias("x")).select("use_id", "x.id", "x.scope")

    whole = first(uses)
    left = uses.join(whole, "use_id", "left_anti")
    parts = left.withColumn("parts", F.split("name", r"::|\.")).where("size(parts) = 2")
    owner = first(parts.withColumn("name", F.col("parts")[0]))
    member = parts.join(owner.select("use_id", F.col("id").alias("owner")), "use_id").select("use_id", "file_id", F.col("parts")[1].alias("name"), F.concat(F.lit("member:"), "owner").alias("scope"))
    found = member.join(scoped, ["file_id", "name", "scope"]).groupBy("use_id").agg(F.min("id").alias("id"), F.first("scope").alias("scope"))
    return whole.unionByName(found)


def module_path(path: Column, language: Column) -> Column:
    """Module of a file: its folders and stem, joined as the language does; index, mod, lib, main and __init__ are their folder."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"(^|/)(?:index|mod|lib|main|__init__)$", "")
    joined = F.replace(F.regexp_replace(stem, r"^(?:\./)*(?:src/)?", ""), F.lit("/"), F.lit("."))
    for name, separator in SEPARATORS.items():
        joined = F.when(language == name, F.replace(F.regexp_replace(stem, r"^(?:\./)*(?:src/)?", ""), F.lit("/"), F.lit(separator))).otherwise(joined)
    return joined


def resolve_methods(calls: DataFrame, defines: DataFrame, parents: DataFrame, depth: int = 8) -> DataFrame:
    """(call_id, owner, method_id): the nearest type, upwards from the receiver's, that defines a method; ties by the type's id.

    ``calls`` (call_id, type_id, method), ``defines`` (type_id, method, method_id), ``parents`` (src, dst): src extends or implements dst. ``depth`` levels are looked at.
    """
    from sparkloom.operators import graph

    above = graph.ancestors(parents, depth).select(F.col("id").alias("type_id"), F.col("ancestor").alias("owner"), "depth")
    own = calls.select("type_id").distinct().select("type_id", F.col("type_id").alias("owner"), F.lit(0).cast("long").alias("depth"))
    reach = own.unionByName(above)
    found = calls.join(reach, "type_id").join(defines.withColumnRenamed("type_id", "owner"), ["owner", "method"])
    return found.groupBy("call_id").agg(F.min_by(F.struct("owner", "method_id"), F.struct("depth", "owner", "method_id")).alias("x")).select("call_id", "x.owner", "x.method_id")


def all_methods(defines: DataFrame, parents: DataFrame, depth: int = 8) -> DataFrame:
    """(type_id, method, owner): every method that a type has, from the nearest type that defines it."""
    types = defines.select("type_id").unionByName(parents.select(F.col("src").alias("type_id"))).distinct()
    names = defines.select("method").distinct()
    from sparkloom.operators import graph

    above = graph.ancestors(parents, depth).select(F.col("id").alias("type_id"), F.col("ancestor").alias("owner"), "depth")
    reach = types.select("type_id", F.col("type_id").alias("owner"), F.lit(0).cast("long").alias("depth")).unionByName(above)
    held = reach.join(defines.withColumnRenamed("type_id", "owner"), "owner").join(names, "method", "left_semi")
    return held.groupBy("type_id", "method").agg(F.min_by("owner", F.struct("depth", "owner")).alias("owner"))


def compatible(edges: DataFrame, matrix: DataFrame) -> DataFrame:
    """Edges whose (from_kind, to_kind, kind) is allowed by ``matrix``."""
    return edges.join(matrix, ["from_kind", "to_kind", "kind"], "left_semi")


def governing_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, dir): the deepest configured folder above each file, by its own folders rather than by pairs with all configs."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.select("path", F.explode(above).alias("dir")).join(configs.select("dir").distinct(), "dir")
    return rows.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))

"""Merkle manifest of a table: every row a leaf, a tree for each language, one root over all trees, and a proof for each row.

Parents are made as in combineByKey: a task opens a partial parent for a key (level, number of the parent) when its first child arrives,
puts each child's digest at its place, and emits the parent's digest as a child of the next level as soon as the parent has as many children
as the tree's size says: ARITY, or what is left over in the last run. What cannot be completed where it is, the top of a block of
ARITY**LEVELS nodes, is the frontier: it is reshuffled and forms the leaves of the next round, so a tree of n leaves takes log(n) / LEVELS / log(ARITY)
rounds and no task ever holds more than one block. Blocks are written with their nodes; the same blocks then give each parent's links back to
its children, from the root down, and so every leaf its proof: the siblings at each level, to the left and to the right of its own path.

Leaves are ranked within their tree by a range sort and the sizes of the sorted parts, so a language that holds most rows is dealt over many
tasks. Rows with equal keys are ordered by their leaves; rows that are equal altogether have equal leaves at places next to each other.
Null ids come first, null languages form a tree of their own (the first), null fields count as ``-``. Empty texts are fields of length 0, very
long ones are hashed by the JVM and never leave it. An empty table has an empty result. Further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

ARITY, LEVELS = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def row_digest(fields: Iterable[Column]) -> Column:
    """Hex sha256 of the fields in turn: ``-`` for null, else the number of its UTF-8 bytes, a colon and the value."""
    texts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered): ``altered`` is the leaf that the row would have with n_chars greater by 1."""
    own = [F.col(c) for c in FIELDS]
    more = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS]
    # Null languages first, the others in the order of their bytes.
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(own).alias("leaf"), row_digest(more).alias("altered"))


class PartialParents:
    """combineByKey over nodes of one block: ``add`` merges a child into its parent's partial and goes on upwards from every parent that is whole."""

    def __init__(self, sizes: list[int], arity: int):
        self.sizes, self.arity = sizes, arity
        self.open: dict[tuple[int, int], list] = {}
        self.children: dict[tuple[int, int], list[bytes]] = {}  # links from whole parents back
        self.top: bytes | None = None

    def add(self, index: int, digest: bytes) -> None:
        level = 0
        while level + 1 < len(self.sizes):
            parent, place = divmod(index, self.arity)
            key = level + 1, parent
            due = min(self.arity, self.sizes[level] - parent * self.arity)
            if key not in self.open:
                self.open[key] = [due, [None] * due]  # createCombiner
            state = self.open[key]
            state[1][place] = digest  # mergeValue
            state[0] -= 1
            if state[0]:
                return
            self.children[key] = self.open.pop(key)[1]
            level, index, digest = level + 1, parent, sha256(b"".join(self.children[key])).hexdigest().encode()
        self.top = digest


def block_sizes(n: int, whole: bool, arity: int, levels: int) -> list[int]:
    """How many nodes a block of ``n`` has at each level: up to one node where it is a whole tree, else up to the next round's level."""
    sizes = [n]
    while sizes[-1] > 1 if whole else len(sizes) <= levels:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their tree's ``size`` and their ``index`` in it, by ``order``."""
    rows = staged(nodes.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    keys = ["tree", *order, "tie"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    # The low bits of the id number the rows of a part.
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    dealt = staged(dealt, "merkle-sorted")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row for each part that a tree lies in.
    before, all_of = Window.partitionBy("tree").orderBy("part"), Window.partitionBy("tree")
    shifts = counts.select("tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(all_of).alias("size"))
    return dealt.join(shifts, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocks_of(nodes: DataFrame, carry: list[str], arity: int, levels: int) -> DataFrame:
    """(tree, size, block, nodes, top, carried arrays) of ``nodes`` (tree, size, index, hash, carried columns)."""
    span = arity**levels
    kinds = dict(nodes.dtypes)
    dealt = nodes.select("tree", "size", (F.floor(F.col("index") / span)).cast("long").alias("block"), "index", "hash", *carry)
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    schema = "tree string, size long, block long, nodes array<string>, top string" + "".join(f", {c} array<{kinds[c]}>" for c in carry)
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    columns = {"tree": pa.string(), "size": pa.int64(), "block": pa.int64(), "nodes": pa.list_(pa.string()), "top": pa.string()} | {c: pa.list_(arrow[kinds[c]]) for c in carry}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parents, held = None, None, []

        def whole() -> pa.RecordBatch:
            row = [*key, [r[0] for r in held], parents.top.decode(), *([r[i + 1] for r in held] for i in range(len(carry)))]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, columns.values())], list(columns))

        for batch in batches:
            for tree, size, block, index, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (tree, size, block):
                    key, held = (tree, size, block), []
                    own = min(span, size - block * span)
                    parents = PartialParents(block_sizes(own, size <= span, arity, levels), arity)
                parents.add(index - block * span, rest[0].encode())
                held.append(rest)
                if parents.top is not None:
                    yield whole()

    return dealt.mapInArrow(run, schema)


def below(blocks: DataFrame, carry: list[str], arity: int, levels: int) -> DataFrame:
    """(tree, index, hash, carried columns, subroot, root, proof): the nodes of ``blocks``, which have their top's (subroot, root, proof)."""
    span = arity**levels
    kinds = {c: k[6:-1] for c, k in blocks.dtypes if c in carry}
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    names = ["tree", "index", "hash", *carry, "subroot", "root", "proof"]
    schema = "tree string, index long, hash string" + "".join(f", {c} {kinds[c]}" for c in carry) + f", subroot string, root string, proof {PROOF}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = [x.encode() for x in row["nodes"]]
                parents = PartialParents(block_sizes(len(nodes), row["size"] <= span, arity, levels), arity)
                for i, x in enumerate(nodes):
                    parents.add(i, x)
                # Steps of the nodes of a level, from the top down: each child's own step stands before its parent's.
                steps = [[(s["left"], s["right"]) for s in row["proof"]]]
                for level in range(len(parents.sizes) - 1, 0, -1):
                    lower = []
                    for parent in range(parents.sizes[level]):
                        run_ = parents.children[level, parent]
                        for place in range(len(run_)):
                            own = b"".join(run_[:place]).decode(), b"".join(run_[place + 1 :]).decode()
                            lower.append([own, *steps[parent]])
                    steps = lower
                n, flat = len(nodes), [s for own in steps for s in own]
                ends, at = [0], 0
                for own in steps:
                    at += len(own)
                    ends.append(at)
                proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], fields=list(_STEP)))
                first = row["block"] * span
                values = [pa.array([row["tree"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(row["nodes"], pa.string())]
                values += [pa.array(row[c], arrow[kinds[c]]) for c in carry]
                values += [pa.array([row[c]] * n, pa.string()) for c in ("subroot", "root")]
                yield pa.RecordBatch.from_arrays([*values, proof], names)

    return blocks.select("tree", "size", "block", "nodes", *carry, "subroot", "root", "proof").mapInArrow(run, schema)


def prove(nodes: DataFrame, order: list[str], carry: list[str], above: Callable[[DataFrame], DataFrame], arity: int, levels: int) -> DataFrame:
    """Every one of ``nodes`` (tree, hash, order and carried columns) with (subroot, root, proof).

    ``above`` gives (tree, subroot, root, proof) for the trees' tops (tree, top).
    """
    span = arity**levels
    level = ranked(nodes, order).select("tree", "size", "index", "hash", *carry)
    most, rounds = None, []
    while True:
        blocks = staged(blocks_of(level, [] if rounds else carry, arity, levels), f"merkle-blocks-{len(rounds)}")
        rounds.append(blocks)
        most = most or blocks.agg(F.max("size")).first()[0] or 0
        if most <= span:
            break
        most = -(-most // span)
        level = blocks.where(F.col("size") > span).select("tree", F.ceil(F.col("size") / span).cast("long").alias("size"), F.col("block").alias("index"), F.col("top").alias("hash"))
    roots = rounds[0].where(F.col("size") <= span).select("tree", "top")
    for blocks in rounds[1:]:
        roots = roots.unionByName(blocks.where(F.col("size") <= span).select("tree", "top"))
    tops, paths = staged(above(roots), "merkle-tops"), None
    for i, blocks in reversed(list(enumerate(rounds))):
        known = blocks.where(F.col("size") <= span).join(tops, "tree")
        if paths is not None:
            known = known.unionByName(blocks.where(F.col("size") > span).join(paths.select("tree", F.col("index").alias("block"), "subroot", "root", "proof"), ["tree", "block"]))
        paths = below(known, carry if i == 0 else [], arity, levels)
        if i:
            paths = staged(paths, f"merkle-paths-{i}")
    return paths


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, altered, subroot, root, proof) of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``proof`` holds a step for each level up to the root: the digests of the run's members to the left of the path and those to its right.
    """
    small_batches(docs.sparkSession)

    def last(roots: DataFrame) -> DataFrame:
        return roots.select("tree", F.col("top").alias("subroot"), F.col("top").alias("root"), F.array().cast(PROOF).alias("proof"))

    def upper(roots: DataFrame) -> DataFrame:
        one = roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("top").alias("hash"))
        return prove(one, ["own"], ["own"], last, arity, levels).select(F.col("own").alias("tree"), F.col("hash").alias("subroot"), "root", "proof")

    found = prove(leaves(docs).withColumn("hash", F.col("leaf")).drop("leaf"), ["doc_id", "hash"], ["doc_id", "altered"], upper, arity, levels)
    return found.select("doc_id", F.col("hash").alias("leaf"), "altered", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of ``proof``, level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def verified(found: DataFrame) -> DataFrame:
    """The digest columns of op11_merkle: rows whose id's crc32 is divisible by 7 are held to their proof with the altered leaf."""
    told = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("altered")).otherwise(F.col("leaf"))
    rows = found.withColumns({"proof_sha256": F.sha2(siblings(F.col("proof")), 256), "folded_root": folded(told, F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows in DuckDB: levels by a recursive union, proofs by siblings' places, roots folded over a list. crc32 is not among its functions.
SQL = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
own AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
rows_ AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS altered,
 xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 7 = 0 AS told FROM own, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM rows_),
tree AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM tree WHERE n = 1),
upper_ AS (SELECT 0 AS level, j, m, subroot AS h FROM subroots UNION ALL SELECT level + 1, j // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM upper_ WHERE m > 1 GROUP BY level, j // 2, m),
roots AS (SELECT h AS root FROM upper_ WHERE m = 1),
below AS (SELECT l.doc_id, l.leaf, list(CASE WHEN s.h IS NULL THEN 'N' WHEN (l.i >> k.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY k.level) AS steps
 FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) k ON l.lang IS NOT DISTINCT FROM k.lang LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = k.level AND s.i = xor(l.i >> k.level, 1) GROUP BY l.doc_id, l.leaf),
above AS (SELECT r.lang, list(CASE WHEN s.h IS NULL THEN 'N' WHEN (r.j >> k.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY k.level) AS steps
 FROM subroots r CROSS JOIN (SELECT DISTINCT level FROM upper_ WHERE m > 1) k LEFT JOIN upper_ s ON s.level = k.level AND s.j = xor(r.j >> k.level, 1) GROUP BY r.lang),
proofs AS (SELECT l.*, subroot, root, list_concat(coalesce(b.steps, []), coalesce(a.steps, [])) AS steps FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang CROSS JOIN roots
 LEFT JOIN below b ON b.doc_id IS NOT DISTINCT FROM l.doc_id AND b.leaf = l.leaf LEFT JOIN above a ON a.lang IS NOT DISTINCT FROM l.lang),
done AS (SELECT *, list_reduce(list_prepend(CASE WHEN told THEN altered ELSE leaf END, steps), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] for s in steps], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done"""

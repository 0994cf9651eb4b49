"""A written index in segments: Parquet folders that are never changed, lists of what has gone since, and numbered manifests that say what is in force.

A change writes what is new as a segment and what goes as a list of keys (a tombstone list), both in proportion to the change, then the next manifest. The
newest manifest that is whole counts: it is created under a name that did not exist, so of two writers one fails, and a writer that dies leaves the one before
in force. A list of keys counts for segments older than itself. Folders that neither the new manifest nor the one before names are removed after a commit, so what a
reader opened just before stays. Compaction merges small segments and drops lists that no older segment needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import math as M
from sparkloom.operators import incremental
from sparkloom.sources.manifests import Manifests

#: The one manifest of indexes of version 1.
CURRENT = "CURRENT.json"
#: Segments of a table from which on the smaller half is merged.
MOST = 8
#: Files of an index and what belongs to them.
OWNED = ("files", "symbols", "imports", "relationships", "chunks", "vectors")


class IndexStore:
    """The tables of schemas.TABLES below ``path``, which driver and executors share; any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def _numbers(self) -> list[int]:
        return self.manifests.numbers()

    def metadata(self) -> dict:
        """{version, number, tables: {name: segments}, gone: {name: lists}, facts}; empty before the first commit. An index of a newer version is refused, older ones are read."""
        found = self.manifests.newest()
        if found is None:
            found = json.loads(self.manifests.text(CURRENT) or "{}")
            if found.get("version", 0) == 1:
                found["tables"] = {name: [{"folder": folder, "since": 0, "bytes": 0}] for name, folder in found.get("tables", {}).items()}
                found |= {"number": 0, "gone": {}}
        if found.get("version", 0) > schemas.VERSION:
            raise ValueError(f"the index has version {found['version']}, newer than {schemas.VERSION}")
        return found

    def _publish(self, before: dict, tables: dict, gone: dict, facts: dict) -> None:
        """Puts a manifest in force, then removes what neither it nor the one before needs."""
        number = max(self._numbers(), default=0) + 1
        # Lists that are no younger than any segment of their table have nothing left to say.
        gone = {name: [g for g in own if any(s["since"] < g["since"] for s in tables.get(name, []))] for name, own in gone.items()}
        body = {"version": schemas.VERSION, "number": number, "tables": tables, "gone": {k: v for k, v in gone.items() if v}, "facts": facts}
        self.manifests.create(number, body)
        used = lambda m: {x["folder"] for part in ("tables", "gone") for own in m.get(part, {}).values() for x in own}
        keep = used(body) | used(before)
        for old in self._numbers():
            if old < number and old != before.get("number"):
                for folder in used(self.manifests.read(old) or {}) - keep:
                    self.manifests.remove(folder)
                self.manifests.remove(f"manifest-{old:012d}.json")

    def _write(self, rows: DataFrame, name: str, since: int) -> dict:
        """A new folder with ``rows``, as a manifest names it."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "since": since, "bytes": self.manifests.size(folder)}

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of the table ``name``, in order; those that are missing are null."""
        fields = [f.split(" ", 1) for f in schemas.TABLES[name].split(", ")]
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields))

    # -- reading --------------------------------------------------------------------------------------------------

    def _segment(self, name: str, segment: dict) -> DataFrame:
        return self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.path}/{segment['folder']}")

    def _alive(self, name: str, segments: list[dict], gone: list[dict]) -> DataFrame:
        """The rows of ``segments`` that no younger list of keys names. Segments of one age are read together."""
        kinds, out = dict(f.split(" ", 1) for f in schemas.TABLES[name].split(", ")), None
        for since in sorted({s["since"] for s in segments}):
            rows = self.spark.read.schema(schemas.TABLES[name]).parquet(*(f"{self.path}/{s['folder']}" for s in segments if s["since"] == since))
            for column in sorted({g["column"] for g in gone if g["since"] > since}):
                folders = [f"{self.path}/{g['folder']}" for g in gone if g["since"] > since and g["column"] == column]
                rows = rows.join(self.spark.read.schema(f"{column} {kinds[column]}").parquet(*folders).distinct(), column, "left_anti")
            rows = rows.select(*kinds)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schemas.TABLES[name]) if out is None else out

    def read(self, name: str) -> DataFrame:
        """The table ``name`` in force, empty if it was never written."""
        found = self.metadata()
        return self._alive(name, found.get("tables", {}).get(name, []), found.get("gone", {}).get(name, []))

    # -- writing --------------------------------------------------------------------------------------------------

    def change(self, add: dict[str, DataFrame], remove: dict[str, list[tuple[str, DataFrame]]] | None = None, facts: dict | None = None) -> None:
        """One commit: rows of ``remove`` go ({table: [(column, keys)]}, keys being a frame of that column), then those of ``add`` come; all else stays where it lies."""
        before = self.metadata()
        since = max(self._numbers(), default=0) + 1
        tables = {name: list(own) for name, own in before.get("tables", {}).items()}
        gone = {name: list(own) for name, own in before.get("gone", {}).items()}
        for name, lists in (remove or {}).items():
            kinds = dict(f.split(" ", 1) for f in schemas.TABLES[name].split(", "))
            for column, keys in lists:
                if tables.get(name):
                    gone.setdefault(name, []).append(self._write(keys.select(F.col(column).cast(kinds[column])).distinct(), f"{name}-gone", since) | {"column": column})
        for name, rows in add.items():
            tables.setdefault(name, []).append(self._write(self._shaped(name, rows), name, since))
        self._publish(before, tables, gone, before.get("facts", {}) | (facts or {}))

    def commit(self, tables: dict[str, DataFrame], facts: dict | None = None) -> None:
        """Puts ``tables`` in force as a whole, all at once; other tables stay."""
        before = self.metadata()
        since = max(self._numbers(), default=0) + 1
        new = {name: [self._write(self._shaped(name, rows), name, since)] for name, rows in tables.items()}
        gone = {name: own for name, own in before.get("gone", {}).items() if name not in new}
        self._publish(before, before.get("tables", {}) | new, gone, before.get("facts", {}) | (facts or {}))

    def append(self, name: str, rows: DataFrame) -> None:
        self.change({name: rows})

    def compact(self, name: str, most: int = MOST) -> int:
        """Merges the smaller half of the segments of ``name`` into one where there are more than ``most``, without what has gone; gives how many there are then."""
        before = self.metadata()
        own, gone = before.get("tables", {}).get(name, []), before.get("gone", {}).get(name, [])
        if len(own) <= most:
            return len(own)
        small = sorted(own, key=lambda s: s["bytes"])[: len(own) // 2 + 1]
        merged = self._write(self._alive(name, small, gone), name, max(self._numbers()) + 1)
        kept = [s for s in own if s not in small]
        self._publish(before, before["tables"] | {name: [*kept, merged]}, before.get("gone", {}), before.get("facts", {}))
        return len(kept) + 1

    def clear(self) -> None:
        """An index without rows; facts go, too."""
        self._publish(self.metadata(), {}, {}, {})

    # -- parts of tables ------------------------------------------------------------------------------------------

    def delete_where(self, name: str, column: str, values: list) -> None:
        """Rows whose ``column`` is one of ``values`` go: by file, symbol, or id."""
        kind = dict(f.split(" ", 1) for f in schemas.TABLES[name].split(", "))[column]
        self.change({}, {name: [(column, self.spark.createDataFrame([(v,) for v in values], f"{column} {kind}"))]})

    def _owned_keys(self, gone: DataFrame) -> dict[str, list[tuple[str, DataFrame]]]:
        """Keys of all that belongs to the files ``gone`` (path): relationships go with either end, chunks with their file, vectors with their chunk."""
        lost = gone.select(F.col("path").alias("file_path")).distinct()
        ids = self.read("symbols").join(lost, "file_path", "left_semi").select("id")
        chunks = self.read("chunks").join(lost, "file_path", "left_semi").select(F.col("chunk_id").alias("id"))
        keys = {name: [("file_path", lost)] for name in ("symbols", "imports", "chunks")}
        return keys | {"files": [("path", gone)], "relationships": [("from_id", ids.select(F.col("id").alias("from_id"))), ("to_id", ids.select(F.col("id").alias("to_id")))], "vectors": [("id", chunks)]}

    def delete_files(self, gone: DataFrame) -> None:
        """All that belongs to the files ``gone`` (path), from all tables, in one commit."""
        self.change({}, self._owned_keys(gone))

    def by_ids(self, name: str, ids: DataFrame, column: str) -> DataFrame:
        """Rows whose ``column`` is in ``ids`` (same column): chunks and vectors by id."""
        return self.read(name).join(ids.select(column).distinct(), column, "left_semi")

    def sign_index(self, dims: int) -> DataFrame:
        """(id, words): vectors as sign bits, made from the vectors when asked for."""
        return self.read("vectors").select("id", M.sign_words(F.col("embedding"), dims).alias("words"))

    # -- refreshing -----------------------------------------------------------------------------------------------

    def refresh(self, files: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], known: DataFrame | None = None) -> DataFrame:
        """Brings the index to the state of ``files`` (path, mtime, content_hash, ...): (path, state), new, modified, deleted or same.

        What new and modified files hold is made by ``make``, which gets their rows and gives tables; what deleted and modified ones held goes. One commit, which
        writes what changed; the states are a table beside it, replaced by the next refresh. ``known`` are the files of the index that count, all of them without it.
        """
        old = self.read("files") if known is None else known
        diff = incremental.file_diff(files.select("path", "mtime", F.col("content_hash").alias("hash")), old.select("path", "mtime", F.col("content_hash").alias("hash")))
        # Written once: what follows, and the caller, read it after the index has moved on.
        states = self._write(diff, "states", 0)
        diff = self.spark.read.schema("path string, state string").parquet(f"{self.path}/{states['folder']}")
        fresh = files.join(diff.where("state in ('new', 'modified')").select("path"), "path", "left_semi")
        gone = diff.where("state in ('deleted', 'modified')").select("path")
        made = make(fresh)
        before = self.metadata().get("facts", {}).get("states")
        self.change(made, {} if gone.isEmpty() else self._owned_keys(gone), {"states": states["folder"]})
        if before:
            self.manifests.remove(before)
        for name in made:
            self.compact(name)
        return diff

    def refresh_one(self, files: DataFrame, path: str, make: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
        """refresh() of a single file, whether it is new, changed or gone; nothing of the others is read for it or written."""
        self.refresh(files.where(F.col("path") == path), make, self.read("files").where(F.col("path") == path))

    def sync_roots(self, roots: DataFrame) -> DataFrame:
        """(root, state): takes ``roots`` (root) as the configured ones; files below removed ones go, added ones are for the caller to scan."""
        old = self.spark.createDataFrame([(r,) for r in self.metadata().get("facts", {}).get("roots", [])], "root string")
        diff = incremental.config_diff(old, roots)
        kept = [r["root"] for r in roots.distinct().orderBy("root").collect()]  # configured folders: a few
        files = self.read("files")
        gone = files.select("path").join(incremental.below_roots(files, roots).select("path"), "path", "left_anti")
        states = self.spark.createDataFrame([tuple(r) for r in diff.collect()], "root string, state string")  # configured folders: a few
        self.change({}, self._owned_keys(gone), {"roots": kept})
        return states

"""Changes of files below a folder as a stream: a Python data source that compares listings.

    spark.dataSource.register(FileEvents)
    spark.readStream.format("file_events").option("path", "file:/repo").option("state", "file:/shared/listings").load()

Each trigger lists the folder. A listing that differs from the last one is written below ``state`` in PARTS files by a hash of the path, and the stream's offset is
the listing's number, so an offset stays a few bytes however many files there are. A batch compares two listings part by part, in as many tasks: files that are new
(create), have another time or size (modify), or are gone (delete). A restart from a checkpoint compares with the listing of the last
committed batch, so each change comes once. Listings before that are removed. ``state`` must be a folder that driver and executors share.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PARTS = 8
SCHEMA = "path string, action string, mtime long, size long"
_NAMES = ["path", "action", "mtime", "size"]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def listing(uri: str, suffixes: tuple[str, ...]) -> dict[str, list[int]]:
    """(time in milliseconds, size) of each file below ``uri`` by its path from there; hidden files and folders are left out."""
    fs, root = _open(uri)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        rel = info.path[len(root) :].lstrip("/")
        if info.is_file and not any(part.startswith(".") for part in rel.split("/")) and (not suffixes or rel.endswith(suffixes)):
            out[rel] = [(info.mtime_ns or 0) // 1_000_000, info.size]
    return out


class Part(InputPartition):
    def __init__(self, before: int, after: int, number: int):
        self.before, self.after, self.number = before, after, number


class _Listings:
    """Numbered listings below ``state``; number 0 is the empty one."""

    def __init__(self, state: str):
        self.fs, self.root = _open(state)
        self.fs.create_dir(self.root, recursive=True)

    def numbers(self) -> list[int]:
        found = [i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.root)) if i.base_name.endswith(".done")]
        return sorted(int(x.removesuffix(".done")) for x in found)

    def part(self, number: int, part: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        with self.fs.open_input_stream(f"{self.root}/{number}-{part}.json") as f:
            return json.loads(f.read())

    def write(self, number: int, rows: dict[str, list[int]]) -> None:
        parts: list[dict] = [{} for _ in range(PARTS)]
        for path, facts in rows.items():
            parts[zlib.crc32(path.encode()) % PARTS][path] = facts
        for k, own in enumerate(parts):
            self._put(f"{number}-{k}.json", json.dumps(own))
        self._put(f"{number}.done", "")  # a listing without this mark was cut short and does not count

    def _put(self, name: str, text: str) -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(text.encode())

    def remove(self, number: int) -> None:
        for name in [f"{number}.done", *(f"{number}-{k}.json" for k in range(PARTS))]:
            self.fs.delete_file(f"{self.root}/{name}")


def _changes(before: dict[str, list[int]], after: dict[str, list[int]]) -> pa.RecordBatch:
    rows = [(p, "create" if p not in before else "modify", *facts) for p, facts in sorted(after.items()) if before.get(p) != facts]
    rows += [(p, "delete", *facts) for p, facts in sorted(before.items()) if p not in after]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], _NAMES)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, state: str, suffixes: tuple[str, ...]):
        self.path, self.state, self.suffixes = path, state, suffixes

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        own, now = _Listings(self.state), listing(self.path, self.suffixes)
        last = max(own.numbers(), default=0)
        known: dict[str, list[int]] = {}
        for k in range(PARTS):
            known |= own.part(last, k)
        if now != known:
            last += 1
            own.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["listing"], end["listing"], k) for k in range(PARTS)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        own = _Listings(self.state)
        yield _changes(own.part(partition.before, partition.number), own.part(partition.after, partition.number))

    def commit(self, end: dict) -> None:
        own = _Listings(self.state)
        for number in own.numbers():
            if number < end["listing"]:
                own.remove(number)


class _Batch(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...]):
        self.path, self.suffixes = path, suffixes

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield _changes({}, listing(self.path, self.suffixes))


class FileEvents(DataSource):
    """Options: path, state (streams only), suffixes (comma-separated, all without)."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return SCHEMA

    def _suffixes(self) -> tuple[str, ...]:
        return tuple(x for x in self.options.get("suffixes", "").split(",") if x)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], self._suffixes())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.options["state"], self._suffixes())

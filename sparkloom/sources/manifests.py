"""Numbered manifests of a folder: small JSON files, created under names that did not exist, of which the newest whole one counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifests:
    """Files manifest-<number>.json below ``path``, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str):
        """The file system and the path of ``name`` below the folder."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def text(self, name: str) -> str | None:
        fs, place = self.at(name)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        fs, place = self.at(name)
        fs.delete(place, True)

    def size(self, name: str) -> int:
        fs, place = self.at(name)
        return fs.getContentSummary(place).getLength()

    def numbers(self) -> list[int]:
        """Numbers of the manifests that exist, the newest first."""
        fs, place = self.at("")
        names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
        return sorted((int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")), reverse=True)

    def read(self, number: int) -> dict | None:
        """A manifest, None if it is cut short."""
        try:
            found = json.loads(self.text(f"manifest-{number:012d}.json") or "")
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def newest(self) -> dict | None:
        for number in self.numbers():
            found = self.read(number)
            if found is not None:
                return found
        return None

    def create(self, number: int, body: dict) -> None:
        """Fails if another writer was first."""
        fs, place = self.at(f"manifest-{number:012d}.json")
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()

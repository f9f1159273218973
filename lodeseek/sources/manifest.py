"""Numbered manifests: which files of a stored table are in force.  None is ever overwritten; the newest counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self) -> dict | None:
        fs, folder = self._fs(), self._file("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        name = max((n for n in names if n.isdigit()), key=int, default=None)
        if name is None:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()[0]) | {"number": int(name)}

    def write(self, entry: dict) -> int:
        """The entry becomes the newest: it is written beside the others and appears by a rename."""
        number = (self.newest() or {"number": -1})["number"] + 1
        fs, started = self._fs(), self._file(f"manifest/_{number}")
        out = fs.create(started, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.rename(started, self._file(f"manifest/{number}")):
            raise RuntimeError(f"manifest {number} of {self.path} is there already: two writers at once")
        return number

    def drop(self, name: str) -> None:
        self._fs().delete(self._file(name), True)

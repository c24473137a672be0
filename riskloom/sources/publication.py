"""Publishing by a marker that is created only if absent: of two writers of one version, one gets it."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_TAKEN = ("FileAlreadyExistsException", "already exists")


class Markers:
    """Numbered JSON files below `<path>/_ready`, written elsewhere first and renamed into place.

    The rename refuses to replace a file, which file systems with atomic renames (HDFS, local disks) decide for one
    of two writers. Readers see whole markers only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.staged = spark, f"{path}/_ready", f"{path}/_staged"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, path: str):
        return self._hadoop.Path(path)

    def _files(self, path: str):
        return self._place(path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Published version numbers; names only, no file is read."""
        files, folder = self._files(self.folder), self._place(self.folder)
        if not files.exists(folder):
            return []
        names = (s.getPath().getName() for s in files.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def name(self, version: int) -> str:
        return f"{self.folder}/{version:010d}.json"

    def read(self, version: int) -> dict[str, Any]:
        return json.loads(self.spark.read.text(self.name(version), wholetext=True).first()[0])

    def latest(self) -> dict[str, Any] | None:
        found = self.versions()
        return self.read(found[-1]) if found else None

    def publish(self, marker: dict[str, Any]) -> bool:
        """True if the marker's version is now ours, False if another writer has it already."""
        draft, final = f"{self.staged}/{uuid.uuid4().hex}.json", self.name(marker["version"])
        files = self._files(self.folder)
        files.mkdirs(self._place(self.folder))
        out = files.create(self._place(draft), True)
        try:
            out.write(bytearray(json.dumps(marker).encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(files.getUri(), self._conf)
        rename = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._place(draft), self._place(final), options)
        except Py4JJavaError as error:
            files.delete(self._place(draft), False)
            if any(word in str(error.java_exception) for word in _TAKEN):
                return False
            raise
        return True


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that a publication has replaced."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

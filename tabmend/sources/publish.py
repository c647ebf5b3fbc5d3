"""Publishing the tables of an export together.

All parts are written into a staging folder first.  One empty marker file, named after that folder, then
publishes them: from that moment on readers take the staged parts, and only then are these moved
over the parts of the export before.  A writer that dies before the marker leaves the earlier export as
it was; one that dies after it leaves the new one, and the next writer finishes the moves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

STAGING, MARKER = "_staging-", "_publishing-"


class Folder:
    """An export folder, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _staged(self) -> str | None:
        """The staging folder of a publication that is under way."""
        marks = [n.removeprefix(MARKER) for n in self._names(self.path) if n.startswith(MARKER)]
        return f"{self.path}/{STAGING}{marks[0]}" if marks else None

    def part(self, name: str) -> str:
        """Where a reader finds a part."""
        staged = self._staged()
        if staged and self._fs.exists(self._path(f"{staged}/{name}")):
            return f"{staged}/{name}"
        return f"{self.path}/{name}"

    def stage(self) -> str:
        """A fresh staging folder; a publication left half way is finished before."""
        self.finish()
        return f"{self.path}/{STAGING}{uuid.uuid4().hex}"

    def publish(self, staged: str) -> None:
        """Makes all parts in ``staged`` the ones that readers get, at once."""
        self._fs.create(self._path(f"{self.path}/{MARKER}{staged.rsplit(STAGING, 1)[1]}"), False).close()
        self.finish()

    def finish(self) -> None:
        """Moves published parts into place; safe to repeat, also after a writer died at any step of it."""
        staged = self._staged()
        if staged is None:
            return
        for name in self._names(staged):
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
            if not self._fs.rename(self._path(f"{staged}/{name}"), self._path(f"{self.path}/{name}")):
                raise OSError(f"could not publish {self.path}/{name}")
        self._fs.delete(self._path(staged), True)
        self._fs.delete(self._path(f"{self.path}/{MARKER}{staged.rsplit(STAGING, 1)[1]}"), False)

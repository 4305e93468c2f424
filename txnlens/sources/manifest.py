"""Tables that change all at once: CREATE TABLE AS and additions by a numbered manifest.

The files of a table lie in folders that are written once (``data/<id>``).  A manifest,
``_manifest/<number>``, lists the folders that make up one state of the table; the highest
number is current.  A write stages its folder first and puts the manifest in place last,
by one rename, so that a run that dies in between leaves the table as it was and a reader
never sees half a table.  Two writers cannot commit the same number: the second fails, and
may start again from the new state.

All access goes through Spark's own file system classes, so the base may be on any
storage that Spark reads.  ``vacuum`` removes what no recent manifest lists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sinks import write_table


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the same number meanwhile."""


class ManifestTable:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.base}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # -- reading -----------------------------------------------------------

    def versions(self) -> list[int]:
        """The committed numbers, ascending."""
        folder = self._path("_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def parts(self, version: int | None = None) -> dict[str, str]:
        """Name -> folder of each part of a state, by default the current one."""
        versions = self.versions()
        if not versions:
            return {}
        name = f"_manifest/{versions[-1] if version is None else version:012d}"
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, names=None) -> DataFrame | None:
        """The parts of a state (or those of ``names``) as one table; None where there is none."""
        folders = [f"{self.base}/{f}" for n, f in sorted(self.parts(version).items()) if names is None or n in names]
        return self.spark.read.parquet(*folders) if folders else None

    # -- writing -----------------------------------------------------------

    def stage(self, df: DataFrame, partition_by=None, max_rows_per_file: int | None = None) -> str:
        """Writes ``df`` to a folder of its own, which nobody reads before it is committed."""
        folder = f"data/{uuid.uuid4().hex}"
        write_table(df, f"{self.base}/{folder}", partition_by, max_rows_per_file=max_rows_per_file)
        return folder

    def commit(self, parts: dict[str, str], after: int | None = None) -> int:
        """Makes ``parts`` the table's state; ``after`` is the number it was derived from (default: the current one)."""
        versions = self.versions()
        current = versions[-1] if versions else 0
        if after is not None and after != current:
            raise ConcurrentCommit(f"state {current} is committed, this one was derived from {after}")
        staged, final = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{current + 1:012d}")
        self._fs.mkdirs(self._path("_manifest"))
        out = self._fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        finally:
            out.close()
        # a rename onto a file that is there already must not replace it
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise ConcurrentCommit(f"state {current + 1} is committed already")
        return current + 1

    def replace(self, df: DataFrame, **kw) -> int:
        """CREATE OR REPLACE TABLE AS SELECT."""
        return self.commit({"all": self.stage(df, **kw)})

    def put(self, name: str, df: DataFrame, **kw) -> int:
        """Adds the part ``name``, or replaces it: repeating a batch under its name changes nothing."""
        versions = self.versions()
        return self.commit(self.parts() | {name: self.stage(df, **kw)}, after=versions[-1] if versions else 0)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last ``keep``, and folders that none of these list; call it while no write runs."""
        versions = self.versions()
        wanted = {f for v in versions[-keep:] for f in self.parts(v).values()}
        gone = []
        if self._fs.exists(self._path("data")):
            for status in self._fs.listStatus(self._path("data")):
                folder = f"data/{status.getPath().getName()}"
                if folder not in wanted:
                    self._fs.delete(status.getPath(), True)
                    gone.append(folder)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"_manifest/{v:012d}"), False)
        return gone

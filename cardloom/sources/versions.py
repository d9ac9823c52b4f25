"""Versions of a group of tables in one folder: a commit shows all of its tables at once, or none, and finds out conflicts.

Each table is a list of Parquet folders. A version is one small JSON file, `_version_00000007.json`, that names the folders of
every table and what else belongs to the version. Writers put their data into folders of their own, then create the file
of the version after the one they started from; creating fails where it is there already, which is the compare-and-swap: of two writers that
started from one version the second gets Conflict and can begin again from the new one. Readers take the newest complete
version and never see half of a commit, and a version that was read stays readable until vacuum() drops it.

A version file that can't be parsed is one that is being written: readers go by the version before, writers wait for it or,
after GRACE seconds, take it over as left behind by a writer that died.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

GRACE = 600.0


class Conflict(RuntimeError):
    """Another writer has committed since."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, grace: float = GRACE):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_version_{version:08d}.json")

    def _listed(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at)]
        return sorted(int(n[9:17]) for n in names if n.startswith("_version_") and n.endswith(".json"))

    def at(self, version: int) -> dict | None:
        """What a version says; None while it is being written."""
        path = self._file(version)
        size = self._fs.getFileStatus(path).getLen()
        source = self._fs.open(path)
        try:
            raw = bytes(source.readNBytes(size))
        finally:
            source.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict]:
        """The newest complete version and what it says; 0 and nothing before the first."""
        for v in reversed(self._listed()):
            if (said := self.at(v)) is not None:
                return v, said
        return 0, {"tables": {}}

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest one if none is given)."""
        said = self.latest()[1] if version is None else self.at(version) if version else {"tables": {}}
        return self.folders(said["tables"].get(table, []), schema)

    def folders(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def write(self, df: DataFrame, label: str, by: list[str] | None = None) -> str:
        """Data of a version to come, in a folder of its own; no reader sees it before a commit names it."""
        name = f"{label}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{name}")
        return name

    def commit(self, base: int, said: dict) -> int:
        """Publish `said` as the version after base; Conflict if that is there already."""
        listed = self._listed()
        if listed and listed[-1] > base:
            newest = listed[-1]
            left = self.at(newest) is None and time.time() * 1000 - self._fs.getFileStatus(self._file(newest)).getModificationTime() > self.grace * 1000
            if not (left and newest == base + 1):
                raise Conflict(f"{self.path} is at version {newest}, the writer started from {base}")
            self._fs.delete(self._file(newest), False)
        try:
            out = self._fs.create(self._file(base + 1), False)
        except Exception as e:  # the file is there: another writer was faster
            if self._fs.exists(self._file(base + 1)):
                raise Conflict(f"{self.path} has a version {base + 1} by another writer") from e
            raise
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return base + 1

    def commit_tables(self, base: int, tables: dict[str, DataFrame], **more) -> int:
        """Replace whole tables in one step; those not named stay as they are in base."""
        said = (self.at(base) if base else None) or {"tables": {}}
        listed = self._listed()
        if listed and listed[-1] > base and self.at(listed[-1]) is not None:
            raise Conflict(f"{self.path} is at version {listed[-1]}, the writer started from {base}")  # before the data are written
        new = {name: [self.write(df, name)] for name, df in tables.items()}
        return self.commit(base, said | more | {"tables": said["tables"] | new})

    def rebased(self, change: Callable[[int, dict], int], tries: int = 5) -> int:
        """change(version, said) makes and commits a change; after a conflict again from the newest version."""
        for _ in range(tries - 1):
            try:
                return change(*self.latest())
            except Conflict:
                continue
        return change(*self.latest())

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions before the newest `keep`, and the folders that only they name; folders that no version names yet belong to writers and stay."""
        listed = [v for v in self._listed() if self.at(v) is not None]
        old, kept = listed[:-keep], listed[-keep:]
        names = lambda vs: {n for v in vs for fs in self.at(v)["tables"].values() for n in fs}
        gone = names(old) - names(kept)
        for v in old:
            self._fs.delete(self._file(v), False)
        for n in gone:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        return len(gone)


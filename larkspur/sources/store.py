"""A database in a folder, saved whole or not at all.

Tables are written to new folders; one small manifest, put in its place by a rename that doesn't overwrite, makes them the next version. Readers open the manifest of the highest version, so a save that stops midway
leaves the old state, and of two saves from one version the second fails. The rename is atomic on HDFS and on local disks; an object store needs a connector that keeps to that.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .catalog import Database


class SaveConflict(RuntimeError):
    """Another save has made the next version."""


@dataclass(frozen=True)
class Saved:
    """A version: the database, and the last batch of each job that is in it."""

    version: int
    database: Database
    batches: MappingProxyType
    paths: MappingProxyType = field(repr=False)


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"versions/v{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def load(self, version: int | None = None) -> Saved:
        """The last version, or a given one. Nothing saved yet is version 0: an empty database."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Saved(0, Database(self.spark), MappingProxyType({}), MappingProxyType({}))
        held = self._manifest(version)
        tables = {n: self.spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(f"{self.folder}/{t['path']}") for n, t in held["tables"].items()}
        return Saved(version, Database(self.spark, MappingProxyType(tables)), MappingProxyType(held["batches"]), MappingProxyType({n: t["path"] for n, t in held["tables"].items()}))

    def save(self, after: Database, before: Saved, **batches: int) -> Saved:
        """Makes `after` the version that follows `before`; SaveConflict if there is one already. Tables that are still those of `before` aren't written again. batches: the last batch of jobs."""
        staged = {}
        for name, df in after.tables.items():
            if name in before.paths and before.database.tables.get(name) is df:
                staged[name] = before.paths[name]
            else:
                staged[name] = f"data/{name}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.folder}/{staged[name]}")
        version = before.version + 1
        manifest = {"version": version, "tables": {n: {"path": p, "schema": after.tables[n].schema.jsonValue()} for n, p in staged.items()}, "batches": {**before.batches, **batches}}
        self._publish(version, json.dumps(manifest))
        return self.load(version)

    def _publish(self, version: int, text: str) -> None:
        fs, made = self._fs(), self._path(f"staged/{uuid.uuid4().hex}.json")
        out = fs.create(made)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(self._path("versions"))
        target = self._path(f"versions/v{version:012d}.json")
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(made, target, none)
        except Exception as e:  # py4j and Spark wrap what Java throws
            if isinstance(e, PySparkException) or "FileAlreadyExists" in str(e):
                raise SaveConflict(f"version {version} of {self.folder} exists already") from e
            raise

    def vacuum(self, keep: int = 2, older_than: float = 7 * 86_400) -> list[str]:
        """Deletes the versions before the last `keep`, and table folders that no kept version names and that are older than so many seconds (younger ones may belong to a save that is under way). Gives what went."""
        kept = self.versions()[-keep:]
        named = {t["path"] for v in kept for t in self._manifest(v)["tables"].values()}
        fs, gone = self._fs(), []
        for v in self.versions():
            if v not in kept:
                fs.delete(self._path(f"versions/v{v:012d}.json"), False)
        for name in self._names("data"):
            path = self._path(f"data/{name}")
            if f"data/{name}" not in named and fs.getFileStatus(path).getModificationTime() < 1000 * (time.time() - older_than):
                fs.delete(path, True)
                gone.append(name)
        return gone

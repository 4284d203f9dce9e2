"""Asset registries in versions: a change is published whole or not at all, and two writers can't lose each other's.

A version is a folder of Parquet files and a manifest, a small file named after the version's number that holds the folder's name. A writer says
which version it read. The manifest of the next one is renamed into its place, which fails if another writer was first; then `Conflict` is
raised, and `change` reads the new version and tries again. Readers see the last manifest; folders are never changed, so that a query that is
planned on a version goes on with it.

Defined results: a store without a manifest is an empty registry of version 0; a folder without a manifest (a writer died) is never read; versions stay until
`forget` drops those before a given one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.assets import FIELDS, SCHEMA


class Conflict(RuntimeError):
    """Another writer published the version first."""


class RegistryStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("manifests").getFileSystem(self.conf)

    def versions(self) -> list[int]:
        fs, top = self._fs(), self._at("manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(top) if x.getPath().getName().isdigit()) if fs.exists(top) else []

    def version(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The registry as of a version, the last one without it."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        held = json.loads(self.spark.read.text(f"{self.path}/manifests/{version:020d}", wholetext=True).first().value)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{held['folder']}")

    def publish(self, registry: DataFrame, expected: int) -> int:
        """Makes the registry the version after `expected`; its number. Raises Conflict if that isn't the last any more."""
        if self.version() != expected:
            raise Conflict(f"version {self.version()} is there, {expected} was expected")
        name = f"data-{uuid.uuid4().hex}"
        registry.select(*FIELDS).write.parquet(f"{self.path}/{name}")
        fs, draft, to = self._fs(), self._at(f"manifests/.{name}"), self._at(f"manifests/{expected + 1:020d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"folder": name, "version": expected + 1}).encode()))
        out.close()
        never_over = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self.conf).rename(draft, to, never_over)
        except Exception as e:
            fs.delete(draft, False)
            fs.delete(self._at(name), True)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {expected + 1} was published meanwhile") from e
            raise
        return expected + 1

    def change(self, make: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Publishes make(last version), again on the new one if another writer was first."""
        for left in reversed(range(tries)):
            expected = self.version()
            try:
                return self.publish(make(self.read(expected)), expected)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def forget(self, before: int) -> None:
        """Drops versions before a given one, never the last; no reader may be on them any more."""
        fs, last = self._fs(), self.version()
        for v in self.versions():
            if v < min(before, last):
                manifest = f"manifests/{v:020d}"
                folder = json.loads(self.spark.read.text(f"{self.path}/{manifest}", wholetext=True).first().value)["folder"]
                fs.delete(self._at(manifest), False)
                fs.delete(self._at(folder), True)

    def history(self) -> DataFrame:
        """(version, assets) of all versions."""
        rows = [self.read(v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("assets")) for v in self.versions()]
        out = self.spark.createDataFrame([], "version long, assets long")
        for r in rows:
            out = out.union(r)
        return out

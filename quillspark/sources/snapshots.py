"""Stored keyed tables: Parquet in hash buckets, under manifests of which each is one version.

A write touches only the buckets of the keys it changes: it reads those, merges, writes them anew beside the old files and
commits with one rename, which fails if another writer has made that version. Until then, and after a write that failed,
readers see the version before; those of an old version go on with its files until expire() drops them. All paths go
through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import tables

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since this one began: read again and retry."""


class Snapshots:
    """A keyed table below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # Files.
    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.conf)

    def _names(self, *below: str) -> list[str]:
        at = self._at(*below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, version: int | None = None) -> dict:
        """What a version, or the last one, consists of: keys, number of buckets, schema, folders by bucket, marks."""
        version = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._at("manifests", f"{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        version = manifest["version"]
        draft, final = self._at("manifests", f"_{uuid.uuid4().hex}.draft"), self._at("manifests", f"{version:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, final, options)
        except Exception as failed:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} of {self.path} is there already") from failed
            raise
        return version

    # Rows.
    @staticmethod
    def _bucket(manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*manifest["keys"]), F.lit(manifest["buckets"]))

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(manifest["schema"])

    def _store(self, rows: DataFrame, manifest: dict) -> dict[str, str]:
        """Write rows by bucket, a large bucket as several files; the folders by bucket."""
        name = f"{manifest['version']:012d}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self._bucket(manifest)).hint("rebalance", "__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self._names("data", name) if n.startswith("__bucket=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> int:
        """Store the first version; rows share no key. Fails if the table is there."""
        schema = StructType.fromJson(json.loads(rows.schema.json()))
        for f in schema.fields:
            f.nullable = True
        manifest = {"version": 0, "keys": keys, "buckets": buckets, "schema": json.loads(schema.json()), "marks": {}}
        if self.versions():
            raise Conflict(f"{self.path} is there already")
        return self._commit(manifest | {"folders": self._store(rows, manifest)})

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The rows of a version, or of the last one; of some buckets only, if given."""
        manifest = self.manifest(version)
        folders = [f"{self.path}/data/{f}" for b, f in sorted(manifest["folders"].items()) if buckets is None or b in buckets]
        schema = self._schema(manifest)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rewrite(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], marks: dict | None = None, partial: bool = False) -> int:
        """Commit ``merge(rows, changes)`` for the buckets that ``changes`` touches, rows being theirs now; the version.

        merge must keep keys in their buckets, as all that works by key does. ``changes`` has the table's columns, in any
        order, or if ``partial`` some of them, keys included; it is read twice. ``marks`` are named values that the
        version carries on from the one before. Without changes or marks there is no new version.
        """
        manifest = self.manifest()
        schema = self._schema(manifest)
        names = [f.name for f in schema.fields if not partial or f.name in changes.columns]
        changes = changes.select(*[F.col(n).cast(schema[n].dataType).alias(n) for n in names])
        touched = [str(r[0]) for r in changes.select(self._bucket(manifest)).distinct().collect()]  # a row for each bucket
        if not touched and not marks:
            return manifest["version"]
        new = manifest | {"version": manifest["version"] + 1, "marks": manifest["marks"] | (marks or {})}
        if touched:
            merged = merge(self.read(manifest["version"], touched), changes).select(*[f.name for f in schema.fields])
            new["folders"] = {b: f for b, f in manifest["folders"].items() if b not in touched} | self._store(merged, new)
        return self._commit(new)

    def upsert(self, changes: DataFrame, version: str, keep_first: tuple[str, ...] = (), marks: dict | None = None) -> int:
        """Store what tables.upsert() gives. ``keep_first`` takes it that versions come in order from write to write: of a
        key's rows only the last and those values are stored."""
        keys = self.manifest()["keys"]
        return self.rewrite(changes, lambda old, new: tables.upsert(old, new, keys, version, keep_first), marks)

    def insert_if_absent(self, changes: DataFrame, position: str, marks: dict | None = None) -> int:
        """Store the rows whose key the table lacks, the first by ``position`` of each."""
        keys = self.manifest()["keys"]
        return self.rewrite(changes, lambda old, new: old.unionByName(tables.insert_if_absent(old, new, keys, position)), marks)

    def replace(self, changes: DataFrame, marks: dict | None = None) -> int:
        """Store what tables.replace() gives: whole rows, columns that ``changes`` lacks being null."""
        keys = self.manifest()["keys"]
        return self.rewrite(changes, lambda old, new: tables.replace(old, new, keys), marks, partial=True)

    def delete(self, doomed: DataFrame, marks: dict | None = None) -> int:
        """Store the table without the keys of ``doomed``; null keys are keys like any other."""
        keys = self.manifest()["keys"]

        def without(old: DataFrame, new: DataFrame) -> DataFrame:
            gone = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
            test = F.lit(True)
            for k in keys:
                test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
            return old.join(gone, test, "left_anti")

        return self.rewrite(doomed.select(*keys), without, marks, partial=True)

    def expire(self, keep: int = 1) -> None:
        """Drop all but the last ``keep`` versions, and the files that none of those has - leavings of failed writes too, so
        nothing may be writing."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - max(1, keep))]:
            self._fs.delete(self._at("manifests", f"{v:012d}.json"), False)
        used = {f for v in self.versions() for f in self.manifest(v)["folders"].values()}
        for name in self._names("data"):
            mine = {f.split("/")[1] for f in used if f.split("/")[0] == name}
            for bucket in self._names("data", name) if mine else [""]:
                if bucket.startswith("__bucket=") and bucket not in mine or not bucket:
                    self._fs.delete(self._at("data", name, *([bucket] if bucket else [])), True)

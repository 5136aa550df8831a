"""A table in immutable versions: data first, then a manifest by rename, then a ledger row.

Data files are never changed. A version is a manifest: which folder holds each part of the table, and the batch that made
it. It is written aside and renamed to its number, so readers see the version before it or the whole new one. A batch that
is already in a manifest is not written again; its ledger row is added if it is missing. So a run that ends at any place
can be repeated: one version and one ledger row for each batch. There is one writer at a time, as with a streaming query.

Only parts (dates, by default the whole table) that a batch touches are read and rewritten. Paths may be in any store
that Spark's file systems reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.upsert import keep_last, upsert


class VersionedTable:
    """``root`` holds ``_versions``, ``_ledger`` and a data folder for each version."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], part: Column | None = None):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        part = part if part is not None else F.lit("all")
        self.part = F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("null"))  # a null and an empty value are two parts

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str) -> dict:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """A small file, whole or not at all."""
        path, fs = self._path(name)
        aside, _ = self._path(f"_aside/{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        fs.mkdirs(path.getParent())
        if not fs.rename(aside, path):
            raise RuntimeError(f"{path} is there already: another writer is at work")

    def manifest(self) -> dict | None:
        """The newest version, or None."""
        names = self._names("_versions")
        return self._read(f"_versions/{names[-1]}") if names else None

    def versions(self) -> list[dict]:
        return [self._read(f"_versions/{n}") for n in self._names("_versions")]

    def read(self, manifest: dict | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """The table at a version (the newest by default), or some parts of it; None before the first version."""
        manifest = manifest or self.manifest()
        if manifest is None:
            return None
        folders = [f for p, f in sorted(manifest["parts"].items()) if parts is None or p in parts]
        schema = StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def ledger(self) -> list[dict]:
        return [self._read(f"_ledger/{n}") for n in self._names("_ledger")]

    def merge(self, batch: DataFrame, batch_id: int | str) -> dict:
        """Upsert a batch as one new version, with one ledger row; again with the same ``batch_id`` changes nothing."""
        done = next((m for m in reversed(self.versions()) if m["batch"] == batch_id), None)
        if done is None:
            done = self._write(batch, batch_id)
        self._settle(done)
        return done

    def replace(self, rows: DataFrame, batch_id: int | str, **facts) -> dict:
        """A version that holds these rows alone; ``facts`` (when they were written, say) are kept with it."""
        done = next((m for m in reversed(self.versions()) if m["batch"] == batch_id), None) or self._write(rows, batch_id, whole=True, facts=facts)
        self._settle(done)
        return done

    def _write(self, batch: DataFrame, batch_id: int | str, whole: bool = False, facts: dict | None = None) -> dict:
        now = self.manifest() or {"version": -1, "parts": {}}
        if whole:
            now = now | {"parts": {}}
        batch = batch.withColumn("_part", self.part)
        batch.persist()
        try:
            touched = [r[0] for r in batch.select("_part").distinct().collect()]  # names of parts, not rows
            folder = f"data/{now['version'] + 1:08d}-{uuid.uuid4().hex}"
            self._rewrite(now, touched, batch, f"{self.root}/{folder}")
            rows = batch.count()
        finally:
            batch.unpersist()
        # a value with odd characters is written as Spark escapes it, so folders are taken as they are
        made = {self._unescaped(n.removeprefix("_part=")): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_part=")}
        schema = batch.drop("_part").schema
        manifest = {"version": now["version"] + 1, "batch": batch_id, "rows": rows, "parts": now["parts"] | made, "schema": json.loads(schema.json())} | (facts or {})
        self._put(f"_versions/{manifest['version']:08d}.json", manifest)
        return manifest

    def _rewrite(self, now: dict, touched: list[str], batch: DataFrame, path: str) -> None:
        """The touched parts with the batch over them, in a new folder."""
        old = self.read(now, touched) if now["parts"] else None
        old = old.withColumn("_part", self.part) if old is not None else batch.limit(0)
        merged = upsert(old, batch, self.keys, self.order)
        merged.write.partitionBy("_part").option("compression", "zstd").parquet(path)

    def _unescaped(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)

    def _settle(self, manifest: dict) -> None:
        """The ledger row of a version, if it is not there."""
        name = f"{manifest['version']:08d}.json"
        if name not in self._names("_ledger"):
            self._put(f"_ledger/{name}", {k: manifest[k] for k in ("batch", "version", "rows")})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the newest ``keep`` versions refers to, with the manifests of older versions; returns their names."""
        names = self._names("_versions")
        held = [self._read(f"_versions/{n}") for n in names[-keep:]]
        wanted = {f.split("/")[1] for m in held for f in m["parts"].values()}
        gone = [f"data/{n}" for n in self._names("data") if n not in wanted] + [f"_versions/{n}" for n in names[:-keep]]
        for name in gone:
            path, fs = self._path(name)
            fs.delete(path, True)
        return gone


class BucketedTable(VersionedTable):
    """A versioned table whose parts are the buckets of its keys, as Spark hashes them.

    A batch rewrites only the buckets that its keys fall into, and only the batch is shuffled: Spark knows the history's buckets,
    so the rows that stay are found by a join without an exchange on the history's side, and are written by the tasks that read them.
    Keys are never null, and every batch has the columns of the first one; both are checked. A bucket has two files at most for each
    version, as many rows as the keys that hash to it, whatever their dates: ``buckets`` is chosen by the table's size and kept.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], buckets: int):
        super().__init__(spark, root, keys, order, F.pmod(F.hash(*keys), F.lit(buckets)))
        self.buckets = buckets

    @contextmanager
    def bucketed(self, manifest: dict | None = None, parts: list[str] | None = None) -> Iterator[DataFrame]:
        """The table, or some parts of it, with its buckets known to Spark: joins and groupings by its keys do not shuffle it. For use within the block."""
        manifest = manifest or self.manifest()
        name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in self.keys)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(manifest["schema"]))
        self.spark.sql(f"CREATE TABLE {name} ({columns}, _part string) USING parquet PARTITIONED BY (_part) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/_none'")
        try:
            wanted = [f"PARTITION (_part = '{p}') LOCATION '{self.root}/{f}'" for p, f in sorted(manifest["parts"].items()) if parts is None or p in parts]
            if wanted:
                self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(wanted)}")
            yield self.spark.table(name).drop("_part")
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files are not the table's own: they stay

    def _write(self, batch: DataFrame, batch_id: int | str, whole: bool = False, facts: dict | None = None) -> dict:
        now = self.manifest()
        if now is not None and not whole:
            schema = StructType.fromJson(now["schema"])
            if sorted(batch.columns) != sorted(schema.names):
                raise ValueError(f"columns {batch.columns}, not {schema.names}")
            batch = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))  # a key of another type would hash to another bucket
        return super()._write(batch, batch_id, whole, facts)

    def _rewrite(self, now: dict, touched: list[str], batch: DataFrame, path: str) -> None:
        for k in self.keys:
            if not batch.where(F.col(k).isNull()).isEmpty():
                raise ValueError(f"a null {k}")
        new = keep_last(batch.repartition(self.buckets, *self.keys), self.keys, self.order)
        if not now["parts"]:
            self._save(new, path)
            return
        with self.bucketed(now, touched) as old:
            stays = old.join(new.select(*self.keys), self.keys, "left_anti").withColumn("_part", self.part)
            self._save(stays.unionByName(new), path)

    def _save(self, rows: DataFrame, path: str) -> None:
        name = f"bucketed_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("path", path).option("compression", "zstd")
        writer.partitionBy("_part").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

"""Versioned tables that a stream updates bucket by bucket.

A table is cut into ``buckets`` by a hash of its key. A version is one manifest:
for each bucket that has rows, the folder that holds them and the oldest value
of an optional time column. An update rewrites the buckets it touches under its
own version and points the new manifest at them; all other buckets keep their
folders. Writing the manifest is the commit: a version without one is not there,
and a repeated micro-batch overwrites its own folders and its own manifest.

:meth:`Snapshots.expire` removes what neither the newest version nor the one
before it (from which a repeated micro-batch starts again) refers to, so the
number of versions on disk does not grow with the life of the stream.

Paths are read and written by Spark and removed through Hadoop's file system, so
any store that Spark can reach will do. The driver sees one row per bucket.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "bucket int, folder string, oldest timestamp"


class Snapshots:
    """Versions of one table under ``path``; ``key`` names its key columns, ``time`` the column whose oldest value per
    bucket the manifest keeps."""

    def __init__(self, path: str, schema: T.StructType, key: Iterable[str], buckets: int = 256, time: str | None = None):
        if not 1 <= buckets <= 1 << 16:
            raise ValueError("buckets must be between 1 and 65536")
        self.path, self.schema, self.key = path.rstrip("/"), schema, list(key)
        self.buckets, self.time = buckets, time

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys in ``rows`` (at most ``buckets`` numbers)."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # -------------------------------------------------------------- reading

    def _version(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/v={version:08d}"

    def manifest(self, spark: SparkSession, version: int) -> dict[int, tuple[str, dt.datetime | None]]:
        rows = spark.read.schema(_MANIFEST).parquet(self._version("manifest", version)).collect()
        return {r.bucket: (r.folder, r.oldest) for r in rows}

    def versions(self, spark: SparkSession) -> list[int]:
        """Versions with a manifest, in order."""
        return sorted(int(n[2:]) for n in _names(spark, f"{self.path}/manifest") if n.startswith("v=")
                      and _exists(spark, f"{self.path}/manifest/{n}/_SUCCESS"))

    def read(self, spark: SparkSession, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (the newest unless given), all or those of some buckets."""
        if version is None:
            known = self.versions(spark)
            if not known:
                return spark.createDataFrame([], self.schema)
            version = known[-1]
        held = self.manifest(spark, version)
        folders = [held[b][0] for b in sorted(held if buckets is None else set(buckets) & held.keys())]
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    # -------------------------------------------------------------- writing

    def start(self, spark: SparkSession, rows: DataFrame | None) -> None:
        """Write version 0 from ``rows`` (none: an empty table)."""
        self._write(spark, 0, {}, [], spark.createDataFrame([], self.schema) if rows is None else rows)

    def update(self, spark: SparkSession, base: int, touched: Iterable[int], merge: Callable[[DataFrame], DataFrame],
               older_than: dt.datetime | None = None) -> list[int]:
        """Write version ``base + 1``: the rows of the touched buckets become ``merge`` of them. With ``older_than``
        buckets that hold an older value of the time column are touched as well. Returns the rewritten buckets."""
        held = self.manifest(spark, base)
        mine = set(touched)
        if older_than is not None:
            mine |= {b for b, (_, oldest) in held.items() if oldest is not None and oldest < older_than}
        if mine:
            self._write(spark, base + 1, held, mine, merge(self.read(spark, base, mine)))
        else:
            self._commit(spark, base + 1, held)
        return sorted(mine)

    def _write(self, spark: SparkSession, version: int, held: dict, touched: Iterable[int], rows: DataFrame) -> None:
        out = self._version("data", version)
        keyed = rows.select(*[f.name for f in self.schema.fields]).withColumn("_bucket", self.bucket())
        keyed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(out)
        oldest = F.min(self.time) if self.time else F.lit(None).cast("timestamp")
        kinds = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        written = spark.read.schema(kinds).parquet(out).groupBy("_bucket").agg(oldest.alias("oldest")).collect()
        new = {b: v for b, v in held.items() if b not in set(touched)}
        new |= {r["_bucket"]: (f"v={version:08d}/_bucket={r['_bucket']}", r.oldest) for r in written}
        self._commit(spark, version, new)

    def _commit(self, spark: SparkSession, version: int, buckets: dict) -> None:
        rows = [(b, folder, oldest) for b, (folder, oldest) in sorted(buckets.items())]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._version("manifest", version))

    def expire(self, spark: SparkSession, newest: int) -> int:
        """Remove manifests before ``newest - 1`` and the folders that neither of the last two versions refers to;
        returns the number of folders removed."""
        keep = {newest, newest - 1}
        live = {folder for v in keep if v in self.versions(spark) for folder, _ in self.manifest(spark, v).values()}
        gone = 0
        for n in _names(spark, f"{self.path}/manifest"):
            if n.startswith("v=") and int(n[2:]) < newest - 1:
                _remove(spark, f"{self.path}/manifest/{n}")
        for n in _names(spark, f"{self.path}/data"):
            if not n.startswith("v=") or int(n[2:]) > newest:
                continue
            parts = [f"{n}/{p}" for p in _names(spark, f"{self.path}/data/{n}") if p.startswith("_bucket=")]
            dead = [p for p in parts if p not in live]
            gone += len(dead)
            for p in [n] if len(dead) == len(parts) and int(n[2:]) < newest else dead:
                _remove(spark, f"{self.path}/data/{p}")
        return gone


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)

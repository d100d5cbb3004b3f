"""Tables whose writes commit by a manifest: append, upsert and compaction that a crash cannot leave half done.

Layout of a table::

    data/_batch=<id>/<partition columns>/*.parquet     written once, never changed
    manifests/v=<n>/                                   one row for each live (batch, partition), with its rows

A write first adds a batch of files, then a manifest with the next number.  A manifest counts once it is complete, so readers see the table before or after
a write and nothing between; files that no manifest names are ignored.  Two writers of the same version collide in the second one's manifest, which fails.
Streams commit under a batch number of their own, and a number that is there already changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.operators.quality import keep_last
from barflow.sources.store import dedup_report, write_months

MONTH = "yyyymm"


def _files(spark: SparkSession, path: str) -> list:
    """Names below a folder, by the file system of the path (none if it does not exist)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def _matching(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which null equals null (a partition may have no key)."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, same, how)


class SnapshotTable:
    """A table under ``root`` with month partitions below ``partition`` columns of type string."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, partition: Sequence[str] = ("symbol",)):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), list(partition)
        self.parts = [*self.partition, MONTH]
        self.schema = T.StructType([f for f in schema.fields if f.name != MONTH])
        self.manifest_schema = T.StructType([T.StructField("_batch", T.StringType()), *[T.StructField(p, T.StringType()) for p in self.parts], T.StructField("_rows", T.LongType())])

    # --- reading ---

    def versions(self) -> list[int]:
        """Complete manifests; one is complete when its success mark is there."""
        found = [int(n[2:]) for n in _files(self.spark, f"{self.root}/manifests") if n.startswith("v=")]
        return sorted(v for v in found if "_SUCCESS" in _files(self.spark, self._manifest_path(v)))

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/v={version}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live (batch, partition, rows) of a version, the newest unless one is named; empty before the first write."""
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            return self.spark.createDataFrame([], self.manifest_schema)
        return self.spark.read.schema(self.manifest_schema).parquet(self._manifest_path(version))

    def read(self, version: int | None = None, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Rows of a version.  ``where`` filters the manifest by its partition columns, so that other partitions are not opened."""
        live = self.manifest(version)
        live = where(live) if where is not None else live
        batches = [r["_batch"] for r in live.select("_batch").distinct().collect()]  # writes since the last compaction
        if not batches:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(MONTH, T.StringType())]))
        full = T.StructType([*[f for f in self.schema.fields if f.name not in self.partition], T.StructField("_batch", T.StringType()), *[T.StructField(p, T.StringType()) for p in self.parts]])
        d = self.spark.read.schema(full).parquet(f"{self.root}/data").where(F.col("_batch").isin(batches))
        d = _matching(d, live, ["_batch", *self.parts], "left_semi")
        return d.select(*self.schema.names, MONTH)

    def sizes(self) -> DataFrame:
        """Bytes and files of every live partition, from file metadata; no Parquet file is opened."""
        path = F.col("path")
        named = lambda name: F.regexp_extract(path, f"/{name}=([^/]*)/", 1)
        of = lambda name: F.when(named(name) != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.url_decode(F.replace(named(name), F.lit("+"), F.lit("%2B")))))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
        files = files.select(*[of(c).alias(c) for c in ("_batch", *self.parts)], "length")
        return _matching(files, self.manifest(), ["_batch", *self.parts], "left_semi").groupBy(*self.parts).agg(
            F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")
        )

    # --- writing ---

    def _write(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch of files; returns its manifest rows."""
        batch = batch or uuid.uuid4().hex
        d = rows.select(*self.schema.names).withColumns({MONTH: F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("unknown")), **{p: F.col(p).cast("string") for p in self.partition}})
        path = f"{self.root}/data/_batch={batch}"
        write_months(d, path, self.partition, mode="overwrite")
        if not any(n.startswith(f"{self.parts[0]}=") for n in _files(self.spark, path)):
            return self.spark.createDataFrame([], self.manifest_schema)
        written = self.spark.read.schema(T.StructType([T.StructField("ts", T.TimestampType()), *[T.StructField(p, T.StringType()) for p in self.parts]])).parquet(path)
        return written.groupBy(*self.parts).agg(F.count(F.lit(1)).alias("_rows")).select(F.lit(batch).alias("_batch"), *self.parts, "_rows")

    def _commit(self, manifest: DataFrame, after: int | None) -> int:
        """Publish the next version; fails if another writer has published it."""
        version = 0 if after is None else after + 1
        manifest.select(*self.manifest_schema.names).coalesce(1).write.mode("errorifexists").parquet(self._manifest_path(version))
        return version

    def append(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Add rows.  A ``batch`` that is live already is not written again (returns False)."""
        now = max(self.versions(), default=None)
        before = self.manifest(now)
        if batch is not None and not before.where(F.col("_batch") == batch).isEmpty():
            return False
        self._commit(before.unionByName(self._write(rows, batch)), now)
        return True

    def upsert(self, rows: DataFrame, keys: Sequence[str], arrival: Sequence[str] = ()) -> None:
        """Rows replace those of equal keys; of several new ones the last by ``arrival`` wins.  Only partitions that get rows are rewritten."""
        now = max(self.versions(), default=None)
        before = self.manifest(now)
        d = rows.withColumns({MONTH: F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("unknown")), **{p: F.col(p).cast("string") for p in self.partition}})
        touched = d.select(*self.parts).distinct()
        age = lambda df, n: df.withColumn("_age", F.lit(n))
        current = _matching(self.read(now), touched, self.parts, "left_semi")
        both = age(current, 0).unionByName(age(d, 1), allowMissingColumns=True)
        added = self._write(keep_last(both, keys, ["_age", *arrival]))
        left = _matching(before, touched, self.parts, "left_anti")
        self._commit(left.unionByName(added), now)

    def compact(self, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
        """Partitions as one batch each, without repeated keys (the first by ``arrival`` stays); returns rows before and after.

        The written rows are counted against the report before anything is published.
        """
        now = max(self.versions(), default=None)
        d = self.read(now)
        report = dedup_report(d, keys, self.parts)
        added = self._write(keep_last(d.dropna(subset=list(keys)), keys, arrival, first=True))
        same = F.lit(True)
        for c in self.parts:
            same = same & report[c].eqNullSafe(added[c])
        wrong = report.join(added, same, "left").where(~F.col("rows_after").eqNullSafe(F.coalesce("_rows", F.lit(0))))
        if not wrong.isEmpty():
            raise ValueError("the compacted batch does not hold the expected rows; nothing was published")
        self._commit(added, now)
        return report

    def months(self, first: Column, last: Column) -> Callable[[DataFrame], DataFrame]:
        """A manifest filter for the months of two times."""
        return lambda m: m.where((F.col(MONTH) >= F.date_format(first, "yyyy-MM")) & (F.col(MONTH) <= F.date_format(last, "yyyy-MM")))

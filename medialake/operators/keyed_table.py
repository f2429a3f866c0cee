"""Tables kept in buckets by key, of which an update rewrites only the buckets that it touches.

A bucket is a folder of Parquet files under the version that last wrote it. A manifest row for each bucket and version
says where it is, how many rows it has and the digest of its rows, which does not depend on their order. A version
counts once its manifest rows are written, in one commit; an update that fails before leaves the last version as it was.
Versions are never changed in place, so a reader keeps what it has opened. Superseded folders stay until the folder is
cleaned.

The number of buckets is fixed when a table is made: some thousands at most, as the manifest of one version is held by the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.plans.shared import shared_dir

BUCKETS = 64
_MANIFEST = "bucket int, at int, n long, digest1 decimal(38,0), digest2 decimal(38,0)"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digests(rows: DataFrame, columns: list[str] | tuple[str, ...], key: str, buckets: int) -> DataFrame:
    """(bucket, n, digest1, digest2): sums of two 64-bit hashes of each row's columns, nulls told apart."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"digest{seed}") for seed in (1, 2)]
    return rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count("*").alias("n"), *sums)


@dataclass(frozen=True)
class KeyedTable:
    """One version of a table: where each bucket that has rows lies, and its digest."""

    spark: SparkSession
    root: str
    key: str
    buckets: int
    schema: T.StructType
    version: int
    #: bucket: (version that wrote it, rows, digests)
    held: dict[int, tuple]
    #: Columns that digests cover.
    covered: tuple[str, ...]

    @classmethod
    def create(cls, rows: DataFrame, key: str, buckets: int = BUCKETS, root: str | None = None, covered: tuple[str, ...] | None = None) -> KeyedTable:
        """Write ``rows`` as version 0 of a new table; rows may share a key."""
        spark = rows.sparkSession
        root = root or f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
        table = cls(spark, root, key, buckets, rows.schema, -1, {}, tuple(covered or rows.columns))
        return table._written(rows, [])

    @classmethod
    def open(cls, spark: SparkSession, root: str, key: str, buckets: int, schema: T.StructType, covered: tuple[str, ...] | None = None) -> KeyedTable:
        """The last version that was committed under ``root``."""
        manifest = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{root}/manifest")
        last = manifest.agg(F.max("version")).first()[0]
        rows = manifest.where((F.col("version") == last) & (F.col("bucket") >= 0)).collect()
        return cls(spark, root, key, buckets, schema, last, {r["bucket"]: (r["at"], r["n"], r["digest1"], r["digest2"]) for r in rows}, tuple(covered or schema.names))

    def read(self, only: set[int] | None = None, without: set[int] | None = None) -> DataFrame:
        """The rows, of the buckets ``only`` or of all but ``without``; others are not opened."""
        paths = [f"{self.root}/v{at}/bucket={b}" for b, (at, *_) in sorted(self.held.items()) if (only is None or b in only) and (without is None or b not in without)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def update(self, gone: DataFrame, rows: DataFrame) -> KeyedTable:
        """The next version: without the keys of ``gone`` and of ``rows``, with ``rows``.

        Only buckets that hold one of these keys are read and written.
        """
        keys = gone.select(self.key).unionByName(rows.select(self.key)).distinct()
        touched = {r[0] for r in keys.select(bucket_of(self.key, self.buckets)).distinct().collect()}
        if not touched:
            return self
        kept = self.read(touched).join(keys, self.key, "left_anti").select(*self.schema.names)
        return self._written(kept.unionByName(rows.select(*self.schema.names)), sorted(touched))

    def _written(self, rows: DataFrame, touched: list[int]) -> KeyedTable:
        """Write ``rows``, which replace the buckets ``touched``, then the manifest of all buckets."""
        version = self.version + 1
        path = f"{self.root}/v{version}"
        placed = rows.withColumn("bucket", bucket_of(self.key, self.buckets)).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)  # a version without a manifest is of an update that failed
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
        new = {r["bucket"]: (version, r["n"], r["digest1"], r["digest2"]) for r in digests(written, self.covered, self.key, self.buckets).collect()}
        held = {b: x for b, x in self.held.items() if b not in set(touched)} | new
        entries = [(b, *x) for b, x in held.items()] or [(-1, version, 0, None, None)]
        self.spark.createDataFrame(entries, _MANIFEST).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.root}/manifest")
        return replace(self, version=version, held=held)

    def differing(self, rows: DataFrame) -> set[int]:
        """Buckets whose rows are not those of ``rows``, by count and digest: one pass over ``rows``, without a shuffle of them."""
        new = {r["bucket"]: (r["n"], r["digest1"], r["digest2"]) for r in digests(rows, self.covered, self.key, self.buckets).collect()}
        return {b for b in new.keys() | self.held.keys() if new.get(b) != (self.held[b][1:] if b in self.held else None)}

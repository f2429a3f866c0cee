"""Incremental jobs: an inbox of files, running view counts, and snapshots refreshed by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medialake.operators.diff import apply_diff, detect_moves, diff_snapshot, scan_counts
from medialake.operators.keyed_table import KeyedTable
from medialake.operators.maintained import apply_by_digests

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_ingest(spark: SparkSession, inbox: str, within: str | None = None) -> DataFrame:
    """(path, size_bytes, sha256, modified_at) of files dropped into ``inbox``; repeated bytes are passed over.

    Every hash is kept as state. With ``within`` (such as "7 days") state older than that is dropped and
    bytes repeated later count as new.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(inbox)
    hashed = files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))
    if within:
        return hashed.withWatermark("modified_at", within).dropDuplicatesWithinWatermark(["sha256"])
    return hashed.dropDuplicates(["sha256"])


def stream_view_counts(views: DataFrame) -> DataFrame:
    """Running count and last time of views by content, of a stream or a table."""
    return views.groupBy("sha256").agg(F.count("*").alias("view_count"), F.max("viewed_at").alias("last_viewed_at"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote.

    In append mode its rows are Parquet files. In update mode each batch is a folder of its own, and the last
    batch that has a ``key`` gives its row.
    """
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(path).drop("part")
    others = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, "r.*")


def refresh_loop(listing: DataFrame, read_snapshot: Callable[[], DataFrame], write_snapshot: Callable[[DataFrame, DataFrame], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Apply each batch of a stream of whole listings to the snapshot.

    ``read_snapshot`` gives the last snapshot, ``write_snapshot`` takes the next one and the scan's counts. The
    rows of a batch are one listing. Without ``interval`` all that is there is done once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        found = diff_snapshot(read_snapshot(), batch).persist()
        moves = detect_moves(found)
        write_snapshot(apply_diff(found, moves), scan_counts(found, moves))
        found.unpersist()
        batch.unpersist()

    writer = listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def refresh_maintained(
    listing: DataFrame, open_snapshot: Callable[[], KeyedTable], update_views: Callable[[DataFrame, DataFrame], None], checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Apply each batch of a stream of whole listings to a snapshot in buckets and to the views of it.

    ``update_views`` takes the changed rows (id, path ...) and those that are gone (id, path). Views come first and the snapshot is committed
    last: a batch that is repeated after a failure finds the same changes again, and views delete and insert by
    key, so they end the same. Only buckets whose digests differ are joined and written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        snapshot = open_snapshot()
        upserts, gone = (rows.persist() for rows in apply_by_digests(snapshot, batch))
        update_views(upserts, gone)
        snapshot.update(gone.select("path"), upserts)
        upserts.unpersist()
        gone.unpersist()

    writer = listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

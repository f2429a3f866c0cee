"""Inbox ingest with state of its own: the first file of each content wins, later ones are listed as repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from medialake.streaming.jobs import FILES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVALS = "sha256 string, path string, size_bytes long, modified_at timestamp, repeat boolean"
ORDER = ["modified_at", "path"]


class FirstWins(StatefulProcessor):
    """By hash: when its first file was taken, with a timer that forgets it. Rows of a hash pass in batches; one of them is held."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        state = self.taken.get() if self.taken.exists() else None
        # A timer fires after the rows of its batch; until then its state is void already.
        known = state is not None and (not self.keep_ms or now < state[0])
        first = None
        for arrived in rows:
            if not known:
                arrived = (arrived if first is None else pd.concat([first, arrived])).sort_values(ORDER, na_position="last", kind="stable")
                first, arrived = arrived.iloc[:1], arrived.iloc[1:]
            if len(arrived):
                yield arrived.assign(repeat=True)
        if first is not None:
            until = now + self.keep_ms if self.keep_ms else 0
            if self.keep_ms:
                if state is not None:
                    self.handle.deleteTimer(state[0])
                self.handle.registerTimer(until)
            self.taken.update((until,))
            yield first.assign(repeat=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.taken.exists() and self.taken.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, on disk; settings of ``spark`` stay as they are.

    Batches run for data only: with timers in processing time a run over all that is there would not end otherwise.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    return own


def hashed_inbox(spark: SparkSession, inbox: str, files_a_batch: int | None = None, max_file_age: str = "36500d") -> DataFrame:
    """A stream of (sha256, path, size_bytes, modified_at) of the files in ``inbox``; bytes stay in the task that reads them.

    Files older than the newest seen by ``max_file_age`` would be passed over by the source, so it is a hundred years;
    where inboxes are cleared, less keeps the source's own list of seen paths short.
    """
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFileAge", max_file_age)
    files = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(inbox)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def first_wins(files: DataFrame, keep_seconds: float | None = None) -> DataFrame:
    """Each arrival of the stream ``files`` once: the first of its hash with ``repeat`` false, all others with true.

    Within a micro-batch the earliest ``modified_at`` is first (ties: smaller path; null last), across batches the one
    that came first. With ``keep_seconds`` a hash is forgotten that long after its first file was taken (processing
    time, so no late file is ever dropped), and the next one counts as first again; without it each hash is kept. Rows
    without a hash are passed over. The stream's session must keep its state in RocksDB (``stateful_session``).

    All arrivals of a hash in one micro-batch meet in one task, narrow and in batches of which one row is held.
    """
    keep_ms = None if keep_seconds is None else max(1, int(keep_seconds * 1000))
    mode = "None" if keep_ms is None else "ProcessingTime"
    arrivals = files.where("sha256 is not null").select("sha256", "path", "size_bytes", "modified_at")
    return arrivals.groupBy("sha256").transformWithStateInPandas(FirstWins(keep_ms), ARRIVALS, "Append", mode)


def ingest(spark: SparkSession, inbox: str, path: str, checkpoint: str, keep_seconds: float | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Take in all that is in ``inbox`` and was not seen by ``checkpoint`` yet; the whole list of arrivals under ``path``.

    Parquet in folders by ``repeat``, written exactly once: a run that fails is ended by the next one.
    """
    stream = first_wins(hashed_inbox(stateful_session(spark), inbox, files_a_batch), keep_seconds)
    query = stream.writeStream.format("parquet").partitionBy("repeat").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(ARRIVALS).parquet(path)

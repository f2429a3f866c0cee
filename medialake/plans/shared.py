"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on one
    machine (tests) a temporary folder is made and set; on a cluster an unset name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="medialake-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in folders by the column ``by`` if one is given, and read it back.

    Cuts lineage, survives lost executors, and lets several later jobs read the columns they need. The folder
    goes when the driver ends in order; what a killed driver leaves has names beginning with ``medialake-``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/medialake-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that :func:`stored` returned, when nothing will read them again."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt to all cores where its files make fewer partitions than there are cores.

    For work that costs much more than moving the rows; tables of many files stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

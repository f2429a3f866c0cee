"""Snapshot comparison and incremental maintenance of the item table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.functions.media import classify_media_type, extension
from medialake.operators.numbering import number_rows


def diff_snapshot(previous: DataFrame, current: DataFrame) -> DataFrame:
    """A row for each path of either snapshot: status new, changed, refresh, removed or unchanged.

    A path whose size or time differs has changed; else one whose sidecar time differs, or is null on one
    side only, is to be refreshed.
    """
    old = previous.select(*[F.col(c).alias(f"old_{c}") for c in ("id", "path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256")])
    new = current.select("path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256")
    joined = old.join(new, F.col("old_path") == F.col("path"), "full")
    status = (
        F.when(F.col("old_path").isNull(), "new")
        .when(F.col("path").isNull(), "removed")
        .when((F.col("old_size_bytes") != F.col("size_bytes")) | (F.col("old_mtime_ns") != F.col("mtime_ns")), "changed")
        .when(~F.col("old_sidecar_mtime_ns").eqNullSafe(F.col("sidecar_mtime_ns")), "refresh")
        .otherwise("unchanged")
    )
    return joined.select(
        F.coalesce("path", "old_path").alias("path"), status.alias("status"), F.col("old_id").alias("id"), "size_bytes", "mtime_ns", "sidecar_mtime_ns",
        F.col("sha256").alias("sha256"), F.col("old_sha256"),
    )


def detect_moves(diff: DataFrame) -> DataFrame:
    """(path, old_path, id): new paths that take over removed rows of equal content, one to one.

    Of several equal files the removed ones are taken by id, the new ones by path.
    """
    by_id = Window.partitionBy("old_sha256").orderBy("id")
    by_path = Window.partitionBy("sha256").orderBy("path")
    removed = diff.where("status = 'removed' and old_sha256 is not null").select(F.col("old_sha256").alias("s"), "id", F.col("path").alias("old_path"), F.row_number().over(by_id).alias("k"))
    new = diff.where("status = 'new' and sha256 is not null").select("sha256", "path", F.row_number().over(by_path).alias("n"))
    return new.join(removed, (F.col("sha256") == F.col("s")) & (F.col("n") == F.col("k"))).select("path", "old_path", "id")


def apply_diff(diff: DataFrame, moves: DataFrame, last: int | None = None) -> DataFrame:
    """The next snapshot: id, path, size_bytes, mtime_ns, sidecar_mtime_ns, sha256, rehash.

    Moved, changed and refreshed rows keep their ids, a refreshed row its hash; new rows are numbered after
    the largest id by path; ``rehash`` marks rows whose derived fingerprint is void. ``last`` is the largest id
    where ``diff`` lacks the unchanged rows.
    """
    moved = moves.select("path", F.col("id").alias("moved_id"))
    alive = diff.where("status <> 'removed'").join(moved, "path", "left").withColumn("id", F.coalesce("moved_id", "id"))
    last = diff.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if last is None else last
    fresh = number_rows(alive.where("id is null").drop("id"), [F.col("path")], "_n").withColumn("id", F.col("_n") + 1 + last)
    columns = [
        "id", "path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", F.when(F.col("status").isin("refresh", "unchanged"), F.col("old_sha256")).otherwise(F.col("sha256")).alias("sha256"),
        (F.col("status") != "unchanged").alias("rehash"),
    ]
    return alive.where("id is not null").select(*columns).unionByName(fresh.select(*columns))


def scan_counts(diff: DataFrame, moves: DataFrame) -> DataFrame:
    """One row: total, added (without moved), modified (with refreshed), removed (without moved), moved."""
    by = diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "refresh", "removed", "unchanged")])
    return by.crossJoin(F.broadcast(moves.agg(F.count("*").alias("moved")))).select(
        (F.col("new") + F.col("changed") + F.col("refresh") + F.col("unchanged")).alias("total"), (F.col("new") - F.col("moved")).alias("added"),
        (F.col("changed") + F.col("refresh")).alias("modified"), (F.col("removed") - F.col("moved")).alias("removed"), "moved",
    )


def plan_ingest(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (path, sha256) with action done, duplicate or process; the first path of equal bytes is processed."""
    first = Window.partitionBy("sha256").orderBy(F.lower("path"), "path")
    known = index.select("sha256", F.lit(True).alias("known")).distinct()
    done = F.coalesce("known", F.lit(False)) & F.lit(not force)
    ranked = files.join(known, "sha256", "left").withColumn("nth", F.row_number().over(first))
    return ranked.select("path", "sha256", F.when(done, "done").when(F.col("nth") > 1, "duplicate").otherwise("process").alias("action"))


def reconcile_index(index: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``index`` and the sidecars whose hash it lacks (the first by id of each); nothing is deleted."""
    missing = sidecars.join(index.select("sha256"), "sha256", "left_anti")
    first = missing.groupBy("sha256").agg(F.min("id").alias("id"))
    return index.select("sha256", "id", F.lit(False).alias("added")).unionByName(first.select("sha256", "id", F.lit(True).alias("added")))


def rebuild_item_tags(items: DataFrame) -> DataFrame:
    """Distinct (item_id, tag), trimmed and lower case, without blanks."""
    return items.select(F.col("id").alias("item_id"), F.explode("tags").alias("tag")).select("item_id", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").distinct()


def upgrade_schema(sidecars: DataFrame) -> DataFrame:
    """Rows below version 2 get the defaults and a media type derived again; ``upgraded`` marks them."""
    old = F.coalesce("schema_version", F.lit(1)) < 2
    return sidecars.select(
        "id",
        F.when(old, F.lit(2)).otherwise(F.col("schema_version")).cast("long").alias("schema_version"),
        F.when(old, F.coalesce("media_type", classify_media_type(extension(F.col("name")), F.col("animated")))).otherwise(F.col("media_type")).alias("media_type"),
        F.when(old, F.coalesce("source", F.lit("model"))).otherwise(F.col("source")).alias("source"),
        old.alias("upgraded"),
    )


def layout_moves(items: DataFrame, target: Column) -> DataFrame:
    """(id, path, target_path) of rows that are not where they belong."""
    return items.select("id", "path", target.alias("target_path")).where("path <> target_path")


def consumable_sources(plan: DataFrame, index: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sources that were handled and whose content has an indexed output with a readable sidecar."""
    handled = plan.where(F.col("action").isin("done", "duplicate", "success"))
    outputs = index.join(sidecars.select("id").distinct(), "id", "left_semi").select("sha256").distinct()
    return handled.join(outputs, "sha256", "left_semi").select("path", "sha256", "action")


def derive_backlog(items: DataFrame, sizes: list[int], done: DataFrame, failures: DataFrame, now, cooldown_s: int, limit: int) -> DataFrame:
    """Newest items that lack one of the derived outputs and did not fail within the cool-down, with their rank."""
    wanted = items.select("id", "indexed_at", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    lacking = wanted.join(done.select("id", "size"), ["id", "size"], "left_anti")
    recent = failures.where(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("failed_at") < cooldown_s).select("id")
    open_ = lacking.join(recent, "id", "left_anti").groupBy("id", "indexed_at").agg(F.count("*").alias("missing"))
    top = open_.orderBy(F.desc("indexed_at"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("indexed_at"), "id")))

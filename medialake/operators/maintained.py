"""Snapshots compared by digests, and views kept up to date from the rows that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators.diff import apply_diff, detect_moves, diff_snapshot
from medialake.operators.keyed_table import BUCKETS, KeyedTable, bucket_of

COMPARED = ("path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256")
SNAPSHOT = ("id", *COMPARED)


def store_snapshot(snapshot: DataFrame, buckets: int = BUCKETS, root: str | None = None) -> KeyedTable:
    """A snapshot in buckets by path, with digests of what a scan compares."""
    return KeyedTable.create(snapshot.select(*SNAPSHOT), "path", buckets, root, COMPARED)


def diff_by_digests(previous: KeyedTable, current: DataFrame, changes_only: bool = False) -> DataFrame:
    """The rows of ``diff_snapshot``; only buckets whose digests differ are joined.

    Rows of the other buckets are unchanged and are taken from the stored snapshot, or left out with ``changes_only``,
    when their buckets are not read at all.
    """
    now = current.select(*COMPARED)
    open_ = previous.differing(now)
    inside = bucket_of("path", previous.buckets).isin(sorted(open_)) if open_ else F.lit(False)
    found = diff_snapshot(previous.read(open_), now.where(inside))
    if changes_only:
        return found.where("status <> 'unchanged'")
    rest = previous.read(without=open_).select("path", F.lit("unchanged").alias("status"), "id", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256", F.col("sha256").alias("old_sha256"))
    return found.unionByName(rest)


def apply_by_digests(previous: KeyedTable, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, gone): the changed rows of the next snapshot with their ids and paths, and the (id, path) of rows that are no more.

    A moved row is an upsert under its new path; its old path is gone, its id is not (``id`` null).
    """
    found = diff_by_digests(previous, current, True)
    moves = detect_moves(found)
    last = previous.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    upserts = apply_diff(found, moves, last).select(*SNAPSHOT)
    moved = moves.select(F.col("old_path").alias("path"), F.lit(True).alias("moved"))
    gone = found.where("status = 'removed'").join(moved, "path", "left").select(F.when(F.col("moved").isNull(), F.col("id")).alias("id"), "path")
    return upserts, gone


def update_view(view: KeyedTable, upserts: DataFrame, gone: DataFrame, items: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> KeyedTable:
    """The view after a scan: rows of the ids ``upserts`` and ``gone`` (id) go, those that ``derive`` makes of the upserted items come.

    ``derive`` makes rows of the view from items, keyed by the item's id; it sees the upserted items only.
    """
    ids = upserts.select("id").distinct()
    fresh = derive(items.join(ids, "id", "left_semi"))
    void = gone.where("id is not null").select("id").unionByName(ids).select(F.col("id").alias(view.key))
    return view.update(void, fresh)

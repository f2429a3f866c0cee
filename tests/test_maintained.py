"""Tables in buckets, snapshots compared by digests, and views kept from what changed, against rebuilding."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from medialake.operators import diff, maintained, postings
from medialake.operators.keyed_table import KeyedTable, bucket_of
from medialake.plans.shared import shared_dir
from medialake.streaming import jobs

SNAPSHOT = "id long, path string, size_bytes long, mtime_ns long, sidecar_mtime_ns long, sha256 string"


def rows_of(frame):
    return sorted(map(repr, (tuple(r) for r in frame.select(*sorted(frame.columns)).collect())))


def scan(draw, rows):
    """A later listing: some files gone, changed, refreshed, moved or new, a few of them with equal content."""
    found = []
    for _, path, size, time, sidecar, sha in rows:
        kind = draw.random()
        if kind < 0.05:
            continue
        if kind < 0.1:
            found.append((None, path, size + 1, time, sidecar, sha + "x"))
        elif kind < 0.15:
            found.append((None, path, size, time, None if sidecar else 5, sha))
        elif kind < 0.2:
            found.append((None, f"/moved{draw.randint(0, 10**9)}{path}", size, time, sidecar, sha))
        else:
            found.append((None, path, size, time, sidecar, sha))
    return found + [(None, f"/new/{draw.randint(0, 10**9)}", 1, 2, None, f"s{draw.randint(0, 40)}") for _ in range(8)]


def test_digests_tell_rows_and_nulls_apart(spark):
    rows = [(1, None, 5), (1, 5, None), (2, 3, 4), (2, 3, 4)]
    table = KeyedTable.create(spark.createDataFrame(rows, "k long, a long, b long"), "k", 4)
    same = spark.createDataFrame(rows[::-1], "k long, a long, b long")
    assert table.differing(same) == set()
    for changed in (rows[:3], [*rows, rows[0]], [(1, 5, None), (1, 5, None), *rows[2:]], [*rows[:2], (2, 4, 3), (2, 3, 4)], []):
        assert table.differing(spark.createDataFrame(changed, "k long, a long, b long"))


def test_updates_write_only_buckets_they_touch(spark):
    table = KeyedTable.create(spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), "k", 16)
    gone, new = spark.createDataFrame([(3,), (4,), (999,)], "k long"), spark.createDataFrame([(5, 50), (5, 51), (300, 1)], "k long, v long")
    later = table.update(gone, new)
    wanted = [(k, k % 7) for k in range(200) if k not in (3, 4, 5)] + [(5, 50), (5, 51), (300, 1)]
    assert rows_of(later.read()) == sorted(map(repr, wanted)) and table.read().count() == 200
    touched = {r[0] for r in spark.createDataFrame([(k,) for k in (3, 4, 5, 300, 999)], "k long").select(bucket_of("k", 16)).collect()}
    assert {b for b in table.held if later.held.get(b) != table.held[b]} <= touched and len(touched) < 16
    again = KeyedTable.open(spark, table.root, "k", 16, table.schema)
    assert again.held == later.held and again.version == 1 and rows_of(again.read()) == rows_of(later.read())
    assert later.update(gone.limit(0), new.limit(0)) is later
    empty = later.update(later.read().select("k"), new.limit(0))
    assert not empty.held and empty.read().count() == 0 and not KeyedTable.open(spark, table.root, "k", 16, table.schema).held
    assert empty.update(gone.limit(0), new).read().count() == 3


def test_an_update_that_fails_leaves_the_last_version(spark):
    table = KeyedTable.create(spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v")), "k", 4)
    broken = spark.range(1).select(F.lit(1).cast("long").alias("k"), F.raise_error(F.lit("broken")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken"):
        table.update(spark.createDataFrame([(2,)], "k long"), broken)
    again = KeyedTable.open(spark, table.root, "k", 4, table.schema)
    assert again.version == 0 and again.read().count() == 50
    later = again.update(spark.createDataFrame([(2,)], "k long"), spark.createDataFrame([(9, "y")], "k long, v string"))
    assert later.version == 1 and later.read().count() == 49


@pytest.mark.parametrize("seed", [1, 2])
def test_diffs_by_digests_equal_whole_ones(spark, seed):
    draw = random.Random(seed)
    rows = [(k, f"/lib/{k}", 10 + k, 7, draw.choice([None, 3]), f"s{draw.randint(0, 60)}") for k in range(90)]
    table = maintained.store_snapshot(spark.createDataFrame(rows, SNAPSHOT), 32)
    for _ in range(3):
        before = table.read()
        known = [tuple(r[c] for c in ("id", "path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256")) for r in before.collect()]
        current = spark.createDataFrame(scan(draw, known[:50]) + known[50:], SNAPSHOT)
        whole = diff.diff_snapshot(before, current)
        assert rows_of(maintained.diff_by_digests(table, current)) == rows_of(whole)
        assert rows_of(maintained.diff_by_digests(table, current, True)) == rows_of(whole.where("status <> 'unchanged'"))
        wanted = diff.apply_diff(whole, diff.detect_moves(whole)).select(*maintained.SNAPSHOT)
        upserts, gone = maintained.apply_by_digests(table, current)
        later = table.update(gone.select("path"), upserts)
        assert rows_of(later.read()) == rows_of(wanted)
        table = later
    assert table.differing(table.read()) == set()


def test_equal_buckets_are_not_read(spark):
    rows = [(k, f"/lib/{k}", 10 + k, 7, None, f"s{k}") for k in range(200)]
    table = maintained.store_snapshot(spark.createDataFrame(rows, SNAPSHOT), 32)
    changed = spark.createDataFrame([(*rows[0][:2], 1, *rows[0][3:]), *rows[1:]], SNAPSHOT)
    (bucket,) = table.differing(changed)
    read = maintained.diff_by_digests(table, changed, True)
    assert [r["status"] for r in read.collect()] == ["changed"]
    assert {f.split("/")[-2] for f in table.read({bucket}).inputFiles()} == {f"bucket={bucket}"}
    files = set(read.inputFiles())
    assert files == set(table.read({bucket}).inputFiles())
    assert maintained.diff_by_digests(table, spark.createDataFrame(rows, SNAPSHOT), True).isEmpty()


def item_rows(spark, rows):
    """Items of a snapshot whose tags and texts follow from their content."""
    shown = spark.createDataFrame(rows, SNAPSHOT) if isinstance(rows, list) else rows
    return shown.select("id", F.array(F.lit(" All "), "sha256", F.col("size_bytes").cast("string"), F.lit(" ")).alias("tags"), *[F.concat("sha256", F.lit(f" {c} text "), F.col("path")).alias(c) for c in ("name", "title", "description", "ocr_text")], F.lit("t").alias("topics"), F.lit("c").alias("category"))


def docs_of(items):
    return items.withColumn("tags", F.array_join("tags", " "))


def test_views_equal_a_rebuild_after_each_scan(spark):
    draw = random.Random(3)
    rows = [(k, f"/lib/{k}", 10 + k, 7, None, f"s{draw.randint(0, 60)}") for k in range(120)]
    snapshot = maintained.store_snapshot(spark.createDataFrame(rows, SNAPSHOT), 16)
    tags = KeyedTable.create(diff.rebuild_item_tags(item_rows(spark, rows)), "item_id", 64)
    index = postings.build_postings(docs_of(item_rows(spark, rows)))
    for _ in range(3):
        known = [tuple(r[c] for c in ("id", "path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256")) for r in snapshot.read().orderBy("id").collect()]
        current = spark.createDataFrame(scan(draw, known[:30]) + known[30:], SNAPSHOT)
        upserts, gone = (f.persist() for f in maintained.apply_by_digests(snapshot, current))
        snapshot = snapshot.update(gone.select("path"), upserts)
        items = item_rows(spark, snapshot.read())
        later = maintained.update_view(tags, upserts, gone, items, diff.rebuild_item_tags)
        assert rows_of(later.read()) == rows_of(diff.rebuild_item_tags(items))
        assert any(later.held.get(b) == x for b, x in tags.held.items())
        tags = later
        fresh = docs_of(items.join(upserts.select("id"), "id", "left_semi"))
        index = postings.update_postings(index, gone.where("id is not null"), fresh)
        rebuilt = postings.build_postings(docs_of(items))
        assert (index.total, index.mean) == (rebuilt.total, pytest.approx(rebuilt.mean))
        for terms in (["new"], ["title text", "moved"], ["s11"], ["lib/1"]):
            one, other = ({r["id"]: r["score"] for r in postings.rank_by_postings(x, terms).collect()} for x in (index, rebuilt))
            assert one == pytest.approx(other, abs=1e-12) and (one or terms != ["new"])


def test_a_stream_of_listings_keeps_snapshot_and_views(spark, tmp_path):
    draw = random.Random(8)
    rows = [(k, f"/lib/{k}", 10 + k, 7, None, f"s{k}") for k in range(60)]
    first = maintained.store_snapshot(spark.createDataFrame(rows, SNAPSHOT), 8)
    view = KeyedTable.create(diff.rebuild_item_tags(item_rows(spark, rows)), "item_id", 8)
    opened = lambda t: KeyedTable.open(spark, t.root, t.key, t.buckets, t.schema, t.covered)

    def update(upserts, gone):
        maintained.update_view(opened(view), upserts, gone, item_rows(spark, upserts), diff.rebuild_item_tags)

    listing = str(tmp_path / "listing")
    last = [r for r in scan(draw, rows)]
    spark.createDataFrame(last, SNAPSHOT).drop("id").coalesce(1).write.parquet(listing)
    stream = spark.readStream.schema(SNAPSHOT.replace("id long, ", "")).parquet(listing)
    jobs.refresh_maintained(stream, lambda: opened(first), update, str(tmp_path / "state")).awaitTermination()
    now = opened(first)
    assert sorted(r["path"] for r in now.read().collect()) == sorted(r[1] for r in last)
    assert rows_of(opened(view).read()) == rows_of(diff.rebuild_item_tags(item_rows(spark, now.read())))
    # A batch that comes again changes nothing.
    jobs.refresh_maintained(stream, lambda: opened(first), update, str(tmp_path / "again")).awaitTermination()
    assert opened(first).version == now.version and shared_dir(spark)

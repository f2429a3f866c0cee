"""Queries over files, sidecars, exports and streams; what they read is written by Spark from the tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from medialake.operators import diff, providers
from medialake.plans import fixtures as fx
from medialake.plans.q_diff import DIFF
from medialake.plans.registry import registering
from medialake.plans.shared import shared_dir
from medialake.sources import files, library
from medialake.streaming import first_wins, jobs

I = fx.ITEMS_SQL
QUERIES, ORACLES, query = registering()
BEGAN, ENDED = datetime.datetime(2024, 3, 1, 12), datetime.datetime(2024, 3, 1, 12, 0, 30)


def _folder(s, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _library(s, d, path: str | None = None) -> str:
    """Items as text files, one for each category folder and media type."""
    path = path or _folder(s, "library")
    rows = fx.items(s, d).select("category_folder", "media_type", F.concat_ws("\t", F.col("id").cast("string"), "sha256").alias("value"))
    rows.repartition("category_folder", "media_type").sortWithinPartitions("category_folder", "media_type", "value").write.partitionBy("category_folder", "media_type").text(path)
    return path


@query("a1_scan_files", I + " SELECT count(DISTINCT (category_folder, media_type)) AS n_files, sum(length(id::VARCHAR) + 66)::BIGINT AS bytes, '.txt' AS ext FROM items")
def a1(s, d):
    return files.scan_files(s, _library(s, d), (".TXT",)).groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query(
    "a3_read_sidecars",
    I + " SELECT CASE WHEN id % 17 <> 0 THEN substr(sha256, 1, 16) END AS id, CASE WHEN id % 17 <> 0 THEN title END AS title, CASE WHEN id % 17 <> 0 THEN len(tags) END AS n_tags, id % 17 <> 0 AS readable FROM items",
)
def a3(s, d):
    path = _folder(s, "sidecars")
    items = fx.items(s, d)
    version = F.when(F.col("id") % 17 == 0, "broken").otherwise("2")
    document = F.struct(
        F.when(F.col("id") % 17 != 0, 2).alias("schema_version"), F.when(F.col("id") % 17 != 0, F.substring("sha256", 1, 16)).alias("id"), F.struct("name", "width", "height", F.col("size_bytes").alias("bytes"), "media_type").alias("file"),
        F.struct("sha256").alias("source"), F.struct("title", "tags", "meme_type", "nsfw", "confidence").alias("analysis"), F.struct(F.col("category_name").alias("name")).alias("category"), F.struct(version.alias("profile")).alias("processing"),
    )
    library.write_library(items.select("category_folder", "media_type", "stem", F.to_json(document).alias("sidecar")), path)
    good, bad = files.read_sidecars(s, path)
    rows = good.select("id", "analysis.title", F.size("analysis.tags").cast("long").alias("n_tags"), F.lit(True).alias("readable"))
    return rows.unionByName(bad.select(F.lit(False).alias("readable")), allowMissingColumns=True)


@query("a4_category_registry", I + fx.REGISTRY_SQL + " SELECT id::INT AS id, name, folder, stored_count AS count, pinned, rule FROM registry")
def a4(s, d):
    path = _folder(s, "registry")
    rows = fx.registry(s, d).select("id", "name", "folder", F.col("stored_count").alias("count"), "pinned", "rule")
    rows.agg(F.collect_list(F.struct("*")).alias("categories")).write.json(path)
    return files.read_category_registry(s, f"{path}/*.json").select("id", "name", "folder", "count", "pinned", "rule")


@query("a9_write_library", I + " SELECT category_folder, media_type, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM items GROUP BY 1, 2")
def a9(s, d):
    path = _folder(s, "items")
    files.write_library(fx.items(s, d).select("id", "size_bytes", "category_folder", "media_type"), path)
    return s.read.parquet(path).groupBy("category_folder", "media_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(
    "a9_library_files",
    I + """, placed AS (SELECT *, CASE WHEN id % 7 = 0 THEN '' ELSE category_folder || '/' || media_type END AS place FROM items)
    SELECT place, ext, count(*) AS n, sum(strlen(ocr_text))::BIGINT AS bytes FROM placed WHERE ocr_text IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT place, '.json', count(*), sum(strlen('{"id":' || id || ',"sha256":"' || sha256 || '"}'))::BIGINT FROM placed GROUP BY 1""",
)
def a9_files(s, d):
    path = _folder(s, "library-files")
    items = fx.files(s, d).withColumns(
        {"category_folder": F.when(F.col("id") % 7 != 0, F.col("category_folder")), "content": F.col("ocr_text").cast("binary"), "sidecar": F.to_json(F.struct("id", "sha256"))}
    )
    library.write_library(items, path)
    found = library.read_library(s, path).withColumn("ext", F.regexp_extract("rel_path", r"(\.[a-z0-9]+)$", 1))
    return found.groupBy(F.regexp_extract("rel_path", "^(.*)/", 1).alias("place"), "ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def _header(batch):
    """The first eight digits of a hash; hashes that begin with two zeros cannot be read."""
    if batch["sha256"].str.startswith("00").any():
        raise ValueError("unreadable header")
    return batch.assign(header=batch["sha256"].str[:8])


@query("u1_isolated_providers", I + " SELECT id, CASE WHEN sha256 NOT LIKE '00%' THEN substr(sha256, 1, 8) END AS header, CASE WHEN sha256 LIKE '00%' THEN 'ValueError: unreadable header' END AS message FROM items")
def u1(s, d):
    header = providers.RowProvider("header", ("sha256",), "header string", _header, F.col("sha256").isNotNull())
    merged = providers.merge_providers(fx.files(s, d).select("id", "sha256"), [header], "id", "errors")
    return merged.select("id", "header", F.get("errors", F.lit(0))["message"].alias("message"))


@query(
    "a10_scan_record",
    DIFF + """ SELECT n.run::INT AS run, count(*) FILTER (status <> 'removed') AS total, count(*) FILTER (status = 'new') - (SELECT count(*) FROM moves) AS added, count(*) FILTER (status IN ('changed', 'refresh')) AS modified,
    count(*) FILTER (status = 'removed') - (SELECT count(*) FROM moves) AS removed, (SELECT count(*) FROM moves) AS moved, 30.0::DOUBLE AS duration_s, CASE WHEN n.run = 1 THEN 'cancelled' END AS error FROM compared, (VALUES (0), (1)) n(run) GROUP BY n.run""",
)
def a10(s, d):
    path = _folder(s, "scans")
    found = diff.diff_snapshot(fx.previous_snapshot(s, d), fx.items(s, d))
    counts = diff.scan_counts(found, diff.detect_moves(found)).persist()
    for run, error in ((0, None), (1, "cancelled")):
        files.append_record(files.scan_record(counts, BEGAN, ENDED, error).withColumn("run", F.lit(run)), path)
    counts.unpersist()
    return s.read.parquet(path).drop("started_at", "finished_at")


@query("a11_write_failures", I + " SELECT path AS source_path, CASE WHEN id % 2 = 0 THEN 'decode' ELSE 'analyze' END AS stage, 'item ' || id AS message FROM items WHERE id % 13 = 0")
def a11(s, d):
    path = _folder(s, "failures")
    failed = fx.items(s, d).where("id % 13 = 0").select(F.col("path").alias("source_path"), F.when(F.col("id") % 2 == 0, "decode").otherwise("analyze").alias("stage"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("message"))
    files.write_failures(failed, path)
    return s.read.schema("source_path string, stage string, message string").json(path)


@query("a12_export_json", I + " SELECT to_json({'id': id, 'name': name, 'tags': tags, 'nsfw': nsfw}) AS json FROM items")
def a12(s, d):
    return files.export_json(fx.items(s, d).select("id", "name", "tags", "nsfw"))


@query("s1_stream_ingest", I + " SELECT count(*) AS n, count(DISTINCT sha256) AS hashes FROM (SELECT DISTINCT string_agg(id || chr(9) || sha256 || chr(10), '' ORDER BY id || chr(9) || sha256) AS sha256 FROM items GROUP BY category_folder, media_type)")
def s1(s, d):
    found = jobs.run_to_end(jobs.stream_ingest(s, _library(s, d)), _folder(s, "ingested"), _folder(s, "ingest-state"))
    return found.agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("hashes"))


@query("s1_first_wins", I + " SELECT again, count(*) AS n FROM (SELECT DISTINCT category_folder, media_type FROM items), (VALUES (false), (true)) v(again) GROUP BY 1")
def s1_first_wins(s, d):
    inbox = _folder(s, "inbox")
    for part in ("first", "second"):
        _library(s, d, f"{inbox}/{part}")
    found = first_wins.ingest(s, inbox, _folder(s, "arrivals"), _folder(s, "arrivals-state"))
    return found.groupBy(F.col("repeat").alias("again")).agg(F.count("*").alias("n"))


@query("s2_stream_view_counts", I + fx.VIEWS_SQL + " SELECT sha256, count(*) AS view_count, strftime(max(viewed_at), '%Y-%m-%d %H:%M:%S') AS last_viewed_at FROM views GROUP BY 1")
def s2(s, d):
    path = _folder(s, "views")
    fx.views(s, d).select("sha256", "viewed_at").repartition(4).write.parquet(path)
    stream = jobs.stream_view_counts(s.readStream.schema("sha256 string, viewed_at timestamp").option("maxFilesPerTrigger", 2).parquet(path))
    counts = jobs.run_to_end(stream, _folder(s, "counts"), _folder(s, "counts-state"), "update", "sha256")
    return counts.withColumn("last_viewed_at", F.date_format("last_viewed_at", "yyyy-MM-dd HH:mm:ss"))


@query("s3_refresh_loop", DIFF + " SELECT count(*) FILTER (status <> 'removed') AS total, count(*) FILTER (status = 'new') - (SELECT count(*) FROM moves) AS added, (SELECT count(*) FROM moves) AS moved, (SELECT count(*) FROM items) AS n_rows FROM compared")
def s3(s, d):
    listing, snapshot = _folder(s, "listing"), _folder(s, "snapshot")
    columns = ["path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256"]
    rows = fx.items(s, d).select(*columns)
    rows.write.parquet(listing)
    fx.previous_snapshot(s, d).write.parquet(f"{snapshot}/0")

    def write(rows, counts):
        rows.write.parquet(f"{snapshot}/1")
        counts.write.parquet(f"{snapshot}/counts")

    jobs.refresh_loop(s.readStream.schema(rows.schema).parquet(listing), lambda: s.read.parquet(f"{snapshot}/0"), write, _folder(s, "refresh-state")).awaitTermination()
    return s.read.parquet(f"{snapshot}/counts").select("total", "added", "moved").crossJoin(F.broadcast(s.read.parquet(f"{snapshot}/1").agg(F.count("*").alias("n_rows"))))

"""Queries over snapshots, providers and incremental maintenance."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from medialake.functions.media import category_from_path, classify_media_type, extension
from medialake.operators import diff, maintained, postings, providers
from medialake.operators.keyed_table import KeyedTable
from medialake.operators.normalize import build_search_docs
from medialake.plans import fixtures as fx
from medialake.plans.registry import registering
from medialake.plans.shared import stored

I, P = fx.ITEMS_SQL, fx.ITEMS_SQL + fx.PREVIOUS_SQL
QUERIES, ORACLES, query = registering()


DIFF = P + """, compared AS (
  SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' WHEN p.size_bytes <> c.size_bytes OR p.mtime_ns <> c.mtime_ns THEN 'changed'
    WHEN p.sidecar_mtime_ns IS DISTINCT FROM c.sidecar_mtime_ns THEN 'refresh' ELSE 'unchanged' END AS status, p.id, c.size_bytes, c.sha256, p.sha256 AS old_sha256, c.id AS now_id
  FROM previous p FULL JOIN items c ON p.path = c.path
), moves AS (
  SELECT n.path, r.path AS old_path, r.id FROM
    (SELECT path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS k FROM compared WHERE status = 'new') n
    JOIN (SELECT id, path, old_sha256, row_number() OVER (PARTITION BY old_sha256 ORDER BY id) AS k FROM compared WHERE status = 'removed') r ON n.sha256 = r.old_sha256 AND n.k = r.k
)"""


def _diff(s, d):
    return diff.diff_snapshot(fx.previous_snapshot(s, d), fx.items(s, d))


@query("a2_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def a2(s, d):
    docs = fx.table(s, d, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("a5_media_type", I + " SELECT id, media_type FROM items")
def a5(s, d):
    return fx.items(s, d).select("id", classify_media_type(extension(F.col("name")), F.col("id") % 10 == 4).alias("media_type"))


@query(
    "a6_merge_providers",
    I + """ SELECT path, CASE WHEN id % 3 = 0 AND id % 4 <> 0 THEN title ELSE 'untitled' END AS title, CASE WHEN id % 3 = 0 THEN description END AS description,
    CASE WHEN id % 5 = 0 THEN category_name ELSE regexp_extract(category_folder, '^[0-9]{2}-(.+)$', 1) END AS category_name FROM items""",
)
def a6(s, d):
    items = fx.items(s, d)
    i = F.col("id")
    basic = items.select("path", F.lit("untitled").alias("title"), F.lit(None).cast("string").alias("description"), F.when(i % 5 == 0, F.col("category_name")).alias("category_name"))
    sidecar = items.where(i % 3 == 0).select("path", F.when(i % 4 != 0, F.col("title")).alias("title"), "description")
    folders = items.select("path", category_from_path(F.col("rel_path")).alias("category_name"))
    chain = [
        providers.Provider("sidecar", lambda fields: sidecar, overrides=True),
        providers.Provider("broken", lambda fields: fields.select("path", "no_such_column")),
        providers.Provider("pathtags", lambda fields: folders),
    ]
    return providers.merge_providers(basic, chain)


@query(
    "a7_category_from_path",
    I + r""" SELECT id, lower(trim(regexp_extract(list_filter(string_split(p, '/')[:-2], lambda x: regexp_matches(x, '^[0-9]{2}[\s-]+.+$'))[1], '^[0-9]{2}[\s-]+(.+)$', 1))).replace(' ', '-') AS category
    FROM (SELECT id, CASE WHEN id % 4 = 0 THEN name WHEN id % 4 = 1 THEN '07 Some Thing/' || rel_path ELSE rel_path END AS p FROM items)""",
)
def a7(s, d):
    i = F.col("id")
    path = F.when(i % 4 == 0, F.col("name")).when(i % 4 == 1, F.concat(F.lit("07 Some Thing/"), "rel_path")).otherwise(F.col("rel_path"))
    return fx.items(s, d).select("id", category_from_path(path).alias("category"))


@query(
    "a8_finalize_nsfw",
    I + fx.REGISTRY_SQL + """ SELECT id, nsfw OR category_name = 'nsfw' OR category_folder = '03-src3' OR category_name IN (SELECT name FROM registry WHERE rule = 'nsfw' OR name = 'src2') AS nsfw
    FROM (SELECT id, nsfw, category_folder, CASE WHEN id % 9 = 0 THEN 'nsfw' ELSE category_name END AS category_name FROM items)""",
)
def a8(s, d):
    items = fx.items(s, d).withColumn("category_name", F.when(F.col("id") % 9 == 0, "nsfw").otherwise(F.col("category_name")))
    registry = fx.registry(s, d).withColumn("rule", F.when(F.col("name") == "src2", "nsfw").otherwise(F.col("rule")))
    return providers.finalize_nsfw(items, registry, "03-src3").select("id", "nsfw")


@query("b1_diff_snapshot", DIFF + " SELECT path, status, id FROM compared")
def b1(s, d):
    return _diff(s, d).select("path", "status", "id")


@query("b1_diff_by_digests", DIFF + " SELECT path, status, id FROM compared")
def b1_digests(s, d):
    previous = maintained.store_snapshot(fx.previous_snapshot(s, d))
    return maintained.diff_by_digests(previous, fx.items(s, d)).select("path", "status", "id")


@query("b3_apply_by_digests", DIFF + """, alive AS (SELECT c.path, coalesce(m.id, c.id) AS id, c.size_bytes, CASE WHEN status IN ('refresh', 'unchanged') THEN old_sha256 ELSE sha256 END AS sha256 FROM compared c LEFT JOIN moves m ON c.path = m.path WHERE status <> 'removed')
    SELECT coalesce(id, (SELECT max(id) FROM previous) + row_number() OVER (PARTITION BY id IS NULL ORDER BY path)) AS id, path, size_bytes, sha256 FROM alive""")
def b3_digests(s, d):
    previous = maintained.store_snapshot(fx.previous_snapshot(s, d))
    upserts, gone = maintained.apply_by_digests(previous, fx.items(s, d))
    return previous.update(gone.select("path"), upserts).read().select("id", "path", "size_bytes", "sha256")


@query("b2_detect_moves", DIFF + " SELECT path, old_path, id FROM moves")
def b2(s, d):
    return diff.detect_moves(_diff(s, d))


@query(
    "b3_apply_diff",
    DIFF + """, alive AS (SELECT c.path, c.status, coalesce(m.id, c.id) AS id, c.size_bytes, CASE WHEN status IN ('refresh', 'unchanged') THEN old_sha256 ELSE sha256 END AS sha256 FROM compared c LEFT JOIN moves m ON c.path = m.path WHERE status <> 'removed')
    SELECT coalesce(id, (SELECT max(id) FROM previous) + row_number() OVER (PARTITION BY id IS NULL ORDER BY path)) AS id, path, size_bytes, sha256, status <> 'unchanged' AS rehash FROM alive""",
)
def b3(s, d):
    found = _diff(s, d)
    return diff.apply_diff(found, diff.detect_moves(found)).select("id", "path", "size_bytes", "sha256", "rehash")


@query(
    "b4_scan_counts",
    DIFF + """ SELECT count(*) FILTER (status <> 'removed') AS total, count(*) FILTER (status = 'new') - (SELECT count(*) FROM moves) AS added, count(*) FILTER (status IN ('changed', 'refresh')) AS modified,
    count(*) FILTER (status = 'removed') - (SELECT count(*) FROM moves) AS removed, (SELECT count(*) FROM moves) AS moved FROM compared""",
)
def b4(s, d):
    found = _diff(s, d)
    return diff.scan_counts(found, diff.detect_moves(found))


INGEST = I + """, plan AS (
  SELECT path, sha256, CASE WHEN sha256 IN (SELECT sha256 FROM items WHERE id % 6 = 0) THEN 'done' WHEN row_number() OVER (PARTITION BY sha256 ORDER BY lower(path), path) > 1 THEN 'duplicate' ELSE 'process' END AS action FROM items
)"""


def _plan(s, d):
    items = fx.items(s, d)
    return diff.plan_ingest(items.select("path", "sha256"), items.where("id % 6 = 0").select("sha256"))


@query("b5_plan_ingest", INGEST + " SELECT * FROM plan")
def b5(s, d):
    return _plan(s, d)


@query(
    "b6_reconcile_index",
    I + """, idx AS (SELECT sha256, min(id) AS id FROM items WHERE id % 6 = 0 GROUP BY 1)
    SELECT sha256, id, false AS added FROM idx UNION ALL SELECT sha256, min(id), true FROM items WHERE sha256 NOT IN (SELECT sha256 FROM idx) GROUP BY 1""",
)
def b6(s, d):
    items = fx.items(s, d)
    return diff.reconcile_index(items.where("id % 6 = 0").groupBy("sha256").agg(F.min("id").alias("id")), items)


@query("b7_item_tags", I + " SELECT DISTINCT item_id, lower(trim(t)) AS tag FROM (SELECT id AS item_id, unnest(tags) AS t FROM items) WHERE trim(t) <> ''")
def b7(s, d):
    return diff.rebuild_item_tags(fx.items(s, d))


@query(
    "b8_rebuild_derived",
    I + """ SELECT i.id, count(DISTINCT lower(trim(t.tag))) FILTER (trim(t.tag) <> '') AS n_tags, length(any_value(title)) + length(any_value(description)) AS n_text FROM items i, unnest(i.tags) AS t(tag) GROUP BY i.id""",
)
def b8(s, d):
    items = fx.items(s, d)
    tags = diff.rebuild_item_tags(items).groupBy("item_id").agg(F.count("*").alias("n_tags"))
    texts = items.select("id", (F.length("title") + F.length("description")).cast("long").alias("n_text"))
    return texts.join(tags, F.col("id") == F.col("item_id")).select("id", "n_tags", "n_text")


def _former_items(s, d):
    """Items before the last scan: the ids and paths of the previous snapshot, other titles and tags where files or sidecars have changed since."""
    i = F.col("id")
    items = fx.items(s, d)
    was = (i % 13 == 0) | (i % 17 == 0)
    known = items.where(i % 11 != 0).withColumns({"title": F.when(was, F.concat(F.lit("former "), "title")).otherwise(F.col("title")), "tags": F.when(was, F.array(F.lit("Former"))).otherwise(F.col("tags"))})
    gone = items.where(i < 20).withColumns({"id": i + 10_000_000, "title": F.lit("gone for good")})
    return known.unionByName(gone)


def _changes(s, d):
    """(upserts, gone): ids of items that a scan finds new, changed, to refresh or moved, and of those that are no more."""
    changed = maintained.diff_by_digests(maintained.store_snapshot(fx.previous_snapshot(s, d)), fx.items(s, d), True)
    now = fx.items(s, d).select("id", "path")
    upserts = changed.where("status <> 'removed'").select("path").join(now, "path").select("id")
    gone = changed.where("status = 'removed'").select("id").join(upserts, "id", "left_anti")
    return stored(upserts), stored(gone)


@query("b7_maintained_tags", I + " SELECT DISTINCT item_id, lower(trim(t)) AS tag FROM (SELECT id AS item_id, unnest(tags) AS t FROM items) WHERE trim(t) <> ''")
def b7_maintained(s, d):
    view = KeyedTable.create(diff.rebuild_item_tags(_former_items(s, d)), "item_id")
    return maintained.update_view(view, *_changes(s, d), fx.items(s, d), diff.rebuild_item_tags).read()


SEARCHED = I + """ SELECT id, sha256(coalesce(name, '') || '|' || title || '|' || description || '|' || array_to_string(tags, ' ') || ' ' || meme_type || coalesce(' ' || template, '') || '|' || category_name) AS digest, length(ocr_text) AS n FROM items"""


@query("b8_maintained_search_rows", SEARCHED)
def b8_maintained(s, d):
    view = KeyedTable.create(build_search_docs(_former_items(s, d)), "id")
    rows = maintained.update_view(view, *_changes(s, d), fx.items(s, d), build_search_docs).read()
    return rows.select("id", F.sha2(F.concat_ws("|", "name", "title", "description", "tags", "category"), 256).alias("digest"), F.char_length("ocr_text").cast("long").alias("n"))


@query(
    "b8_maintained_postings",
    I + """ SELECT id FROM items WHERE contains(lower(name || '|' || title || '|' || description || '|' || ocr_text || '|' || array_to_string(tags, ' ') || ' ' || meme_type || coalesce(' ' || template, '') || '|' || array_to_string(topics, ' ') || '|' || category_name), 'the')""",
)
def b8_postings(s, d):
    index = postings.build_postings(build_search_docs(_former_items(s, d)))
    upserts, gone = _changes(s, d)
    fresh = build_search_docs(fx.items(s, d).join(upserts, "id", "left_semi"))
    return postings.rank_by_postings(postings.update_postings(index, gone, fresh), ["the"]).select("id")


@query(
    "b9_upgrade_schema",
    I + """ SELECT id, 2 AS schema_version, CASE WHEN id % 2 = 1 AND id % 4 = 1 THEN 'image' ELSE media_type END AS media_type, CASE WHEN id % 2 = 1 THEN 'model' ELSE 'hint' END AS source, id % 2 = 1 AS upgraded FROM items""",
)
def b9(s, d):
    i = F.col("id")
    rows = fx.items(s, d).select("id", "name", (i % 10 == 4).alias("animated"), F.when(i % 2 == 1, 1).otherwise(2).alias("schema_version"), F.when(i % 2 == 0, F.col("media_type")).when(i % 4 == 1, "image").alias("media_type"), F.when(i % 2 == 0, "hint").alias("source"))
    return diff.upgrade_schema(rows)


@query("b10_layout_moves", I + " SELECT id, path, target_path FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '/lib/' || category_folder || '/' || name ELSE path END AS path, path AS target_path FROM items) WHERE path <> target_path")
def b10(s, d):
    folder = F.concat(F.lit("/lib/"), "category_folder", F.lit("/"))
    items = fx.items(s, d).withColumn("path", F.when(F.col("id") % 3 == 0, F.concat(folder, "name")).otherwise(F.col("path")))
    return diff.layout_moves(items, F.concat(folder, "media_type", F.lit("/"), "name"))


@query("b11_consumable_sources", INGEST + " SELECT path, sha256, action FROM plan WHERE action IN ('done', 'duplicate') AND sha256 IN (SELECT sha256 FROM items WHERE id % 5 <> 0)")
def b11(s, d):
    items = fx.items(s, d)
    return diff.consumable_sources(_plan(s, d), items.select("sha256", "id"), items.where("id % 5 <> 0"))


@query(
    "b12_derive_backlog",
    I + """, wanted AS (SELECT id, indexed_at, unnest([160, 320, 640]) AS size FROM items), open AS (
      SELECT id, indexed_at, count(*) AS missing FROM wanted WHERE NOT (id % 3 = 0 OR (id % 3 = 1 AND size = 160)) AND NOT (id % 7 = 0 AND id % 2 = 0) GROUP BY id, indexed_at)
    SELECT id, strftime(indexed_at, '%Y-%m-%d %H:%M:%S') AS indexed_at, missing, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY indexed_at DESC, id) AS rank FROM open) WHERE rank <= 50""",
)
def b12(s, d):
    items = fx.items(s, d)
    i = F.col("id")
    now = datetime.datetime(2024, 3, 1)
    done = items.select("id", F.explode(F.array(*map(F.lit, (160, 320, 640)))).alias("size")).where((i % 3 == 0) | ((i % 3 == 1) & (F.col("size") == 160)))
    failed = items.where(i % 7 == 0).select("id", F.when(i % 2 == 0, F.lit("2024-02-29 23:00:00")).otherwise(F.lit("2024-02-20 00:00:00")).cast("timestamp").alias("failed_at"))
    found = diff.derive_backlog(items, [160, 320, 640], done, failed, now, 86_400, 50)
    return found.withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss"))

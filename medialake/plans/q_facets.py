"""Queries over counts, facets, suggestions and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import facets
from medialake.operators.diff import rebuild_item_tags
from medialake.operators.normalize import build_search_docs
from medialake.plans import fixtures as fx
from medialake.plans.q_search import DOCS_SQL, MARKS_SQL, TAGS_SQL, VIEWS_SQL
from medialake.plans.registry import registering

I = fx.ITEMS_SQL
QUERIES, ORACLES, query = registering()
NOW = "2024-02-02 00:00:00"


def _items(s, d):
    return fx.items(s, d)


def _tags(s, d):
    return rebuild_item_tags(fx.items(s, d))


def _views(s, d):
    return facets.view_counts(fx.views(s, d))


@query("e1_library_stats", I + MARKS_SQL + " SELECT count(*) AS total, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, count(*) FILTER (nsfw) AS nsfw, (SELECT count(*) FROM favorites) AS favorites FROM items")
def e1(s, d):
    return facets.library_stats(_items(s, d), fx.favorites(s, d))


@query("e2_counts_by_type", I + " SELECT t AS media_type, (SELECT count(*) FROM items WHERE media_type = t AND category_name = 'src4') AS n FROM (VALUES ('image'), ('gif'), ('video')) v(t)")
def e2(s, d):
    return facets.counts_by_type(_items(s, d).where("category_name = 'src4'"))


@query("e3_counts_by_category", I + " SELECT category_name, min(category_folder) AS folder, count(*) AS n FROM items GROUP BY 1")
def e3(s, d):
    return facets.counts_by_category(_items(s, d))


@query("e4_tag_counts", I + TAGS_SQL + ", c AS (SELECT tag, count(*) AS n FROM item_tags WHERE contains(tag, 'en') GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM c) SELECT tag, n, rank::INT AS rank FROM r WHERE rank <= 40")
def e4(s, d):
    return facets.tag_counts(_tags(s, d), " EN", 40)


@query("e5_category_listing", I + fx.REGISTRY_SQL + " SELECT r.id, r.name, r.folder, coalesce(c.n, r.stored_count) AS n FROM registry r LEFT JOIN (SELECT category_name, count(*) AS n FROM items GROUP BY 1) c ON c.category_name = r.name")
def e5(s, d):
    return facets.category_listing(_items(s, d), fx.registry(s, d))


@query(
    "e6_suggest",
    I + TAGS_SQL + """, v AS (SELECT DISTINCT 0 AS k, 'title' AS kind, title AS value FROM items UNION SELECT 1, 'tag', tag FROM item_tags UNION SELECT 2, 'name', name FROM items UNION SELECT 3, 'category', category_name FROM items
    ), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value) AS i FROM v WHERE contains(lower(value), 'rc1')), t AS (SELECT *, row_number() OVER (ORDER BY k, value) AS rank FROM r WHERE i <= 30) SELECT rank::INT AS rank, kind, value FROM t WHERE rank <= 30""",
)
def e6(s, d):
    return facets.suggest(_items(s, d), _tags(s, d), "RC1", 30)


@query("e7_recent_added", I + " SELECT id, rank::INT AS rank FROM (SELECT id, row_number() OVER (ORDER BY indexed_at DESC, id) AS rank FROM items) WHERE rank <= 30")
def e7(s, d):
    return facets.recent_added(_items(s, d), 30).select("id", "rank")


@query("e8_recent_viewed", I + VIEWS_SQL + " SELECT id, view_count, rank::INT AS rank FROM (SELECT id, view_count, row_number() OVER (ORDER BY last_viewed_at DESC, id) AS rank FROM items JOIN counts USING (sha256)) WHERE rank <= 30")
def e8(s, d):
    return facets.recent_viewed(_items(s, d), _views(s, d), 30).select("id", "view_count", "rank")


@query("e9_view_counts", I + VIEWS_SQL + " SELECT sha256, view_count, strftime(last_viewed_at, '%Y-%m-%d %H:%M:%S') AS last_viewed_at FROM counts")
def e9(s, d):
    return _views(s, d).withColumn("last_viewed_at", F.date_format("last_viewed_at", "yyyy-MM-dd HH:mm:ss"))


@query("e10_favorites_state", I + MARKS_SQL + " SELECT sha256, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM favorites")
def e10(s, d):
    return fx.favorites(s, d).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "e11_builtin_collections",
    I + VIEWS_SQL + MARKS_SQL + f""", x AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS copies FROM items) SELECT unnest(['favorites', 'recent-added', 'recent-viewed', 'gifs', 'videos', 'images', 'nsfw', 'duplicates']) AS name,
    unnest([count(*) FILTER (sha256 IN (SELECT sha256 FROM favorites)), count(*) FILTER (indexed_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY), count(*) FILTER (sha256 IN (SELECT sha256 FROM counts)), count(*) FILTER (media_type = 'gif'),
    count(*) FILTER (media_type = 'video'), count(*) FILTER (media_type = 'image'), count(*) FILTER (nsfw), count(*) FILTER (copies > 1)]) AS n FROM x UNION ALL SELECT 'category:' || category_name, count(*) FROM items GROUP BY 1""",
)
def e11(s, d):
    return facets.builtin_collections(_items(s, d), _views(s, d), fx.favorites(s, d), NOW, 1)


@query(
    "e12_saved_collections",
    DOCS_SQL + TAGS_SQL + MARKS_SQL + """, texts AS (SELECT id, concat_ws(chr(10), name, title, description, ocr_text, tags, topics, category) AS t FROM docs)
    SELECT 1 AS collection_id, count(*) AS n FROM items JOIN texts USING (id) WHERE media_type IN ('gif', 'video') AND NOT nsfw AND contains(t, 'the') AND contains(t, 'src1')
    UNION ALL SELECT 2, count(*) FROM items WHERE nsfw UNION ALL SELECT 3, count(*) FROM items WHERE category_name = 'src2' AND duration_s >= 30 AND duration_s <= 200 AND id IN (SELECT item_id FROM item_tags WHERE tag = 'en')
    UNION ALL SELECT 4, count(*) FROM items WHERE sha256 IN (SELECT sha256 FROM favorites) AND NOT nsfw AND created_at >= TIMESTAMP '2024-01-01 02:00:00' UNION ALL SELECT 5, 0""",
)
def e12(s, d):
    saved = [
        (1, "THE src1", '{"type": ["gif", "video"]}'), (2, None, '{"nsfw": "only"}'), (3, "", '{"category": ["src2"], "tag": [" EN"], "min_duration": 30, "max_duration": 200, "nsfw": "include"}'),
        (4, None, '{"favorite": true, "since": "2024-01-01 02:00:00"}'), (5, "no such words anywhere", "{}"),
    ]
    collections = s.createDataFrame(saved, "collection_id int, query string, filters_json string")
    items = _items(s, d)
    return facets.eval_saved_collections(collections, build_search_docs(items), items, rebuild_item_tags(items), fx.favorites(s, d))

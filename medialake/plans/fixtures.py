"""The media library as views over the given tables, for Spark and as SQL for DuckDB.

Every expression exists on both sides with equal results; see FIXTURES.md for the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.media import MEME_TYPES, classify_media_type
from medialake.plans.shared import spread, table

EXTENSIONS = (".jpg", ".png", ".gif", ".mp4", ".webp")
FIRST_TAGS = 4


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def files(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The columns of ``items`` that need no label: what follows from a document alone; ``wide`` for costly work on texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs = spread(docs) if wide else docs
    d = F.col("doc_id")
    words = F.filter(F.split(F.lower("text"), r"[ \n\t]+"), lambda w: w != "")
    based = docs.select(
        "*",
        _pick(EXTENSIONS, d % 5).alias("ext"),
        (d % 10 == 4).alias("animated"),
        F.array_distinct(F.concat(F.array("lang", "source"), F.slice(words, 1, FIRST_TAGS))).alias("tags"),
    )
    typed = based.withColumn("media_type", classify_media_type(F.col("ext"), F.col("animated"))).withColumns(
        {
            "stem": F.concat_ws("-", F.concat_ws("_", "lang", "source"), d.cast("string")),
            "category_folder": F.concat_ws("-", F.lpad((d % 12).cast("string"), 2, "0"), "source"),
        }
    )
    named = typed.withColumn("name", F.concat("stem", "ext")).withColumn("rel_path", F.concat_ws("/", "category_folder", "media_type", "name"))
    return named.select(
        d.alias("id"),
        F.concat(F.lit("/lib/"), "rel_path").alias("path"),
        "rel_path",
        "name",
        "stem",
        "ext",
        "media_type",
        F.col("n_chars").alias("size_bytes"),
        (F.lit(1704067200000000000) + d * 60000000000).alias("mtime_ns"),
        F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(1706745600) + d * 7919 % 100000).alias("indexed_at"),
        F.when(d % 50 != 0, 400 + d * 37 % 1600).alias("width"),
        F.when(d % 50 != 0, 300 + d * 91 % 6000).alias("height"),
        F.when(F.col("media_type") != "image", 1 + (d * 13 % 2400) / F.lit(10.0)).alias("duration_s"),
        F.sha2("text", 256).alias("sha256"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("title"),
        F.substring("text", 121, 500).alias("description"),
        F.col("text").alias("ocr_text"),
        "tags",
        F.array("lang").alias("topics"),
        F.array("source").alias("tone"),
        _pick(MEME_TYPES, d % 10).alias("meme_type"),
        F.when(d % 7 == 0, F.col("source")).alias("template"),
        F.col("source").alias("category_name"),
        "category_folder",
        (d * 3).alias("sidecar_mtime_ns"),
    )


def items(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The central table: a row for each document, read as a media file with its metadata.

    What follows from a text is derived before labels are joined: a join then moves texts only where a query reads them.
    """
    known = files(spark, sf_dir, wide)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = F.col("id")
    return known.join(labels, d == labels["doc_id"], "left").select(
        *[c for c in known.columns if c != "sidecar_mtime_ns"],
        (F.coalesce("toxic", F.lit(0)) == 1).alias("nsfw"),
        (F.coalesce("quality", F.lit(0)) * 0.5 + (d % 50) / 100.0).alias("confidence"),
        "sidecar_mtime_ns",
    )


ITEMS_SQL = f"""
WITH base AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         ['{"', '".join(EXTENSIONS)}'][(d.doc_id % 5 + 1)::INT] AS ext,
         list_concat([d.lang, d.source], list_filter(regexp_split_to_array(lower(d.text), '[ \\n\\t]+'), lambda w: w <> '')[1:{FIRST_TAGS}]) AS raw_tags
  FROM documents d LEFT JOIN labels l USING (doc_id)
), typed AS (
  SELECT *, CASE WHEN ext = '.mp4' THEN 'video' WHEN ext = '.gif' OR (ext IN ('.png', '.webp') AND doc_id % 10 = 4) THEN 'gif' ELSE 'image' END AS media_type,
         lang || '_' || source || '-' || doc_id AS stem, lpad((doc_id % 12)::VARCHAR, 2, '0') || '-' || source AS category_folder,
         list_filter(raw_tags, lambda t, i: list_position(raw_tags, t) = i) AS tags
  FROM base
), items AS (
  SELECT doc_id AS id, '/lib/' || category_folder || '/' || media_type || '/' || stem || ext AS path, category_folder || '/' || media_type || '/' || stem || ext AS rel_path,
         stem || ext AS name, stem, ext, media_type, n_chars AS size_bytes, 1704067200000000000 + doc_id * 60000000000 AS mtime_ns,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-02-01' + to_seconds(doc_id * 7919 % 100000) AS indexed_at,
         CASE WHEN doc_id % 50 <> 0 THEN 400 + doc_id * 37 % 1600 END AS width, CASE WHEN doc_id % 50 <> 0 THEN 300 + doc_id * 91 % 6000 END AS height,
         CASE WHEN media_type <> 'image' THEN 1 + (doc_id * 13 % 2400) / 10.0::DOUBLE END AS duration_s, sha256(text) AS sha256,
         substr(split_part(text, chr(10), 1), 1, 120) AS title, substr(text, 121, 500) AS description, text AS ocr_text, tags, [lang] AS topics, [source] AS tone,
         ['{"', '".join(MEME_TYPES)}'][(doc_id % 10 + 1)::INT] AS meme_type, CASE WHEN doc_id % 7 = 0 THEN source END AS template, source AS category_name, category_folder,
         coalesce(toxic, 0) = 1 AS nsfw, coalesce(quality, 0) * 0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE AS confidence, doc_id * 3 AS sidecar_mtime_ns
  FROM typed
)"""


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("sha256"))
    return docs, docs.count()


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events: sha256 of the item and the time."""
    docs, n = _hashed(spark, sf_dir)
    events = table(spark, sf_dir, "events").where("event_type = 'view'")
    return events.select((F.col("event_id") % n).alias("item_id"), F.col("ts").cast("timestamp").alias("viewed_at"), "event_id").join(docs, "item_id").select("event_id", "sha256", "viewed_at")


VIEWS_SQL = """, views AS (
  SELECT e.event_id, i.sha256, e.ts AS viewed_at FROM events e JOIN items i ON e.event_id % (SELECT count(*) FROM documents) = i.id WHERE e.event_type = 'view'
)"""


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourite toggles: purchase sets, error clears."""
    docs, n = _hashed(spark, sf_dir)
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    return events.select((F.col("event_id") % n).alias("item_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", (F.col("event_type") == "purchase").alias("favorite")).join(docs, "item_id").select("event_id", "sha256", "favorite", "at")


TOGGLES_SQL = """, toggles AS (
  SELECT e.event_id, i.sha256, e.event_type = 'purchase' AS favorite, e.ts AS moment FROM events e JOIN items i ON e.event_id % (SELECT count(*) FROM documents) = i.id
  WHERE e.event_type IN ('purchase', 'error')
)"""


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    from medialake.operators.facets import favorites_state

    return favorites_state(toggles(spark, sf_dir))


FAVORITES_SQL = """, cleared AS (
  SELECT sha256, max(row(moment, event_id)) FILTER (NOT favorite) AS cleared FROM toggles GROUP BY sha256
), favorites AS (
  SELECT t.sha256, min(t.moment) AS created_at FROM toggles t JOIN cleared c USING (sha256)
  WHERE t.favorite AND (c.cleared IS NULL OR row(t.moment, t.event_id) > c.cleared) GROUP BY t.sha256
)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories: the first nine sources are 1 to 9, others is 10, nsfw 0 is pinned; two user categories and all later sources follow as pinned ones."""
    from pyspark.sql.window import Window

    sources = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", F.row_number().over(Window.orderBy("source")))
    found = sources.select(F.when(F.col("n") <= 9, F.col("n")).otherwise(F.col("n") + 3).cast("long").alias("id"), F.col("source").alias("name"))
    kept = [(0, "nsfw"), (10, "others"), (11, "user-a"), (12, "user-b")]
    # An array of literals, as rows given by the driver would start a Python worker on every core.
    fixed = spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for i, n in kept])))
    return found.unionByName(fixed).select(
        "id", "name", F.format_string("%02d-%s", "id", "name").alias("folder"), (F.col("id") * 3).alias("stored_count"), ((F.col("id") == 0) | (F.col("id") >= 11)).alias("pinned"), F.when(F.col("id") == 0, "nsfw").alias("rule")
    )


REGISTRY_SQL = """, registry AS (
  SELECT id, name, printf('%02d', id) || '-' || name AS folder, id * 3 AS stored_count, id = 0 OR id >= 11 AS pinned, CASE WHEN id = 0 THEN 'nsfw' END AS rule FROM (
    SELECT CASE WHEN n <= 9 THEN n ELSE n + 3 END AS id, source AS name FROM (SELECT source, row_number() OVER (ORDER BY source) AS n FROM (SELECT DISTINCT source FROM documents))
    UNION ALL VALUES (0, 'nsfw'), (10, 'others'), (11, 'user-a'), (12, 'user-b'))
)"""


def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of items, perturbed by id: absent, other size, other sidecar time, other path; 20 rows since removed."""
    now = items(spark, sf_dir).select("id", "path", "size_bytes", "mtime_ns", "sidecar_mtime_ns", "sha256")
    i = F.col("id")
    kept = now.where(i % 11 != 0).select(
        i.alias("id"),
        F.when((i % 13 != 0) & (i % 17 != 0) & (i % 19 == 0), F.concat(F.lit("/old"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(i % 13 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        "mtime_ns",
        F.when((i % 13 != 0) & (i % 17 == 0), F.lit(None).cast("long")).otherwise(F.col("sidecar_mtime_ns")).alias("sidecar_mtime_ns"),
        "sha256",
    )
    gone = spark.range(20).select((F.col("id") + 10_000_000).alias("id"), F.concat(F.lit("/gone/"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(1).cast("long").alias("sidecar_mtime_ns"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    return kept.unionByName(gone)


PREVIOUS_SQL = """, previous AS (
  SELECT id, CASE WHEN id % 13 <> 0 AND id % 17 <> 0 AND id % 19 = 0 THEN '/old' || path ELSE path END AS path, CASE WHEN id % 13 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes,
         mtime_ns, CASE WHEN id % 13 <> 0 AND id % 17 = 0 THEN NULL ELSE sidecar_mtime_ns END AS sidecar_mtime_ns, sha256 FROM items WHERE id % 11 <> 0
  UNION ALL SELECT 10000000 + r, '/gone/' || r, 1, 1, 1, sha256(r::VARCHAR) FROM range(20) t(r)
)"""

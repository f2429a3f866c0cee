"""Queries over normalisation, naming and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import geometry, text
from medialake.functions.media import MEME_TYPES
from medialake.operators import naming, normalize, sampling
from medialake.plans import fixtures as fx
from medialake.plans.registry import registering

I = fx.ITEMS_SQL
QUERIES, ORACLES, query = registering()

#: Analyses with odd values, derived from the documents.
RAW_SQL = I + """, raw AS (
  SELECT id, CASE WHEN id % 9 = 0 THEN '  ' ELSE replace(title, ' ', '_') END AS title, description, ocr_text, list_concat(list_transform(tags, lambda t: ' ' || t || '_X'), ['Meme', 'a-b', 'A_B', ' ', 'funny']) AS tags,
         CASE WHEN id % 4 = 0 THEN NULL ELSE tags END AS subjects, CASE WHEN id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE tone END AS tone, CASE WHEN id % 6 = 0 THEN [' '] ELSE topics END AS topics,
         CASE WHEN id % 7 = 0 THEN '  ' ELSE template END AS template, CASE WHEN id % 8 = 0 THEN '' ELSE upper(topics[1]) END AS language,
         CASE WHEN id % 10 = 0 THEN 'high' WHEN id % 10 = 1 THEN '1.7' WHEN id % 10 = 2 THEN '-0.2' ELSE '0.25' END AS confidence FROM items
)"""


def _clean_sql(column: str, most: int, generic: bool, default: str | None) -> str:
    plain = f"list_filter(list_transform(coalesce({column}, CAST([] AS VARCHAR[])), lambda t: trim(regexp_replace(lower(replace(replace(t, '_', ' '), '-', ' ')), '\\s+', ' ', 'g'))), lambda t: t <> ''{' AND t NOT IN (' + ', '.join(repr(g) for g in text.GENERIC_TAGS) + ')' if generic else ''})"
    cut = f"list_filter({plain}, lambda t, i: list_position({plain}, t) = i)[1:{most}]"
    joined = f"array_to_string({cut}, '|')"
    return f"coalesce(nullif({joined}, ''), '{default}')" if default else joined


def _raw(s, d):
    i = F.col("id")
    none = F.array().cast("array<string>")
    return fx.items(s, d).select(
        "id", F.when(i % 9 == 0, "  ").otherwise(F.replace("title", F.lit(" "), F.lit("_"))).alias("title"), "description", "ocr_text",
        F.concat(F.transform("tags", lambda t: F.concat(F.lit(" "), t, F.lit("_X"))), F.array(*map(F.lit, ("Meme", "a-b", "A_B", " ", "funny")))).alias("tags"),
        F.when(i % 4 != 0, F.col("tags")).alias("subjects"), F.when(i % 5 == 0, none).otherwise(F.col("tone")).alias("tone"), F.when(i % 6 == 0, F.array(F.lit(" "))).otherwise(F.col("topics")).alias("topics"),
        F.when(i % 7 == 0, "  ").otherwise(F.col("template")).alias("template"), F.when(i % 8 == 0, "").otherwise(F.upper(F.col("topics")[0])).alias("language"),
        F.when(i % 10 == 0, "high").when(i % 10 == 1, "1.7").when(i % 10 == 2, "-0.2").otherwise("0.25").alias("confidence"),
    )


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


@query(
    "c1_clip_to_limits",
    I + """ SELECT id, CASE WHEN length(title) > 40 THEN rtrim(title[1:40]) ELSE title END AS title, CASE WHEN length(description) > 100 THEN rtrim(description[1:100]) ELSE description END AS description, array_to_string(tags[1:3], '|') AS tags FROM items""",
)
def c1(s, d):
    return normalize.clip_to_limits(fx.items(s, d), {"title": 40, "description": 100}, {"tags": 3}).select("id", "title", "description", _joined("tags"))


@query("c2_clean_word_list", RAW_SQL + f" SELECT id, {_clean_sql('tags', 4, True, None)} AS tags, {_clean_sql('subjects', 3, False, None)} AS subjects FROM raw")
def c2(s, d):
    return _raw(s, d).select("id", text.clean_word_list(F.col("tags"), 4, True).alias("tags"), text.clean_word_list(F.col("subjects"), 3).alias("subjects")).select("id", _joined("tags"), _joined("subjects"))


@query(
    "c3_normalize_analysis",
    RAW_SQL + f""" SELECT id, {_clean_sql('tags', 10, True, 'uncategorized')} AS tags, {_clean_sql('tone', 4, False, 'neutral')} AS tone, {_clean_sql('topics', 3, False, 'general')} AS topics, {_clean_sql('subjects', 10, False, None)} AS subjects,
    nullif(trim(template), '') AS template, coalesce(nullif(trim(regexp_replace(replace(title, '_', ' '), '\\s+', ' ', 'g')), ''), 'untitled meme') AS title, coalesce(nullif(lower(trim(language)), ''), 'none') AS language,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(try_cast(confidence AS DOUBLE), 0.0))) AS confidence FROM raw""",
)
def c3(s, d):
    done = normalize.normalize_analysis(_raw(s, d))
    return done.select("id", *map(_joined, ("tags", "tone", "topics", "subjects")), "template", "title", "language", "confidence")


@query(
    "c4_validate_analysis",
    I + f""" SELECT id, concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'missing description' END, CASE WHEN id % 9 = 0 THEN 'long title' END, CASE WHEN id % 6 = 0 THEN 'many tags' END, CASE WHEN id % 8 = 0 AND id % 6 <> 0 THEN 'empty tags' END, CASE WHEN id % 10 = 3 THEN 'unknown meme_type' END,
    CASE WHEN id % 13 = 0 THEN 'confidence out of range' END, CASE WHEN id % 7 = 0 THEN 'unknown extra' END) AS violations FROM items""",
)
def c4(s, d):
    i = F.col("id")
    many = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda k: k.cast("string"))
    document = F.struct(
        F.when(i % 9 == 0, F.repeat(F.lit("x"), 130)).otherwise(F.lit("t")).alias("title"), F.when(i % 5 != 0, F.lit("d")).alias("description"), F.when(i % 6 == 0, many).when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("tags"),
        F.when(i % 10 == 3, F.lit("painting")).otherwise(F.lit(MEME_TYPES[0])).alias("meme_type"), F.lit(False).alias("nsfw"), F.when(i % 13 == 0, F.lit(1.5)).otherwise(F.lit(0.5)).alias("confidence"), F.when(i % 7 == 0, F.lit(1)).alias("extra"),
    )
    rows = fx.items(s, d).select("id", F.to_json(document).alias("analysis"))
    good, bad = normalize.validate_analysis(rows, "analysis")
    return good.select("id", F.lit("").alias("violations")).unionByName(bad.select("id", F.array_join("violations", "; ").alias("violations")))


SLUG_SQL = """, slugs AS (
  SELECT id, CASE WHEN cut = '' THEN 'meme' WHEN cut IN ('con', 'aux', 'nul', 'prn') THEN cut || '-meme' ELSE cut END AS slug FROM (
    SELECT id, CASE WHEN length(whole) <= 30 THEN whole ELSE trim(regexp_replace(whole[1:30], '-[^-]*$', ''), '-') END AS cut FROM (
      SELECT id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(CASE WHEN regexp_matches(t, '(?i)^(a|an|the) ') THEN regexp_replace(t, '(?i)^(a|an|the) ', '') ELSE t END), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS whole
      FROM (SELECT id, trim(regexp_replace(CASE WHEN id % 10 = 0 THEN 'The CON' WHEN id % 10 = 1 THEN '***' WHEN id % 10 = 2 THEN 'The ' || title ELSE title END, '\\s+', ' ', 'g')) AS t FROM items))))"""


def _slugs(s, d):
    i = F.col("id")
    title = F.when(i % 10 == 0, "The CON").when(i % 10 == 1, "***").when(i % 10 == 2, F.concat(F.lit("The "), "title")).otherwise(F.col("title"))
    return fx.items(s, d).select("id", "sha256", text.slugify(title, 30).alias("slug"))


@query("c5_slugify", I + SLUG_SQL + " SELECT id, slug FROM slugs")
def c5(s, d):
    return _slugs(s, d).select("id", "slug")


@query(
    "c6_resolve_collisions",
    I + """, rows AS (SELECT sha256 || '-' || id AS id, id AS arrival, stem[1:4] AS slug FROM items), held AS (SELECT stem[1:4] AS slug, min('x' || id) AS holder FROM items WHERE id % 50 = 3 GROUP BY 1
    ), first AS (SELECT r.*, h.holder, row_number() OVER (PARTITION BY r.slug ORDER BY arrival, r.id) AS nth FROM rows r LEFT JOIN held h USING (slug)
    ), asked AS (SELECT *, nth = 1 AND holder IS NULL AS free, CASE WHEN nth = 1 AND holder IS NULL THEN slug ELSE slug || '-' || id[1:6] END AS stem FROM first)
    SELECT id, slug, CASE WHEN NOT free AND row_number() OVER (PARTITION BY stem ORDER BY free DESC, arrival, id) > 1 THEN slug || '-' || id[1:12] ELSE stem END AS stem FROM asked""",
)
def c6(s, d):
    items = fx.items(s, d)
    rows = items.select(F.concat_ws("-", "sha256", F.col("id").cast("string")).alias("id"), F.col("id").alias("arrival"), F.substring("stem", 1, 4).alias("slug"))
    held = items.where("id % 50 = 3").select(F.substring("stem", 1, 4).alias("stem"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"))
    return naming.resolve_collisions(rows, held)


@query(
    "c7_sanitize_filename",
    """SELECT page_id, CASE WHEN error IS NULL THEN clean END AS name, error FROM (
      SELECT *, CASE WHEN clean = '' THEN 'empty' WHEN lower(split_part(clean, '.', 1)) IN ('con', 'aux', 'nul', 'prn') THEN 'reserved' END AS error FROM (
        SELECT page_id, trim(regexp_replace(trim(regexp_extract(raw, '([^/\\\\]*)$', 1)), '[<>:"|?*\\x00-\\x1F]', '', 'g'), ' .') AS clean FROM (
          SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'x/CON.txt' WHEN page_id % 5 = 1 THEN 'dir\\ a?b .' ELSE url END AS raw FROM pages)))""",
)
def c7(s, d):
    i = F.col("page_id")
    raw = F.when(i % 5 == 0, "x/CON.txt").when(i % 5 == 1, "dir\\ a?b .").otherwise(F.col("url"))
    return fx.table(s, d, "pages").select("page_id", text.sanitize_filename(raw).alias("f")).select("page_id", "f.name", "f.error")


@query(
    "c8_unique_names",
    I + """, rows AS (SELECT id, lang || ext AS name, lang AS stem, ext FROM (SELECT id, topics[1] AS lang, ext FROM items)), held AS (SELECT DISTINCT stem, ext, k FROM rows, (VALUES (0), (2), (3)) v(k) WHERE ext <> '.png'
    ), numbers AS (SELECT stem, ext, k, row_number() OVER (PARTITION BY stem, ext ORDER BY k) AS nth FROM (SELECT DISTINCT stem, ext FROM rows), range(0, (SELECT count(*) + 5 FROM rows)) r(k) WHERE (stem, ext, k) NOT IN (SELECT stem, ext, k FROM held))
    SELECT r.id, r.name, CASE WHEN n.k = 0 THEN r.name ELSE r.stem || '-' || n.k || r.ext END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY id) AS nth FROM rows) r JOIN numbers n USING (stem, ext, nth)""",
)
def c8(s, d):
    rows = fx.items(s, d).select("id", F.concat(F.col("topics")[0], F.col("ext")).alias("name"))
    held = fx.items(s, d).where("ext <> '.png'").select(F.col("topics")[0].alias("lang"), "ext").distinct()
    existing = held.select(F.explode(F.array(F.concat("lang", "ext"), F.concat("lang", F.lit("-2"), "ext"), F.concat("lang", F.lit("-3"), "ext"))).alias("name"))
    return naming.unique_names(rows, existing)


@query(
    "c9_search_docs",
    I + """ SELECT id, name, title, description, ocr_text, array_to_string(tags, ' ') || ' ' || meme_type || coalesce(' ' || template, '') AS tags, array_to_string(topics, ' ') AS topics, category_name AS category FROM items""",
)
def c9(s, d):
    return normalize.build_search_docs(fx.items(s, d))


@query(
    "c10_shape_item",
    I + """ SELECT id, round(CASE WHEN width > 0 AND height > 0 THEN width / height END, 6) AS aspect_ratio, CASE WHEN id % 8 <> 0 THEN category_name END AS category, 0 AS view_count FROM items""",
)
def c10(s, d):
    items = fx.items(s, d).withColumn("category_name", F.when(F.col("id") % 8 != 0, F.col("category_name")).otherwise(""))
    return normalize.shape_item(items).select("id", F.round("aspect_ratio", 6).alias("aspect_ratio"), F.col("category.name").alias("category"), "view_count")


@query(
    "c11_fit_within",
    I + """, scaled AS (SELECT id, width, height, least(1.0, sqrt(500000.0::DOUBLE / (width * height)), 1000.0::DOUBLE / greatest(width, height)) AS f FROM items WHERE width IS NOT NULL)
    SELECT id, greatest(1, round_even(width * f, 0)::BIGINT) AS width, greatest(1, round_even(height * f, 0)::BIGINT) AS height FROM scaled""",
)
def c11(s, d):
    return fx.items(s, d).where("width is not null").select("id", geometry.fit_within(F.col("width"), F.col("height"), 500_000, 1000).alias("b")).select("id", "b.width", "b.height")


@query(
    "c12_plan_tiles",
    I + """, known AS (SELECT id, width, height, greatest(width, height) AS long, least(width, height) AS short FROM items WHERE width > 0 AND height > 0
    ), counted AS (SELECT *, CASE WHEN long / short >= 2.5 AND long >= 1600 THEN least(4, ceil(long / greatest(1, 1000000 // short)))::BIGINT ELSE 1 END AS tiles FROM known
    ), boxes AS (SELECT *, unnest(range(tiles)) AS tile, ceil(long / tiles)::BIGINT AS step FROM counted
    ), cut AS (SELECT *, greatest(0, tile * step - CASE WHEN tile > 0 THEN 40 ELSE 0 END) AS b, least(long, (tile + 1) * step + CASE WHEN tile < tiles - 1 THEN 40 ELSE 0 END) AS e FROM boxes
    ), placed AS (SELECT id, tile, tiles, CASE WHEN height >= width THEN 0 ELSE b END AS x0, CASE WHEN height >= width THEN b ELSE 0 END AS y0, CASE WHEN height >= width THEN width ELSE e END AS x1, CASE WHEN height >= width THEN e ELSE height END AS y1 FROM cut
    ), fitted AS (SELECT *, least(1.0, sqrt(1000000.0::DOUBLE / ((x1 - x0) * (y1 - y0))), CASE WHEN tiles = 1 THEN 1600.0::DOUBLE / greatest(x1 - x0, y1 - y0) ELSE 1.0 END) AS f FROM placed
    ), sized AS (SELECT *, greatest(1, round_even((x1 - x0) * f, 0)::BIGINT) AS w, greatest(1, round_even((y1 - y0) * f, 0)::BIGINT) AS h FROM fitted
    ), total AS (SELECT *, sum(w * h) OVER (PARTITION BY id) AS t FROM sized
    ), shrunk AS (SELECT *, CASE WHEN t > 1500000 THEN sqrt(1500000.0::DOUBLE / t) ELSE 1.0 END AS g FROM total)
    SELECT id, tile, x0 AS "left", y0 AS "top", x1 AS "right", y1 AS "bottom", greatest(1, round_even(w * g, 0)::BIGINT) AS out_width, greatest(1, round_even(h * g, 0)::BIGINT) AS out_height FROM shrunk""",
)
def c12(s, d):
    return sampling.plan_tiles(fx.items(s, d), most_total=1_500_000)


@query(
    "c13_scale_to_budget",
    I + """, t AS (SELECT id, width, height, sum(width * height) OVER (PARTITION BY category_name) AS total FROM items WHERE width IS NOT NULL), f AS (SELECT *, CASE WHEN total > 20000000 THEN sqrt(20000000.0::DOUBLE / total) ELSE 1.0 END AS g FROM t)
    SELECT id, greatest(1, round_even(width * g, 0)::BIGINT) AS width, greatest(1, round_even(height * g, 0)::BIGINT) AS height FROM f""",
)
def c13(s, d):
    return sampling.scale_to_budget(fx.items(s, d).where("width is not null").select("id", "category_name", "width", "height"), "category_name", 20_000_000).select("id", "width", "height")


@query(
    "c14_evenly_spaced_sample",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
    SELECT conv_id, turn, place FROM p WHERE place IN (SELECT round_even(i * (total - 1) / (least(3, total) - 1)::DOUBLE, 0)::BIGINT FROM range(0, 3) r(i) WHERE i < least(3, total)) OR total = 1""",
)
def c14(s, d):
    return sampling.evenly_spaced_sample(fx.table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


@query(
    "c15_timeline_sample",
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, event_id FROM events), g AS (SELECT user_id, min(sec) AS zero, max(sec) - min(sec) AS span FROM e GROUP BY 1
    ), q AS (SELECT user_id, i, zero, round(i * greatest(0, span - 0.2) / 5, 3) AS instant FROM g, range(0, 6) r(i))
    SELECT q.user_id, q.i::INT AS i, round(q.instant, 3) AS instant, max_by(e.event_id, (e.sec, e.event_id)) AS event_id FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.sec <= q.zero + q.instant GROUP BY ALL""",
)
def c15(s, d):
    events = fx.table(s, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("at"), "event_id")
    return sampling.timeline_sample(events, "user_id", "at", "event_id", 6).select("user_id", "i", F.round("instant", 3).alias("instant"), F.col("value").alias("event_id"))


@query("c16_snap_size", I + " SELECT id, size FROM (SELECT id, s AS size, row_number() OVER (PARTITION BY id ORDER BY abs(s - width), s) AS k FROM items, (VALUES (160), (320), (640), (1280)) v(s) WHERE width IS NOT NULL) WHERE k = 1")
def c16(s, d):
    return fx.items(s, d).where("width is not null").select("id", geometry.snap_size(F.col("width"), [160, 320, 640, 1280]).alias("size"))

"""Queries over the categorisation pipeline, with a deterministic scorer in the model's place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from medialake.operators import categorize as cat
from medialake.operators.diff import plan_ingest
from medialake.plans import fixtures as fx
from medialake.plans.registry import registering

I, R = fx.ITEMS_SQL, fx.ITEMS_SQL + fx.REGISTRY_SQL
QUERIES, ORACLES, query = registering()

ANSWERS_SQL = R + ", answers AS (SELECT id, id % 12 AS category_id, (id * 7 % 100) / 100.0::DOUBLE AS confidence FROM items WHERE id % 23 <> 0)"
CURRENT_SQL = ANSWERS_SQL + """, current AS (SELECT id, title, nsfw, CASE WHEN id % 3 = 0 THEN id % 14 END AS category_id, CASE WHEN id % 3 = 0 THEN 0.7::DOUBLE END AS confidence, CASE WHEN id % 3 = 0 THEN 'hint' END AS source, CASE WHEN id % 3 = 0 THEN 'r0' END AS run_id FROM items
), final AS (SELECT a.id, CASE WHEN v.id IS NOT NULL AND confidence >= 0.5 THEN category_id ELSE 10 END AS category_id, confidence, CASE WHEN NOT (v.id IS NOT NULL AND confidence >= 0.5) THEN category_id END AS suggested FROM answers a LEFT JOIN registry v ON v.id = a.category_id)"""
APPLIED_SQL = CURRENT_SQL + """, applied AS (SELECT c.id, c.title, CASE WHEN nsfw AND coalesce(c.category_id, 0) < 11 THEN 0 ELSE coalesce(f.category_id, c.category_id) END AS category_id,
  CASE WHEN nsfw AND coalesce(c.category_id, 0) < 11 THEN 1.0 ELSE coalesce(f.confidence, c.confidence) END AS confidence, CASE WHEN nsfw AND coalesce(c.category_id, 0) < 11 THEN 'rule' WHEN f.id IS NOT NULL THEN 'model' ELSE c.source END AS source,
  CASE WHEN f.id IS NOT NULL OR (nsfw AND coalesce(c.category_id, 0) < 11) THEN 'r1' ELSE c.run_id END AS run_id, c.category_id AS old_id FROM current c LEFT JOIN final f ON c.id = f.id AND f.id % 2 = 0)"""


def _answers(s, d):
    i = F.col("id")
    return fx.items(s, d).where(i % 23 != 0).select("id", (i % 12).alias("category_id"), (i * 7 % 100 / 100.0).alias("confidence"))


def _current(s, d):
    i = F.col("id")
    third = lambda v: F.when(i % 3 == 0, v)
    return fx.items(s, d).select("id", "title", "nsfw", third(i % 14).alias("category_id"), third(F.lit(0.7)).alias("confidence"), third(F.lit("hint")).alias("source"), third(F.lit("r0")).alias("run_id"))


def _final(s, d):
    return cat.finalize_assignment(_answers(s, d), fx.registry(s, d), 10)


def _applied(s, d):
    return cat.apply_assignments(_current(s, d), _final(s, d).where("id % 2 = 0"), fx.registry(s, d), "r1")


def _joined(c):
    return F.array_join(c, "|").alias(c)


@query("g1_digest_records", I + " SELECT id, title, array_to_string(tags[1:8], '|') AS tags, meme_type, array_to_string(tone[1:3], '|') AS tone, array_to_string(topics[1:3], '|') AS topics, ocr_text[1:100] AS ocr FROM items")
def g1(s, d):
    return cat.digest_records(fx.items(s, d)).select("id", "title", _joined("tags"), "meme_type", _joined("tone"), _joined("topics"), "ocr")


@query(
    "g2_digest_stats",
    I + """, v AS (SELECT 'tags' AS facet, unnest(tags) AS value FROM items UNION ALL SELECT 'topics', unnest(topics) FROM items UNION ALL SELECT 'meme_type', meme_type FROM items UNION ALL SELECT 'tone', unnest(tone) FROM items
    ), r AS (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS rank FROM v GROUP BY 1, 2)
    SELECT facet, value, n, rank::INT AS rank FROM r WHERE rank <= CASE facet WHEN 'tags' THEN 60 WHEN 'topics' THEN 30 WHEN 'tone' THEN 20 ELSE 1000 END UNION ALL SELECT 'total', '', count(*), 1 FROM items""",
)
def g2(s, d):
    return cat.digest_stats(fx.items(s, d))


@query(
    "g3_stratified_sample",
    I + """, tags AS (SELECT DISTINCT id, unnest(tags) AS tag FROM items), top AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS r FROM tags GROUP BY tag ORDER BY r LIMIT 30
    ), best AS (SELECT id, max(r) AS r FROM tags JOIN top USING (tag) GROUP BY id), first AS (SELECT min_by(id, sha256('sample/' || id)) AS id FROM best GROUP BY r)
    SELECT id FROM items ORDER BY CASE WHEN id IN (SELECT id FROM first) THEN 0 ELSE 1 END, sha256('sample/' || id), id LIMIT 60""",
)
def g3(s, d):
    return cat.stratified_sample(fx.items(s, d), 60)


@query("g4_validate_discovery", "SELECT 'expected 9 categories, got ' || (count(*) + 4) || '; empty name; reserved name; repeated name' AS problems FROM (SELECT DISTINCT source FROM documents)")
def g4(s, d):
    names = fx.items(s, d).select(F.col("category_name").alias("name")).distinct()
    more = names.where("name = 'src1'").select(F.explode(F.array(F.lit("SRC1"), F.lit(" "), F.lit("Others"), F.lit("The SRC2"))).alias("name"))
    return cat.validate_discovery(names.unionByName(more), 9).select(F.array_join("problems", "; ").alias("problems"))


@query("g5_make_batches", I + " SELECT id, (row_number() OVER (ORDER BY id) - 1) // 12 AS batch FROM items")
def g5(s, d):
    return cat.make_batches(fx.items(s, d).select("id"))


def keyword_scorer(rows: pd.DataFrame) -> pd.DataFrame:
    """Stands for a model: one category a batch member, an invalid answer for some, an error for others."""
    if (rows["id"] % 97 == 0).any():
        raise RuntimeError("no answer")
    kept = rows[rows["id"] % 23 != 0]
    return pd.DataFrame({"id": kept["id"], "category_id": kept["id"] % 12, "confidence": (kept["id"] * 7 % 100) / 100.0})


@query(
    "g6_score_batches",
    I + """, b AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 12 AS batch FROM items), failed AS (SELECT DISTINCT batch FROM b WHERE id % 97 = 0)
    SELECT id, id % 12 AS category_id, (id * 7 % 100) / 100.0::DOUBLE AS confidence, batch, CAST(NULL AS VARCHAR) AS error FROM b WHERE batch NOT IN (SELECT batch FROM failed) AND id % 23 <> 0
    UNION ALL SELECT NULL, NULL, NULL, batch, 'RuntimeError: no answer' FROM failed""",
)
def g6(s, d):
    answers, failures = cat.score_batches(cat.make_batches(fx.items(s, d).select("id")), keyword_scorer, "id long, category_id long, confidence double")
    return answers.withColumn("error", F.lit(None).cast("string")).unionByName(failures, allowMissingColumns=True)


@query("g7_finalize_assignment", CURRENT_SQL + " SELECT * FROM final")
def g7(s, d):
    return _final(s, d)


@query("g8_missing_assignments", ANSWERS_SQL + " SELECT i.id, CASE WHEN i.id % 23 <> 0 THEN i.id % 12 WHEN i.id % 2 = 0 THEN 3 ELSE 10 END AS category_id, CASE WHEN i.id % 23 <> 0 THEN (i.id * 7 % 100) / 100.0::DOUBLE WHEN i.id % 2 = 0 THEN 0.9 ELSE 0 END AS confidence, CASE WHEN i.id % 23 = 0 AND i.id % 2 <> 0 THEN 'no valid assignment returned' END AS reason FROM items i")
def g8(s, d):
    items = fx.items(s, d)
    retried = items.where("id % 23 = 0 and id % 2 = 0").select("id", F.lit(3).cast("long").alias("category_id"), F.lit(0.9).alias("confidence"))
    return cat.missing_assignments(items, _answers(s, d), retried, 10)


@query(
    "g9_renumber_categories",
    CURRENT_SQL + """, n AS (SELECT r.id AS old_id, r.name, (SELECT count(*) FROM final f WHERE f.category_id = r.id) AS n FROM registry r WHERE r.id BETWEEN 1 AND 10
    ), k AS (SELECT *, CASE WHEN old_id = 10 THEN 10 ELSE row_number() OVER (PARTITION BY old_id = 10 ORDER BY n DESC, old_id) END AS id FROM n) SELECT old_id, id, name, lpad(id::VARCHAR, 2, '0') || '-' || name AS folder, n FROM k""",
)
def g9(s, d):
    counts = _final(s, d).groupBy("category_id").agg(F.count("*").alias("n"))
    return cat.renumber_categories(fx.registry(s, d).where("id between 1 and 10"), counts, 10)


@query("g10_split_pinned", CURRENT_SQL + " SELECT id, NOT (coalesce(category_id = 0 OR category_id >= 11, false) OR (category_id IS NULL AND nsfw)) AS assign FROM current")
def g10(s, d):
    inside, out = cat.split_pinned(_current(s, d))
    return inside.select("id", F.lit(True).alias("assign")).unionByName(out.select("id", F.lit(False).alias("assign")))


HINTS_SQL = R + """, hints AS (SELECT i.id, i.slug, r.id AS category_id FROM (SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'user-a' WHEN id % 5 = 2 THEN 'new-' || id % 3 ELSE category_folder END AS slug FROM items) i
  LEFT JOIN (SELECT slug, min(id) AS id FROM (SELECT id, unnest([name, folder]) AS slug FROM registry) GROUP BY 1) r USING (slug))"""


def _hints(s, d):
    i = F.col("id")
    folder = F.when(i % 5 == 1, "User A").when(i % 5 == 2, F.concat(F.lit("New "), (i % 3).cast("string"))).otherwise(F.col("category_folder"))
    files = fx.items(s, d).select("id", F.when(i % 5 == 0, F.col("name")).otherwise(F.concat_ws("/", folder, "name")).alias("rel_path"))
    return cat.resolve_hints(files, fx.registry(s, d))


@query("g11_resolve_hints", HINTS_SQL + " SELECT * FROM hints")
def g11(s, d):
    return _hints(s, d).select("id", "slug", "category_id")


@query("g12_new_user_categories", HINTS_SQL + " SELECT id, slug AS name, printf('%02d', id) || '-' || slug[1:30] AS folder FROM (SELECT slug, (SELECT max(id) FROM registry) + row_number() OVER (ORDER BY min(id), slug) AS id FROM hints WHERE slug IS NOT NULL AND category_id IS NULL GROUP BY slug)")
def g12(s, d):
    return cat.new_user_categories(_hints(s, d).withColumn("seen", F.col("id")), fx.registry(s, d))


@query(
    "g13_route_category",
    CURRENT_SQL + """ SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN 11 END, category_id, CASE WHEN nsfw THEN 0 END) AS routed_id, CASE WHEN id % 4 = 0 THEN 'hint' WHEN category_id IS NOT NULL THEN 'model' WHEN nsfw THEN 'rule' END AS source,
    CASE WHEN id % 4 = 0 OR (category_id IS NULL AND nsfw) THEN 1.0::DOUBLE END AS confidence FROM current""",
)
def g13(s, d):
    files = _current(s, d).select("id", "nsfw", "category_id", F.when(F.col("id") % 4 == 0, 11).cast("long").alias("hint_id"))
    return cat.route_category(files).select("id", "routed_id", "source", "confidence")


@query("g14_assign_scope", CURRENT_SQL + " SELECT id FROM current WHERE category_id IS NULL OR category_id NOT IN (SELECT id FROM registry)")
def g14(s, d):
    return cat.assign_scope(_current(s, d), fx.registry(s, d)).select("id")


@query("g15_apply_assignments", APPLIED_SQL + " SELECT a.id, category_id, confidence, source, run_id, category_id IS DISTINCT FROM old_id AS changed, r.folder FROM applied a LEFT JOIN registry r ON r.id = a.category_id")
def g15(s, d):
    return _applied(s, d)


@query("g16_category_counts", APPLIED_SQL + " SELECT r.id, r.name, (SELECT count(*) FROM applied a WHERE a.category_id = r.id AND NOT r.pinned) + (SELECT count(*) FROM current c WHERE c.category_id = r.id AND r.pinned) + (SELECT count(*) FROM applied a WHERE a.category_id = r.id AND r.pinned AND a.old_id IS DISTINCT FROM a.category_id) AS n FROM registry r")
def g16(s, d):
    applied = _applied(s, d)
    return cat.category_counts(fx.registry(s, d), applied, _current(s, d), applied.where("changed"))


@query("g17_preview", APPLIED_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY id) AS k, count(*) OVER (PARTITION BY category_id) AS n FROM applied WHERE category_id IS NOT NULL) SELECT category_id, any_value(n) AS n, string_agg(title, '|' ORDER BY id) AS titles FROM r WHERE k <= 5 GROUP BY category_id")
def g17(s, d):
    titled = _applied(s, d).join(fx.items(s, d).select("id", "title"), "id").where("category_id is not null")
    return cat.preview(titled).select("category_id", "n", _joined("titles"))


@query(
    "g18_merge_ocr",
    I + ", r AS (SELECT id, CASE WHEN id % 3 = 0 THEN '  ' ELSE ocr_text END AS a, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN NULL ELSE 'read ' || id END AS b FROM items) SELECT id, CASE WHEN trim(a) = '' THEN coalesce(nullif(trim(b), ''), a) ELSE a END AS fallback, trim(a) = '' AS fallback_ran, coalesce(nullif(trim(b), ''), a) AS always FROM r",
)
def g18(s, d):
    i = F.col("id")
    rows = fx.items(s, d).select("id", F.when(i % 3 == 0, "  ").otherwise(F.col("ocr_text")).alias("ocr_text"), F.when(i % 4 == 0, "").when(i % 4 != 1, F.concat(F.lit("read "), i.cast("string"))).alias("second_ocr"))
    one = cat.merge_ocr(rows, "fallback").select("id", F.col("ocr_text").alias("fallback"), F.col("ocr_ran").alias("fallback_ran"))
    return one.join(cat.merge_ocr(rows, "always").select("id", F.col("ocr_text").alias("always")), "id")


@query(
    "g19_run_summary",
    HINTS_SQL + """, plan AS (SELECT id, CASE WHEN sha256 IN (SELECT sha256 FROM items WHERE id % 6 = 0) THEN 'done' WHEN row_number() OVER (PARTITION BY sha256 ORDER BY lower(path), path) > 1 THEN 'duplicate' ELSE 'process' END AS action FROM items
    ), run AS (SELECT p.id, p.id % 9 <> 0 AS ok, h.slug IS NOT NULL AS hinted, h.category_id FROM plan p JOIN hints h USING (id) WHERE action = 'process')
    SELECT (SELECT count(*) FROM plan WHERE action = 'done') AS skipped_done, (SELECT count(*) FROM plan WHERE action = 'duplicate') AS skipped_duplicate, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND hinted) AS hinted,
    count(*) FILTER (ok AND category_id IS NOT NULL) AS categorized, (SELECT count(DISTINCT slug) FROM hints WHERE slug IS NOT NULL AND category_id IS NULL) AS categories_created FROM run""",
)
def g19(s, d):
    items = fx.items(s, d)
    plan = plan_ingest(items.select("path", "sha256"), items.where("id % 6 = 0").select("sha256")).join(items.select("path", "id"), "path")
    hints = _hints(s, d)
    run = plan.where("action = 'process'").join(hints.select("id", "slug", "category_id"), "id").select((F.col("id") % 9 != 0).alias("ok"), F.col("slug").isNotNull().alias("hinted"), "category_id")
    return cat.run_summary(plan, run, cat.new_user_categories(hints.withColumn("seen", F.col("id")), fx.registry(s, d)))

"""Queries over search: parsing, terms, filters, sorts, pages, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import facets, fuzzy, postings, rank, search
from medialake.operators.diff import rebuild_item_tags
from medialake.operators.normalize import build_search_docs
from medialake.operators.search_page import search_page
from medialake.operators.numbering import number_rows
from medialake.plans import fixtures as fx
from medialake.plans.registry import registering

I = fx.ITEMS_SQL
QUERIES, ORACLES, query = registering()

TERMS = ("ement", "tion")
DOCS_SQL = I + """, docs AS (
  SELECT id, lower(name) AS name, lower(title) AS title, lower(description) AS description, lower(ocr_text) AS ocr_text, lower(array_to_string(tags, ' ') || ' ' || meme_type || coalesce(' ' || template, '')) AS tags,
         lower(array_to_string(topics, ' ')) AS topics, lower(category_name) AS category FROM items
), sized AS (SELECT *, """ + " + ".join(f"greatest(0, length({f}) - 2)" for f in search.FIELDS) + """ AS size FROM docs)"""
TAGS_SQL = ", item_tags AS (SELECT DISTINCT item_id, lower(trim(t)) AS tag FROM (SELECT id AS item_id, unnest(tags) AS t FROM items) WHERE trim(t) <> '')"
VIEWS_SQL = fx.VIEWS_SQL + ", counts AS (SELECT sha256, count(*) AS view_count, max(viewed_at) AS last_viewed_at FROM views GROUP BY 1)"
MARKS_SQL = fx.TOGGLES_SQL + fx.FAVORITES_SQL


def _any(term: str) -> str:
    return "(" + " OR ".join(f"contains({f}, {term})" for f in search.FIELDS) + ")"


def _frequency(term: str) -> str:
    return " + ".join(f"{w} * len(list_filter(range(1, greatest(2, length({f}) - length({term}) + 2)), lambda i: substr({f}, i, length({term})) = {term}))" for f, w in rank.WEIGHTS.items())


def _count(term: str, looped: str) -> str:
    """Weighted places of a term: by what is left without it, or place by place if it may overlap itself."""
    one = lambda f: f"CASE WHEN NOT contains({f}, {term}) THEN 0 WHEN {looped} THEN len(list_filter(range(1, greatest(2, length({f}) - length({term}) + 2)), lambda i: {f}[i:i + length({term}) - 1] = {term})) ELSE (length({f}) - length(replace({f}, {term}, ''))) // length({term}) END"
    return " + ".join(f"{w} * ({one(f)})" for f, w in rank.WEIGHTS.items())


def _part(having: str, frequency: str) -> str:
    idf = f"greatest(1e-6, ln(((SELECT count(*) FROM sized) - {having} + 0.5) / ({having} + 0.5)))"
    return f"{idf} * {frequency} * 2.2 / ({frequency} + 1.2 * (0.25 + 0.75 * size / (SELECT avg(size) FROM sized)))"


def bm25_sql(terms: tuple[str, ...]) -> str:
    """CTE ``ranked`` (id, score) after DOCS_SQL."""
    freqs = ", ".join(f"({_frequency(repr(t))}) AS f{k}" for k, t in enumerate(terms))
    score = " + ".join(_part(f"(SELECT count(*) FROM sized WHERE {_any(repr(t))})", f"f{k}") for k, t in enumerate(terms))
    return f", counted AS (SELECT *, {freqs} FROM sized WHERE {' AND '.join(_any(repr(t)) for t in terms)}), ranked AS (SELECT id, -({score}) AS score FROM counted)"


def _docs(s, d):
    return build_search_docs(fx.files(s, d, True))


def _tags(s, d):
    return rebuild_item_tags(fx.files(s, d))


def _views(s, d):
    return facets.view_counts(fx.views(s, d))


LOG = ("excel powerpoint", "type:gif,video cat:src1 tag:De", "TYPE:GIF is:fav the", "is:nsfw x", "is:unknown", "type:", "x" * 201, " ".join("abcdefghijklm"), "_ %", "cat:SRC2, ,src3 is:FAV")


@query(
    "d1_parse_query_log",
    "WITH log AS (SELECT item_id, ([" + ", ".join(repr(q) for q in LOG) + "])[(item_id % 10 + 1)::INT] || ' ' || text AS q FROM benchmark), t AS (SELECT *, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS toks FROM log), "
    + "p AS (SELECT *, " + ", ".join(f"list_filter(list_transform(flatten(list_transform(list_filter(toks, lambda x: regexp_matches(x, '(?i)^{k}:.+$')), lambda x: string_split(regexp_extract({f}, '^[A-Za-z]+:(.+)$', 1), ','))), lambda v: trim(v)), lambda v: v <> '') AS {n}"
                             for k, n, f in (("type", "types", "lower(x)"), ("cat", "cats", "x"), ("tag", "tags", "x"), ("is", "states", "lower(x)"))) + " FROM t) "
    + "SELECT item_id, array_to_string(types, '|') AS type, array_to_string(cats, '|') AS category, array_to_string(tags, '|') AS tag, CASE WHEN list_contains(states, 'fav') THEN true END AS favorite, CASE WHEN list_contains(states, 'nsfw') THEN 'only' END AS nsfw, "
    + "array_to_string(list_filter(toks, lambda x: NOT regexp_matches(x, '(?i)^(type|cat|tag|is):.+$')), ' ') AS text, length(q) <= 200 AND len(toks) <= 12 AS valid FROM p",
)
def d1(s, d):
    log = fx.table(s, d, "benchmark").select("item_id", F.concat(F.get(F.array(*map(F.lit, LOG)), (F.col("item_id") % 10).cast("int")), F.lit(" "), "text").alias("q"))
    done = search.parse_query_log(log, "q")
    return done.select("item_id", *[F.array_join(c, "|").alias(c) for c in ("type", "category", "tag")], "favorite", "nsfw", "text", "valid")


@query("d2_match_all_terms", DOCS_SQL + f" SELECT id FROM docs WHERE {_any(repr('src1'))} AND {_any(repr('the'))}")
def d2(s, d):
    return search.match_all_terms(_docs(s, d), ("SRC1", "the")).select("id")


@query("d3_match_short_terms", DOCS_SQL + " SELECT id FROM docs WHERE (contains(name, '_s') OR contains(title, '_s')) AND (contains(name, 'th') OR contains(title, 'th'))")
def d3(s, d):
    return search.match_short_terms(_docs(s, d), ("_s", "th")).select("id")


@query("d4_bm25_rank", DOCS_SQL + bm25_sql(TERMS) + " SELECT id, round(score, 6) AS score FROM ranked")
def d4(s, d):
    return rank.bm25_rank(_docs(s, d), TERMS).select("id", F.round("score", 6).alias("score"))


def _simple(name, sql, f):
    query(name, I + TAGS_SQL + sql)(lambda s, d: f(s, d).select("id"))


_simple("d5_filter_types", " SELECT id FROM items WHERE media_type IN ('gif', 'video')", lambda s, d: search.filter_types(fx.items(s, d), ("gif", "video")))
_simple("d6_filter_categories", " SELECT id FROM items WHERE category_name IN ('src1', 'src2')", lambda s, d: search.filter_categories(fx.items(s, d), ("src1", "src2")))
_simple("d7_filter_tags", " SELECT id FROM items WHERE id IN (SELECT item_id FROM item_tags WHERE tag = 'de') AND id IN (SELECT item_id FROM item_tags WHERE tag = 'src3')", lambda s, d: search.filter_tags(fx.items(s, d), _tags(s, d), (" De", "src3")))
_simple("d9_filter_nsfw", " SELECT id FROM items WHERE NOT nsfw", lambda s, d: search.filter_nsfw(fx.items(s, d), "no such mode"))
_simple("d10_filter_duration", " SELECT id FROM items WHERE duration_s >= 20 AND duration_s <= 100.5", lambda s, d: search.filter_duration(fx.items(s, d), 20.0, 100.5))
_simple("d11_filter_since", " SELECT id FROM items WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00'", lambda s, d: search.filter_since(fx.items(s, d), "2024-01-01 01:00:00"))


@query("d8_filter_favorite", I + MARKS_SQL + " SELECT id FROM items WHERE sha256 IN (SELECT sha256 FROM favorites)")
def d8(s, d):
    return search.filter_favorite(fx.items(s, d), fx.favorites(s, d), True).select("id")


ORDERS = {"newest": "created_at DESC", "oldest": "created_at", "name": "lower(name)", "size": "size_bytes DESC", "duration": "duration_s DESC NULLS LAST", "random": "(id * 2654435761 + 42) % 999999937"}


def _sorted(name: str, sort: str) -> None:
    sql = f" SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY {ORDERS[sort]}, id) AS rank FROM items) WHERE rank BETWEEN 21 AND 70"
    query(name, I + sql)(lambda s, d: search.page(fx.items(s, d), search.sort_order(sort, 42), 50, 20).select("id", "rank"))


for _name, _sort in (("d12_sort_newest", "newest"), ("d12_sort_oldest", "oldest"), ("d13_sort_name", "name"), ("d14_sort_size", "size"), ("d14_sort_duration", "duration"), ("d15_sort_random", "random")):
    _sorted(_name, _sort)


@query("d16_page_total", I + " SELECT id, rank, (SELECT count(*) FROM items WHERE NOT nsfw) AS total FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM items WHERE NOT nsfw) WHERE rank BETWEEN 11 AND 40")
def d16(s, d):
    found = search.filter_nsfw(fx.items(s, d), "exclude")
    return search.page(found, search.sort_order("newest"), 30, 10).select("id", "rank").crossJoin(F.broadcast(search.total(found)))


@query("d17_random_one", I + f" SELECT id FROM items WHERE media_type = 'gif' ORDER BY {ORDERS['random']}, id LIMIT 1")
def d17(s, d):
    return search.page(search.filter_types(fx.items(s, d), ("gif",)), search.sort_order("random", 42), 1).select("id")


def _query_log(s, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: F.char_length(w) >= 3)
    return fx.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(words, 1, 2).alias("terms"))


def typo_log(s, d):
    """Queries with a typo: the third character of the first word goes."""
    return _query_log(s, d).withColumn("q", F.array_join("terms", " ")).select("query_id", F.expr("concat(substring(q, 1, 2), substring(q, 4))").alias("q"))


@query("d18_fuzzy_match")
def d18(s, d):
    return fuzzy.fuzzy_match(fx.items(s, d, True), typo_log(s, d))


@query("d19_fuzzy_candidates")
def d19(s, d):
    left = _query_log(s, d).select(F.explode("terms").alias("word")).select(F.lower("word").alias("word")).distinct()
    return fuzzy.fuzzy_candidates(left, _tags(s, d).select(F.col("tag").alias("word")).distinct())


@query(
    "d20_search_page",
    DOCS_SQL + bm25_sql(TERMS) + VIEWS_SQL + MARKS_SQL + """, hits AS (SELECT i.id, i.sha256, r.score, row_number() OVER (ORDER BY r.score, i.id) AS rank, count(*) OVER () AS total FROM items i JOIN ranked r USING (id) WHERE NOT nsfw)
    SELECT id, rank, round(score, 6) AS score, coalesce(view_count, 0) AS view_count, sha256 IN (SELECT sha256 FROM favorites) AS favorite, total, false AS fuzzy_used FROM hits LEFT JOIN counts USING (sha256) WHERE rank <= 20""",
)
def d20(s, d):
    page = search_page(fx.items(s, d, True), " ".join(TERMS), _tags(s, d), fx.favorites(s, d), _views(s, d), limit=20)
    return page.select("id", "rank", F.round("score", 6).alias("score"), "view_count", "favorite", F.col("total").cast("long").alias("total"), "fuzzy_used")


@query("d20_search_fuzzy_top_up")
def d20_fuzzy(s, d):
    page = search_page(fx.items(s, d, True), "en src1 thnterble zz", _tags(s, d), fx.favorites(s, d), _views(s, d), limit=20)
    return page.select("id", "rank", "view_count", "favorite", "total", "fuzzy_used")


@query(
    "d21_enrich",
    I + VIEWS_SQL + MARKS_SQL + """ SELECT id, coalesce(view_count, 0) AS view_count, strftime(last_viewed_at, '%Y-%m-%d %H:%M:%S') AS last_viewed_at, sha256 IN (SELECT sha256 FROM favorites) AS favorite FROM items LEFT JOIN counts USING (sha256)""",
)
def d21(s, d):
    return search.enrich(fx.items(s, d), _views(s, d), fx.favorites(s, d)).select("id", "view_count", F.date_format("last_viewed_at", "yyyy-MM-dd HH:mm:ss").alias("last_viewed_at"), "favorite")


@query("d22_items_by_ids", I + " SELECT id, name FROM items WHERE id IN (SELECT item_id FROM benchmark) UNION ALL SELECT id, name || '*' FROM items WHERE sha256 = (SELECT min(sha256) FROM items)")
def d22(s, d):
    items = fx.items(s, d)
    least = items.agg(F.min("sha256")).first()[0]
    chosen = search.items_by_ids(items, fx.table(s, d, "benchmark").select(F.col("item_id").alias("id")))
    return chosen.select("id", "name").unionByName(search.item_by_sha(items, least).select("id", F.concat("name", F.lit("*")).alias("name")))


@query("d23_item_detail", I + " SELECT id, title, count(*) OVER (PARTITION BY sha256) - 1 AS copies, min(id) OVER (PARTITION BY sha256) AS content_class FROM items")
def d23(s, d):
    items = fx.items(s, d)
    return search.item_detail(items, items).select("id", "title", "copies", "content_class")


@query(
    "d24_search_sidecars",
    I + """, f AS (SELECT id, name, [lower(title), lower(description), lower(ocr_text), lower(array_to_string(tags, ' ')), lower(array_to_string(tags[3:], ' ')), lower(array_to_string(topics, ' '))] AS fields FROM items
      WHERE lower(category_name) = 'src1' AND media_type = 'image' AND list_contains(list_transform(tags, lambda t: lower(t)), 'en'))
    , scored AS (SELECT id, name, len(list_filter(fields, lambda x: contains(x, 'th') AND contains(x, 'er'))) AS score FROM f) SELECT id, score::INT AS score, row_number() OVER (ORDER BY score DESC, lower(name), id)::INT AS rank FROM scored WHERE score > 0""",
)
def d24(s, d):
    sidecars = fx.items(s, d).withColumn("subjects", F.slice("tags", 3, 100))
    found = search.search_sidecars(sidecars, "TH er", ("EN",), "SRC1", None, "image")
    ranked = number_rows(found.select("id", "name", "score"), [F.desc("score"), F.lower("name"), F.col("id")], "rank")
    return ranked.select("id", "score", (F.col("rank") + 1).cast("int").alias("rank"))


@query(
    "d25_batch_search",
    DOCS_SQL + f""", asked AS (SELECT DISTINCT query_id, lower(w) AS term FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) >= 3)[1:2]) AS w FROM benchmark)
    ), terms AS (SELECT term, len(list_filter(range(1, length(term)), lambda i: left(term, i) = right(term, i))) > 0 AS looped FROM (SELECT DISTINCT term FROM asked)
    ), hits AS (SELECT term, id, size, {_count("term", "looped")} AS f FROM terms JOIN sized ON {_any("term")}
    ), parts AS (SELECT h.term, id, {_part("n.n", "f")} AS part FROM hits h JOIN (SELECT term, count(*) AS n FROM hits GROUP BY 1) n USING (term)
    ), scored AS (SELECT query_id, id, -sum(part) AS score FROM asked a JOIN parts p USING (term) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM asked b WHERE b.query_id = a.query_id)
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM scored) SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)
def d25(s, d):
    return postings.batch_search(_docs(s, d), _query_log(s, d)).withColumn("score", F.round("score", 6))

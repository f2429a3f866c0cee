"""A whole search: filters, terms, ranking, one page, and a fuzzy top-up when little is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.operators import search
from medialake.operators.fuzzy import fuzzy_match
from medialake.operators.normalize import build_search_docs
from medialake.operators.rank import bm25_rank
from medialake.plans.shared import stored

#: Hits of a first page below which fuzzy ones are added, and shortest text for it.
FEW_HITS = 5
FUZZY_TEXT = 3
#: Columns that the orders of a page need.
ORDERED = ("id", "created_at", "name", "size_bytes", "duration_s")


def matches(items: DataFrame, parsed: search.ParsedQuery, item_tags: DataFrame, favorites: DataFrame) -> DataFrame:
    """Items that pass the filters and hold all terms, with score (null without long terms)."""
    found = search.apply_filters(items, parsed.filters, item_tags, favorites)
    docs = build_search_docs(items)
    if parsed.short_terms:
        found = found.join(search.match_short_terms(docs, parsed.short_terms).select("id"), "id", "left_semi")
    if parsed.long_terms:
        return found.join(bm25_rank(docs, parsed.long_terms), "id")
    return found.withColumn("score", F.lit(None).cast("double"))


def search_page(
    items: DataFrame, text: str, item_tags: DataFrame, favorites: DataFrame, view_counts: DataFrame, filters: search.Filters | None = None, sort: str | None = None, limit: int = 100, offset: int = 0, seed: int = 0
) -> DataFrame:
    """One page with rank, view_count, favorite, score, total and fuzzy_used.

    Fuzzy rows pass the same filters as others; they come after them, on the first page only.
    """
    parsed = search.parse_query(items.sparkSession, text, filters)
    order = search.sort_order(sort or ("relevance" if parsed.long_terms else "newest"), seed)
    # What was found is written once, without texts: the count, the page and the top-up read it from there.
    found = stored(matches(items, parsed, item_tags, favorites).select(*ORDERED, "score"))
    number = found.count()
    top = search.page(found, order, limit, offset).select("id", "rank", "score")
    words = " ".join((*parsed.long_terms, *parsed.short_terms))
    added = 0
    if offset == 0 and len(words) >= FUZZY_TEXT and number < FEW_HITS:
        query = items.sparkSession.createDataFrame([(0, words)], "query_id int, q string")
        allowed = search.apply_filters(items, parsed.filters, item_tags, favorites)
        room = limit - min(limit, number)
        near = fuzzy_match(allowed, query).join(found.select("id"), "id", "left_anti").orderBy("rank").limit(room)
        placed = F.row_number().over(Window.orderBy("rank")) + number
        extra = stored(near.select("id", placed.cast("long").alias("rank"), F.lit(None).cast("double").alias("score")))
        added = extra.count()
        top = top.unionByName(extra)
    # At most a page of ids: the limits of PAGE bound them.
    rows = items.join(F.broadcast(top), "id")
    return search.enrich(rows, view_counts, favorites).withColumns({"total": F.lit(number + added), "fuzzy_used": F.lit(added > 0)})

"""Search over the item table: terms, filters, sorts, pages and enrichment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("name", "title", "description", "ocr_text", "tags", "topics", "category")
MOST_QUERY_CHARS = 200
MOST_QUERY_TERMS = 12
#: Characters from which a term is looked up in all fields; shorter ones only in name and title.
LONG_TERM = 3
PAGE = (1, 500)


class QueryTooComplexError(ValueError):
    """The query has too many characters or terms."""


@dataclass(frozen=True)
class Filters:
    """What a search narrows down to; empty means no limit. nsfw: exclude, only or include."""

    type: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    favorite: bool | None = None
    nsfw: str = "exclude"
    min_duration: float | None = None
    max_duration: float | None = None
    since: str | None = None


@dataclass(frozen=True)
class ParsedQuery:
    """Long and short terms of a query text and its filters."""

    long_terms: tuple[str, ...] = ()
    short_terms: tuple[str, ...] = ()
    filters: Filters = field(default_factory=Filters)


def parse_query_log(df: DataFrame, column: str) -> DataFrame:
    """``df`` with type, category, tag, favorite, nsfw, text, valid parsed from a column of query strings.

    ``type:``, ``cat:`` and ``tag:`` take comma lists, ``is:`` takes fav or nsfw and swallows the rest.
    A query over the limits of characters or terms is not valid.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\s+"), lambda t: t != "")
    operator = r"(?i)^(type|cat|tag|is):(.+)$"
    rest = F.filter(tokens, lambda t: ~t.rlike(operator))

    def values(key: str, low: bool = False) -> Column:
        own = F.filter(tokens, lambda t: t.rlike(f"(?i)^{key}:.+$"))
        parts = F.flatten(F.transform(own, lambda t: F.split(F.regexp_extract(t, operator, 2), ",")))
        kept = F.filter(F.transform(parts, lambda v: F.trim(F.lower(v) if low else v)), lambda v: v != "")
        return kept

    states = values("is", True)
    return df.withColumns(
        {
            "type": values("type", True),
            "category": values("cat"),
            "tag": values("tag"),
            "favorite": F.when(F.array_contains(states, "fav"), True),
            "nsfw": F.when(F.array_contains(states, "nsfw"), "only"),
            "text": F.array_join(rest, " "),
            "valid": (F.char_length(F.coalesce(F.col(column), F.lit(""))) <= MOST_QUERY_CHARS) & (F.size(tokens) <= MOST_QUERY_TERMS),
        }
    )


def parse_query(spark, text: str, filters: Filters | None = None) -> ParsedQuery:
    """One query as given by a user; values of operators are added to ``filters``."""
    filters = filters or Filters()
    row = parse_query_log(spark.createDataFrame([(text,)], "q string"), "q").first()
    if not row["valid"]:
        raise QueryTooComplexError(f"at most {MOST_QUERY_CHARS} characters and {MOST_QUERY_TERMS} terms")
    merged = Filters(
        (*filters.type, *row["type"]), (*filters.category, *row["category"]), (*filters.tag, *row["tag"]), filters.favorite if row["favorite"] is None else row["favorite"],
        row["nsfw"] or filters.nsfw, filters.min_duration, filters.max_duration, filters.since,
    )
    terms = row["text"].split()
    return ParsedQuery(tuple(t for t in terms if len(t) >= LONG_TERM), tuple(t for t in terms if len(t) < LONG_TERM), merged)


def holds(column: str, term: str) -> Column:
    return F.contains(F.lower(column), F.lit(term.lower()))


def match_all_terms(docs: DataFrame, terms: list[str] | tuple[str, ...], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows in which every term stands in some field, whatever its case."""
    for term in terms:
        found = F.lit(False)
        for f in fields:
            found = found | holds(f, term)
        docs = docs.where(found)
    return docs


def match_short_terms(docs: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows in which every term stands in name or title; no sign is a wildcard."""
    return match_all_terms(docs, terms, ("name", "title"))


def filter_types(items: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return items.where(F.col("media_type").isin(*types)) if types else items


def filter_categories(items: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return items.where(F.col("category_name").isin(*names)) if names else items


def filter_tags(items: DataFrame, item_tags: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Rows that have every tag."""
    for tag in tags:
        own = item_tags.where(F.col("tag") == tag.strip().lower()).select("item_id")
        items = items.join(own, items["id"] == own["item_id"], "left_semi")
    return items


def filter_favorite(items: DataFrame, favorites: DataFrame, favorite: bool | None) -> DataFrame:
    return items.join(favorites.select("sha256"), "sha256", "left_semi") if favorite else items


def filter_nsfw(items: DataFrame, mode: str | None) -> DataFrame:
    """only, include, or anything else to exclude."""
    if mode == "include":
        return items
    return items.where(F.col("nsfw") if mode == "only" else ~F.col("nsfw"))


def filter_duration(items: DataFrame, least: float | None, most: float | None) -> DataFrame:
    if least is not None:
        items = items.where(F.col("duration_s") >= least)
    return items if most is None else items.where(F.col("duration_s") <= most)


def filter_since(items: DataFrame, since: str | None) -> DataFrame:
    return items.where(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else items


def apply_filters(items: DataFrame, filters: Filters, item_tags: DataFrame, favorites: DataFrame) -> DataFrame:
    items = filter_since(filter_duration(filter_nsfw(items, filters.nsfw), filters.min_duration, filters.max_duration), filters.since)
    items = filter_categories(filter_types(items, filters.type), filters.category)
    return filter_favorite(filter_tags(items, item_tags, filters.tag), favorites, filters.favorite)


def sort_order(sort: str, seed: int = 0) -> list[Column]:
    """Columns of a total order; id breaks ties."""
    orders = {
        "relevance": [F.col("score").asc()],
        "newest": [F.desc("created_at")],
        "oldest": [F.asc("created_at")],
        "name": [F.lower("name").asc()],
        "size": [F.desc("size_bytes")],
        "duration": [F.desc_nulls_last("duration_s")],
        "random": [random_key(F.col("id"), seed)],
    }
    return [*orders[sort], F.col("id")]


def random_key(number: Column, seed: int) -> Column:
    """A key that is stable for a seed; decimals, so that no id overflows."""
    return F.pmod(number.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)") + F.lit(seed), F.lit(999999937)).cast("long")


def page(items: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a total order, with each row's place in the whole order as ``rank``."""
    limit, offset = min(max(limit, PAGE[0]), PAGE[1]), max(offset, 0)
    top = items.orderBy(*order).offset(offset).limit(limit)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) + offset).cast("long"))


def total(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"))


def enrich(items: DataFrame, view_counts: DataFrame, favorites: DataFrame) -> DataFrame:
    """``items`` with view_count, last_viewed_at and favorite by content."""
    marked = favorites.select("sha256", F.lit(True).alias("favorite")).distinct()
    joined = items.join(view_counts.select("sha256", "view_count", "last_viewed_at"), "sha256", "left").join(marked, "sha256", "left")
    return joined.withColumns({"view_count": F.coalesce("view_count", F.lit(0)), "favorite": F.coalesce("favorite", F.lit(False))})


def items_by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def item_by_sha(items: DataFrame, sha256: str) -> DataFrame:
    return items.where(F.col("sha256") == sha256)


def item_detail(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted items with the number of other items of equal content and the class of that content (its smallest id)."""
    content = items.groupBy("sha256").agg((F.count("*") - 1).alias("copies"), F.min("id").alias("content_class"))
    return items_by_ids(items, ids).join(content, "sha256")


def items_of_content(items: DataFrame, ids: DataFrame) -> DataFrame:
    """(content_class, id): the members of the content classes of the wanted items, a row each."""
    wanted = item_detail(items, ids).select("sha256", "content_class").distinct()
    return items.select("sha256", "id").join(wanted, "sha256").select("content_class", "id")


def _standing_in(text: Column):
    return lambda word: F.contains(text, word)


def search_sidecars(sidecars: DataFrame, query: str, tags: tuple[str, ...] = (), category: str | None = None, meme_type: str | None = None, media_type: str | None = None) -> DataFrame:
    """Sidecars with the number of text fields that hold all words as ``score``; 1 for an empty query, none at 0."""
    words = F.array(*map(F.lit, query.lower().split())).cast("array<string>")
    fields = [F.lower(c) for c in ("title", "description", "ocr_text")] + [F.lower(F.array_join(c, " ")) for c in ("tags", "subjects", "topics")]
    score = F.lit(0)
    for f in fields:
        score = score + F.when(F.forall(words, _standing_in(f)), 1).otherwise(0)
    found = sidecars.withColumn("score", score if query.split() else F.lit(1)).where("score > 0")
    for tag in tags:
        found = found.where(F.array_contains(F.transform("tags", lambda t: F.lower(t)), tag.lower()))
    if category is not None:
        found = found.where(F.lower("category_name") == category.lower())
    if meme_type is not None:
        found = found.where(F.col("meme_type") == meme_type)
    return found if media_type is None else found.where(F.col("media_type") == media_type)

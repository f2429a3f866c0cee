"""Counts, facets, suggestions and collections over the item table."""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.operators.numbering import number_rows
from medialake.plans.shared import stored

MEDIA_TYPES = ("image", "gif", "video")


def library_stats(items: DataFrame, favorites: DataFrame) -> DataFrame:
    """One row: total, bytes, nsfw and favourite rows (those without an item too)."""
    counted = items.agg(F.count("*").alias("total"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if("nsfw").alias("nsfw"))
    return counted.crossJoin(F.broadcast(favorites.agg(F.count("*").alias("favorites"))))


def counts_by_type(items: DataFrame) -> DataFrame:
    """A row for each media type, 0 where there is none."""
    counts = items.agg(*[F.count_if(F.col("media_type") == t).alias(t) for t in MEDIA_TYPES])
    return counts.unpivot([], list(MEDIA_TYPES), "media_type", "n")


def counts_by_category(items: DataFrame) -> DataFrame:
    return items.where("category_name is not null").groupBy("category_name").agg(F.min("category_folder").alias("folder"), F.count("*").alias("n"))


def tag_counts(item_tags: DataFrame, containing: str | None = None, limit: int = 100) -> DataFrame:
    """The most frequent tags (1 to 500), ties by tag, with their rank."""
    if containing:
        item_tags = item_tags.where(F.contains("tag", F.lit(containing.strip().lower())))
    order = [F.desc("n"), F.col("tag")]
    top = item_tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(*order).limit(min(max(limit, 1), 500))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def category_listing(items: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Categories in the registry's order with live counts, its stored counts where there are none."""
    live = counts_by_category(items)
    if registry is None:
        return live.select(F.row_number().over(Window.orderBy("category_name")).cast("long").alias("id"), F.col("category_name").alias("name"), "folder", "n")
    joined = registry.join(live.select("category_name", "n"), registry["name"] == F.col("category_name"), "left")
    return joined.select("id", "name", "folder", F.coalesce("n", "stored_count").alias("n"))


def suggest(items: DataFrame, item_tags: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Titles, tags, file names and categories that hold a text, in this order, ``limit`` in all (1 to 50)."""
    limit = min(max(limit, 1), 50)
    kinds = (("title", items.select(F.col("title").alias("value"))), ("tag", item_tags.select(F.col("tag").alias("value"))), ("name", items.select(F.col("name").alias("value"))), ("category", items.select(F.col("category_name").alias("value"))))
    parts = []
    for k, (kind, values) in enumerate(kinds):
        hit = values.where(F.contains(F.lower("value"), F.lit(text.lower()))).distinct().orderBy("value").limit(limit)
        parts.append(hit.select(F.lit(k).alias("k"), F.lit(kind).alias("kind"), "value"))
    top = functools.reduce(DataFrame.unionByName, parts).orderBy("k", "value").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("k", "value"))).select("rank", "kind", "value")


def _top(rows: DataFrame, limit: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def recent_added(items: DataFrame, limit: int) -> DataFrame:
    return _top(items, limit, F.desc("indexed_at"), F.col("id"))


def recent_viewed(items: DataFrame, view_counts: DataFrame, limit: int) -> DataFrame:
    return _top(items.join(view_counts, "sha256"), limit, F.desc("last_viewed_at"), F.col("id"))


def view_counts(views: DataFrame) -> DataFrame:
    return views.groupBy("sha256").agg(F.count("*").alias("view_count"), F.max("viewed_at").alias("last_viewed_at"))


def favorites_state(toggles: DataFrame) -> DataFrame:
    """(sha256, created_at) of what is a favourite after all toggles; setting again keeps the first time.

    ``toggles`` has sha256, favorite, at and event_id, which breaks ties of time.
    """
    moment = F.struct("at", "event_id")
    folded = toggles.groupBy("sha256").agg(F.max(F.when(~F.col("favorite"), moment)).alias("cleared"))
    later = toggles.where("favorite").join(folded, "sha256").where(F.col("cleared").isNull() | (moment > F.col("cleared")))
    return later.groupBy("sha256").agg(F.min("at").alias("created_at"))


def builtin_collections(items: DataFrame, view_counts: DataFrame, favorites: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(name, n) of the collections that every library has and one for each category.

    ``items`` is read once for the fixed ones; recently viewed items are those with a view.
    """
    viewed = view_counts.select("sha256", F.lit(True).alias("viewed"))
    starred = favorites.select("sha256", F.lit(True).alias("starred"))
    copies = items.groupBy("sha256").agg(F.count("*").alias("copies"))
    joined = items.join(viewed, "sha256", "left").join(starred, "sha256", "left").join(copies, "sha256", "left")
    recent = F.col("indexed_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    fixed = {
        "favorites": F.coalesce("starred", F.lit(False)), "recent-added": recent, "recent-viewed": F.coalesce("viewed", F.lit(False)), "gifs": F.col("media_type") == "gif",
        "videos": F.col("media_type") == "video", "images": F.col("media_type") == "image", "nsfw": F.col("nsfw"), "duplicates": F.col("copies") > 1,
    }
    counts = joined.agg(*[F.count_if(c).alias(name) for name, c in fixed.items()]).unpivot([], [f"`{n}`" for n in fixed], "name", "n")
    by_category = counts_by_category(items).select(F.concat(F.lit("category:"), "category_name").alias("name"), "n")
    return counts.unionByName(by_category)


#: Saved searches, and characters of their words, that one pass over the texts looks for; searches without an anchor that meet the items at once.
SAVED_BLOCK = 20_000
WORD_CHARS = 1 << 22
LOOSE_BLOCK = 1000
FILTERS_SCHEMA = "type array<string>, category array<string>, tag array<string>, favorite boolean, nsfw string, min_duration double, max_duration double, since string"


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found


def _holding(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """How many texts (id, text) hold each word: one pass, counts by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held = _automaton(words), Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update({word for _, word in automaton.iter(text.as_py())})
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return {r["word"]: r["n"] for r in texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()} if words else {}


def _hits(texts: DataFrame, searches: list[tuple[int, list[str]]]) -> DataFrame:
    """(number, id): searches (number, words) all of whose words stand in the text, looked up by their rarest word."""
    often = _holding(texts, sorted({w for _, words in searches for w in words}))
    by_word: dict[str, list] = defaultdict(list)
    for number, words in searches:
        if all(w in often for w in words):  # else nothing holds one of them
            by_word[min(words, key=lambda w: (often[w], w))].append((number, set(words)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sorted({w for some in by_word.values() for _, words in some for w in words}))
        for batch in batches:
            numbers, ids = [], []
            for row, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                held = {word for _, word in automaton.iter(text.as_py())}
                own = [number for word in held for number, words in by_word.get(word, ()) if words <= held]
                numbers += own
                ids += [row] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.int64())], names=["number", "id"])

    return texts.mapInArrow(find, "number long, id long") if by_word else texts.sparkSession.createDataFrame([], "number long, id long")


def eval_saved_collections(collections: DataFrame, search_docs: DataFrame, items: DataFrame, item_tags: DataFrame, favorites: DataFrame) -> DataFrame:
    """(collection_id, n): how many items each stored search (collection_id, query, filters_json) finds.

    The searches are an index that items are routed through; equal ones are evaluated once. A search with words is found by its
    rarest one: a pass over the texts, with an automaton of the words of ``SAVED_BLOCK`` searches, gives the items that hold
    all words. A search without words is found by the rarest of the values it filters by (a tag, its categories, its types,
    favourite, nsfw only), joined by equality with the items' values. What is found is checked against all filters, without texts.
    Only searches with neither (durations and dates) meet all items, in blocks of ``LOOSE_BLOCK``.
    """
    parsed = collections.select("collection_id", F.lower(F.coalesce("query", F.lit(""))).alias("query"), F.coalesce("filters_json", F.lit("{}")).alias("json"))
    parsed = parsed.withColumn("words", F.array_sort(F.array_distinct(F.filter(F.split("query", r"\s+"), lambda w: w != ""))))
    named = stored(parsed.withColumn("digest", F.sha2(F.to_json(F.struct("words", "json")), 256)))
    distinct = named.groupBy("digest").agg(F.first("words").alias("words"), F.from_json(F.first("json"), FILTERS_SCHEMA).alias("f"))
    searches = stored(number_rows(distinct, ["digest"], "number"))
    tags = item_tags.groupBy("item_id").agg(F.collect_set("tag").alias("own_tags"))
    starred = favorites.select("sha256", F.lit(True).alias("starred")).distinct()
    facts = items.select(F.col("id").cast("long").alias("id"), "sha256", "media_type", "category_name", "nsfw", "duration_s", "created_at")
    rows = stored(facts.join(tags, facts["id"] == tags["item_id"], "left").join(starred, "sha256", "left").drop("item_id", "sha256"))
    f = F.col("f")
    empty = lambda c: f[c].isNull() | (F.size(f[c]) == 0)
    mode = F.coalesce(f["nsfw"], F.lit("exclude"))
    wanted_tags = F.transform(f["tag"], lambda t: F.lower(F.trim(t)))
    condition = (
        (empty("type") | F.array_contains(f["type"], F.col("media_type")))
        & (empty("category") | F.array_contains(f["category"], F.col("category_name")))
        & (empty("tag") | (F.size(F.array_except(wanted_tags, F.coalesce("own_tags", F.array().cast("array<string>")))) == 0))
        & (~F.coalesce(f["favorite"], F.lit(False)) | F.coalesce("starred", F.lit(False)))
        & ((mode == "include") | ((mode == "only") & F.col("nsfw")) | (~mode.isin("include", "only") & ~F.col("nsfw")))
        & (f["min_duration"].isNull() | F.coalesce(F.col("duration_s") >= f["min_duration"], F.lit(False)))
        & (f["max_duration"].isNull() | F.coalesce(F.col("duration_s") <= f["max_duration"], F.lit(False)))
        & (f["since"].isNull() | (F.col("created_at") >= f["since"].cast("timestamp")))
    )
    size = searches.where(F.size("words") > 0).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length(F.array_join("words", " "))), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size["n"] / SAVED_BLOCK), math.ceil(size["chars"] / WORD_CHARS))
    texts = search_docs.select(F.col("id").cast("long").alias("id"), F.lower(F.concat_ws("\n", "name", "title", "description", "ocr_text", "tags", "topics", "category")).alias("text"))
    found = []
    for k in range(blocks if size["n"] else 0):
        some = [(r["number"], r["words"]) for r in searches.where((F.size("words") > 0) & (F.pmod("number", F.lit(blocks)) == k)).select("number", "words").collect()]
        found.append(stored(_hits(texts, some)))

    value = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    either = lambda kind, c: F.when(~empty(c), F.array_distinct(F.transform(f[c], lambda v: value(kind, v))))
    flag = lambda kind, test: F.when(test, F.array(F.lit(kind)))
    own_values = F.array_compact(
        F.concat(F.array(value("category", F.col("category_name")), value("type", F.col("media_type")), F.when(F.col("starred"), "favorite"), F.when(F.col("nsfw"), "nsfw")), F.transform(F.coalesce("own_tags", F.array().cast("array<string>")), lambda t: value("tag", t)))
    )
    # Each choice is a set of values of which an item has at most one: a tag, the categories, the types, a mark.
    choices = F.concat(
        F.array_compact(F.array(either("category", "category"), either("type", "type"), flag("favorite", F.coalesce(f["favorite"], F.lit(False))), flag("nsfw", mode == "only"))),
        F.when(~empty("tag"), F.transform(wanted_tags, lambda t: F.array(value("tag", t)))).otherwise(F.array().cast("array<array<string>>")),
    )
    silent = searches.where(F.size("words") == 0).select("number", choices.alias("choices"))
    offered = silent.select("number", F.posexplode("choices").alias("choice", "values")).select("number", "choice", F.explode("values").alias("value"))
    of_items = rows.select("id", F.explode(own_values).alias("value"))
    often = of_items.groupBy("value").agg(F.count("*").alias("often"))
    costs = offered.join(often, "value", "left").groupBy("number", "choice").agg(F.sum(F.coalesce("often", F.lit(0))).alias("cost"))
    anchors = costs.groupBy("number").agg(F.min(F.struct("cost", "choice")).alias("best")).select("number", F.col("best.choice").alias("choice")).join(offered, ["number", "choice"])
    found.append(anchors.join(of_items, "value").select("number", "id"))

    checked = functools.reduce(DataFrame.unionByName, found).join(rows, "id").join(searches.select("number", "f"), "number").where(condition).select("number")
    loose = silent.where(F.size("choices") == 0).select("number")
    numbered = searches.join(loose, "number", "left_semi").select("number", "f")
    many = numbered.count()
    parts = math.ceil(many / LOOSE_BLOCK)
    met = [rows.join(F.broadcast(numbered.where(F.pmod("number", F.lit(parts)) == k)), condition).select("number") for k in range(parts)]
    counts = functools.reduce(DataFrame.unionByName, [checked, *met]).groupBy("number").agg(F.count("*").alias("n"))
    return named.join(searches.select("digest", "number"), "digest").join(counts, "number", "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("n"))

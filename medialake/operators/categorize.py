"""Confidence-routed categorisation: digests, batches, scoring, assignment, numbering and routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.functions.media import category_folder
from medialake.functions.text import slugify
from medialake.operators.numbering import number_rows
from medialake.plans.shared import stored

#: Fixed values.
OTHERS = "others"
NSFW_ID = 0
FIRST_USER_ID = 11
LEAST_CONFIDENCE = 0.5
BATCH = 12
STATS = {"tags": 60, "topics": 30, "meme_type": None, "tone": 20}
STRATA = 30


def digest_records(items: DataFrame) -> DataFrame:
    """What a model is shown of each item."""
    return items.select("id", "title", F.slice("tags", 1, 8).alias("tags"), "meme_type", F.slice("tone", 1, 3).alias("tone"), F.slice("topics", 1, 3).alias("topics"), F.substring("ocr_text", 1, 100).alias("ocr"))


def digest_stats(items: DataFrame) -> DataFrame:
    """(facet, value, n, rank): the most frequent values of whole lists, ties by value, and the total."""
    parts = [items.agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit("").alias("value"), "n", F.lit(1).alias("rank"))]
    for facet, most in STATS.items():
        values = items.select((F.col(facet) if facet == "meme_type" else F.explode(facet)).alias("value")).where("value is not null")
        counted = values.groupBy("value").agg(F.count("*").alias("n"))
        order = [F.desc("n"), F.col("value")]
        ranked = number_rows(counted if most is None else counted.orderBy(*order).limit(most), order, "place").withColumn("rank", (F.col("place") + 1).cast("int"))
        parts.append(ranked.select(F.lit(facet).alias("facet"), "value", "n", "rank"))
    return reduce(DataFrame.unionByName, parts)


def stratified_sample(items: DataFrame, n: int, strata: int = STRATA) -> DataFrame:
    """ids of at most ``n`` items: one for each frequent tag that has one not chosen yet, then others in hash order.

    Deterministic for the same ids; all items if there are at most ``n``. A tag's item is the first in hash
    order among the items whose best (most frequent) tag it is, so no item is chosen twice.
    """
    if items.count() <= n:
        return items.select("id")
    tags = items.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    top = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(strata).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))
    lot = F.sha2(F.concat_ws("/", F.lit("sample"), F.col("id").cast("string")), 256)
    best = tags.join(F.broadcast(top), "tag").groupBy("id").agg(F.max("r").alias("r"))
    first = best.groupBy("r").agg(F.min_by("id", lot).alias("id")).select("id", F.lit(0).alias("turn"))
    marked = items.select("id").join(first, "id", "left").select("id", F.coalesce("turn", F.lit(1)).alias("turn"))
    return marked.orderBy("turn", lot, "id").limit(n).select("id")


def validate_discovery(categories: DataFrame, n: int) -> DataFrame:
    """One row: problems (array) of a proposed set of categories (a column ``name``)."""
    slugs = categories.select(F.trim(F.coalesce("name", F.lit(""))).alias("name")).withColumn("slug", slugify(F.col("name"), 30))
    counted = slugs.agg(F.count("*").alias("n"), F.count_if(F.col("name") == "").alias("empty"), F.count_if(F.col("slug") == OTHERS).alias("reserved"), F.count_distinct(F.when(F.col("name") != "", F.col("slug"))).alias("distinct"), F.count_if(F.col("name") != "").alias("named"))
    problems = F.array(
        F.when(F.col("n") != n, F.format_string("expected %d categories, got %d", F.lit(n), F.col("n"))),
        F.when(F.col("empty") > 0, "empty name"), F.when(F.col("reserved") > 0, "reserved name"), F.when(F.col("distinct") < F.col("named"), "repeated name"),
    )
    return counted.select(F.array_compact(problems).alias("problems"))


def make_batches(items: DataFrame, size: int = BATCH) -> DataFrame:
    """``items`` with the number of their batch of ``size`` consecutive ids."""
    return number_rows(items, [F.col("id")], "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(batched: DataFrame, scorer: Scorer, schema: str, valid: Callable[[pd.DataFrame], bool] = lambda answer: True, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answers, failures): the scorer's rows for each batch, and (batch, error) of batches that gave none.

    An answer that ``valid`` rejects, or an exception, is tried again; a batch that fails gives no rows and
    fails no job. Batches are kept together, dealt to all tasks, and scored once for both results: a task
    takes whole runs of them out of sorted rows.
    """
    names = [part.split()[0] for part in schema.split(",")]
    columns = [*names, "batch", "error"]

    def score(rows: pd.DataFrame) -> pd.DataFrame | str:
        error = ""
        for _ in range(attempts):
            try:
                answer = scorer(rows.reset_index(drop=True))
                if valid(answer):
                    return answer.reindex(columns=names)
                error = "invalid answer"
            except Exception as reason:  # a scorer is foreign code: what it raises is the batch's result
                error = f"{type(reason).__name__}: {reason}"
        return error

    def scored(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Answers as frames of one kind of columns each, so that no other batch changes a value's type; then the failures."""
        numbers, members = rows["batch"].to_numpy(), rows.drop(columns="batch")
        begins = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        alike: dict[tuple, list] = {}
        failed = []
        for begin, end in zip(begins, [*begins[1:], len(rows)]):
            found = score(members.iloc[begin:end])
            if isinstance(found, str):
                failed.append((numbers[begin], found))
            elif len(found):
                alike.setdefault(tuple(found.dtypes), []).append((numbers[begin], found))
        for answers in alike.values():
            batch = np.repeat([n for n, _ in answers], [len(f) for _, f in answers])
            yield pd.concat([f for _, f in answers], ignore_index=True).assign(batch=batch, error=None)
        if failed:
            yield pd.DataFrame(failed, columns=["batch", "error"]).reindex(columns=columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last batch, which the next part may go on with
        for part in parts:
            last = part["batch"] == part["batch"].iloc[-1] if len(part) else None
            if last is None:
                continue
            if held and part["batch"].iloc[0] != held[0]["batch"].iloc[0]:
                yield from scored(pd.concat(held, ignore_index=True))
                held = []
            if not last.all():
                yield from scored(pd.concat([*held, part[~last]], ignore_index=True))
                held = []
            held.append(part[last])
        if held:
            yield from scored(pd.concat(held, ignore_index=True))

    numbered = batched.withColumn("batch", F.col("batch").cast("long"))
    dealt = numbered.repartition(int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch").sortWithinPartitions("batch")
    done = stored(dealt.mapInPandas(run, f"{schema}, batch long, error string"))
    return done.where("error is null").drop("error"), done.where("error is not null").select("batch", "error")


def score_rows(rows: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """The scorer's rows for Arrow batches of any size, where order and grouping do not matter."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(scorer, parts)

    return rows.mapInPandas(run, schema)


def finalize_assignment(answers: DataFrame, valid: DataFrame, others_id: int, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``answers`` (id, category_id, confidence) with doubtful ones routed to others and the given id as suggested."""
    known = valid.select(F.col("id").alias("category_id"), F.lit(True).alias("known")).distinct()
    joined = answers.join(known, "category_id", "left")
    keep = F.coalesce("known", F.lit(False)) & (F.col("confidence") >= least)
    return joined.select("id", F.when(keep, F.col("category_id")).otherwise(others_id).alias("category_id"), "confidence", F.when(~keep, F.col("category_id")).alias("suggested"))


def missing_assignments(items: DataFrame, answers: DataFrame, retried: DataFrame, others_id: int) -> DataFrame:
    """A row for each item: its answer, else the one of a single retry, else others with a reason."""
    first = answers.select("id", F.col("category_id").alias("c1"), F.col("confidence").alias("p1"))
    second = retried.select("id", F.col("category_id").alias("c2"), F.col("confidence").alias("p2")).join(answers, "id", "left_anti")
    joined = items.select("id").join(first, "id", "left").join(second, "id", "left")
    found = F.coalesce("c1", "c2")
    return joined.select("id", F.coalesce(found, F.lit(others_id)).alias("category_id"), F.coalesce("p1", "p2", F.lit(0.0)).alias("confidence"), F.when(found.isNull(), "no valid assignment returned").alias("reason"))


def renumber_categories(categories: DataFrame, counts: DataFrame, others_id: int) -> DataFrame:
    """(old_id, id, name, folder, n): categories from 1 by falling number of members, others unchanged."""
    counted = categories.join(counts.select(F.col("category_id").alias("id"), "n"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = counted.where(F.col("id") != others_id).withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), "id")).cast("long"))
    both = ranked.unionByName(counted.where(F.col("id") == others_id).withColumn("new", F.col("id").cast("long")))
    return both.select(F.col("id").alias("old_id"), F.col("new").alias("id"), "name", category_folder(F.col("new"), slugify(F.col("name"), 30)).alias("folder"), "n")


def pinned(category_id: Column) -> Column:
    return F.coalesce((category_id == NSFW_ID) | (category_id >= FIRST_USER_ID), F.lit(False))


def split_pinned(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items to assign, items left out): pinned members and NSFW items without a category are left out."""
    out = pinned(F.col("category_id")) | (F.col("category_id").isNull() & F.coalesce("nsfw", F.lit(False)))
    return items.where(~out), items.where(out)


def resolve_hints(files: DataFrame, registry: DataFrame, hint: str | None = None) -> DataFrame:
    """``files`` (rel_path) with hint, its slug and the category_id that it names, null if it names none.

    An explicit hint wins over the first folder of a path. A slug names the first category whose name,
    folder, or folder without its number has it.
    """
    folder = F.when(F.contains("rel_path", F.lit("/")), F.split_part("rel_path", F.lit("/"), F.lit(1)))
    named = files.withColumn("hint", F.lit(hint) if hint else folder)
    hinted = named.join(_slugs(named.select("hint")), "hint", "left").select(*named.columns, "slug")
    spelled = F.array(F.col("name"), F.col("folder"), F.regexp_replace("folder", r"^\d{2}[ -]+", ""))
    names = registry.select("id", F.explode(spelled).alias("spelling"))
    # A spelling that is null has the slug of an empty one.
    known = names.withColumn("spelling", F.coalesce("spelling", F.lit("")))
    first = known.join(_slugs(known.select("spelling")), "spelling").groupBy("slug").agg(F.min("id").alias("category_id"))
    return hinted.join(first, "slug", "left")


def _slugs(values: DataFrame) -> DataFrame:
    """Each distinct value of the one column of ``values`` with its slug; null has none.

    Names of folders repeat: each is made a slug once, so rows of files never pass through Python.
    """
    column = values.columns[0]
    each = stored(values.where(F.col(column).isNotNull()).distinct())
    return stored(each.select(column, slugify(F.col(column), 30, False).alias("slug")))


def new_user_categories(hints: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, name, folder) for each slug that names no category, numbered from 11 on by where it was first seen.

    ``hints`` has slug, category_id and seen (order of arrival).
    """
    fresh = hints.where("slug is not null and category_id is null").groupBy("slug").agg(F.min("seen").alias("seen"))
    last = registry.agg(F.greatest(F.max("id"), F.lit(FIRST_USER_ID - 1))).first()[0]
    numbered = fresh.withColumn("id", (F.row_number().over(Window.orderBy("seen", "slug")) + (last or FIRST_USER_ID - 1)).cast("long"))
    return numbered.select("id", F.col("slug").alias("name"), category_folder(F.col("id"), F.col("slug")).alias("folder"))


def route_category(files: DataFrame, nsfw_rule: bool = True) -> DataFrame:
    """``files`` (hint_id, category_id, nsfw) with routed_id, source and confidence: hint, then category, then rule."""
    ruled = F.coalesce("nsfw", F.lit(False)) & F.lit(nsfw_rule)
    return files.withColumns(
        {
            "routed_id": F.coalesce("hint_id", "category_id", F.when(ruled, NSFW_ID)),
            "source": F.when(F.col("hint_id").isNotNull(), "hint").when(F.col("category_id").isNotNull(), "model").when(ruled, "rule"),
            "confidence": F.when(F.col("hint_id").isNotNull() | (F.col("category_id").isNull() & ruled), 1.0),
        }
    )


def assign_scope(items: DataFrame, registry: DataFrame, rediscover: bool = False) -> DataFrame:
    """Items to assign: those without a valid category if there are discovered ones and they stay, else all."""
    if rediscover or registry.where((F.col("id") >= 1) & (F.col("id") < FIRST_USER_ID - 1)).isEmpty():
        return items
    return items.join(registry.select(F.col("id").alias("category_id")), "category_id", "left_anti")


def apply_assignments(current: DataFrame, results: DataFrame, registry: DataFrame, run_id: str, nsfw_rule: bool = True) -> DataFrame:
    """The next assignment of each item: id, category_id, confidence, source, run_id, changed.

    Results overlay what was; items that the NSFW rule takes get category 0; items that were not assigned
    keep their stamp.
    """
    new = results.select("id", F.col("category_id").alias("new_id"), F.col("confidence").alias("new_confidence"))
    joined = current.join(new, "id", "left")
    forced = F.coalesce("nsfw", F.lit(False)) & F.lit(nsfw_rule) & ~F.coalesce(F.col("category_id") >= FIRST_USER_ID, F.lit(False))
    fresh = F.col("new_id").isNotNull()
    final = F.when(forced, NSFW_ID).otherwise(F.coalesce("new_id", "category_id"))
    return joined.select(
        "id",
        final.alias("category_id"),
        F.when(forced, 1.0).otherwise(F.coalesce("new_confidence", "confidence")).alias("confidence"),
        F.when(forced, "rule").when(fresh, "model").otherwise(F.col("source")).alias("source"),
        F.when(forced | fresh, run_id).otherwise(F.col("run_id")).alias("run_id"),
        (~final.eqNullSafe(F.col("category_id"))).alias("changed"),
    ).join(registry.select(F.col("id").alias("category_id"), "folder"), "category_id", "left")


def category_counts(registry: DataFrame, assigned: DataFrame, prior: DataFrame, routed: DataFrame) -> DataFrame:
    """(id, name, n): discovered ones from the final assignment, pinned ones prior members and newly routed."""
    members = assigned.where(~pinned(F.col("category_id"))).select("category_id").unionByName(prior.where(pinned(F.col("category_id"))).select("category_id")).unionByName(routed.where(pinned(F.col("category_id"))).select("category_id"))
    counts = members.groupBy("category_id").agg(F.count("*").alias("n"))
    return registry.join(counts, registry["id"] == counts["category_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def preview(assigned: DataFrame, k: int = 5) -> DataFrame:
    """(category_id, n, titles): the size of each category and its first ``k`` titles by id."""
    counts = assigned.groupBy("category_id").agg(F.count("*").alias("n"))
    first = assigned.withColumn("r", F.row_number().over(Window.partitionBy("category_id").orderBy("id"))).where(F.col("r") <= k)
    titles = first.groupBy("category_id").agg(F.array_sort(F.collect_list(F.struct("r", "title"))).alias("t")).select("category_id", F.col("t.title").alias("titles"))
    return counts.join(titles, "category_id")


def merge_ocr(rows: DataFrame, mode: str, primary: str = "ocr_text", second: str = "second_ocr") -> DataFrame:
    """``rows`` with ocr_text by mode (off, fallback, always) and ocr_ran."""
    if mode not in ("off", "fallback", "always"):
        raise ValueError(f"unknown mode {mode}")
    empty = F.trim(F.coalesce(primary, F.lit(""))) == ""
    other = F.nullif(F.trim(second), F.lit(""))
    text = {"off": F.col(primary), "fallback": F.when(empty, F.coalesce(other, F.col(primary))).otherwise(F.col(primary)), "always": F.coalesce(other, F.col(primary))}
    ran = {"off": F.lit(False), "fallback": empty, "always": F.lit(True)}
    return rows.withColumns({"ocr_text": text[mode], "ocr_ran": ran[mode]})


def run_summary(plan: DataFrame, results: DataFrame, created: DataFrame) -> DataFrame:
    """One row of counters over the plan of a run and its results (path, ok, hinted, category_id)."""
    planned = plan.agg(F.count_if(F.col("action") == "done").alias("skipped_done"), F.count_if(F.col("action") == "duplicate").alias("skipped_duplicate"))
    done = results.agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & F.col("hinted")).alias("hinted"), F.count_if(F.col("ok") & F.col("category_id").isNotNull()).alias("categorized"))
    return planned.crossJoin(F.broadcast(done)).crossJoin(F.broadcast(created.agg(F.count("*").alias("categories_created"))))

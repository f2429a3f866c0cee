"""Normalisation and validation of structured analyses, and shapes of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.geometry import aspect_ratio
from medialake.functions.media import MEME_TYPES
from medialake.functions.text import clean_word_list, clip_list, clip_text, collapse_blanks, or_default

#: Limits of the fields.
TEXT_LIMITS = {"title": 120, "description": 500, "ocr_text": 2000, "template": 80, "language": 20}
LIST_LIMITS = {"tags": 10, "subjects": 10, "tone": 4, "topics": 3}
REQUIRED = ("title", "description", "tags", "meme_type", "nsfw", "confidence")
FIELDS = ("title", "description", "ocr_text", "tags", "subjects", "meme_type", "template", "tone", "topics", "language", "nsfw", "confidence")


def clip_to_limits(df: DataFrame, texts: dict[str, int] | None = None, lists: dict[str, int] | None = None) -> DataFrame:
    """Over-long texts and lists of the columns that are there, cut to their limits."""
    texts, lists = texts or TEXT_LIMITS, lists or LIST_LIMITS
    cut = {c: clip_text(F.col(c), n) for c, n in texts.items() if c in df.columns}
    return df.withColumns(cut | {c: clip_list(F.col(c), n) for c, n in lists.items() if c in df.columns})


def normalize_analysis(df: DataFrame) -> DataFrame:
    """The analysis columns in their final form, with defaults for what is empty."""
    title = collapse_blanks(F.translate(F.coalesce("title", F.lit("")), "_", " "))
    language = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    return df.withColumns(
        {
            "tags": or_default(clean_word_list(F.col("tags"), 10, True), "uncategorized"),
            "tone": or_default(clean_word_list(F.col("tone"), 4), "neutral"),
            "topics": or_default(clean_word_list(F.col("topics"), 3), "general"),
            "subjects": clean_word_list(F.col("subjects"), 10),
            "template": F.nullif(F.trim("template"), F.lit("")),
            "description": F.trim(F.coalesce("description", F.lit(""))),
            "ocr_text": F.trim(F.coalesce("ocr_text", F.lit(""))),
            "title": F.when(title == "", "untitled meme").otherwise(title),
            "language": F.when(language == "", "none").otherwise(language),
            "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.0)))),
        }
    )


def violations(analysis: Column) -> Column:
    """Array of what is wrong with a JSON document of an analysis; empty if it is valid."""
    schema = "title string, description string, ocr_text string, tags array<string>, subjects array<string>, meme_type string, template string, tone array<string>, topics array<string>, language string, nsfw boolean, confidence double"
    row = F.from_json(analysis, schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(analysis)
    problems = [F.when(keys.isNull(), "not an object")]
    problems += [F.when(keys.isNotNull() & row[c].isNull(), f"missing {c}") for c in REQUIRED]
    problems += [F.when(F.char_length(row[c]) > n, f"long {c}") for c, n in TEXT_LIMITS.items()]
    problems += [F.when(F.char_length(row[c]) == 0, f"empty {c}") for c in ("title", "description")]
    problems += [F.when(F.size(row[c]) > n, f"many {c}") for c, n in LIST_LIMITS.items()]
    problems.append(F.when(F.size(row["tags"]) == 0, "empty tags"))
    problems.append(F.when(~row["meme_type"].isin(*MEME_TYPES), "unknown meme_type"))
    problems.append(F.when((row["confidence"] < 0) | (row["confidence"] > 1), "confidence out of range"))
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, FIELDS)))), lambda k: F.concat(F.lit("unknown "), k))
    return F.concat(F.array_compact(F.array(*problems)), F.coalesce(unknown, F.array().cast("array<string>")))


def validate_analysis(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are valid, the others with their violations)."""
    checked = df.withColumn("violations", violations(F.col(column)))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def build_search_docs(items: DataFrame) -> DataFrame:
    """id and the seven texts that are searched; missing ones are empty."""
    return items.select(
        "id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "title", "description", "ocr_text")],
        F.concat_ws(" ", "tags", "meme_type", "template").alias("tags"),
        F.concat_ws(" ", "topics").alias("topics"),
        F.coalesce("category_name", F.lit("")).alias("category"),
    )


def shape_item(items: DataFrame) -> DataFrame:
    """Items as they are shown: aspect ratio, category as a struct or null, view count or 0."""
    named = F.col("category_name").isNotNull() & (F.col("category_name") != "")
    return items.withColumns(
        {
            "aspect_ratio": aspect_ratio(F.col("width"), F.col("height")),
            "category": F.when(named, F.struct(F.col("category_name").alias("name"), F.col("category_folder").alias("folder"))),
            "view_count": F.coalesce("view_count", F.lit(0)) if "view_count" in items.columns else F.lit(0),
        }
    )

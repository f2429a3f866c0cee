"""Normalisation of structured model output and of names, as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags that say nothing.
GENERIC_TAGS = ("meme", "memes", "funny", "image", "picture", "pictures", "humor", "humour")
#: Leading articles, and device names that may not be file names.
ARTICLES = ("a", "an", "the")
RESERVED_NAMES = ("aux", "con", "nul", "prn", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))


def clip_text(text: Column, most: int) -> Column:
    """An over-long text cut to ``most`` characters and then freed of trailing blanks."""
    return F.when(F.char_length(text) > most, F.rtrim(F.substring(text, 1, most))).otherwise(text)


def clip_list(values: Column, most: int, most_chars: int | None = None) -> Column:
    """The first ``most`` values, each clipped to ``most_chars``."""
    cut = F.slice(values, 1, most)
    return F.transform(cut, lambda v: clip_text(v, most_chars)) if most_chars else cut


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_word_list(values: Column, most: int, drop_generic: bool = False) -> Column:
    """Lower-case words without separators, blanks and repeats, in first-seen order, at most ``most``."""
    plain = F.transform(values, lambda v: collapse_blanks(F.lower(F.translate(v, "_-", "  "))))
    kept = F.filter(plain, lambda v: (v != "") & (~v.isin(*GENERIC_TAGS) if drop_generic else F.lit(True)))
    return F.coalesce(F.slice(F.array_distinct(kept), 1, most), F.array().cast("array<string>"))


def or_default(values: Column, default: str) -> Column:
    return F.when(F.size(values) == 0, F.array(F.lit(default))).otherwise(values)


@F.pandas_udf(T.StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """NFKD with everything that is not ASCII dropped; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slugify(text: Column, most: int = 80, drop_articles: bool = True, fold=ascii_fold) -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens, cut before the last hyphen if too long.

    A leading article goes unless it is the only word; an empty result is ``meme``; a device name gets
    ``-meme``. ``fold`` makes the text ASCII.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    if drop_articles:
        words = F.when((F.size(words) > 1) & F.lower(F.get(words, F.lit(0))).isin(*ARTICLES), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    plain = F.lower(fold(F.array_join(words, " ")))
    whole = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.substring(whole, 1, most)
    short = F.when(F.char_length(whole) <= most, whole).otherwise(F.btrim(F.regexp_replace(cut, "-[^-]*$", ""), F.lit("-")))
    named = F.when(short == "", "meme").otherwise(short)
    return F.when(named.isin(*RESERVED_NAMES), F.concat(named, F.lit("-meme"))).otherwise(named)


def sanitize_filename(name: Column) -> Column:
    """struct(name, error): the last path part without forbidden signs, or why there is none."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    clean = F.btrim(F.regexp_replace(F.trim(last), r"[<>:\"|?*\x00-\x1F]", ""), F.lit(" ."))
    before_dot = F.lower(F.regexp_extract(clean, r"^([^.]*)", 1))
    error = F.when(clean == "", "empty").when(F.trim(before_dot).isin(*RESERVED_NAMES), "reserved")
    return F.struct(F.when(error.isNull(), clean).alias("name"), error.alias("error"))

"""Metadata providers and what is merged from them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

MESSAGE_CHARS = 500


@dataclass(frozen=True)
class Provider:
    """Adds columns to the fields that the providers before it have given.

    ``extract`` takes the fields so far and returns the key and its own columns, a row for each key that it
    knows. Its values replace others if it ``overrides``, otherwise they fill what is blank.
    """

    name: str
    extract: Callable[[DataFrame], DataFrame]
    overrides: bool = False


@dataclass(frozen=True)
class RowProvider:
    """A provider in Python, for formats that no built-in reads; an error costs only the rows that raise it.

    ``extract`` takes a batch of the columns ``reads`` and returns a frame of the columns of ``schema`` (DDL),
    row for row. If it raises, the batch is halved until the rows that fail stand alone: one failing row of n costs
    about 2 log2(n) further calls, so ``extract`` must not depend on which rows share a batch. Rows for which
    ``applies`` is not true are not handed to it and get nothing. Whole numbers with nulls arrive as floats.
    """

    name: str
    reads: tuple[str, ...]
    schema: str
    extract: Callable[[pd.DataFrame], pd.DataFrame]
    applies: Column | None = None
    overrides: bool = False


def merge_providers(basic: DataFrame, providers: Sequence[Provider | RowProvider], key: str = "path", errors: str | None = None) -> DataFrame:
    """``basic`` with what ``providers`` add, in their order.

    A provider without a row for a key adds nothing to it, and one that raises when it builds its table, or
    whose table has no key, adds nothing at all (a warning names it). A row provider that raises for a row adds nothing
    to that row, and other providers still do. With ``errors`` a column of that name says what failed, as an array
    of (provider, message), empty where nothing did. Columns of ``basic`` that a provider also has are merged,
    others are kept.
    """
    merged = basic.withColumn(errors, F.array().cast("array<struct<provider:string,message:string>>")) if errors else basic
    for provider in providers:
        if isinstance(provider, RowProvider):
            merged = _merge_rows(merged, provider, errors)
            continue
        try:
            table = provider.extract(merged)
            own = [c for c in table.columns if c not in (key, errors)]
            side = table.select(key, *[F.col(c).alias(f"_p_{c}") for c in own])
        except Exception as error:
            log.warning("provider %s adds nothing: %s", provider.name, error)
            continue
        merged = _merged(merged.join(side, key, "left"), own, merged.columns, provider.overrides)
    return merged


def quarantine(merged: DataFrame, errors: str, key: str = "path", stage: str = "extract") -> DataFrame:
    """(source_path, stage, message) of all that failed, for ``write_failures``; a row for each provider and row."""
    return merged.select(F.col(key).alias("source_path"), F.explode(errors).alias("e")).select("source_path", F.lit(stage).alias("stage"), F.concat_ws(": ", "e.provider", "e.message").alias("message"))


def _merge_rows(merged: DataFrame, provider: RowProvider, errors: str | None) -> DataFrame:
    schema = StructType.fromDDL(provider.schema)
    own = schema.fieldNames()
    applies = F.lit(True) if provider.applies is None else F.coalesce(provider.applies, F.lit(False))
    extract = provider.extract
    given = F.pandas_udf(lambda batch: isolated(extract, own, batch), StructType.fromDDL(f"{provider.schema}, _message string"))
    called = merged.withColumn("_given", given(F.struct(applies.alias("_applies"), *provider.reads)))
    wide = called.withColumns({f"_p_{c}": F.col(f"_given.{c}") for c in own})
    if errors:
        failed = F.struct(F.lit(provider.name).alias("provider"), F.col("_given._message").alias("message"))
        wide = wide.withColumn(errors, F.when(F.col("_given._message").isNull(), F.col(errors)).otherwise(F.array_append(errors, failed)))
    return _merged(wide.drop("_given"), own, merged.columns, provider.overrides)


def isolated(extract: Callable[[pd.DataFrame], pd.DataFrame], own: list[str], batch: pd.DataFrame) -> pd.DataFrame:
    """What ``extract`` gives for a batch: its columns and ``_message``, null where it did not fail."""
    batch = batch.reset_index(drop=True)
    asked = batch.index[batch["_applies"]]
    rows = batch.drop(columns="_applies")
    parts: list[pd.DataFrame] = []
    messages: dict[int, str] = {}
    waiting = [asked] if len(asked) else []
    while waiting:
        at = waiting.pop()
        try:
            given = extract(rows.loc[at].reset_index(drop=True))
            if len(given) != len(at):
                raise ValueError(f"{len(given)} rows for {len(at)}")
            parts.append(given[own].set_axis(at))
        except Exception as error:
            if len(at) == 1:
                messages[at[0]] = f"{type(error).__name__}: {error}"[:MESSAGE_CHARS]
            else:
                waiting += [at[: len(at) // 2], at[len(at) // 2 :]]
    found = pd.concat(parts).reindex(batch.index) if parts else pd.DataFrame(None, batch.index, own, dtype=object)
    return found.assign(_message=pd.Series(messages, dtype=object).reindex(batch.index))


def _merged(joined: DataFrame, own: list[str], known: list[str], overrides: bool) -> DataFrame:
    """Take the columns ``_p_...`` of a provider over: known ones by its rule, new ones as they are."""
    rule = _override if overrides else _fill
    return joined.withColumns({c: rule(c) if c in known else F.col(f"_p_{c}") for c in own}).drop(*[f"_p_{c}" for c in own])


def _override(column: str) -> Column:
    return F.coalesce(f"_p_{column}", column)


def _fill(column: str) -> Column:
    blank = F.col(column).isNull() | (F.col(column).cast("string") == "")
    return F.when(blank, F.col(f"_p_{column}")).otherwise(F.col(column))


def finalize_nsfw(items: DataFrame, registry: DataFrame, folder: str | None = None) -> DataFrame:
    """``items`` with nsfw set where it was, or by category name, folder or the registry's rule; never unset."""
    ruled = registry.where("rule = 'nsfw'").select(F.col("name").alias("category_name"), F.lit(True).alias("_ruled")).distinct()
    named = F.coalesce(F.lower("category_name") == "nsfw", F.lit(False))
    placed = F.coalesce(F.col("category_folder") == folder, F.lit(False)) if folder else F.lit(False)
    return items.join(ruled, "category_name", "left").withColumn("nsfw", F.coalesce("nsfw", F.lit(False)) | named | placed | F.coalesce("_ruled", F.lit(False))).drop("_ruled")

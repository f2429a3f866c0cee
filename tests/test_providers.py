"""Providers whose rows fail one by one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialake.operators.providers import Provider, RowProvider, isolated, merge_providers, quarantine
from medialake.sources.files import write_failures


def header(applies=None, overrides=False) -> RowProvider:
    def head(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["size"].isin([7, 70]).any():
            raise ValueError("unreadable header")
        return pd.DataFrame({"width": batch["size"] * 2, "title": "t" + batch["size"].astype(int).astype(str)})

    return RowProvider("head", ("size",), "width long, title string", head, applies, overrides)


def some_files(spark, n=100):
    return spark.range(n).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.col("id").alias("size"), F.when(F.col("id") % 10 == 0, "own").otherwise("").alias("title"), F.lit(1.5).alias("_message"))


def test_a_failing_row_costs_itself_only(spark, tmp_path):
    last = Provider("last", lambda fields: fields.select("path", F.lit(True).alias("seen")))
    merged = merge_providers(some_files(spark), [header(), last], errors="errors").persist()
    rows = {r["size"]: r for r in merged.collect()}
    assert merged.columns == ["path", "size", "title", "_message", "errors", "width", "seen"] and len(rows) == 100
    for size, row in rows.items():
        failed = size in (7, 70)
        assert row["width"] == (None if failed else 2 * size) and row["seen"] and row["_message"] == 1.5
        assert row["title"] == ("own" if size % 10 == 0 else "" if failed else f"t{size}") or failed and row["title"] is None
        assert [tuple(e) for e in row["errors"]] == ([("head", "ValueError: unreadable header")] if failed else [])
    write_failures(quarantine(merged, "errors"), str(tmp_path / "failed"))
    written = spark.read.json(str(tmp_path / "failed")).select("source_path", "stage", "message").collect()
    assert sorted(map(tuple, written)) == [(f"f{n}", "extract", "head: ValueError: unreadable header") for n in (7, 70)]
    merged.unpersist()


def test_rows_to_which_a_provider_does_not_apply(spark):
    """They are not handed to it: what would fail there does not; null is not true."""
    applies = F.when(F.col("size") == 3, F.lit(None)).otherwise(~F.col("size").isin(7, 70))
    rows = {r["size"]: r for r in merge_providers(some_files(spark), [header(applies, True)], errors="errors").collect()}
    assert [n for n, r in rows.items() if r["width"] is None] == [3, 7, 70] and not any(r["errors"] for r in rows.values())
    assert rows[10]["title"] == "t10" and rows[70]["title"] == "own"


def test_without_a_column_of_errors_and_with_no_rows(spark):
    assert merge_providers(some_files(spark), [header()]).where("width is null").count() == 2
    assert merge_providers(some_files(spark, 0), [header()], errors="errors").isEmpty()
    always = RowProvider("always", ("size",), "n long", lambda batch: batch.missing)
    found = merge_providers(some_files(spark, 5), [always], errors="errors")
    assert found.where("n is null and size(errors) = 1").count() == 5


@pytest.mark.parametrize("seed", range(5))
def test_calls_grow_with_the_failures(seed):
    draw = np.random.default_rng(seed)
    bad = set(draw.choice(4096, seed, replace=False).tolist())
    calls = []

    def extract(batch):
        calls.append(len(batch))
        if batch["n"].isin(bad).any():
            raise KeyError("bad")
        return batch.rename(columns={"n": "m"})

    found = isolated(extract, ["m"], pd.DataFrame({"_applies": True, "n": range(4096)}))
    assert set(found.index[found["_message"].notna()]) == bad and set(found.index[found["m"].isna()]) == bad
    assert len(calls) <= 1 + seed * 24

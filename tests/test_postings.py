"""The positional trigram index against scans and brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from medialake.operators import postings, rank
from medialake.plans import q_search

DATA = "/root/testdata/sf0.001"
COLUMNS = ["name", "title", "description", "ocr_text", "tags", "topics", "category"]


def some_docs(spark, n=300, seed=4, copies=1):
    draw = random.Random(seed)
    words = ["aaaa", "abab", "Ünïcode", "straße", "banana", "ab", "\U0001f600\U0001f600\U0001f600", "tree", "TREES", "a"]
    text = lambda most: " ".join(draw.choices(words, [1, 2, 1, 1, 3, 5, 1, 2, 1, 4], k=draw.randint(0, most)))
    rows = [(i, *[text(3) if draw.random() < 0.9 else None for _ in range(3)], text(60), text(3), "", text(1)) for i in range(n // copies)]
    rows = [(r[0] + k * len(rows), *r[1:]) for k in range(copies) for r in rows]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, name string, title string, description string, ocr_text string, tags string, topics string, category string")


def scores_by_hand(rows, terms):
    weights = list(rank.WEIGHTS.values())
    order = [COLUMNS.index(c) for c in rank.WEIGHTS]
    low = [(r[0], [(r[1:][k] or "").lower() for k in order]) for r in rows]
    sizes = {i: sum(max(0, len(t) - 2) for t in texts) for i, texts in low}
    mean = sum(sizes.values()) / len(sizes)
    count = lambda t, w: sum(t.startswith(w, k) for k in range(len(t)))
    found = {}
    for w in terms:
        met = {i: sum(weight * count(t, w) for weight, t in zip(weights, texts)) for i, texts in low if any(w in t for t in texts)}
        value = math.log((len(rows) - len(met) + 0.5) / (len(met) + 0.5))
        found[w] = {i: (value if value > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for i, f in met.items()}
    both = set.intersection(*[set(found[w]) for w in terms]) if terms else set()
    return {i: -sum(found[w][i] for w in terms) for i in both}


@pytest.mark.parametrize("docs,chars", [(4096, 1 << 21), (7, 1 << 21), (4096, 300)])
def test_ranking_by_postings_equals_brute_force(spark, monkeypatch, docs, chars):
    monkeypatch.setattr(postings, "BLOCK_DOCS", docs)
    monkeypatch.setattr(postings, "BLOCK_CHARS", chars)
    rows, frame = some_docs(spark)
    index = postings.build_postings(frame)
    assert index.total == len(rows)
    for terms in (["aaa"], ["aba", "nan"], ["BANANA"], ["straße", "ünï"], ["\U0001f600\U0001f600\U0001f600 "], ["tree", "trees", "a a"], ["no such term"], ["banana ab"]):
        wanted = scores_by_hand(rows, [t.lower() for t in terms])
        found = {r["id"]: r["score"] for r in postings.rank_by_postings(index, terms).collect()}
        assert found == pytest.approx(wanted, abs=1e-12)
        assert found == pytest.approx({r["id"]: r["score"] for r in rank.bm25_rank(frame.na.fill(""), terms).collect()}, abs=1e-12)
    assert postings.rank_by_postings(index, ["ab"]).isEmpty() and postings.rank_by_postings(index, []).isEmpty()


@pytest.mark.parametrize("copies,k,terms", [(1, 3, 50_000), (10, 4, 3)])
def test_best_rows_of_many_queries(spark, monkeypatch, copies, k, terms):
    monkeypatch.setattr(postings, "TERMS", terms)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 20)
    rows, frame = some_docs(spark, copies=copies)
    queries = [(0, ["aaaa", "tree"]), (1, ["aaaa", "AAAA", "ab"]), (2, ["ab"]), (3, []), (4, ["banana"]), (5, ["none", "banana"]), (6, ["nan", "aba"]), (7, ["a a"])]
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    found = postings.batch_search_by_postings(postings.build_postings(frame), asked, k).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, postings.batch_search(frame, asked, k).collect()))
    wanted = {}
    for q, of in queries:
        low = sorted({t.lower() for t in of if len(t) >= 3})
        best = sorted((round(s, 9), i) for i, s in scores_by_hand(rows, low).items())[:k] if low else []
        wanted |= {(q, n + 1): i for n, (_, i) in enumerate(best)}
    assert len(wanted) > 3 * k and {(r["query_id"], r["rank"]): r["id"] for r in found} == wanted


def test_index_of_no_rows(spark):
    index = postings.build_postings(some_docs(spark)[1].limit(0))
    assert index.total == 0 and postings.rank_by_postings(index, ["abc"]).isEmpty()
    assert postings.batch_search_by_postings(index, spark.createDataFrame([(1, ["abc"])], "query_id long, terms array<string>")).isEmpty()


def test_only_wanted_folders_and_grams_are_read(spark, same_rows):
    index = postings.build_postings(q_search._docs(spark, DATA))
    read = postings.wanted_grams(index, ["ement"])
    plan = read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "bucket" in plan.split("PartitionFilters:")[1].split("\n")[0] and "In(gram" in plan.split("PushedFilters:")[1].split("\n")[0]
    folders = {f.split("bucket=")[1].split("/")[0] for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert folders and folders <= {str(b) for b in postings._bucket(postings.np.array([g for g, _ in postings.covering("ement")]))}
    same_rows(postings.rank_by_postings(index, q_search.TERMS).select("id", F.round("score", 6).alias("score")), q_search.ORACLES["d4_bm25_rank"])


def test_rows_of_the_index_stay_with_the_task_that_made_them(spark):
    """No file of the index holds blocks of two tasks, so the index is written without a shuffle; each file is sorted by gram."""
    _, docs = some_docs(spark)
    index = postings.build_postings(docs.repartition(3))
    rows = index.grams.select(F.input_file_name().alias("file"), F.shiftright("block", 32).alias("task"), F.monotonically_increasing_id().alias("at"), "gram")
    made = {}
    for r in rows.orderBy("file", "at").collect():
        made.setdefault(r["file"], []).append((r["task"], r["gram"]))
    assert len({t for found in made.values() for t, _ in found}) == 3
    assert all(len({t for t, _ in found}) == 1 and [g for _, g in found] == sorted(g for _, g in found) for found in made.values())

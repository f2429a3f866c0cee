"""The pipeline against a brute-force version of its stages, and the SQL of the queries that have one."""

from __future__ import annotations

import pytest
from llm_by_hand import lines_by_hand

import corpus_pipeline
from medialake.llm import near_copies, queries
from medialake.plans.shared import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, same_rows, name):
    same_rows(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def test_stages_by_hand(spark):
    docs = table(spark, DATA, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    known = stages["language_id"](spark, docs, DATA)
    assert known.columns == docs.columns and known.count() == docs.where("text rlike '[A-Za-z]'").count()
    lines = stages["line_dedup"](spark, known, DATA)
    wanted = lines_by_hand([(r["doc_id"], r["text"]) for r in known.collect()])
    assert {(r["doc_id"], r["text"]) for r in lines.collect()} == {(k[0], k[1]) for k in wanted}
    sets = {r["doc_id"]: set(near_copies.shingle_set(r["text"]).tolist()) for r in lines.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    single = stages["near_dedup"](spark, lines, DATA)
    assert {r["doc_id"] for r in single.collect()} == {i for i in ids if root(i) == i}
    mixed = stages["mixing"](spark, single, DATA)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(ids)
    packed = stages["packing"](spark, mixed, DATA).toPandas()
    assert packed[packed["piece"] == 0].shape[0] == mixed.count()
    ends = packed["offset"] + packed["length"]
    assert ends.max() <= 2048 and packed.groupby("sequence_id")["length"].sum().equals(ends.groupby(packed["sequence_id"]).max())


def test_run_over_an_empty_table(spark, no_documents, tmp_path):
    no_documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()

"""Every registered query of the media library gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from medialake.functions.fuzzy import weighted_ratio
from medialake.operators.fuzzy import fuzzy_text
from medialake.plans import catalog, fixtures, q_search

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, same_rows, name):
    same_rows(catalog.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).columns


def test_fuzzy_query_finds_what_all_pairs_hold(spark):
    texts = [(r["id"], r["choice"]) for r in fuzzy_text(fixtures.items(spark, DATA)).collect()]
    log = q_search.typo_log(spark, DATA).collect()
    wanted = []
    for q in log:
        scored = sorted((-weighted_ratio(q["q"] or "", t or ""), i) for i, t in texts)
        wanted += [(q["query_id"], k + 1, i, -score) for k, (score, i) in enumerate(scored[:50]) if score <= -75]
    assert wanted and sorted(tuple(r) for r in catalog.queries()["d18_fuzzy_match"](spark, DATA).collect()) == sorted(wanted)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if (before := row) else row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_fuzzy_candidates_of_all_words(spark):
    """Every pair of a word of the query log and a tag, by hand."""
    def grams(w):
        return {w.lower()[k : k + 3] for k in range(max(1, len(w) - 2))}

    log = {w.lower() for r in q_search._query_log(spark, DATA).collect() for w in r["terms"]}
    tags = {r["tag"] for r in q_search._tags(spark, DATA).select("tag").distinct().collect()}
    wanted = [(a, b, len(grams(a) & grams(b)), edits(a, b)) for a in log for b in tags if abs(len(a) - len(b)) <= 2 and len(grams(a) & grams(b)) >= 2]
    wanted = sorted(w for w in wanted if w[3] <= 2)
    assert wanted and sorted(tuple(r) for r in catalog.queries()["d19_fuzzy_candidates"](spark, DATA).collect()) == wanted


def test_fuzzy_top_up_adds_what_all_pairs_hold(spark):
    """The page holds the exact hits, then the best other items by score that pass the filter."""
    items = fixtures.items(spark, DATA)
    words = "en src1 thnterble zz"
    exact = [r["id"] for r in items.where("not nsfw").collect() if all(w in (r["name"] + r["title"]).lower() for w in ["zz"]) and all(w in str(r.asDict()).lower() for w in ["src1", "thnterble"])]
    texts = [(r["id"], r["choice"]) for r in fuzzy_text(items.where("not nsfw")).collect()]
    parsed = q_search.search.parse_query(spark, words)
    asked = " ".join((*parsed.long_terms, *parsed.short_terms))
    scored = sorted((-weighted_ratio(asked, t or ""), i) for i, t in texts)
    wanted = [i for s, i in scored[:50] if s <= -75 and i not in exact][:20]
    rows = sorted(catalog.queries()["d20_search_fuzzy_top_up"](spark, DATA).collect(), key=lambda r: r["rank"])
    assert not exact and wanted and [r["id"] for r in rows] == wanted
    assert [r["rank"] for r in rows] == list(range(1, len(wanted) + 1)) and all(r["fuzzy_used"] and r["total"] == len(wanted) for r in rows)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(catalog.queries())

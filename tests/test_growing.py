"""Components that grow by batches of links equal components from scratch."""

from __future__ import annotations

import random

import pytest

from medialake.operators.graph import connected_components
from medialake.operators.growing import Components


def rows_of(frame):
    return sorted((r["node"], r["component"]) for r in frame.collect())


@pytest.mark.parametrize("seed,kind", [(1, "long"), (2, "string")])
def test_batches_of_links_equal_all_links_at_once(spark, seed, kind):
    draw = random.Random(seed)
    name = (lambda k: k) if kind == "long" else (lambda k: f"{k:04x}")
    schema = f"a {kind}, b {kind}"
    batch = lambda n, of: [(name(draw.randrange(of)), name(draw.randrange(of))) for _ in range(n)]
    links = batch(40, 300)
    now = Components.create(spark.createDataFrame(links, schema), buckets=32)
    for n, of in ((10, 300), (5, 20), (0, 1), (30, 900), (60, 300)):
        some = [*batch(n, of), (None, name(1)), (name(7), name(7))]
        links += some
        later = now.add(spark.createDataFrame(some, schema))
        wanted = rows_of(connected_components(spark.createDataFrame(links, schema), "a", "b"))
        assert rows_of(later.read()) == wanted and rows_of(later.by_component.read()) == wanted
        now = later


def test_only_touched_buckets_are_written(spark):
    chains = [(10 * c + k, 10 * c + k + 1) for c in range(40) for k in range(4)]
    now = Components.create(spark.createDataFrame(chains, "a long, b long"), buckets=64)
    later = now.add(spark.createDataFrame([(22, 31), (23, 32)], "a long, b long"))
    assert {r["component"] for r in later.read().where("node between 30 and 34").collect()} == {20}
    for old, new in ((now.by_node, later.by_node), (now.by_component, later.by_component)):
        assert 0 < sum(new.held.get(b) != x for b, x in old.held.items()) <= 7
    same = later.add(spark.createDataFrame([(20, 34)], "a long, b long"))
    assert same.by_node is later.by_node and same.by_component is later.by_component

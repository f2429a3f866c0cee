"""Connected components that are kept while links arrive, of which only the touched ones are visited.

Two tables hold the same rows: by node, to find the components of new links' ends, and by component, to find the
nodes of components that grow together. A batch of links is contracted to links between components,
whose own components are found; all else stays as it is, in memory, in the plan and on disk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators.graph import connected_components
from medialake.operators.keyed_table import BUCKETS, KeyedTable, bucket_of
from medialake.plans.shared import stored


@dataclass(frozen=True)
class Components:
    """(node, component) of every node that has had a link; a component is named by its smallest node."""

    by_node: KeyedTable
    by_component: KeyedTable

    @classmethod
    def create(cls, links: DataFrame, left: str = "a", right: str = "b", buckets: int = BUCKETS) -> Components:
        found = stored(connected_components(links, left, right).select("node", "component"))
        return cls(KeyedTable.create(found, "node", buckets), KeyedTable.create(found, "component", buckets))

    def read(self) -> DataFrame:
        return self.by_node.read()

    def add(self, links: DataFrame, left: str = "a", right: str = "b") -> Components:
        """The components with the links as well; those with a null end and loops are passed over."""
        ends = stored(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v").distinct())
        nodes = stored(ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct())
        known = stored(_rows_of(self.by_node, nodes.select("node")))
        # A node that is new is a component of its own.
        named = nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        of = lambda end, to: named.select(F.col("node").alias(end), F.col("component").alias(to))
        between = ends.join(of("u", "x"), "u").join(of("v", "y"), "v").select("x", "y")
        merged = connected_components(between, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("name"))
        # Only components that get another name move; new nodes come in under theirs.
        renamed = stored(merged.where("component <> name"))
        moved = _rows_of(self.by_component, renamed.select("component")).join(renamed, "component").select("node", F.col("name").alias("component"))
        fresh = nodes.join(known, "node", "left_anti").join(merged, F.col("node") == F.col("component")).select("node", F.col("name").alias("component"))
        rows = stored(moved.unionByName(fresh))
        grown = rows.select("component").distinct()
        whole = _rows_of(self.by_component, grown).select("node", "component").unionByName(rows)
        return Components(self.by_node.update(rows.select("node"), rows), self.by_component.update(renamed.select("component"), whole))


def _rows_of(table: KeyedTable, keys: DataFrame) -> DataFrame:
    """The rows of some keys (a column named as the key), from their buckets only."""
    buckets = {r[0] for r in keys.select(bucket_of(table.key, table.buckets)).distinct().collect()}
    return table.read(buckets).join(keys.distinct(), table.key, "left_semi")

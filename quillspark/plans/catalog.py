"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import forest
from quillspark.plans import reference_queries
from quillspark.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node of every paper version."""
    return forest.resolve_forest(table(spark, d, "hierarchy"), ["paper_id", "version_num"], "child_id", "parent_id", "edge_no")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every node that reaches a root, as one string."""
    from pyspark.sql import functions as F

    p = forest.resolve_forest(table(spark, d, "hierarchy"), ["paper_id", "version_num"], "child_id", "parent_id", "edge_no", with_path=True)
    return p.filter(F.col("path").isNotNull()).select("paper_id", "version_num", "child_id", F.array_join("path", "/").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node below every node, with its distance."""
    tree = ["paper_id", "version_num"]
    return forest.descendants(forest.resolve_forest(table(spark, d, "hierarchy"), tree, "child_id", "parent_id", "edge_no", with_path=True), tree, "child_id")


_CHAIN = """
WITH RECURSIVE n AS (
  SELECT paper_id, version_num, child_id, min(CASE WHEN trim(parent_id) <> '' THEN parent_id END) AS parent_id
  FROM hierarchy WHERE child_id IS NOT NULL GROUP BY ALL),
up AS (
  SELECT paper_id, version_num, child_id, child_id AS at, 0 AS depth, [child_id] AS path FROM n
  UNION ALL
  SELECT u.paper_id, u.version_num, u.child_id, n.parent_id, u.depth + 1, list_prepend(n.parent_id, u.path)
  FROM up u JOIN n ON n.paper_id = u.paper_id AND n.version_num = u.version_num AND n.child_id = u.at
  WHERE n.parent_id IS NOT NULL AND NOT list_contains(u.path, n.parent_id)),
top AS (
  SELECT u.* FROM up u LEFT JOIN n ON n.paper_id = u.paper_id AND n.version_num = u.version_num AND n.child_id = u.at
  WHERE n.parent_id IS NULL)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
} | reference_queries.QUERIES

SQL: dict[str, str] = {
    "p6_found": _CHAIN + "SELECT n.paper_id, n.version_num, n.child_id, coalesce(top.at, '') AS root_id, CAST(coalesce(top.depth, -1) AS INTEGER) AS depth FROM n LEFT JOIN top USING (paper_id, version_num, child_id)",
    "p6_paths": _CHAIN + "SELECT paper_id, version_num, child_id, array_to_string(path, '/') AS path FROM top",
    "p6_descendants": _CHAIN + "SELECT paper_id, version_num, path[CAST(i AS INTEGER)] AS ancestor_id, child_id AS descendant_id, CAST(depth + 1 - i AS INTEGER) AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM top)",
} | reference_queries.SQL

"""Connected components over an edge table, by contraction: no step gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (node, up) with up <= node becomes (node, root), two jumps a table."""
    parent = cut(parent)
    while True:
        once, again = (parent.select(F.col("node").alias(f"_n{k}"), F.col("up").alias(f"_u{k}")) for k in (1, 2))
        first = parent.join(once, F.col("up") == F.col("_n1"), "left").select("node", F.coalesce("_u1", "up").alias("_near"))
        second = first.join(again, F.col("_near") == F.col("_n2"), "left")
        jumped = cut(second.select("node", F.coalesce("_u2", "_near").alias("up"), (F.coalesce("_u2", "_near") != F.col("_near")).alias("moved")))
        drop(parent)
        parent = jumped
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, root long), root the smallest node reachable.

    Each round hooks every node to its smallest neighbour, flattens the trees by pointer
    jumping and contracts them; rounds end when no edge joins two trees. Rows with a null
    end and self-links are ignored; no edges give no rows. Nodes without edges don't appear.
    The result is a table of cut().
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("_a"), F.col("b").alias("_b")).where("_a is not null and _b is not null and a <> b").select("a", "b").distinct())
    found: DataFrame | None = None
    while True:
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("up")), F.struct(F.col("b").alias("node"), F.col("a").alias("up")))).alias("e")).select("e.*")
        level = _roots(ends.groupBy("node").agg(F.min("up").alias("up")))
        step = level.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
        if found is None:
            now = cut(level.select("node", F.col("up").alias("root")))
        else:
            now = cut(found.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_up", "root").alias("root")))
        up_a, up_b = (level.select(F.col("node").alias(x), F.col("up").alias(f"_{x}")) for x in "ab")
        rest = cut(left.join(up_a, "a").join(up_b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        drop(found, left, level)
        found, left = now, rest
        if left.isEmpty():
            drop(left)
            return found

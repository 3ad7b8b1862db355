"""Parent–child links to full hierarchies.

Method: level-wise frontier joins. Level 0 are the roots; each round joins the links to the nodes
reached last and extends path and depth. Ancestor pairs out of the paths yield descendants; nodes that
no round reaches hang on a cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import cut_lineage


@dataclass
class Hierarchy:
    """``nodes``: (tree, node, parent, root, depth, path), one row per reached node; depth of a root is 0.
    ``spoilt``: (tree, node, parent), the nodes whose chain of parents runs into a cycle."""

    nodes: DataFrame
    spoilt: DataFrame


def links(rows: DataFrame, tree: str, node: str, parent: str, order: str | None = None) -> DataFrame:
    """One link per (tree, node): (tree, node, parent); parent null where it is null, empty or unknown.

    Repeats collapse; of rows that contradict each other the one with the largest ``order`` counts (then
    the largest parent). A null tree is a tree of its own. Rows with a null node name nothing and
    are left out; columns other than those named are ignored.
    """
    rank = F.struct(*([F.col(order).alias("o")] if order else []), F.col(parent).alias("p"))
    one = (
        rows.where(F.col(node).isNotNull())
        .groupBy(F.col(tree).alias("tree"), F.col(node).alias("node"))
        .agg(F.max(rank)["p"].alias("parent"))
    )
    known = one.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"))
    named = F.nullif(F.col("parent"), F.lit(""))
    return one.join(
        known, F.col("tree").eqNullSafe(F.col("k_tree")) & (named == F.col("k_node")), "left"
    ).select("tree", "node", F.col("k_node").alias("parent"))


def build_hierarchy(link_rows: DataFrame, max_levels: int | None = None, paths: bool = True) -> Hierarchy:
    """Reach every node from its root, level by level.

    ``link_rows`` as from :func:`links`. The number of rounds is the depth of the deepest tree. A round joins the nodes
    not yet reached with the frontier and writes them once, marked reached or not; only those left over take part in
    the next, so what is shuffled shrinks with the trees. Joins are on (tree, parent), not on the tree alone, so a tree
    with a third of all rows is spread; a parent with very many children is split by AQE's skew join, as the children
    are the larger side. What no round reaches hangs on a cycle. ``max_levels`` raises instead of truncating when a chain
    is deeper. Without ``paths`` the frontier carries names only, and ``nodes`` has tree and node alone.
    """
    edges = cut_lineage(link_rows)
    carried = ["root", "depth", "path"] if paths else []
    begin = {"root": F.col("node"), "depth": F.lit(0), "path": F.array("node")}
    frontier = edges.where(F.col("parent").isNull()).select("tree", "node", "parent", *[begin[c].alias(c) for c in carried])
    waiting = edges.where(F.col("parent").isNotNull())
    levels = [frontier]
    while True:
        met = frontier.select(F.col("tree").alias("f_tree"), F.col("node").alias("f_node"), *[F.col(c).alias(f"f_{c}") for c in carried])
        after = {"root": F.col("f_root"), "depth": F.col("f_depth") + 1, "path": F.concat("f_path", F.array("node"))}
        step = cut_lineage(
            waiting.join(met, F.col("tree").eqNullSafe(F.col("f_tree")) & (F.col("parent") == F.col("f_node")), "left").select(
                "tree", "node", "parent", *[after[c].alias(c) for c in carried], F.col("f_node").isNotNull().alias("reached")
            ),
            bare=True,
        )
        frontier = step.where("reached").drop("reached")
        waiting = step.where("NOT reached").select("tree", "node", "parent")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if max_levels is not None and len(levels) - 1 > max_levels:
            raise ValueError(f"a chain of parents is deeper than {max_levels}")
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return Hierarchy(nodes if paths else nodes.select("tree", "node"), waiting)


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """(tree, ancestor, descendant, distance), a row per pair; as many as the sum of all depths."""
    return nodes.select(
        "tree",
        F.col("node").alias("descendant"),
        "depth",
        F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "ancestor"),
    ).select("tree", "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """(tree, node, n_descendants, height): a row per node that has descendants, combined on the map side."""
    return (
        ancestor_pairs(nodes)
        .groupBy("tree", F.col("ancestor").alias("node"))
        .agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))
    )

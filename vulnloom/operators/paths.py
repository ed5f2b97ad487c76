"""Depths and shortest chains in dependency graphs, as bounded frontier joins.

A round joins the frontier with the edges of its own scan, drops nodes reached before, and is written as a table in the
shared folder, so lineage stays short and a lost executor costs one round.  All scans advance together: the number of
rounds is the longest depth, not the number of scans.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnloom.sources.shared import drop_stored, stored
from vulnloom.sources.testbed import Graph

HOPS = 12
#: Rounds after which what they reached is written as one table.
FOLD = 8


def prune_flat(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges without a root's links to components that some other component also depends on.

    Generators often list every component under the root; where the real parent is known, the flat link goes.
    """
    marked = edges.join(roots.select("scan_id", F.col("root").alias("_root")), "scan_id", "left")
    mine = F.coalesce(F.col("src") == F.col("_root"), F.lit(False))
    deep = marked.filter(~mine).select("scan_id", "dst").distinct()
    flat = marked.filter(mine).drop("_root").join(deep, ["scan_id", "dst"], "left_anti")
    return marked.filter(~mine).drop("_root").unionByName(flat.select("scan_id", "src", "dst"))


def sources_only(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(scan_id, node): nodes that nothing depends on, the root left out."""
    nodes = edges.select("scan_id", F.col("src").alias("node")).distinct()
    return nodes.join(edges.select("scan_id", F.col("dst").alias("node")), ["scan_id", "node"], "left_anti").join(roots.select("scan_id", F.col("root").alias("node")), ["scan_id", "node"], "left_anti")


def replace_virtual(heads: DataFrame, edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Nodes of ``heads`` that are no component of ``valid`` (scan_id, node) give way to their children, one level."""
    real = heads.join(valid, ["scan_id", "node"], "left_semi")
    virtual = heads.join(valid, ["scan_id", "node"], "left_anti")
    children = virtual.join(edges.withColumnRenamed("src", "node"), ["scan_id", "node"]).select("scan_id", F.col("dst").alias("node"))
    return real.union(children).distinct()


def direct_dependencies(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(scan_id, node): the root's children after pruning; of scans whose root has none, the nodes nothing depends on."""
    return _direct(prune_flat(edges, roots), roots)


def _direct(pruned: DataFrame, roots: DataFrame) -> DataFrame:
    led = pruned.join(roots.withColumnRenamed("root", "src"), ["scan_id", "src"], "left_semi")
    heads = sources_only(pruned, roots).join(led.select("scan_id"), "scan_id", "left_anti")
    return led.select("scan_id", F.col("dst").alias("node")).union(heads).distinct()


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(scan_id, node, depth): least number of links from the root (0); cycles are harmless.

    Edges are made and pruned once; rounds end when one reaches nothing new, however deep a graph is.
    """
    edges, roots = stored(edges, "edges"), stored(roots, "roots")
    pruned = stored(prune_flat(edges, roots), "pruned")
    start = roots.join(edges.select("scan_id").distinct(), "scan_id", "left_semi").select("scan_id", F.col("root").alias("node"), F.lit(0).alias("depth"))
    first = _direct(pruned, roots).join(start.select("scan_id", "node"), ["scan_id", "node"], "left_anti")
    frontier = stored(first.withColumn("depth", F.lit(1)), "frontier")
    folded = stored(start.union(frontier), "reached")
    drop_stored(frontier)
    seen, rounds = folded, []
    for depth in count(2):
        last = rounds[-1] if rounds else folded.filter(F.col("depth") == depth - 1)
        step = last.join(pruned.withColumnRenamed("src", "node"), ["scan_id", "node"]).select("scan_id", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen, ["scan_id", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        seen = seen.union(frontier)
        if len(rounds) == FOLD:
            # What was reached so far becomes one table, so a deep graph does not read a table for every round in each.
            seen = stored(seen, "reached")
            for old in (folded, *rounds):
                drop_stored(old)
            folded, rounds = seen, []
    for old in (frontier, pruned, edges, roots):
        drop_stored(old)
    return seen


def shortest_chains(edges: DataFrame, starts: DataFrame, targets: DataFrame, hops: int = HOPS) -> DataFrame:
    """(scan_id, root, target, hops, chain): one shortest chain per root and target, the least in order of its nodes.

    ``starts`` (scan_id, root), ``targets`` (scan_id, target).  A start that is a target is a chain of itself.
    Edges are cut to the scans of targets and written once, as are targets; per (scan, root, node) only the least chain is kept.
    """
    targets = stored(targets.distinct(), "targets")
    scans = targets.select("scan_id").distinct()
    edges = stored(edges.join(scans, "scan_id", "left_semi").select("scan_id", "src", "dst"), "edges")
    frontier = starts.join(scans, "scan_id", "left_semi").select("scan_id", "root", F.col("root").alias("node"), F.array("root").alias("chain")).distinct()
    frontier = stored(frontier, "chains")
    seen = frontier
    for _ in range(hops):
        step = frontier.join(edges.withColumnRenamed("src", "node"), ["scan_id", "node"]).select("scan_id", "root", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        best = step.join(seen, ["scan_id", "root", "node"], "left_anti").groupBy("scan_id", "root", "node").agg(F.min("chain").alias("chain"))
        frontier = stored(best, "chains")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    drop_stored(edges)
    found = seen.withColumnRenamed("node", "target").join(targets, ["scan_id", "target"], "left_semi")
    return found.select("scan_id", "root", "target", (F.size("chain") - 1).alias("hops"), "chain")


def dependency_chains(g: Graph, targets: DataFrame) -> DataFrame:
    """Shortest chains from direct dependencies to ``targets`` (scan_id, component_id), with the root's depth added up."""
    direct = g.has_component.filter("is_direct").select("scan_id", F.col("component_id").alias("root"), F.col("depth").alias("root_depth"))
    chains = shortest_chains(g.depends_on, direct.select("scan_id", "root"), targets.select("scan_id", F.col("component_id").alias("target")))
    met = chains.join(direct, ["scan_id", "root"])
    return met.select("scan_id", "root", "target", "hops", F.array_join("chain", ">").alias("chain"), (F.col("root_depth") + F.col("hops")).alias("reached_depth"))

"""Dependency levels of a child -> parent graph held as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.skew import join_unique
from rowloom.session import reliable_checkpoint


def self_references(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("child") == F.col("parent"))


def _peel(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Take away nodes whose parents are all gone, round by round.

    Returns the nodes of each round and the edges that never come free. Every
    round's frames are checkpointed, so plans stay short and a lost executor
    costs one round.
    """
    pending = reliable_checkpoint(edges.select("child", "parent").distinct())
    children = pending.select(F.col("child").alias("node")).distinct()
    parents = pending.select(F.col("parent").alias("node")).distinct()
    free = reliable_checkpoint(parents.join(children, "node", "left_anti"))
    rounds = []
    while not free.isEmpty():
        rounds.append(free)
        rest = reliable_checkpoint(
            join_unique(pending, free.select(F.col("node").alias("parent")), ["parent"], "left_anti").select("child", "parent")
        )
        before = pending.select(F.col("child").alias("node")).distinct()
        after = rest.select(F.col("child").alias("node")).distinct()
        free = reliable_checkpoint(before.join(after, "node", "left_anti"))
        pending = rest
    return rounds, pending


def one_cycle(edges: DataFrame) -> DataFrame:
    """(child, parent): the edges of one cycle, no rows if there is none.

    It is the cycle that a walk from the smallest node ends in, always to the smallest parent,
    among the nodes on cycles or between them. The walk is not taken edge by edge: steps are
    doubled until they are as long as there are nodes, and so is the way around the cycle.
    """
    return _walked_cycle(_peel(edges)[1])


def _walked_cycle(stuck: DataFrame) -> DataFrame:
    # what is stuck also holds nodes below a cycle; taking those away from the other side leaves cycles and the ways between them
    _, core = _peel(stuck.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    step = reliable_checkpoint(core.groupBy(F.col("parent").alias("child")).agg(F.min("child").alias("parent")))
    jumps = [step]
    for _ in range(step.count().bit_length()):
        far = jumps[-1].select(F.col("child").alias("parent"), F.col("parent").alias("end"))
        jumps.append(reliable_checkpoint(join_unique(jumps[-1], far, ["parent"], "inner").select("child", F.col("end").alias("parent"))))
    # the last jump is longer than any way into a cycle
    around = jumps[-1].join(step.agg(F.min("child").alias("child")), "child").select(F.col("parent").alias("node"))
    for jump in jumps:
        ahead = jump.join(around.select(F.col("node").alias("child")), "child").select("parent")
        around = reliable_checkpoint(around.union(ahead).distinct())
    return step.join(around.select(F.col("node").alias("child")), "child", "left_semi")


def dependency_levels(edges: DataFrame) -> DataFrame:
    """(node, level): roots are level 0, others one more than their highest parent. Cycles raise."""
    if not self_references(edges).isEmpty():
        edge = self_references(edges).first()
        raise ValueError(f"self reference: {edge['child']}")
    rounds, stuck = _peel(edges)
    if not stuck.isEmpty():
        edge = _walked_cycle(stuck).orderBy("child").first()
        raise ValueError(f"cycle through {edge['child']} -> {edge['parent']}")
    levels = [nodes.select("node", F.lit(i).cast("bigint").alias("level")) for i, nodes in enumerate(rounds)]
    if not levels:
        return edges.select(F.col("child").alias("node"), F.lit(0).cast("bigint").alias("level")).limit(0)
    return reduce(DataFrame.unionAll, levels)


def load_order(edges: DataFrame, parents_first: bool = True) -> DataFrame:
    """Levels in the order tables can be loaded, or emptied."""
    levels = dependency_levels(edges)
    return levels.orderBy(F.col("level") if parents_first else F.col("level").desc(), "node")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or below one: those no loading order can reach."""
    _, stuck = _peel(edges)
    return stuck.select(F.col("child").alias("node")).distinct()


def adjacent(edges: DataFrame, node) -> DataFrame:
    """Parents of one node."""
    return edges.filter(F.col("child") == F.lit(node)).select(F.col("parent").alias("node")).distinct()


def edge_value(edges: DataFrame, child, parent, payload: str) -> DataFrame:
    """What an edge carries."""
    return edges.filter((F.col("child") == F.lit(child)) & (F.col("parent") == F.lit(parent))).select(payload).distinct()

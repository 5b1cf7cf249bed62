"""Connected components of an edge list, by DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import checkpoint_root

MOST_ROUNDS = 60
#: Edges up to which a graph is solved in one task: so few hold less than the shuffles of a round would cost.
ONE_TASK_EDGES = 100_000


def _roots(labels: DataFrame) -> DataFrame:
    """(node, label) with every label followed to its own label until it stays: pointer jumping."""
    for _ in range(MOST_ROUNDS):
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = labels.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), (F.col("above") < F.col("label")).alias("moved")).checkpoint()
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError(f"labels still move after {MOST_ROUNDS} rounds")


def _in_one_task(batches):
    """(a, b) edges to (node, component), by union-find."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([find(x) for x in nodes], pa.string())], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, for nodes that have an edge.

    edges: string columns a and b. Up to ONE_TASK_EDGES edges are solved in one task, and its rows dealt evenly. Beyond
    that, each round gives every node its smallest neighbour, follows these pointers to their roots, and contracts the
    graph to the roots, which at least halves the nodes that still have edges. Rounds are written to the shared
    checkpoint folder, so lineage stays short. Only a few flags reach the driver.
    """
    checkpoint_root(edges.sparkSession)
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    if left.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return left.coalesce(1).mapInArrow(_in_one_task, "node string, component string").repartition("node")
    rounds: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        both = left.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label").union(left.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        labels = _roots(both.groupBy("node").agg(F.min("label").alias("label")).checkpoint())
        rounds.append(labels)
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))  # noqa: B023, E731
        left = left.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct().checkpoint()
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"edges are left after {MOST_ROUNDS} rounds")
    out = rounds[0]
    for labels in rounds[1:]:
        out = out.join(labels.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return out.select("node", F.col("label").alias("component"))

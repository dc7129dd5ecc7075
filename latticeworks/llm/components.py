"""Connected components by least labels and pointer jumping.

Every node starts with the smallest id among itself and its neighbours. A round passes labels along edges, keeps the least, and then
replaces each label by its label's label, so that long chains shrink by half or more each time. It ends when no label changes. Every
round is a written table, so that a lost executor costs one round. A node's neighbours are never gathered: a round takes grouped
minima, which tasks pre-aggregate, and joins between stored tables, of which Spark can split a hot node's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b), of any ordered type; component is the smallest node reachable.

    Loops and null ends are ignored; repeated edges are harmless.
    """
    ends = edges.where("a <> b")
    both = work.put(ends.select("a", "b").unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = work.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).select("node", F.least("node", "component").alias("component")), f"{name}-0")
    before = None
    for i in range(1, rounds + 1):
        state = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            work.drop(f"{name}-edges")
            return labels
        before = state
        passed = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "component").unionAll(labels)
        least = work.put(passed.groupBy("node").agg(F.min("component").alias("component")), f"{name}-{i}-least")
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = work.put(least.join(jump, "component").select("node", F.col("further").alias("component")), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}", f"{name}-{i}-least")
    raise RuntimeError(f"not converged after {rounds} rounds")

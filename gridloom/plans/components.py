"""Connected components by contraction, with DataFrame operations only.

Each round points every node at the smallest node among itself and its neighbours, follows the
pointers one step further, and rewrites the edges between what the nodes point at. Edges inside one
group vanish, so the graph shrinks geometrically; a hub's neighbours meet in a partial aggregate and
never in one task. Every round's tables are cut, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.plans.lineage import cut, discard, keep, scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge between two different nodes; root is the component's smallest node.

    Direction, repetition and self loops of edges don't matter; edges with a null end are ignored.
    Nodes without an edge to another node are not returned. Raises after ``max_rounds``.
    """
    with scratch():
        return keep(cut(_contracted(edges, src, dst, max_rounds), "components"))


def _contracted(edges: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    live = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        far = low.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        step = cut(low.join(far, "up").select("node", F.col("up2").alias("root")), "cc-step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(left, "a").join(right, "b").where("ra <> rb")
        after = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        discard(live)
        live = after
    else:
        if not live.isEmpty():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(live)
    if not steps:
        return live.sparkSession.createDataFrame([], live.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)
    out = steps[-1]
    for step in reversed(steps[:-1]):
        onward = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = step.join(onward, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return out

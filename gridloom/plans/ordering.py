"""Positions and running sums over a whole table, without one task that sees all rows.

Rows are range-partitioned by the order and written down, with the number of their part. A window runs
within each part; what precedes a part is a sum over the parts before it, of which there are as many
as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.plans.lineage import cut, discard, keep, scratch


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with a column per entry of ``sums``: the running total, in the given order, of its expression, this row included.

    Rows that tie in the order are added one by one, in any sequence; give an order without ties.
    """
    keys = {f"__k{i}": c if not isinstance(c, str) else F.col(c) for i, c in enumerate(order)}
    named = df.select("*", *[F.expr(e).alias(f"__s_{name}") if isinstance(e, str) else e.alias(f"__s_{name}") for name, e in sums.items()])
    ranged = named.repartitionByRange(*keys.values()).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(*[F.sum(f"__s_{name}").alias(f"__p_{name}") for name in sums])
    parts = parts.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__p_{name}").over(before), F.lit(0)).alias(f"__b_{name}") for name in sums])
    within = Window.partitionBy("__part").orderBy(*keys.values()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(parts, F.col("__part") == F.col("__of"))
    totals = [(F.sum(f"__s_{name}").over(within) + F.col(f"__b_{name}")).alias(name) for name in sums]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *totals)


def positions(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the row's place in the given order, from 0."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


#: Rows of a group that one task ranks; groups beyond are ranked by range.
HOT_GROUP = 100_000


def places(df: DataFrame, keys: list[str], order: list[str], place: str, size: str) -> DataFrame:
    """df with the row's place in its group, from 0, and the group's size; a hot group is ranked by several tasks.

    Rows of hot groups are numbered together, by group and order; a group's place is what lies before its first.
    """
    named = [F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]
    with scratch():
        hot = keep(cut(df.groupBy(*named).agg(F.count("*").alias(size)).where(F.col(size) > HOT_GROUP), "hot-groups"))
    own = Window.partitionBy(*keys)
    ranked = lambda rows: rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.row_number().over(own.orderBy(*order)) - 1).cast("long").alias(place), F.count("*").over(own).alias(size))
    if hot.isEmpty():
        discard(hot)
        return ranked(df)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    numbered = positions(df.join(hot.drop(size), same, "left_semi"), [*keys, *order], "__at")
    firsts = numbered.groupBy(*named).agg(F.min("__at").alias("__first"), F.count("*").alias(size))
    out = numbered.join(firsts, same).withColumn(place, F.col("__at") - F.col("__first"))
    return ranked(df.join(hot.drop(size), same, "left_anti")).union(out.select(*[F.col(f"`{c}`") for c in df.columns], place, size))


def previous(df: DataFrame, order: list[str], value, name: str) -> DataFrame:
    """df with the value of the row before it in the given order, over the whole table; null for the first."""
    ranged = cut(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("__part").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    ends = ends.select(F.col("__part").alias("__of"), F.lag("__end").over(Window.orderBy("__part")).alias("__end"))
    within = Window.partitionBy("__part").orderBy(*order)
    out = ranged.withColumns({"__n": F.row_number().over(within), "__l": F.lag("__v").over(within)}).join(ends, F.col("__part") == F.col("__of"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("__n") == 1, F.col("__end")).otherwise(F.col("__l")).alias(name))

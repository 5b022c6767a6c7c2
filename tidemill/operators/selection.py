"""Exact ranks without a sort in one task: medians by counting in narrowing ranges, row numbers from the totals of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import cut

#: Ranges that the open values of a group are counted in, a round.
RANGES = 2048


def medians(rows: DataFrame, group: list[str], value: Column | str, name: str = "median") -> DataFrame:
    """group and the exact median of the known values of each group (the mean of the two middle ones); groups without values are left out.

    The lowest and highest value of a group are cut into RANGES ranges, and the values of each are counted, with their
    own lowest and highest. The range that holds the wanted place is cut again, until it holds one value. Every round
    parts the lowest from the highest, so it ends; a group costs RANGES small rows a round, however many values it has
    and however few groups there are.
    """
    v = F.col(value) if isinstance(value, str) else value
    known = cut(rows.select(*group, v.cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    ends = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    middle = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    targets = cut(ends.select(*group, "_lo", "_hi", F.explode(middle).alias("_k")).withColumn("_left", F.col("_k")))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    on = same[0] if same else F.lit(True)
    for s in same[1:]:
        on = on & s
    while not targets.where("_lo < _hi").isEmpty():
        open_ = targets.where("_lo < _hi")
        inside = known.alias("r").join(open_.alias("t"), on & F.col("r._v").between(F.col("t._lo"), F.col("t._hi")))
        # halves first, so that no difference of two doubles overflows
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        ranged = inside.select(*(F.col(f"t.{c}").alias(c) for c in group), "_k", "_left", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_b"), "_v")
        counted = ranged.groupBy(*group, "_k", "_left", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        below = F.sum("_n").over(Window.partitionBy(*group, "_k").orderBy("_b")) - F.col("_n")
        found = counted.withColumn("_below", below).where("_below <= _left and _left < _below + _n")
        targets = cut(targets.where("_lo >= _hi").unionByName(found.select(*group, "_lo", "_hi", "_k", (F.col("_left") - F.col("_below")).alias("_left"))))
    return targets.groupBy(*group).agg(F.avg("_lo").alias(name))


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """rows with their place (from 1) in an order: sorted by ranges of it, places start after the totals of the ranges before.

    Rows that are equal in order follow each other as they come; give an order without ties for the same places each time.
    """
    laid = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    # one row for each range
    totals = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    start = totals.withColumn("_start", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows"))
    return laid.join(start, "_part").withColumn(name, F.col("_start") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_rows", "_first", "_start")

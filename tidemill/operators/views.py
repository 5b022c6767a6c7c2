"""Small views over facts and dimensions: option lists, bounds, orders and the ends of a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import filters


def options(dim: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value: the distinct known values of each column, from one pass."""
    each = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))
    return dim.select(F.inline(each)).where("value is not null").distinct()


def in_segment(recipient: DataFrame, resolved: DataFrame, employee: DataFrame, given: dict[str, list]) -> DataFrame:
    """recipients whose one employee is in the chosen departments, regions and grades (an empty list is no limit); others go only if there is a limit."""
    if not any(given.values()):
        return recipient
    chosen = employee.where(filters(given)).select("employee_key")
    return recipient.join(resolved.join(chosen, "employee_key", "left_semi"), recipient.recipient_key == resolved.id_key, "left_semi")


def bounds(facts: DataFrame, column: str) -> DataFrame:
    """First, last and rows."""
    return facts.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("rows"))


def lowest(rows: DataFrame, by: str, then: str, n: int = 5) -> DataFrame:
    """The n rows with the smallest known value, ties by another column."""
    return rows.where(F.col(by).isNotNull()).orderBy(by, then).limit(n)


def stuck(rows: DataFrame, done: str, progress: str) -> DataFrame:
    """rows with known progress that are not known to be done."""
    return rows.where(~F.col(done).eqNullSafe(True) & F.col(progress).isNotNull())


def in_order(rows: DataFrame, by: str, then: str) -> DataFrame:
    """Rows with their place by falling value, unknown values last; for as many rows as there are channels."""
    return _placed(rows, [F.when(F.col(by).isNull(), 1).otherwise(0), -F.col(by), F.col(then)])


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place by rising columns; for as many rows as there are channels and stages."""
    return _placed(rows, [F.col(c) for c in by])


def _placed(rows: DataFrame, keys: list) -> DataFrame:
    line = rows.agg(F.array_sort(F.collect_list(F.struct(*(k.alias(f"_{i}") for i, k in enumerate(keys)), F.struct("*").alias("row")))).alias("line"))
    placed = line.select(F.posexplode("line").alias("at", "x"))
    return placed.select("x.row.*", (F.col("at") + 1).alias("place"))

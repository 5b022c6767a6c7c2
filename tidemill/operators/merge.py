"""Merges that never lose what was known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ["targeted", "delivered", "opened", "engaged", "completed"]
STAMPS = ["targeted_at", "opened_at", "engaged_at", "completed_at"]


def monotonic(existing: DataFrame, new: DataFrame, keys: list[str], highest: list[str], newest: list[str], batch: str = "batch_id") -> DataFrame:
    """True beats false beats unknown, earliest stamps, highest measures, newest known of the rest.

    One commutative aggregation over both sides: order and repetition of loads do not matter. Of several rows of one
    batch the largest known value is the newest, so that every order of rows gives the same.
    """
    both = existing.unionByName(new, allowMissingColumns=True)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(batch, c))).alias(c)
    return both.groupBy(*keys).agg(*(F.max(c).alias(c) for c in FLAGS), *(F.min(c).alias(c) for c in STAMPS), *(F.max(c).alias(c) for c in highest), *(known(c) for c in newest), F.max(batch).alias(batch))


def collapse(rows: DataFrame, keys: list[str], flags: list[str], stamps: list[str], highest: list[str], last: list[str], order: str) -> DataFrame:
    """Rows of one key within a file: flags by any, stamps earliest, measures highest, else the last that is known in file order."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in flags), *(F.min(c).alias(c) for c in stamps), *(F.max(c).alias(c) for c in highest), *(known(c) for c in last))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each new key replaces the existing one; other rows stay."""
    columns = existing.columns
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), order).alias("s")).select(*keys, "s.*").select(*columns)
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows with keys that do not exist yet."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def replace_slice(existing: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """Derived rows of the recomputed keys are dropped and written anew."""
    return existing.join(recomputed.select(*keys).distinct(), keys, "left_anti").unionByName(recomputed)


def filters(given: dict[str, list | None], ranges: dict[str, tuple] | None = None) -> F.Column:
    """one predicate from lists of values (empty: no limit) and (low, high) ranges (None: open)."""
    preds = [F.col(c).isin(list(v)) for c, v in given.items() if v]
    for c, (lo, hi) in (ranges or {}).items():
        preds += [F.col(c) >= F.lit(lo)] * (lo is not None) + [F.col(c) <= F.lit(hi)] * (hi is not None)
    return reduce(lambda a, b: a & b, preds, F.lit(True))

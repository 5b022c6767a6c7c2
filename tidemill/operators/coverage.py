"""Coverage by segment with disclosure control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = ["targeted", "opened", "engaged", "completed"]


def by_segment(recipient: DataFrame, resolved: DataFrame, employee: DataFrame, segment: str = "department") -> DataFrame:
    """Active headcount and distinct employees at four stages for each segment."""
    seg = F.coalesce(F.col(segment), F.lit("Unknown"))
    heads = employee.where("is_active").groupBy(seg.alias("segment")).agg(F.count(F.lit(1)).alias("headcount"))
    j = recipient.join(resolved, recipient.recipient_key == resolved.id_key)
    one = j.groupBy("employee_key").agg(*(F.bool_or(s).alias(s) for s in STAGES)).join(employee, "employee_key")
    acts = one.groupBy(seg.alias("segment")).agg(*(F.count_if(F.col(s)).alias(s) for s in STAGES))
    out = heads.join(acts, "segment", "left").select("segment", "headcount", *(F.coalesce(s, F.lit(0)).alias(s) for s in STAGES))
    return out.select("*", F.round(F.try_divide("opened", "headcount"), 6).alias("coverage_rate"), F.greatest(F.col("headcount") - F.col("opened"), F.lit(0)).alias("never_reached"))


def suppressed(coverage: DataFrame, least: int = 5) -> DataFrame:
    """Hides segments under the least size; if that hides exactly one, the smallest visible one too, so that it cannot be worked out."""
    small = F.col("headcount") < least
    whole = Window.partitionBy()
    seen = coverage.select("*", small.alias("_small"), F.sum(small.cast("int")).over(whole).alias("_n"), F.row_number().over(Window.orderBy(small, "headcount", F.desc("segment"))).alias("_rank"))
    hide = F.col("_small") | ((F.col("_n") == 1) & (F.col("_rank") == 1))
    measures = [c for c in coverage.columns if c not in ("segment", "headcount")]
    return seen.select("segment", F.when(~hide, F.col("headcount")).alias("headcount"), *(F.when(~hide, F.col(c)).alias(c) for c in measures), hide.alias("suppressed"))


def channel_mix(recipient: DataFrame, resolved: DataFrame, employee: DataFrame, segment: str = "department", least: int = 5) -> DataFrame:
    """Distinct employees targeted and reached by segment and channel; small cells are emptied."""
    j = recipient.join(resolved, recipient.recipient_key == resolved.id_key).join(employee, "employee_key")
    one = j.groupBy(F.coalesce(F.col(segment), F.lit("Unknown")).alias("segment"), "channel", "employee_key").agg(F.bool_or("opened").alias("o"))
    c = one.groupBy("segment", "channel").agg(F.count(F.lit(1)).alias("targeted"), F.count_if(F.col("o")).alias("reached"))
    show = F.col("targeted") >= least
    return c.select("segment", "channel", "targeted", F.when(show, F.col("reached")).alias("reached"), F.round(F.when(show, F.try_divide("reached", "targeted")), 6).alias("reach_rate"))


def mix_matrix(mix: DataFrame, channels: list[str]) -> DataFrame:
    """Reach rates, segments by channels."""
    return mix.groupBy("segment").pivot("channel", channels).agg(F.first("reach_rate"))


def exposure(recipient: DataFrame, resolved: DataFrame, least: int = 5) -> DataFrame:
    """Employees by the number of channels in which they opened something, none included; small cells are emptied."""
    j = recipient.join(resolved, recipient.recipient_key == resolved.id_key)
    n = j.groupBy("employee_key").agg(F.count_distinct(F.when(F.col("opened"), F.col("channel"))).alias("channels"))
    c = n.groupBy("channels").agg(F.count(F.lit(1)).alias("n"))
    return c.select("channels", F.when(F.col("n") >= least, F.col("n")).alias("employees"))

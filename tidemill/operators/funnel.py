"""Stage metrics and funnels in which unknown, not applicable and zero stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import medians

STAGES = ["targeted", "delivered", "opened", "engaged", "completed"]


def stage_rollup(recipient: DataFrame, support: DataFrame, grain: str = "month", campaigns: DataFrame | None = None) -> DataFrame:
    """Persons per campaign, channel, period and stage, long; a stage the channel cannot measure has no value.

    The period is that of the last known stamp, else of the campaign's start (campaigns: campaign_id, start_date),
    else of 1970, so that no row is lost.
    """
    stamps = [F.col(c) for c in ("completed_at", "engaged_at", "opened_at", "targeted_at")]
    if campaigns is not None:
        recipient = recipient.join(campaigns.select("campaign_id", F.col("start_date").cast("timestamp").alias("_start")), "campaign_id", "left")
        stamps += [F.col("_start"), F.lit("1970-01-01").cast("timestamp")]
    period = F.to_date(F.date_trunc(grain, F.coalesce(*stamps)))
    counts = recipient.groupBy("campaign_id", "channel", period.alias("period")).agg(*(F.count_if(F.col(s)).alias(s) for s in STAGES))
    long = counts.unpivot(["campaign_id", "channel", "period"], STAGES, "stage", "v")
    j = long.join(F.broadcast(support), ["channel", "stage"])
    return j.select("campaign_id", "channel", "stage", "period", F.lit("").alias("object"), F.when(F.col("support_status") == "measured", F.col("v")).alias("value"), F.lit("persons").alias("unit"), F.lit("sum").alias("aggregation"), "support_status")


def community_metrics(orders: DataFrame, lineitem: DataFrame, audience: int = 1000) -> DataFrame:
    """Posts at aggregate grain as stage rows: audience and viewers combine by max, interactions are events."""
    acts = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    day = (
        orders.join(acts, orders.o_orderkey == acts.l_orderkey)
        .groupBy(F.concat(F.lit("camp-"), (F.col("o_orderkey") % 6).cast("string")).alias("campaign_id"), F.col("o_orderpriority").alias("object"), F.to_date("o_orderdate").alias("d"))
        .agg(F.count_distinct("o_custkey").alias("viewers"), F.sum("n").alias("acts"))
    )
    kinds = F.array(
        F.struct(F.lit("targeted").alias("stage"), F.lit(audience).cast("long").alias("value"), F.lit("persons").alias("unit"), F.lit("max").alias("aggregation")),
        F.struct(F.lit("opened").alias("stage"), F.col("viewers").alias("value"), F.lit("persons").alias("unit"), F.lit("max").alias("aggregation")),
        F.struct(F.lit("engaged").alias("stage"), F.col("acts").alias("value"), F.lit("events").alias("unit"), F.lit("sum").alias("aggregation")),
    )
    return day.select("campaign_id", F.lit("community").alias("channel"), F.to_date(F.date_trunc("month", "d")).alias("period"), "object", F.inline(kinds)).withColumn("support_status", F.lit("measured"))


def effective_status(metric: DataFrame, support: DataFrame) -> DataFrame:
    """a row's own support status if it has one, else what its channel and stage support."""
    s = F.broadcast(support.select("channel", "stage", F.col("support_status").alias("_general")))
    return metric.join(s, ["channel", "stage"]).withColumn("support_status", F.coalesce("support_status", "_general")).drop("_general")


def policy(value: str = "value") -> F.Column:
    """Max or sum, as the grouping column aggregation says."""
    return F.when(F.col("aggregation") == "max", F.max(value)).otherwise(F.sum(value))


def stage_totals(metric: DataFrame) -> DataFrame:
    """One value per campaign, channel, stage, unit and status, combined by the row's own policy."""
    return metric.groupBy("campaign_id", "channel", "stage", "unit", "aggregation", "support_status").agg(policy().alias("value"))


def channel_wide(totals: DataFrame) -> DataFrame:
    """Stages as columns, empty where not measured; events beside persons, never mixed."""
    ok = F.col("support_status") == "measured"
    persons = [F.max(F.when(ok & (F.col("unit") == "persons") & (F.col("stage") == s), F.col("value"))).alias(s) for s in STAGES]
    events = F.max(F.when(ok & (F.col("unit") == "events") & (F.col("stage") == "engaged"), F.col("value"))).alias("engaged_events")
    return totals.groupBy("campaign_id", "channel").agg(*persons, events)


def channel_extras(recipient: DataFrame) -> DataFrame:
    """Counts, means and the median of hours (as boundaries crossed) from first contact to opening."""
    hours = (F.unix_timestamp(F.date_trunc("hour", "opened_at")) - F.unix_timestamp(F.date_trunc("hour", "targeted_at"))) / 3600
    counts = recipient.groupBy("channel").agg(
        F.count(F.lit(1)).alias("recipients"), F.count_if(F.col("opened").eqNullSafe(True)).alias("opened"), F.count_if(~F.col("opened").eqNullSafe(True)).alias("not_opened"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.avg(F.when(F.col("attempts") > 0, F.col("score") / F.col("attempts"))), 6).alias("avg_score_per_attempt"),
    )
    return counts.join(medians(recipient.where("opened"), ["channel"], hours, "median_hours").withColumnRenamed("channel", "_c"), F.col("channel").eqNullSafe(F.col("_c")), "left").drop("_c")


def unambiguous(identity: DataFrame) -> DataFrame:
    """Keys that name exactly one employee."""
    return identity.groupBy("id_key").agg(F.count_distinct("employee_key").alias("n"), F.min("employee_key").alias("employee_key")).where("n = 1").select("id_key", "employee_key")


def employee_reach(recipient: DataFrame, resolved: DataFrame, employee: DataFrame) -> DataFrame:
    """Per employee, channels targeted and opened, last stamp, any engagement."""
    j = recipient.join(resolved, recipient.recipient_key == resolved.id_key).join(employee, "employee_key", "left")
    return j.groupBy("employee_key", "department", "region").agg(F.count_distinct("channel").alias("channels"), F.count_distinct(F.when(F.col("opened"), F.col("channel"))).alias("channels_opened"), F.max("targeted_at").alias("last_at"), F.bool_or("engaged").alias("engaged"))


def identity_resolution(recipient: DataFrame, resolved: DataFrame) -> DataFrame:
    """How many recipients of a channel are known employees."""
    j = recipient.join(resolved, recipient.recipient_key == resolved.id_key, "left")
    n, k = F.count(F.lit(1)), F.count("employee_key")
    return j.groupBy("channel").agg(n.alias("recipients"), k.alias("resolved"), F.round(F.try_divide(k, n), 6).alias("rate"))


def dedupe_availability(resolution: DataFrame, least: float = 0.5, channels: int = 2) -> DataFrame:
    """Whether people can be told apart across channels: enough are known in enough channels."""
    good = F.count_if(F.try_divide(F.col("resolved"), F.greatest(F.col("recipients"), F.lit(1))) >= least)
    return resolution.agg(good.alias("channels_ok"), (good >= channels).alias("available"))


def funnel_by_channel(metric: DataFrame, support: DataFrame, channels: DataFrame) -> DataFrame:
    """Policy total per campaign, then the sum over campaigns; measured wins over not_measured over not_applicable."""
    per = stage_totals(metric).groupBy("channel", "stage").agg(F.sum("value").alias("value"), F.bool_or(F.col("support_status") == "measured").alias("m"), F.bool_or(F.col("support_status") == "not_measured").alias("u"), F.min("unit").alias("unit"))
    status = F.when(F.col("m"), "measured").when(F.col("u"), "not_measured").otherwise("not_applicable")
    j = per.join(F.broadcast(support.select("channel", "stage", "ordinal")), ["channel", "stage"]).join(F.broadcast(channels), "channel", "left")
    return j.select("channel", "sort_order", "stage", "ordinal", "value", status.alias("status"), "unit")


def combined_sum(funnel: DataFrame) -> DataFrame:
    """Per stage, the sum over channels that measure it in persons, with who contributes and who is left out."""
    usable = (F.col("status") == "measured") & (F.col("unit") == "persons") & F.col("value").isNotNull()
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("channel")))), ", ")
    return funnel.groupBy("stage", "ordinal").agg(F.sum(F.when(usable, F.col("value"))).alias("value"), names(usable).alias("contributing"), names(~usable).alias("excluded"))


def combined_dedup(recipient: DataFrame, resolved: DataFrame) -> DataFrame:
    """A10: per stage, distinct employees; flags are combined per employee first, so that people are counted once."""
    j = recipient.join(resolved, recipient.recipient_key == resolved.id_key)
    one = j.groupBy("employee_key").agg(*(F.bool_or(s).alias(s) for s in STAGES))
    counts = one.agg(*(F.count_if(F.col(s)).alias(s) for s in STAGES))
    return counts.unpivot([], STAGES, "stage", "persons")


def trend(metric: DataFrame) -> DataFrame:
    """Engaged persons by channel and period."""
    return metric.where("stage = 'engaged' and unit = 'persons' and support_status = 'measured'").groupBy("channel", "period").agg(F.sum("value").alias("engaged"))


def campaign_table(metric: DataFrame) -> DataFrame:
    """Per campaign the measured persons of four stages over all channels, and the number of channels."""
    t = stage_totals(metric)
    ok = (F.col("support_status") == "measured") & (F.col("unit") == "persons")
    return t.groupBy("campaign_id").agg(*(F.sum(F.when(ok & (F.col("stage") == s), F.col("value"))).alias(s) for s in ("targeted", "opened", "engaged", "completed")), F.count_distinct("channel").alias("channels")).orderBy(F.desc_nulls_last("targeted"), "campaign_id")


def load_quality(ledger: DataFrame) -> DataFrame:
    """One row over the load ledger: batches by outcome and the last success."""
    s = F.col("status")
    return ledger.agg(F.count(F.lit(1)).alias("batches"), F.count_if(s == "loaded").alias("loaded"), F.count_if(s == "rejected").alias("rejected"), F.count_if(s == "duplicate").alias("duplicates"), F.max(F.when(s == "loaded", F.col("stamp"))).alias("last_loaded"))


def max_stage(recipient: DataFrame) -> DataFrame:
    """the highest stage known to be reached, 0 to 5."""
    top = F.lit(0)
    for i, s in enumerate(STAGES, 1):
        top = F.when(F.col(s), i).otherwise(top)
    return recipient.select("campaign_id", "channel", "recipient_key", top.alias("max_stage"))


def stage_availability(recipient: DataFrame, support: DataFrame) -> DataFrame:
    """The declared status unless it is measured; then measured only if the data have any value."""
    any_ = recipient.groupBy("channel").agg(*(F.bool_or(F.col(s).isNotNull()).alias(s) for s in STAGES)).unpivot(["channel"], STAGES, "stage", "any")
    status = F.when(F.col("support_status") != "measured", F.col("support_status")).when(F.col("any"), "measured").otherwise("not_measured")
    return any_.join(F.broadcast(support), ["channel", "stage"]).select("channel", "stage", status.alias("status"))


def complete_grid(metric: DataFrame, support: DataFrame) -> DataFrame:
    """Every campaign with every channel and stage, those without rows too."""
    seen = metric.groupBy("campaign_id", "channel", "stage").agg(F.count(F.lit(1)).alias("rows"))
    grid = metric.select("campaign_id").distinct().crossJoin(F.broadcast(support.select("channel", "stage")))
    return grid.join(seen, ["campaign_id", "channel", "stage"], "left").select("campaign_id", "channel", "stage", F.coalesce("rows", F.lit(0)).alias("rows"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the last by order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))).where("_rn = 1").drop("_rn")

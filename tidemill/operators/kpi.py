"""Rates, indices and targets that respect units, support and small groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import medians

#: key, numerator stage, denominator stage, channels that it is for (none: all); the published set (fixed values).
KPIS = [
    ("delivery_rate", "delivered", "targeted", None),
    ("open_rate", "opened", "delivered", None),
    ("engagement_rate", "engaged", "delivered", None),
    ("click_to_open", "engaged", "opened", None),
    ("completion_rate", "completed", "targeted", ["lms", "teams"]),
    ("completion_of_starters", "completed", "opened", ["lms", "teams"]),
    ("attendance_rate", "engaged", "opened", ["teams"]),
    ("registration_rate", "opened", "targeted", ["teams"]),
    ("stayed_to_end", "completed", "engaged", ["teams"]),
    ("show_up_rate", "engaged", "targeted", ["teams"]),
]
#: Weights of the effectiveness index.
WEIGHTS = [("delivery_rate", 0.15), ("open_rate", 0.35), ("engagement_rate", 0.35), ("completion_rate", 0.15)]


def rate(num: str, den: str, num_status: str, den_status: str, num_unit: str, den_unit: str, least: int = 5) -> F.Column:
    """struct(value, status): the first that holds of not applicable, not measured, mixed units, missing, no base, small base."""
    none = F.lit(None).cast("double")
    pair = lambda v, s: F.struct(v.alias("value"), F.lit(s).alias("status"))
    return (
        F.when((F.col(num_status) == "not_applicable") | (F.col(den_status) == "not_applicable"), pair(none, "not_applicable"))
        .when((F.col(num_status) == "not_measured") | (F.col(den_status) == "not_measured"), pair(none, "not_measured"))
        .when(F.col(num_unit) != F.col(den_unit), pair(none, "not_applicable"))
        .when(F.col(num).isNull() | F.col(den).isNull() | (F.col(den) <= 0), pair(none, "no_data"))
        .when(F.col(den) < least, pair(none, "suppressed"))
        .otherwise(pair(F.try_divide(F.col(num), F.col(den)), "ok"))
    )


def channel_kpis(funnel: DataFrame, open_basis: str = "delivered") -> DataFrame:
    """Each KPI of KPIS for each channel that it is for; open_basis says what opened is measured against.

    The funnel is read once: its stages become a map for each channel, from which every KPI takes its two.
    """
    stages = F.map_from_entries(F.collect_list(F.struct("stage", F.struct("value", "status", "unit"))))
    wide = funnel.groupBy("channel").agg(stages.alias("m"))
    every = []
    for kpi, num, den, only in KPIS:
        den = open_basis if kpi == "open_rate" else den
        entry = F.struct(F.lit(kpi).alias("kpi"), F.try_element_at("m", F.lit(num)).alias("a"), F.try_element_at("m", F.lit(den)).alias("b"))
        every.append(F.when(F.col("channel").isin(only), entry) if only else entry)
    each = wide.select("channel", F.explode(F.array_compact(F.array(*every))).alias("k")).where("k.a is not null and k.b is not null")
    flat = each.select("channel", "k.kpi", *(F.col(f"k.{s}.{c}").alias(f"{n}{x}") for s, n in (("a", "num"), ("b", "den")) for c, x in (("value", ""), ("status", "_status"), ("unit", "_unit"))))
    r = flat.withColumn("r", rate("num", "den", "num_status", "den_status", "num_unit", "den_unit"))
    return r.select("channel", "kpi", "num", "den", F.round("r.value", 6).alias("value"), F.col("r.status").alias("status"))


def cross_channel(funnel: DataFrame) -> DataFrame:
    """Each KPI over all channels that measure both of its stages in one unit: both sums have one basis."""
    k = channel_kpis(funnel)
    ok = F.col("status").isin("ok", "suppressed", "no_data") & F.col("num").isNotNull() & F.col("den").isNotNull()
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("channel")))), ", ")
    s = k.groupBy("kpi").agg(F.sum(F.when(ok, F.col("num"))).alias("num"), F.sum(F.when(ok, F.col("den"))).alias("den"), names(ok).alias("basis"), names(~ok).alias("excluded"))
    return s.select("kpi", "num", "den", F.round(F.when(F.col("den") > 0, F.try_divide("num", "den")), 6).alias("value"), "basis", "excluded")


def workforce_coverage(recipient: DataFrame, resolved: DataFrame, employee: DataFrame) -> DataFrame:
    """Distinct employees who opened anything, by active headcount (inactive ones may be among the former)."""
    reached = recipient.where(F.col("opened")).join(resolved, recipient.recipient_key == resolved.id_key).agg(F.count_distinct("employee_key").alias("reached"))
    heads = employee.agg(F.count_if(F.col("is_active")).alias("headcount"))
    return reached.crossJoin(heads).select("reached", "headcount", F.round(F.try_divide("reached", "headcount"), 6).alias("coverage"))


def coverage_status(recipient: DataFrame, resolved: DataFrame, employee: DataFrame, configured: int | None = None) -> DataFrame:
    """workforce_coverage() with its status: not measured where no identity is known, the configured headcount where no employee is active, no data without either."""
    known = resolved.agg((F.count(F.lit(1)) > 0).alias("known"))
    c = workforce_coverage(recipient, resolved, employee).crossJoin(known)  # single rows
    heads = F.coalesce(F.when(F.col("headcount") > 0, F.col("headcount")), F.lit(configured).cast("long"))
    status = F.when(~F.col("known"), "not_measured").when(heads.isNull(), "no_data").otherwise("ok")
    return c.select(F.when(F.col("known"), F.col("reached")).alias("reached"), heads.alias("headcount"), F.when(status == "ok", F.round(F.col("reached") / heads, 6)).alias("coverage"), status.alias("status"))


def pass_mark(rows: DataFrame, group: str, mark: str, default: float = 70.0) -> DataFrame:
    """The commonest mark of each group, of equally common ones the smallest, and the default where none is known."""
    counts = rows.groupBy(group, mark).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(mark, F.when(F.col(mark).isNotNull(), F.struct(-F.col("n"), mark)))
    return counts.groupBy(group).agg(F.coalesce(best.cast("double"), F.lit(default)).alias("pass_mark"))


def typical_length(rows: DataFrame, group: str, minutes: str) -> DataFrame:
    """The median over groups of each group's median."""
    typical = medians(medians(rows, [group], minutes, "m").withColumn("_all", F.lit(1)), ["_all"], "m", "typical")
    # a sum over no rows gives one row of null, as a median does
    return typical.agg(F.round(F.sum("typical"), 6).alias("typical"))


def headline(funnel: DataFrame, coverage: DataFrame) -> DataFrame:
    """Four cross-channel rates and the workforce coverage."""
    four = cross_channel(funnel).where(F.col("kpi").isin("delivery_rate", "open_rate", "engagement_rate", "completion_rate")).select("kpi", "num", "den", "value")
    return four.unionByName(coverage.select(F.lit("workforce_coverage").alias("kpi"), F.col("reached").alias("num"), F.col("headcount").alias("den"), F.col("coverage").alias("value")))


def effectiveness(kpis: DataFrame) -> DataFrame:
    """Weighted mean of the available rates of a channel, weights made to sum to one, times 100; nothing if none is."""
    w = F.broadcast(kpis.sparkSession.createDataFrame(WEIGHTS, "kpi string, w double"))
    j = kpis.join(w, "kpi").where("status = 'ok'")
    have = j.groupBy("channel").agg(F.bround(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")) * 100, 1).alias("effectiveness"), F.count(F.lit(1)).alias("components"))
    return kpis.select("channel").distinct().join(have, "channel", "left").select("channel", "effectiveness", F.coalesce("components", F.lit(0)).alias("components"))


def rag(kpis: DataFrame, targets: DataFrame, amber: float = 0.8) -> DataFrame:
    """Green at the target, amber at a share of it, else red; grey without value or target. targets: kpi, channel (null: any), target."""
    own = targets.where("channel is not null").select("kpi", "channel", F.col("target").alias("own"))
    any_ = targets.where("channel is null").select("kpi", F.col("target").alias("general"))
    j = kpis.join(own, ["kpi", "channel"], "left").join(any_, "kpi", "left")
    t = F.coalesce("own", "general")
    color = F.when(F.col("value").isNull() | t.isNull(), "grey").when(F.col("value") >= t, "green").when(F.col("value") >= t * amber, "amber").otherwise("red")
    shown = F.when(F.col("status") == "ok", F.format_string("%.1f%%", F.bround(F.col("value") * 100, 1))).when(F.col("status") == "not_applicable", "n/a").when(F.col("status") == "not_measured", "not measured").when(F.col("status") == "suppressed", "suppressed").otherwise("—")
    return j.select("channel", "kpi", "value", t.alias("target"), color.alias("rag"), shown.alias("shown"))

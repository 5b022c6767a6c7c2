"""Warehouse tables bound to the star-schema test tables, and the same bindings as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import scratch  # noqa: F401

STAGES = ["targeted", "delivered", "opened", "engaged", "completed"]
CHANNELS = [("email", 1), ("whatsapp", 2), ("lms", 3), ("teams", 4), ("community", 5)]
#: Stages a channel cannot measure; all others are measured.
UNSUPPORTED = {("email", "completed"): "not_applicable", ("whatsapp", "completed"): "not_measured", ("lms", "delivered"): "not_applicable", ("teams", "delivered"): "not_applicable", ("community", "delivered"): "not_applicable", ("community", "completed"): "not_measured"}
#: Smallest group that may be shown.
MIN_GROUP = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per campaign, channel and person, from events: five nullable stage flags, stamps, measures."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    e = e.select(
        F.concat(F.lit("camp-"), (F.get_json_object("props", "$.k").cast("int") % 6).cast("string")).alias("campaign_id"),
        F.element_at(F.array(*(F.lit(c) for c, _ in CHANNELS[:4])), (F.col("event_id") % 4 + 1).cast("int")).alias("channel"),
        F.col("user_id").alias("recipient_key"), "event_type", "ts", "value",
    )
    g = e.groupBy("campaign_id", "channel", "recipient_key").agg(
        F.bool_or(kind.isin("view", "click", "purchase")).alias("active"), F.bool_or(kind == "error").alias("failed"), F.bool_or(kind == "click").alias("clicked"), F.bool_or(kind == "purchase").alias("bought"), F.bool_and(kind == "signup").alias("only_signup"),
        F.min("ts").alias("targeted_at"), F.min(F.when(kind == "view", F.col("ts"))).alias("opened_at"), F.min(F.when(kind == "click", F.col("ts"))).alias("engaged_at"), F.min(F.when(kind == "purchase", F.col("ts"))).alias("completed_at"), F.max("value").alias("score"), F.count(F.lit(1)).alias("attempts"),
    )
    delivered = F.when(F.col("channel").isin("lms", "teams"), F.lit(None)).when(F.col("active"), True).when(F.col("failed"), False)
    opened = F.when(F.col("active"), True).when(F.col("only_signup"), F.lit(None)).otherwise(False)
    completed = F.when(F.col("channel").isin("lms", "teams"), F.col("bought"))
    return g.select("campaign_id", "channel", "recipient_key", F.lit(True).alias("targeted"), delivered.alias("delivered"), opened.alias("opened"), F.col("clicked").alias("engaged"), completed.alias("completed"), "targeted_at", "opened_at", "engaged_at", "completed_at", "score", "attempts")


def employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workforce dimension: customers with department, region, site, grade and activity."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    grade = F.when(F.col("c_acctbal") < 0, "G0").when(F.col("c_acctbal") < 3000, "G1").when(F.col("c_acctbal") < 6000, "G2").otherwise("G3")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("c_custkey").alias("employee_key"), F.col("c_mktsegment").alias("department"), F.col("r_name").alias("region"), F.col("n_name").alias("site"), grade.alias("grade_band"), (F.col("c_acctbal") >= 0).alias("is_active"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipient key to employee: a gap for every 7th key, a second, conflicting row for every 50th."""
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    one = u.where("k % 7 != 0").select(F.col("k").alias("id_key"), F.col("k").alias("employee_key"))
    return one.unionByName(u.where("k % 50 = 0").select(F.col("k").alias("id_key"), (F.col("k") + 1).alias("employee_key")))


def support(spark: SparkSession) -> DataFrame:
    """channel, stage, ordinal, support_status: which stages a channel can measure."""
    rows = [(c, s, i + 1, UNSUPPORTED.get((c, s), "measured")) for c, _ in CHANNELS for i, s in enumerate(STAGES)]
    return spark.createDataFrame(rows, "channel string, stage string, ordinal int, support_status string")


def channels(spark: SparkSession) -> DataFrame:
    """channel, sort_order."""
    return spark.createDataFrame(CHANNELS, "channel string, sort_order int")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide sales fact by campaign (brand), type, region, channel (priority) and month; money in exact decimals."""
    li, o, c, n, r, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(p, li.l_partkey == p.p_partkey)
    keys = [F.col("p_brand").alias("campaign_name"), F.col("p_type").alias("campaign_type"), F.col("r_name").alias("region"), F.col("o_orderpriority").alias("channel"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")]
    price, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    return j.groupBy(*keys).agg(F.sum(price * discount).alias("spend"), F.count(F.lit(1)).alias("leads"), F.count_distinct("o_orderkey").alias("conversions"), F.sum(price * (1 - discount)).alias("revenue"))


REC = """e as (select 'camp-' || (json_extract_string(props, '$.k')::int % 6) as campaign_id,
 ['email', 'whatsapp', 'lms', 'teams'][(event_id % 4 + 1)::int] as channel, user_id as recipient_key, event_type, ts, value from events),
rec as (select campaign_id, channel, recipient_key, true as targeted,
 case when channel in ('lms', 'teams') then null when bool_or(event_type in ('view', 'click', 'purchase')) then true when bool_or(event_type = 'error') then false end as delivered,
 case when bool_or(event_type in ('view', 'click', 'purchase')) then true when bool_and(event_type = 'signup') then null else false end as opened,
 bool_or(event_type = 'click') as engaged, case when channel in ('lms', 'teams') then bool_or(event_type = 'purchase') end as completed,
 min(ts) as targeted_at, min(ts) filter (event_type = 'view') as opened_at, min(ts) filter (event_type = 'click') as engaged_at,
 min(ts) filter (event_type = 'purchase') as completed_at, max(value) as score, count(*) as attempts from e group by campaign_id, channel, recipient_key)"""
EMP = """emp as (select c_custkey as employee_key, c_mktsegment as department, r_name as region, n_name as site,
 case when c_acctbal < 0 then 'G0' when c_acctbal < 3000 then 'G1' when c_acctbal < 6000 then 'G2' else 'G3' end as grade_band, c_acctbal >= 0 as is_active
 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
IDN = """idn as (select c_custkey as id_key, c_custkey as employee_key from customer where c_custkey % 7 <> 0
 union all select c_custkey, c_custkey + 1 from customer where c_custkey % 50 = 0),
res as (select id_key, min(employee_key) as employee_key from idn group by 1 having count(distinct employee_key) = 1)"""
SUP = "sup(channel, stage, ordinal, support_status) as (values " + ", ".join(f"('{c}', '{s}', {i + 1}, '{UNSUPPORTED.get((c, s), 'measured')}')" for c, _ in CHANNELS for i, s in enumerate(STAGES)) + ")"
CHN = "chn(channel, sort_order) as (values " + ", ".join(f"('{c}', {i})" for c, i in CHANNELS) + ")"
ROLL = """per as (select campaign_id, channel, date_trunc('month', coalesce(completed_at, engaged_at, opened_at, targeted_at))::date as period,
 count(*) filter (targeted) as targeted, count(*) filter (delivered) as delivered, count(*) filter (opened) as opened, count(*) filter (engaged) as engaged, count(*) filter (completed) as completed from rec group by all),
long as (unpivot per on targeted, delivered, opened, engaged, completed into name stage value v),
rol as (select campaign_id, channel, stage, period, '' as object, case when support_status = 'measured' then v end::bigint as value, 'persons' as unit, 'sum' as aggregation, support_status
 from long join sup using (channel, stage))"""
POSTS = """day as (select 'camp-' || (o_orderkey % 6) as campaign_id, o_orderpriority as community, o_orderdate::date as d, count(distinct o_custkey) as viewers, sum(n) as acts
 from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey group by all),
pst as (select campaign_id, 'community' as channel, 'targeted' as stage, date_trunc('month', d)::date as period, community as object, 1000 as value, 'persons' as unit, 'max' as aggregation, 'measured' as support_status from day
 union all select campaign_id, 'community', 'opened', date_trunc('month', d)::date, community, viewers, 'persons', 'max', 'measured' from day
 union all select campaign_id, 'community', 'engaged', date_trunc('month', d)::date, community, acts::bigint, 'events', 'sum', 'measured' from day)"""
MET = f"{REC}, {SUP}, {CHN}, {ROLL}, {POSTS}, met as (select * from rol union all by name select * from pst)"
TOT = """tot as (select campaign_id, channel, stage, unit, aggregation, support_status, case when aggregation = 'max' then max(value) else sum(value) end::bigint as value from met group by campaign_id, channel, stage, unit, aggregation, support_status)"""
SAL = """sal as (select p_brand as campaign_name, p_type as campaign_type, r_name as region, o_orderpriority as channel, date_trunc('month', o_orderdate)::date as month,
 sum(l_extendedprice::decimal(12,2) * l_discount::decimal(4,2)) as spend, count(*) as leads, count(distinct o_orderkey) as conversions, sum(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2))) as revenue
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey group by all)"""

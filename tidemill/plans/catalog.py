"""Registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as X
from ..operators import coverage, digest, funnel, kpi, merge, nlq, views
from ..streaming import flows
from . import bindings as B
from .registry import ORACLES, QUERIES, query

def _metric(s, d):
    own = funnel.stage_rollup(B.recipient(s, d), B.support(s))
    return own.unionByName(funnel.community_metrics(B.table(s, d, "orders"), B.table(s, d, "lineitem")))


def _resolved(s, d):
    return funnel.unambiguous(B.identity(s, d))


def _funnel(s, d):
    return funnel.funnel_by_channel(_metric(s, d), B.support(s), B.channels(s))


FUN = f"""{B.MET}, {B.TOT}, fch as (select channel, stage, sum(value)::bigint as value, bool_or(support_status = 'measured') as m, bool_or(support_status = 'not_measured') as u, min(unit) as unit from tot group by all),
fun as (select channel, sort_order, stage, ordinal, value, case when m then 'measured' when u then 'not_measured' else 'not_applicable' end as status, unit from fch join sup using (channel, stage) left join chn using (channel))"""
KPI = FUN + ", kd(kpi, num_stage, den_stage, chs) as (values " + ", ".join(f"('{k}', '{n}', '{m}', {c or 'null'})" for k, n, m, c in kpi.KPIS) + """),
kk as (select a.channel, kpi, a.value as num, b.value as den, a.status as sa, b.status as sb, a.unit as ua, b.unit as ub from kd join fun a on a.stage = num_stage join fun b on b.stage = den_stage and a.channel = b.channel where chs is null or list_contains(chs, a.channel)),
kp as (select channel, kpi, num, den, case when 'not_applicable' in (sa, sb) then 'not_applicable' when 'not_measured' in (sa, sb) then 'not_measured' when ua <> ub then 'not_applicable' when num is null or den is null or den <= 0 then 'no_data' when den < 5 then 'suppressed' else 'ok' end as status from kk),
kpis as (select channel, kpi, num, den, round(case when status = 'ok' then num / den end, 6) as value, status from kp)"""
XCH = KPI + """, xch as (select kpi, sum(num) filter (ok)::bigint as num, sum(den) filter (ok)::bigint as den, coalesce(string_agg(channel, ', ' order by channel) filter (ok), '') as basis, coalesce(string_agg(channel, ', ' order by channel) filter (not ok), '') as excluded
 from (select *, status in ('ok', 'suppressed', 'no_data') and num is not null and den is not null as ok from kpis) group by 1),
xchr as (select kpi, num, den, round(case when den > 0 then num / den end, 6) as value, basis, excluded from xch)"""
WHO = f"{B.REC}, {B.EMP}, {B.IDN}, per1 as (select employee_key, bool_or(targeted) as targeted, bool_or(delivered) as delivered, bool_or(opened) as opened, bool_or(engaged) as engaged, bool_or(completed) as completed from rec join res on recipient_key = id_key group by 1)"
SEG = WHO + """, hd as (select department as segment, count(*) as headcount from emp where is_active group by 1),
ac as (select department as segment, count(*) filter (targeted) as targeted, count(*) filter (opened) as opened, count(*) filter (engaged) as engaged, count(*) filter (completed) as completed from per1 join emp using (employee_key) group by 1),
seg as (select segment, headcount, coalesce(targeted, 0) as targeted, coalesce(opened, 0) as opened, coalesce(engaged, 0) as engaged, coalesce(completed, 0) as completed,
 round(coalesce(opened, 0) / headcount, 6) as coverage_rate, greatest(headcount - coalesce(opened, 0), 0) as never_reached from hd left join ac using (segment))"""


query("funnel_by_channel", f"with {FUN} select * from fun")(_funnel)
query("stage_totals_policy", f"with {B.MET}, {B.TOT} select * from tot")(lambda s, d: funnel.stage_totals(_metric(s, d)))
query("channel_stage_wide", f"""with {B.MET}, {B.TOT} select campaign_id, channel, {', '.join(f"max(value) filter (support_status = 'measured' and unit = 'persons' and stage = '{x}') as {x}" for x in B.STAGES)},
 max(value) filter (support_status = 'measured' and unit = 'events' and stage = 'engaged') as engaged_events from tot group by 1, 2""")(
    lambda s, d: funnel.channel_wide(funnel.stage_totals(_metric(s, d)))
)
query("channel_extras", f"""with {B.REC} select channel, count(*) as recipients, count(*) filter (opened is true) as opened, count(*) filter (opened is not true) as not_opened, round(avg(score), 6) as avg_score,
 round(avg(case when attempts > 0 then score / attempts end), 6) as avg_score_per_attempt, median(date_diff('hour', targeted_at, opened_at)) filter (opened is true) as median_hours from rec group by 1""")(
    lambda s, d: funnel.channel_extras(B.recipient(s, d))
)
query("identity_unambiguous", f"with {B.IDN} select * from res")(_resolved)
query("employee_reach", f"""with {WHO} select employee_key, department, region, count(distinct channel) as channels, count(distinct case when opened then channel end) as channels_opened, max(targeted_at) as last_at, bool_or(engaged) as engaged
 from rec join res on recipient_key = id_key left join emp using (employee_key) group by all""")(
    lambda s, d: funnel.employee_reach(B.recipient(s, d), _resolved(s, d), B.employee(s, d))
)
RSL = f"{B.REC}, {B.IDN}, rsl as (select channel, count(*) as recipients, count(employee_key) as resolved, round(count(employee_key) / count(*), 6) as rate from rec left join res on recipient_key = id_key group by 1)"
query("identity_resolution", f"with {RSL} select * from rsl")(lambda s, d: funnel.identity_resolution(B.recipient(s, d), _resolved(s, d)))
query("dedupe_availability", f"with {RSL} select count(*) filter (resolved / greatest(recipients, 1) >= 0.5) as channels_ok, count(*) filter (resolved / greatest(recipients, 1) >= 0.5) >= 2 as available from rsl")(
    lambda s, d: funnel.dedupe_availability(funnel.identity_resolution(B.recipient(s, d), _resolved(s, d)))
)
query("combined_funnel_sum", f"""with {FUN}, f as (select *, status = 'measured' and unit = 'persons' and value is not null as ok from fun) select stage, ordinal, sum(value) filter (ok)::bigint as value,
 coalesce(string_agg(channel, ', ' order by channel) filter (ok), '') as contributing, coalesce(string_agg(channel, ', ' order by channel) filter (not ok), '') as excluded from f group by 1, 2""")(
    lambda s, d: funnel.combined_sum(_funnel(s, d))
)
query("combined_funnel_dedup", f"with {WHO} " + " union all ".join(f"select '{x}' as stage, count(*) filter ({x}) as persons from per1" for x in B.STAGES))(lambda s, d: funnel.combined_dedup(B.recipient(s, d), _resolved(s, d)))
query("trend_monthly", f"with {B.MET} select channel, period, sum(value)::bigint as engaged from met where stage = 'engaged' and unit = 'persons' and support_status = 'measured' group by 1, 2")(
    lambda s, d: funnel.trend(_metric(s, d))
)
query("trend_weekly", f"with {B.MET.replace(chr(39) + 'month' + chr(39) + ', coalesce', chr(39) + 'week' + chr(39) + ', coalesce')} select channel, period, sum(value)::bigint as engaged from rol where stage = 'engaged' and support_status = 'measured' group by 1, 2")(
    lambda s, d: funnel.trend(funnel.stage_rollup(B.recipient(s, d), B.support(s), "week"))
)
query("campaign_table", f"""with {B.MET}, {B.TOT} select campaign_id, {', '.join(f"sum(value) filter (support_status = 'measured' and unit = 'persons' and stage = '{x}')::bigint as {x}" for x in ('targeted', 'opened', 'engaged', 'completed'))}, count(distinct channel) as channels from tot group by 1""")(
    lambda s, d: funnel.campaign_table(_metric(s, d))
)
query("max_stage", f"with {B.REC} select campaign_id, channel, recipient_key, case when completed then 5 when engaged then 4 when opened then 3 when delivered then 2 when targeted then 1 else 0 end as max_stage from rec")(
    lambda s, d: funnel.max_stage(B.recipient(s, d))
)
query("stage_availability", f"""with {B.REC}, {B.SUP}, a as (select channel, {', '.join(f'bool_or({x} is not null) as {x}' for x in B.STAGES)} from rec group by 1), u as (unpivot a on {', '.join(B.STAGES)} into name stage value any_)
 select channel, stage, case when support_status <> 'measured' then support_status when any_ then 'measured' else 'not_measured' end as status from u join sup using (channel, stage)""")(
    lambda s, d: funnel.stage_availability(B.recipient(s, d), B.support(s))
)
query("complete_grid", f"with {B.MET} select c.campaign_id, sup.channel, sup.stage, count(met.stage) as rows from (select distinct campaign_id from met) c cross join sup left join met on met.campaign_id = c.campaign_id and met.channel = sup.channel and met.stage = sup.stage group by all")(
    lambda s, d: funnel.complete_grid(_metric(s, d), B.support(s))
)
LED = "led as (select case o_orderstatus when 'F' then 'loaded' when 'O' then 'rejected' else 'duplicate' end as status, o_orderdate as stamp, o_orderkey as batch_id from orders)"


def _ledger(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "loaded").when(F.col("o_orderstatus") == "O", "rejected").otherwise("duplicate")
    return B.table(s, d, "orders").select(status.alias("status"), F.col("o_orderdate").alias("stamp"), F.col("o_orderkey").alias("batch_id"))


query("load_quality", f"with {LED} select count(*) as batches, count(*) filter (status = 'loaded') as loaded, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'duplicate') as duplicates, max(stamp) filter (status = 'loaded') as last_loaded from led")(
    lambda s, d: funnel.load_quality(_ledger(s, d))
)
query("load_history", f"with {LED} select batch_id, status from led order by batch_id desc limit 200")(
    lambda s, d: _ledger(s, d).select("batch_id", "status").orderBy(F.desc("batch_id")).limit(200)
)
query("channel_kpis", f"with {KPI} select * from kpis")(lambda s, d: kpi.channel_kpis(_funnel(s, d)))
query("cross_channel_kpis", f"with {XCH} select * from xchr")(lambda s, d: kpi.cross_channel(_funnel(s, d)))
COV = f"cov as (select (select count(distinct employee_key) from rec join res on recipient_key = id_key where opened) as reached, (select count(*) from emp where is_active) as headcount)"
query("workforce_coverage", f"with {WHO}, {COV} select reached, headcount, round(reached / headcount, 6) as coverage from cov")(
    lambda s, d: kpi.workforce_coverage(B.recipient(s, d), _resolved(s, d), B.employee(s, d))
)
query("headline_kpis", f"with {XCH}, {B.EMP}, {B.IDN}, {COV} select kpi, num, den, value from xchr where kpi in ('delivery_rate', 'open_rate', 'engagement_rate', 'completion_rate') union all select 'workforce_coverage', reached, headcount, round(reached / headcount, 6) from cov")(
    lambda s, d: kpi.headline(_funnel(s, d), kpi.workforce_coverage(B.recipient(s, d), _resolved(s, d), B.employee(s, d)))
)
query("effectiveness_index", f"""with {KPI}, w(kpi, w) as (values {', '.join(map(str, kpi.WEIGHTS))}), h as (select channel, round_even(sum(w * value) / sum(w) * 100, 1) as effectiveness, count(*) as components from kpis join w using (kpi) where status = 'ok' group by 1)
 select channel, effectiveness::double as effectiveness, coalesce(components, 0) as components from (select distinct channel from kpis) left join h using (channel)""")(
    lambda s, d: kpi.effectiveness(kpi.channel_kpis(_funnel(s, d)))
)
TARGETS = [("open_rate", None, 0.6), ("open_rate", "email", 0.9), ("engagement_rate", None, 0.5), ("completion_rate", None, 0.4)]
query("rag_status", f"""with {KPI}, t(kpi, channel, target) as (values {', '.join(f"('{k}', {'null' if c is None else repr(c)}, {v})" for k, c, v in TARGETS)}),
 j as (select k.channel, k.kpi, k.value, k.status, coalesce(o.target, g.target)::double as target from kpis k left join t o on o.kpi = k.kpi and o.channel = k.channel left join t g on g.kpi = k.kpi and g.channel is null)
 select channel, kpi, value, target, case when value is null or target is null then 'grey' when value >= target then 'green' when value >= target * 0.8 then 'amber' else 'red' end as rag,
 case status when 'ok' then format('{{:.1f}}%', round_even(value * 100, 1)) when 'not_applicable' then 'n/a' when 'not_measured' then 'not measured' when 'suppressed' then 'suppressed' else '—' end as shown from j""")(
    lambda s, d: kpi.rag(kpi.channel_kpis(_funnel(s, d)), s.createDataFrame(TARGETS, "kpi string, channel string, target double"))
)
query("coverage_by_segment", f"with {SEG} select * from seg")(lambda s, d: coverage.by_segment(B.recipient(s, d), _resolved(s, d), B.employee(s, d)))
#: A limit under which exactly one bound segment falls, so that a second must be hidden.
query("coverage_suppressed", f"""with {SEG}, k as (select *, headcount = (select min(headcount) from seg) as small from seg), s as (select *, sum(small::int) over () as n, row_number() over (order by small, headcount, segment desc) as r from k), h as (select *, small or (n = 1 and r = 1) as hide from s)
 select segment, {', '.join(f'case when not hide then {c} end as {c}' for c in ('headcount', 'targeted', 'opened', 'engaged', 'completed', 'coverage_rate', 'never_reached'))}, hide as suppressed from h""")(
    lambda s, d: (lambda c: coverage.suppressed(c, c.agg(F.min("headcount")).first()[0] + 1))(coverage.by_segment(B.recipient(s, d), _resolved(s, d), B.employee(s, d)))
)
MIX = WHO + """, mix0 as (select department as segment, channel, employee_key, bool_or(opened) as o from rec join res on recipient_key = id_key join emp using (employee_key) group by all),
mix1 as (select segment, channel, count(*) as targeted, count(*) filter (o) as n from mix0 group by 1, 2), mix as (select segment, channel, targeted, case when targeted >= 5 then n end as reached, round(case when targeted >= 5 then n / targeted end, 6) as reach_rate from mix1)"""
query("channel_mix", f"with {MIX} select * from mix")(lambda s, d: coverage.channel_mix(B.recipient(s, d), _resolved(s, d), B.employee(s, d)))
query("channel_mix_matrix", f"with {MIX} select segment, " + ", ".join(f"max(reach_rate) filter (channel = '{c}') as {c}" for c, _ in B.CHANNELS[:4]) + " from mix group by 1")(
    lambda s, d: coverage.mix_matrix(coverage.channel_mix(B.recipient(s, d), _resolved(s, d), B.employee(s, d)), [c for c, _ in B.CHANNELS[:4]])
)
query("multi_channel_exposure", f"with {WHO}, n as (select employee_key, count(distinct case when opened then channel end) as channels from rec join res on recipient_key = id_key group by 1), c as (select channels, count(*) as n from n group by 1) select channels, case when n >= 5 then n end as employees from c")(
    lambda s, d: coverage.exposure(B.recipient(s, d), _resolved(s, d))
)

# merges
_HALF = "(select *, 1 as batch_id from rec where recipient_key % 3 <> 0 union all by name select * replace (case when recipient_key % 2 = 0 then null else opened end as opened, false as engaged, score / 2 as score), 2 as batch_id from rec where recipient_key % 3 <> 1)"


def _halves(s, d):
    r = B.recipient(s, d)
    old = r.where("recipient_key % 3 != 0").withColumn("batch_id", F.lit(1))
    new = r.where("recipient_key % 3 != 1").withColumns({"opened": F.when(F.col("recipient_key") % 2 != 0, F.col("opened")), "engaged": F.lit(False), "score": F.col("score") / 2, "batch_id": F.lit(2)})
    return old, new


query("monotonic_merge", f"""with {B.REC} select campaign_id, channel, recipient_key, {', '.join(f'bool_or({x}) as {x}' for x in B.STAGES)}, {', '.join(f'min({x}) as {x}' for x in merge.STAMPS)}, max(score) as score, arg_max(attempts, batch_id) filter (attempts is not null) as attempts, max(batch_id) as batch_id from {_HALF} group by 1, 2, 3""")(
    lambda s, d: merge.monotonic(*_halves(s, d), ["campaign_id", "channel", "recipient_key"], ["score"], ["attempts"])
)
query("in_batch_collapse", """select user_id, bool_or(event_type = 'click') as clicked, min(ts) as first_at, max(value) as best, arg_max(nullif(event_type, 'error'), event_id) filter (event_type <> 'error') as last_kind from events group by 1""")(
    lambda s, d: merge.collapse(B.table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("clicked"), F.col("ts").alias("first_at"), F.col("value").alias("best"), F.nullif("event_type", F.lit("error")).alias("last_kind")), ["user_id"], ["clicked"], ["first_at"], ["best"], ["last_kind"], "event_id")
)


def _delta(s, d):
    c = B.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    one = c.where("c_custkey % 5 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), "c_mktsegment", F.lit(1).alias("i"))
    two = c.where("c_custkey % 10 = 0").select((F.col("c_custkey")).alias("c_custkey"), F.lit("renamed").alias("c_name"), "c_mktsegment", F.lit(2).alias("i"))
    three = c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("new").alias("c_name"), "c_mktsegment", F.lit(3).alias("i"))
    return c, one.union(two).union(three)


query("scd1_upsert", "select c_custkey, case when c_custkey % 10 = 0 then 'renamed' when c_custkey % 5 = 0 then upper(c_name) else c_name end as c_name, c_mktsegment from customer union all select c_custkey + 10000000, 'new', c_mktsegment from customer where c_custkey % 50 = 0")(
    lambda s, d: merge.upsert(*_delta(s, d), ["c_custkey"], "i")
)
query("insert_ignore", "select c_custkey, c_name, c_mktsegment from customer union all select c_custkey + 10000000, 'new', c_mktsegment from customer where c_custkey % 50 = 0")(
    lambda s, d: (lambda c, n: merge.insert_ignore(c, n.drop("i").where("c_custkey > 10000000 or c_custkey % 5 = 0"), ["c_custkey"]))(*_delta(s, d))
)
query("replace_slice", "select o_orderstatus, o_orderpriority, case when o_orderstatus = 'F' then 0 else count(*) end as n from orders group by 1, 2")(
    lambda s, d: (lambda a: merge.replace_slice(a, a.where("o_orderstatus = 'F'").withColumn("n", F.lit(0).cast("long")), ["o_orderstatus"]))(B.table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
)
query("filtered_funnel", f"with {FUN}, x as (select channel, stage, sum(value)::bigint as value from met where channel in ('email', 'lms') and period >= date '2024-01-01' group by 1, 2) select * from x")(
    lambda s, d: _metric(s, d).where(merge.filters({"channel": ["email", "lms"], "campaign_id": []}, {"period": ("2024-01-01", None)})).groupBy("channel", "stage").agg(F.sum("value").alias("value"))
)

# coercions over a messy column
#: What each cell of a messy column is as a flag, as minutes and as a date, told by hand.
_CELLS = {
    "Yes": (True, None, None), "TRUE": (True, None, None), " ✓ ": (True, None, None), "": (None, None, None), "85%": (None, 85, None), "0.85": (None, 0.85, None),
    "01:05:00": (None, 65, None), "45 min": (None, 45, None), "PT1H5M": (None, 65, None), "1.5 hours": (None, 90, None), "03/04/2026": (None, 3042026, "2026-04-03"), "2026-01-14": (None, None, "2026-01-14"),
    "ages": (None, None, None), "no": (False, None, None), "1%": (None, 1, None), "45000": (None, 45000, None), "1": (True, 1, None), "1,200": (None, 1200, None), "90": (None, 90, None),
    "Delivered": (True, None, None), "In Progress": (False, None, None), "failed": (False, None, None), "on": (True, None, None), "x": (True, None, None), "-": (None, None, None), "done": (None, None, None), "1.0": (True, 1, None), "opened": (True, None, None),
    "about 65": (None, 65, None), "1h30": (None, 130, None), "1:75": (None, 175, None), "3/4/2026": (None, 342026, "2026-04-03"), "03-04-2026": (None, None, "2026-04-03"), "14 Jan 2026": (None, 142026, "2026-01-14"),
    "2026-01-14 10:00:00": (None, None, "2026-01-14"), "Jan 14, 2026": (None, 142026, "2026-01-14"), "31/02/2026": (None, 31022026, None),
}
_WORDS = list(_CELLS)
_told = lambda k, sql: "[" + ", ".join("null" if v[k] is None else sql(v[k]) for v in _CELLS.values()) + f"][((l_orderkey + l_linenumber) % {len(_WORDS)} + 1)::int]"
_M = "m as (select l_orderkey, l_linenumber, [" + ", ".join(f"'{w}'" for w in _WORDS) + f"][((l_orderkey + l_linenumber) % {len(_WORDS)} + 1)::int] as x from lineitem)"


def _messy(s, d):
    x = F.element_at(F.array(*map(F.lit, _WORDS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_WORDS) + 1).cast("int"))
    return B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))


_NUM = r"try_cast(regexp_replace(x, '[^\d.\-]', '', 'g') as double)"
_in = lambda words: ", ".join(f"'{w}'" for w in words)
query("coerce_bool", f"with {_M} select l_orderkey, l_linenumber, x, {_told(0, str)}::boolean as v from m")(
    lambda s, d: _messy(s, d).withColumn("v", C.to_bool(F.col("x")))
)
query("coerce_number", f"with {_M} select l_orderkey, l_linenumber, x, {_NUM} as v, case when trim(x) <> '' then {_NUM} > 0 end as positive from m")(
    lambda s, d: _messy(s, d).withColumns({"v": C.to_number(F.col("x")), "positive": C.to_bool_from_count(F.col("x"))})
)
query("coerce_percent", f"with {_M}, n as (select *, {_NUM} as n from m) select l_orderkey, l_linenumber, x, round(case when ends_with(trim(x), '%') or n > 1 then n / 100 else n end, 8) as v from n")(
    lambda s, d: _messy(s, d).withColumn("v", F.round(C.to_percent(F.col("x")), 8))
)
query("coerce_duration", f"with {_M} select l_orderkey, l_linenumber, x, {_told(1, str)}::double as v from m")(
    lambda s, d: _messy(s, d).withColumn("v", F.round(C.to_minutes(F.col("x")), 6))
)
query("coerce_date", f"with {_M} select l_orderkey, l_linenumber, x, {_told(2, lambda v: f"date '{v}'")}::date as v from m")(
    lambda s, d: _messy(s, d).withColumn("v", C.to_date(F.col("x")))
)
query("slug", "select c_custkey, trim(regexp_replace(lower(trim(c_name || ' / ' || c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '-') as slug from customer")(
    lambda s, d: B.table(s, d, "customer").select("c_custkey", C.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"))
)
query("e164", "select c_custkey, '+91' || (7000000000 + c_custkey) as phone from customer")(
    lambda s, d: B.table(s, d, "customer").select("c_custkey", C.e164(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0"), (F.col("c_custkey") + 7000000000).cast("string"))).otherwise(F.concat(F.lit("+91 "), (F.col("c_custkey") + 7000000000).cast("string")))).alias("phone"))
)
_PADS = [bytes(b ^ x for b in b"salt".ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]
query("pseudonym", f"select c_custkey, left(sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(c_name)))), 32) as alias from customer")(
    lambda s, d: B.table(s, d, "customer").select("c_custkey", C.pseudonym(F.col("c_name"), b"salt").alias("alias"))
)
query("alias_fold", "select c_custkey, case c_mktsegment when 'BUILDING' then 'Construction' when 'MACHINERY' then 'Industry' else c_mktsegment end as segment from customer")(
    lambda s, d: B.table(s, d, "customer").select("c_custkey", C.to_text(F.col("c_mktsegment"), {"building": "Construction", "MACHINERY": "Industry"}).alias("segment"))
)
query("dwell_histogram", "select least(20, greatest(1, floor(value / 10) + 1))::bigint as bin, count(*) as n from events where value > 0 group by 1")(
    lambda s, d: B.table(s, d, "events").where("value > 0").groupBy(F.least(F.lit(20).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("value") / 10) + 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
)
query("score_deciles", "select round_even(value, -1)::double as decile, count(*) as n from events group by 1")(
    lambda s, d: B.table(s, d, "events").groupBy(F.bround("value", -1).alias("decile")).agg(F.count(F.lit(1)).alias("n"))
)
query("pass_mark_mode", "with c as (select event_type, round(value)::bigint as m, count(*) as n from events group by 1, 2) select event_type, min(m) as mode, round(any_value(md), 6) as median from (select c.*, max(n) over (partition by event_type) as top from c) join (select event_type, median(value) as md from events group by 1) using (event_type) where n = top group by 1")(
    lambda s, d: (lambda e: e.groupBy("event_type", F.round("value").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.min_by("m", F.struct(-F.col("n"), "m")).alias("mode")).join(e.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median")), "event_type"))(B.table(s, d, "events"))
)

# questions
_sal = lambda f: lambda s, d: f(B.sales(s, d))
query("leads_by_region", f"with {B.SAL} select region, sum(leads)::bigint as leads from sal group by 1")(_sal(nlq.leads_by_region))
query("spend_vs_conversions", f"with {B.SAL} select channel, round(sum(spend)::double, 2) as spend, sum(conversions)::bigint as conversions from sal group by 1")(_sal(nlq.spend_vs_conversions))
query("revenue_trend", f"with {B.SAL} select month, round(sum(revenue)::double, 2) as revenue from sal group by 1")(_sal(nlq.revenue_trend))
query("roas_top5", f"with {B.SAL} select campaign_name, round(sum(revenue)::double / sum(spend)::double, 4) as roas from sal group by 1 order by 2 desc, 1 limit 5")(_sal(nlq.roas_top))
query("revenue_share", f"with {B.SAL}, t as (select region, sum(revenue)::double as r from sal group by 1), w as (select *, sum(r) over () as t, count(*) over () as n from t) select region, round(r, 2) as revenue, round(r / t, 6) as share, round(r / ((t - r) / (n - 1)) - 1, 6) as vs_rest from w")(_sal(nlq.revenue_share))
query("month_change", f"with {B.SAL}, t as (select month, sum(revenue)::double as r from sal group by 1), w as (select *, lag(r) over (order by month) as b from t) select month, round(r, 2) as revenue, round((r - b) / b, 6) as change from w")(_sal(nlq.month_change))
query("peak_and_low", f"with {B.SAL}, t as (select month, sum(revenue)::double as r from sal group by 1) select arg_max(month, r) as peak_month, arg_min(month, r) as low_month, round(max(r), 2) as peak, round(min(r), 2) as low from t")(_sal(nlq.peak_and_low))
query("campaign_comparability", f"with {B.SAL}, c as (select campaign_name, sum(leads) as a, count(distinct campaign_type) as o, count(distinct channel) as ch from sal group by 1) select max(a) >= 4 * min(a) as audience_differs, max(o) > 1 as several_objectives, max(ch) <> min(ch) as channels_differ from c")(_sal(nlq.comparability))
query("chart_config", f"with {B.SAL}, t as (select region, sum(leads)::double as leads from sal group by 1) select 'leads by region' as title, 'bar' as type, string_agg(region, '|' order by region) as labels, string_agg(leads::varchar, '|' order by region) as data, '![chart](https://charts.invalid/?t=leads%20by%20region)' as markdown from t")(_sal(lambda x: nlq.chart(nlq.leads_by_region(x))))
query("question_to_rows", f"with {B.SAL} select region, sum(leads)::bigint as leads from sal group by 1")(
    lambda s, d: nlq.answer(s, B.sales(s, d), "How many leads by region?")
)

# texts
# the references that these pages hold, the ampersand last
_REFS = r"regexp_replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"
query("page_title", "select page_id, trim(regexp_replace(" + _REFS.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", '[ \t\n\r\x{a0}]+', ' ', 'g')) as title from pages")(
    lambda s, d: B.table(s, d, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))
)
query("strip_html", "select page_id, trim(regexp_replace(" + _REFS.format(r"regexp_replace(regexp_replace(regexp_replace(" + _REFS.format("html") + r", '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + r", '[\s\x{a0}]+', ' ', 'g')) as body from pages")(
    lambda s, d: B.table(s, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))
)
query("canonical_url", r"""with p as (select page_id, url, string_split(url, '#')[1] as u from pages),
 k as (select page_id, url, string_split(u, '://')[1] as sch, string_split(string_split(u, '://')[2], '?')[1] as hp, string_split(u, '?')[2:] as qs from p),
 h as (select *, string_split(hp, '/')[1] as host, '/' || array_to_string(string_split(hp, '/')[2:], '/') as path, coalesce(string_split(array_to_string(qs, '?'), '&'), []) as parts from k),
 t as (select *, list_filter(parts, lambda x: contains(x, '=') and not starts_with(x, '=') and split_part(x, '=', 2) <> '' and not regexp_matches(lower(x), '^(utm_|pk_|mc_|hsa_|ito_)') and not regexp_matches(lower(x), '^(fbclid|gclid|dclid|msclkid|igshid|ref|referrer|cmpid|campaign_id|source|src|from|feature|share|amp|output|ncid|smid|cid|utm|sh)=')) as kept from h)
 select page_id, case when coalesce(hp, '') = '' or host = '' then url else lower(sch) || '://' || regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', '') || coalesce(nullif(rtrim(path, '/'), ''), '/') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as url from t""")(
    lambda s, d: B.table(s, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))
)
ART = r"art as (select doc_id, source as source_id, trim(left(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'), 160)) as title, text as summary, case when doc_id % 17 <> 0 then timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) end as published from documents)"
_art = lambda s, d: digest.articles(B.table(s, d, "documents"))
query("truncate_summary", r"""with s as (select doc_id, text, left(text, 161) as h from documents), a as (select *, 161 - instr(reverse(h), ' ') as cut from s)
 select doc_id, case when length(text) > 160 then regexp_replace(case when instr(h, ' ') > 0 and cut > 96 then left(h, cut) else left(h, 160) end, '[ ,;:.\-–—]+$', '') || '…' else text end as summary from a""")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("summary"))
)
_FLAT = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '[ \\t\\n\\r\\x{a0}]+', ' ', 'g'))"
_STOP = "a an the and or of to in on for at by with from as is are was were be been it its this that these those new says say said after over into amid ahead up down more most may might will would can could should percent pc cent".split()
_TOK = f"list_filter(string_split({_FLAT}, ' '), lambda w: (length(w) > 2 or regexp_matches(w, '[0-9]')) and w not in (" + _in(_STOP) + "))"
_STEM = "case " + " ".join(f"when ends_with(w, '{x}') and length(w) >= {len(x) + X.LEAST_STEM} then left(w, length(w) - {len(x)})" for x in X.SUFFIXES) + " else w end"
query("title_tokens", f"with {ART} select doc_id, array_to_string({_TOK}, ' ') as tokens from art")(
    lambda s, d: _art(s, d).select("doc_id", F.array_join(X.tokens(F.col("title")), " ").alias("tokens"))
)
STM = f"{ART}, tok as (select doc_id, unnest({_TOK}) as w from art), stm as (select distinct doc_id, {_STEM} as e from tok)"
query("title_stems", f"with {STM} select art.doc_id, coalesce(x.s, '') as stems from art left join (select doc_id, string_agg(e, ' ' order by e) as s from stm group by 1) x using (doc_id)")(
    lambda s, d: _art(s, d).select("doc_id", F.array_join(X.stems(F.col("title")), " ").alias("stems"))
)
NOW = "2024-01-01 14:00:00"
query("window_filter", f"with {ART}, w as (select doc_id, coalesce(published, timestamp '{NOW}') as p from art) select doc_id, case when p > timestamp '{NOW}' + interval 3 hour then timestamp '{NOW}' else p end as published from w where case when p > timestamp '{NOW}' + interval 3 hour then timestamp '{NOW}' else p end >= timestamp '{NOW}' - interval 6 hour")(
    lambda s, d: digest.within(_art(s, d), F.lit(NOW).cast("timestamp"), 6).select("doc_id", "published")
)
query("window_filter_dated", f"with {ART} select doc_id, published from art where published >= timestamp '{NOW}' - interval 6 hour")(
    lambda s, d: digest.within(_art(s, d), F.lit(NOW).cast("timestamp"), 6, undated=False, clamp=False).select("doc_id", "published")
)
query("dedupe_exact_keys", "select 'u:' || left(sha1(text), 16) as text_key, count(*) as items, min(doc_id) as first_id from documents group by 1")(
    lambda s, d: digest.exact_groups(_art(s, d))
)
_PER = f"per as (select doc_id, list_sort(list_distinct(list_filter(string_split({_FLAT}, ' '), lambda w: regexp_matches(w, '^(q[1-4]|h[12]|fy\\d{{2,4}}|cy\\d{{2,4}}|\\d{{4}})$')))) as p from art)"
CLS = f"{STM}, {_PER}, ts as (select doc_id, list_sort(list(e)) as s from stm group by 1), cls as (select min(doc_id) as id, s, p from ts join per using (doc_id) group by s, p)"
query("title_classes", f"with {CLS} select ts.doc_id, cls.id as class_id from ts join per using (doc_id) join cls on ts.s = cls.s and per.p = cls.p")(
    lambda s, d: digest.title_classes(_art(s, d))
)
query("dedupe_near_pairs", f"""with {CLS}, w as (select id, p, unnest(s) as e, len(s) as n from cls), i as (select a.id as id_a, b.id as id_b, any_value(a.n) as na, any_value(b.n) as nb, any_value(a.p) as pa, any_value(b.p) as pb, count(*) as i from w a join w b on a.e = b.e and a.id < b.id group by 1, 2)
 select id_a, id_b, round(i / (na + nb - i), 6) as similarity from i where i / (na + nb - i) >= 0.62 and (len(pa) = 0 or len(pb) = 0 or list_has_any(pa, pb))""")(
    lambda s, d: digest.near_pairs(_art(s, d))
)
query("seen_filter", f"with {ART}, k as (select doc_id, sha1(summary) as u, {_FLAT} as t from art) select doc_id from k where doc_id % 3 <> 0 and u not in (select u from k where doc_id % 3 = 0) and t not in (select t from k where doc_id % 3 = 0)")(
    lambda s, d: digest.unseen(_art(s, d).where("doc_id % 3 != 0"), digest.keys(_art(s, d).where("doc_id % 3 = 0"))).select("doc_id")
)
query("seen_ledger", f"""with {ART}, k as (select doc_id, [case when doc_id % 3 = 0 then null else 'u:' || left(sha1(summary), 16) end, case when doc_id % 3 = 0 then null else 't:' || left(sha1({_FLAT}), 16) end] as ks, doc_id % 40 as age from art where doc_id % 3 <> 0),
 l as (select unnest(ks) as key, timestamp '{NOW}' - to_days(age::int) as seen_at from k where doc_id % 3 = 1), n as (select unnest(ks) as key, timestamp '{NOW}' as seen_at from k where doc_id % 3 = 2),
 m as (select key, min(seen_at) as seen_at from (select * from l union all select * from n) group by 1) select key, seen_at from m where seen_at >= timestamp '{NOW}' - interval 14 day""")(
    lambda s, d: (lambda k, now: digest.pruned(digest.marked(k.where("doc_id % 3 = 1").select(F.explode(F.array("text_key", "title_key")).alias("key"), (now - F.expr("make_dt_interval(cast(doc_id % 40 as int))")).alias("seen_at")), _art(s, d).where("doc_id % 3 = 2"), now), now))(digest.keys(_art(s, d)), F.lit(NOW).cast("timestamp"))
)
query("failure_ratio", "select count(*) as sources, count(*) filter (s_suppkey % 4 = 1) as failed, round(count(*) filter (s_suppkey % 4 = 1) / count(*) filter (s_suppkey % 4 <> 2), 6) as ratio from supplier")(
    lambda s, d: digest.failure_ratio(B.table(s, d, "supplier").select(F.expr("case s_suppkey % 4 when 1 then 'error' when 2 then 'skipped' else 'ok' end").alias("status")))
)

# option lists, bounds and views
query("filter_options", f"with {B.EMP}, {B.REC} select 'department' as kind, department as value from emp where department is not null group by 2 union all select 'region', region from emp where region is not null group by 2 union all select 'channel', channel from rec where channel is not null group by 2")(
    lambda s, d: views.options(B.employee(s, d), ["department", "region"]).unionByName(views.options(B.recipient(s, d), ["channel"]))
)
query("segment_filter", f"with {WHO} select channel, count(*) as recipients, count(*) filter (opened) as opened from rec join res on recipient_key = id_key join emp using (employee_key) where department in ('BUILDING', 'MACHINERY') and grade_band = 'G2' group by 1")(
    lambda s, d: views.in_segment(B.recipient(s, d), _resolved(s, d), B.employee(s, d), {"department": ["BUILDING", "MACHINERY"], "grade_band": ["G2"], "region": []}).groupBy("channel").agg(F.count(F.lit(1)).alias("recipients"), F.count_if("opened").alias("opened"))
)
query("date_bounds", f"with {B.MET} select min(period) as first, max(period) as last, count(*) as rows, (select max(o_orderkey) from orders) as version from met")(
    lambda s, d: views.bounds(_metric(s, d), "period").crossJoin(B.table(s, d, "orders").agg(F.max("o_orderkey").alias("version")))
)
query("worst_covered", f"with {SEG} select segment, coverage_rate from seg order by coverage_rate, segment limit 3")(
    lambda s, d: views.lowest(coverage.by_segment(B.recipient(s, d), _resolved(s, d), B.employee(s, d)), "coverage_rate", "segment", 3).select("segment", "coverage_rate")
)
query("stuck_learners", f"with {B.REC} select channel, count(*) as n, round(max(score), 6) as furthest from rec where completed is distinct from true and score is not null group by 1")(
    lambda s, d: views.stuck(B.recipient(s, d), "completed", "score").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("furthest"))
)
query("effectiveness_order", f"""with {KPI}, w(kpi, w) as (values {', '.join(map(str, kpi.WEIGHTS))}), h as (select channel, round_even(sum(w * value) / sum(w) * 100, 1)::double as effectiveness from kpis join w using (kpi) where status = 'ok' group by 1), a as (select channel, effectiveness from (select distinct channel from kpis) left join h using (channel))
 select channel, effectiveness, row_number() over (order by effectiveness desc nulls last, channel)::int as place from a""")(
    lambda s, d: views.in_order(kpi.effectiveness(kpi.channel_kpis(_funnel(s, d))).drop("components"), "effectiveness", "channel")
)
query("status_override", f"with {B.REC}, {B.SUP}, m as (select channel, case when channel in ('email', 'lms') then 'opened' else 'completed' end as stage, case when channel = 'email' then 'not_measured' end as own from rec group by 1) select channel, stage, coalesce(own, support_status) as status from m join sup using (channel, stage)")(
    lambda s, d: funnel.effective_status(B.recipient(s, d).select("channel").distinct().select("channel", F.when(F.col("channel").isin("email", "lms"), "opened").otherwise("completed").alias("stage"), F.when(F.col("channel") == "email", "not_measured").alias("support_status")), B.support(s)).select("channel", "stage", F.col("support_status").alias("status"))
)
query("ordered_funnel", f"with {FUN}, o as (select channel, stage, sort_order, ordinal from fun) select channel, stage, (row_number() over (order by sort_order, ordinal))::int as place from o")(
    lambda s, d: views.numbered(_funnel(s, d), ["sort_order", "ordinal"]).select("channel", "stage", "place")
)


@query("stream_equals_batch", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_equals_batch(s, d):
    """The daily activity of events, read as a stream."""
    like = B.table(s, d, "events")
    stream = s.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return flows.drained(flows.activity(stream), B.scratch(s, "activity"))


# fallbacks and further questions
query("coverage_status", f"with {WHO}, {COV} select reached, headcount, round(reached / headcount, 6) as coverage, 'ok' as status from cov")(
    lambda s, d: kpi.coverage_status(B.recipient(s, d), _resolved(s, d), B.employee(s, d), 900)
)
query("coverage_not_measured", "select null::bigint as reached, 900::bigint as headcount, null::double as coverage, 'not_measured' as status")(
    lambda s, d: kpi.coverage_status(B.recipient(s, d), _resolved(s, d).where("false"), B.employee(s, d).where("not is_active"), 900)
)
_MARKS = "m as (select o_custkey % 40 as g, case when o_custkey % 40 <> 7 then (o_orderkey % 4) * 10 + 50 end as mark, o_totalprice as minutes from orders)"
_marks = lambda s, d: B.table(s, d, "orders").selectExpr("o_custkey % 40 as g", "case when o_custkey % 40 <> 7 then (o_orderkey % 4) * 10 + 50 end as mark", "o_totalprice as minutes")
query("pass_marks", f"with {_MARKS}, c as (select g, mark, count(*) as n from m where mark is not null group by 1, 2), r as (select *, row_number() over (partition by g order by n desc, mark) as r from c) select g.g, coalesce(mark, 70)::double as pass_mark from (select distinct g from m) g left join r on r.g = g.g and r = 1")(
    lambda s, d: kpi.pass_mark(_marks(s, d), "g", "mark")
)
query("typical_session", f"with {_MARKS}, x as (select g, median(minutes) as md from m group by 1) select round(median(md), 6) as typical from x")(
    lambda s, d: kpi.typical_length(_marks(s, d), "g", "minutes")
)
query("trend_daily", f"""with {B.REC}, c(campaign_id, start_date) as (values ('camp-0', date '2023-05-01'), ('camp-1', null)), u as (select * replace (case when recipient_key % 9 = 0 then null else targeted_at end as targeted_at, case when recipient_key % 9 = 0 then null else opened_at end as opened_at,
 case when recipient_key % 9 = 0 then null else engaged_at end as engaged_at, case when recipient_key % 9 = 0 then null else completed_at end as completed_at) from rec)
 select date_trunc('day', coalesce(completed_at, engaged_at, opened_at, targeted_at, start_date, timestamp '1970-01-01'))::date as period, count(*) filter (engaged) as engaged from u left join c using (campaign_id) group by 1""")(
    lambda s, d: funnel.stage_rollup(B.recipient(s, d).withColumns({c: F.when(F.col("recipient_key") % 9 != 0, F.col(c)) for c in ("targeted_at", "opened_at", "engaged_at", "completed_at")}), B.support(s), "day", s.createDataFrame([("camp-0", "2023-05-01"), ("camp-1", None)], "campaign_id string, start_date string").withColumn("start_date", F.to_date("start_date")))
    .where("stage = 'engaged'").groupBy("period").agg(F.sum("value").alias("engaged"))
)
query("open_rate_by_audience", f"with {KPI} select a.channel, a.value as num, b.value as den, round(case when b.value >= 5 then a.value / b.value end, 6) as value from fun a join fun b on a.channel = b.channel and a.stage = 'opened' and b.stage = 'targeted'")(
    lambda s, d: kpi.channel_kpis(_funnel(s, d), open_basis="targeted").where("kpi = 'open_rate'").select("channel", "num", "den", "value")
)
for _name, _ask, _sql in (
    ("question_top", "What are the top three campaigns by ROAS?", "select campaign_name, round(sum(revenue)::double / sum(spend)::double, 4) as roas from sal group by 1 order by 2 desc, 1 limit 3"),
    ("question_trend", "How did revenue and leads develop over time?", "select month, round(sum(revenue)::double, 2) as revenue, sum(leads)::bigint as leads from sal group by 1"),
    ("question_worst", "Which 2 channels have the lowest conversion rate", "select channel, round(sum(conversions)::double / sum(leads)::double, 4) as conversion_rate from sal group by 1 order by 2, 1 limit 2"),
    ("question_total", "Total spend, please", "select round(sum(spend)::double, 2) as spend from sal"),
):
    query(_name, f"with {B.SAL} {_sql}")(
        lambda s, d, ask=_ask: (lambda r: r.select(*(F.round(F.col(c).cast("double"), 4 if c in ("roas", "conversion_rate") else 2).alias(c) if c in ("roas", "conversion_rate", "revenue", "spend") else F.col(c) for c in r.columns)))(nlq.answer(s, B.sales(s, d), ask))
    )


# the other parts of the catalogue register themselves
from . import brief_catalog, cleaning_catalog, ingest_catalog, question_catalog, radar_catalog, source_catalog, stream_catalog  # noqa: E402, F401

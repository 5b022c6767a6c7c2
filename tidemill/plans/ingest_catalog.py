"""Queries over raw exports: what they imply, which campaign they belong to, what is wrong with them, and the ledger.

The exports are bound to the test tables by expressions that Spark and the oracle share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive, ingest
from . import bindings as B
from .registry import query


def _flag(by: str, n: int) -> str:
    """A nullable flag: unknown, yes and no by turns."""
    return f"case ({by}) % {n} when 1 then true when 2 then false end"


#: Columns of a raw export, by expressions over lineitem that both engines read alike.
EXPORT = {
    "row": "l_orderkey * 10 + l_linenumber",
    "file": "concat('file-', l_suppkey % 30)",
    "targeted": "true",
    "delivered": _flag("l_orderkey", 4),
    "bounced": _flag("l_partkey", 5),
    "opened": _flag("l_orderkey + l_partkey", 4),
    "engaged": _flag("l_partkey + l_linenumber", 3),
    "completed": _flag("l_orderkey + l_linenumber", 5),
    "replied": _flag("l_partkey", 3),
    "button_clicked": _flag("l_orderkey + 1", 3),
    "assessment_passed": _flag("l_orderkey + 2 * l_linenumber", 4),
    "opened_at": "case when l_partkey % 4 <> 0 then l_shipdate end",
    "progress_pct": "case when l_partkey % 3 <> 0 then l_quantity - 25 end",
    "attempts": "case when l_orderkey % 7 = 0 then l_linenumber - 1 end",
    "minutes": "case when l_linenumber % 3 <> 0 then l_quantity - 5 end",
    "joined_at": "case when l_suppkey % 30 <> 3 then l_shipdate end",
    "length": "case when l_suppkey % 30 < 20 and l_linenumber % 2 = 1 then 40.0e0 end",
    "department": "case when l_suppkey % 2 = 0 and l_linenumber % 4 = 1 then l_returnflag end",
    "name": "case l_partkey % 4 when 0 then concat('Guest ', l_partkey) when 1 then concat('Guest (Town ', l_partkey % 9, ' - Desk)') when 2 then 'Guest ( - Desk)' else concat('Guest (Town ', l_partkey % 9, ')') end",
    "hands": "l_linenumber % 3",
}
EXP = "exp as (select " + ", ".join(f"{e} as {c}" for c, e in EXPORT.items()) + " from lineitem)"
STAGES = ", ".join(B.STAGES)


def _export(s, d):
    return B.table(s, d, "lineitem").selectExpr(*(f"{e} as `{c}`" for c, e in EXPORT.items()))


def _channel(df, name):
    return df.select(F.lit(name).alias("channel"), "row", *B.STAGES)


@query("channel_derivations", f"""with {EXP},
em as (select 'email' as channel, row, targeted, case when delivered is not null then delivered when bounced is not null then not bounced when opened or engaged then true end as delivered, opened, engaged, completed from exp),
wa as (select 'whatsapp' as channel, row, targeted, coalesce(delivered, case when coalesce(opened, opened_at is not null) then true end) as delivered, coalesce(opened, opened_at is not null) as opened,
 case when replied is null and button_clicked is null then null else coalesce(replied, false) or coalesce(button_clicked, false) end as engaged, completed from exp),
lm as (select 'lms' as channel, row, targeted, delivered, coalesce(opened, opened_at is not null) as opened,
 case when progress_pct > 0 or assessment_passed is not null or attempts > 0 or completed then true when progress_pct is not null or attempts is not null then false end as engaged,
 case when assessment_passed = false then false else completed end as completed from exp)
select * from em union all by name select * from wa union all by name select * from lm""")
def channel_derivations(s, d):
    """M11, M12, M13 over one export each."""
    e = _export(s, d)
    email = derive.email(e.select("row", *B.STAGES, "bounced"))
    whatsapp = derive.whatsapp(e.select("row", *B.STAGES, "opened_at", "replied", "button_clicked"))
    lms = derive.lms(e.select("row", *B.STAGES, "opened_at", "progress_pct", "assessment_passed", "attempts"))
    return _channel(email, "email").unionByName(_channel(whatsapp, "whatsapp")).unionByName(_channel(lms, "lms"))


#: Files under 5 list attendees only.
_TOLD = "l_suppkey % 30 >= 5"
WEB = EXP.replace("exp as", "raw as").replace(" from lineitem)", f", {_TOLD} as told, l_shipdate + interval 90 minutes as left_at from lineitem)")


@query("webinar_derivations", f"""with {WEB},
w as (select row, file, targeted, case when told then opened end as opened, case when told then engaged end as engaged, minutes, length, joined_at, left_at, department, name, hands from raw),
f as (select file, bool_or(opened is not null or engaged is not null) as tells, bool_or(length is not null) as long, (epoch_us(max(left_at)) - epoch_us(min(joined_at))) / 60e6 as span, bool_or(department is not null) as placed from w group by 1),
j as (select w.*, tells, placed, coalesce(engaged, minutes > 0) as there, case when long then length when span > 0 then span end as len from w join f using (file))
select row, case when tells then targeted end as targeted, case when tells then case when there then true else opened end end as opened, there as engaged, round(len, 4) as session_minutes,
 case when minutes is null then null when len > 0 then minutes / len >= 0.5 else minutes > 0 end as completed,
 case when placed then department else nullif(trim(split_part(regexp_extract(name, '\\(([^)]+)\\)', 1), '-', 1)), '') end as department, hands::double as interactions from j""")
def webinar_derivations(s, d):
    """M14, X34 over exports of several files."""
    told = F.expr(_TOLD)
    e = B.table(s, d, "lineitem").selectExpr("*", *(f"{x} as `{c}`" for c, x in EXPORT.items()))
    w = e.select(
        "row", "file", "targeted", F.when(told, F.col("opened")).alias("opened"), F.when(told, F.col("engaged")).alias("engaged"), F.col("minutes").alias("attendance_minutes"), F.col("length").cast("double").alias("session_minutes"),
        F.col("joined_at").alias("engaged_at"), F.expr("l_shipdate + interval 90 minutes").alias("left_at"), "department", F.col("name").alias("participant_name"), F.col("hands").alias("raise_hands"),
    )
    w = w.withColumns({c: F.col(c).cast("timestamp") for c in ("engaged_at", "left_at")})
    return derive.webinar(w).select("row", "targeted", "opened", "engaged", F.round("session_minutes", 4).alias("session_minutes"), "completed", "department", "interactions")


ALIASES = {"Machinery": "Industry", "building": "Construction"}


@query("roster_defaults", """select c_custkey, case c_mktsegment when 'MACHINERY' then 'Industry' when 'BUILDING' then 'Construction' else c_mktsegment end as department,
 coalesce(case when c_custkey % 3 <> 0 then c_acctbal > 0 end, true) as is_active, coalesce(case when c_custkey % 4 = 0 then true end, false) as mandatory from customer""")
def roster_defaults(s, d):
    """M15."""
    c = B.table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("department"), F.expr("case when c_custkey % 3 <> 0 then c_acctbal > 0 end").alias("is_active"), F.expr("case when c_custkey % 4 = 0 then true end").alias("mandatory"))
    return derive.registry(derive.roster(c, ALIASES))


#: Files named after a campaign, with and without a campaign column, and campaigns spelled by id or name.
LOAD = {
    "row": "o_orderkey",
    "file": "case when o_custkey % 12 < 9 then concat('report_camp-', o_custkey % 12, '.csv') else concat('export', o_custkey % 12, '.csv') end",
    "campaign_raw": "case when o_custkey % 3 <> 0 then case o_orderkey % 6 when 0 then '  CAMP-3 ' when 1 then 'Town Hall 4' when 2 then 'town-hall-5' when 3 then concat('Side Show ', o_orderkey % 4) when 4 then '' end end",
    "recipient_key": "case when o_orderkey % 11 <> 0 then o_custkey end",
    "delivered": "case when o_custkey % 12 <> 4 then true end",
}
LOD = "lod as (select " + ", ".join(f"{e} as {c}" for c, e in LOAD.items()) + " from orders)"
CMP = "cmp(campaign_id, campaign_name, place) as (values " + ", ".join(f"('camp-{i}', 'Town Hall {i}', {i})" for i in range(8)) + ")"
MANUAL = [("export9.csv", "camp-7")]
_SLUG = lambda c: f"coalesce(nullif(trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"
RSV = f"""{LOD}, {CMP}, fl as (select file, bool_or(campaign_raw is not null) as col, case when file = 'export9.csv' then 'camp-7' end as man, nullif(regexp_extract(file, '(camp-[0-9]+)', 1), '') as nam from lod group by 1),
rt as (select lod.*, case when man is not null then 'manual' when col then 'column' when nam is not null then 'filename' else 'unresolved' end as campaign_by,
 case when man is not null then man when col then trim(campaign_raw) else nam end as campaign_text from lod join fl using (file)),
rk as (select *, nullif(trim(campaign_text), '') as t from rt),
rsv as (select row, file, recipient_key, delivered, campaign_by, campaign_text, coalesce(a.campaign_id, b.campaign_id, e.campaign_id, case when t is not null then {_SLUG('t')} end) as campaign_id, coalesce(a.campaign_id, b.campaign_id, e.campaign_id) is not null as registered
 from rk left join cmp a on lower(t) = a.campaign_id left join cmp b on lower(t) = lower(b.campaign_name) left join cmp e on t is not null and {_SLUG('t')} = {_SLUG('e.campaign_name')})"""


def _resolved(s, d):
    loads = B.table(s, d, "orders").selectExpr(*(f"{e} as `{c}`" for c, e in LOAD.items()))
    campaigns = s.createDataFrame([(f"camp-{i}", f"Town Hall {i}", i) for i in range(8)], "campaign_id string, campaign_name string, place int")
    told = ingest.campaign_of(loads, "(camp-[0-9]+)", manual=s.createDataFrame(MANUAL, "file string, campaign string"))
    return ingest.campaign_ids(told, campaigns)


query("campaign_resolution", f"with {RSV} select row, campaign_by, campaign_id, registered from rsv")(
    lambda s, d: _resolved(s, d).select("row", "campaign_by", "campaign_id", "registered")
)
query("required_keys", f"with {RSV} select file, count(*) as rows_read, count(*) filter (recipient_key is null or campaign_id is null) as rows_rejected, count(*) filter (recipient_key is not null and campaign_id is not null) as rows_loaded from rsv group by 1")(
    lambda s, d: ingest.row_counts(_resolved(s, d), ["recipient_key", "campaign_id"])
)
query("usable_rows", f"with {RSV} select campaign_id, count(*) as n from rsv where recipient_key is not null and campaign_id is not null group by 1")(
    lambda s, d: ingest.usable(_resolved(s, d), ["recipient_key", "campaign_id"]).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"))
)
ISS = f"""{RSV}, un as (select distinct file, trim(campaign_text) as v from rsv where not registered and campaign_id is not null), ur as (select *, row_number() over (partition by file order by v) as r from un),
iss as (select file, case min(campaign_by) when 'filename' then 'info' else 'error' end as severity, case min(campaign_by) when 'filename' then 'CAMPAIGN_FROM_FILENAME' else 'CAMPAIGN_UNRESOLVED' end as code, 1::bigint as occurrence_count, coalesce(min(campaign_text), '') as example_values
 from rsv where campaign_by in ('filename', 'unresolved') group by 1
 union all select file, 'warning', 'CAMPAIGN_NOT_IN_REGISTRY', count(*), string_agg(v, ', ' order by v) filter (r <= 3) from ur group by 1)"""
query("campaign_issues", f"with {ISS} select * from iss")(lambda s, d: ingest.campaign_issues(_resolved(s, d)))
query("stage_issues", f"with {LOD} select file, 'warning' as severity, 'STAGE_NOT_MEASURED' as code, 'delivered' as column_name from lod group by 1 having bool_and(delivered is null)")(
    lambda s, d: ingest.stage_issues(_resolved(s, d), ["delivered"])
)
query("issue_severity", f"with {ISS} select severity, case severity when 'error' then 0 when 'warning' then 1 else 2 end as weight, count(*) as n, sum(occurrence_count)::bigint as occurrences from iss group by 1, 2")(
    lambda s, d: ingest.campaign_issues(_resolved(s, d)).groupBy("severity", ingest.severity_order(F.col("severity")).alias("weight")).agg(F.count(F.lit(1)).alias("n"), F.sum("occurrence_count").alias("occurrences"))
)
_MESS = ["Yes", "12", "1,200", "n/a", "often", "", "maybe", "no", "TRUE", "9 lives"]
_PICK = "(l_orderkey + l_linenumber + l_suppkey) % 10 + 1"
query("coercion_issues", f"""with m as (select concat('file-', l_suppkey % 7) as file, l_orderkey * 10 + l_linenumber as row, [{', '.join(f"'{w}'" for w in _MESS)}][({_PICK})::int] as v from lineitem),
 b as (select file, 'opened' as column_name, v, row from m where v in ('12', '1,200', 'n/a', 'often', 'maybe', '9 lives') union all select file, 'score', v, row from m where v in ('Yes', 'n/a', 'often', 'maybe', 'no', 'TRUE')),
 g as (select file, column_name, v, count(*) as n, min(row) as fst from b group by 1, 2, 3), r as (select *, row_number() over (partition by file, column_name order by fst, v) as r from g)
 select file, 'warning' as severity, 'COERCION_FAILED' as code, column_name, sum(n)::bigint as occurrence_count, string_agg(v, ', ' order by r) filter (r <= 3) as example_values from r group by file, column_name""")(
    lambda s, d: ingest.coercion_issues(
        B.table(s, d, "lineitem").select(F.concat(F.lit("file-"), (F.col("l_suppkey") % 7).cast("string")).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.element_at(F.array(*map(F.lit, _MESS)), F.expr(f"cast({_PICK} as int)")).alias("opened")).withColumn("score", F.col("opened")),
        {"opened": "bool", "score": "number"},
    )
)
FIELDS = {"recipient": ["email", "e_mail", "recipient"], "opened": ["opened", "open_date"], "campaign": ["campaign", "mailing"]}
_HEAD = [["email", "opened", "campaign", "notes", "region"], ["e_mail", "mailing"], ["name", "open_date"]]
query("header_issues", """with n as (select n_name || '.csv' as file, n_nationkey % 3 as k from nation), i(k, severity, code, column_name, occurrence_count, example_values) as (values (0, 'info', 'UNMAPPED_COLUMNS', null, 2::bigint, 'notes, region'), (1, 'info', 'OPTIONAL_COLUMN_MISSING', 'opened', 1, ''),
 (2, 'error', 'MISSING_REQUIRED_COLUMN', 'recipient', 1, ''), (2, 'error', 'MISSING_REQUIRED_COLUMN', 'campaign', 1, ''), (2, 'info', 'UNMAPPED_COLUMNS', null, 1, 'name')) select file, severity, code, column_name, occurrence_count, example_values from n join i using (k)""")(
    lambda s, d: ingest.header_issues(B.table(s, d, "nation").select(F.concat("n_name", F.lit(".csv")).alias("file"), F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in _HEAD)), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("names")), FIELDS, ["recipient", "campaign"])
)
query("header_probe", """select s_name as file, case when s_suppkey % 2 = 0 then 'plain' else 'skip 2' end as spec, case when s_suppkey % 2 = 0 then 'email, opened' else 'mailing, ' || s_name end as names, case when s_suppkey % 2 = 0 then 2 else 1 end as hits from supplier""")(
    lambda s, d: ingest.mapped_headers(
        B.table(s, d, "supplier").select(
            F.col("s_name").alias("file"),
            F.inline(F.array(
                F.struct(F.lit(0).alias("place"), F.lit("plain").alias("spec"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("email"), F.lit("opened"))).otherwise(F.array(F.lit(""), F.lit(None).cast("string"))).alias("names")),
                F.struct(F.lit(1).alias("place"), F.lit("skip 2").alias("spec"), F.array(F.lit("mailing"), F.lit(""), F.col("s_name")).alias("names")),
            )),
        ),
        FIELDS,
    ).select("file", "spec", F.array_join("names", ", ").alias("names"), "hits")
)
query("canonical_ids", """select c_custkey, case c_custkey % 5 when 0 then null when 1 then 'customer' || c_custkey when 2 then '+91' || (7000000000 + c_custkey) when 3 then 'some text' else 'none of these' end as id from customer""")(
    lambda s, d: B.table(s, d, "customer").select(
        "c_custkey",
        F.expr("case c_custkey % 5 when 0 then ' NaN ' when 1 then concat(' Customer', c_custkey, '@Example.com ') when 2 then concat('0', 7000000000 + c_custkey) when 3 then 'Some TEXT' else 'None of these' end").alias("x"),
    ).select("c_custkey", F.when(F.col("c_custkey") % 5 == 2, ingest.canonical(F.col("x"), ["strip", "e164"])).otherwise(ingest.canonical(F.col("x"), ["strip", "lower", "strip_domain"])).alias("id"))
)

# the ledger: one load for each customer, over a ledger of earlier loads with one row for each order
_BATCH = "case o_orderkey % 3 when 0 then 'loaded' when 1 then 'rejected' else 'duplicate' end"
_LED = f"led as (select o_orderkey as batch_id, concat('sha-', o_custkey) as sha, {_BATCH} as status, case when o_orderkey % 5 <> 0 then -1::bigint end as superseded_by from orders)"
_NEW = "nw as (select c_name as file, concat('sha-', c_custkey) as sha, c_custkey % 4 * 10 as rows_loaded, c_custkey % 7 = 0 as bad from customer)"
_STA = "st as (select file, sha, case when sha in (select sha from led where status = 'loaded' and superseded_by is null) then 'duplicate' when bad or rows_loaded = 0 then 'rejected' else 'loaded' end as status, rows_loaded from nw)"


def _ledger(s, d):
    return B.table(s, d, "orders").selectExpr("o_orderkey as batch_id", "concat('sha-', o_custkey) as sha", f"{_BATCH} as status", "case when o_orderkey % 5 <> 0 then cast(-1 as long) end as superseded_by")


def _loads(s, d):
    new = B.table(s, d, "customer").selectExpr("c_name as file", "concat('sha-', c_custkey) as sha", "c_custkey % 4 * 10 as rows_loaded", "c_custkey % 7 = 0 as bad")
    issues = new.where("bad").select("file", F.lit("error").alias("severity"))
    return ingest.numbered(ingest.verdicts(new.drop("bad"), issues, ingest.standing(_ledger(s, d))), _ledger(s, d))


query("ledger_append", f"with {_LED}, {_NEW}, {_STA} select file, status, case when status = 'loaded' then rows_loaded else 0 end::bigint as rows_loaded, (select max(batch_id) from led) + row_number() over (order by file) as batch_id from st")(
    lambda s, d: _loads(s, d).select("file", "status", "rows_loaded", "batch_id")
)
query("load_reports", f"with {_LED}, {_NEW}, {_STA} select file, file as reported, status as outcome, case when status = 'loaded' then rows_loaded else 0 end::bigint as loaded from st")(
    lambda s, d: _loads(s, d).select("file", F.from_json("report", "file string, status string, rows_loaded long").alias("r")).select("file", F.col("r.file").alias("reported"), F.col("r.status").alias("outcome"), F.col("r.rows_loaded").alias("loaded"))
)
query("ledger_supersede", f"with {_LED} select batch_id, status, case when superseded_by is null and sha in (select concat('sha-', c_custkey) from customer where c_mktsegment = 'BUILDING') then -1 else superseded_by end as superseded_by from led")(
    lambda s, d: ingest.superseded(_ledger(s, d), B.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("concat('sha-', c_custkey) as sha")).select("batch_id", "status", "superseded_by")
)
query("source_overrides", "select concat('sha-', o_custkey) as sha, arg_max(o_orderstatus, o_orderkey) as source, arg_max(o_orderpriority, o_orderkey) as campaign from orders group by 1")(
    lambda s, d: (lambda o: ingest.overrides(o.where("at % 2 = 0"), o.where("at % 2 = 1")).select("sha", "source", "campaign"))(B.table(s, d, "orders").selectExpr("concat('sha-', o_custkey) as sha", "o_orderstatus as source", "o_orderpriority as campaign", "o_orderkey as at"))
)
query("archive_names", """with f as (select concat('r', o_custkey, '.csv') as file, case when o_orderkey % 9 = 0 then 'rejected' else 'loaded' end as status, o_orderkey as ord from orders),
 n as (select *, case status when 'rejected' then 'rejected' else 'archive/2026-01' end as folder, split_part(file, '.', 1) as stem from f),
 r as (select *, row_number() over (partition by folder, file order by ord) - 1 + case when folder = 'archive/2026-01' and stem = 'r3' then 3 when folder = 'rejected' and stem = 'r5' then 1 else 0 end as k from n)
 select file, folder || '/' || stem || case when k > 0 then '__' || k else '' end || '.csv' as target from r""")(
    lambda s, d: ingest.archive_names(
        B.table(s, d, "orders").selectExpr("concat('r', o_custkey, '.csv') as file", "case when o_orderkey % 9 = 0 then 'rejected' else 'loaded' end as status", "o_orderkey as at"),
        s.createDataFrame([("archive/2026-01/r3.csv",), ("archive/2026-01/r3__2.csv",), ("rejected/r5.csv",)], "target string"), "2026-01",
    )
)

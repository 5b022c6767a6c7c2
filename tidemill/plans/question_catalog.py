"""Questions with filters, two groupings and dates over the sales table, and what they mean in SQL, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nlq, questions
from . import bindings as B
from .registry import query

_ASKED = [
    ("asked_region_filter", "How much revenue in Asia by channel?", "select channel, sum(revenue)::double as revenue from sal where region = 'ASIA' group by 1"),
    ("asked_two_groups", "Leads by region and channel", "select region, channel, sum(leads)::bigint as leads from sal group by 1, 2"),
    ("asked_year", "Spend by region in 1995", "select region, sum(spend)::double as spend from sal where month >= date '1995-01-01' and month < date '1996-01-01' group by 1"),
    ("asked_between", "Conversions per region between March 1997 and June 1998", "select region, sum(conversions)::bigint as conversions from sal where month >= date '1997-03-01' and month < date '1998-07-01' group by 1"),
    ("asked_since_trend", "Trend of revenue in the Middle East since 1996", "select month, sum(revenue)::double as revenue from sal where region = 'MIDDLE EAST' and month >= date '1996-01-01' group by 1"),
    ("asked_top_filtered", "Top three campaigns by ROAS in Europe", "select campaign_name, sum(revenue)::double / sum(spend)::double as roas from sal where region = 'EUROPE' group by 1 order by 2 desc, 1 limit 3"),
    ("asked_without", "Leads by region without Africa", "select region, sum(leads)::bigint as leads from sal where region <> 'AFRICA' group by 1"),
    ("asked_two_values", "Compare leads and revenue of Asia and America", "select sum(leads)::bigint as leads, sum(revenue)::double as revenue from sal where region in ('ASIA', 'AMERICA')"),
    ("asked_hyphened", "Which 2 regions have the lowest cost per lead for 1-URGENT", "select region, sum(spend)::double / sum(leads)::double as cost_per_lead from sal where channel = '1-URGENT' group by 1 order by 2, 1 limit 2"),
    ("asked_before", "Total spend before February 1996 by campaign type", "select campaign_type, sum(spend)::double as spend from sal where month < date '1996-02-01' group by 1"),
]
for _name, _question, _sql in _ASKED:

    @query(_name, f"with {B.SAL}, x as ({_sql}) select * replace (" + ", ".join(f"round({c}, 4) as {c}" for c in ("revenue", "spend", "roas", "cost_per_lead") if f" as {c}" in _sql) + ") from x" if any(f" as {c}" in _sql for c in ("revenue", "spend", "roas", "cost_per_lead")) else f"with {B.SAL} {_sql}")
    def run(s, d, question=_question):
        """One of _ASKED."""
        got = questions.ask(B.sales(s, d), question)
        return got.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes))

_DRAWN = {"What is the trend of revenue?": "YES", "Leads by region": "YES", "Compare the channels": "YES", "Top five campaigns": "YES", "What was the total spend": "NO", "Who are you": "NO"}
query("chart_wanted", "select o_orderkey as id, [" + ", ".join(f"'{v}'" for v in _DRAWN.values()) + f"][(o_orderkey % {len(_DRAWN)})::int + 1] as wanted from orders")(
    lambda s, d: B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), nlq.needs_chart(F.element_at(F.array(*map(F.lit, _DRAWN)), (F.col("o_orderkey") % len(_DRAWN) + 1).cast("int"))).alias("wanted"))
)

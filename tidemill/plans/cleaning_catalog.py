"""Queries over single values as sources write them: dates, ages, years asked for, references, links, whole items.

Each is bound to orders: the order's number picks a text, and what is expected of each text is told by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as X
from ..operators import cleaned
from . import bindings as B
from .registry import query


def _sql(value, kind: str) -> str:
    return "null" if value is None else f"{kind} '{str(value).replace(chr(39), chr(39) * 2)}'" if kind in ("date", "timestamp") else str(value) if kind == "int" else "'" + str(value).replace("'", "''") + "'"


def _list(values, kind: str) -> str:
    return f"[{', '.join(_sql(v, kind) for v in values)}][(o_orderkey % {len(values)})::int + 1]"


def _told(name: str, kind: str, answers: dict, build) -> None:
    """A query id, text, value over orders, and its oracle from the answers: one value a text, or one a column."""
    some = next(iter(answers.values()))
    columns = list(some) if isinstance(some, dict) else ["value"]
    rows = [v if isinstance(v, dict) else {"value": v} for v in answers.values()]
    oracle = ", ".join(f"{_list([r[c] for r in rows], kind)} as {c}" for c in columns)

    @query(name, f"select o_orderkey as id, {_list(list(answers), 'varchar')} as text, {oracle} from orders")
    def run(s, d):
        texts = F.element_at(F.array(*map(F.lit, answers)), (F.col("o_orderkey") % len(answers) + 1).cast("int"))
        got = build(B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), texts.alias("text")))
        return got.select("id", "text", *columns)


_both = lambda v: {"day_first": v, "month_first": v}
_told("coerce_datetime", "timestamp", {
    "2026-01-14": _both("2026-01-14 00:00:00"), "2026-01-14 10:00:00": _both("2026-01-14 10:00:00"), "2026-01-14T10:00:00Z": _both("2026-01-14 10:00:00"), "2026-01-14T10:00:00+05:30": _both("2026-01-14 04:30:00"),
    "03/04/2026": {"day_first": "2026-04-03 00:00:00", "month_first": "2026-03-04 00:00:00"}, "3/4/2026": {"day_first": "2026-04-03 00:00:00", "month_first": "2026-03-04 00:00:00"},
    "03-04-2026 09:05": {"day_first": "2026-04-03 09:05:00", "month_first": "2026-03-04 09:05:00"}, "03.04.2026": {"day_first": "2026-04-03 00:00:00", "month_first": "2026-03-04 00:00:00"}, "3/4/26": {"day_first": "2026-04-03 00:00:00", "month_first": "2026-03-04 00:00:00"},
    "14/01/2026": _both("2026-01-14 00:00:00"), "01/14/2026": _both("2026-01-14 00:00:00"), "14 Jan 2026": _both("2026-01-14 00:00:00"), "14-Jan-26": _both("2026-01-14 00:00:00"), "14 January 2026 22:15": _both("2026-01-14 22:15:00"),
    "Jan 14, 2026": _both("2026-01-14 00:00:00"), "January 14 2026": _both("2026-01-14 00:00:00"), "Wed, 14 Jan 2026 10:00": _both("2026-01-14 10:00:00"), "1st March 2026": _both("2026-03-01 00:00:00"), "2026/01/14": _both("2026-01-14 00:00:00"), "20260114": _both("2026-01-14 00:00:00"),
    "01/02/2026 12:30 am": {"day_first": "2026-02-01 00:30:00", "month_first": "2026-01-02 00:30:00"}, "March 2026": _both("2026-03-01 00:00:00"), "45000": _both(None), "2026-02-30": _both(None), "32/01/2026": _both(None), "soon": _both(None), "": _both(None),
}, lambda x: x.withColumns({"day_first": C.to_datetime(F.col("text")), "month_first": C.to_datetime(F.col("text"), day_first=False)}))
_told("source_dates", "timestamp", {"03/04/2026": {"value": "2026-04-03 00:00:00"}, "05/06/2026 07:08": {"value": "2026-05-06 07:08:00"}}, lambda x: x.withColumn("value", C.to_datetime(F.col("text"), day_first=F.col("id") % 2 == 0)))
_told("posted_dates", "timestamp", {
    "24 Aug 2026": "2026-08-24 00:00:00", "24 August 2026": "2026-08-24 00:00:00", "Aug 24, 2026": "2026-08-24 00:00:00", "24/08/2026": "2026-08-24 00:00:00", "08/24/2026": "2026-08-24 00:00:00", "Mon, 24 Aug 2026 09:00:00 +0000": "2026-08-24 09:00:00", "2026-08-24T09:00:00Z": "2026-08-24 09:00:00",
    "Posted Today": "2026-09-01 12:00:00", "just posted": "2026-09-01 12:00:00", "Posted Yesterday": "2026-08-31 12:00:00", "Posted 3 Days Ago": "2026-08-29 12:00:00", "5 hours ago": "2026-09-01 07:00:00", "2 weeks ago": "2026-08-18 12:00:00", "Posted 30+ Days Ago": "2026-08-02 12:00:00", "1 month ago": "2026-08-02 12:00:00", "sometime soon": None, "": None,
}, lambda x: x.withColumn("value", X.posted_date(F.col("text"), F.lit("2026-09-01 12:00:00"))))
_told("experience_asked", "int", {
    "8-12 years": {"min": 8, "max": 12}, "10 to 15 yrs": {"min": 10, "max": 15}, "12 – 18 years of experience": {"min": 12, "max": 18}, "12-8 years": {"min": 8, "max": 12}, "15+ years": {"min": 15, "max": None}, "minimum 12 years": {"min": 12, "max": None}, "at least 10 years": {"min": 10, "max": None}, "more than 9 yrs": {"min": 9, "max": None},
    "15 years": {"min": None, "max": None}, "up to 5 years": {"min": None, "max": None}, "no band mentioned": {"min": None, "max": None}, "": {"min": None, "max": None},
}, lambda x: x.withColumn("e", X.experience(F.col("text"))).select("id", "text", "e.*"))
_told("html_references", "varchar", {
    "&lt;p&gt;Premium up&lt;/p&gt;": "Premium up", "a<td>b</td><td>c</td>": "a b c", "it&#8217;s": "it’s", "a&nbsp;b": "a b", "Rates &amp; <b>norms</b><script>x()</script>": "Rates & norms", "&ampx &copy2": "&x ©2", "&NotEqualTilde; &rarr;": "≂̸ →", "&#x41;&#66;": "AB", "&#150;": "–", "&bogus; & &;": "&bogus; & &;", "&#0;&#xD800;": "��", "&amp;eacute;": "é", "": "",
}, lambda x: x.withColumn("value", X.strip_html(F.col("text"))))
_told("posting_texts", "varchar", {"<ul><li>Key accounts</li><li>Alliances</li></ul> <b>now</b> .": "Key accounts Alliances now.", "a <i>b</i>, c": "a b, c", "no<br/>tags ; here": "no tags; here"}, lambda x: x.withColumn("value", X.strip_html(F.col("text"), postings=True)))
_told("posting_places", "varchar", {"2 Locations": "", "Gurugram, India": "Gurugram, India", "Pune; Delhi;; Goa": "Pune (+2 more)", "<b>Pune</b> , India": "Pune, India", "Upper " * 20: ("Upper " * 13).strip() + "…", "": ""}, lambda x: x.withColumn("value", X.location(F.col("text"))))
_told("opening_links", "varchar", {
    "https://www.Example.test:443/jobs/1/?utm_source=x&trk=y&id=7": {"opening": "https://www.example.test/jobs/1?id=7", "item": "https://example.test/jobs/1?trk=y&id=7"},
    " http://a.test/x?q=a%20b&r=~*&e= ": {"opening": "http://a.test/x?q=a+b&r=~%2A", "item": "http://a.test/x?q=a+b&r=~%2A"}, "http://a.test?PageNum=2&output=z#f": {"opening": "http://a.test/?output=z", "item": "http://a.test/?PageNum=2"}, "not a url": {"opening": "not a url", "item": "not a url"},
}, lambda x: x.withColumns({"opening": X.canonical_url(F.col("text"), True, X.OPENING_TRACKING), "item": X.canonical_url(F.col("text"))}))
_told("folded_headers", "varchar", {"Unique Opens ": "uniqueopens", "unique_opens": "uniqueopens", "UNIQUE-OPENS": "uniqueopens", "  % Done!": "done", "": ""}, lambda x: x.withColumn("value", C.header(F.col("text"))))

# whole postings and entries
_JOBS = {"title": ["<b>VP</b> - Alliances", "", "Head &amp; lead", "AVP"], "url": ["https://www.j.test/1?utm_x=1", "https://j.test/2", "", "https://j.test/3?refId=9&k=1"], "summary": ["Needs 8-12 years. " + "word " * 90, "x", "y", "Lead  <li>teams</li> ; grow"]}


def _pick(words, e: str) -> str:
    return f"element_at(array({', '.join(_sql(w, 'varchar') for w in words)}), cast({e} % {len(words)} as int) + 1)"


query("openings_cleaned", """with p as (select o_orderkey as id, o_orderkey % 4 as t, (o_orderkey // 4) % 4 as u, o_custkey % 4 as x from orders)
 select id, ['VP - Alliances', null, 'Head & lead', 'AVP'][t + 1] as title, ['https://www.j.test/1', 'https://j.test/2', null, 'https://j.test/3?k=1'][u + 1] as url, case x when 0 then 'Needs 8-12 years. ' || trim(repeat('word ', 76)) || '…' when 3 then 'Lead teams; grow' when 1 then 'x' else 'y' end as summary,
 case x when 0 then 8 end as experience_min, case x when 0 then 12 end as experience_max, 'Pune (+1 more)' as location, timestamp '2026-08-29 12:00:00' as posted from p where t <> 1 and u <> 2""")(
    lambda s, d: cleaned.openings(B.table(s, d, "orders").selectExpr("o_orderkey as id", f"{_pick(_JOBS['title'], 'o_orderkey')} as title", f"{_pick(_JOBS['url'], '(o_orderkey div 4)')} as url", f"{_pick(_JOBS['summary'], 'o_custkey')} as summary", "'Pune; Goa' as location", "'Posted 3 days ago' as posted", "'' as company", "'' as experience"), F.lit("2026-09-01 12:00:00"))
    .select("id", "title", "url", "summary", "experience_min", "experience_max", "location", "posted")
)
query("entries_cleaned", """with p as (select o_orderkey as id, o_orderkey % 3 as t, o_custkey % 3 as x from orders) select id, ['Rates rise', 'Rates & more', 'Shares fall'][t + 1] as title, 'https://n.test/' || id as url, 'The Desk' as publisher,
 case when x = 0 and t = 0 then '' when x = 0 then 'Rates rise The Desk' when x = 1 then 'More about rates' else '' end as summary, timestamp '2025-08-19 01:00:00' as published from p""")(
    lambda s, d: cleaned.entries(B.table(s, d, "orders").selectExpr("o_orderkey as id", f"{_pick(['Rates rise - The Desk', '<i>Rates</i> &amp; more', 'Shares fall | the desk'], 'o_orderkey')} as title", "concat('https://www.n.test/', o_orderkey, '/?utm_source=a') as link", f"{_pick(['Rates rise The Desk', 'More about <b>rates</b>', ''], 'o_custkey')} as summary", "'www.Wire.example' as publisher", "'Tue, 19 Aug 2025 06:30:00 +0530' as published"), {"wire.example": "The Desk"})
    .select("id", "title", "url", "publisher", "summary", "published")
)

"""Queries over openings: gates, fit, tiers, repeated roles, search links.

Openings are bound to orders: their words come from the lists below by the order's numbers, in both engines alike.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import fit, roles
from . import bindings as B
from .registry import query

_GRADES = ["Vice President", "AVP", "Assistant Vice President", "Senior  Vice President", "Manager", "VP", "vice president", "Head", "SVP"]
_FUNCTIONS = [" - Key Accounts", ", Partner Banking", " Alliances", " (Key Account Management)", " Telesales", " R&D Alliances", " - Channel sales", ""]
_PLACES = ["", " North", " South", " - Pune", " Urgent hiring", " | West"]
_COMPANIES = ["Harbour Life Ltd", "HARBOUR LIFE", "Acme Holdings", "Group Co", "", "Northwind Insurance Pvt. Ltd.", "northwind"]
_SUMMARIES = ["Lead key  accounts for life cover", "alliances with banks", "nothing to see", "life cover and pension plans, market entry", "internship for graduates", "partner banking in Gulf City and Riverside", "pension plans", "digital alliances; market entry", None, "Key account management"]
_LOCATIONS = ["Riverside", "Gulf City", "Atlantis", "", None, "Northland", "Old Town, Northland", "Islands of Gulf City"]
OPENINGS = {
    "title": (("concat", ("pick", _GRADES, "o_orderkey % 9"), ("pick", _FUNCTIONS, "o_custkey % 8"), ("pick", _PLACES, "(o_orderkey + o_custkey) % 6"))),
    "company": ("pick", _COMPANIES, "o_custkey % 7"),
    "summary": ("pick", _SUMMARIES, "(o_orderkey * 3 + o_custkey) % 10"),
    "location": ("pick", _LOCATIONS, "(o_orderkey + 5 * o_custkey) % 8"),
}
_YEARS = {"experience_min": "case when o_orderkey % 4 in (1, 2) then cast(o_custkey % 18 as int) end", "experience_max": "case when o_orderkey % 4 in (2, 3) then cast(o_custkey % 18 + 4 as int) end"}
PROFILE = fit.Profile(
    levels=(fit.Level("VP", 1.0, ("vice president", "VP", "senior vice president", "SVP")), fit.Level("AVP", 0.6, ("assistant vice president", "AVP"))),
    regions=(fit.Region("home", "Home", 0.8, ("Riverside", "Pune"), ("Northland",)), fit.Region("gulf", "Gulf", 0.7, ("Gulf City",), ("Islands",))),
    function_strong=("key accounts", "key account management", "alliances", "partner banking"),
    function_supporting=("channel sales", "digital"),
    domain_strong=("life cover",),
    domain_adjacent=("pension plans", "banks"),
    edge=("R&D", "market entry"),
    exclude_title=("telesales",),
    exclude_anywhere=("internship",),
    queries=("vice president alliances", "head key accounts", "", "AVP partner banking", "one more"),
)


def _quoted(words) -> str:
    return ", ".join("null" if w is None else "'" + w.replace("'", "''") + "'" for w in words)


def _spark(e) -> str:
    return f"element_at(array({_quoted(e[1])}), cast({e[2]} as int) + 1)" if e[0] == "pick" else f"concat({', '.join(map(_spark, e[1:]))})"


def _duck(e) -> str:
    return f"[{_quoted(e[1])}][({e[2]})::int + 1]" if e[0] == "pick" else f"concat({', '.join(map(_duck, e[1:]))})"


OPN = "opn as (select o_orderkey as id, " + ", ".join(f"{_duck(e)} as {c}" for c, e in OPENINGS.items()) + ", " + ", ".join(f"{e} as {c}" for c, e in _YEARS.items()) + " from orders)"


def _openings(s, d):
    return B.table(s, d, "orders").selectExpr("o_orderkey as id", *(f"{_spark(e)} as {c}" for c, e in OPENINGS.items()), *(f"{e} as {c}" for c, e in _YEARS.items()))


def _found(text: str, keywords) -> str:
    """The oracle's own wording of a keyword list: the longest alternative first, spaces of any width."""
    if not keywords:
        return "[]::varchar[]"
    alternatives = "|".join("(?:" + r"\b" + re.escape(k).replace(r"\ ", r"\s+") + r"\b" + ")" for k in sorted(keywords, key=len, reverse=True))
    hits = f"list_transform(regexp_extract_all(lower({text}), '{alternatives.lower().replace(chr(92) + 's', chr(92) + 's')}'), lambda h: regexp_replace(h, '\\s+', ' ', 'g'))"
    return f"list_filter([{_quoted(keywords)}], lambda k: list_contains({hits}, lower(k)))"


_P = PROFILE
_LISTS = {"xt": ("t", _P.exclude_title), "xa": ("hay", _P.exclude_anywhere), "fs": ("hay", _P.function_strong), "fst": ("t", _P.function_strong), "fu": ("hay", _P.function_supporting), "fut": ("t", _P.function_supporting), "ds": ("hay", _P.domain_strong), "dst": ("t", _P.domain_strong), "da": ("hay", _P.domain_adjacent), "dat": ("t", _P.domain_adjacent), "ed": ("hay", _P.edge), "edt": ("t", _P.edge)}
_LISTS |= {f"l{j}": ("t", x.keywords) for j, x in enumerate(_P.levels)}
_LISTS |= {f"{a}{b}{j}": (text, r.preferred if b == "p" else r.places) for j, r in enumerate(_P.regions) for a, text in (("w", "loc"), ("h", "hay")) for b in "po"}


def _dim(pairs, full: float) -> str:
    worth = ", ".join(f"list_transform({a}, lambda k: case when list_contains({t}, k) then {w * _P.title_factor}::double else {w}::double end)" for a, t, w in pairs)
    joined = f"list_concat({worth})" if len(pairs) > 1 else worth
    return f"least(1.0, coalesce(list_sum(({joined})[1:{_P.most_keywords}]), 0) / {full})"


def _named(pairs) -> str:
    return (f"list_concat({', '.join(p[0] for p in pairs)})" if len(pairs) > 1 else pairs[0][0]) + f"[1:{_P.most_keywords}]"


def _where(a: str) -> list[str]:
    out = []
    for b in "po":
        out += [f"case when len({a}{b}{j}) > 0 then {{'id': '{r.id}', 'title': '{r.title}', 'value': {1.0 if b == 'p' else r.value}::double, 'place': {a}{b}{j}[1], 'preferred': {str(b == 'p').lower()}}} end" for j, r in enumerate(_P.regions)]
    return out


_FUN = [("fs", "fst", 1.0), ("fu", "fut", _P.supporting)]
_DOM = [("ds", "dst", 1.0), ("da", "dat", _P.adjacent)]
_EDG = [("ed", "edt", 1.0)]
_LEVELS = "list_concat(" + ", ".join(f"list_transform(l{j}, lambda x, i: {{'n': length(x), 'r': {-j}, 'a': -i, 'lv': '{x.title}', 'v': {x.value}::double, 'h': x}})" for j, x in enumerate(_P.levels)) + ")"
FIT = f"""{OPN}, f0 as (select *, coalesce(title, '') as t, coalesce(location, '') as loc, coalesce(title, '') || ' ' || concat_ws(' ', nullif(company, ''), nullif(summary, '')) as hay from opn),
f1 as (select *, {', '.join(f'{_found(text, k)} as {n}' for n, (text, k) in _LISTS.items())} from f0),
f2 as (select *, list_sort({_LEVELS}, 'DESC')[1] as lv, coalesce({', '.join(_where('w') + _where('h'))}) as wh, {_named(_FUN)} as fm, {_named(_DOM)} as dm, {_named(_EDG)} as em,
 {_dim(_FUN, _P.saturation['function'])} as fv, {_dim(_DOM, _P.saturation['domain'])} as dv, {_dim(_EDG, _P.saturation['edge'])} as ev,
 case when experience_min is not null and experience_max is not null then experience_min || '-' || experience_max || ' yrs' when experience_min is not null then experience_min || '+ yrs' when experience_max is not null then 'up to ' || experience_max || ' yrs' else '' end as band from f1),
f3 as (select *, case when len(xt) > 0 then 'title names ''' || xt[1] || ''', another line of work' when len(xa) > 0 then 'posting names ''' || xa[1] || '''' when lv is null then 'no grade marker in the title'
 when len(fs) = 0 then 'names no function that is looked for' when wh is null then 'location (' || coalesce(nullif(location, ''), 'no location given') || ') is outside the target regions' when experience_max < {_P.floor_years} then 'advertises ' || band || ', below the {_P.floor_years}-year floor' end as reject_reason,
 round_even(least(100.0, {_P.points['seniority']} * lv.v + {_P.points['function']} * fv + {_P.points['domain']} * dv + {_P.points['geography']} * wh.value + {_P.points['edge']} * ev), 1)::double as fit0 from f2),
fit as (select *, case when reject_reason is null then fit0 end as fit, case when reject_reason is null then case when fit0 >= {_P.tiers['strong']} then 'strong' when fit0 >= {_P.tiers['possible']} then 'possible' when fit0 >= {_P.tiers['stretch']} then 'stretch' else 'below' end end as tier from f3)"""


def _fitted(s, d):
    return fit.fitted(_openings(s, d), PROFILE)


query("fit_score", f"with {FIT} select id, fit, tier, reject_reason from fit")(lambda s, d: _fitted(s, d).select("id", "fit", "tier", "reject_reason"))
query("fit_tiers", f"with {FIT}, x(tier, place) as (values ('strong', 1), ('possible', 2), ('stretch', 3)) select tier, place, count(*) as openings, max(fit) as best from fit join x using (tier) where reject_reason is null group by 1, 2")(
    lambda s, d: fit.by_tier(_fitted(s, d))
)
query("fit_seniority", f"with {FIT} select id, lv.lv as level, lv.h as marker from fit")(
    lambda s, d: _openings(s, d).withColumn("l", fit.seniority(F.coalesce("title", F.lit("")), PROFILE.levels)).select("id", F.col("l.level").alias("level"), F.col("l.hit").alias("marker"))
)
query("fit_region", f"with {FIT} select id, wh.id as region, wh.place as place from fit")(
    lambda s, d: _openings(s, d).withColumn("w", F.coalesce(fit.located(F.col("location"), PROFILE.regions), fit.located(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.concat_ws(" ", F.nullif("company", F.lit("")), F.nullif("summary", F.lit("")))), PROFILE.regions))).select("id", "w.id", "w.place").toDF("id", "region", "place")
)
query("fit_reasons", f"""with {FIT} select id, array_to_string(list_concat(fm, dm, em), '|') as matched,
 array_to_string(list_filter([lv.lv || ' (' || lv.h || ')', case when len(fm) > 0 then array_to_string(fm[1:3], ' · ') end, case when len(dm) > 0 then dm[1] end, wh.title || ' — ' || case when wh.preferred then wh.place else coalesce(nullif(location, ''), wh.place) end,
 case when band <> '' then band || ' asked' || case when experience_min >= {_P.ideal_years} then ', which fits' else '' end end, case when len(em) > 0 then 'stands out by ' || array_to_string(em[1:3], ', ') end], lambda x: x is not null), '; ') as reasons from fit where reject_reason is null""")(
    lambda s, d: _fitted(s, d).where("reject_reason is null").select("id", F.array_join("matched", "|").alias("matched"), F.array_join("reasons", "; ").alias("reasons"))
)
query("experience_bands", f"with {FIT} select band, count(*) as n from fit group by 1")(
    lambda s, d: _openings(s, d).groupBy(fit.experience_band(F.col("experience_min"), F.col("experience_max")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
)

# titles and companies in comparable form
_SYN = "lower(coalesce(title, ''))"
for _k in sorted(roles.SYNONYMS, key=len, reverse=True):
    _SYN = f"regexp_replace({_SYN}, '\\b{_k}\\b', '{roles.SYNONYMS[_k]}', 'g')"
_FLAT = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
ROL = f"""{OPN}, r0 as (select *, {_FLAT(_SYN)} as nt, {_FLAT("lower(coalesce(company, ''))")} as c0 from opn),
r1 as (select *, coalesce(nullif(array_to_string(list_filter(string_split(c0, ' '), lambda w: w not in ({_quoted(roles.CORPORATE)})), ' '), ''), c0) as nc, list_sort(list_distinct(list_filter(string_split(nt, ' '), lambda w: length(w) > 2 and w not in ({_quoted(roles.STOPWORDS)})))) as ws from r0),
rol as (select *, list_filter(ws, lambda w: w in ({_quoted(roles.DISCRIMINATORS)})) as ms, 'r:' || left(sha1(nc || '|' || nt), 16) as role_key from r1)"""
query("role_titles", f"with {ROL} select id, nt as title, array_to_string(ws, ' ') as words, array_to_string(ms, ' ') as marks from rol")(
    lambda s, d: _openings(s, d).select("id", roles.normal_title(F.col("title")).alias("t"), roles.title_words(F.col("title")).alias("w")).select("id", F.col("t").alias("title"), F.array_join("w", " ").alias("words"), F.array_join(roles.marks(F.col("w")), " ").alias("marks"))
)
query("role_companies", f"with {ROL} select nc as company, count(*) as n from rol group by 1")(
    lambda s, d: _openings(s, d).groupBy(roles.normal_company(F.col("company")).alias("company")).agg(F.count(F.lit(1)).alias("n"))
)
query("role_keys", f"with {ROL} select role_key, count(*) as n, min(id) as first_id from rol group by 1")(
    lambda s, d: roles.keys(_openings(s, d).withColumn("url", F.lit(""))).groupBy("role_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
)


def _placed(s, d):
    return _openings(s, d).select("id", F.col("id").alias("place"), F.concat(F.lit("https://www.jobs.example/"), (F.col("id") % 5000).cast("string")).alias("url"), "company", "title")


#: An ordered fold, which SQL does not express; a test holds it against a plain one.
query("role_dedupe")(lambda s, d: roles.one_of_each(_placed(s, d), key="id"))

# searches and what is sent
query("search_links", """select 'jobs.' || lower(replace(n_name, ' ', '')) || '.example · ' || r_name || ' (past week)' as label,
 'https://www.google.com/search?q=site%3Ajobs.' || lower(replace(n_name, ' ', '')) || '.example+%28%22vice+president+alliances%22+OR+%22head+key+accounts%22+OR+%22AVP+partner+banking%22%29&tbs=qdr:w' as url from nation join region on n_regionkey = r_regionkey""")(
    lambda s, d: roles.searches(B.table(s, d, "nation").join(B.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region_title"), F.concat(F.lit("jobs."), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".example")).alias("site")), list(PROFILE.queries))
)
query("saved_searches", "select url, min(o_orderkey) as place from (select concat('https://x.example/', o_custkey % 50) as url, o_orderkey from orders) group by 1")(
    lambda s, d: roles.first_of_url(B.table(s, d, "orders").selectExpr("concat('https://x.example/', o_custkey % 50) as url", "o_orderkey as place"))
)
query("query_expansion", f"with s as (select s_suppkey, case when s_suppkey % 3 = 0 then s_name when s_suppkey % 3 = 1 then '' end as q from supplier) select s_suppkey, q as phrase from s where q <> '' union all select s_suppkey, p from s, unnest([{_quoted([q for q in PROFILE.queries if q])}]) u(p) where coalesce(q, '') = ''")(
    lambda s, d: roles.queries_of(B.table(s, d, "supplier").selectExpr("s_suppkey", "case when s_suppkey % 3 = 0 then s_name when s_suppkey % 3 = 1 then '' end as query"), [q for q in PROFILE.queries if q]).select("s_suppkey", "phrase")
)
query("empty_brief_policy", """with x as (select o_orderdate::date as day, count(*) filter (o_orderstatus = 'P') as published from orders group by 1)
 select day, published, case when published > 0 then 'items' when dayname(day) = 'Monday' then 'empty, but monday is the proof-of-life day' end as why from x""")(
    lambda s, d: B.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("published")).select("day", "published", roles.goes_out(F.col("published"), F.lit(False), F.lit("Monday"), F.col("day")).alias("why"))
)

"""Openings against a profile: gates in order, a score from 0 to 100, a tier, and the reasons."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import phrases
from ..functions.steps import once


@dataclass(frozen=True)
class Level:
    """A grade, its value from 0 to 1, and what names it in a title."""

    title: str
    value: float
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Region:
    """A target region: preferred cities count in full, its other places at its value."""

    id: str
    title: str
    value: float
    preferred: tuple[str, ...]
    places: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    """What is looked for. The numbers are the defaults of the method (fixed values)."""

    levels: tuple[Level, ...]
    regions: tuple[Region, ...]
    function_strong: tuple[str, ...]
    function_supporting: tuple[str, ...] = ()
    domain_strong: tuple[str, ...] = ()
    domain_adjacent: tuple[str, ...] = ()
    edge: tuple[str, ...] = ()
    exclude_title: tuple[str, ...] = ()
    exclude_anywhere: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    points: dict = field(default_factory=lambda: {"seniority": 30.0, "function": 30.0, "domain": 20.0, "geography": 10.0, "edge": 10.0})
    saturation: dict = field(default_factory=lambda: {"function": 3.0, "domain": 2.0, "edge": 3.0})
    supporting: float = 0.35
    adjacent: float = 0.55
    title_factor: float = 2.0
    most_keywords: int = 10
    floor_years: int = 8
    ideal_years: int = 12
    tiers: dict = field(default_factory=lambda: {"strong": 75.0, "possible": 55.0, "stretch": 35.0})


def experience_band(low: Column, high: Column) -> Column:
    """X25: '8-12 yrs', '15+ yrs', 'up to 5 yrs' or nothing."""
    text = lambda c: c.cast("string")
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(text(low), F.lit("-"), text(high), F.lit(" yrs")))
        .when(low.isNotNull(), F.concat(text(low), F.lit("+ yrs")))
        .when(high.isNotNull(), F.concat(F.lit("up to "), text(high), F.lit(" yrs")))
        .otherwise(F.lit(""))
    )


def seniority(title: Column, levels: tuple[Level, ...]) -> Column:
    """struct(length, …, level, value, hit) of the longest marker in a title; of equally long ones that of the earlier level; null without any."""

    def marks(j: int, level: Level) -> Column:
        return F.transform(phrases(title, level.keywords), lambda h, i: F.struct(F.length(h).alias("n"), F.lit(-j).alias("rank"), (-i).alias("at"), F.lit(level.title).alias("level"), F.lit(level.value).alias("value"), h.alias("hit")))

    return F.array_max(F.concat(*(marks(j, level) for j, level in enumerate(levels))))


def located(text: Column, regions: tuple[Region, ...]) -> Column:
    """struct(id, title, value, place, preferred) of the region that a text names: a preferred city of any region comes before other places."""

    def first(region: Region, names: tuple[str, ...], preferred: bool) -> Column:
        hits = phrases(text, names)
        return F.when(F.size(hits) > 0, F.struct(F.lit(region.id).alias("id"), F.lit(region.title).alias("title"), F.lit(1.0 if preferred else region.value).alias("value"), F.get(hits, F.lit(0)).alias("place"), F.lit(preferred).alias("preferred")))

    return F.coalesce(*(first(r, r.preferred, True) for r in regions), *(first(r, r.places, False) for r in regions))


def _dimension(lists: list[tuple[str, float]], factor: float, most: int, full: float) -> Column:
    """struct(value, matched): keywords found anywhere at their worth, more in the title, up to `most` of them, as a share of `full`.

    lists: for each list the name of its columns, _n_name with what the posting has and _t_name with what the title has.
    """

    def weighed(name: str, worth: float) -> Column:
        return F.transform(F.col(f"_n_{name}"), lambda k: F.struct(k.alias("k"), F.when(F.array_contains(f"_t_{name}", k), F.lit(worth * factor)).otherwise(F.lit(worth)).alias("w")))

    counted = F.slice(F.concat(*(weighed(name, worth) for name, worth in lists)), 1, most)
    total = F.aggregate(counted, F.lit(0.0), lambda a, x: a + x["w"])
    return F.struct(F.least(F.lit(1.0), total / F.lit(full)).alias("value"), F.transform(counted, lambda x: x["k"]).alias("matched"))


def fitted(openings: DataFrame, p: Profile) -> DataFrame:
    """Openings with fit, tier, seniority, region, region_title, matched, reasons and reject_reason.

    openings: title, company, summary, location, experience_min, experience_max, and any others. Gates come in order
    and the first that fails gives the reason: excluded in the title, excluded anywhere, grade, function, place (of
    the location, else of the whole posting), experience. Rejected openings have null in the other new columns.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.concat_ws(" ", F.nullif("company", F.lit("")), F.nullif("summary", F.lit("")))
    d = openings.withColumns({"_title": text("title"), "_hay": F.concat(text("title"), F.lit(" "), body)})
    lists = {"function": p.function_strong, "more_function": p.function_supporting, "domain": p.domain_strong, "more_domain": p.domain_adjacent, "edge": p.edge}
    found = {f"_n_{k}": phrases(F.col("_hay"), v) for k, v in lists.items()} | {f"_t_{k}": phrases(F.col("_title"), v) for k, v in lists.items()}
    d = once(d, found | {
        "_not_title": F.get(phrases(F.col("_title"), p.exclude_title), F.lit(0)),
        "_not_any": F.get(phrases(F.col("_hay"), p.exclude_anywhere), F.lit(0)),
        "_level": seniority(F.col("_title"), p.levels),
        "_where": F.coalesce(located(text("location"), p.regions), located(F.col("_hay"), p.regions)),
        "_band": experience_band(F.col("experience_min"), F.col("experience_max")),
    })
    d = once(d, {
        "_function": _dimension([("function", 1.0), ("more_function", p.supporting)], p.title_factor, p.most_keywords, p.saturation["function"]),
        "_domain": _dimension([("domain", 1.0), ("more_domain", p.adjacent)], p.title_factor, p.most_keywords, p.saturation["domain"]),
        "_edge": _dimension([("edge", 1.0)], p.title_factor, p.most_keywords, p.saturation["edge"]),
    }).withColumn("_named", F.size("_n_function") > 0)
    reason = (
        F.when(F.col("_not_title").isNotNull(), F.concat(F.lit("title names '"), "_not_title", F.lit("', another line of work")))
        .when(F.col("_not_any").isNotNull(), F.concat(F.lit("posting names '"), "_not_any", F.lit("'")))
        .when(F.col("_level").isNull(), F.lit("no grade marker in the title"))
        .when(~F.col("_named"), F.lit("names no function that is looked for"))
        .when(F.col("_where").isNull(), F.concat(F.lit("location ("), F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("no location given")), F.lit(") is outside the target regions")))
        .when(F.col("experience_max") < p.floor_years, F.concat(F.lit("advertises "), "_band", F.lit(f", below the {p.floor_years}-year floor")))
    )
    worth = {"seniority": F.col("_level.value"), "function": F.col("_function.value"), "domain": F.col("_domain.value"), "geography": F.col("_where.value"), "edge": F.col("_edge.value")}
    fit = F.bround(F.least(F.lit(100.0), reduce(lambda a, b: a + b, (F.lit(p.points[k]) * v for k, v in worth.items()))), 1)
    d = once(d, {"reject_reason": reason, "_fit": fit})
    tier = F.when(F.col("_fit") >= p.tiers["strong"], "strong").when(F.col("_fit") >= p.tiers["possible"], "possible").when(F.col("_fit") >= p.tiers["stretch"], "stretch").otherwise("below")
    listed = lambda c, n, gap: F.array_join(F.slice(F.col(c), 1, n), gap)
    some = lambda c, x: F.when(F.size(c) > 0, x)
    place = F.when(F.col("_where.preferred"), F.col("_where.place")).otherwise(F.coalesce(F.nullif(F.col("location"), F.lit("")), F.col("_where.place")))
    reasons = F.array_compact(F.array(
        F.concat("_level.level", F.lit(" ("), "_level.hit", F.lit(")")),
        some("_function.matched", listed("_function.matched", 3, " · ")),
        some("_domain.matched", listed("_domain.matched", 1, "")),
        F.concat("_where.title", F.lit(" — "), place),
        F.when(F.col("_band") != "", F.concat("_band", F.lit(" asked"), F.when(F.col("experience_min") >= p.ideal_years, F.lit(", which fits")).otherwise(F.lit("")))),
        some("_edge.matched", F.concat(F.lit("stands out by "), listed("_edge.matched", 3, ", "))),
    ))
    ok = F.col("reject_reason").isNull()
    out = {"fit": F.col("_fit"), "tier": tier, "seniority": F.col("_level.level"), "region": F.col("_where.id"), "region_title": F.col("_where.title"), "matched": F.concat("_function.matched", "_domain.matched", "_edge.matched"), "reasons": reasons}
    return d.select(*openings.columns, *(F.when(ok, v).alias(k) for k, v in out.items()), "reject_reason")


def by_tier(fitted_openings: DataFrame, order: tuple[str, ...] = ("strong", "possible", "stretch")) -> DataFrame:
    """Tier, place, openings, best: the tiers in their fixed order; empty ones, and what is below all, are left out."""
    dim = fitted_openings.sparkSession.createDataFrame([(t, i) for i, t in enumerate(order, 1)], "tier string, place int")
    counted = fitted_openings.where("reject_reason is null").groupBy("tier").agg(F.count(F.lit(1)).alias("openings"), F.max("fit").alias("best"))
    return counted.join(F.broadcast(dim), "tier").select("tier", "place", "openings", "best").orderBy("place")

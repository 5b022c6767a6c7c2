"""Items against topics: sections with strong and supporting keywords, certification, the domain gate and the threshold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import inflected, mentions
from ..functions.steps import once


@dataclass(frozen=True)
class Topic:
    """A section: its keywords, how much it counts, whether it vouches for the domain, and which strong keywords need company."""

    id: str
    strong: tuple[str, ...]
    supporting: tuple[str, ...] = ()
    multiplier: float = 1.0
    certifies: bool = False
    ambiguous: tuple[str, ...] = ()


@dataclass(frozen=True)
class Topics:
    """All sections in order, and the numbers of the method."""

    sections: tuple[Topic, ...]
    exclude: tuple[str, ...] = ()
    gate: tuple[str, ...] = ()
    sources: dict[str, tuple[float, str | None]] = field(default_factory=dict)
    strong_weight: float = 3.0
    supporting_weight: float = 1.0
    title_factor: float = 1.5
    most_keywords: int = 8
    hint_bonus: float = 1.0
    bypass: float = 2.0
    least: float = 3.0


def _contributions(name: str, weight: float, factor: float) -> Column:
    """array of struct(w, k): each keyword found in title or summary, at its weight, or more if the title has it."""
    return F.transform(F.array_union(f"_t_{name}", f"_x_{name}"), lambda k: F.struct(F.when(F.array_contains(f"_t_{name}", k), F.lit(weight * factor)).otherwise(F.lit(weight)).alias("w"), k.alias("k")))


def routed(items: DataFrame, t: Topics) -> DataFrame:
    """Items with score, section_id, matched and reject_reason.

    Every section adds up its heaviest keywords, times its multiplier, plus a bonus where the item's source hints at
    it; the best section, of equal ones the first, is the item's, and its source's weight comes on top. Rejected are
    items that name an excluded keyword, that match no section, that no certified section, weighty source or gate
    keyword places in the domain, and whose score stays below the threshold; score and section are given for these
    last ones too. A section certifies if it has a strong hit and one of its hits is not an ambiguous strong one.
    items: source_id, title, summary, and any others; a source that is not configured weighs nothing.
    """
    d = items.withColumns({"_title": F.coalesce("title", F.lit("")), "_summary": F.coalesce("summary", F.lit(""))})
    d = d.withColumn("_hay", F.concat("_title", F.lit(". "), "_summary"))
    # sources and sections are a configuration of a few dozen entries, which becomes literals of the plan
    weight = F.lit(0.0)
    hint = F.lit(None).cast("string")
    for source, (w, section) in t.sources.items():
        weight = F.when(F.col("source_id") == source, F.lit(float(w))).otherwise(weight)
        hint = F.when(F.col("source_id") == source, F.lit(section).cast("string")).otherwise(hint)
    lists = {f"{kind}{i}": words for i, x in enumerate(t.sections) for kind, words in (("s", x.strong), ("p", x.supporting))}
    found = {f"_{a}_{name}": inflected(F.col(c), words) for name, words in lists.items() for a, c in (("t", "_title"), ("x", "_summary"))}
    d = once(d, found | {"_weight": weight, "_hint": hint, "_blocked": F.array_min(inflected(F.col("_hay"), t.exclude)), "_gate": mentions(F.col("_hay"), t.gate)})
    d = once(d, {f"_{name}": _contributions(name, t.strong_weight if name[0] == "s" else t.supporting_weight, t.title_factor) for name in lists})
    certified, best = F.lit(False), []
    for i, x in enumerate(t.sections):
        strong, supporting = F.col(f"_s{i}"), F.col(f"_p{i}")
        if x.certifies:
            vouching = (F.size(F.array_except(F.transform(strong, lambda h: h["k"]), F.array(*map(F.lit, x.ambiguous or ("",))))) > 0) | (F.size(supporting) > 0)
            certified = certified | ((F.size(strong) > 0) & vouching)
        counted = F.slice(F.sort_array(F.concat(strong, supporting), False), 1, max(1, t.most_keywords))
        total = F.aggregate(counted, F.lit(0.0), lambda a, h: a + h["w"]) * F.lit(x.multiplier) + F.when(F.col("_hint") == x.id, F.lit(t.hint_bonus)).otherwise(F.lit(0.0))
        there = (F.size(counted) > 0) | F.coalesce(F.col("_hint") == x.id, F.lit(False))
        best.append(F.when(there, F.struct(total.alias("total"), F.lit(-i).alias("rank"), F.lit(x.id).alias("id"), F.array_sort(F.transform(counted, lambda h: h["k"])).alias("matched"))))
    d = once(d, {"_best": F.array_max(F.array_compact(F.array(*best))), "_certified": certified})
    score = F.bround(F.col("_best.total") + F.col("_weight"), 3)
    outside = ~F.col("_certified") & (F.col("_weight") < t.bypass) & ~F.col("_gate")
    reason = (
        F.when(F.col("_blocked").isNotNull(), F.concat(F.lit("excluded on '"), "_blocked", F.lit("'")))
        .when(F.col("_best").isNull(), "no topic keywords matched")
        .when(outside, "outside the domain")
        .when(score < t.least, "below the threshold")
    )
    d = once(d, {"reject_reason": reason})
    told = F.col("reject_reason").isNull() | (F.col("reject_reason") == "below the threshold")
    return d.select(*items.columns, F.when(told, score).alias("score"), F.when(told, F.col("_best.id")).alias("section_id"), F.when(told, F.col("_best.matched")).alias("matched"), "reject_reason")


def section_order(routed_items: DataFrame, t: Topics, by_volume: bool = False) -> DataFrame:
    """section_id, items, place: sections with items in their configured order, or by falling number of items, ties in that order."""
    dim = routed_items.sparkSession.createDataFrame([(x.id, i) for i, x in enumerate(t.sections)], "section_id string, ordinal int")
    counted = routed_items.where("reject_reason is null").groupBy("section_id").agg(F.count(F.lit(1)).alias("items")).join(F.broadcast(dim), "section_id")
    # as many rows as there are sections
    ordered = counted.agg(F.array_sort(F.collect_list(F.struct((-F.col("items") if by_volume else F.lit(0).cast("long")).alias("v"), "ordinal", "section_id", "items"))).alias("x"))
    return ordered.select(F.posexplode("x").alias("i", "s")).select("s.section_id", "s.items", (F.col("i") + 1).alias("place"))

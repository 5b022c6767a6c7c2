"""Mixing sources to target weights by entropy balancing, with document rates rounded into copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, n_words

#: No document is taken more often than this, and no target is above this many times its source.
CAP = 3
#: Newton steps; each at least halves the bracket of every source that has not settled.
STEPS = 40
#: A source has settled when its expected words are this near its target, as a share.
NEAR = 1e-6
#: Rows of one source and size are ranked in so many parts, so that copies of one text do not meet in one task.
PARTS = 64


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating by code point order of the sources, null last.

    Targets share the sum of all sizes by weight but stop at cap times their source's size; the excess is shared
    by weight among the rest, until none is above. That level is found in closed form: with sources by rising
    cap * size / weight, those below the level are at their cap and the rest get level * weight.
    sizes: source, source_size, one row each.
    """
    ranked = sizes.select("*", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).alias("rank"))
    ranked = ranked.select("*", (F.col("rank") % 3 + 1).cast("double").alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    rising = Window.orderBy(F.col("most") / F.col("w"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    stepped = ranked.select("*", F.when(level * F.col("w") <= F.col("most"), level).alias("open_level"), F.row_number().over(rising).alias("at"))
    found = stepped.select("*", F.min_by("open_level", F.when(F.col("open_level").isNotNull(), F.col("at"))).over(whole).alias("level"))
    return found.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _rate(tilt: F.Column, size: F.Column, mean: F.Column, cap: int) -> F.Column:
    """cap * e^(tilt x) / (e^(tilt x) + cap - 1), x the size in means of the source: 1 without a tilt, under cap always."""
    x = F.greatest(F.lit(-600.0), F.least(F.lit(600.0), tilt * size / mean))
    return F.when(tilt == F.lit(float("inf")), F.lit(float(cap))).otherwise(F.lit(float(cap)) / (F.lit(1.0) + F.lit(cap - 1.0) * F.exp(-x)))


def solve(strata: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target, mean, tilt: the dual of entropy balancing, by Newton steps over all strata.

    The entropy is not the plain one, whose tilted rates e^x have no bound, while no document may pass cap times its
    size: rates r minimise the entropy of r and of cap - r relative to a rate of 1, subject to sum(r * size) = target
    for each source. The optimum is the tilted rate of _rate, near e^x where that is small against cap, and the dual is
    convex with one tilt for each source.
    Each step is one aggregation of the strata (source, size, n) that gives value and slope at the present tilts;
    a step that would leave the bracket of a tilt is replaced by bisection. Targets at the cap have an infinite tilt.
    Source is compared null-safe. Everything per source stays in a table. Sums are of decimals, so they do not depend
    on the order of rows and reruns agree. A source that has not settled after STEPS steps is an error.
    """
    mean = strata.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    m = mean.select(F.col("source").alias("s"), "mean")
    state = goals.join(m, goals.source.eqNullSafe(m.s)).drop("s").where("source_size > 0")
    full = F.col("target") >= F.lit(float(cap)) * F.col("source_size") * (1 - 1e-9)
    state = keep(state.select("*", F.when(full, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("tilt"), F.lit(-500.0).alias("lo"), F.lit(500.0).alias("hi"), full.alias("done")))
    for _ in range(STEPS):
        now = state.where("not done").select(F.col("source").alias("s"), "mean", "tilt")
        at = strata.join(now, strata.source.eqNullSafe(now.s))
        r = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        words = F.col("n") * F.col("size")
        exact = lambda c: F.sum(c.cast("decimal(28,8)")).cast("double")
        sums = at.groupBy("s").agg(exact(words * r).alias("value"), exact(words * r * (F.lit(1.0) - r / F.lit(float(cap))) * F.col("size") / F.col("mean")).alias("slope"))
        moved = state.join(sums, state.source.eqNullSafe(sums.s), "left").drop("s")
        off = F.col("value") - F.col("target")
        lo = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))
        moved = moved.select("source", "source_size", "target", "mean", "tilt", lo.alias("lo"), hi.alias("hi"), (F.col("done") | (F.abs(off) <= F.lit(NEAR) * F.col("target"))).alias("done"), (F.col("tilt") - F.try_divide(off, F.col("slope"))).alias("step"))
        good = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        moved = moved.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(good, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("step")
        state = keep(moved)
        if state.where("not done").isEmpty():
            break
    else:
        raise ValueError(f"a source did not settle in {STEPS} steps")
    return state.select("source", "source_size", "target", "mean", "tilt")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP, carry: list[str] | None = None) -> DataFrame:
    """_row (a struct of the columns carry of docs, or of all), and _size, _source_size, _target and _copies: how often the mix takes each row.

    Size is the number of words. The tilted rates of solve() are rounded into copies by systematic sampling: strata
    (source, size) lie in a line by size, and a stratum gets as many copies as whole numbers fall into its piece of
    the running sum of rates. That leaves a source's words off its target by up to half of its longest document,
    which one copy more or less of its shortest documents makes up. Inside a stratum the copies are spread evenly;
    rows are ranked only inside one of its PARTS.

    Null texts have size 0 and are kept as often as a rate of 1 gives; sources may be null; repeated rows are
    ranked apart; a table without words, or empty, gives targets of 0 and one copy of each row. Reruns agree up to
    which of two equal rows gets a copy.
    """
    h = F.xxhash64(F.col(key), F.col(text))
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("_size"), h.alias("_h"), F.pmod(h, F.lit(PARTS)).cast("int").alias("_part"))
    if text not in carry:
        rows = keep(rows)  # then it is narrow, and the texts are read once
    parts = keep(rows.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    strata = keep(parts.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sums = strata.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = keep(targets(sums, cap))
    tilts = solve(strata.where("size > 0"), goals, cap)
    g, t = goals, tilts.select(F.col("source").alias("s"), "mean", "tilt")
    known = g.join(t, g.source.eqNullSafe(t.s), "left").drop("s")
    s = strata.select(F.col("source").alias("s"), "size", "n")
    laid = s.join(known, s.s.eqNullSafe(known.source)).drop("s")
    rate = F.when((F.col("size") == 0) | F.col("tilt").isNull(), F.lit(1.0)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap))
    laid = laid.select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    ahead = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    each = Window.partitionBy("source")
    start = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(ahead), F.lit(0.0))
    laid = laid.select("*", (F.floor(start + F.col("n") * F.col("rate") + 0.5) - F.floor(start + 0.5)).alias("k"))
    laid = laid.select("*", (F.col("target") - F.sum(F.col("k") * F.col("size")).over(each)).alias("off"))
    # what is still missing, or too much, is made up by one copy more, or less, of the shortest documents
    room = F.when(F.col("off") > 0, F.least("n", F.lit(cap) * F.col("n") - F.col("k"))).otherwise(F.least("n", "k"))
    laid = laid.select("*", F.when(F.col("size") > 0, room).otherwise(F.lit(0)).alias("room"))
    left = F.abs("off") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(ahead), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("room"), F.coalesce(F.floor(F.try_divide(left, F.col("size")) + 0.5), F.lit(0))))
    laid = laid.select("source", "size", "source_size", "target", (F.col("k") + F.signum("off") * more).cast("long").alias("k"), "n")
    inner = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    p = parts.select(F.col("source").alias("s"), F.col("size").alias("z"), "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("ahead"))
    place = p.join(laid, p.s.eqNullSafe(laid.source) & (p.z == laid["size"])).select("s", "z", "part", "source_size", "target", "n", "k", "ahead")
    place = keep(place)
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_source", "_size", "_part").orderBy("_h", "_key")) - 1)
    joined = ranked.join(place, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z")) & (F.col("_part") == F.col("part")))
    # the k copies of n rows, spread evenly: whole numbers, so the sum is k exactly
    low = F.expr("(ahead + _i) * k div n")
    copies = F.expr("(ahead + _i + 1) * k div n") - low
    return joined.select("_row", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.least(F.lit(cap).cast("long"), copies).alias("_copies"))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    done = mix(docs.select("doc_id", "text", "source"), carry=["doc_id"])
    return done.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))

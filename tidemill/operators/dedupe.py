"""The ordered, greedy removal of near-duplicates as rounds of joins: what is first within its reach stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import cut, let_go, once


def kind_hash(same_marks: bool) -> Column:
    """Equal for sets with equal elements, marks and, where marks and groups must agree, group."""
    return F.xxhash64(F.array_join("s", "\n"), F.array_join(F.array_sort("p"), "\n"), F.when(F.lit(same_marks), F.col("g")))


def similar_pairs(sets: DataFrame, threshold: float, same_marks: bool = False) -> DataFrame:
    """k_a, k_b, id_a, id_b, similarity: pairs of sets s with a Jaccard similarity of threshold or more whose groups and marks agree.

    sets: id, s (distinct strings), p (marks), g (group). Groups must be known and equal where same_marks is set,
    and marks equal; otherwise groups do not matter, and marks only part two sets that both have some but none in
    common. Sets with equal elements, marks and group stand for each other, so copies make no pairs; their k is
    kind_hash(), their id the smallest.

    A prefix filter over an inverted index: sets that are so similar share one of their rarest elements. An entry of the
    index has the whole set, as numbers, so a pair is decided where two entries meet, in full, and only by the rarest
    element that both have: candidates are neither written nor shuffled, only the index and the pairs found are. Bits of
    the sets, which differ by no more than the sets do, spare nearly all of the rest the comparison.
    """
    one = sets.where("size(s) > 0").select("id", "s", F.array_sort("p").alias("p"), "g")
    if same_marks:
        one = one.where("g is not null")
    one = one.withColumn("kind", kind_hash(same_marks))
    kinds = cut(one.groupBy("kind").agg(F.min("id").alias("id"), F.first("s").alias("s"), F.first("p").alias("p"), F.first("g").alias("g")))
    # an element counts inside its group and marks where these must agree
    element = ["g", "p", "w"] if same_marks else ["w"]
    spelled = kinds.select("kind", "id", F.size("s").alias("n"), "g", "p", F.explode("s").alias("w"))
    # those of one set only are in no two; the others get numbers, which are written, so that they stay
    often = cut(spelled.groupBy(*element).agg(F.count(F.lit(1)).alias("f")).where("f > 1").withColumn("e", F.monotonically_increasing_id()))
    known = spelled.join(often, element).groupBy("kind").agg(*(F.first(c).alias(c) for c in ("id", "n", "p")), F.array_sort(F.collect_list(F.struct("f", "e"))).alias("s"))
    bits = F.aggregate("s", F.lit(0).cast("long"), lambda bits, e: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(e), F.lit(64)).cast("int"))))
    known = cut(known.withColumn("s", F.col("s.e")).withColumn("bits", bits))
    # the rarest elements of a set are those that no other has
    prefix = (F.size("s") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    index = known.where(prefix > 0).select(F.explode(F.slice("s", F.lit(1), prefix)).alias("e"), "kind", "id", "n", "p", "s", "bits")
    a, b = (index.select("e", *(F.col(c).alias(f"{c}_{x}") for c in ("kind", "id", "n", "p", "s", "bits"))) for x in "ab")
    near = F.expr(f"kind_a < kind_b and least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    # what both have is threshold / (1 + threshold) of all their elements at least
    apart = F.size("s_a") + F.size("s_b") - (F.col("n_a") + F.col("n_b")) * (2 * threshold / (1 + threshold)) + 1e-9
    met = a.join(b, "e").where(near & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= apart))
    met = once(met.select("e", "kind_a", "kind_b", "id_a", "id_b", "n_a", "n_b", "p_a", "p_b", "s_a", "s_b"), {"both": F.array_intersect("s_a", "s_b")})
    sim = F.size("both") / (F.col("n_a") + F.col("n_b") - F.size("both"))
    agree = F.lit(True) if same_marks else (F.size("p_a") == 0) | (F.size("p_b") == 0) | F.arrays_overlap("p_a", "p_b")
    found = met.where((F.get("both", F.lit(0)) == F.col("e")) & (sim >= threshold) & agree)
    return found.select(F.col("kind_a").alias("k_a"), F.col("kind_b").alias("k_b"), "id_a", "id_b", F.round(sim, 6).alias("similarity"))


def kinds_of(sets: DataFrame, same_marks: bool = False) -> DataFrame:
    """id, kind: which sets similar_pairs() takes as one."""
    one = sets.where("size(s) > 0" + (" and g is not null" if same_marks else ""))
    return one.select("id", kind_hash(same_marks).alias("kind"))


def greedy(items: DataFrame, threshold: float, same_marks: bool = False) -> DataFrame:
    """Id, slot, duplicates of the items that are kept: in order of place, each item joins a kept one that it matches.

    Items match by key_a, by key_b, or by similar sets (see similar_pairs()); an item joins the kept one of its key_a, else
    of its key_b, else the first similar one. items: id (long), place, key_a, key_b,
    s, p, g; places follow falling rank, so that the first of a slot is its best, and none comes twice. Items that agree
    in key_b must agree in s, p and g. Items that agree in both keys are one with a count from the start; first_free()
    finds those that stay.
    """
    one = items.groupBy("key_a", "key_b").agg(F.min_by(F.struct("id", "place", "s", "p", "g"), "place").alias("x"), F.count(F.lit(1)).alias("n"))
    one = one.select("key_a", "key_b", "n", "x.*")
    kind = F.when(F.size("s") > 0, kind_hash(same_marks))
    if same_marks:
        kind = F.when(F.col("g").isNotNull(), kind)
    named = F.array_compact(F.array(F.xxhash64(F.lit("a"), "key_a"), F.xxhash64(F.lit("b"), "key_b"), F.xxhash64(F.lit("k"), kind)))
    # a null kind hashes to a group of its own, which must not join items
    own = F.when(kind.isNull(), F.slice(named, 1, 2)).otherwise(named)
    one = cut(one.withColumn("groups", own))
    pairs = similar_pairs(one, threshold, same_marks).select(F.xxhash64(F.lit("k"), "k_a").alias("a"), F.xxhash64(F.lit("k"), "k_b").alias("b"))
    links = cut(pairs.union(pairs.select("b", "a")))
    kept = first_free(one.select("id", "place", "groups"), links)
    best = reached(kept.select(F.explode("groups").alias("group"), "place"), links)
    # an item may share a key with one that was kept after it; such a match came too late
    before = one.select("id", "n", F.col("place").alias("own"), F.posexplode("groups").alias("i", "group")).join(best, "group").where("place <= own")
    by = [F.min(F.when(F.col("i") == i, F.col("place"))) for i in range(3)]
    joined = before.groupBy("id").agg(F.first("n").alias("n"), F.coalesce(*by).alias("place"))
    total = joined.groupBy("place").agg(F.sum("n").alias("duplicates"))
    return kept.join(total, "place").select("id", F.col("id").alias("slot"), "duplicates")


def reached(groups: DataFrame, links: DataFrame) -> DataFrame:
    """group, place: the lowest place in each group or in one linked to it. groups: group, place; links: a, b, both ways round."""
    low = groups.groupBy("group").agg(F.min("place").alias("place"))
    far = links.join(low, links.b == low.group).select(F.col("a").alias("group"), "place")
    return low.unionByName(far).groupBy("group").agg(F.min("place").alias("place"))


def first_free(items: DataFrame, links: DataFrame) -> DataFrame:
    """The items that an ordered fold keeps: of all items in order of place, those that meet none kept before.

    Two items meet if they share a group or have groups that are linked. items: id, place, groups (array of long);
    links: a, b, both ways round. In rounds: an item that is the first of all within its reach that are still open is
    kept, and what it reaches goes. Every round decides the first open item of each connected part at least, most
    rounds nearly all; each shuffles one row for each open item and group of it, minima are combined before the
    shuffle, and only what is open goes on, with the links between what is open. The result is that of the fold,
    whatever the rounds.
    """
    kept, open_items, rounds = None, items, 0
    while True:
        rounds += 1
        single = open_items.select("id", "place", F.explode("groups").alias("group"))
        near = reached(single.select("group", "place"), links).withColumnRenamed("place", "first")
        first = single.join(near, "group").groupBy("id").agg(F.min("first").alias("first"))
        decided = cut(open_items.join(first, "id").withColumn("keep", F.col("first") == F.col("place")).drop("first"))
        new = decided.where("keep").drop("keep")
        if rounds > 1 and new.isEmpty():
            return kept
        kept = new if kept is None else kept.unionByName(new)
        if rounds % 16 == 0:
            kept = cut(kept)
        taken = new.select(F.explode("groups").alias("group")).distinct()
        taken = taken.unionByName(links.join(taken, links.b == taken.group).select(F.col("a").alias("group"))).distinct()
        rest = decided.where("not keep").drop("keep")
        gone = rest.select("id", F.explode("groups").alias("group")).join(taken, "group", "left_semi").select("id").distinct()
        open_items = cut(rest.join(gone, "id", "left_anti"))
        still = open_items.select(F.explode("groups").alias("group")).distinct()
        for end in "ab":
            links = links.join(still, links[end] == still.group, "left_semi")
        links = cut(links)
        del single, near, first, decided, new, taken, rest, gone, still
        let_go(items.sparkSession)

"""From routed items to a ranked, capped brief: window, rank, quotas, remove near-duplicates and what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import cut
from . import dedupe

def articles(documents: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Documents as items: the first line's head is the title, every 17th has no date."""
    head = F.regexp_replace(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), r"\s+", " ")
    when = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("doc_id") * 60)
    return documents.select("doc_id", F.col("source").alias("source_id"), F.trim(F.left(head, F.lit(160))).alias("title"), F.col("text").alias("summary"), F.when(F.col("doc_id") % 17 != 0, when).alias("published"))


def within(items: DataFrame, now: Column, hours: int = 26, undated: bool = True, clamp: bool = True) -> DataFrame:
    """items since now - hours; undated ones are stamped now or dropped, future ones (over 3 hours) clamped to now."""
    ts = F.coalesce("published", now) if undated else F.col("published")
    ts = F.when(ts > now + F.expr("interval 3 hours"), now).otherwise(ts) if clamp else ts
    return items.withColumn("published", ts).where(F.col("published") >= now - F.expr(f"interval {hours} hours"))


def ranked(items: DataFrame, score: str = "score", at: str = "published", key: str = "doc_id") -> DataFrame:
    """Place by score, then date, both falling, undated last; ties by key.

    A place is the number of items with a higher score, those of the same score and a later day, and the row's number
    among those of its score and day. So only the totals of distinct scores pass through one task.
    """
    order = [F.desc_nulls_last(at), F.col(key)]
    day = F.to_date(at)
    x = items.withColumns({"_score": F.col(score), "_day": day})
    days = x.groupBy("_score", "_day").agg(F.count(F.lit(1)).alias("n"))
    scores = days.groupBy("_score").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = scores.select(F.col("_score").alias("_s"), before(Window.orderBy(F.desc("_score"))).alias("_above"))
    later = days.select(F.col("_score").alias("_s2"), F.col("_day").alias("_d"), before(Window.partitionBy("_score").orderBy(F.desc_nulls_last("_day"))).alias("_later"))
    start = later.join(above, F.col("_s2").eqNullSafe(F.col("_s"))).select("_s2", "_d", (F.col("_above") + F.col("_later")).alias("_start"))
    inside = x.withColumn("_i", F.row_number().over(Window.partitionBy("_score", "_day").orderBy(*order)))
    j = inside.join(start, F.col("_score").eqNullSafe(F.col("_s2")) & F.col("_day").eqNullSafe(F.col("_d")))
    return j.select(*items.columns, (F.col("_start") + F.col("_i")).cast("int").alias("place"))


def capped(items: DataFrame, per_source: int = 4, per_section: int = 6, total: int = 24, section: str = "section_id") -> DataFrame:
    """Place, doc_id, source_id and section (or tier) of what the quotas by source, by section and in all let through.

    In order of score and date; who is refused by one quota uses up none. No source can have an item kept that is not
    among its best of a section, so each source and section is cut to its quota first: what the fold sees is bounded
    by the number of sections and sources, not of items.
    """
    best = Window.partitionBy("source_id", section).orderBy(F.desc("score"), F.desc_nulls_last("published"), "doc_id")
    near = items.select("doc_id", "source_id", section, "score", "published").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= min(per_source, per_section))
    # falling score and date in an array that is sorted upwards
    rank = F.struct((-F.col("score")).alias("s"), F.coalesce(-F.unix_micros(F.col("published").cast("timestamp")), F.lit(2**62)).alias("d"), F.col("doc_id").alias("i"), "source_id", F.col(section).alias("section"))
    line = near.agg(F.array_sort(F.collect_list(rank)).alias("line"))
    zero = F.array().cast("array<struct<doc_id:bigint,source_id:string,section:string>>")

    def step(kept: Column, x: Column) -> Column:
        same = lambda f: F.size(F.filter(kept, lambda k: k[f] == x[f]))
        free = (F.size(kept) < total) & (same("source_id") < per_source) & (same("section") < per_section)
        return F.when(free, F.array_append(kept, F.struct(x["i"].alias("doc_id"), x["source_id"].alias("source_id"), x["section"].alias("section")))).otherwise(kept)

    kept = line.select(F.posexplode(F.aggregate("line", zero, step)).alias("at", "x"))
    return kept.select((F.col("at") + 1).alias("place"), "x.doc_id", "x.source_id", F.col("x.section").alias(section))


def keys(items: DataFrame) -> DataFrame:
    """Keys of the text, which stands for the link, and of the title in comparable form."""
    return items.withColumn("text_key", X.key("u:", F.col("summary"))).withColumn("title_key", X.key("t:", X.flat(F.col("title"))))


def exact_groups(items: DataFrame) -> DataFrame:
    """D01, by its first key: per text the best item and how many it stands for."""
    k = keys(items)
    return k.groupBy("text_key").agg(F.count(F.lit(1)).alias("items"), F.min("doc_id").alias("first_id"))


def _sets(items: DataFrame) -> DataFrame:
    return items.select(F.col("doc_id").alias("id"), X.stems(F.col("title")).alias("s"), X.periods(F.col("title")).alias("p"), F.lit(None).cast("string").alias("g"))


def title_classes(items: DataFrame) -> DataFrame:
    """doc_id, class_id: titles with the same stems and periods are one class, named by its smallest id; titles without stems are in none."""
    kinds = dedupe.kinds_of(_sets(items))
    head = kinds.groupBy("kind").agg(F.min("id").alias("class_id"))
    return kinds.join(head, "kind").select(F.col("id").alias("doc_id"), "class_id")


def near_pairs(items: DataFrame, threshold: float = 0.62) -> DataFrame:
    """id_a, id_b, similarity: pairs of title_classes() whose stems have a Jaccard similarity of threshold or more and whose periods agree."""
    pairs = dedupe.similar_pairs(_sets(items), threshold)
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def greedy(items: DataFrame, threshold: float = 0.62) -> DataFrame:
    """doc_id, slot, duplicates of the items that stay when each, from the best down, joins the first kept one with its text, its title, or a similar title.

    Items are taken in the order of ranked(), as a brief does, so the first of a slot is its best. Texts go no further
    than their keys, which are written once with title, score and date.
    """
    slim = cut(keys(items).select("doc_id", "score", "published", "title", "text_key", "title_key"))
    k = ranked(slim).select(F.col("doc_id").alias("id"), "place", F.col("text_key").alias("key_a"), F.col("title_key").alias("key_b"), X.stems(F.col("title")).alias("s"), X.periods(F.col("title")).alias("p"), F.lit(None).cast("string").alias("g"))
    return dedupe.greedy(k, threshold).withColumnRenamed("id", "doc_id")


def unseen(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items of which neither key is in the ledger (columns text_key, title_key)."""
    k = keys(items)
    return k.join(ledger.select("text_key").distinct(), "text_key", "left_anti").join(ledger.select("title_key").distinct(), "title_key", "left_anti")


def marked(ledger: DataFrame, published: DataFrame, now: Column) -> DataFrame:
    """The ledger with a row for each key of what was published: only that counts as seen, from now on, and its first stamp stays."""
    new = keys(published).select(F.explode(F.array("text_key", "title_key")).alias("key"), now.alias("seen_at"))
    return ledger.select("key", "seen_at").unionByName(new).groupBy("key").agg(F.min("seen_at").alias("seen_at"))


def pruned(ledger: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """The ledger without entries that are too old or have no readable stamp."""
    return ledger.where(F.col("seen_at") >= now - F.expr(f"interval {days} days"))


def failure_ratio(sources: DataFrame) -> DataFrame:
    """Failed sources by those that were asked; skipped ones were not; nothing asked, nothing failed. sources: status ok, error or skipped."""
    asked = F.count_if(F.col("status") != "skipped")
    failed = F.count_if(F.col("status") == "error")
    return sources.agg(F.count(F.lit(1)).alias("sources"), failed.alias("failed"), F.coalesce(F.round(F.try_divide(failed, asked), 6), F.lit(0.0)).alias("ratio"))


def first_counters(items: DataFrame, routed: DataFrame) -> DataFrame:
    """Fetched, in_window, accepted. routed: the items in the window, with reject_reason."""
    return items.agg(F.count(F.lit(1)).alias("fetched")).crossJoin(routed.agg(F.count(F.lit(1)).alias("in_window"), F.count_if(F.col("reject_reason").isNull()).alias("accepted")))


def counters(items: DataFrame, routed: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """How many items each step of the brief keeps: first_counters(), then after_dedupe, unseen, published.

    routed: the items in the window with score, section_id and reject_reason, as routing.routed() gives them; written once.
    """
    told = cut(routed)
    ok = told.where("reject_reason is null")
    kept = cut(ok.join(greedy(ok).select("doc_id"), "doc_id", "left_semi"))
    fresh = unseen(kept, ledger) if ledger is not None else kept
    out = first_counters(items, told)
    for df, name in ((kept, "after_dedupe"), (fresh, "unseen"), (capped(fresh), "published")):
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # single rows
    return out

"""Multi-party chat formatting: each dialogue from the perspective of each of its speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one part of a rendering; longer dialogues come in several parts, to be joined in order.
PART = 256
#: Turns in one sub of a part: a part has more than one where turn numbers are repeated.
MOST = 4 * PART
#: The part of turns without a number.
LAST = 2**62


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv, perspective, part, sub, n_turns, n_own, text, starts, ends: each dialogue rendered for each speaker.

    For a speaker P the turns of P are the assistant's, turns of the role `system` stay, and all others are a
    user's with the speaker's name. starts and ends are code point offsets, in the part's text, of what P says with
    its end marker: what a loss mask covers. Turns are in order of turn number (null last), role and text.
    A part covers PART turn numbers, a sub MOST turns of a part in that order, counted from 0; offsets are those in
    the sub. So no row holds an unbounded dialogue, and the rendering is the concatenation of parts and subs. The
    place of a turn comes from the totals of the turn numbers before it; equal rows are one with a count till then.

    A null role speaks as "unknown" and is nobody's perspective; a null text is empty; a null conversation is one
    of its own; repeated rows are rendered each; markers inside a text are broken up by a space; dialogues with
    system turns only, and empty tables, give no rows; other columns are ignored.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("r"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("x"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("t") / PART), F.lit(LAST)).cast("long"))
    same = rows.groupBy("c", "part", "t", "r", "x").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c", "part", "t").orderBy(F.coalesce("r", F.lit("")), "x", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("c2", "p2").orderBy("t2").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("c").alias("c2"), F.col("part").alias("p2"), F.col("t").alias("t2")).agg(F.count(F.lit(1)).alias("m"))
    totals = totals.select("c2", "p2", "t2", F.coalesce(F.sum("m").over(line), F.lit(0)).alias("at"))
    inside = same.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i"))
    placed = inside.join(totals, inside.c.eqNullSafe(totals.c2) & (inside.part == totals.p2) & inside.t.eqNullSafe(totals.t2))
    rows = placed.select("c", "t", "r", "x", "part", F.explode(F.sequence(F.col("at") + F.col("i"), F.col("at") + F.col("i") + F.col("n") - 1)).alias("nth"))
    rows = rows.withColumn("sub", F.floor(F.col("nth") / MOST).cast("long"))
    speakers = turns.select(F.col(conv).alias("c2"), F.col(role).alias("who")).where(F.col("who").isNotNull() & (F.col("who") != system)).distinct()
    seen = rows.join(speakers, rows.c.eqNullSafe(speakers.c2))
    own = F.col("r").eqNullSafe(F.col("who"))
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(F.col("r").eqNullSafe(F.lit(system)), F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.coalesce("r", F.lit("unknown")), F.lit("\n")))
    said = F.struct("nth", "x", own.alias("own"), head.alias("head"))
    grouped = seen.select("c", "who", "part", "sub", said.alias("s")).groupBy("c", "who", "part", "sub").agg(F.array_sort(F.collect_list("s")).alias("turns"))
    grouped = grouped.withColumn("pieces", F.transform("turns", lambda s: F.concat(s["head"], s["x"], F.lit("<|im_end|>\n"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"))

    def step(acc, s):
        begin = acc["at"] + F.length(s["head"])
        stop = begin + F.length(s["x"]) + F.lit(len("<|im_end|>"))
        return F.struct(
            (stop + 1).alias("at"),
            F.when(s["own"], F.array_append(acc["starts"], begin)).otherwise(acc["starts"]).alias("starts"),
            F.when(s["own"], F.array_append(acc["ends"], stop)).otherwise(acc["ends"]).alias("ends"),
        )

    done = grouped.select("*", F.aggregate("turns", zero, step).alias("m"))
    return done.select(
        F.col("c").alias(conv), F.col("who").alias("perspective"), "part", "sub", F.size("turns").cast("long").alias("n_turns"), F.size("m.starts").cast("long").alias("n_own"), F.array_join("pieces", "").alias("text"), F.col("m.starts").alias("starts"), F.col("m.ends").alias("ends")
    )


def op3(turns: DataFrame) -> DataFrame:
    """rotate(), the subs of a part joined in order, with the mask as text: start-end, joined by commas; no part where turns have no number."""
    subs = rotate(turns)
    of = Window.partitionBy("conv_id", "perspective", "part").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    moved = subs.withColumn("at", F.coalesce(F.sum(F.length("text")).over(of), F.lit(0)))
    mask = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws("-", (a + F.col("at")).cast("string"), (b + F.col("at")).cast("string"))), ",")
    one = moved.select("conv_id", "perspective", "part", "n_turns", "n_own", F.struct("sub", "text", F.when(F.col("n_own") > 0, mask).alias("mask")).alias("s"))
    one = one.groupBy("conv_id", "perspective", "part").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), F.array_sort(F.collect_list("s")).alias("s"))
    return one.select("conv_id", "perspective", F.when(F.col("part") != LAST, F.col("part")).alias("part"), "n_turns", "n_own", F.array_join("s.text", "").alias("text"), F.array_join("s.mask", ",").alias("mask"))


ORACLE = """
with t as (select conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') as x from conversations),
w as (select distinct conv_id, role as who from t where role is not null and role <> 'system'),
s as (select t.conv_id, who, floor(turn / 256)::bigint as part, turn, coalesce(role, '') as r, x, role is not distinct from who as own,
  case when role is not distinct from who then '<|im_start|>assistant' || chr(10) when role = 'system' then '<|im_start|>system' || chr(10)
    else '<|im_start|>user name=' || coalesce(role, 'unknown') || chr(10) end as head from t join w on t.conv_id is not distinct from w.conv_id),
o as (select *, coalesce(sum(length(head) + length(x) + 11) over (partition by conv_id, who, part order by turn, r, x rows between unbounded preceding and 1 preceding), 0)::bigint as pos from s)
select conv_id, who as perspective, part, count(*)::bigint as n_turns, count(*) filter (own)::bigint as n_own,
  string_agg(head || x || '<|im_end|>' || chr(10), '' order by turn, r, x) as text,
  coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(x) + 10), ',' order by turn, r, x) filter (own), '') as mask
from o group by 1, 2, 3
"""

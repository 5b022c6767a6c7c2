"""Contiguous shards of near equal bytes, from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Ranges of doc_id that are summed apart; only their totals are brought into one order.
RANGES = 256
#: A range that holds one doc_id only (null included) is dealt on by text hash, into so many parts.
PARTS = 64


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows into n_shards contiguous runs of one order, with near equal bytes.

    Size is the UTF-8 length of the text plus 1. The order is by range of the key, then inside a range by key
    and text hash; a key that fills a range by itself is dealt on into PARTS by text hash. A row belongs to the shard in which the middle of its bytes
    falls, so a cut is off its target by at most half of the row on it. Rows are first summed in ranges of the
    key; the totals of the ranges, at most RANGES * PARTS of them, give each range its place, and a window
    inside the range does the rest. Equal rows are carried as one row with a count until the end.

    The key must be a number. Returns key, size, text_crc32, shard, slot (0, 1, ... in each shard), offset (bytes before the row).
    Null texts count as empty; null keys come first; repeated rows each get a slot of their own, next to each
    other; other columns are ignored; an empty table gives no rows. Reruns agree, whatever the partitions.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("h"))
    same = rows.groupBy("k", "size", "crc", "h").agg(F.count(F.lit(1)).alias("n"))
    edges = rows.agg(F.percentile_approx("k", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("e")).first()["e"] or []
    heavy = sorted({a for a, b in zip(edges, edges[1:], strict=False) if a == b})
    dense = F.col("k").isNull() | (F.col("k").isin(heavy) if heavy else F.lit(False))
    part = F.when(dense, F.pmod("h", F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    same = keep(same.select("*", _below(F.col("k"), sorted(set(edges))).alias("bucket"), part.alias("part")))
    order = Window.partitionBy("bucket", "part").orderBy("k", "h", "size", "crc")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = same.select("*", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_in"))
    totals = same.groupBy("bucket", "part").agg(F.sum(F.col("n") * F.col("size")).alias("b"), F.sum("n").alias("r"))
    line = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select("bucket", "part", F.coalesce(F.sum("b").over(line), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(line), F.lit(0)).alias("r0"), F.sum("b").over(whole).alias("all_bytes"))
    placed = inside.join(totals, ["bucket", "part"]).select("k", "size", "crc", "n", "all_bytes", (F.col("b0") + F.col("bytes_in")).alias("b"), (F.col("r0") + F.col("rows_in")).alias("r"))
    copies = placed.select("k", "size", "crc", "all_bytes", "b", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    offset = F.col("b") + F.col("i") * F.col("size")
    # twice the middle of the row, so that all is in whole numbers
    shard = F.least(F.lit(n_shards - 1), F.expr(f"cast((2 * (b + i * size) + size) * {n_shards} div (2 * all_bytes) as int)"))
    out = keep(copies.select("k", "size", "crc", offset.alias("offset"), (F.col("r") + F.col("i")).alias("r"), shard.alias("shard")))
    starts = out.groupBy("shard").agg(F.min("r").alias("r0"))
    return out.join(F.broadcast(starts), "shard").select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("r") - F.col("r0")).alias("slot"), "offset")


def _below(value: F.Column, cuts: list) -> F.Column:
    """Number of cuts not above value, found in a tree of comparisons; -1 for null."""

    def tree(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(value.isNull(), -1).otherwise(tree(0, len(cuts)))


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns: law bytes over shards 0 to 7."""
    done = shard_by_bytes(docs)
    return done.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Streams that end in tables which take a batch once: late rows through the monotonic merge, and items against a ledger of keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import cut
from ..sources import versions
from ..sources.versions import Version

#: Buckets of a merged table; a batch rewrites those that it touches.
BUCKETS = 16


def merged_into(folder: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch: the rows of a batch are merged into the table below folder, however late they come.

    merge(existing, new) must give the same whatever the order of batches, as merge.monotonic() does. The table lies in
    buckets by key; only those that the batch touches are read and written, as new folders, and the next manifest names
    these and the untouched ones. The manifest holds the number of the batch, so a batch that comes again, after a
    failure or a replay, changes nothing; if another writer has committed meanwhile, the batch starts from its version.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.withColumn("_bucket", bucket)
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        while True:
            base = versions.latest(spark, folder)
            if number <= base.notes.get("batch", -1) or not touched:
                return
            old = Version(parts={str(b): base.parts[str(b)] for b in touched if str(b) in base.parts})
            both = merge(versions.read(spark, old, batch.schema), batch)
            data = f"{folder}/data/{number:09d}-{uuid.uuid4().hex}"
            both.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(data)
            parts = base.parts | {str(b): [f"{data}/_bucket={b}"] for b in touched}
            if versions.commit(spark, folder, Version(base.number + 1, parts, {"batch": number})):
                return

    return write


def merged_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What merged_into() has made of all batches so far."""
    return versions.read(spark, versions.latest(spark, folder), schema)


def drained_into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that has arrived, batch by batch, through a writer."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: A ledger of keys: when each was published, and when that was written down.
LEDGER = "key string, at bigint, set_at timestamp"
#: So many folders of a ledger are read as they are; more are written together into one.
FOLDERS = 16


def _stamps(marks: DataFrame, known: DataFrame, span: int) -> DataFrame:
    """key, at: which of the marks set their key's stamp, in order of time: those that come more than span after the stamp before.

    marks and known: key, at; known has the last stamp of a key. In rounds, one for each time that a key's marks of one
    batch go on for longer than span; each shuffles the marks that are left, and a key's first one is found before the shuffle.
    """
    later = F.col("last").isNull() | (F.col("at") > F.col("last") + span)
    left = cut(marks.distinct().join(known.select("key", F.col("at").alias("last")), "key", "left").where(later).select("key", "at"))
    stamps = None
    while True:
        first = left.groupBy("key").agg(F.min("at").alias("at"))
        stamps = first if stamps is None else stamps.unionByName(first)
        left = cut(left.join(first.select("key", F.col("at").alias("last")), "key").where(later).select("key", "at"))
        if left.isEmpty():
            return stamps


def asked_of(spark: SparkSession, folder: str, days: int = 14) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch: the ids of a batch that are new go to folder/result, what the batch publishes to the ledger below folder.

    Rows of a batch: id, at (microseconds), marks (whether the item counts as published), key. A key is seen from its
    stamp, its first mark, for days; a mark after that sets it anew. An item that does not mark only asks; it is new if
    none of its keys is seen. Inside a batch, marks count for items of the same time and later ones, those of batches
    before for late items too; an item without a time comes last, a mark without one or a missing key counts for nothing.

    The ledger is a table in versions that grows by the batch's stamps; every FOLDERS batches it is written together.
    Stamps that were written longer than days ago are not read any more. A batch is joined to it by key, so it costs one
    reading of the ledger and no work a key outside Spark's joins; batches should be large. The manifest holds the
    number of the last batch, whose result is written before, so a replay changes nothing.
    """
    span = days * 86_400_000_000

    def write(batch: DataFrame, number: int) -> None:
        if number <= versions.latest(spark, folder).notes.get("batch", -1):
            return
        # from here on in the caller's session; that of a stream plans without adaptive execution
        rows = f"{folder}/batches/{number:09d}-{uuid.uuid4().hex}"
        batch.write.parquet(rows)
        single = spark.read.schema(batch.schema).parquet(rows)
        asks = single.where("not coalesce(marks, false)")
        while True:
            base = versions.latest(spark, folder)
            if number <= base.notes.get("batch", -1):
                return
            kept = versions.read(spark, base, LEDGER).where(F.col("set_at") > F.current_timestamp() - F.expr(f"interval {days} days"))
            known = kept.groupBy("key").agg(F.max("at").alias("at"))
            stamps = cut(_stamps(single.where("marks and at is not null and key is not null").select("key", "at"), known, span))
            # what was known is seen by late items too
            seen = known.select("key", F.lit(None).cast("long").alias("since"), (F.col("at") + span).alias("until"))
            seen = seen.unionByName(stamps.select("key", F.col("at").alias("since"), (F.col("at") + span).alias("until")))
            found = asks.join(seen, "key").where("at is null or (at <= until and (since is null or at >= since))").select("id").distinct()
            asks.select("id").distinct().join(found, "id", "left_anti").write.mode("overwrite").parquet(f"{folder}/result/batch={number:09d}")
            parts, new = base.parts.get("seen", []), stamps.withColumn("set_at", F.current_timestamp())
            if len(parts) >= FOLDERS:
                new, parts = kept.unionByName(new).groupBy("key").agg(F.max(F.struct("at", "set_at")).alias("x")).select("key", "x.*"), []
            data = f"{folder}/data/{number:09d}-{uuid.uuid4().hex}"
            new.write.parquet(data)
            if versions.commit(spark, folder, Version(base.number + 1, {"seen": [*parts, data]}, {"batch": number})):
                return

    return write


def unseen(items: DataFrame, folder: str, days: int = 14) -> DataFrame:
    """The ids of all that has arrived and does not mark, of which no key was seen within days before.

    items: a stream of id (long), at (timestamp), marks (boolean), keys (array of strings), which asked_of() takes under
    each of its keys. A call takes what has arrived since the last one with the same folder.
    """
    single = items.select("id", F.unix_micros("at").alias("at"), "marks", F.explode("keys").alias("key"))
    drained_into(single, asked_of(items.sparkSession, folder, days), f"{folder}/checkpoint")
    return items.sparkSession.read.schema("id bigint").parquet(f"{folder}/result/*")

"""Queries that read the test tables as streams, in several files and out of order, and must equal their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.steps import cut, scratch
from ..operators import digest, merge
from ..sources import versions
from ..streaming import flows, upserts
from . import bindings as B
from . import catalog as C
from .registry import ORACLES, QUERIES, query

_KEYS = ["campaign_id", "channel", "recipient_key"]


def _merged(existing, new):
    return merge.monotonic(existing, new, _KEYS, ["score"], ["attempts"])


@query("late_rows_merged", ORACLES["monotonic_merge"])
def late_rows_merged(s, d):
    """§2.11: loads as files, the later load first, in micro-batches of one file; one batch comes twice."""
    old, new = C._halves(s, d)
    folder = scratch(s, "late")
    for name, rows in (("a", new), ("b", old)):  # files are taken by time of writing
        rows.repartition(2, "recipient_key").write.parquet(f"{folder}/in/{name}")
    like = s.read.parquet(f"{folder}/in/a")
    stream = s.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    write = upserts.merged_into(f"{folder}/table", _KEYS, _merged)
    upserts.drained_into(stream, write, f"{folder}/checkpoint")
    write(like, 1)  # a replay
    return upserts.merged_table(s, f"{folder}/table", like.schema).select(*C.merge.monotonic(old, new, _KEYS, ["score"], ["attempts"]).columns)


@query("stream_seen", ORACLES["seen_filter"])
def stream_seen(s, d):
    """§2.11, D03: documents as items under two keys: every third is published, then the others ask."""
    k = digest.keys(digest.articles(B.table(s, d, "documents"))).select(F.col("doc_id").alias("id"), F.lit("2024-01-01 14:00:00").cast("timestamp").alias("at"), (F.col("doc_id") % 3 == 0).alias("marks"), F.array("text_key", "title_key").alias("keys"))
    folder = scratch(s, "seen")
    for name, rows in (("a", k.where("marks")), ("b", k.where("not marks"))):
        rows.write.parquet(f"{folder}/in/{name}")
        stream = s.readStream.schema(k.schema).option("recursiveFileLookup", True).option("maxBytesPerTrigger", 256 << 20).parquet(f"{folder}/in")
        out = upserts.unseen(stream, f"{folder}/state")
    return out.withColumnRenamed("id", "doc_id")


for _grain, _length in (("week", "7 days"), ("month", None)):

    @query(f"stream_by_{_grain}", f"select date_trunc('{_grain}', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
    def stream_by_period(s, d, grain=_grain):
        """§2.11: activity by week or month, read as a stream."""
        stream = s.readStream.schema(B.table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
        return flows.drained(flows.activity_by(stream, grain), scratch(s, grain))


@query("seen_snapshots", ORACLES["seen_ledger"])
def seen_snapshots(s, d):
    """The ledger as versions: a first snapshot, a second by a writer that wins, and one by a writer that comes too late and is not read."""
    ledger = cut(QUERIES["seen_ledger"](s, d))
    folder = scratch(s, "snapshots")
    for number, name, rows in ((1, "first", ledger.limit(0)), (2, "winner", ledger), (2, "late", ledger.where("false"))):
        rows.write.parquet(f"{folder}/data/{name}")
        versions.commit(s, folder, versions.Version(number, {"seen": [f"{folder}/data/{name}"]}))
    return versions.read(s, versions.latest(s, folder), ledger.schema)

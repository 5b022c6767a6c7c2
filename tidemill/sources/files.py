"""Files as wholes: hashes of any size, headers without the rest, and which source a file comes from."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import header
from .delimited import HEAD, sniff

#: Bytes that are held of a file at once.
CHUNK = 8 << 20
#: Stores that a task opens by itself; files of others come through Spark, which holds a file of up to 2 GB whole.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs")
#: Points of a source for a file: its name, each strong, weak and excluded header; and least points, and lead, to be sure (fixed values).
NAME, STRONG, WEAK, EXCLUDED, LEAST, LEAD = 2, 3, 1, -5, 4, 2


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files below path that hold anything (Spark lists no empty ones); none is opened."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _local(uri: str):
    """The local file system and a path in it, for a path without a scheme or of the scheme file; else None."""
    from pyarrow import fs

    parsed = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parsed.path)) if parsed.scheme in ("", "file") else None


@contextmanager
def opened(uri: str):
    """A file of any store in OPENED, as a stream of bytes."""
    from pyarrow import fs

    store, path = _local(uri) or fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    with store.open_input_stream(path) as stream:
        yield stream


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt to tasks by path; their number is fixed here, because paths are short and what they name is not."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path, sha256 of each file, read chunk by chunk inside a task, whatever its size; files without bytes are left out."""
    files = listed(spark, path).select("path")
    own = F.lower(F.regexp_extract("path", "^([A-Za-z0-9+.-]*):", 1)).isin(*OPENED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with opened(p) as stream:
                    while data := stream.read(CHUNK):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "sha256"])

    here = _dealt(files.where(own)).mapInArrow(run, "path string, sha256 string")
    return here.unionByName(spark.read.format("binaryFile").load(path).where(~own).select("path", F.sha2("content", 256).alias("sha256")))


def new_files(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """Files whose content no loaded batch of the ledger (sha256, status) has; dimensions come first (S11), of equal files the first by path."""
    done = ledger.where("status = 'loaded'").select("sha256").distinct()
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    order = F.when(name.rlike("roster|employee"), 0).when(name.contains("campaign") & name.contains("registry"), 1).otherwise(2)
    fresh = content_hashes(spark, path).join(done, "sha256", "left_anti").withColumn("load_order", order)
    first = fresh.groupBy("sha256").agg(F.min(F.struct("load_order", "path")).alias("x")).select("x.path", "sha256", "x.load_order")
    return first.orderBy("load_order", "path")


def headers(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """Path, names of delimited files, from the first HEAD bytes of each that has any; a file without that row has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                with opened(p) as stream:
                    head = stream.read(HEAD)
                try:
                    head.decode("utf-8-sig")
                    encoding = "utf-8-sig"
                except UnicodeDecodeError as e:  # a character that the end of the head cuts is none that UTF-8 lacks
                    encoding = "utf-8-sig" if e.start > len(head) - 4 and e.reason == "unexpected end of data" else "cp1252"
                lines = head.decode(encoding, "replace").splitlines()
                found.append([n.strip() for n in next(csv.reader(lines[header_row - 1 : header_row], delimiter=sniff(head, encoding)), [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["path", "names"])

    return _dealt(listed(spark, path).select("path")).mapInArrow(run, "path string, names array<string>")


def detected(files: DataFrame, fingerprints: dict[str, dict]) -> DataFrame:
    """File, source, points: the source that a file's name and headers speak for most, or null if none is sure.

    files: file, names (array of headers). fingerprints: source to name (a pattern), strong, weak, exclude (headers) and
    least. Headers are joined, folded, to the fingerprints' headers, a small table of the configuration; a source is sure
    with its least points and a lead of LEAD over every other.
    """
    spark = files.sparkSession
    points = {"strong": STRONG, "weak": WEAK, "exclude": EXCLUDED}
    prints = spark.createDataFrame([(s, h, points[k]) for s, f in fingerprints.items() for k in points for h in f.get(k, ())] or [("", "", 0)], "source string, header string, points int")
    prints = prints.select("source", header(F.col("header")).alias("header"), "points").distinct()
    seen = files.select("file", F.explode(F.array_distinct(F.transform("names", header))).alias("header"))
    told = seen.join(F.broadcast(prints), "header").select("file", "source", "points")
    patterns = [F.when(F.col("file").rlike(f["name"]), F.lit(s)) for s, f in fingerprints.items() if f.get("name")]
    if patterns:
        told = told.unionByName(files.select("file", F.explode(F.array_compact(F.array(*patterns))).alias("source"), F.lit(NAME).alias("points")))
    # one entry for each source of the configuration
    ranked = told.groupBy("file", "source").agg(F.sum("points").alias("points")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("minus"), "source"))).alias("s"))
    least: Column = F.lit(LEAST)
    for s, f in fingerprints.items():
        least = F.when(F.col("s")[0]["source"] == s, F.lit(f.get("least", LEAST))).otherwise(least)
    top, second = -F.col("s")[0]["minus"], F.coalesce(-F.get("s", F.lit(1))["minus"], F.lit(0))
    second = F.greatest(second, F.when(F.size("s") < len(fingerprints), F.lit(0)).otherwise(second)) if len(fingerprints) > 1 else F.lit(-(10**6))
    sure = ranked.select("file", F.when((top >= least) & (top - second >= LEAD), F.col("s")[0]["source"]).alias("source"), top.alias("points"))
    return files.select("file").join(sure, "file", "left").select("file", "source", F.coalesce("points", F.lit(0).cast("long")).alias("points"))


def put_away(spark: SparkSession, folder: str, names: DataFrame) -> int:
    """Each file of names (file, target) below folder is renamed to its target below it; how many were.

    Renaming moves no data, and names are those of one sweep, taken one by one. A target that is there already, which
    ingest.archive_names() never gives, is an error, and what was renamed before stays so.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = 0
    for r in names.select("file", "target").toLocalIterator():
        source, target = (jvm.org.apache.hadoop.fs.Path(base, x) for x in (r["file"], r["target"]))
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise FileExistsError(f"{r['file']} was not moved to {r['target']}")
        done += 1
    return done

"""Tables in versions: files that never change, and a manifest for each version that says which of them count.

A version's manifest is created only if there is none, so of two writers that start from one version one wins; it ends
with a mark, so a reader takes no half of it. Files of writers that lost or died are in no manifest and are never read.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Last word of a manifest that was written to its end.
DONE = "complete"


@dataclass(frozen=True)
class Version:
    """number; parts: name of a part to the paths of its files' folders, the oldest first; notes: whatever the writer keeps with it."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def paths(self) -> list[str]:
        """All folders of the version."""
        return [p for name in sorted(self.parts) for p in self.parts[name]]


def _store(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
    return jvm, base, base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, folder: str) -> Version:
    """The newest version whose manifest is whole; version 0, without parts, if there is none."""
    jvm, base, fs = _store(spark, folder)
    if not fs.exists(base):
        return Version()
    names = sorted((s.getPath().getName() for s in fs.listStatus(base) if s.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(base, name))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if text.endswith(DONE):
            return Version(**json.loads(text[: -len(DONE)]))
    return Version()


def commit(spark: SparkSession, folder: str, new: Version) -> bool:
    """Make new the version after new.number - 1; false if another writer has made one with its number. The store's exclusive creation of a file decides."""
    jvm, base, fs = _store(spark, folder)
    fs.mkdirs(base)
    path = jvm.org.apache.hadoop.fs.Path(base, f"{new.number:012d}.json")
    try:
        out = fs.create(path, False)
    except Exception as e:  # py4j and Spark wrap the store's error
        if "AlreadyExists" in str(e) or "already exists" in str(e) or isinstance(e, PySparkException):
            return False
        raise
    out.write(bytearray((json.dumps(asdict(new)) + DONE).encode()))
    out.close()
    return True


def read(spark: SparkSession, version: Version, schema) -> DataFrame:
    """The rows of a version, all parts."""
    paths = version.paths()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete the data folders that none of the newest keep versions names, and the manifests before those; how many folders went.

    To be run when no writer is at work, whose files are in no manifest yet.
    """
    jvm, base, fs = _store(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(base)) if fs.exists(base) else []
    names = [n for n in names if n.endswith(".json")]
    held: set[str] = set()
    for name in names[-keep:]:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(base, name))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        if text.endswith(DONE):
            held |= {p.rstrip("/").split("/data/")[1].split("/")[0] for p in Version(**json.loads(text[: -len(DONE)])).paths()}
    for name in names[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, name), False)
    data = jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in held] if fs.exists(data) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)

"""What the operators share: reading tables, the shared folder, names that cannot clash."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule; words are maximal runs of other characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Most bytes of rows that go to or come from a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCHES_DEFAULT = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data set. Arrow batches are bounded by bytes as well as rows, unless the session says otherwise."""
    if spark.conf.get(_BATCHES) == _BATCHES_DEFAULT:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, one machine gets a temporary one; a cluster has none that all would see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more. It does so once the driver's garbage is collected, which between the rounds of a loop may be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_words(text) -> F.Column:
    """Number of words of a text column; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

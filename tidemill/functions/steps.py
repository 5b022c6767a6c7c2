"""Plans in steps, and the folder that steps share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each computed once for a row however often later steps use it.

    The columns pass through a generator, which the optimizer neither merges with what follows nor copies into
    filters above it. For expressions that are dear, such as regular expressions over whole texts.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of values, each of which is computed once however often body uses it. For expressions that a function of columns nests deeply."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 1)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where that is unset, one machine gets a temporary one, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: a lost executor costs no recomputation of what came before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it does so once the driver's garbage is collected, which between the rounds of a loop may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

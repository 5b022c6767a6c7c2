"""Delimited exports and spreadsheets read as text, with the shape cleaned but nothing inferred."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Delimiters that a sniff may find, cells that mean nothing, first cells of a totals row (fixed values).
DELIMITERS = ",;\t|"
NOTHING = ["", "-", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TOTALS = ["total", "totals", "grand total", "sum", "subtotal"]
#: Bytes, and lines, of a file's start that decide on the delimiter.
HEAD, LINES = 8192, 64


def sniff(head: bytes, encoding: str) -> str:
    """Delimiter from the first bytes, which may end inside a character."""
    try:
        return csv.Sniffer().sniff(head.decode(encoding, "ignore"), DELIMITERS).delimiter
    except csv.Error:
        return ","


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """Path, head (first lines, as bytes) and encoding of each file, from the whole of it: UTF-8 if valid, else cp1252, or Latin-1 if it has bytes that cp1252 lacks.

    Files are read by lines, which may be split among tasks: no character of UTF-8 holds a line's end.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("v"))
    lacks = F.decode("v", "ISO-8859-1").rlike("[\u0081\u008d\u008f\u0090\u009d]")
    whole = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("v").cast("string"))).alias("utf8"), F.bool_or(lacks).alias("odd"))
    first = lines.where("block = 0").withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("i"))).where(F.col("r") <= LINES)
    heads = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("h"))
    encoding = F.when(F.col("utf8"), "utf-8-sig").when(F.col("odd"), "latin-1").otherwise("cp1252")
    return whole.join(heads, "path").select("path", F.col("h.v").alias("head"), encoding.alias("encoding"))


def _layout(head: list[bytes], encoding: str, header_row: int) -> tuple[str, tuple[str, ...]]:
    """Delimiter and column names of a file, equal ones made different by their place."""
    sep = sniff(b"\n".join(head)[:HEAD], encoding)
    lines = [line.decode(encoding, "replace").rstrip("\r") for line in head]
    names = [n.strip() for n in next(csv.reader(lines[header_row - 1 : header_row], delimiter=sep), [])]
    return sep, tuple((n if names.index(n) == i else f"{n}_{i}") or f"Unnamed: {i}" for i, n in enumerate(names))


def read_delimited(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """All columns as text plus _file and _row: the nothing-words become null; empty rows and columns, each file's head and a last totals row go.

    Every file's own encoding, delimiter and header count; files of one layout are read together, and layouts are
    united by column name. What comes to the driver is the first lines of the files of one sweep.
    """
    layouts: dict[tuple, list[str]] = {}
    for f in encodings(spark, path).toLocalIterator():
        layouts.setdefault((f["encoding"], *_layout([bytes(v) for v in f["head"]], f["encoding"], header_row)), []).append(f["path"])
    high = {bytes([b]).decode("latin-1"): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
    parts = []
    for (encoding, sep, names), paths in sorted(layouts.items()):
        spark_name = "UTF-8" if encoding.startswith("utf-8") else "ISO-8859-1"
        schema = ", ".join(f"`{n}` string" for n in names)
        raw = spark.read.option("sep", sep).option("encoding", spark_name).option("multiLine", True).schema(schema).csv(sorted(paths))
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
        if encoding == "cp1252":  # Spark reads no such file; it differs from Latin-1 in these bytes only
            raw = raw.withColumns({n: F.translate(F.col(f"`{n}`"), "".join(high), "".join(high.values())) for n in names})
        # a file that may hold line ends in its cells is one partition, so its rows are numbered in order
        start = raw.groupBy(F.col("_file").alias("_f")).agg(F.min("_row").alias("_start"))
        raw = raw.join(start, F.col("_file") == F.col("_f")).withColumn("_row", F.col("_row") - F.col("_start")).drop("_f", "_start")
        parts.append(shaped(raw.where(F.col("_row") >= header_row)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shaped(df: DataFrame) -> DataFrame:
    """S04-S06 on rows of text with their file and order in _file and _row."""
    columns = [c for c in df.columns if c not in ("_file", "_row") and not c.startswith("Unnamed")]
    df = df.select("_file", "_row", *(F.when(F.trim(F.col(f"`{c}`")).isin(NOTHING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in columns))
    full = df.agg(*(F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in columns)).first()
    used = [c for c in columns if full[c]]
    if not used:
        return df.limit(0)
    df = df.select("_file", "_row", *(F.col(f"`{c}`") for c in used)).dropna("all", subset=used)
    last = df.groupBy(F.col("_file").alias("_f")).agg(F.max("_row").alias("_last"))
    total = F.coalesce(F.lower(F.trim(F.col(f"`{used[0]}`"))).isin(TOTALS), F.lit(False))
    return df.join(last, F.col("_file") == F.col("_f")).where(~((F.col("_row") == F.col("_last")) & total)).drop("_f", "_last")

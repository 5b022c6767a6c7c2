"""From parsed exports to rows that may be merged: campaigns, required keys, issues, and the ledger of loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce as C
from . import selection

EXAMPLES = 3


def severity_order(c: Column) -> Column:
    """errors, then warnings, then all others."""
    return F.when(c == "error", 0).when(c == "warning", 1).otherwise(2)


def canonical(c: Column, rules: list[str], country: str = "91") -> Column:
    """An identifier by rules in order: strip, lower, upper, e164, strip_domain; nan, none, null and blank are null."""
    t = F.trim(c.cast("string"))
    t = F.when(~F.lower(t).isin("", "nan", "none", "null"), t)
    steps: dict[str, Callable[[Column], Column]] = {
        "strip": F.trim,
        "lower": F.lower,
        "upper": F.upper,
        "e164": lambda x: F.coalesce(C.e164(x, country), x),
        "strip_domain": lambda x: F.substring_index(x, "@", 1),
    }
    for rule in rules:
        t = steps[rule](t) if rule in steps else t
    return F.nullif(t, F.lit(""))


def campaign_of(rows: DataFrame, pattern: str, file: str = "file", raw: str = "campaign_raw", manual: DataFrame | None = None) -> DataFrame:
    """Rows with campaign_text and campaign_by: the admin's choice for the file, else its column where any row has a value, else the file name.

    pattern has one group, the campaign in a file name. manual: file, campaign. Where nothing tells, campaign_by is
    'unresolved' and campaign_text null. What holds for a file comes from one aggregation, joined back.
    """
    whole = rows.groupBy(F.col(file).alias("_file")).agg(F.bool_or(F.col(raw).isNotNull()).alias("_column"))
    if manual is not None:
        m = manual.select(F.col("file").alias("_m"), F.col("campaign").alias("_manual"))
        whole = whole.join(m, F.col("_file").eqNullSafe(F.col("_m")), "left").drop("_m")
    else:
        whole = whole.withColumn("_manual", F.lit(None).cast("string"))
    named = F.nullif(F.regexp_extract(F.col(file), pattern, 1), F.lit(""))
    by = F.when(F.col("_manual").isNotNull(), "manual").when(F.col("_column"), "column").when(named.isNotNull(), "filename").otherwise("unresolved")
    text = F.when(F.col("_manual").isNotNull(), F.col("_manual")).when(F.col("_column"), F.trim(F.col(raw))).otherwise(named)
    joined = rows.join(whole, F.col(file).eqNullSafe(F.col("_file")))
    return joined.withColumns({"campaign_text": text, "campaign_by": by}).drop("_file", "_column", "_manual")


def campaign_ids(rows: DataFrame, campaigns: DataFrame, text: str = "campaign_text", order: str = "place") -> DataFrame:
    """Rows with campaign_id and registered: the campaign whose id or name reads like the text, else a slug of the text.

    Ids and names are compared in lower case, then as slugs; of campaigns that share a spelling the last by `order`
    counts. campaigns: campaign_id, campaign_name, and the order. Blank texts have no campaign.
    """
    spelled = F.array(*(F.struct(F.lit(i).alias("i"), f.alias("k")) for i, f in enumerate((F.lower(F.trim("campaign_id")), C.slug(F.col("campaign_id")), F.lower(F.trim("campaign_name")), F.when(F.trim("campaign_name") != "", C.slug(F.col("campaign_name")))))))
    keys = campaigns.select("campaign_id", order, F.explode(spelled).alias("s")).where(F.coalesce(F.col("s.k"), F.lit("")) != "")
    lookup = keys.groupBy(F.col("s.k").alias("_k")).agg(F.max_by("campaign_id", F.struct(order, "s.i")).alias("_id"))
    t = F.nullif(F.trim(text), F.lit(""))
    rows = rows.withColumns({"_low": F.lower(t), "_slug": F.when(t.isNotNull(), C.slug(t))})
    for c in ("_low", "_slug"):
        rows = rows.join(lookup.select(F.col("_k").alias(c), F.col("_id").alias(f"{c}_id")), c, "left")
    hit = F.coalesce("_low_id", "_slug_id")
    return rows.withColumns({"campaign_id": F.coalesce(hit, F.col("_slug")), "registered": hit.isNotNull()}).drop("_low", "_slug", "_low_id", "_slug_id")


def usable(rows: DataFrame, keys: list[str]) -> DataFrame:
    """the rows that have all keys."""
    return rows.where(" and ".join(f"{k} is not null" for k in keys))


def row_counts(rows: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """rows_read, rows_rejected and rows_loaded of each file."""
    good = F.expr(" and ".join(f"{k} is not null" for k in keys))
    counted = rows.groupBy(file).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(~good).alias("rows_rejected"))
    return counted.withColumn("rows_loaded", F.col("rows_read") - F.col("rows_rejected"))


def first_examples(values: DataFrame, by: list[str], value: str, order: str, n: int = EXAMPLES) -> DataFrame:
    """By, occurrence_count, example_values: the first n distinct values in order of appearance, joined by comma and space.

    Equal values are one with a count before they are ranked, and only n of a group are collected.
    """
    each = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"))
    total = each.groupBy(*by).agg(F.sum("_n").alias("occurrence_count"))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_at", value))).where(F.col("_r") <= n)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))).alias("e"))
    return total.join(listed, by).select(*by, "occurrence_count", F.array_join("e.v", ", ").alias("example_values"))


def coercion_issues(rows: DataFrame, columns: dict[str, str], file: str = "file", order: str = "row") -> DataFrame:
    """For each file and column with values that its type cannot read: severity, code, column_name, occurrence_count, example_values."""
    entries = F.array(*(F.struct(F.lit(c).alias("column_name"), F.trim(c).alias("v"), C.COERCIONS[t](F.col(c)).isNull().alias("bad")) for c, t in columns.items()))
    long = rows.select(file, order, F.inline(entries)).where("bad and v is not null and v != ''")
    found = first_examples(long, [file, "column_name"], "v", order)
    return found.select(file, F.lit("warning").alias("severity"), F.lit("COERCION_FAILED").alias("code"), "column_name", "occurrence_count", "example_values")


def header_issues(headers: DataFrame, fields: dict[str, list[str]], required: list[str], file: str = "file") -> DataFrame:
    """Issues from headers alone; headers: file, names (array of normalised headers). fields: aliases of each field.

    A required field that no header names is an error, an optional one an info; headers that no field names are one info.
    """
    entries = F.array(*(F.struct(F.lit("error" if f in required else "info").alias("severity"), F.lit("MISSING_REQUIRED_COLUMN" if f in required else "OPTIONAL_COLUMN_MISSING").alias("code"), F.lit(f).alias("column_name"), F.arrays_overlap("names", F.array(*map(F.lit, a))).alias("there")) for f, a in fields.items()))
    missing = headers.select(file, F.inline(entries)).where("not there").select(file, "severity", "code", "column_name", F.lit(1).cast("long").alias("occurrence_count"), F.lit("").alias("example_values"))
    known = F.array(*(F.lit(a) for names in fields.values() for a in names))
    over = headers.select(file, F.array_except("names", known).alias("x")).where("size(x) > 0")
    ignored = over.select(file, F.lit("info").alias("severity"), F.lit("UNMAPPED_COLUMNS").alias("code"), F.lit(None).cast("string").alias("column_name"), F.size("x").cast("long").alias("occurrence_count"), F.array_join(F.slice("x", 1, 5), ", ").alias("example_values"))
    return missing.unionByName(ignored)


def campaign_issues(resolved: DataFrame, file: str = "file") -> DataFrame:
    """What campaign_of() and campaign_ids() leave to be said of each file."""
    info = [("filename", "info", "CAMPAIGN_FROM_FILENAME"), ("unresolved", "error", "CAMPAIGN_UNRESOLVED")]
    whole = resolved.groupBy(file).agg(F.min("campaign_by").alias("by"), F.min("campaign_text").alias("t"))
    told = [whole.where(F.col("by") == by).select(file, F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(1).cast("long").alias("occurrence_count"), F.coalesce("t", F.lit("")).alias("example_values")) for by, s, c in info]
    unknown = resolved.where("not registered and campaign_id is not null").select(file, F.trim("campaign_text").alias("v")).distinct()
    ranked = unknown.withColumn("r", F.row_number().over(Window.partitionBy(file).orderBy("v")))
    counts = unknown.groupBy(file).agg(F.count(F.lit(1)).alias("occurrence_count"))
    named = ranked.where(F.col("r") <= EXAMPLES).groupBy(file).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("example_values"))
    stubs = counts.join(named, file).select(file, F.lit("warning").alias("severity"), F.lit("CAMPAIGN_NOT_IN_REGISTRY").alias("code"), "occurrence_count", "example_values")
    return told[0].unionByName(told[1]).unionByName(stubs)


def stage_issues(rows: DataFrame, stages: list[str], file: str = "file") -> DataFrame:
    """A warning for each stage of which a file has no value at all."""
    whole = rows.groupBy(file).agg(*(F.bool_or(F.col(s).isNotNull()).alias(s) for s in stages))
    entries = F.array(*(F.struct(F.lit(s).alias("column_name"), F.col(s).alias("there")) for s in stages))
    return whole.select(file, F.inline(entries)).where("not there").select(file, F.lit("warning").alias("severity"), F.lit("STAGE_NOT_MEASURED").alias("code"), "column_name")


def verdicts(counts: DataFrame, issues: DataFrame, loaded: DataFrame, file: str = "file") -> DataFrame:
    """The status of each load: duplicate if its sha is loaded already, rejected on an error or without usable rows, else loaded.

    counts: file, sha, rows_read, rows_rejected, rows_loaded; loaded: sha of standing loads.
    """
    errors = issues.where("severity = 'error'").select(F.col(file).alias("_f")).distinct().withColumn("_bad", F.lit(True))
    known = loaded.select(F.col("sha").alias("_s")).distinct().withColumn("_known", F.lit(True))
    j = counts.join(errors, F.col(file).eqNullSafe(F.col("_f")), "left").join(known, F.col("sha") == F.col("_s"), "left")
    status = F.when(F.col("_known"), "duplicate").when(F.col("_bad") | (F.col("rows_loaded") == 0), "rejected").otherwise("loaded")
    return j.withColumn("status", status).withColumn("rows_loaded", F.when(status == "loaded", F.col("rows_loaded")).otherwise(F.lit(0))).drop("_f", "_bad", "_s", "_known")


def numbered(loads: DataFrame, ledger: DataFrame, order: str = "file") -> DataFrame:
    """Loads with batch_id, going on from the ledger's highest; one row for each attempt, duplicates and rejects included.

    order must tell loads apart; numbers follow it by the totals of its ranges. The report is kept as JSON (X39).
    """
    last = ledger.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("_last"))
    placed = selection.numbered(loads, [order], "_n")
    report = F.to_json(F.struct(*(c for c in loads.columns)))
    return placed.crossJoin(F.broadcast(last)).withColumns({"batch_id": F.col("_last") + F.col("_n"), "superseded_by": F.lit(None).cast("long"), "report": report}).drop("_n", "_last")


def append(loads: DataFrame, issues: DataFrame, folder: str, file: str = "file") -> None:
    """One ledger row for each load and one row for each issue of it, appended as Parquet below folder."""
    ids = loads.select(F.col(file).alias("_f"), "batch_id")
    loads.write.mode("append").parquet(f"{folder}/load_batch")
    issues.join(ids, F.col(file).eqNullSafe(F.col("_f"))).drop("_f").write.mode("append").parquet(f"{folder}/load_issue")


def standing(ledger: DataFrame) -> DataFrame:
    """Loads that count for duplicates: loaded and not superseded."""
    return ledger.where("status = 'loaded' and superseded_by is null")


def superseded(ledger: DataFrame, again: DataFrame) -> DataFrame:
    """The ledger with the loads of the files to be loaded again (column sha) marked -1, so that they no longer count."""
    mark = again.select(F.col("sha").alias("_s")).distinct().withColumn("_again", F.lit(True))
    j = ledger.join(mark, F.col("sha") == F.col("_s"), "left")
    return j.withColumn("superseded_by", F.when(F.col("_again") & F.col("superseded_by").isNull(), F.lit(-1).cast("long")).otherwise(F.col("superseded_by"))).drop("_s", "_again")


def overrides(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """Sha, source, campaign: what the admin said of a file, the last answer by `at` in place of an earlier one."""
    both = stored.select("sha", "source", "campaign", "at").unionByName(answers.select("sha", "source", "campaign", "at"))
    return both.groupBy("sha").agg(F.max_by(F.struct("source", "campaign"), "at").alias("x"), F.max("at").alias("at")).select("sha", "x.source", "x.campaign", "at")


def archive_names(files: DataFrame, taken: DataFrame, month: str) -> DataFrame:
    """File, target: the folder (the month, or rejected) and name under which a processed file is put away.

    A name that is taken gets __1, __2 and so on before its ending; files of one name in a sweep follow each other.
    taken: target. Numbers go on from the highest taken one.
    """
    folder = F.when(F.col("status") == "rejected", F.lit("rejected")).otherwise(F.concat(F.lit("archive/"), F.lit(month)))
    dot = r"^(.*?)(\.[^.]*)?$"
    f = files.select("file", folder.alias("folder"), F.regexp_extract("file", dot, 1).alias("stem"), F.regexp_extract("file", dot, 2).alias("end"), "at")
    t = taken.select(F.regexp_extract("target", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("target", r"([^/]*)$", 1).alias("name"))
    t = t.select("folder", F.regexp_extract("name", r"^(.*?)(?:__(\d+))?(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract("name", r"(\.[^.]*)?$", 1).alias("end"), F.coalesce(F.regexp_extract("name", r"__(\d+)(?:\.[^.]*)?$", 1).try_cast("int"), F.lit(0)).alias("n"))
    top = t.groupBy("folder", "stem", "end").agg((F.max("n") + 1).alias("next"))
    j = f.join(top, ["folder", "stem", "end"], "left")
    n = F.coalesce("next", F.lit(0)) + F.row_number().over(Window.partitionBy("folder", "stem", "end").orderBy("at", "file")) - 1
    return j.select("file", F.concat("folder", F.lit("/"), "stem", F.when(n > 0, F.concat(F.lit("__"), n.cast("string"))).otherwise(F.lit("")), "end").alias("target"))


def mapped_headers(candidates: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """File, spec, names: of the header rows that the read specs give, the first in order that has any name.

    candidates: file, place (of the spec in order, the plain one first), spec, names.
    """
    known = F.filter("names", lambda n: F.coalesce(n, F.lit("")) != "")
    good = candidates.where(F.size(known) > 0)
    hits = F.size(F.array_intersect(known, F.array(*(F.lit(a) for x in fields.values() for a in x))))
    return good.groupBy("file").agg(F.min_by(F.struct("spec", known.alias("names"), hits.alias("hits")), "place").alias("x")).select("file", "x.*")

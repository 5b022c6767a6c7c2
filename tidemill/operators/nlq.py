"""Answers to simple business questions over the wide sales table, with chart-ready shapes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the sales table that a question may name: numbers add up, the others group; the date is what "over time" means.
COLUMNS = {"campaign_name": "string", "campaign_type": "string", "region": "string", "channel": "string", "month": "date", "spend": "decimal", "leads": "long", "conversions": "long", "revenue": "decimal"}
#: Ratios of sums, by the words that ask for them.
RATIOS = {"roas": ("revenue", "spend"), "return on ad spend": ("revenue", "spend"), "cost per lead": ("spend", "leads"), "conversion rate": ("conversions", "leads")}
#: Metrics by priority.
PRIORITY = ["revenue", "conversions", "leads", "spend"]
_NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def _named(question: str, columns: list[str]) -> list[str]:
    """Columns whose words, or whose first word, a question has, singular or plural, in the order of the question."""
    at = {}
    for c in columns:
        words = c.split("_")
        for form in dict.fromkeys((" ".join(words), words[0] if len(words) > 1 and sum(x.startswith(words[0] + "_") for x in columns) == 1 else " ".join(words), words[0] if words[-1] == "name" else " ".join(words))):
            if m := re.search(rf"\b{form.rstrip('s')}(?:s|es)?\b", question):
                at.setdefault(c, m.start())
    return sorted(at, key=at.get)


def to_sql(question: str, columns: dict[str, str] | None = None, table: str = "sales") -> str:
    """The query that a question asks for, read from the table's columns: what is measured, by what, in which order, how many.

    A ratio of RATIOS or one or more numeric columns are measured; the first column named that is not a number
    groups them, or the date where the question is about time; top, best and most sort downwards, worst and least
    upwards, and limit to the number given, or to five. Questions without anything to measure are refused.
    """
    columns = columns or COLUMNS
    q = re.sub(r"[^a-z0-9 ]+", " ", question.lower())
    groups = [c for c, t in columns.items() if t in ("string", "date", "timestamp")]
    ratio = next((r for r in RATIOS if re.search(rf"\b{r}\b", q)), None)
    metrics = [ratio.replace(" ", "_")] if ratio else _named(q, [c for c in columns if c not in groups])
    if not metrics:
        raise ValueError(f"no query for: {question}")
    shown = [f"sum({RATIOS[ratio][0]}) / nullif(sum({RATIOS[ratio][1]}), 0) as {metrics[0]}"] if ratio else [f"sum({m}) as {m}" for m in metrics]
    by = _named(q, groups)
    times = [c for c in groups if columns[c] != "string"]
    if times and re.search(r"\b(trend|trends|over time|monthly|month|months)\b", q):
        by = times[:1]
    if not by and ratio:
        by = groups[:1]
    if not by:
        return f"select {', '.join(shown)} from {table}"
    down, up = re.search(r"\b(top|best|highest|most|largest)\b", q), re.search(r"\b(bottom|worst|lowest|least|smallest)\b", q)
    n = re.search(rf"\b(\d+|{'|'.join(_NUMBERS)})\b", q)
    order = by[0] if by[0] in times else f"{metrics[0]}{'' if up else ' desc'}, {by[0]}"
    limit = f" limit {_NUMBERS.get(n[1], None) or int(n[1]) if n else 5}" if down or up else ""
    return f"select {by[0]}, {', '.join(shown)} from {table} group by {by[0]} order by {order}{limit}"


def guarded(sql: str) -> str:
    """The statement, if it is a single SELECT or WITH."""
    bare = re.sub(r"'[^']*'", "''", sql).strip().rstrip(";")
    if ";" in bare or not re.match(r"(?is)(select|with)\b", bare) or re.search(r"(?i)\b(insert|update|delete|drop|create|alter|merge|truncate)\b", bare):
        raise ValueError("only a single SELECT is allowed")
    return sql


def answer(spark: SparkSession, sales: DataFrame, question: str) -> DataFrame:
    """The rows that answer a question."""
    sales.createOrReplaceTempView("sales")
    return spark.sql(guarded(to_sql(question, {c: t.split("(")[0].replace("bigint", "long") for c, t in sales.dtypes})))


def leads_by_region(s: DataFrame) -> DataFrame:
    """A31."""
    return s.groupBy("region").agg(F.sum("leads").alias("leads"))


def spend_vs_conversions(s: DataFrame) -> DataFrame:
    """A31."""
    return s.groupBy("channel").agg(F.round(F.sum("spend").cast("double"), 2).alias("spend"), F.sum("conversions").alias("conversions"))


def revenue_trend(s: DataFrame) -> DataFrame:
    """A31."""
    return s.groupBy("month").agg(F.round(F.sum("revenue").cast("double"), 2).alias("revenue"))


def roas_top(s: DataFrame, n: int = 5) -> DataFrame:
    """Ratio of sums, the highest n."""
    return s.groupBy("campaign_name").agg(F.round(F.try_divide(F.sum("revenue").cast("double"), F.sum("spend").cast("double")), 4).alias("roas")).orderBy(F.desc("roas"), "campaign_name").limit(n)


def revenue_share(s: DataFrame) -> DataFrame:
    """Share of all revenue, and against the mean of the other regions."""
    t = s.groupBy("region").agg(F.sum("revenue").cast("double").alias("revenue"))
    w = Window.partitionBy()
    total, n = F.sum("revenue").over(w), F.count(F.lit(1)).over(w)
    return t.select("region", F.round("revenue", 2).alias("revenue"), F.round(F.col("revenue") / total, 6).alias("share"), F.round(F.col("revenue") / ((total - F.col("revenue")) / (n - 1)) - 1, 6).alias("vs_rest"))


def month_change(s: DataFrame) -> DataFrame:
    """Change from the month before."""
    t = s.groupBy("month").agg(F.sum("revenue").cast("double").alias("revenue"))
    before = F.lag("revenue").over(Window.orderBy("month"))
    return t.select("month", F.round("revenue", 2).alias("revenue"), F.round(F.try_divide(F.col("revenue") - before, before), 6).alias("change"))


def peak_and_low(s: DataFrame) -> DataFrame:
    """Highest and lowest month."""
    t = s.groupBy("month").agg(F.sum("revenue").cast("double").alias("revenue"))
    return t.agg(F.max_by("month", "revenue").alias("peak_month"), F.min_by("month", "revenue").alias("low_month"), F.round(F.max("revenue"), 2).alias("peak"), F.round(F.min("revenue"), 2).alias("low"))


def comparability(s: DataFrame) -> DataFrame:
    """Whether campaigns differ too much in audience, objective or channels to be compared."""
    c = s.groupBy("campaign_name").agg(F.sum("leads").alias("audience"), F.count_distinct("campaign_type").alias("objectives"), F.count_distinct("channel").alias("channels"))
    return c.agg((F.max("audience") >= 4 * F.min("audience")).alias("audience_differs"), (F.max("objectives") > 1).alias("several_objectives"), (F.max("channels") != F.min("channels")).alias("channels_differ"))


def chart(df: DataFrame) -> DataFrame:
    """A chart of a result: time gives a line, two parts or more a bar; labels and data in order; a link with quotes and spaces escaped."""
    kinds = dict(df.dtypes)
    label = next(c for c, k in kinds.items() if k in ("date", "timestamp", "string"))
    metric = next((m for m in PRIORITY if m in kinds), [c for c in kinds if c != label][0])
    kind = "line" if kinds[label] in ("date", "timestamp") else "bar"
    pairs = F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("l"), F.col(metric).cast("double").alias("v"))))
    a = df.agg(pairs.alias("p")).select(F.lit(f"{metric} by {label}").alias("title"), F.lit(kind).alias("type"), F.array_join(F.transform("p", lambda x: x["l"]), "|").alias("labels"), F.array_join(F.transform("p", lambda x: x["v"].cast("string")), "|").alias("data"))
    return a.withColumn("markdown", F.concat(F.lit("![chart]("), F.replace(F.replace(F.concat(F.lit("https://charts.invalid/?t="), F.col("title")), F.lit("'"), F.lit("%27")), F.lit(" "), F.lit("%20")), F.lit(")")))


def needs_chart(question: F.Column) -> F.Column:
    """Whether a question asks for something that can be drawn."""
    return F.when(F.lower(question).rlike(r"\b(trend|by|per|compare|top|share|months?|monthly)\b"), "YES").otherwise("NO")

"""Values, files, workbooks and answers as sources give them, told by hand."""

import hashlib
import html
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.functions import coerce as C
from tidemill.functions import text as X
from tidemill.operators import questions
from tidemill.plans.source_catalog import _xlsx
from tidemill.sources import asked, files, workbooks


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_flags(spark):
    assert values(spark, C.to_bool, "on", "ok", "x", "opened", "passed", "1.0", "Delivered", "Complete") == [True] * 8
    assert values(spark, C.to_bool, "failed", "off", "In Progress", "not started", "0.0", "none", "bounced") == [False] * 7
    assert values(spark, C.to_bool, "done", "-", "✗", "perhaps", "", None) == [None] * 6
    own = lambda c: C.to_bool(c, ("not registered",), ("registered",))
    assert values(spark, own, "Registered", "Not registered", "yes") == [False, True, True]


def test_durations(spark):
    assert values(spark, C.to_minutes, "about 65", "1h30", "1:75", "2 hrs 5 mins 30 secs", "T5M", "5m 2h", "P", "-", None) == [65, 130, 175, 125.5, 5, 52, None, None, None]


def test_dates(spark):
    shown = lambda c, *x: [str(v) for v in values(spark, c, *x)]
    assert shown(C.to_datetime, "3/4/2026", "03-04-2026", "14 Jan 2026", "2026-01-14 10:00:00", "Jan 14, 2026", "01/14/2026", "3/4/68", "3/4/69") == [
        *("2026-04-03 00:00:00", "2026-04-03 00:00:00", "2026-01-14 00:00:00", "2026-01-14 10:00:00", "2026-01-14 00:00:00", "2026-01-14 00:00:00", "2068-04-03 00:00:00", "1969-04-03 00:00:00"),
    ]
    assert shown(C.to_datetime, "45000", "2026-13-14", "2026-02-30", "14 Foo 2026", "1.5", "", None, "14 Jan 2026 25:00", "14 Jan 2026 13:00 pm") == ["None"] * 9
    assert [str(r[0]) for r in spark.createDataFrame([(45000.0,), (45000.75,), (12.0,), (None,)], "n double").select(C.serial_date(F.col("n"))).collect()] == ["2023-03-15 00:00:00", "2023-03-15 18:00:00", "None", "None"]


def test_references_are_those_of_html(spark):
    rng = random.Random(8)
    parts = ["&", "&amp;", "&amp", "&lt;", "&notit;", "&notin;", "&#8217;", "&#x41", "&#0;", "&#150;", "&#129;", "&#xD800;", "&#1114112;", "&bogus;", ";", "x", " ", "&NotEqualTilde;", "&copy2", "\x01", "&&", "&eacutex"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    got = values(spark, X.unescape, *texts)
    assert got == [html.unescape(t) for t in texts]


def test_strip_html(spark):
    assert values(spark, X.strip_html, "&lt;p&gt;x&lt;/p&gt;", "a<td>b</td><td>c</td>", "it&#8217;s", "<script type=x>1<2</script>a", None) == ["x", "a b c", "it’s", "a", None]


def test_postings(spark):
    assert [tuple(v) for v in values(spark, X.experience, "15 years", "up to 5 years", "over 9 years", "3+ yrs", "12-8 years")] == [(None, None), (None, None), (9, None), (3, None), (8, 12)]
    now = lambda c: X.posted_date(c, F.lit("2026-09-01 12:00:00"))
    assert [str(v) for v in values(spark, now, "24 Aug 2026", "just posted", "5 hours ago", "12:30", None)] == ["2026-08-24 00:00:00", "2026-09-01 12:00:00", "2026-09-01 07:00:00", "None", "None"]


def test_hashes_and_headers_of_files(spark, tmp_path):
    contents = {"a b.csv": b"x;y\n1;2\n", "e.csv": b"", "big.csv": b"h\xe9\tz\n" + b"01234\t6789\n" * 1_000_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.sha256 for r in files.content_hashes(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items() if d}
    heads = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.names for r in files.headers(spark, str(tmp_path)).collect()}
    assert heads == {"a b.csv": ["x", "y"], "big.csv": ["hé", "z"]}


def test_a_tie_detects_nothing(spark):
    prints = {"a": {"strong": ["One", "Two"]}, "b": {"strong": ["One", "Two"]}, "c": {"strong": ["Three"], "least": 3}}
    told = files.detected(spark.createDataFrame([("x", ["one", "TWO"]), ("y", ["three"])], "file string, names array<string>"), prints)
    assert {r.file: r.source for r in told.collect()} == {"x": None, "y": "c"}


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_xlsx([["Title"], ["Id", "When", "Note"], [1, ("d", 45000), "x"], [], [2, ("d", 45000.5), "n/a"], ["Total", 2]]))
    (tmp_path / "b.xlsx").write_bytes(_xlsx([["Title"], ["Note", "Id"], ["y", 3]]))
    rows = workbooks.read_workbooks(spark, f"{tmp_path}/*.xlsx", "Data", 2).collect()
    assert sorted((r.Id, r.When, r.Note) for r in rows if r.Id) == [("1", "2023-03-15", "x"), ("2", "2023-03-15 12:00:00", None), ("3", None, "y")]
    assert workbooks.read_workbooks(spark, f"{tmp_path}/*.xlsx", "Nowhere").count() == 0
    assert workbooks.cells(spark, f"{tmp_path}/*.xlsx", "Notes").count() == 0


def test_answers_as_a_data_source(spark, tmp_path):
    rss = "<rss><channel><item><title>T</title><link>http://l</link></item></channel></rss>"
    rows = [("1", "rss", rss), ("2", "rss", "<rss"), ("3", "rss", None), ("4", "adzuna", '{"results": [{"title": "J", "redirect_url": "u", "location": {"display_name": "Goa"}}]}'), ("5", "jooble", "{}"), ("6", None, ""), (None, "lever", '[{"text": "L", "createdAt": 5}]'), ("8", "greenhouse", "[]")]
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("source_id", "kind", "body"))}), f"{tmp_path}/a.parquet", row_group_size=3)
    asked.install(spark)
    got = spark.read.format("feeds").option("path", str(tmp_path)).option("keys", "adzuna").load().collect()
    assert sorted((str(r.source_id), r.state, r.title, r.location) for r in got) == [
        *[("1", "ok", "T", None), ("2", "error", None, None), ("3", "error", None, None), ("4", "ok", "J", "Goa"), ("5", "skipped", None, None), ("6", "error", None, None), ("8", "error", None, None), ("None", "ok", "L", None)],
    ]


def test_questions_are_bound_to_values(spark):
    sales = spark.createDataFrame([("EAST", "2024-01-01", 1, 2.0), ("WEST COAST", "2024-02-01", 3, 4.0), ("WEST", "2024-03-01", 5, 6.0)], "region string, month string, leads long, revenue double").withColumn("month", F.to_date("month"))
    q = questions.understood(sales, "Top 2 months by revenue on the west coast, not in East, since February 2024")
    assert q.wanted == {"region": ("WEST COAST",)} and q.unwanted == {"region": ("EAST",)} and q.since == "2024-02-01" and q.until is None and q.limit == 2 and q.rising is False
    assert [r.leads for r in questions.ask(sales, "leads in west").collect()] == [5]
    assert questions.understood(sales, "leads in December 2023").until == "2024-01-01"
    with pytest.raises(ValueError):
        questions.ask(sales, "what is love")

"""The engine's own operators: every registered query against its oracle, and the edges of the functions."""

import glob
import hashlib
import hmac
import os
import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.functions import coerce as C
from tidemill.functions import text as X
from tidemill.operators import coverage, digest, funnel, merge, nlq, routing
from tidemill.plans import brief_catalog, catalog
from tidemill.sources import delimited, feeds, files
from tidemill.streaming import flows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(rows):
    one = lambda v: "null" if v is None else f"{float(v):.6g}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert columns == sorted(rel.columns)
    got = shown(df.select(*columns).collect())
    want = shown(duck.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_coercions(spark):
    assert values(spark, C.to_minutes, "01:05:00", "1:05", "PT1H5M", "65 min", "1 h 5 m", "65", "", None, "ages") == [65, 65, 65, 65, 65, 65, None, None, None]
    assert values(spark, C.to_percent, "85%", "85", "0.85", "1", "1%", None) == pytest.approx([0.85, 0.85, 0.85, 1.0, 0.01, None])
    assert values(spark, C.to_bool, " YES", "no", "✓", "maybe", "", None) == [True, False, True, None, None, None]
    assert [str(v) for v in values(spark, C.to_date, "03/04/2026", "2026-01-14", "45000", "later", None)] == ["2026-04-03", "2026-01-14", "None", "None", "None"]
    assert [str(v) for v in values(spark, lambda c: C.to_date(c, False), "03/04/2026")] == ["2026-03-04"]
    assert values(spark, C.e164, "07000000001", "+91 7000000001", "00917000000001", "7000000001.0", "", None) == ["+917000000001"] * 4 + [None, None]
    assert values(spark, C.slug, " A & B ", "--", None) == ["a-b", "unknown", "unknown"]
    assert values(spark, lambda c: C.pseudonym(c, b"key"), "é", None) == [hmac.new(b"key", "é".encode(), hashlib.sha256).hexdigest()[:32], None]


def test_texts(spark):
    assert values(spark, X.strip_html, "<p>a&amp;b</p><script>x</script>c", None) == ["a&b c", None]
    assert values(spark, X.canonical_url, "HTTP://www.X.com:80/a/?utm_source=q&b=1#top", "not a url", None) == ["http://x.com/a?b=1", "not a url", None]
    assert values(spark, lambda c: X.truncate(c, 10), "short", "one two three four", "abcdefghijklmnop") == ["short", "one two…", "abcdefghij…"]
    assert [tuple(v) for v in values(spark, X.experience, "12-8 years", "15+ yrs", "none")] == [(8, 12), (15, None), (None, None)]
    assert values(spark, X.location, "3 Locations", "Pune; Delhi;Goa", "Here") == ["", "Pune (+2 more)", "Here"]
    assert [str(v) for v in values(spark, lambda c: X.relative_date(c, F.lit("2026-03-31")).cast("date"), "Posted 3 days ago", "yesterday", "2 weeks ago", "1 month ago", "?")] == ["2026-03-28", "2026-03-30", "2026-03-17", "2026-03-01", "None"]


def test_merge_never_regresses(spark):
    schema = "k int, targeted boolean, delivered boolean, opened boolean, engaged boolean, completed boolean, targeted_at timestamp, opened_at timestamp, engaged_at timestamp, completed_at timestamp, score double, dept string, batch_id int"
    old = spark.createDataFrame([(1, True, None, True, None, None, None, None, None, None, 5.0, "a", 1)], schema)
    new = spark.createDataFrame([(1, True, False, None, False, None, None, None, None, None, 3.0, None, 2)], schema)
    for a, b in ((old, new), (new, old), (old, new.union(new))):
        r = merge.monotonic(a, b, ["k"], ["score"], ["dept"]).first()
        assert (r.delivered, r.opened, r.engaged, r.completed, r.score, r.dept, r.batch_id) == (False, True, False, None, 5.0, "a", 2)


def test_suppression_hides_two(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 9, 2), ("c", 7, 3), ("d", 30, 4)], "segment string, headcount int, opened int")
    got = {r.segment: r.suppressed for r in coverage.suppressed(df, 5).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}
    assert not any(r.suppressed for r in coverage.suppressed(df.where("segment != 'a'"), 5).collect())


def test_unmeasured_is_not_zero(spark):
    df = spark.createDataFrame([("c", "email", "opened", "persons", "max", "measured", 5), ("c", "email", "opened", "persons", "max", "measured", 7), ("c", "email", "completed", "persons", "sum", "not_measured", None)], "campaign_id string, channel string, stage string, unit string, aggregation string, support_status string, value int")
    r = funnel.channel_wide(funnel.stage_totals(df)).first()
    assert r.opened == 7 and r.completed is None and r.delivered is None


def fold_caps(rows, a, b, total):
    kept = []
    for r in rows:
        if len(kept) < total and sum(k[1] == r[1] for k in kept) < a and sum(k[2] == r[2] for k in kept) < b:
            kept.append(r)
    return {k[0] for k in kept}


def test_caps_equal_the_plain_fold(spark):
    rng = random.Random(6)
    for _ in range(4):
        rows = [(i, rng.choice("abcde"), rng.choice("xyz"), float(100 - i)) for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, source_id string, section_id string, score double").withColumn("published", F.lit(None).cast("timestamp"))
        got = {r.doc_id for r in digest.capped(df, 2, 3, 7).collect()}
        assert got == fold_caps(rows, 2, 3, 7)


def test_greedy_equals_the_plain_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = routing.routed(digest.articles(docs), brief_catalog.BRIEF).cache()
    got = {(r.doc_id, r.duplicates) for r in digest.greedy(items).collect()}
    k = digest.keys(digest.ranked(items)).select("doc_id", "place", "text_key", "title_key", X.stems(F.col("title")).alias("s"), X.periods(F.col("title")).alias("p")).orderBy("place").collect()
    kept = []

    def alike(r, x):
        either = set(r.s) | set(x.s)
        return either and len(set(r.s) & set(x.s)) >= 0.62 * len(either) - 1e-12 and not (r.p and x.p and not set(r.p) & set(x.p))

    for r in k:
        found = [x for x in kept if x[0].text_key == r.text_key] or [x for x in kept if x[0].title_key == r.title_key] or [x for x in kept if alike(r, x[0])]
        if found:
            found[0][1] += 1
        else:
            kept.append([r, 1])
    assert got == {(r.doc_id, n) for r, n in kept}


def test_questions(spark):
    assert "group by region" in nlq.to_sql("Leads by region?")
    with pytest.raises(ValueError):
        nlq.to_sql("what is love")
    for bad in ("drop table x", "select 1; select 2", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            nlq.guarded(bad)
    assert nlq.guarded("select ';' as x") == "select ';' as x"


def test_delimited(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.csv", "w", encoding="cp1252") as f:
        f.write("Name; Score ;Unnamed: 2;Empty\nZoë;1;;\nBob;N/A;;\n;;;\nTotal;1;;\n")
    rows = delimited.read_delimited(spark, f"{folder}/a.csv").orderBy("_row").collect()
    assert [(r["Name"], r["Score"]) for r in rows] == [("Zoë", "1"), ("Bob", None)]
    prints = {"email": {"name": "mail", "strong": ["Recipient Email"], "weak": ["Bounced"]}, "lms": {"strong": ["Course Name"], "exclude": ["Bounced"]}}
    told = files.detected(spark.createDataFrame([("mail_x.csv", ["recipient_email", "Bounced"]), ("y.csv", ["Column A"]), ("z.csv", []), ("mail_y.csv", None)], "file string, names array<string>"), prints)
    assert {r.file: r.source for r in told.collect()} == {"mail_x.csv": "email", "y.csv": None, "z.csv": None, "mail_y.csv": None}
    ledger = spark.createDataFrame([], "sha256 string, status string")
    new = files.new_files(spark, folder, ledger).collect()
    assert len(new) == 1
    done = spark.createDataFrame([(new[0]["sha256"], "loaded")], "sha256 string, status string")
    assert files.new_files(spark, folder, done).count() == 0


def test_feeds(spark):
    rss = "<rss><channel><item><title>A & B</title><link>http://x</link><pubDate>d</pubDate><source>P</source></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="http://self"/><link href="http://alt"/><updated>u</updated><id>i</id></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("e", "<rss/>"), ("b", "<rss"), ("n", None)], "source_id string, body string")
    got = {r.source_id: r for r in feeds.read_feeds(df).collect()}
    assert (got["r"].title, got["r"].link, got["r"].publisher) == ("A & B", "http://x", "P")
    assert (got["a"].link, got["a"].published) == ("http://alt", "u")
    assert got["e"].error == "empty feed" and got["b"].error.startswith("unreadable") and got["n"].error
    board = spark.createDataFrame([("w", '{"total":2,"jobPostings":[{"title":"x","externalPath":"/1","locationsText":"Pune"},{"title":"again","externalPath":"/1"}]}'), ("z", "oops")], "source_id string, body string")
    assert [(r.title, r.location) for r in feeds.read_board(board, "workday").collect()] == [("x", "Pune")]
    lever = spark.createDataFrame([("l", '[{"text":"t","hostedUrl":"u","categories":{"location":"Goa"},"createdAt":0}]')], "source_id string, body string")
    assert feeds.read_board(lever, "lever").first().posted == "1970-01-01"


def test_seen_in_a_stream(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    like = spark.read.parquet(f"{folder}/in")
    q = flows.into_table(flows.first_seen(flows.arriving(spark, f"{folder}/in", like), "k"), f"{folder}/out", f"{folder}/ck")
    q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b"]
    assert glob.glob(f"{folder}/out/*.parquet") and os.path.isdir(f"{folder}/ck")


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    items = digest.articles(docs)
    scored = routing.routed(items, brief_catalog.BRIEF)
    assert digest.capped(scored).count() == 0 and digest.near_pairs(items).count() == 0 and digest.greedy(scored).count() == 0


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    start = "a,b\n" + "x,y\n" * 2046 + "zz,"
    assert len(start) == delimited.HEAD - 1  # the next character lies across the head's end
    tails = {"utf-8": "", "cp1252": "é€", "latin-1": "é\x81"}
    for encoding, tail in tails.items():
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes((start + ("é" if encoding == "utf-8" else "p" * 50 + tail) + "\n").encode(encoding))
        got = [r["b"] for r in delimited.read_delimited(spark, str(path)).where("a = 'zz'").collect()]
        assert got == ["é" if encoding == "utf-8" else "p" * 50 + tail]
    all_of_them = delimited.read_delimited(spark, str(tmp_path)).where("a = 'zz'").collect()
    assert sorted(r["b"] for r in all_of_them) == sorted(["é", "p" * 50 + "é€", "p" * 50 + "é\x81"])

"""What exports imply, on small tables with what they may lack."""

import datetime
import tempfile

from pyspark.sql import functions as F

from tidemill.operators import derive, ingest
from tidemill.sources import delimited


def test_columns_that_are_absent_stay_absent(spark):
    df = spark.createDataFrame([(1, None), (2, True)], "id int, delivered boolean")
    assert derive.email(df).columns == ["id", "delivered"] and derive.whatsapp(df.drop("delivered")).columns == ["id"]
    assert derive.lms(df).columns == ["id", "delivered"]


def test_failed_assessment_undoes_completion_but_not_engagement(spark):
    df = spark.createDataFrame([(1, True, False, None), (2, True, None, None), (3, None, None, 0.0), (4, None, None, None)], "id int, completed boolean, assessment_passed boolean, progress_pct double")
    got = {r.id: (r.completed, r.engaged) for r in derive.lms(df).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (None, False), 4: (None, None)}


def test_webinar_of_attendees_only(spark):
    t = datetime.datetime
    rows = [("a", None, None, 30.0, t(2024, 1, 1, 10, 0), t(2024, 1, 1, 11, 0), "Ann (Pune - Desk)"), ("a", None, None, 10.0, t(2024, 1, 1, 10, 0), None, "Bob"), ("b", None, True, None, None, None, "Cid (Goa)"), ("b", False, None, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "file string, opened boolean, engaged boolean, attendance_minutes double, engaged_at timestamp, left_at timestamp, participant_name string").withColumn("targeted", F.lit(True))
    got = sorted((r.file, r.targeted, r.opened, r.engaged, r.session_minutes, r.completed, r.department) for r in derive.webinar(df).collect() if r.participant_name)
    assert got == [("a", None, None, True, 60.0, False, None), ("a", None, None, True, 60.0, True, "Pune"), ("b", True, True, True, None, None, "Goa")]


def test_campaigns(spark):
    campaigns = spark.createDataFrame([("q1", "Town Hall", 1), ("town-hall", None, 2), ("q3", "Town Hall", 3)], "campaign_id string, campaign_name string, place int")
    rows = spark.createDataFrame([(1, " Q1 "), (2, "TOWN HALL"), (3, "town_hall"), (4, "New One!"), (5, " "), (6, None)], "i int, campaign_text string")
    got = {r.i: (r.campaign_id, r.registered) for r in ingest.campaign_ids(rows, campaigns).collect()}
    assert got == {1: ("q1", True), 2: ("q3", True), 3: ("q3", True), 4: ("new-one", False), 5: (None, False), 6: (None, False)}


def test_ledger_goes_on(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    ledger = spark.createDataFrame([(7, "s1", "loaded", None)], "batch_id long, sha string, status string, superseded_by long")
    counts = spark.createDataFrame([("f1", "s1", 3, 0, 3), ("f2", "s2", 3, 3, 0), ("f3", "s3", 3, 1, 2), ("f4", "s4", 1, 0, 1)], "file string, sha string, rows_read long, rows_rejected long, rows_loaded long")
    issues = spark.createDataFrame([("f4", "error", "CAMPAIGN_UNRESOLVED")], "file string, severity string, code string")
    loads = ingest.numbered(ingest.verdicts(counts, issues, ingest.standing(ledger)), ledger)
    assert [(r.file, r.status, r.batch_id, r.rows_loaded) for r in loads.orderBy("file").collect()] == [("f1", "duplicate", 8, 0), ("f2", "rejected", 9, 0), ("f3", "loaded", 10, 2), ("f4", "rejected", 11, 0)]
    ingest.append(loads, issues, folder)
    assert spark.read.parquet(f"{folder}/load_issue").first().batch_id == 11
    again = ingest.superseded(spark.read.parquet(f"{folder}/load_batch"), spark.createDataFrame([("s3",)], "sha string"))
    assert again.where("superseded_by = -1").first().file == "f3" and ingest.standing(again).count() == 0


def test_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;Score\nZoë;1\n\"two\nlines\";2\nTotal;3\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(b"Score,Name\n4,Ann\n5,Total\n")
    (tmp_path / "c.csv").write_bytes(b"Name;Score\nTotal;1\nEve;\nBob;<NA>\n")
    got = sorted((r["Name"], r["Score"]) for r in delimited.read_delimited(spark, str(tmp_path)).collect())
    assert got == [("Ann", "4"), ("Bob", None), ("Eve", None), ("Total", "1"), ("Total", "5"), ("Zoë", "1"), ("two\nlines", "2")]

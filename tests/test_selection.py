"""Ranks without a full sort, tables in versions, batches that come twice."""

import random
import statistics

from pyspark.sql import functions as F

from tidemill.operators import merge, selection
from tidemill.plans import stream_catalog
from tidemill.plans.catalog import QUERIES
from tidemill.sources import versions
from tidemill.streaming import upserts


def test_medians_are_exact(spark):
    rng = random.Random(1)
    rows = []
    for g in ["a", "b", None, "d", "e"]:
        kind = rng.choice([lambda: rng.gauss(0, 1e6), lambda: float(rng.randrange(5)), lambda: rng.random() ** 40, lambda: rng.choice([-1e308, 1e308, 0.0])])
        rows += [(g, kind()) for _ in range(rng.randrange(1, 400))]
    rows += [("a", None), ("none", None), ("nan", float("nan")), ("one", 7.0), ("two", 1.0), ("two", 2.0)]
    known = {}
    for g, v in rows:
        if v is not None and v == v:
            known.setdefault(g, []).append(v)
    for ranges in (2, selection.RANGES):
        selection.RANGES, before = ranges, selection.RANGES
        got = {r.g: r.median for r in selection.medians(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v").collect()}
        selection.RANGES = before
        assert got == {g: statistics.median(v) for g, v in known.items()}
    assert selection.medians(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(10**6)) for i in range(500)]
    got = selection.numbered(spark.createDataFrame(rows, "i int, x int").repartition(5), ["x", "i"]).collect()
    assert [(r.x, r.i) for r in sorted(got, key=lambda r: r.n)] == sorted((x, i) for i, x in rows)
    assert sorted(r.n for r in got) == list(range(1, 501))
    assert selection.numbered(spark.createDataFrame([], "i int, x int"), ["x"]).count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    base = versions.latest(spark, folder)
    assert base.number == 0 and versions.read(spark, base, "k int").count() == 0
    for name, k in (("mine", 1), ("theirs", 2)):
        spark.createDataFrame([(k,)], "k int").write.parquet(f"{folder}/data/{name}")
    assert versions.commit(spark, folder, versions.Version(1, {"p": [f"{folder}/data/mine"]}))
    assert not versions.commit(spark, folder, versions.Version(1, {"p": [f"{folder}/data/theirs"]}))
    assert [r.k for r in versions.read(spark, versions.latest(spark, folder), "k int").collect()] == [1]
    # a manifest that was not written to its end does not count
    (tmp_path / "table/manifests/000000000002.json").write_text('{"number": 2, "parts": {}, "no')
    assert versions.latest(spark, folder).number == 1
    assert versions.vacuum(spark, folder) == 1
    assert [r.k for r in versions.read(spark, versions.latest(spark, folder), "k int").collect()] == [1]


def test_late_and_repeated_batches_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    schema = "k int, targeted boolean, delivered boolean, opened boolean, engaged boolean, completed boolean, targeted_at timestamp, opened_at timestamp, engaged_at timestamp, completed_at timestamp, score double, batch_id int"
    flag = lambda: rng.choice([None, True, False])
    batches = [[(rng.randrange(20), *(flag() for _ in range(5)), None, None, None, None, float(rng.randrange(9)), b) for _ in range(15)] for b in range(4)]
    merged = lambda old, new: merge.monotonic(old, new, ["k"], ["score"], [])
    results = []
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        folder = f"file://{tmp_path}/{order[0]}"
        write = upserts.merged_into(folder, ["k"], merged, buckets=3)
        for number, b in enumerate(order):
            write(spark.createDataFrame(batches[b], schema), number)
        write(spark.createDataFrame(batches[order[1]], schema), 1)  # again
        assert versions.latest(spark, folder).number == 4
        results.append(sorted(map(str, upserts.merged_table(spark, folder, schema).select(*[c.split()[0] for c in schema.split(", ")]).collect())))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = merge.monotonic(every, every.limit(0), ["k"], ["score"], []).select(*every.columns)
    assert results[0] == results[1] == sorted(map(str, want.collect()))


def test_keys_are_seen_for_as_long_as_they_are_kept(spark, tmp_path):
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    rows = [(1, at(1), True, ["a", "b"]), (2, at(2), False, ["a", "x"]), (3, at(10), False, ["y", "z"]), (4, at(20), False, ["a", "q"]), (5, at(21), True, ["y", "c"]), (6, at(22), False, ["z", "c"]), (7, at(20), False, ["y", "p"])]
    schema = "id long, at string, marks boolean, keys array<string>"
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i : i + 2], schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("id long, at timestamp, marks boolean, keys array<string>").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # 4 asks for a key of 19 days before, 7 comes after its key was published
    assert sorted(r.id for r in upserts.unseen(stream, f"file://{tmp_path}/state").collect()) == [3, 4]


def test_ledger_equals_the_plain_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upserts, "FOLDERS", 3)
    rng, day, days = random.Random(8), 86_400_000_000, 3
    seen, want, folder = {}, {}, f"file://{tmp_path}/state"
    write = upserts.asked_of(spark, folder, days)
    for number in range(8):  # over FOLDERS, so the ledger is written together
        rows = [(number * 100 + i, (number + rng.randrange(12)) * day // 2, rng.random() < 0.4, k) for i in range(12) for k in rng.sample("abcdefgh", 2)]
        told = {}
        for k in "abcdefgh":
            state = seen.get(k)
            for i, at, marks, _ in sorted((r for r in rows if r[3] == k), key=lambda r: (r[1], not r[2], r[0])):
                if state is not None and at - state > days * day:
                    state = None
                if marks and state is None:
                    state = at
                elif not marks:
                    told.setdefault(i, []).append(state is None)
            seen[k] = seen.get(k) if state is None else state
        want[number] = {i for i, new in told.items() if all(new)}
        batch = spark.createDataFrame(rows, "id long, at long, marks boolean, key string")
        write(batch, number)
        if number == 3:
            write(batch, number)  # again
        assert {r.id for r in spark.read.parquet(f"{folder}/result/batch={number:09d}").collect()} == want[number]
    assert any(want.values()) and len(versions.latest(spark, folder).parts["seen"]) <= 3


def test_many_files_are_few_batches(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stream_catalog, "scratch", lambda s, what: f"file://{tmp_path}/{what}")
    got = {r.doc_id for r in QUERIES["stream_seen"](spark, str(tmp_path)).collect()}
    assert got == {r.doc_id for r in QUERIES["seen_filter"](spark, str(tmp_path)).collect()} and got
    assert len(list((tmp_path / "seen/state/result").glob("batch=*"))) == 2

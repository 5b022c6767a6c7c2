"""The pipeline on the smallest data: stages in order, columns, and that decisions take effect."""

import random

import corpus_pipeline
from tidemill.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    assert len(seen[1]) < len(seen[0]) and len(seen[2]) < len(seen[1]) and len(seen[3]) < len(seen[2])


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    rows = got.collect()
    assert {"doc_id", "size", "shard", "slot"} <= set(got.columns)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def _tables(spark, folder, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(40, 50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


ITEM = " ".join(f"benchmark{i}" for i in range(30))


def test_hostile_rows_pass_all_stages(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    plain = [text(rng.randrange(80, 200)) for _ in range(50)]
    texts = [*plain, plain[3], plain[3], plain[4] + " tail", f"{plain[5][:200]} {ITEM} {text(80)}", None, "", "a few words only", "again and again " * 90]
    docs = [(i, t, None if i % 3 else "en", rng.choice([None, "a", "b"]), None) for i, t in enumerate(texts)]
    docs += [docs[7], (None, text(90), "en", "a", 1)]
    _tables(spark, tmp_path, docs)
    source = table(spark, str(tmp_path), "documents")
    kept = [source]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], str(tmp_path))
        assert out.columns == source.columns
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(spark.read.parquet(f"{tmp_path}/{len(kept)}"))
    ids = [[r.doc_id for r in k.collect()] for k in kept]
    assert not {54, 55, 56, 57} & set(ids[1])  # null, empty, short, repeated
    assert {50, 51, 52}.isdisjoint(ids[2]) and {3, 4} & set(ids[1]) == {3, 4} & set(ids[2])
    assert len(ids[2]) == len(set(ids[2]))  # one of equal rows
    assert 53 not in ids[3] and set(ids[2]) - {53} == set(ids[3])
    assert set(ids[4]) <= set(ids[3])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids[4]))


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

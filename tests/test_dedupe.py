"""Pairs of similar sets, and the ordered fold over them, against brute force."""

import random
from pathlib import Path

import pytest

from tidemill.operators import dedupe
from tidemill.plans.catalog import QUERIES

SETS = "id long, s array<string>, p array<string>, g string"


def pairs_of(sets, threshold, same_marks):
    """By brute force: (id_a, id_b, similarity) between the smallest ids of equal sets."""
    kinds = {}
    for i, s, p, g in sets:
        if s and not (same_marks and g is None):
            k = (frozenset(s), tuple(sorted(p)), g if same_marks else None)
            kinds[k] = min(i, kinds.get(k, i))
    out = set()
    for (s, p, g), i in kinds.items():
        for (t, q, h), j in kinds.items():
            like = len(s & t) / len(s | t)
            agree = (p, g) == (q, h) if same_marks else not p or not q or set(p) & set(q)
            if i < j and like >= threshold and agree:
                out.add((i, j, round(like, 6)))
    return out


@pytest.mark.parametrize("same_marks", [False, True])
def test_similar_pairs_equal_brute_force(spark, same_marks):
    rng = random.Random(4)
    sets = []
    for i in range(400):
        s = sorted(rng.sample([f"w{int(rng.random() ** 2 * 40)}" for _ in range(60)], rng.randrange(9)))
        if sets and rng.random() < 0.6:  # a near copy
            s = [w for w in rng.choice(sets)[1] if rng.random() < 0.9] + [f"x{i}"] * (rng.random() < 0.3)
        sets.append((i, sorted(set(s)), rng.choice([[], [], ["2024"], ["2024", "q1"], ["q1"]]), rng.choice(["a", "b", None])))
    for threshold in (0.5, 0.62):
        got = dedupe.similar_pairs(spark.createDataFrame(sets, SETS), threshold, same_marks).collect()
        assert len(got) == len({(r.k_a, r.k_b) for r in got})
        assert {(min(r.id_a, r.id_b), max(r.id_a, r.id_b), r.similarity) for r in got} == pairs_of(sets, threshold, same_marks) != set()


def test_candidates_are_not_shuffled(spark):
    # every two sets share their rarest element, and none are similar
    sets = [(i, ["a", *(f"w{(i * 7 + k * k) % 97}" for k in range(1, 6))], [], None) for i in range(200)]
    pairs = dedupe.similar_pairs(spark.createDataFrame([(i, sorted(set(s)), p, g) for i, s, p, g in sets], SETS), 0.62)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 0


def test_first_free_equals_the_fold(spark):
    rng = random.Random(5)
    # a chain in falling rank, which takes a round a link, and a random graph beside it
    items = [(i, i, [1000 + i]) for i in range(9)] + [(i, i, rng.sample(range(60), 2)) for i in range(9, 100)]
    one_way = [(1000 + i, 1001 + i) for i in range(8)] + [tuple(rng.sample(range(60), 2)) for _ in range(40)]
    links = set(one_way) | {(b, a) for a, b in one_way}
    kept = []
    for i, _, groups in items:
        if not any(a == b or (a, b) in links for _, other in kept for a in groups for b in other):
            kept.append((i, groups))
    got = dedupe.first_free(spark.createDataFrame(items, "id long, place int, groups array<long>"), spark.createDataFrame(sorted(links), "a long, b long"))
    assert sorted(r.id for r in got.collect()) == [i for i, _ in kept]


def test_greedy_writes_no_texts(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices("abcdefghij klmnop", k=60_000))
    docs = [(i, f"title {i}\n{text()}", "src0") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before = size()
    assert QUERIES["dedupe_greedy"](spark, str(tmp_path)).count() == 40
    assert size() - before < 1_000_000  # the texts are 2.4 MB

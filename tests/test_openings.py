"""Keywords, fit, routing and repeated roles against plain folds of the same rules."""

import random

import pytest

from pyspark.sql import functions as F

from tidemill.functions import keywords as K
from tidemill.functions import text as X
from tidemill.operators import digest, fit, roles, routing
from tidemill.plans.radar_catalog import PROFILE
from tidemill.sources import config

OPENING = "id long, title string, company string, summary string, location string, experience_min int, experience_max int"


def found(spark, f, words, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [list(r.k) for r in df.select("i", f(F.col("x"), words).alias("k")).orderBy("i").collect()]


def test_phrases(spark):
    words = ["vice president", "senior vice president", "P&L", "AVP", " "]
    assert found(spark, K.phrases, words, "Senior  Vice\nPresident", "vice president, p&l owner", "AVPs", "avp AVP", "", None) == [["senior vice president"], ["vice president", "P&L"], [], ["AVP"], [], []]
    assert found(spark, K.phrases, [], "x") == [[]]


def test_inflected(spark):
    words = ["life insurer", "annuity", "non-par", "LIC", "first year premium"]
    texts = ["Life insurers' annuities", "a non par plan, first-year premiums", "policy", "LICs lic", "life insurer", None]
    assert [sorted(x) for x in found(spark, K.inflected, words, *texts)] == [["annuity", "life insurer"], ["first year premium", "non-par"], [], ["LIC"], ["life insurer"], []]


def test_gates_come_in_order(spark):
    rows = [
        (1, "VP Telesales", "c", "internship", "Riverside", None, None),
        (2, "VP Alliances", "c", "internship", "Riverside", None, None),
        (3, "Manager Alliances", "c", "", "Riverside", None, None),
        (4, "VP Claims", None, None, "Riverside", None, None),
        (5, "VP Alliances", None, None, None, None, None),
        (6, "VP Alliances", None, None, "Northland", None, 5),
        (7, "VP Alliances", None, "life cover in Gulf City", "Northland", 12, 20),
        (8, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in fit.fitted(spark.createDataFrame(rows, OPENING), PROFILE).collect()}
    starts = ["title names 'telesales'", "posting names 'internship'", "no grade", "names no function", "location (no location given)", "advertises up to 5 yrs, below the 8-year floor", None, "no grade"]
    assert [got[i].reject_reason and got[i].reject_reason.startswith(s) if s else got[i].reject_reason is None for i, s in enumerate(starts, 1)] == [True] * 8
    # 30 for VP, 30 * 2 / 3 for one function in the title, 20 * 1 / 2 for the domain, 8 for Northland
    assert (got[7].fit, got[7].tier, got[7].region) == (68.0, "possible", "home")
    assert list(got[7].reasons) == ["VP (VP)", "alliances", "life cover", "Home — Northland", "12-20 yrs asked, which fits"]
    assert got[1].fit is None and got[1].matched is None
    assert fit.fitted(spark.createDataFrame([], OPENING), PROFILE).count() == 0


def test_certification_needs_company(spark):
    t = routing.Topics((routing.Topic("life", ("harbour", "annuity"), ("nominee",), certifies=True, ambiguous=("harbour",)),), gate=("court",), least=0.5)
    rows = [(1, "s", "Harbour opens", None), (2, "s", "Harbour nominee", None), (3, "s", "Harbour annuity", ""), (4, "s", "harbour court", None), (5, "s", "weather", None), (6, None, None, None)]
    got = {r.id: r.reject_reason for r in routing.routed(spark.createDataFrame(rows, "id int, source_id string, title string, summary string"), t).collect()}
    assert got == {1: "outside the domain", 2: None, 3: None, 4: None, 5: "no topic keywords matched", 6: "no topic keywords matched"}


def plain_roles(rows):
    """rows: id, url, company, words, marks, role, in order."""
    kept = []

    def alike(words, company, marks, x):
        return company and company == x[2] and marks == x[4] and words and x[3] and len(words & x[3]) >= 0.85 * len(words | x[3]) - 1e-12

    for i, url, company, words, marks, role in rows:
        found = [x for x in kept if x[1] == url] or [x for x in kept if x[5] == role] or [x for x in kept if alike(words, company, marks, x)]
        if found:
            found[0][6] += 1
        else:
            kept.append([i, url, company, words, marks, role, 1])
    return {(x[0], x[6]) for x in kept}


@pytest.mark.parametrize("seed", [4, 5])
def test_roles_equal_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    words = ["alliances", "banking", "north", "south", "lead", "growth", "markets", "vp", "kam", "role"]
    rows = []
    for i in range(250):
        title = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
        rows.append((i, i, f"http://{rng.choice(['www.', ''])}j/{rng.randrange(120)}", rng.choice(["Acme Ltd", "acme", "Group", "", "Other Co"]), title))
    rows += [(250 + i, 250 + i, "http://j/0", "Acme", "VP banking") for i in range(50)]  # a hot group of copies
    df = spark.createDataFrame(rows, "key long, place long, url string, company string, title string")
    seen = roles.keys(df).select("key", "url_key", roles.normal_company(F.col("company")).alias("c"), roles.title_words(F.col("title")).alias("w"), "role_key").withColumn("m", roles.marks(F.col("w"))).orderBy("key").collect()
    want = plain_roles([(r.key, r.url_key, r.c, set(r.w), set(r.m), r.role_key) for r in seen])
    assert {(r.key, r.duplicates) for r in roles.one_of_each(df).collect()} == want


def test_places_are_those_of_a_full_sort(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randrange(4)), rng.choice([None, "2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-02 00:00:00"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, score double, published string").withColumn("published", F.col("published").cast("timestamp"))
    want = [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[2] is None, [-ord(c) for c in r[2] or ""], r[0]))]
    assert [r.doc_id for r in digest.ranked(df).orderBy("place").collect()] == want


def test_titles_and_dates(spark):
    df = spark.createDataFrame([("A | The Desk", "The Desk"), ("A - The Desk", ""), ("A-The Desk", "The Desk"), (None, "x")], "t string, p string")
    assert [r[0] for r in df.select(X.clean_title(F.col("t"), F.col("p"))).collect()] == ["A", "A - The Desk", "A-The Desk", None]
    df = spark.createDataFrame([("Mon 1 Jan 2024 9:05 PST",), ("Mon, 1 Jan 2024 09:05:06 +0100",), ("2024-01-01T09:05:06.5+01:00",), ("Monday",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(X.parse_date(F.col("d"))).collect()] == ["2024-01-01 17:05:00", "2024-01-01 08:05:06", "2024-01-01 08:05:06.500000", "None", "None"]


def test_configuration():
    p = config.profile('{"levels": [{"title": "VP", "value": 1.0, "keywords": ["VP"]}], "regions": [], "function_strong": ["x"], "tiers": {"strong": 80}}')
    assert p.tiers == {"strong": 80, "possible": 55.0, "stretch": 35.0} and p.levels[0].keywords == ("VP",)
    for wrong in ('{"sektions": []}', '{"sections": [{"id": "a", "strong": [], "weight": 1}]}'):
        try:
            config.topics(wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)

"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and clashing names."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, decontam, lm, mixing, neardup, quality, sharding, substrings, tokens, warc
from tidemill.llm.suffixes import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, n int, h string, comp string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, junk, nulls, empty texts and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(70)
    texts = [text(rng.randrange(60, 160)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[4].upper(), texts[5] + " tail", text(40) + "\n" + passage + "\n" + text(30), passage, "x" + passage[5:], None, "", "  \n ", "one two", "a a a a " * 30, "### *** " * 40]
    for i in range(6, 14):  # near copies: a few words replaced
        w = texts[i].split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    rows = [(i, t, "en", rng.choice(["b", "a", None, "ä"]), 0, "r", i, "h", "c") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, texts[8], "en", None, 0, "r", 1, "h", "c"), (3, "other text under a used id " * 12, "en", "b", 0, "r", 1, "h", "c")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    """The same rows as a table, which is read alike twice."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_sorts_suffixes():
    rng = random.Random(2)
    for _ in range(3000):
        s = [rng.randrange(1, rng.choice([2, 3, 5])) for _ in range(rng.randrange(0, 24))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_op1_windows_of_a_crowded_anchor():
    rng = np.random.default_rng(1)
    gram = bytes(rng.integers(97, 122, substrings.GRAM, dtype=np.uint8))
    pool = [bytes(rng.integers(97, 122, 95, dtype=np.uint8)) for _ in range(8)]
    texts = []
    for _ in range(600):
        a, b = (bytearray(pool[rng.integers(8)]) for _ in range(2))
        a[rng.integers(95)], b[rng.integers(95)] = 65 + rng.integers(20, size=2)
        texts.append(bytes(a) + gram + bytes(b))
    texts = sorted(set(texts))
    n = len(texts)
    tracemalloc.start()
    got = substrings.repeated_windows(np.full(n, 7, np.uint64), np.ones(n, np.int64), np.full(n, 95), np.full(n, 95), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(96))
    assert [g.tolist() for g in got] == [[seen[t[i : i + 200]] > 1 for i in range(96)] for t in texts]
    assert peak < 60 * sum(map(len, texts))


@pytest.mark.parametrize("crowd", [substrings.CROWD, 1])
def test_op1_removes_repeated_strings(table, rows, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    need = substrings.NEED
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(b[i : i + need] for _, b in data for i in range(len(b) - need + 1))
    expected = collections.Counter()
    for i, b in data:
        on = bytearray(len(b))
        for j in range(len(b) - need + 1):
            if seen[b[j : j + need]] > 1:
                on[j : j + need] = b"\1" * need
        kept = bytes(x for x, y in zip(b, on, strict=True) if not y)
        spans = len(re.findall(b"\1+", bytes(on)))
        expected[(i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = collections.Counter(tuple(r) for r in substrings.op1(table).collect())
    assert got == expected


def test_op1_of_nothing(none):
    assert substrings.op1(none).count() == 0


def test_op2_counts_as_the_tokenizer_does(spark, docs, rows, none):
    from tokenizers import Tokenizer, models

    vocab = tokens.vocabulary()
    pieces = [("<unk>", -2e9), *((f"<0x{i:02X}>", -3e9) for i in range(256)), *vocab.pieces]
    t = Tokenizer(models.Unigram(pieces, 0, True))
    count = lambda x: len(t.encode(tokens.MARK + x.replace(" ", tokens.MARK), add_special_tokens=False).ids) if x else 0
    got = collections.Counter(map(tuple, tokens.op2(docs).collect()))
    assert got == collections.Counter((r[0], count(r[1])) for r in rows)
    assert tokens.op2(none).count() == 0


def test_op2_ties_and_unknowns():
    c = tokens.Counter(tokens.Vocabulary((("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0)), False))
    assert c.best("aa") == (-2.0, 1)  # of equal scores the longest last piece
    assert c.best("aab")[0] == -3.0
    assert c.best("azzb")[1] == 3  # a run of unknown characters is one
    assert tokens.Counter(tokens.Vocabulary((("a", -1.0),), True)).best("aéa")[1] == 4


def test_op3_rotates_speakers(spark):
    turns = [(1, 0, "system", "be kind", 0), (1, 1, "user", "hi <|im_end|>", 0), (1, 2, "assistant", "hello", 0), (1, 2, "assistant", "hello", 0), (2, 0, "ann", None, 0), (2, 1, None, "x", 0), (2, None, "bob", "late", 0), (3, 0, "system", "alone", 0), (None, 5, "ann", "no id", 0), *((9, 0, "u", str(i), 0) for i in range(chat.MOST + 5))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part int")
    got = chat.rotate(df).collect()
    one = {r["perspective"]: r for r in got if r["conv_id"] == 1}
    assert set(one) == {"user", "assistant"}
    r = one["assistant"]
    assert r["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=user\nhi <| im_end|><|im_end|>\n" + "<|im_start|>assistant\nhello<|im_end|>\n" * 2
    assert [r["text"][a:b] for a, b in zip(r["starts"], r["ends"], strict=True)] == ["hello<|im_end|>"] * 2
    two = sorted((r["perspective"], r["part"] < 2**61, r["text"]) for r in got if r["conv_id"] == 2)
    assert {t[0] for t in two} == {"ann", "bob"} and any("name=unknown\nx" in t[2] for t in two)
    assert not [r for r in got if r["conv_id"] == 3] and [r for r in got if r["conv_id"] is None]
    nine = [r for r in got if r["conv_id"] == 9]
    assert len(nine) > 1 and sum(r["n_turns"] for r in nine) == chat.MOST + 5
    assert chat.rotate(df.where("false")).count() == 0


def test_op3_equals_its_oracle_at_every_size(spark):
    """Hot conversations: repeated turn numbers, equal rows, no turn numbers."""
    import duckdb
    import pyarrow as pa

    rng = random.Random(6)
    turns = [(1, rng.randrange(300), rng.choice(["ann", "bob", "system", None]), rng.choice(["é", "hm", f"text {i % 700}"])) for i in range(5000)]
    turns += [(2, None, rng.choice(["ann", "bob"]), f"late {i}") for i in range(chat.MOST + 300)] + [(3, 7, "ann", "again")] * (2 * chat.MOST + 1) + [(None, 0, "ann", None), (4, 1, "bob", "x"), (4, 600, "ann", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    conversations = pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns, strict=True)), strict=True)))
    with duckdb.connect() as db:
        db.register("conversations", conversations)
        want = db.execute(chat.ORACLE).fetchall()
    # the oracle lists the spans of equal rows in any order
    level = lambda rs: collections.Counter((*r[:-1], *sorted(tuple(map(int, m.split("-"))) for m in r[-1].split(",") if m)) for r in rs)
    got = [tuple(r) for r in chat.op3(df).collect()]
    assert level(got) == level(want)
    assert all((m := [int(x.split("-")[0]) for x in r[-1].split(",") if x]) == sorted(m) for r in got)
    subs = sorted((r["sub"], r["n_turns"]) for r in chat.rotate(df).collect() if r["conv_id"] == 3)
    assert subs == [(0, chat.MOST), (1, chat.MOST), (2, 1)]


def test_op4_gives_contiguous_even_shards(docs, rows, none):
    got = sharding.op4(docs).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    sizes = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    full = sorted(sharding.shard_by_bytes(docs).collect(), key=lambda r: r.offset)
    assert all(a.offset + a["size"] == b.offset and a.shard <= b.shard for a, b in zip(full, full[1:], strict=False))
    assert sharding.op4(none).count() == 0


def test_op4_spreads_one_key(spark):
    df = spark.createDataFrame([(7, f"text {i % 50}") for i in range(3000)], "doc_id long, text string")
    got = sharding.op4(df).groupBy("shard").sum("size").collect()
    assert len(got) == 8 and max(r[1] for r in got) - min(r[1] for r in got) < 40


def targets_by_filling(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full: dict = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def test_op5_meets_its_targets(docs, rows, none):
    got = mixing.op5(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], size(r[1])) for r in rows)
    by = collections.Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    want = targets_by_filling(by)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted((by[s], round(want[s], 6)) for s in by)
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0) <= (r.taken == 0)
        taken[r.source_size, r.target] += r.taken
    for (_, t), n in taken.items():
        assert abs(n - t) <= 0.01 * t + 0.5 * min(r["size"] for r in got if r["size"] > 40)
    again = collections.Counter((r.doc_id, r.taken) for r in mixing.op5(docs.repartition(7)).collect())
    assert again == collections.Counter((r.doc_id, r.taken) for r in got)
    assert mixing.op5(none).count() == 0


def test_op5_reaches_the_optimum_of_the_dual(spark):
    """Rates that meet every target, and whose log odds against the cap are linear in size: the conditions of the optimum."""
    rng = random.Random(11)
    strata = [(s, k, rng.randrange(1, 30)) for s in ("a", "b", None) for k in rng.sample(range(1, 900), 40)]
    sums = collections.Counter()
    for s, k, n in strata:
        sums[s] += k * n
    goal = {"a": 0.4, "b": 1.7, None: 2.9}
    goals = spark.createDataFrame([(s, v, goal[s] * v) for s, v in sums.items()], "source string, source_size long, target double")
    for _ in range(2):
        got = {r.source: r for r in mixing.solve(spark.createDataFrame(rng.sample(strata, len(strata)), "source string, size long, n long"), goals).collect()}
        for s, share in goal.items():
            x = {k: got[s].tilt * k / got[s].mean for t, k, _ in strata if t == s}
            rate = {k: 3 * math.exp(v) / (math.exp(v) + 2) for k, v in x.items()}
            assert abs(sum(rate[k] * k * n for t, k, n in strata if t == s) - share * sums[s]) <= 2e-6 * share * sums[s]
            assert all(abs(math.log(r / (3 - r)) - math.log(1 / 2) - x[k]) < 1e-6 for k, r in rate.items())


def test_op5_caps_targets(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 50 else "b" if i < 52 else "c") for i in range(60)], "doc_id long, text string, source string")
    got = {r["source_size"]: (r["target"], r["t"]) for r in mixing.op5(df).groupBy("source_size", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    assert got[20] == (60.0, 60) and got[80] == (240.0, 240)
    assert abs(got[500][1] - 300) <= 10


def test_op6_round_trip(spark):
    pages = [(5, "http://a/x y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (9, None, None), (7, "http://c", ""), (8, "http://d", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (2, "http://b", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, sha string")
    got = sorted(map(tuple, warc.op6(df).collect()), key=str)
    b32 = lambda t: warc.digest((t or "").encode())
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    want = [(i, len((h or "").encode()), b32(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages]
    assert got == sorted(want, key=str)
    assert warc.op6(df.where("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_op6_converts_both_versions(version):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhi\nthere"
    data = warc.arc_start(version, "f.arc", "20200102030405") + warc.arc_header(version, {"URL": "http://x/", "IP-address": "1.2.3.4", "Archive-date": "20200102030405", "Content-type": "text/html; charset=x", "Archive-length": str(len(body))}).replace(b"%20", b" ") + body + b"\n"
    opening, record = warc.read_arc(data)
    assert opening.fields["URL"] == "filedesc://f.arc" and record.content == body and record.fields["Content-type"] == "text/html; charset=x"
    made = warc.convert(opening) + b"\r\n\r\n" + warc.convert(record) + b"\r\n\r\n"
    (h0, _), (h1, c1) = warc.read_warc(made)
    assert h0["warc-type"] == "warcinfo" and h1["warc-type"] == "response" and h1["warc-date"] == "2020-01-02T03:04:05Z"
    assert c1 == body and h1["warc-payload-digest"] == "sha1:" + warc.digest(b"hi\nthere")
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-5]))


def components_by_force(rows, k, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = label[a], label[b]
                label = [min(x, y) if c in (x, y) else c for c in label]
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    return collections.Counter((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_op7_components(docs, rows, none, k, percent):
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.op7(none).count() == 0


def test_op7_crowded_family(spark):
    """Copies with ever more edits: one band, many that are near the leader and many that are not."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(150)] = rng.choice("pqrst") * rng.randrange(1, 4)
        rows.append((i, " ".join(w)))
    got = neardup.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(rows, 3, 85)


def test_op7_one_of_each(docs, rows):
    kept = neardup.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    want = components_by_force(rows, 5, 80)
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert {c for (_, n, c) in want if n and c is not None} <= set(ids)
    # id 3 is the smallest of two components
    assert ids[3] == 2 and sum(ids.values()) == len({c for (_, n, c) in want if n}) + 1 + sum(v for (_, n, _), v in want.items() if not n)


def test_op7_estimate_by_parts():
    """Many pairs at once give what each gives alone."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, int(rng.integers(5, 300)), dtype=np.uint64) for _ in range(2 * neardup.PAIRS + 40)]
    a, n = np.array([neardup.registers(x) for x in sets]), np.array([float(len(x)) for x in sets])
    b, m = np.roll(a, 1, axis=0), np.roll(n, 1)
    whole = neardup.estimate(a, b, n, m)
    assert np.array_equal(whole, [neardup.estimate(a[i : i + 1], b[i : i + 1], n[i : i + 1], m[i : i + 1])[0] for i in range(len(a))])


def test_op7_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = x[: int(1000 + 1000 * share)], x[int(1000 - 1000 * share) :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = neardup.estimate(*(neardup.registers(y).reshape(1, -1) for y in (a, b)), np.array([float(len(a))]), np.array([float(len(b))]))
        assert abs(est[0] - true) < 0.12
    assert (np.maximum(neardup.registers(a), neardup.registers(b)) == neardup.registers(np.union1d(a, b))).all()


def test_op1_long_texts(spark, tmp_path):
    """Two copies of a text of 5 MB, and one of 700,000 equal bytes: all is removed, in time that grows with the text."""
    import time

    rng = np.random.default_rng(7)
    long = "".join(map(chr, rng.integers(97, 123, 5_000_000)))
    began = time.time()
    rows = spark.createDataFrame([(1, long), (2, long + "!"), (3, "x" * 700_000), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.op1(rows).collect()}
    assert got == {1: (5_000_000, 5_000_000, 1), 2: (5_000_001, 5_000_000, 1), 3: (700_000, 700_000, 1), 4: (5, 0, 0)}
    assert time.time() - began < 90


def test_op1_cut_merges_runs():
    rng = random.Random(3)
    for _ in range(200):
        runs = [(a, a + rng.randrange(0, 60)) for a in (rng.randrange(0, 3000) for _ in range(rng.randrange(0, 9)))]
        on = {x for a, b in runs for x in range(a, b + substrings.NEED)}
        starts, ends = substrings._cut(np.array([a for a, _ in runs], np.int64), np.array([b for _, b in runs], np.int64))
        assert {x for a, b in zip(starts, ends, strict=True) for x in range(a, b)} == on
        assert len(starts) == sum(x - 1 not in on for x in on)


def test_op6_hostile_rows(spark, monkeypatch):
    """URLs with line ends, spaces, odd schemes or nothing, a page of its own file, and empty and null pages."""
    monkeypatch.setattr(warc, "LARGE", 5000)
    monkeypatch.setattr(warc, "PER_FILE", 7)
    big = "<html>" + "é\r\n\r\n" * 3000
    data = [(1, "http://a/\nb", "x"), (2, "filedesc:z", "x"), (3, "", "y"), (4, None, "y"), (5, " http://a b\t", big), (6, "http://c", big), (7, "u", ""), (8, "u", None), (9, "http://\u2028", "WARC/1.1\r\n\r\nq")]
    data += [(10 + i, f"http://d/{i}", f"page {i // 2}") for i in range(20)]
    got = {r.page_id: r for r in warc.op6(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    first = {}
    for i, _, h in data:
        first.setdefault(h or "", i)
    assert len(got) == len(data)
    for i, _, h in data:
        body, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest(body))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))


def test_op6_archives_in_members():
    """An ARC archive reads the same in one piece, gzipped, and gzipped in members; so does a WARC archive."""
    import gzip

    head = lambda url, n: warc.arc_header(1, {"URL": url, "IP-address": "1.2.3.4", "Archive-date": "20200102030405", "Content-type": "text/plain", "Archive-length": str(n)})
    plain = warc.arc_start(1, "f.arc", "20200102030405") + head("http://x/", 5) + b"hello\n" + head("filedesc:later", 2) + b"\n\n\n" + head("http://y/", 0) + b"\n"
    want = [(r.fields, r.content, r.opening) for r in warc.read_arc(plain)]
    assert [o for _, _, o in want] == [True, False, False, False] and want[2][1] == b"\n\n"
    members = gzip.compress(plain[:70]) + gzip.compress(plain[70:90]) + gzip.compress(plain[90:])
    assert want == [(r.fields, r.content, r.opening) for r in warc.read_arc(gzip.compress(plain))] == [(r.fields, r.content, r.opening) for r in warc.read_arc(members)]
    records = [warc.convert(r) + b"\r\n\r\n" for r in warc.read_arc(plain)]
    assert list(warc.read_warc(b"".join(records))) == list(warc.read_warc(b"".join(map(gzip.compress, records))))
    assert [h["warc-type"] for h, _ in warc.read_warc(b"".join(records))] == ["warcinfo", "resource", "resource", "resource"]


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 40])
def test_op8_scores(table, rows, none, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    got = lm.op8(table).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seqs = [(r[0], [*WORD.findall((r[1] or "").translate(LOW)), None]) for r in rows]
    c = collections.Counter(w for i, s in seqs if not held(i) for w in s)
    total, distinct = sum(c.values()), len(c)
    key = lambda i, n, k, b: (str(i), n, k, round(b, 4))
    want = collections.Counter(key(i, len(s), sum(c[w] > 0 for w in s), sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in s)) for i, s in seqs)
    assert collections.Counter(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == total and r.held_out == held(r.doc_id) for r in got)
    assert lm.op8(none).count() == 0


def test_op8_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(1)
    size = 200
    classes = rng.integers(0, lm.CLASSES, size)
    classes[: lm.CLASSES] = np.arange(lm.CLASSES)
    inner = np.full((lm.CONTEXTS, size), 0.0, np.float32)
    inner -= np.log10(np.bincount(classes, minlength=lm.CLASSES))[classes]
    net = lm.Attention(classes, np.arange(size) % lm.CONTEXTS, np.arange(size), inner, np.zeros((lm.CONTEXTS, lm.CLASSES)) - np.log(lm.CLASSES))
    total = sum(10 ** net.score(np.array([5, i]), np.array([0, 0]), 1)[0] for i in range(size))
    assert abs(total / 10 ** net.score(np.array([5]), np.array([0]), 1)[0] - 1) < 1e-3
    # what follows depends on what stood three places before: no bigram can know
    seq = [7, 8, 9]
    while len(seq) < 4000:
        seq.append(seq[-3] if rng.random() < 0.9 else int(rng.integers(0, 40)))
    w = np.array([seq[i : i + 2 * lm.HALF + 1] for i in range(0, 3900, 3)], np.int32)
    before = net.score(np.array(seq), np.zeros(len(seq), int), 1)[0]
    for k in range(6):
        net.train(w, k)
    assert net.score(np.array(seq), np.zeros(len(seq), int), 1)[0] > 0.6 * before
    # long texts are scored once for each token, like any split of rows
    a = net.score(np.array(seq[:50] + seq[:20]), np.repeat([0, 1], [50, 20]), 2)
    assert np.allclose(a, [net.score(np.array(seq[:50]), np.zeros(50, int), 1)[0], net.score(np.array(seq[:20]), np.zeros(20, int), 1)[0]], rtol=1e-4)


def test_op8_attention_tells_more_than_the_commonest_ids_apart(spark):
    """What stood three places before decides between 120 ids, which no counts of pairs know."""
    rng = np.random.default_rng(4)
    seq = [7, 8, 9]
    while len(seq) < 12000:
        seq.append(seq[-3] if rng.random() < 0.9 else int(rng.integers(3, 123)))
    n = collections.Counter(zip(seq, seq[1:], strict=False))
    model = lm._start(spark.createDataFrame([(a, b, k) for (a, b), k in n.items()], "a long, b long, n long"), 600)
    ids, of = np.array(seq), np.zeros(len(seq), int)
    before = model.score(ids, of, 1)[0]
    for k in range(6):
        model.train(lm.training_windows(ids, of, 1), k)
    assert model.score(ids, of, 1)[0] > 0.5 * before


def test_op8_trains_on_every_id():
    rng = random.Random(5)
    texts = [[rng.randrange(3, 900) for _ in range(n)] + [lm.END] for n in (0, 1, 15, 16, 17, 33, 200, 3000)]
    ids, of = np.array([i for t in texts for i in t]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    w = lm.training_windows(ids, of, len(texts))
    goals = w[:, lm.HALF + 1 :]
    assert goals[goals >= 0].tolist() == ids.tolist()
    # what stands before a goal is the text before it, as far as the window goes
    whole = np.concatenate([[-1] * lm.HALF + [lm.END] + t for t in texts[-1:]])
    assert (w[-5][w[-5] >= 0] == whole[-(w[-5:, 1 + lm.HALF :] >= 0).sum() - 1 - lm.HALF :][: 2 * lm.HALF + 1]).all()
    assert len(lm.training_windows(ids[:0], of[:0], 0)) == 0


def test_op8_scores_equal_a_plain_loop(table):
    """score() against the same model, one token at a time; every training token is in some round, and in one only."""
    read = lm.read(table).cache()
    model = lm.fit(read)
    got = {r.rid: r.score for r in lm.attended(read, model, (np.zeros(0, np.int64), np.zeros(0))).collect()}
    p, scale = {k: v.astype(float) for k, v in model.p.items()}, lm.WIDTH**-0.5
    for r in read.collect():
        ids = np.frombuffer(r.ids, np.uint16).astype(int).tolist()
        before, total = [lm.END, *ids[:-1]], 0.0
        for t, goal in enumerate(ids):
            begin = max(0, (t // lm.HALF - 1) * lm.HALF)
            c = model.classes[before[begin : t + 1]]
            x = p["E"][c]
            s = (x @ p["K"]) @ (x[-1] @ p["Q"]) * scale + p["R"][np.arange(len(c))[::-1]]
            w = np.exp(s - s.max())
            context = model.contexts[before[t]]
            logits = (w / w.sum()) @ (x @ p["V"]) @ p["U"] + model.bigram[context]
            m = logits.max()
            total += (logits[model.classes[goal]] - m - np.log(np.exp(logits - m).sum())) / np.log(10) + model.inner[context, model.column[goal]]
        assert abs(got[r.rid] - total) < 2e-4 * len(ids)
    shares = [read.where(F.pmod(F.xxhash64("rid"), F.lit(lm.ROUNDS)) == k).count() for k in range(lm.ROUNDS)]
    assert sum(shares) == read.count()


def test_op8_encodes_a_word_once_a_worker(monkeypatch):
    """Words of earlier slices are not encoded again, and what is remembered, or forgotten, changes no ids."""
    rng = random.Random(6)
    vocabulary = [f"w{i}x" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=40_000)) for _ in range(6)] + [None, "", "one\u00a0two \u2581 A"]
    with open(lm.MODEL, "rb") as f:
        model = f.read()
    encoded, plain = [], lm.Subwords.encode
    monkeypatch.setattr(lm.Subwords, "encode", lambda self, words: encoded.append(len(words)) or plain(self, words))
    monkeypatch.setattr(lm, "SMALL", 1 << 17)
    read = lambda: [np.concatenate(x) for x in zip(*((ids, n) for *_, ids, n in lm.Subwords(model).read(pa.array(texts))), strict=True)]
    got = read()
    assert len(encoded) > 1 and sum(encoded) <= len(vocabulary) + 3
    monkeypatch.setattr(lm, "REMEMBERED", 100)
    again = read()
    reader = lm.Subwords(model)
    want = [plain(reader, [w])[0] for t in texts for w in [*WORD.findall((t or "").translate(LOW)), None] if w is not None]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
    assert got[0][got[0] != lm.END].tolist() == [int(i) for x in want for i in x]


def test_op8_counts_are_added_up_in_tasks(monkeypatch):
    monkeypatch.setattr(lm, "TALLIED", 50)
    rng = np.random.default_rng(7)
    runs = [(rng.integers(-90, 90, n), rng.integers(1, 9, n)) for n in (0, 10, 300, 40, 45, 0, 7)]
    want, got = collections.Counter(), collections.Counter()
    for keys, n in runs:
        for k, x in zip(keys.tolist(), n.tolist(), strict=True):
            want[k] += x
    made = list(lm._added_up(iter(runs)))
    for b in made:
        assert len(set(b.column(0).to_pylist())) == b.num_rows
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[k] += x
    assert got == want and sum(b.num_rows for b in made) < 402 and [b.num_rows for b in lm._added_up(iter([]))] == [0]


def test_op8_later_ids_are_learned(spark, tmp_path):
    """Texts that differ from id 34 on only give models that differ."""
    made = []
    for tail in ("the", "of"):
        rows = [(i, "and " * 40 + f"{tail} " * 60 + "the of") for i in range(40)]
        made.append(lm.fit(lm.read(spark.createDataFrame(rows, "doc_id long, text string"))).p)
    assert any(not np.allclose(made[0][k], made[1][k]) for k in made[0])


def fold(t):
    return re.sub(r"[\x20\x09-\x0d!-/:-@\[-`{-~]+", " ", (t or "").translate(LOW)).split()


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(now[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
        last = now
    return last[-1]


def test_op9_finds_leaks(spark, none):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 40)))) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = [(0, None), (1, ""), (2, " ".join(rng.choice(vocab) for _ in range(200)))]
    for i in range(60):
        w = items[i % 12][1].upper().split()
        for _ in range(rng.randrange(0, len(w) * 3 // 10)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at] + ",", "ins"]])
        around = [rng.choice(vocab) for _ in range(60)]
        docs.append((10 + i, " ".join(around[:30] + w + around[30:])))
    docs.append((10, docs[5][1]))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.n_edits) for r in decontam.op9(d, b).collect())
    want = collections.Counter()
    for i, t in docs:
        words = fold(t)
        for j, q in items:
            q = fold(q)
            k = decontam.allowed(len(q))
            near = [edits(words[p : p + len(q)], q) for p in range(len(words) - len(q) + 1)] if q else []
            if near and min(near) <= k:
                want[(i, j, min(near))] += 1
    missed = sum((want - got).values())
    assert not got - want or all((i, j) in {(a, c) for a, c, _ in want} for i, j, _ in got - want)
    assert missed <= 0.005 * sum(want.values())
    clean = {r.doc_id for r in decontam.clean(d, b).collect()}
    assert {0, 1, 2} <= clean and not clean & {i for i, _, _ in got}
    assert decontam.op9(none, b).count() == 0 and decontam.op9(d, b.where("false")).count() == 0


def test_op9_finds_items_cut_by_the_edges(spark):
    """A text that is an item less some words, and texts that begin or end inside an item."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 50)))) for i in range(20)]
    docs, want = [], {}
    for i, t in items:
        w = t.split()
        k, filler = decontam.allowed(len(w)), [rng.choice("xyz") * 3 + str(j) for j in range(40)]
        at = rng.randrange(1, len(w) - 1)
        for j, (x, lost) in enumerate([(w[:-1], 1), (w[1:], 1), (w[:at] + w[at + 1 :], 1), (w[k:] + filler, k), (filler + w[:-k], k), (w[: -k - 1], k + 1)]):
            docs.append((10 * i + j, " ".join(x)))
            if lost <= k:
                want[10 * i + j, i] = lost
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.n_edits for r in decontam.op9(d, b).collect()} == want
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 8, 10, 15, 24, 40, 80, 200])
def test_op9_recall_by_item_size(n):
    """Items of 1 to 200 words with as many random edits as they may have, against brute force: at least 99 in 100 are found."""
    import pyarrow as pa

    from tidemill.llm.textscan import slices

    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    items, k = [[word() for _ in range(n)] for _ in range(12)], decontam.allowed(n)
    texts = []
    for j in range(150 if n < 100 else 40):
        x = list(items[j % 12])
        for _ in range(k):
            at = rng.randrange(len(x))
            x[at : at + 1] = rng.choice([[], [word()], [x[at], word()]]) if len(x) > 1 else [word()]
        texts.append([word() for _ in range(12)] + x + [word() for _ in range(12)])
    index = decontam.Items(list(range(12)), [" ".join(i) for i in items])
    found = {}
    for s in slices(pa.array([" ".join(t) for t in texts])):
        r, i, e, _, _ = index.search(s)
        found |= dict(zip(zip(r.tolist(), i.tolist(), strict=True), e.tolist(), strict=True))
    want = {}
    for j, t in enumerate(texts):
        best = min((edits(t[a : a + n], items[j % 12]) for a in range(8, min(len(t) - n + 1, 17))), default=n)
        if best <= k:
            want[j, j % 12] = best
    hit = sum(x in found for x in want)
    assert want and hit >= 0.99 * len(want)
    assert all(found[x] <= want[x] for x in want if x in found)


def test_op9_distances():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (50, 9)).astype(np.uint64), rng.integers(0, 4, (50, 9)).astype(np.uint64)
    assert decontam.distances(a, b).tolist() == [edits(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_op10_statistics_and_verdicts(spark, docs, rows, none):
    def stats(t):
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + x for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for x in range(3)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed

    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(72, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.op10(docs, labels).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == collections.Counter((r[0], *stats(r[1])) for r in rows)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 60) >= 55
    kept = quality.passing(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.op10(none, labels).count() == 0 and quality.op10(docs, labels.where("false")).count() == len(rows)


def test_op10_forest_tells_junk():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (600, 4))
    bad = rng.normal(8, 1, (40, 4))
    forest, cut = quality.fit(np.vstack([good, bad]), np.repeat([1, 0], [600, 40]))
    assert (forest.score(bad) > cut).mean() > 0.95 and (forest.score(good) > cut).mean() < 0.02

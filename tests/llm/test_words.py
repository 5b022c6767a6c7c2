"""Operators 11 to 13 against brute force on small tables with nulls, empty, long and repeated rows, ties and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemill.llm import align, compression, variants

SCHEMA = "doc_id long, text string, word string, n int, n_near int, a string, b string, score string, quality int, _k int, _t int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
REST = ("w", 1, 2, "a", "b", "s", 0, 1, 2)


def rows_of(texts: list[str | None]) -> list[tuple]:
    return [(i, t, *REST) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# 11


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows: list[tuple]) -> dict[str, tuple]:
    seen = collections.Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    vocab = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        if best is not None and vocab[best] >= 10 * n:
            form[w] = best

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), vocab[form[w]] if w in form else None) for w, n in vocab.items()}


def misspelt(seed: int) -> list[str | None]:
    """Few base words, often; their variants, rarely; chains of variants, ties, repeated letters, letters at the rim."""
    rng = random.Random(seed)
    letters = "abé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 10))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaaaa", "bbbbbbb"]
    texts: list[str | None] = [None, "", " 1 2 ", "short ab Ab", "AAAAAAAA-BBBBBBB", "a" * 300 + " " + "a" * 300, "b" * 299 + " " + "b" * 300 + " " + "b" * 299 + "_" + "b" * 300]
    for w in base:
        texts += [w] * rng.choice([3, 30, 300])
        for _ in range(6):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            texts += [v] * rng.choice([1, 2, 3, 29, 30])
            j = rng.randrange(len(v) + 1)
            texts += [v[:j] + c + v[j:]] * 2
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_op11_equals_brute_force(spark, seed):
    rows = rows_of(misspelt(seed))
    rows += [rows[9], rows[9], (None, "nullkeyed nullkeyed", *REST)]
    got = variants.op11(frame(spark, rows)).collect()
    expected = expected_variants(rows)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected and len(got) == len(expected)
    assert any(r.form is not None and r.root != r.form for r in got)


def test_op11_of_nothing(spark):
    assert variants.op11(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.op11(frame(spark, rows_of([None, "", "no long ones"]))).count() == 0


def test_neighbourhood_is_whole_and_distinct():
    everything = variants.Filter(16, np.full(1 << 13, 255, np.uint8))
    alphabet = np.array([ord(c) for c in "abé"], np.uint32)
    for w in ("abba", "a", "ééé", "aabé" * 40):
        made = [c for _, c in variants.neighbourhood([w], alphabet, everything)]
        full = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abé"} - {w}
        assert len(made) == len(set(made)) and set(made) == full
    both = variants.hashes(["abba", "", "ba"])
    assert both[1] == 0 and both[0] != both[2]


def test_neighbourhood_of_a_long_word(monkeypatch):
    everything = variants.Filter(16, np.full(1 << 13, 255, np.uint8))
    alphabet = np.array([ord(c) for c in "ab"], np.uint32)
    words = ["ab" * 50, "ba" * 50, "abbaabb"]
    once = sorted(variants.neighbourhood(words, alphabet, everything))
    monkeypatch.setattr(variants, "AT_ONCE", 16)
    assert sorted(variants.neighbourhood(words, alphabet, everything)) == once


# 12

GOOD = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
BAD = "click buy cheap pills casino bonus winner $$$ !!! free offer act now >>> <<< ### order viagra jackpot limited deal".split()


def labelled(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.7)
        docs.append((i, " ".join(rng.choice(GOOD if q else BAD) for _ in range(rng.randrange(20, 200))), *REST))
        labels.append((i, q, "clash"))
    return docs, labels


LABELS = "doc_id long, quality int, text string"


def held(key: int | None) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 3 == 1


def test_op12_tells_held_out_classes_apart(spark):
    docs, labels = labelled(1, 400)
    docs += [(400, None, *REST), (401, "", *REST), (402, "the " * 60_000, *REST), (None, "the of and", *REST), docs[3], docs[3]]
    labels += [(None, 1, ""), (5, None, ""), (6, 7, ""), (9999, 0, ""), (labels[8][0], 1 - labels[8][1], "")]
    got = compression.op12(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d[0] for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    truth = {k: q for k, q, _ in labelled(1, 400)[1]}
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in judged) >= 0.98 * len(judged) and len(judged) > 80
    assert {r.doc_id: r.score for r in got}[400] == {r.doc_id: r.score for r in got}[401]


def test_op12_reads_no_held_out_label_and_no_other_column(spark):
    docs, labels = labelled(2, 200)
    one = {r.doc_id: r.score for r in compression.op12(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()}
    flipped = [(k, 1 - q if held(k) else q, t) for k, q, t in labels]
    other = [(d[0], d[1], "x", 9, 9, "x", "y", "z", 1 - labels[d[0]][1], 5, 5) for d in docs]
    assert one == {r.doc_id: r.score for r in compression.op12(frame(spark, other), spark.createDataFrame(flipped, LABELS)).collect()}


def test_op12_without_labels_or_a_class(spark):
    docs, labels = labelled(3, 60)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in compression.op12(frame(spark, docs), none).collect()} == {0.5}
    only = spark.createDataFrame([(k, 1, "") for k, _, _ in labels], LABELS)
    assert all(r.predicted == 1 for r in compression.op12(frame(spark, docs), only).collect())
    assert compression.op12(spark.createDataFrame([], SCHEMA), only).count() == 0


def test_op12_scores_are_those_of_the_model(spark):
    docs, labels = labelled(4, 120)
    d = frame(spark, docs)
    model = compression.fit(d, spark.createDataFrame(labels, LABELS))
    import zstandard

    def size(text: bytes, of: bytes) -> int:
        c = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(of), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + compression.BLOCK])) for i in range(0, len(text), compression.BLOCK))

    got = {r.doc_id: r.score for r in compression.score(d, model).collect()}
    for key, text, *_ in docs:
        x = text.encode()
        ratio = (size(x, model.bad) - size(x, model.good) + compression.PRIOR * model.average) / (len(x) + compression.PRIOR)
        assert got[key] == pytest.approx(1 / (1 + np.exp(-(model.slope * ratio + model.constant))), rel=1e-9, abs=1e-12)


def test_line_is_a_logistic_regression():
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000) * 0.01
    y = (rng.random(4000) < 1 / (1 + np.exp(-(300 * x + 1)))).astype(float)
    slope, constant = compression.line(x, y)
    assert slope == pytest.approx(300, rel=0.15) and constant == pytest.approx(1, abs=0.2)
    assert compression.line(-x, y)[0] == 0.0  # a line that falls is none
    assert compression.line(np.array([]), np.array([])) == (0.0, 0.0)


# 13


@pytest.fixture(scope="module")
def both():
    return align.tokenizers(align.BYTE_LEVEL, align.PIECES)


def aligned(both, texts: list[str | None]) -> list[tuple]:
    """Each text's row, by walking along both token lists."""
    found, corpus = [], collections.Counter()
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if b"".join(both.a_bytes[i] for i in a) != (" " + text).encode() if text else True:
            a = b = []
        elif b"".join(both.b_bytes[i] for i in b) != (" " + text).encode():
            a = b = []
        spans = []
        for ids, of in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(out)
        pairs = []
        lo = 0
        for s, e, i in spans[0]:
            while lo < len(spans[1]) and spans[1][lo][1] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][0] < e:
                pairs.append((i, spans[1][k][2]))
                k += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        for end in common:
            both_sides = []
            for k in (0, 1):
                first = at[k]
                while at[k] < len(spans[k]) and spans[k][at[k]][1] <= end:
                    at[k] += 1
                both_sides.append(",".join(str(i) for _, _, i in spans[k][first : at[k]]))
            groups.append("|".join(both_sides))
        corpus.update(pairs)
        found.append((a, b, groups, pairs))
    best = collections.defaultdict(int)
    for (_, i), n in corpus.items():
        best[i] = max(best[i], n)
    return [(len(a), len(b), len(g), len(p), sum(corpus[x] == best[x[1]] for x in p), sum(corpus[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, p in found]


HARD = [None, "", " ", "a", "  two  spaces\n\n\tand tabs ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "naïve ☃ 𝄞 日本語", "é   \r\n", "\0 nul", "1234567 it's we'll", "x" * 3000]


def test_op13_equals_a_walk_along_the_tokens(spark, both):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinéß☃") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts = [*HARD, *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)), "Same words again. " * 40, "Same words again. " * 40]
    texts.append(" ".join(rng.choice(words) for _ in range(16_000)))  # over several segments
    rows = rows_of(texts)
    got = sorted(align.op13(frame(spark, rows)).collect())
    assert [tuple(r)[1:] for r in got] == aligned(both, texts)
    assert got[6].n_a == 0 and got[6].groups_sha256 == "" and got[13].n_a > 0
    assert len(both.chunks(texts[-1])) > 2 * align.SEGMENT


def test_op13_of_nothing(spark):
    assert align.op13(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[1:] for r in align.op13(frame(spark, [(None, None, *REST)])).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_chunks_change_no_token(both):
    rng = random.Random(4)
    parts = ["word", "Word's", "  ", " ", "\n", "x1", "12", "é", "ß", "☃", ".", ",", "the", "<s>", "'", "_a", "'s", "\xa0", "\t", "…", "日本", "\0"]
    for i in range(600):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 30)))
        some = both.chunks(text)
        assert "".join(some) == " " + text and all(c[0] == " " for c in some)
        if i % 200 == 0:
            both.forget()
        number = both.numbers(some)
        assert both.gathered(0, number)[0].tolist() == both.a.encode(" " + text, add_special_tokens=False).ids
        assert both.gathered(1, number)[0].tolist() == both.b.encode(text)


def test_chunks_encoded_together_are_those_encoded_alone(both, monkeypatch):
    chunks = [f" w{i}x" for i in range(300)] + [" a\0b", " \uff46\uff55", " x\u0301\u00e9", " <s>", " ", " \tq", " z\u200bz"]
    real, texts = both.b, []

    class Counting:
        def encode(self, some, **more):
            texts.extend(some)
            return real.encode(some, **more)

    both.forget()
    monkeypatch.setattr(both, "b", Counting())
    number = both.numbers(chunks)
    assert len(texts) < len(chunks) / 2
    for c, i in zip(chunks, number.tolist(), strict=True):
        want = both.a.encode(c, add_special_tokens=False).ids, real.encode(c[1:])
        assert [both.gathered(side, np.array([i]))[0].tolist() for side in (0, 1)] == [*want]
        assert both.equal[i] == (b"".join(both.a_bytes[x] for x in want[0]) == c.encode() == b"".join(both.b_bytes[x] for x in want[1]))
    both.forget()


def test_shards_add_up_runs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40) << 32 | rng.randrange(30), rng.randrange(1, 9)) for _ in range(4000)]
    total = collections.Counter()
    for k, n in rows:
        total[k] += n
    made = align.shards(spark.createDataFrame(rows, "pair long, n long").repartition(5), 40)
    keys = np.array(sorted(total))
    assert made.lookup(keys, {}).tolist() == [total[k] for k in keys.tolist()]
    assert made.best.tolist() == [max(n for k, n in total.items() if k >> 32 == b) for b in range(40)]


# 10


def test_op10_verdicts_are_those_of_a_plain_walk(spark):
    from tidemill.llm import quality

    rng = random.Random(10)
    good = [" ".join(rng.choice(GOOD) for _ in range(rng.randrange(60, 200))).capitalize() + "." for _ in range(120)]
    bad = [" ".join(w.upper() + rng.choice(["!!", "###", "$"]) for w in rng.choices(GOOD, k=rng.randrange(60, 120))) for _ in range(30)]
    docs = rows_of([*good, *bad, None, "", "few words", "same words again " * 60, "x" * 100_000 + " y" * 80, good[0] + "\nshort line\n\nshort line\n"])
    labels = spark.createDataFrame([(i, int(i < 120), "") for i in range(150)], LABELS)
    d = frame(spark, docs)
    forest, cut = quality.calibrated(d, labels)
    got = {r.doc_id: r for r in quality.op10(d, labels).collect()}

    def path(tree, row) -> float:
        feature, at, left, right, length = tree
        node = 0
        while feature[node] >= 0:
            node = left[node] if row[feature[node]] <= at[node] else right[node]
        return length[node]

    for key, text, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = set()
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                repeated |= {i, i + 1, i + 2}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        chars = sum(map(len, words))
        marks = sum(1 for w in words for c in w if ord(c) < 128 and not c.isalnum())
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        again = len(lines) - len(set(lines))
        n = max(len(words), 1)
        row = [chars / n, sum(c in "#*$%&|<>" for c in text or "") / n, math.log1p(again), math.log1p(len(repeated)), marks / n]
        score = 2 ** (-sum(path(t, row) for t in forest.trees) / len(forest.trees) / quality.mean_path(forest.size))
        assert got[key].base_failed == failed and got[key].score == pytest.approx(score, rel=1e-9)
        assert got[key].kept == (not failed and got[key].score <= cut)
    assert sum(got[i].kept for i in range(120)) >= 118 and sum(got[i].kept for i in range(120, 150)) <= 3


def test_op10_learns_from_every_label(spark):
    """A kind of good document that only labels beyond the first 20,000, by the hash of the id, know."""
    from pyspark.sql import functions as F

    from tidemill.llm import quality

    order = [r.id for r in spark.range(24_000).orderBy(F.xxhash64("id"), "id").collect()]
    rng = random.Random(11)
    some = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(3000)]
    text = lambda tail: " ".join(w + tail for w in rng.choices(some, k=55))
    late = set(order[20_000:])
    junk = set(order[100:200])
    rows = [(i, text("###" if i in junk else "abcdefgh" if i in late else "")) for i in order]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in junk)) for i in order], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.op10(docs, labels).where("kept").select("doc_id").collect()}
    assert len(late & kept) > 0.95 * len(late) and len(junk & kept) < 5


def test_every_row_is_in_a_tree_and_in_none_twice():
    from tidemill.llm import quality

    for n in (1, 500, 40_000, 300_000):
        copies = quality.copies_of(n)
        rows, tree = quality.dealt(np.arange(n)[:, None], np.random.default_rng(n).integers(0, 2**63, n), copies)
        assert copies >= 1 and len(np.unique(rows[:, 0] * quality.TREES + tree)) == n * copies

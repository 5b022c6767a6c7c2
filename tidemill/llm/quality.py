"""Quality rules: rule statistics of each document, and an isolation forest over them calibrated on labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .textscan import IS_SPACE, SMALL, mix64, shingles, slices, twice

#: Characters that count as symbols (fixed by the rule).
SYMBOLS = b"#*$%&|<>"
#: Fixed limits of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Trees; rows that a tree gets at least, as far as there are so many, and that its depth is made for; seed of the splits.
TREES, PER_TREE, SEED = 100, 2048, 7
#: Growing rows of a task.
PER_TASK = 20_000
#: Share of good labelled documents that the threshold may reject.
GOOD_LOST = 0.004
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Columns of features().
FEATURES = 5
_COUNTS = [x.split()[0] for x in STATS.split(", ")] + ["n_punct"]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, STATS, and n_punct (ASCII marks inside words) for each row, over whole texts.

    n_words: runs of characters other than white space. word_chars: code points in words. n_symbols: characters of
    SYMBOLS. n_dup_lines: lines (split at newline) with a word that equal an earlier line of the text.
    n_repeat_words: words in 3-word windows that the text has twice or more. A null text has zeros everywhere.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_statistics(s) for s in slices(batch.column(1), SMALL)]
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    schema = f"{key} {dict(docs.dtypes)[key]}, {STATS}, n_punct long"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(key, text).mapInArrow(scan, schema)


def _statistics(s) -> list[np.ndarray]:
    buf, offs = s.buf, s.offs

    def per_row(flag: np.ndarray) -> np.ndarray:
        run = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flag, out=run[1:])
        return run[offs[1:]] - run[offs[:-1]]

    solid = ~IS_SPACE[buf]
    start, end, row = s.spans()
    n_words = np.bincount(row, minlength=s.n)
    chars = per_row(solid & ((buf & 0xC0) != 0x80))
    punct = per_row(solid & (buf < 128) & ~(((buf | 32) >= 97) & ((buf | 32) <= 122)) & ~((buf >= 48) & (buf <= 57)))
    # lines: between newlines and the ends of texts
    breaks = np.flatnonzero(buf == 10)
    a = np.concatenate([offs[:-1], breaks + 1])
    order = np.argsort(a, kind="stable")
    # an empty text shares its offset with the next; its line is empty and counts for nothing
    at = np.concatenate([np.arange(s.n), np.searchsorted(offs, breaks, side="right") - 1])[order]
    a = a[order]
    b = np.minimum(np.append(a[1:], len(buf)), offs[at + 1])
    ends = np.where(np.isin(b - 1, breaks) & (b - 1 >= a), b - 1, b) if len(breaks) else b
    run = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=run[1:])
    ends = np.maximum(ends, a)
    full = run[ends] > run[a]
    a, ends, at = a[full], ends[full], at[full]
    line = mix64(s.hashes(a, ends) ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(line, kind="stable")
    again = order[1:][line[order][1:] == line[order][:-1]]
    dup_lines = np.bincount(at[again], minlength=s.n)
    # words in windows that the text has again
    words = s.hashes(start, end)
    covered = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        inside = np.flatnonzero(row[:-2] == row[2:])
        h, r = shingles(words, row, s.n, 3)
        n = np.bincount(row, minlength=s.n)
        h, r = h[n[r] >= 3], r[n[r] >= 3]
        hit = inside[twice(mix64(h ^ (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))]
        for j in range(3):
            covered[hit + j] = True
    repeat = np.bincount(row[covered[: len(row)]], minlength=s.n)
    return [x.astype(np.int64) for x in (n_words, chars, per_row(_IS_SYMBOL[buf]), dup_lines, repeat, punct)]


def features(d: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's view: mean word, symbols and marks a word, logarithms of repeated lines and repeated words.

    Rates of repetition fall with length, and their few high values part good rows early; as logarithms of counts both
    statistics stay in without that. Grown, calibrated and judged on a third each of the labelled rows of sf0.1 that
    pass the base rule, the forest rejects 0.995 of the bad rows and 0.003 to 0.005 of the good ones (mean of four
    draws, a forest of at most 20,000 labels); with shares in place of logarithms it rejects 0.84 to 0.87 of the bad ones.
    """
    n = np.maximum(d["n_words"], 1)
    again = np.log1p(d["n_dup_lines"]), np.log1p(d["n_repeat_words"])
    return np.column_stack([d["word_chars"] / n, d["n_symbols"] / n, *again, d["n_punct"] / n]).astype(float)


@dataclass
class Nodes:
    """Trees while they grow: node t is the root of tree t; those from fresh on are of the last level. A feature of -1 ends a path."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    fresh: int = 0

    def reached(self, rows: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """The node of each row in its tree."""
        at, every = tree.astype(np.int64), np.arange(len(rows))
        while (self.feature[at] >= 0).any():
            f = self.feature[at]
            below = rows[every, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f < 0, at, np.where(below, self.left[at], self.right[at]))
        return at

    def spans(self, rows: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each node of the last level that has rows: the node, their number, least and greatest value of each feature."""
        at = self.reached(rows, tree)
        rows, at = rows[at >= self.fresh], at[at >= self.fresh]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        if not len(start):
            return at, at, rows, rows
        return at[start], np.diff(np.append(start, len(at))), np.minimum.reduceat(rows, start, axis=0), np.maximum.reduceat(rows, start, axis=0)


class Forest:
    """Isolation trees over random splits: a row's score is high where few splits part it from the others.

    Trees grow level by level from spans(), the number of rows and the range of each feature of every node of the last
    level, so the rows stay where they are. size is the mean number of rows of a tree.
    """

    def __init__(self, size: int, spans: Callable[[Nodes], tuple[np.ndarray, ...]]):
        self.size, rng = size, np.random.default_rng(SEED)
        self.depth = max(1, int(np.ceil(np.log2(max(min(size, PER_TREE), 2)))))
        ints = lambda n, x: np.full(n, x, np.int64)
        t = Nodes(ints(TREES, -1), np.zeros(TREES), ints(TREES, 0), ints(TREES, 0), np.zeros(TREES), np.arange(TREES))
        for level in range(self.depth + 1):
            at, n, lo, hi = spans(t)
            t.length[at] = level + mean_path(n)
            some = np.flatnonzero((n > 1) & (hi > lo).any(axis=1)) if level < self.depth and len(at) else []
            if not len(some):
                break
            at, lo, hi = at[some], lo[some], hi[some]
            # one of the features that differ within the node, and a cut inside its range
            nth = np.cumsum(hi > lo, axis=1)
            f = np.argmax(nth > (rng.random(len(at)) * nth[:, -1]).astype(int)[:, None], axis=1)
            every, born = np.arange(len(at)), 2 * len(at)
            t.cut[at] = lo[every, f] + (hi - lo)[every, f] * rng.random(len(at))
            t.fresh = len(t.feature)
            t.feature[at], t.left[at], t.right[at] = f, t.fresh + 2 * every, t.fresh + 2 * every + 1
            t.feature, t.left, t.right = (np.append(x, ints(born, e)) for x, e in ((t.feature, -1), (t.left, 0), (t.right, 0)))
            t.cut, t.length, t.owner = np.append(t.cut, np.zeros(born)), np.append(t.length, np.full(born, level + 1.0)), np.append(t.owner, np.repeat(t.owner[at], 2))
        place = np.empty(len(t.owner), np.int64)
        self.trees = []
        for tree in range(TREES):
            mine = np.flatnonzero(t.owner == tree)
            place[mine] = np.arange(len(mine))
            self.trees.append((t.feature[mine], t.cut[mine], place[t.left[mine]], place[t.right[mine]], t.length[mine]))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that are parted early."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                below = rows[every, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(mean_path(self.size), 1e-9))


def mean_path(n) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)))


def dealt(rows: np.ndarray, h: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as often as trees get them, and the trees: `copies` different ones for each row, told by its hash h."""
    steps = np.array([x for x in range(1, TREES + 1) if gcd(x, TREES) == 1])
    h = h.astype(np.uint64)
    first, step = (h >> np.uint64(8)) % np.uint64(TREES), steps[((h >> np.uint64(32)) % np.uint64(len(steps))).astype(int)]
    tree = (first.astype(np.int64)[:, None] + np.arange(copies) * step[:, None]) % TREES
    return np.repeat(rows, copies, axis=0), tree.ravel()


def copies_of(n: int) -> int:
    """Trees that each of n rows goes to: one at least, so every row is in the forest, and as many as give a tree PER_TREE rows."""
    return int(np.clip(-(-TREES * PER_TREE // max(n, 1)), 1, TREES))


def counted(scores: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in order, and the good and bad rows that have each."""
    cuts, at = np.unique(scores, return_inverse=True)
    return cuts, np.bincount(at, good, len(cuts)).astype(np.int64), np.bincount(at, ~good, len(cuts)).astype(np.int64)


def best_cut(cuts: np.ndarray, ok: np.ndarray, bad: np.ndarray, before: tuple[int, int], total: tuple[int, int]) -> tuple[float, float] | None:
    """The share of correct verdicts of the best of these cuts, and that cut: of equally good ones the highest, which rejects least.

    Only cuts above which at most GOOD_LOST of all good rows lie count. before and total: good and bad rows below the
    first cut, and all.
    """
    kept, passed = before[0] + np.cumsum(ok), before[1] + np.cumsum(bad)
    fine = kept >= np.ceil(total[0] * (1 - GOOD_LOST))
    if not fine.any():
        return None
    right = np.where(fine, kept / total[0] + 1 - passed / max(total[1], 1), -1)
    i = len(cuts) - 1 - int(np.argmax(right[::-1]))
    return float(right[i]), float(cuts[i])


def fit(labelled: np.ndarray, quality: np.ndarray) -> tuple[Forest | None, float]:
    """calibrated() for rows of features() that are at hand, by the same steps."""
    h = mix64(np.arange(len(labelled), dtype=np.uint64))
    good, growing = quality == 1, h % np.uint64(2) == 0
    grow, rest = good & growing, (good & ~growing) | (quality == 0)
    if not grow.any() or not (good & ~growing).any():
        return None, np.inf
    copies = copies_of(int(grow.sum()))
    rows, tree = dealt(labelled[grow], h[grow], copies)
    forest = Forest(round(len(rows) / TREES), lambda nodes: nodes.spans(rows, tree))
    cuts, ok, bad = counted(forest.score(labelled[rest]), good[rest])
    return forest, best_cut(cuts, ok, bad, (0, 0), (int(ok.sum()), int(bad.sum())))[1]


def calibrated(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[Forest | None, float]:
    """A forest grown on one half of the good labelled rows that pass the base rule, and the score above which a row is rejected.

    All labelled rows count. Which half a row is in, and which trees get it, the hash of its id tells; every row of the
    first half is in at least one tree. The threshold comes from the other half and the bad rows, none of which the
    forest has seen: the highest share of correct verdicts among the cuts that reject at most GOOD_LOST of those good
    rows. Without good rows in both halves there is no forest and nothing is rejected.

    Ids and label values that are null are not used; of an id labelled twice the lower label counts. Of rows that
    share a labelled id the one with the smallest statistics is used.
    """
    return _calibrated(statistics(docs, key, text), labels, key, quality)


def _calibrated(stats: DataFrame, labels: DataFrame, key: str, quality: str) -> tuple[Forest | None, float]:
    """calibrated() from statistics(): they are joined to the labels as numbers, no text is moved.

    To the driver come, each level, at most two nodes for each of the last, 2 * PER_TREE a tree; of the scores a line for each partition.
    """
    label = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(quality).alias("_q"))
    once = stats.join(label, F.col(key) == F.col("_k")).groupBy("_k").agg(F.min(F.struct(*_COUNTS)).alias("s"), F.min("_q").alias("_q"))
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    known = keep(once.select(F.xxhash64("_k").alias("h"), (F.col("_q") == 1).alias("good"), "s.*", "_q").where(passed & F.col("_q").isin(0, 1)).drop("_q"))
    growing = F.col("good") & (F.pmod("h", F.lit(2)) == 0)
    n = known.agg(*(F.count_if(c).alias(x) for x, c in (("grow", growing), ("ok", F.col("good") & ~growing), ("bad", ~F.col("good"))))).first()
    if not n["grow"] or not n["ok"]:
        return None, np.inf
    context, copies = stats.sparkSession.sparkContext, copies_of(n["grow"])
    # tasks of so many rows that nodes are mostly summed up inside them
    shares = known.where(growing).coalesce(max(1, n["grow"] // PER_TASK))
    names = [f"{side}{i}" for side in ("lo", "hi") for i in range(FEATURES)]

    def spans(nodes: Nodes) -> tuple[np.ndarray, ...]:
        shared = context.broadcast(nodes)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, m, lo, hi = shared.value.spans(*dealt(features(_columns(batch)), batch.column("h").to_numpy(), copies))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (at, m)), *map(pa.array, lo.T), *map(pa.array, hi.T)], names=["at", "m", *names])

        rows = shares.mapInArrow(local, "at long, m long, " + ", ".join(f"{c} double" for c in names))
        got = rows.groupBy("at").agg(F.sum("m").alias("m"), *((F.min if c.startswith("lo") else F.max)(c).alias(c) for c in names)).toPandas().sort_values("at")
        shared.unpersist()
        lo, hi = (got[[c for c in names if c.startswith(side)]].to_numpy() for side in ("lo", "hi"))
        return got["at"].to_numpy(), got["m"].to_numpy(), lo, hi

    forest = Forest(round(n["grow"] * copies / TREES), spans)
    shared = context.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(features(_columns(batch)))), batch.column("good")], names=["x", "good"])

    # equal scores are in one partition
    scored = keep(known.where(~growing).mapInArrow(score, "x double, good boolean").repartitionByRange("x"))

    def each(use: Callable[[tuple, int], list], schema: str) -> list:
        """A row, if any, that use() makes of the counts by score of each partition, and its number."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = pa.Table.from_batches([*batches], pa.schema([("x", pa.float64()), ("good", pa.bool_())]))
            if len(found):
                got = use(counted(found["x"].to_numpy(), found["good"].to_numpy()), TaskContext.get().partitionId())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], names=[c.split()[0] for c in schema.split(", ")])

        return scored.mapInArrow(scan, schema).collect()

    parts = sorted(each(lambda c, i: [float(c[0][0]), i, int(c[1].sum()), int(c[2].sum())], "x double, i long, ok long, bad long"))
    before, so_far = {}, (0, 0)
    for r in parts:
        before[r.i] = so_far
        so_far = so_far[0] + r.ok, so_far[1] + r.bad
    best = each(lambda c, i: best_cut(*c, before[i], so_far) or [-1.0, 0.0], "right double, cut double")
    return forest, max(best).cut


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy() for c in _COUNTS}


def _verdict(d: dict[str, np.ndarray], forest: Forest | None, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (d["n_words"] < MIN_WORDS) | (100 * d["n_repeat_words"] > MAX_REPEAT_PERCENT * d["n_words"])
    score = forest.score(features(d)) if forest and len(failed) else np.zeros(len(failed))
    return failed, score, ~failed & (score <= cut)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """key, STATS, base_failed, score, kept for each row of docs.

    A document fails the base rule with under MIN_WORDS words or over MAX_REPEAT_PERCENT percent repeated words.
    Otherwise the isolation forest of calibrated() decides: a score above the threshold is a rejection. Every
    document is judged on all of its text, which is read once. Null or empty texts fail the base rule; repeated rows get equal
    verdicts; other columns are ignored; an empty table gives no rows.
    """
    stats = keep(statistics(docs, key, text))
    forest, cut = _calibrated(stats, labels, key, quality)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != key}
            out = [*(batch.column(i) for i in range(6)), *map(pa.array, _verdict(d, forest, cut))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:6], "base_failed", "score", "kept"])

    return stats.mapInArrow(verdicts, f"{key} {dict(stats.dtypes)[key]}, {STATS}, base_failed boolean, score double, kept boolean")


def passing(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that judge() keeps."""
    forest, cut = calibrated(docs, labels, key, text, quality)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_statistics(s) for s in slices(batch.column(text), SMALL)]
            if found:
                d = dict(zip(_COUNTS, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))
                yield batch.filter(pa.array(_verdict(d, forest, cut)[2]))

    return docs.mapInArrow(good, docs.schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the forest's score."""
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")

"""Benchmark decontamination: CGK walks of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .textscan import LOWER, Slice, mix64, shingles, slices

#: A window matches an item of n words with at most n * EDITS // 100 word insertions, deletions and replacements.
EDITS = 20
#: Most words of the seeds that a window must share with an item; items of few words have shorter ones.
SEED_WORDS = 3
#: Chance that a window at the greatest distance meets its item in some table, on TRIALS trials; the number of walks follows from it.
RECALL, TRIALS = 0.999, 1000
#: Symbols sampled for one key, keys taken from one walk, and the most walks: where they fall short, all pairs that share a seed are verified.
SAMPLED, PER_WALK, MOST_WALKS = 2, 24, 48
#: The items are taken in blocks of at most so many bytes of text, so that what is broadcast is bounded: at most about MOST_WALKS * PER_WALK keys an item.
BLOCK_BYTES = 4 << 20
#: Words of windows that are laid out at once.
AT_ONCE = 1 << 20
#: Stands for the words that a window at a text's edge lacks.
LACKING = np.uint64(1)
#: A-Z in lower case, and ASCII marks as white space.
FOLD = LOWER.copy()
FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return n * EDITS // 100


def seed_words(n: int, k: int) -> int:
    """Words of the seeds for items of n words within k edits: the most, up to SEED_WORDS, of which one must be left."""
    return max(w for w in range(1, SEED_WORDS + 1) if w == 1 or seeds_needed(n, k, w) >= 1)


def seeds_needed(n: int, k: int, w: int) -> int:
    """Seeds of w words that a window of n words within k edits of an item shares with it at least."""
    return n - w + 1 - k * w


def reach(n: int) -> int:
    """Steps in which a walk over n words still has words: it goes on in half of them."""
    return max(1, 3 * n * 5 // 9)


def walks(words: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding: the first outputs of 3n for each row of n words; a fixed random bit of step and word says whether to go on.

    Outputs past reach() are mostly padding, in which everything agrees: they are neither sampled nor made.
    """
    rows, n = words.shape
    padded = np.concatenate([words, np.zeros((rows, 1), np.uint64)], axis=1)
    bits = mix64(np.arange(3 * n, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 17)) | np.uint64(1)
    at, every = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, reach(n)), np.uint64)
    for j in range(reach(n)):
        out[:, j] = now = padded[every, at]
        at = np.minimum(at + ((now * bits[j]) >> np.uint64(63)).astype(np.int64), n)
    return out


def keys_of(words: np.ndarray, w: int) -> np.ndarray:
    """PER_WALK bucket keys from walk w: hashes of SAMPLED sampled outputs, one column a table."""
    walk = walks(words, w)
    picks = np.random.default_rng((w, 3 * words.shape[1])).integers(0, reach(words.shape[1]), (PER_WALK, SAMPLED))
    out = np.empty((len(words), PER_WALK), np.uint64)
    for t, pick in enumerate(picks):
        h = np.full(len(words), w * PER_WALK + t + 1, np.uint64)
        for p in pick:
            h = mix64(h ^ walk[:, p])
        out[:, t] = h
    return out


def distances(a: np.ndarray, b: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Edit distance between the words of each row of a, or the first size of them, and of b, both of n columns."""
    rows, n = a.shape
    size = np.full(rows, n) if size is None else size
    out = np.full(rows, n, np.int32)
    ramp = np.arange(n + 1, dtype=np.int32)
    last = np.tile(ramp, (rows, 1))
    for i in range(n):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (b != a[:, i : i + 1]))
        last = np.minimum.accumulate(now - ramp, axis=1) + ramp
        done = size == i + 1
        out[done] = last[done, -1]
    return out


def _walks_needed(items: np.ndarray, k: int) -> int:
    """Walks for RECALL at k random edits, and at k words lacking in front or behind, from trials on the items themselves.

    Half as many again as the trials ask for, as other edits may be harder; 0 if MOST_WALKS do not reach it: then no
    key is to decide.
    """
    if k == 0:
        return 1
    n = items.shape[1]
    rng = np.random.default_rng(len(items) * 31 + k)
    base = items[rng.integers(0, len(items), TRIALS)]
    edited = []
    for row, what, new in zip(base.tolist(), rng.integers(0, 3, (TRIALS, k)).tolist(), rng.integers(1, 1 << 62, (TRIALS, k)).tolist(), strict=True):
        for j in range(k):
            at = int(rng.integers(0, len(row) + 1))
            if what[j] == 0 or at == len(row):
                row.insert(at, new[j])
            elif what[j] == 1:
                del row[at]
            else:
                row[at] = new[j]
        edited.append((row + [1] * n)[:n])
    front, behind = base.copy(), base.copy()
    front[:, :k] = behind[:, -k:] = LACKING
    variants = [np.array(edited, np.uint64), front, behind]
    met = np.zeros((len(variants), TRIALS), bool)
    for w in range(MOST_WALKS):
        own = keys_of(base, w)
        for i, x in enumerate(variants):
            met[i] |= (own == keys_of(x, w)).any(axis=1)
        if met.mean(axis=1).min() >= RECALL:
            return w + 1 + (w + 1) // 2
    return 0


class Items:
    """An index of one block of benchmark items, small enough to go to every task."""

    def __init__(self, ids: list, texts: list[str]):
        by_size: dict[int, list] = {}
        for s in slices(pa.array(texts, pa.string())):
            words, row = _words(s)
            cut = np.searchsorted(row, np.arange(s.n + 1))
            for i in range(s.n):
                if cut[i + 1] > cut[i]:
                    by_size.setdefault(int(cut[i + 1] - cut[i]), []).append((s.first + i, words[cut[i] : cut[i + 1]]))
        self.ids = ids
        # for each length of seeds: the seeds of all items, and a filter of their first bits
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sizes = []
        for n, rows in sorted(by_size.items()):
            k = allowed(n)
            at, words, w = np.array([r for r, _ in rows]), np.array([x for _, x in rows]), seed_words(n, k)
            own = np.unique(shingles(words.ravel(), np.repeat(np.arange(len(words)), n), len(words), w)[0])
            n_walks = _walks_needed(words, k)
            table = np.hstack([keys_of(words, x) for x in range(n_walks)]) if n_walks else np.zeros((len(words), 0), np.uint64)
            order = np.argsort(table, axis=0).astype(np.int32)
            self.sizes.append((n, k, w, own, n_walks, at, words, np.take_along_axis(table, order.astype(np.int64), axis=0), order))
        for w in {x[2] for x in self.sizes}:
            every = np.unique(np.concatenate([x[3] for x in self.sizes if x[2] == w]))
            maybe = np.zeros(1 << 22, bool)
            maybe[every >> np.uint64(42)] = True
            self.seeds[w] = every, maybe

    def search(self, s: Slice) -> tuple[np.ndarray, ...]:
        """row, item, edits, first word, item words: for each text and item that match, the nearest window.

        At a text's edges windows are also shorter, by up to as many words as may be edited. The bound on seeds holds
        for them too: it counts those of the item that so many edits leave.
        """
        words, row = _words(s)
        found = []
        for w, (every, maybe) in self.seeds.items():
            found += self._with_seeds(w, every, maybe, words, row, s.n)
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        start, item, edits, size = (np.concatenate(c) for c in zip(*found, strict=True))
        first = np.searchsorted(row, row[start])
        order = np.lexsort((start, edits, item, row[start]))
        r, i = row[start][order], item[order]
        best = order[np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
        return row[start[best]] + s.first, item[best], edits[best], (start - first)[best], size[best]

    def _with_seeds(self, w: int, every: np.ndarray, maybe: np.ndarray, words: np.ndarray, row: np.ndarray, n_rows: int) -> list[tuple]:
        """first word (in words), item, edits, item words of the windows that match items whose seeds have w words."""
        at = np.flatnonzero(row[: max(0, len(row) - w + 1)] == row[w - 1 :]) if len(row) >= w else np.zeros(0, np.int64)
        h, r = shingles(words, row, n_rows, w)
        h = h[np.bincount(row, minlength=n_rows)[r] >= w]
        near = np.flatnonzero(maybe[h >> np.uint64(42)])
        near = near[every[np.minimum(np.searchsorted(every, h[near]), len(every) - 1)] == h[near]]
        mark, seed = np.zeros(len(words), bool), np.zeros(len(words), np.uint64)
        mark[at[near]], seed[at[near]] = True, h[near]
        sizes = [x for x in self.sizes if x[2] == w]
        # only rows with as many seeds as the least demanding size needs are looked at again
        likely = np.flatnonzero((np.bincount(row[mark], minlength=n_rows) >= min(seeds_needed(x[0], x[1], w) for x in sizes))[row])
        words, row, mark, seed = words[likely], row[likely], mark[likely], seed[likely]
        found = []
        ends = np.cumsum(np.bincount(row, minlength=n_rows))
        places = np.flatnonzero(mark)
        for n, k, _, own, n_walks, ids, items, table, order in sizes if len(places) else ():
            seen = places[own[np.minimum(np.searchsorted(own, seed[places]), len(own) - 1)] == seed[places]]
            if not len(seen):
                continue
            hit = np.zeros(len(words) + 1, np.int64)
            hit[seen + 1] = 1
            run = np.cumsum(hit)
            need = seeds_needed(n, k, w)
            # a window that counts begins less than n words before a seed
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(seen - n + 1, 0), 1)
            np.add.at(near, seen + 1, -1)
            p = np.flatnonzero(np.cumsum(near)[: max(0, len(words) - n + 1)])
            p = p[(row[p] == row[p + n - 1]) & (run[p + n - w + 1] - run[p] >= need)]
            begin, length, front = self._edges(np.unique(row[seen]), ends, n, k)
            # seeds lie wholly inside the window
            good = run[np.maximum(begin + length - w + 1, begin)] - run[begin] >= need
            begin, length, front = (np.concatenate([x, y[good]]) for x, y in zip((p, np.full(len(p), n), np.zeros(len(p), np.int64)), (begin, length, front), strict=True))
            step = max(1, AT_ONCE // max(n, PER_WALK * max(1, n_walks)))
            for lo in range(0, len(begin), step):
                p, item, edits, size = self._match(*(x[lo : lo + step] for x in (begin, length, front)), n, k, n_walks, ids, items, table, order, words)
                found.append((likely[p], item, edits, size))
        return found

    @staticmethod
    def _edges(rows: np.ndarray, ends: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, words and words lacking in front, of the windows at the edges of texts that lack 1 to k of n words."""
        stop = np.repeat(ends[rows], k)
        start = np.repeat(np.concatenate([[0], ends])[rows], k)
        length = np.tile(n - 1 - np.arange(k), len(rows))
        fits = (length > 0) & (length <= stop - start)
        start, stop, length = start[fits], stop[fits], length[fits]
        return np.concatenate([start, stop - length]), np.concatenate([length, length]), np.concatenate([n - length, np.zeros(len(length), np.int64)])

    @staticmethod
    def _match(p, length, front, n, k, n_walks, ids, items, table, order, words):
        at = np.arange(n) - front[:, None]
        windows = np.where((at >= 0) & (at < length[:, None]), words[np.clip(p[:, None] + at, 0, len(words) - 1)], LACKING)
        pairs = [] if n_walks else [np.arange(len(windows) * len(items))]
        for x in range(n_walks):
            own = keys_of(windows, x)
            for t in range(PER_WALK):
                column, by = table[:, x * PER_WALK + t], order[:, x * PER_WALK + t]
                a, b = np.searchsorted(column, own[:, t], "left"), np.searchsorted(column, own[:, t], "right")
                for j in range(int((b - a).max(initial=0))):
                    w = np.flatnonzero(a + j < b)
                    pairs.append(w * len(items) + by[a[w] + j])
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        w, i = pairs // len(items), pairs % len(items)
        # the words that are there, from the left
        there = lambda x: words[np.minimum(p[x][:, None] + np.arange(n), len(words) - 1)]
        step = max(1, AT_ONCE // n)
        d = np.concatenate([distances(there(w[x : x + step]), items[i[x : x + step]], length[w[x : x + step]]) for x in range(0, len(w), step)]) if len(w) else np.zeros(0, np.int32)
        good = d <= k
        return p[w[good]], ids[i[good]], d[good].astype(np.int64), np.full(int(good.sum()), n)


def _words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and their rows."""
    s = Slice(s.first, FOLD[s.buf], s.offs)
    start, end, row = s.spans()
    return s.hashes(start, end), row


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for one in items.where(F.col(text).isNotNull()).select(key, text).orderBy(key, text).toLocalIterator():
        if size + len(one[1]) > BLOCK_BYTES and ids:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(one[0])
        texts.append(one[1])
        size += 4 * len(one[1])
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """key, item_key, n_edits, n_item_words, first_word: each pair of a row and an item that it holds.

    Words are runs of characters other than white space and ASCII marks, in lower case. A row holds an item if some
    window of as many words, or a shorter one at an edge of the text, is within allowed() edits of it; the nearest window is reported, of equally near ones
    the first. Every window of every text that shares enough seeds with the items (runs of up to SEED_WORDS words, by
    a bound that no window within the distance can miss) is embedded, its keys are looked up, and the pairs that
    meet are verified exactly. Items are searched in bounded blocks against all rows; rows are never shuffled.

    Null and empty texts hold nothing, and items without words are held by nothing; repeated
    rows and items are each reported; other columns are ignored; empty tables give no rows.
    """
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"{key} {kinds[0]}, {item_key} {kinds[1]}, n_edits long, n_item_words long, first_word long"
    item_type = items.select(item_key).schema[0].dataType
    parts = []
    for block in _blocks(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            index, kind = shared.value, to_arrow_type(item_type)
            for batch in batches:
                for s in slices(batch.column(1)):
                    row, item, edits, first, size = index.search(s)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item], kind), pa.array(edits), pa.array(size.astype(np.int64)), pa.array(first.astype(np.int64))], names=[key, item_key, "n_edits", "n_item_words", "first_word"])

        parts.append(docs.select(key, text).mapInArrow(scan, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    # with several blocks each one's pairs are written, so that no task holds more than one block
    return reduce(DataFrame.union, map(keep, parts)) if len(parts) > 1 else parts[0]


def clean(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item in the sense of leaks()."""
    for block in _blocks(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for s in slices(batch.column(text)):
                    good[shared.value.search(s)[0]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document with each benchmark item that it holds."""
    return leaks(docs, items)

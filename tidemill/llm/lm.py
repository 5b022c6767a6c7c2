"""Scores of a small causal self-attention model over subword ids, and of a word unigram model beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, keep
from .textscan import SMALL, slices

#: Where the public tokenizer lies; a parameter of scores().
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Classes of ids, those of one id only among them; width of the model; half of a context window. Inside a class counts decide, so these say how much the attention does.
CLASSES, ALONE, WIDTH, HALF = 192, 160, 16, 16
#: Contexts: so many of the commonest ids are told apart as the last one, the others by class.
CONTEXTS = 512
#: Rounds of local training and averaging, each over another share of the training texts; rate and batch of the local steps.
ROUNDS, RATE, BATCH = 4, 0.02, 64
#: Ids that are laid out as windows at once, or those of one text; half windows that are scored at once, which a core's cache holds.
IDS, AT_ONCE = 1 << 18, 32
LOG2E = np.float32(np.log2(np.e))
#: Places whose logits are made, used and given up at once, so that they stay in a core's cache; rows of one matrix product, for which BLAS copies nothing.
PLACES, ROWS = 512, 256
#: So many of the commonest training words are looked up in every task; the others meet their counts in a join.
FREQUENT = 20_000
#: Words that are encoded in one string; words whose ids a worker remembers, besides those of one slice.
TOGETHER, REMEMBERED = 64, 1 << 19
#: Words, or pairs of ids, that a task adds up before it hands them on.
TALLIED = 1 << 19
#: How words, by hash, and the times that a text has them are written.
WORD, TIMES = np.dtype("<i8"), np.dtype("<i4")
#: Weight of the coarser distribution in smoothed ones.
PRIOR = 5.0
#: Documents with this remainder of crc32(id) by FOLDS are held out.
FOLDS, HELD_OUT = 7, 2
#: The id that begins and ends a text (that of </s>).
END = 2


class Subwords:
    """Texts as ids: lower-cased words, each with a space before it, then END."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.encoder.get_piece_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.begins = np.array([self.encoder.id_to_piece(i).startswith("\u2581") for i in range(self.size)])
        self.forget()

    def forget(self) -> None:
        """Words that are known, by hash and in order; where their ids begin in store, and how many each has."""
        self.known, self.begin, self.sizes, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def look_up(self, distinct: np.ndarray, spelt: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Places among the known words of distinct ones, by hash and in order; those that are new are encoded, spelt by their places in distinct."""
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = self.known[np.minimum(at, len(self.known) - 1)] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            flat, sizes = self.encode(spelt(np.flatnonzero(new)))
            self.known, self.begin, self.sizes = (np.insert(x, at[new], y) for x, y in ((self.known, distinct[new]), (self.begin, len(self.store) + np.cumsum(sizes) - sizes), (self.sizes, sizes)))
            self.store = np.concatenate([self.store, flat.astype(self.kind)])
            at += np.cumsum(new) - new
        return at

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and how many each has.

        Words are encoded some TOGETHER, with spaces between them, which no piece crosses. Where the ids do not show as
        many beginnings as there are words, as characters that become spaces may cause, each word is encoded alone.
        """
        runs = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        got = self.encoder.encode([" ".join(run) for run in runs], num_threads=1)
        total = sum(map(len, got))
        flat = np.fromiter(chain.from_iterable(got), np.int64, total)
        ends = np.cumsum([0, *map(len, got)])
        starts = np.concatenate([[0], np.cumsum(self.begins[flat])])
        wrong = np.flatnonzero(starts[ends[1:]] - starts[ends[:-1]] != [len(run) for run in runs])
        # the first id of a run must be a beginning too
        wrong = np.union1d(wrong, [i for i, x in enumerate(got) if not x or not self.begins[x[0]]]).astype(int)
        if not len(wrong):
            return flat, np.diff(np.append(np.flatnonzero(self.begins[flat]), total))
        ids, sizes = [], []
        for i, run in enumerate(runs):
            own = self.encoder.encode(run, num_threads=1) if i in set(wrong.tolist()) else None
            mine = flat[ends[i] : ends[i + 1]] if own is None else np.fromiter(chain.from_iterable(own), np.int64)
            ids.append(mine)
            sizes.append(np.diff(np.append(np.flatnonzero(self.begins[mine]), len(mine))) if own is None else np.array([len(x) for x in own], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def read(self, column: pa.Array) -> Iterator[tuple]:
        """For each slice: its rows; row and place among the distinct words of each word, those words; ids, END after each row, and their number by row."""
        for s in slices(column, SMALL):
            s = s.lower()
            start, end, row = s.spans()
            words = s.hashes(start, end)
            order = np.argsort(words)
            fresh = np.concatenate([[True], words[order][1:] != words[order][:-1]]) if len(words) else np.zeros(0, bool)
            at, back = order[fresh], np.empty(len(words), np.int64)
            distinct, back[order] = words[at], np.cumsum(fresh) - 1
            data = s.buf.tobytes()
            first, last = start[at], end[at]
            known = self.look_up(distinct, lambda which, data=data, first=first, last=last: [data[a:b].decode("utf-8", "replace") for a, b in zip(first[which].tolist(), last[which].tolist(), strict=True)])[back]
            n = self.sizes[known]
            ids = self.store[np.repeat(self.begin[known] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            of = np.repeat(row, n)
            # one END behind each row
            cut = np.searchsorted(of, np.arange(1, s.n + 1))
            yield s.n, row, back, distinct, np.insert(ids, cut, END), np.bincount(of, minlength=s.n) + 1


_loaded: dict[int, Subwords] = {}


def _subwords(model: bytes) -> Subwords:
    if hash(model) not in _loaded:
        _loaded.clear()
        _loaded[hash(model)] = Subwords(model)
    return _loaded[hash(model)]


def read(docs: DataFrame, path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, id, held, n_tokens, words, ids for each row, written to the shared folder: texts are read and split once.

    rid tells rows apart and is fixed by the writing. words holds the distinct words of the text, by hash, times how
    often it has each; ids its subword ids and END, two or four bytes each.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), held.alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"rid long, id {dict(docs.dtypes)[key]}, held boolean, n_tokens long, words binary, times binary, ids binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _subwords(model.value)
        for batch in batches:
            done = 0
            for n, row, back, distinct, ids, n_ids in reader.read(batch.column(3)):
                pair, times = np.unique(row * max(1, len(distinct)) + back, return_counts=True)
                of, word = pair // max(1, len(distinct)), distinct[pair % max(1, len(distinct))]
                ends = np.searchsorted(of, np.arange(n + 1))
                packed = _packed(word.view(WORD), ends), _packed(times.astype(TIMES), ends), _packed(ids.astype(reader.kind), np.concatenate([[0], np.cumsum(n_ids)]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, n) for i in range(3)), pa.array(np.bincount(row, minlength=n) + 1), *packed], names=["rid", "id", "held", "n_tokens", "words", "times", "ids"])
                done += n

    made = fresh_path(spark, "ids")
    rows.mapInArrow(scan, schema).write.option("compression", "zstd").parquet(made)
    return spark.read.schema(schema).parquet(made)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of runs of values; ends: where they begin and the last one ends."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _plain(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column that _packed() made, and where its rows begin and the last one ends."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    flat = np.frombuffer(column.buffers()[2], kind) if column.buffers()[2] is not None else np.zeros(0, kind)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def _unpacked(column: pa.Array, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Ids, their rows and the number of rows, for runs of rows of up to IDS ids."""
    flat, offs = _plain(column, kind)
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(offs, offs[a] + IDS, side="right")) - 1), len(column))
        yield flat[offs[a] : offs[b]].astype(np.int64), np.repeat(np.arange(b - a), np.diff(offs[a : b + 1])), b - a
        a = b


def _added_up(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """key and n: the keys of all runs with the sums of their numbers, of some TALLIED keys at once."""
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for run in chain(runs, [None]):
        if run is not None:
            keys.append(run[0])
            sums.append(run[1])
            if sum(map(len, keys[1:])) < TALLIED:
                continue
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        keys, sums = [key[first]], [np.add.reduceat(np.concatenate(sums)[order], first)] if len(key) else sums[:1]
        if run is None or len(first) > TALLIED:
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(sums[0])], names=["key", "n"])
            keys, sums = [keys[0][:0]], [sums[0][:0]]


def training_windows(ids: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Windows of 2 HALF + 1 ids (-1 before and behind the text) at every HALF ids: each id is once in a second half, the first ones included."""
    n = np.bincount(row, minlength=n_rows)
    halves = -(-n // HALF)
    room = np.where(n > 0, (halves + 1) * HALF + 1, 0)
    base, begin = np.cumsum(room) - room, np.cumsum(n) - n
    laid = np.full(int(room.sum()), -1, np.int32)
    laid[base[n > 0] + HALF] = END
    laid[np.arange(len(ids)) + np.repeat(base + HALF + 1 - begin, n)] = ids
    nth = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
    return laid[(np.repeat(base, halves) + nth * HALF)[:, None] + np.arange(2 * HALF + 1)]


def _rows_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] for places that are known to be inside, which spares looking at each."""
    return np.take(table, at, axis=0, mode="clip")


def _in_parts(x: np.ndarray) -> np.ndarray:
    """x (n, width) as a stack of matrices of ROWS rows, or of one matrix if these don't come out even."""
    return x.reshape(-1, ROWS if len(x) % ROWS == 0 else len(x), x.shape[1])


def _windows(halves: np.ndarray) -> np.ndarray:
    """Each of the halves (n + 1, HALF, WIDTH) but the first, with that before it: (n, 2 HALF, WIDTH), a view."""
    n, size, width = halves.shape
    return np.ndarray((n - 1, 2 * size, width), halves.dtype, halves, strides=halves.strides)


class Attention:
    """One layer of causal self-attention over classes of ids, on top of what the last class says alone.

    log p(class | before) is the log-softmax of bigram[context] + attend(before) U, with keys, queries and values
    from class embeddings and a bias for each distance. The context is that of the last id; bigram and
    log p(id | class, context) come from counts; the latter is inner[context, column[id]], where ids that training
    texts do not have share one column for each class. Training does without inner.
    """

    def __init__(self, classes: np.ndarray, contexts: np.ndarray, column: np.ndarray, inner: np.ndarray | None, bigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes, self.contexts, self.column, self.inner, self.bigram = classes, contexts, column, inner, bigram.astype(np.float32)
        d = WIDTH
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": small(CLASSES, d) * np.float32(np.sqrt(CLASSES / d)), "Q": small(d, d), "K": small(d, d), "V": small(d, d), "R": np.zeros(2 * HALF, np.float32), "U": np.zeros((d, CLASSES), np.float32)}
        i, j = np.arange(HALF)[:, None] + HALF, np.arange(2 * HALF)[None, :]
        self.gap = np.clip(i - j, 0, 2 * HALF - 1)
        self.future = j > i
        # logits are taken to the base of 2, whose powers numpy has at half the price
        self.bits = self.bigram * LOG2E
        self.lines, self.ones = np.arange(PLACES) * CLASSES, np.ones(CLASSES, np.float32)
        self.cells = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)

    def projected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries (scaled), keys and values of the classes, and what is added to the scores by place: the bias of a distance, or no attention to what comes."""
        p = self.p
        return p["E"] @ (p["Q"] * np.float32(WIDTH**-0.5)), p["E"] @ p["K"], p["E"] @ p["V"], np.where(self.future, np.float32(-1e9), p["R"][self.gap])

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, bias: np.ndarray, some: np.ndarray, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of the scores (rows, HALF, 2 HALF); their sums and what is attended to, by place.

        q are queries (rows, HALF, WIDTH), k and v keys and values (rows, 2 HALF, WIDTH) of windows; hidden says which places
        of some of them are not to be seen. Exponentials are taken as they are, or less their maxima where that fails.
        """
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for careful in (False, True):
                s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
                s += bias
                if len(some):
                    s[some] = np.where(hidden[:, None, :], np.float32(-1e9), s[some])
                if careful:
                    s -= s.max(axis=2, keepdims=True)
                np.exp(s, out=s)
                z = s.reshape(-1, 2 * HALF) @ np.ones(2 * HALF, np.float32)
                if z.min() > 1e-25 and z.max() < np.inf:
                    break
        h = (s @ v).reshape(-1, WIDTH)
        h /= z[:, None]
        return s, z, h

    def shares(self, h: np.ndarray, u: np.ndarray, context: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of up to PLACES places, the logits, to the base of 2, at some cells of (places, CLASSES); the powers of all; their sums. All are less a number for each place.

        u: U times LOG2E. room: two arrays for logits, which are written again by the next call.
        """
        e, part = room[0, : len(h)], room[1, : len(h)]
        with np.errstate(over="ignore", invalid="ignore"):
            for careful in (False, True):
                np.take(self.bits, context, axis=0, out=e, mode="clip")
                np.matmul(_in_parts(h), u, out=_in_parts(part))
                e += part
                if careful:
                    e -= e.max(axis=1, keepdims=True)
                chosen = e.reshape(-1)[at]
                np.exp2(e, out=e)
                total = e @ self.ones
                if total.min() > 1e-25 and total.max() < np.inf:
                    break
        return chosen, e, total

    def score(self, ids: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """log10 probability of each row's ids, END last; each token is scored once, in the second half of a window."""
        n = np.bincount(row, minlength=n_rows)
        halves = -(-n // HALF)
        first, begin = np.cumsum(halves) - halves, np.cumsum(n) - n
        total = int(halves.sum())
        place = np.arange(len(ids)) + np.repeat(first * HALF - begin, n)
        # half windows one behind the other; the first one has nothing before it
        before, target = np.full((total + 1) * HALF, END, ids.dtype), np.full(total * HALF, -1, ids.dtype)
        target[place] = ids
        before[HALF + 1 + place[:-1]] = ids[:-1]
        before[HALF + first[n > 0] * HALF] = END
        c, context = _rows_of(self.classes, before).reshape(-1, HALF), _rows_of(self.contexts, before[HALF:])
        real = target >= 0
        target = np.maximum(target, 0)
        goal = _rows_of(self.classes, target)
        # what is padded stands behind all that is real, where nothing real looks
        opening, earlier = first[halves > 0], np.arange(2 * HALF)[None, :] < HALF
        openings = np.searchsorted(opening, np.arange(0, total + AT_ONCE, AT_ONCE)).tolist()
        eq, ek, ev, bias = self.projected()
        room, u = np.empty((2, PLACES, CLASSES), np.float32), self.p["U"] * LOG2E
        out = np.empty(total * HALF, np.float32)
        for a in range(0, total, AT_ONCE):
            b = min(a + AT_ONCE, total)
            k, v = (_windows(_rows_of(x, c[a : b + 1])) for x in (ek, ev))
            some = opening[openings[a // AT_ONCE] : openings[a // AT_ONCE + 1]] - a
            _, _, h = self.attend(_rows_of(eq, c[a + 1 : b + 1]), k, v, bias, some, earlier)
            for i in range(a * HALF, b * HALF, PLACES):
                j = min(i + PLACES, b * HALF)
                chosen, _, sums = self.shares(h[i - a * HALF : j - a * HALF], u, context[i:j], goal[i:j] + self.lines[: j - i], room)
                out[i:j] = chosen * np.float32(np.log10(2)) - np.log10(sums)
        out += np.take(self.inner.reshape(-1), context * self.inner.shape[1] + _rows_of(self.column, target), mode="clip")
        out *= real
        return np.bincount(np.repeat(np.arange(n_rows), halves), out.reshape(-1, HALF).sum(axis=1, dtype=np.float64), n_rows)

    def train(self, windows: np.ndarray, seed: int, state: dict | None = None) -> None:
        """Adam steps on windows of 2 HALF + 1 ids (-1 where there is none); the second half is predicted. state goes on from the windows before."""
        rng = np.random.default_rng(seed)
        state = {} if state is None else state
        # all parameters in one array, of which p has views
        flat = np.concatenate([v.ravel() for v in self.p.values()])
        cut = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), np.split(flat, cut), strict=True)}
        if not state:
            state |= {"t": 0, "m": np.zeros_like(flat), "u": np.zeros_like(flat)}
        m, u = state["m"], state["u"]
        order = rng.permutation(len(windows))
        room = np.empty((2, PLACES, CLASSES), np.float32)
        for a in range(0, len(windows), BATCH):
            state["t"] = t = state["t"] + 1
            got = self._gradients(windows[order[a : a + BATCH]], room)
            g = np.concatenate([got[k].ravel() for k in self.p])
            m += np.float32(0.1) * (g - m)
            g *= g
            g -= u
            u += np.float32(0.02) * g
            step = np.sqrt(u / np.float32(1 - 0.98**t))
            step += np.float32(1e-7)
            np.divide(m, step, out=step)
            step *= np.float32(RATE / (1 - 0.9**t))
            flat -= step

    def _gradients(self, w: np.ndarray, room: np.ndarray) -> dict[str, np.ndarray]:
        p, scale = self.p, np.float32(WIDTH**-0.5)
        real = w >= 0
        known = np.maximum(w, 0)
        c = _rows_of(self.classes, known)
        seen, now = c[:, :-1], c[:, HALF:-1]
        weigh = (real[:, HALF:-1] & real[:, HALF + 1 :]).ravel().astype(np.float32)
        some = np.flatnonzero(~real.all(axis=1))
        eq, ek, ev, bias = self.projected()
        q, k, v, x = _rows_of(eq, now), _rows_of(ek, seen), _rows_of(ev, seen), _rows_of(p["E"], seen)
        s, z, h = self.attend(q, k, v, bias, some, ~real[some, :-1])
        weigh /= max(1.0, float(weigh.sum()))
        goal, context = c[:, HALF + 1 :].ravel(), _rows_of(self.contexts, known[:, HALF:-1]).ravel()
        u, back_u = p["U"] * LOG2E, np.ascontiguousarray(p["U"].T)
        dh, du = np.empty_like(h), np.zeros_like(p["U"])
        for i in range(0, len(h), PLACES):
            j = min(i + PLACES, len(h))
            at = goal[i:j] + self.lines[: j - i]
            _, d, total = self.shares(h[i:j], u, context[i:j], at, room)
            # shares of the classes less those that should be, both times total
            d.reshape(-1)[at] -= total
            part = (weigh[i:j] / total)[:, None]
            np.multiply((_in_parts(d) @ back_u).reshape(-1, WIDTH), part, out=dh[i:j])
            du += (_in_parts(h[i:j] * part).transpose(0, 2, 1) @ _in_parts(d)).sum(axis=0)
        back = dh / z[:, None]
        ds = back.reshape(q.shape) @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds -= np.einsum("ij,ij->i", back, h).reshape(*q.shape[:2], 1)
        ds *= s
        flat = lambda y: y.reshape(-1, y.shape[-1])
        dq, dk, dv = flat(ds @ k), flat(ds.transpose(0, 2, 1) @ q), flat(s.transpose(0, 2, 1) @ back.reshape(q.shape))
        # what reaches the embedding of each place, summed by class
        dx = dk @ np.ascontiguousarray(p["K"].T)
        dx += dv @ np.ascontiguousarray(p["V"].T)
        dx.reshape(x.shape)[:, HALF:] += (dq @ np.ascontiguousarray(p["Q"].T * scale)).reshape(q.shape)
        de = np.bincount(_rows_of(self.cells, seen).ravel(), dx.ravel(), CLASSES * WIDTH)
        dr = np.bincount(self.gap.ravel(), np.ones(len(w), np.float32) @ ds.reshape(len(w), -1), 2 * HALF)
        xs = flat(x).T
        return {"E": de.astype(np.float32), "Q": flat(x[:, HALF:]).T @ (dq * scale), "K": xs @ dk, "V": xs @ dv, "R": dr.astype(np.float32), "U": du}


def _start(pairs: DataFrame, size: int) -> Attention:
    """The untrained model, from the counts of all pairs of ids: classes, distributions inside them, class bigrams.

    What comes to the driver is at most CONTEXTS rows of `size` ids, whatever the corpus.
    """
    single = pairs.groupBy("b").agg(F.sum("n").alias("n"))
    count = np.zeros(size)
    for r in single.collect():
        count[r.b] = r.n
    order = np.lexsort((np.arange(size), -count))
    classes = np.zeros(size, np.int64)
    classes[order[:ALONE]] = np.arange(ALONE)
    rest = order[ALONE:]
    mass = np.cumsum(count[rest] + 0.1)
    classes[rest] = ALONE + np.minimum(CLASSES - ALONE - 1, ((mass - mass[0]) * (CLASSES - ALONE) / mass[-1]).astype(int))
    # the commonest ids are contexts of their own, then come the classes
    contexts = CONTEXTS - CLASSES + classes
    contexts[order[: CONTEXTS - CLASSES]] = np.arange(CONTEXTS - CLASSES)
    spark = pairs.sparkSession
    named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(contexts)], "a long, c int")
    got = pairs.join(F.broadcast(named), "a").groupBy("c", "b").agg(F.sum("n").alias("n")).toPandas()
    used, unused = np.flatnonzero(count > 0), np.flatnonzero(count == 0)
    column = np.empty(size, np.int64)
    column[used] = np.arange(len(used))
    column[unused] = len(used) + classes[unused]
    owner = np.concatenate([classes[used], np.arange(CLASSES)])
    table = np.zeros((CONTEXTS, len(owner)), np.float32)
    table[got["c"], column[got["b"]]] = got["n"]
    inside = np.bincount(classes, count + 0.1, CLASSES)
    per = np.zeros((CONTEXTS, CLASSES))
    for c in range(CLASSES):
        per[:, c] = table[:, owner == c].sum(axis=1)
    bigram = np.log((per + PRIOR * inside / inside.sum()) / (per.sum(axis=1, keepdims=True) + PRIOR))
    table += (PRIOR * (np.concatenate([count[used], np.zeros(CLASSES)]) + 0.1) / inside[owner]).astype(np.float32)
    table /= (per + PRIOR).astype(np.float32)[:, owner]
    return Attention(classes, contexts, column, np.log10(table, out=table), bigram)


def fit(rows: DataFrame, path: str = MODEL) -> Attention:
    """The model of the training rows of read(): counts of all their ids, parameters trained on every id once.

    In each of ROUNDS rounds every partition trains a copy on all windows of its share of the texts, as they come,
    and the copies are averaged, weighed by windows; the shares, by the hash of the row, make up all training texts.
    """
    spark = rows.sparkSession
    with open(path, "rb") as f:
        reader = Subwords(f.read())
    kind = reader.kind
    texts = rows.where("not held").select("rid", "ids")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for ids, row, _ in _unpacked(batch.column(0), kind):
                before = np.concatenate([[END], ids[:-1]])
                before[1:][row[1:] != row[:-1]] = END
                yield (before << 32) | ids, np.ones(len(ids), np.int64)

    summed = texts.select("ids").mapInArrow(lambda batches: _added_up(pairs(batches)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = keep(summed.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n"))
    model = _start(counted, reader.size)
    shapes = {k: v.shape for k, v in model.p.items()}
    for turn in range(ROUNDS):
        bare = Attention(model.classes, model.contexts, model.column, None, model.bigram)
        bare.p = model.p
        shared = spark.sparkContext.broadcast(bare)

        def local(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            state, seen = {}, 0
            mine = Attention(shared.value.classes, shared.value.contexts, shared.value.column, None, shared.value.bigram)
            mine.p = {k: v.copy() for k, v in shared.value.p.items()}
            for batch in batches:
                for ids, row, n in _unpacked(batch.column(0), kind):
                    w = training_windows(ids, row, n)
                    mine.train(w, turn, state)
                    seen += len(w)
            if seen:
                flat = np.concatenate([v.ravel() for v in mine.p.values()]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["i", "x", "n"])

        share = texts.where(F.pmod(F.xxhash64("rid"), F.lit(ROUNDS)) == turn).select("ids")
        mean = share.mapInArrow(local, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("i").toPandas()
        shared.unpersist()
        if len(mean):
            cut = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
            model.p = {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(shapes.items(), np.split(mean["x"].to_numpy(), cut), strict=True)}
    return model


def attended(rows: DataFrame, model: Attention, counted: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rid, id, held, n_tokens, score, known, logs, far for each row of read(), written to the shared folder.

    counted: the frequent words of training, sorted, and their counts c. known is the number of a row's words among
    them, logs the sum of log10(c + 1) over these; far holds the row's other words with their times.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, *counted))
    kind = np.dtype("<u2" if len(model.classes) <= 1 << 16 else "<u4")
    names = ["rid", "id", "held", "n_tokens"]
    schema = f"rid long, id {dict(rows.dtypes)['id']}, held boolean, n_tokens long, score double, known long, logs double, far array<struct<word:long,times:int>>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, frequent, counts = shared.value
        worth = np.log10(np.append(counts, 0) + 1.0)
        for batch in batches:
            found = [net.score(ids, row, n) for ids, row, n in _unpacked(batch.column(4), kind)]
            if not found:
                continue
            (word, offs), (times, _) = _plain(batch.column(5), WORD), _plain(batch.column(6), TIMES)
            n = len(offs) - 1
            row = np.repeat(np.arange(n), np.diff(offs))
            at = np.minimum(np.searchsorted(frequent, word), max(0, len(frequent) - 1))
            hit = frequent[at] == word if len(frequent) else np.zeros(len(word), bool)
            known, logs = np.bincount(row[hit], times[hit], n), np.bincount(row[hit], times[hit] * worth[at[hit]], n)
            rest = pa.StructArray.from_arrays([pa.array(word[~hit]), pa.array(times[~hit])], names=["word", "times"])
            far = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[~hit], np.arange(n + 1)).astype(np.int32)), rest)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(np.concatenate(found)), pa.array(known.astype(np.int64)), pa.array(logs.astype(float)), far], names=[*names, "score", "known", "logs", "far"])

    made = fresh_path(rows.sparkSession, "scored")
    rows.select(*names, "ids", "words", "times").mapInArrow(score, schema).write.parquet(made)
    return rows.sparkSession.read.schema(schema).parquet(made)


def scores(docs: DataFrame, path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Rows whose crc32(key as text) leaves HELD_OUT by FOLDS are held out; all models learn from the others. Base:
    lower-cased words and one end, each with log10((c + 1) / (N + V + 1)) of counts over all training rows. Score:
    log10 probability of the text's subword ids and END under an Attention model, whose counts come from all training
    texts and whose parameters are trained on every id of them, each predicted once.

    Texts are split once, by read(); the rest works on what that wrote. Up to FREQUENT of the commonest training words
    go to every task and are summed where rows are scored; only the others meet their counts in a join, and none of
    these has much more than an N / FREQUENT-th of all rows. A null text has the end only; a null key counts as empty
    text; repeated rows are each scored, and count each; an empty table gives no rows.
    """
    rows = read(docs, path, key, text)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            yield _plain(batch.column(0), WORD)[0], _plain(batch.column(1), TIMES)[0].astype(np.int64)

    counted = rows.where("not held").select("words", "times").mapInArrow(lambda batches: _added_up(words(batches)), "key long, n long")
    total = keep(counted.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")))
    size = total.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = rows.where("not held").count()
    n_train, n_distinct = size["n"] + ends, size["v"] + int(ends > 0)
    least = _least_count(total)
    often = total.where(F.col("c") > least).toPandas().sort_values("word")  # at most FREQUENT rows
    out = attended(rows, fit(rows, path), (often["word"].to_numpy(np.int64), often["c"].to_numpy(float)))
    seldom = out.select("rid", F.inline("far")).join(total.where(F.col("c") <= least), "word")
    more = seldom.groupBy(F.col("rid").alias("r")).agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("l"))
    known = F.col("known") + F.coalesce("k", F.lit(0)) + F.lit(int(ends > 0))
    logs = F.col("logs") + F.coalesce("l", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0)))
    return out.join(more, F.col("rid") == F.col("r"), "left").select(
        F.col("id").alias(key), F.col("held").alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_distinct + 1.0)))).alias("base_score"), "score",
    )


def _least_count(total: DataFrame) -> float:
    """A count that at most FREQUENT words exceed; -1 if there are no more words than that.

    Counts are binned by eighths of powers of two: a few hundred bins, whatever the corpus.
    """
    bins = total.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("top")).orderBy(F.desc("bin")).collect()
    so_far = 0
    for b in bins:
        so_far += b["n"]
        if so_far > FREQUENT:
            return float(b["top"])
    return -1.0


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scores(docs)

"""Removal of long repeated strings, within and across documents, by suffix arrays over matched segments."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import fresh_path, keep
from .suffixes import suffix_array
from .textscan import Slice, mix64, slices

#: A repeated string has so many bytes; both windows of that length and their anchors are counted in bytes.
NEED = 200
#: Anchors are chosen among the 96 grams of a window, each of 105 bytes.
WIDE = 96
GRAM = NEED - WIDE + 1
#: Bytes that one symbol of the coarse suffix array stands for; WIDE is a multiple.
BLOCK = 16
PARTS = WIDE // BLOCK
#: Rows in a block that is searched and later completed together, as a power of two; a text of more than LONG bytes is a block by itself.
ROWS, LONG = 6, 1 << 18
#: Longest piece of a text that is searched in one step; pieces are counted from the start of their text.
STEP = 1 << 18
#: Bytes of segments that go into one suffix array, and rows of one anchor above which its windows are counted one by one.
CHUNK, CROWD = 1 << 19, 20_000


def segments(s: Slice) -> tuple[np.ndarray, ...]:
    """anchor hash, segment hash, anchor, first window, last window: the segments of all texts of a slice.

    Each window of NEED bytes has an anchor: of its grams the one with the smallest hash, the leftmost of equal
    ones. Windows in a row with the same anchor are a segment, which spans the bytes of all of them. Equal windows
    have equal anchors at equal places, so a window's equals are found among the segments of its anchor's hash.
    """
    out = []
    mask = np.uint64((1 << 20) - 1)
    # pieces of whole texts, and steps of longer texts
    a = 0
    pieces = []
    while a < s.n:
        b = max(a + 1, int(np.searchsorted(s.offs, s.offs[a] + STEP, side="right")) - 1)
        b = min(b, s.n)
        lo, hi = int(s.offs[a]), int(s.offs[b])
        if b == a + 1:
            pieces += [(x, min(x + STEP, hi), hi) for x in range(lo, hi, STEP)]
        elif hi > lo:
            pieces.append((lo, hi, hi))
        a = b
    ends = np.repeat(s.offs[1:], np.diff(s.offs))
    for lo, hi, stop in pieces:
        top = min(hi + NEED, stop)
        m = top - lo
        if m < NEED:
            continue
        run = np.zeros(m + 1, np.uint64)
        np.cumsum(textscan.BYTE_VALUES[s.buf[lo:top]] * textscan._up[:m], out=run[1:])
        grams = m - GRAM + 1
        h = mix64((run[GRAM : GRAM + grams] - run[:grams]) * textscan._down[:grams])
        low = (h & ~mask) | np.arange(grams, dtype=np.uint64)
        d = 1
        while 2 * d <= WIDE:
            low = np.minimum(low[:-d], low[d:])
            d *= 2
        if d < WIDE:
            low = np.minimum(low[: len(low) - (WIDE - d)], low[WIDE - d :])
        n = min(hi - lo, len(low))
        p = np.flatnonzero(np.arange(lo, lo + n) + NEED <= ends[lo : lo + n])
        if not len(p):
            continue
        at = (low[p] & mask).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
        first, last, at = p[begin], p[np.append(begin[1:], len(p)) - 1], at[begin]
        shape = mix64((last - first).astype(np.uint64) * np.uint64(1_000_003) + (at - first).astype(np.uint64))
        x = mix64(((run[last + NEED] - run[first]) * textscan._down[first]) ^ shape)
        out.append((h[at], x, at + lo, first + lo, last + lo))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeated_windows(h: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """For each segment, which of its windows (first to last) occur elsewhere among the segments, or in itself again.

    h: anchor hashes; count: how often a segment occurs; left, right: bytes of the segment before and after its
    gram; texts: the segments. Two suffix arrays decide. In the coarse one a symbol stands for the gram, or for
    BLOCK bytes counted from it; suffixes that agree in PARTS symbols share a core, the bytes common to BLOCK
    neighbouring windows. In the fine one a symbol stands for the core, or for one byte within BLOCK of it;
    suffixes that agree in BLOCK symbols are equal windows.
    """
    out = [np.zeros(int(a + b) - WIDE + 2, bool) for a, b in zip(left, right, strict=True)]
    # coarse: blocks left of the gram, nearest last, the gram, blocks right of it
    rows, pieces = [], []
    for i, text in enumerate(texts):
        a, g = int(left[i]), int(left[i]) + GRAM
        l, r = a // BLOCK, int(right[i]) // BLOCK
        pieces += [text[a - BLOCK * j : a - BLOCK * (j - 1)] for j in range(l, 0, -1)]
        pieces.append(h[i].tobytes())
        pieces += [text[g + BLOCK * j : g + BLOCK * (j + 1)] for j in range(r)]
        rows.append((l, r))
    names: dict[bytes, int] = {}
    symbols, where, owner, part = (array("i") for _ in range(4))
    at = 0
    taken = iter(pieces)
    for i, (l, r) in enumerate(rows):
        for _ in range(l + 1 + r):
            piece = next(taken)
            symbols.append(names.setdefault(piece, len(names) + 2))
        for k in range(max(0, PARTS - 1 - r), min(l, PARTS - 1) + 1):  # k blocks left, PARTS - 1 - k right
            where.append(at + l - k)
            owner.append(i)
            part.append(k)
        symbols.append(1)
        at += l + 2 + r
    core, cores = _equal(symbols, where, PARTS)
    del pieces, names, taken
    # fine: for each segment and part of its windows whose core occurs more than once
    total = np.zeros(cores, np.int64)
    np.add.at(total, core, count[np.frombuffer(owner, np.int32)])
    symbols, where, owners, windows = (array("i") for _ in range(4))
    at = 0
    for j, (i, k) in enumerate(zip(owner, part, strict=True)):
        if total[core[j]] < 2:
            continue
        a = int(left[i])
        begin, stop = a - BLOCK * k, a + GRAM + BLOCK * (PARTS - 1 - k)
        before = texts[i][max(0, begin - BLOCK + 1) : begin]
        behind = texts[i][stop : stop + BLOCK - 1]
        symbols.extend(b + 2 for b in before)
        symbols.append(258 + int(core[j]))
        symbols.extend(b + 2 for b in behind)
        symbols.append(1)
        for x in range(max(0, BLOCK - 1 - len(behind)), len(before) + 1):  # x bytes before the core
            where.append(at + len(before) - x)
            owners.append(i)
            windows.append(a - BLOCK * k - x)
        at += len(before) + 2 + len(behind)
    if not where:
        return out
    same, n = _equal(symbols, where, BLOCK)
    total = np.zeros(n, np.int64)
    np.add.at(total, same, count[np.frombuffer(owners, np.int32)])
    for j in np.flatnonzero(total[same] > 1):
        out[owners[j]][windows[j]] = True
    return out


def _equal(symbols: Sequence[int], where: Sequence[int], n: int) -> tuple[np.ndarray, int]:
    """Class of each position in `where`, and their number: positions are of one class if n symbols from them agree."""
    s = np.array(symbols, np.int32)
    order = suffix_array(s)
    rank = np.empty(len(s), np.int32)
    rank[order] = np.arange(len(s))
    w = np.array(where, np.int32)
    by = np.argsort(rank[w])
    at = w[by]
    fresh = np.ones(len(w), bool)
    fresh[1:] = False
    for j in range(n):
        symbol = s[at + j]
        fresh[1:] |= symbol[1:] != symbol[:-1]
    out = np.empty(len(w), np.int64)
    out[by] = np.cumsum(fresh) - 1
    return out, int(fresh.sum())


def _search(docs: DataFrame) -> DataFrame:
    """block, h, x, n: how often each segment occurs in each block of rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            for s in slices(batch.column(1)):
                h, x, _, first, _ = segments(s)
                if len(h):
                    b = block[s.first + np.searchsorted(s.offs, first, side="right") - 1]
                    whole = mix64(h ^ mix64(x ^ mix64(b.astype(np.uint64))))
                    _, at, n = np.unique(whole, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array(h[at].view(np.int64)), pa.array(x[at].view(np.int64)), pa.array(n.astype(np.int32))], names=["block", "h", "x", "n"])

    return docs.select("block", "text").mapInArrow(scan, "block long, h long, x long, n int")


def _blocks(docs: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """For each block its documents, with what is known of their windows, and the segments that others need.

    Rows with key h null are documents: sure holds first and last window of segments that repeat as a whole, open
    those whose windows the suffix arrays have yet to judge. Other rows are segments, each sent by one block.
    """
    schema = f"block long, rid long, id {kind}, text binary, sure array<int>, open_h array<long>, open_x array<long>, open_at array<int>, h long, x long, m long, crowded boolean, left int, right int, segment binary"
    names = [f.split()[0] for f in schema.split(", ")]
    ints = pa.list_(pa.int32())

    def complete(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = {c: [] for c in names}
        types = dict(zip(names, [pa.int64(), pa.int64(), docs.schema.field("id").type, pa.binary(), ints, pa.list_(pa.int64()), pa.list_(pa.int64()), ints, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()], strict=True))
        kx = known.column("x").to_numpy().view(np.uint64)
        kh = known.column("h").to_numpy().view(np.uint64)
        whole = mix64(kh ^ mix64(kx))
        order = np.argsort(whole)
        whole = whole[order]
        mixed, m, sender, crowded = (known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("mixed", "m", "sender", "crowded"))
        block = docs.column("block")[0].as_py() if docs.num_rows else None
        rid, ids = docs.column("rid").to_pylist(), docs.column("id").to_pylist()
        sent = set()

        def add(**row) -> None:
            for c in names:
                out[c].append(row.get(c))

        for s in slices(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())):
            h, x, at, first, last = segments(s)
            own = mix64(h ^ mix64(x))
            hit = np.minimum(np.searchsorted(whole, own), max(0, len(whole) - 1))
            good = whole[hit] == own if len(whole) else np.zeros(len(own), bool)
            row = np.searchsorted(s.offs, first, side="right") - 1
            sure = good & (~mixed[hit] | (m[hit] > 1)) if len(whole) else good
            judge = good & mixed[hit] & (m[hit] == 1) if len(whole) else good
            for j in np.flatnonzero(good & mixed[hit] & (sender[hit] == block)) if len(whole) else ():
                k = hit[j]
                if k not in sent:
                    sent.add(k)
                    add(h=int(h[j].view(np.int64)), x=int(x[j].view(np.int64)), m=int(m[k]), crowded=bool(crowded[k]), left=int(at[j] - first[j]), right=int(last[j] + NEED - at[j] - GRAM), segment=s.buf[first[j] : last[j] + NEED].tobytes())
            cut = np.searchsorted(row, np.arange(s.n + 1))
            for i in range(s.n):
                a, b, base = cut[i], cut[i + 1], int(s.offs[i])
                js, jo = a + np.flatnonzero(sure[a:b]), a + np.flatnonzero(judge[a:b])
                add(block=block, rid=rid[s.first + i], id=ids[s.first + i], text=s.buf[base : s.offs[i + 1]].tobytes(), sure=np.column_stack([first[js] - base, last[js] - base]).ravel().tolist(), open_h=h[jo].view(np.int64).tolist(), open_x=x[jo].view(np.int64).tolist(), open_at=(first[jo] - base).tolist())
        return pa.table({c: pa.array(out[c], types[c]) for c in names})

    left = docs.select("block", "rid", "id", "text").groupBy("block")
    return left.cogroup(found.select("block", "h", "x", "mixed", "m", "sender", "crowded").groupBy("block")).applyInArrow(complete, schema)


def _judged(sent: DataFrame) -> DataFrame:
    """h, x, bits: for each segment sent, which of its windows repeat, one bit each."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush() -> pa.RecordBatch:
            h, x, m, left, right, texts = zip(*held, strict=True)
            got = repeated_windows(np.array(h, np.int64).view(np.uint64), np.array(m), np.array(left), np.array(right), list(texts))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.int64()), pa.array([np.packbits(g).tobytes() for g in got], pa.binary())], names=["h", "x", "bits"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "x", "m", "left", "right", "segment")), strict=True):
                if row[0] != last and size > CHUNK:
                    yield flush()
                    size = 0
                last = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x, m, text in zip(*(batch.column(c).to_pylist() for c in ("h", "x", "m", "segment")), strict=True):
                n = len(text) - NEED + 1
                w = [hashlib.blake2b(text[i : i + NEED], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, t) for v, t in ((h, pa.int64()), (x, pa.int64()), (m, pa.int64()))] + [pa.array(range(n), pa.int32()), pa.array(w, pa.binary())], names=["h", "x", "m", "i", "w"])

    arrays = sent.where("not crowded").select("h", "x", "m", "left", "right", "segment").repartition("h").sortWithinPartitions("h", "x").mapInArrow(judge, "h long, x long, bits binary")
    # an anchor with very many segments: its windows are dealt out by their own hashes
    single = sent.where("crowded").select("h", "x", "m", "segment").mapInArrow(windows, "h long, x long, m long, i int, w binary")
    often = single.groupBy("w").agg(F.sum("m").alias("c")).where("c > 1").select("w")
    listed = single.join(often, "w").groupBy("h", "x").agg(F.collect_set("i").alias("places"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for places in batch.column("places").to_pylist():
                b = np.zeros(WIDE, bool)
                b[places] = True
                bits.append(np.packbits(b).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("x"), pa.array(bits, pa.binary())], names=["h", "x", "bits"])

    return arrays.unionByName(listed.mapInArrow(packed, "h long, x long, bits binary"))


def _cut(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that some window covers; windows come as runs, first to last."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + NEED)
    apart = np.flatnonzero(start[1:] > end[:-1])
    return start[np.concatenate([[0], apart + 1])] if len(start) else start, end[np.append(apart, len(end) - 1)] if len(end) else end


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, starts, ends, kept (binary) for each row.

    Every byte that lies in a string of NEED bytes which also starts anywhere else, in this text or another, is
    removed; matches do not cross texts, overlaps count, and all strings are judged on the input. starts and ends
    are the removed runs in bytes.

    Segments (see segments()) are counted over the corpus by their anchors' hashes. Anchors that occur once are
    done. Segments of which the corpus has equal ones repeat as a whole and are kept once, with their count. Where
    one anchor has different segments, suffix arrays over these find the windows that repeat; very crowded anchors
    are dealt out by window. Rows are numbered and written once, then read twice and shuffled once, by blocks of
    rows, or of one long text; only those with open segments are moved again.

    Null texts are empty; repeated rows repeat each other and lose everything from NEED bytes on; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    path = fresh_path(docs.sparkSession, "rows")
    rows.withColumn("block", F.when(F.octet_length("text") > LONG, -1 - F.col("rid")).otherwise(F.shiftright("rid", ROWS))).write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    found = _search(rows)
    common = found.groupBy("h").agg(F.sum("n").alias("c"), F.min("x").alias("x1"), F.max("x").alias("x2")).where("c > 1")
    shared = found.join(common.select("h", "c", (F.col("x1") != F.col("x2")).alias("mixed")), "h")
    path = fresh_path(docs.sparkSession, "segments")
    shared.write.parquet(path)
    shared = docs.sparkSession.read.parquet(path)
    each = shared.where("mixed").groupBy("h", "x").agg(F.sum("n").alias("m"), F.min("block").alias("sender"))
    known = shared.join(each, ["h", "x"], "left").select("block", "h", "x", "mixed", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("sender", F.lit(-1)).alias("sender"), (F.col("c") > CROWD).alias("crowded"))
    path = fresh_path(docs.sparkSession, "blocks")
    _blocks(rows, known, kind).write.parquet(path)
    blocks = docs.sparkSession.read.parquet(path)
    judged = keep(_judged(blocks.where("h is not null").select("h", "x", "m", "crowded", "left", "right", "segment")))
    texts = blocks.where("rid is not null").select("block", "rid", "id", "text", "sure", "open_h", "open_x", "open_at")
    asked = texts.where("size(open_h) > 0").select("rid", F.explode(F.arrays_zip("open_h", "open_x", "open_at")).alias("o")).select("rid", F.col("o.open_h").alias("h"), F.col("o.open_x").alias("x"), F.col("o.open_at").alias("at"))
    answers = asked.join(judged, ["h", "x"]).groupBy("rid").agg(F.collect_list(F.struct("at", "bits")).alias("open"))
    closed = texts.where("size(open_h) = 0").select("id", "text", "sure", F.array().cast("array<struct<at:int,bits:binary>>").alias("open"))
    opened = texts.where("size(open_h) > 0").join(answers, "rid", "left").select("id", "text", "sure", "open")
    schema = f"{key} {kind}, n_bytes long, n_removed long, n_spans long, starts array<int>, ends array<int>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for body, sure, waited in zip(*(batch.column(c).to_pylist() for c in ("text", "sure", "open")), strict=True):
                spans = np.array(sure, np.int64).reshape(-1, 2)
                single = [o["at"] + np.flatnonzero(np.unpackbits(np.frombuffer(o["bits"], np.uint8))) for o in waited or ()]
                starts, ends = _cut(np.concatenate([spans[:, 0], *single]).astype(np.int64), np.concatenate([spans[:, 1], *single]).astype(np.int64))
                ins, outs = [0, *ends.tolist()], [*starts.tolist(), len(body)]
                rest = b"".join(body[a:b] for a, b in zip(ins, outs, strict=True))
                for c, v in zip(out, (len(body), len(body) - len(rest), len(starts), starts, ends, rest), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"])

    return closed.unionByName(opened).mapInArrow(cut, schema)


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

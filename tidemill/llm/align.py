"""Two tokenizers' views of the same text: groups with common ends, linked tokens, and how often ids are linked corpus-wide."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, filterfalse
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Where the public tokenizers lie on every machine; parameters of align().
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space in pieces (fixed by the format).
MARK = "▁"
#: Chunks of a segment, characters of the texts encoded at once, and tokens that a worker remembers the chunks of.
SEGMENT, AT_ONCE, REMEMBERED = 4096, 1 << 18, 1 << 20
#: Characters beside a space that make the space begin a token on both sides: visible ones, none of them white space.
VISIBLE = r"!-~\u00A1-\u024F"
CUT, UNSAFE = re.compile(f"(?<=[{VISIBLE}])(?= [{VISIBLE}])"), re.compile(f"(?<![{VISIBLE}]) | (?![{VISIBLE}])|\0")
#: The same characters as a set; new chunks that are encoded in one text.
SEEN, TOGETHER = {chr(i) for i in (*range(0x21, 0x7F), *range(0xA1, 0x250))}, 64
#: Tokens whose links are held at once, and distinct pairs that a task sums before it passes them on.
TOKENS, PAIRS = 1 << 18, 1 << 21
#: Shards that a task keeps mapped.
MAPPED = 64


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of a worker, the bytes of their tokens, and the texts of ids for digests."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = _byte_of_char()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        #: No piece has a mark after another character, so none reaches across the start of a word.
        self.separable = not any(MARK in n.lstrip(MARK) for n in names)
        self.forget()
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.texts = {side: tuple(np.array([f"{i}{sep}".encode() for i in range(n)], object) for sep in seps) for side, n, seps in (("a", size, ",|"), ("b", len(names), ",;"))}

    def forget(self) -> None:
        """Start anew with no chunks remembered."""
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.start: list[np.ndarray] = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.equal = np.zeros(0, bool)

    def chunks(self, text: str) -> list[str]:
        """space+text, cut before each space between two VISIBLE characters: there both tokenizers begin a token, whatever stands around, so chunks are encoded apart."""
        if not self.separable:
            return [" " + text]
        if UNSAFE.search(text) is None:
            return (" " + text).replace(" ", "\0 ")[1:].split("\0")
        return CUT.split(" " + text)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk among those known; what is new is encoded first, each once."""
        new = list(dict.fromkeys(c for c in chunks if c not in self.known))
        # chunks that begin and end with VISIBLE characters stand behind one another as they would in a text
        apart = [c for c in new if c[1:2] not in SEEN or c[-1] not in SEEN] if self.separable else new
        joined = list(filterfalse(set(apart).__contains__, new))
        runs = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)] + [[c] for c in apart]
        if runs:
            self.learn(runs)
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def learn(self, runs: list[list[str]]) -> None:
        """Encode new chunks, those of a run in one text. Where its tokens do not end where its chunks do, or lose bytes, each is encoded alone."""
        texts = ["".join(run) for run in runs]
        found = [[e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)]
        whole = np.array([b"".join(map(self.a_bytes.__getitem__, a)) == t.encode() == b"".join(map(self.b_bytes.__getitem__, b)) for t, a, b in zip(texts, *found, strict=True)])
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        while True:
            kept = np.flatnonzero(whole).tolist()
            chunks = [c for i in kept for c in runs[i]]
            stop = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
            ids = [np.fromiter(chain.from_iterable(side[i] for i in kept), np.int32) for side in found]
            ends = [np.cumsum(length[x]) for length, x in zip((self.a_length, self.b_length), ids, strict=True)]
            at = [np.searchsorted(e, stop) for e in ends]
            crossed = np.logical_or.reduce([e[i] != stop for e, i in zip(ends, at, strict=True)])
            if not crossed.any():
                break
            whole[np.repeat(kept, size[kept])[crossed]] = False
        self.add(chunks, ids, [np.diff(np.append(-1, i)) for i in at], True)
        lost = np.flatnonzero(~whole & (size == 1)).tolist()
        self.add([runs[i][0] for i in lost], [np.fromiter(chain.from_iterable(side[i] for i in lost), np.int32) for side in found], [np.fromiter((len(side[i]) for i in lost), np.int64, len(lost)) for side in found], False)
        if again := [[c] for i in np.flatnonzero(~whole & (size > 1)).tolist() for c in runs[i]]:
            self.learn(again)

    def add(self, chunks: list[str], ids: list[np.ndarray], length: list[np.ndarray], equal: bool) -> None:
        """Remember the ids of chunks, how many each has, and whether they keep its bytes."""
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.equal = np.append(self.equal, np.full(len(chunks), equal))
        for side in (0, 1):
            self.start[side] = np.append(self.start[side], self.start[side][-1] + np.cumsum(length[side]))
            self.ids[side] = np.append(self.ids[side], ids[side])

    def gathered(self, side: int, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        start, length = self.start[side][chunks], self.start[side][chunks + 1] - self.start[side][chunks]
        before = np.cumsum(length) - length
        return self.ids[side][np.repeat(start - before, length) + np.arange(int(length.sum()))], length


@cache
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """Those of this worker, loaded once."""
    return Tokenizers(byte_level, pieces)


def _lists(values: np.ndarray, length: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values, pa.int32()))


def encodings(docs: DataFrame, key: str, text: str, byte_level: str, pieces: str) -> DataFrame:
    """key, a, b (ids of the whole text), a_part, b_part (how many of them each SEGMENT of chunks has); all empty for a text without tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_level, pieces)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # rows of about AT_ONCE characters
                texts, start = [], at
                while at < batch.num_rows and sum(map(len, texts)) < AT_ONCE:
                    texts.append(batch.column(1)[at].as_py() or "")
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *_encoded(both, texts)], names=names)

    schema = f"{key} {dict(docs.dtypes)[key]}, a array<int>, b array<int>, a_part array<int>, b_part array<int>"
    names = [key, "a", "b", "a_part", "b_part"]
    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, schema)


def _encoded(both: Tokenizers, texts: list[str]) -> list[pa.Array]:
    if max(map(len, both.ids)) > REMEMBERED:
        both.forget()
    parts = [both.chunks(t) if t else [] for t in texts]
    number = both.numbers([c for some in parts for c in some])
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    row = np.repeat(np.arange(len(parts)), count)
    # a text with a chunk whose bytes are lost has no tokens
    whole = np.bincount(row[~both.equal[number]], minlength=len(parts)) == 0
    number, row, count = number[whole[row]], row[whole[row]], np.where(whole, count, 0)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    first = np.flatnonzero(place % SEGMENT == 0)
    out = []
    for side in (0, 1):
        ids, length = both.gathered(side, number)
        out.append((_lists(ids, np.bincount(row, length, len(parts)).astype(np.int64)), _lists(np.add.reduceat(length, first) if len(first) else first, -(-count // SEGMENT))))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


@dataclass
class Links:
    """Links of some consecutive segments: the row and the packed pair of each; rows of groups; digest pieces by segment."""

    row: np.ndarray
    pair: np.ndarray
    group_row: np.ndarray
    segment_row: np.ndarray
    pieces: list[list[bytes]]


def links(both: Tokenizers, batch: pa.RecordBatch, digests: bool) -> Iterator[Links]:
    """The links of a batch of encodings, some TOKENS tokens at a time.

    The union of all token ends cuts the text into ranges, each inside one A and one B token: one link each. Ends that
    both sides have are those of groups. A pair is packed as B id * 2^32 + A id.
    """
    flat = {c: (batch.column(c).flatten().to_numpy(), np.diff(batch.column(c).offsets.to_numpy())) for c in ("a", "b", "a_part", "b_part")}
    segment_row = np.repeat(np.arange(batch.num_rows), flat["a_part"][1])
    ends = [np.append(0, np.cumsum(flat[c][0].astype(np.int64))) for c in ("a_part", "b_part")]
    lo = 0
    while lo < len(segment_row):
        hi = max(lo + 1, int(np.searchsorted(ends[0], ends[0][lo] + TOKENS, side="right")) - 1)
        a, b = flat["a"][0][ends[0][lo] : ends[0][hi]], flat["b"][0][ends[1][lo] : ends[1][hi]]
        end_a, end_b = np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b])
        merged = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        last = np.append(merged[1:] != merged[:-1], True)
        cut, common = merged[last], merged[1:][~last[:-1]]
        in_a, in_b = np.searchsorted(end_a, cut), np.searchsorted(end_b, cut)
        segment_end = end_a[ends[0][lo + 1 : hi + 1] - ends[0][lo] - 1]
        rows = segment_row[lo:hi]
        pieces = _pieces(both, a, b, end_a, end_b, common, segment_end) if digests else []
        yield Links(rows[np.searchsorted(segment_end, cut)], b[in_b].astype(np.int64) << 32 | a[in_a], rows[np.searchsorted(segment_end, common)], rows, pieces)
        lo = hi


def _pieces(both: Tokenizers, a, b, end_a, end_b, common, segment_end) -> list[list[bytes]]:
    """Ids of each segment as texts with separators, group by group, A before B."""
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    until_a, until_b = np.searchsorted(end_a, common, side="right"), np.searchsorted(end_b, common, side="right")
    out = np.empty(len(a) + len(b), object)
    texts_a = np.where(common[group_a] == end_a, both.texts["a"][1][a], both.texts["a"][0][a])
    texts_b = np.where(common[group_b] == end_b, both.texts["b"][1][b], both.texts["b"][0][b])
    out[np.arange(len(a)) + np.append(0, until_b)[group_a]] = texts_a
    out[np.arange(len(b)) + until_a[group_b]] = texts_b
    last = np.searchsorted(common, segment_end)
    stop = (until_a + until_b)[last]
    return [out[s:e].tolist() for s, e in zip(np.append(0, stop[:-1]), stop, strict=True)]


def pair_counts(encoded: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """pair, n: sums of np.unique over each task's links; a pair comes once a task, or once for each PAIRS distinct ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, keys, sums = tokenizers(byte_level, pieces), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for some in links(both, batch, False):
                new, n = np.unique(some.pair, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, n]), len(keys)).astype(np.int64)
                if len(keys) >= PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                    keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    return encoded.select("a", "b", "a_part", "b_part").mapInArrow(scan, "pair long, n long")


def _write(uri: str, data: np.ndarray) -> None:
    """An array's bytes as one file of the shared folder."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        path = unquote(parsed.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        data.tofile(path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        f.write(np.ascontiguousarray(data).data)


def _mapped(uri: str, n: int) -> np.ndarray:
    """The keys and sums of a shard, memory-mapped; from a store that cannot be mapped, read."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return np.memmap(unquote(parsed.path), np.int64, "r", shape=(2, n))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.int64).reshape(2, n)


@dataclass(frozen=True)
class Shards:
    """Sorted shards of pair sums: their files, first pairs and lengths, and the highest sum of each B id."""

    files: tuple[str, ...]
    first: np.ndarray
    length: np.ndarray
    best: np.ndarray

    def lookup(self, pairs: np.ndarray, held: dict[int, np.ndarray]) -> np.ndarray:
        """Sums of sorted pairs, all of which occur."""
        shard = np.searchsorted(self.first, pairs, side="right") - 1
        out = np.zeros(len(pairs), np.int64)
        for i in np.unique(shard).tolist():
            if i not in held:
                while len(held) >= MAPPED:
                    held.pop(next(iter(held)))
                held[i] = _mapped(self.files[i], int(self.length[i]))
            mine = shard == i
            out[mine] = held[i][1][np.searchsorted(held[i][0], pairs[mine])]
        return out


def shards(partial: DataFrame, n_b: int) -> Shards:
    """Sort partial sums by pair across the cluster, add up runs of a pair, and write one file a range.

    A file has a name of its own for every attempt; only those of finished tasks are listed, so a task that runs again
    does no harm. The driver gets one line a file and the highest sum of each B id.
    """
    base = fresh_path(partial.sparkSession, "pair-counts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            total = np.add.reduceat(n, start)
            k = k[start]
            if keys and keys[-1][-1] == k[0]:  # a run that goes on from the batch before
                sums[-1][-1] += total[0]
                k, total = k[1:], total[1:]
            if len(k):
                keys.append(k)
                sums.append(total)
        if not keys:
            return
        data = np.stack([np.concatenate(keys), np.concatenate(sums)])
        uri = f"{base}/{uuid.uuid4().hex}.i64"
        _write(uri, data)
        start = np.flatnonzero(np.append(True, np.diff(data[0] >> 32) != 0))
        best = [pa.array([x.tolist()]) for x in (data[0][start] >> 32, np.maximum.reduceat(data[1], start))]
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([data[0][0]]), pa.array([data.shape[1]]), *best], names=["file", "first", "n", "b", "top"])

    made = partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(write, "file string, first long, n long, b array<long>, top array<long>").collect()
    made.sort(key=lambda r: r.first)
    best = np.zeros(n_b, np.int64)
    for r in made:
        np.maximum.at(best, np.array(r.b, np.int64), np.array(r.top, np.int64))
    return Shards(tuple(r.file for r in made), np.array([r.first for r in made], np.int64), np.array([r.n for r in made], np.int64), best)


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """key, RESULT for each row: the whole text's tokens under a byte-level and a piece tokenizer, aligned by bytes.

    n_groups: ranges between byte offsets where tokens of both end. n_links: pairs of tokens whose bytes overlap; n_best
    those whose ids are linked as often, corpus-wide, as the B id is with any; count_sum adds up how often over all links.
    groups_sha256 digests the ids group by group. A null or empty text, and one whose tokens' bytes are not those of
    space+text on both sides, has no tokens: zeros and an empty digest. Repeated rows count each; other columns are
    ignored; an empty table gives no rows. Texts are encoded once, in chunks that no token crosses, each of
    which a worker remembers; encodings and partial counts are written to the shared folder. The tokenizers' files must lie on every machine.
    """
    spark = docs.sparkSession
    at = fresh_path(spark, "encodings")
    encodings(docs, key, text, byte_level, pieces).write.option("compression", "zstd").parquet(at)
    encoded = spark.read.parquet(at)
    counted = fresh_path(spark, "partial-counts")
    pair_counts(encoded, byte_level, pieces).write.option("compression", "zstd").parquet(counted)
    found = spark.sparkContext.broadcast(shards(spark.read.parquet(counted), len(tokenizers(byte_level, pieces).b_bytes)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sums, held = tokenizers(byte_level, pieces), found.value, {}
        for batch in batches:
            n = batch.num_rows
            n_links, n_groups, n_best, count_sum = np.zeros((4, n), np.int64)
            digest: list = [None] * n
            for some in links(both, batch, True):
                pair, at = np.unique(some.pair, return_inverse=True)
                count = sums.lookup(pair, held)
                top = count == sums.best[pair >> 32]
                n_links += np.bincount(some.row, minlength=n)
                n_groups += np.bincount(some.group_row, minlength=n)
                n_best += np.bincount(some.row[top[at]], minlength=n)
                np.add.at(count_sum, some.row, count[at])
                for r, texts in zip(some.segment_row.tolist(), some.pieces, strict=True):
                    joined = b"".join(texts)[:-1]
                    if digest[r] is None:
                        digest[r] = hashlib.sha256(joined)
                    else:
                        digest[r].update(b";" + joined)
            sizes = [np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in ("a", "b")]
            out = [*sizes, n_groups, n_links, n_best, count_sum]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), pa.array([d.hexdigest() if d else "" for d in digest], pa.string())], names=names)

    names = [key, *(x.split()[0] for x in RESULT.split(", "))]
    return encoded.mapInArrow(scan, f"{key} {dict(docs.dtypes)[key]}, {RESULT}")


def op13(docs: DataFrame) -> DataFrame:
    """All documents, aligned."""
    return align(docs)

"""Spelling variants: every string one edit away from a word is made, and those that are words themselves are its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .textscan import BASE, BASE_INVERSE, mix64

#: Letters of a word after A-Z are lower-cased (fixed by the rule), its least length and least number of occurrences.
LETTERS = r"a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
#: One occurrence in so many, by the hash of its document and spelling, has lost a letter (fixed by the rule).
LOSSY = 31
#: A form occurs at least so many times as often as its variant.
TIMES = 10
#: Bits of the vocabulary's filter for each word, and most bits in all (32 MB): beyond, more candidates pass to the join.
BITS, MOST_BITS = 32, 28
#: Candidates that are hashed at once, and words of one task.
AT_ONCE, WORDS_A_TASK = 1 << 18, 20_000


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of MIN_LENGTH code points or more that occur MIN_COUNT times or more in the whole texts.

    Words are maximal runs of LETTERS after A-Z became lower case. Where LOSSY divides the crc32 h of `<key>:<run>`, the
    run loses its code point h % length (from 0). A null key counts as one without characters; a null or empty text has
    no words; repeated rows count each; counts are summed before and after one shuffle by word.
    """
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("k", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, at + 2)"))
    spelt = runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % LOSSY == 0, less).otherwise(F.col("run")).alias("word"))
    return spelt.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(0x1234567)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(spelt: list[str]) -> np.ndarray:
    """64-bit values of strings: the sum of a value of each code point times BASE to its place."""
    codes = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, spelt), np.int64, len(spelt))
    start = np.cumsum(length) - length
    place = np.arange(len(codes)) - np.repeat(start, length)
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_values(codes) * _powers(int(length.max(initial=0)))[place], out=run[1:])
    return run[start + length] - run[start]


class Filter:
    """Two bits for each of a set of strings: a string without both is not in the set."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = np.uint64(64 - bits), data

    def first(self, h: np.ndarray) -> np.ndarray:
        return self._has(h >> self.bits)

    def second(self, h: np.ndarray) -> np.ndarray:
        return self._has(mix64(h) >> self.bits)

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def vocabulary_filter(vocabulary: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Bits and bytes of the Filter of all words; its bytes are put together in tasks by range, at most 2^MOST_BITS bits in all."""
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(size, 1) * BITS)))))
    shift = np.uint64(64 - bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column(0).to_pylist())
            at = np.concatenate([h >> shift, mix64(h) >> shift]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 13), pa.array((at & 8191).astype(np.int16))], names=["block", "at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column(1):
                on = np.zeros(8192, bool)
                on[at.values.to_numpy()] = True
                out.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bytes"])

    # a block has 8,192 places at most, a fixed size
    blocks = vocabulary.select("word").mapInArrow(places, "block long, at short").groupBy("block").agg(F.collect_set("at").alias("at"))
    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in blocks.mapInArrow(packed, "block long, bytes binary").collect():
        data[r.block * 1024 : (r.block + 1) * 1024] = np.frombuffer(r.bytes, np.uint8)
    return bits, data


def neighbourhood(spelt: list[str], alphabet: np.ndarray, known: Filter) -> Iterator[tuple[int, str]]:
    """(index, candidate) for each distinct deletion, replacement and insertion of each string that the filter lets pass.

    Of equal deletions in a run of one letter the last is made, of equal insertions beside it the last as well, so no
    candidate comes twice. Candidates are hashed as arrays, from the sums before and after the edit, and only those that
    pass are spelt out. Memory is bounded by AT_ONCE and the longest string.
    """
    value, letters = _values(alphabet), len(alphabet)
    order = sorted(range(len(spelt)), key=lambda i: len(spelt[i]))
    at = 0
    while at < len(order):
        length = len(spelt[order[at]])
        end = at
        while end < len(order) and len(spelt[order[end]]) == length and (end - at + 1) * (length + 1) * max(letters, 1) <= AT_ONCE:
            end += 1
        group = order[at : max(end, at + 1)]
        at += len(group)
        codes = np.frombuffer("".join(spelt[i] for i in group).encode("utf-32-le"), np.uint32).reshape(len(group), length)
        power = _powers(length + 1)
        terms = _values(codes) * power[:length]
        run = np.zeros((len(group), length + 1), np.uint64)
        np.cumsum(terms, axis=1, out=run[:, 1:])
        total = run[:, -1:]
        # a long string goes by ranges of places
        width = max(1, AT_ONCE // (len(group) * max(letters, 1)))
        for lo in range(0, length + 1, width):
            hi = min(lo + width, length)
            places = np.arange(lo, hi)
            gone = run[:, lo:hi] + (total - run[:, lo + 1 : hi + 1]) * np.uint64(BASE_INVERSE)
            differs = np.ones((len(group), hi - lo), bool)
            inner = places < length - 1
            differs[:, inner] = codes[:, places[inner]] != codes[:, places[inner] + 1]
            for k, p in _passing(gone, differs, known):
                s = spelt[group[k]]
                yield group[k], s[: lo + p] + s[lo + p + 1 :]
            other = alphabet[None, None, :] != codes[:, lo:hi, None]
            put = total[:, :, None] + (value[None, None, :] - _values(codes[:, lo:hi])[:, :, None]) * power[lo:hi][None, :, None]
            for k, p, a in _passing(put, other, known):
                s = spelt[group[k]]
                yield group[k], s[: lo + p] + chr(alphabet[a]) + s[lo + p + 1 :]
            top = min(lo + width, length + 1)
            before = run[:, lo:top]
            more = (before + (total - before) * np.uint64(BASE))[:, :, None] + value[None, None, :] * power[lo:top][None, :, None]
            new = np.ones(more.shape, bool)
            new[:, : hi - lo] = other
            for k, p, a in _passing(more, new, known):
                s = spelt[group[k]]
                yield group[k], s[: lo + p] + chr(alphabet[a]) + s[lo + p :]


def _passing(h: np.ndarray, valid: np.ndarray, known: Filter) -> list[tuple[int, ...]]:
    hit = np.nonzero(known.first(h) & valid)
    ok = known.second(h[hit])
    return list(zip(*(x[ok].tolist() for x in hit), strict=True))


def near(vocabulary: DataFrame, size: int) -> DataFrame:
    """word, n_near, best (struct of -n and spelling of the commonest near word) for each word that has a near one.

    Each word's whole neighbourhood over the observed alphabet is made in tasks. Candidates that a filter of fixed size
    shows to be no words are dropped there; the others are shuffled by spelling, summed, and joined to the vocabulary,
    whose equality of strings decides. Being near is mutual, so what reaches a word is what it reaches. A word receives
    no more candidates than its own neighbourhood holds, so none is hot.
    """
    spark = vocabulary.sparkSession
    split = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    # the alphabet is bounded by LETTERS: 90 code points
    alphabet = np.array(sorted(ord(r.c) for r in split.collect() if r.c), np.uint32)
    shared = spark.sparkContext.broadcast((alphabet, *vocabulary_filter(vocabulary, size)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, bits, data = shared.value
        known = Filter(bits, data)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                spelt, n = (batch.column(i).slice(lo, 2000) for i in (0, 1))
                found = list(neighbourhood(spelt.to_pylist(), alphabet, known))
                source = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c in found], pa.string()), spelt.take(source), n.take(source)], names=["candidate", "source", "n"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-size // WORDS_A_TASK))
    candidates = vocabulary.select("word", "n").repartition(tasks, "word").mapInArrow(scan, "candidate string, source string, n long")
    reached = candidates.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("source").alias("spelling"))).alias("best"))
    return vocabulary.select("word").join(reached, F.col("word") == F.col("candidate")).select("word", "n_near", "best")


def followed(forms: DataFrame) -> DataFrame:
    """word, root for each word of forms (word, form): what following forms ends at.

    Each round follows twice as far; n grows at least TIMES-fold a step, so five rounds follow any chain of 64-bit counts.
    """
    roots = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = keep(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of words().

    n_near counts the words that differ by exactly one inserted, deleted or replaced code point. form is the near word
    of the largest n (of equals the smallest by code points) if that n is at least TIMES the word's, else null; form_n is
    its n. root is where following forms ends; a word without a form is its own. Other columns are ignored; an empty
    table, or one without words, gives no rows.
    """
    vocabulary = keep(words(docs, key, text))
    found = near(vocabulary, vocabulary.count())
    best = vocabulary.join(found, "word", "left").withColumn("top", -F.col("best.minus"))
    has = F.col("top") >= TIMES * F.col("n")
    judged = keep(best.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.spelling")).alias("form"), F.when(has, F.col("top")).alias("form_n")))
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(docs: DataFrame) -> DataFrame:
    """Variants among the words of all documents."""
    return variants(docs)

"""Quality by compression: text is good where a dictionary of good text makes it shorter than one of bad text does."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Bytes that are compressed at once, so that the dictionary and not the text's own beginning explains them.
BLOCK = 320
#: Bytes of a dictionary, and the level at which blocks are compressed.
DICTIONARY, LEVEL = 128 << 10, 6
#: Labelled ids that dictionaries and calibration may see (those with the smallest hashes), and blocks a class of them.
LABELLED, BLOCKS = 20_000, 24_000
#: Bytes of average text that each text counts as having besides its own, so that few bytes decide little.
PRIOR = 32
#: Ids whose crc32 leaves this remainder by FOLDS are held out: their labels are never read.
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the average size difference a byte, and the line that turns it into log-odds; without dictionaries only the line's constant."""

    good: bytes
    bad: bytes
    average: float
    slope: float
    constant: float

    def probability(self, difference: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Of label 1, for texts of n_bytes whose compressed sizes differ by difference."""
        return 1 / (1 + np.exp(-np.clip(self.slope * normalised(difference, n_bytes, self.average) + self.constant, -500, 500)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def normalised(difference: np.ndarray, n_bytes: np.ndarray, average: float) -> np.ndarray:
    """Size difference a byte, PRIOR bytes of average text included."""
    return (difference + PRIOR * average) / (n_bytes + PRIOR)


class Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.of = (_compressor(good), _compressor(bad))

    def difference(self, text: str | None) -> tuple[int, int]:
        """Bytes that the bad dictionary needs more than the good one, over all blocks of the whole text; bytes of the text."""
        data = memoryview((text or "").encode("utf-8", "replace"))
        good, bad = (c.compress for c in self.of)
        return sum(len(bad(b)) - len(good(b)) for b in (data[i : i + BLOCK] for i in range(0, len(data), BLOCK))), len(data)


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; of too few blocks for training, the blocks themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the log-odds of y by x: logistic regression by Newton steps, lightly held to 0, slope at least 0."""
    if not len(y):
        return 0.0, 0.0
    scale = float(np.abs(x).max()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    # one imagined row of each class keeps the constant finite
    a, y = np.vstack([a, [0, 1], [0, 1]]), np.append(y, [0, 1])
    w, ridge = np.zeros(2), np.diag([1e-3, 0])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - z @ y + w @ ridge @ w / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(2), a.T @ (y - p) - ridge @ w)
        t = 1.0
        while loss(w + t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-9:
            break
    if w[0] < 0:
        return 0.0, float(np.log(y.mean() / (1 - y.mean())))
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """Dictionaries of half of the labelled texts, calibrated on the other half.

    Only labels of 0 and 1, of ids that are not held out, are read: LABELLED ids at most, by the hash of the id. Of an id
    labelled twice the lower label counts. Of the dictionary half, BLOCKS blocks a class at most, those with the smallest
    hashes, train the dictionaries; of the other half each id gives one row, of repeated ids the smallest difference.
    If a class is missing in either half, there are no dictionaries and every text gets the share of label 1.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(key).isNotNull() & F.col(quality).isin(0, 1) & (F.crc32(F.col(key).cast("string")) % FOLDS != HELD_OUT))
    # LABELLED rows of three numbers: a size that is fixed whatever the input
    chosen = keep(usable.groupBy(F.col(key).alias("_k")).agg(F.min(quality).cast("int").alias("_q")).orderBy(F.xxhash64("_k"), "_k").limit(LABELLED).withColumn("_half", F.pmod(F.xxhash64("_k", F.lit(17)), F.lit(2)).cast("int")))
    known = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "replace")
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                for i in range(0, len(blocks), 1000):
                    some = blocks[i : i + 1000]
                    order = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big", signed=True) for b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(some), pa.int32()), pa.array(order, pa.int64()), pa.array(some, pa.binary())], names=["q", "h", "block"])

    pieces = keep(known.where("_half = 0").select("_q", "_t").mapInArrow(cut, "q int, h long, block binary"))
    blocks = {q: [bytes(r.block) for r in pieces.where(F.col("q") == q).select("h", "block").distinct().orderBy("h", "block").limit(BLOCKS).collect()] for q in (0, 1)}
    if not (blocks[0] and blocks[1]):
        share = chosen.agg(F.avg("_q")).first()[0]
        return Model(b"", b"", 0.0, 0.0, 0.0 if share is None else float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    good, bad = dictionary(blocks[1]), dictionary(blocks[0])
    both = spark.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*both.value)
        for batch in batches:
            found = [sizes.difference(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["_k", "q", "d", "n"])

    id_type = dict(known.dtypes)["_k"]
    measured = known.where("_half = 1").select("_k", "_q", "_t").mapInArrow(measure, f"_k {id_type}, q int, d long, n long")
    rows = measured.groupBy("_k", "q").agg(F.min(F.struct("d", "n")).alias("s")).orderBy("_k").select("q", "s.*").toPandas()
    d, n, y = (rows[c].to_numpy(float) for c in ("d", "n", "q"))
    average = float(np.mean(d[n > 0] / n[n > 0])) if (n > 0).any() else 0.0
    return Model(good, bad, average, *line(normalised(d, n, average), y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score for each row: the probability that the whole text would be labelled 1.

    A null or empty text has no bytes and gets the probability of average text; repeated rows get equal scores; other
    columns are ignored; an empty table gives no rows. A text is compressed block by block, so its length does not
    matter; the model, two dictionaries of DICTIONARY bytes, goes to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.good, m.bad) if m.good and m.bad else None
        for batch in batches:
            found = np.array([sizes.difference(t.as_py()) for t in batch.column(1)] if sizes else np.zeros((batch.num_rows, 2)), float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.probability(found[:, 0], found[:, 1]), pa.float64())], names=[key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, f"{key} {dict(docs.dtypes)[key]}, score double")


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns. A null id counts as one without characters."""
    scored = score(docs, fit(docs, labels))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

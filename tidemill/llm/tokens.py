"""Token counts of a unigram tokenizer by count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers lie; a parameter of vocabulary().
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space, and what an unknown character costs below the lowest score (fixed by the format).
MARK, UNKNOWN_COST = "▁", 10.0
#: Chunks whose counts a worker remembers; then it starts anew.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; whether unknown characters are counted as their bytes, or runs of them as one piece."""

    pieces: tuple[tuple[str, float], ...]
    bytes_for_unknown: bool


def vocabulary(path: str = MODEL) -> Vocabulary:
    """The ordinary pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    ordinary = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return Vocabulary(tuple((p.id_to_piece(i), p.get_score(i)) for i in ordinary), sum(p.is_byte(i) for i in range(n)) == 256)


class Counter(dict):
    """chunk -> number of tokens; unknown chunks are segmented when first asked for.

    The text is marked (a mark for each space, one in front) and cut before each run of marks and around line ends,
    where no piece of a best segmentation reaches across; _separable says whether the vocabulary allows that.
    """

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.found = ahocorasick.Automaton()
        for piece, score in vocab.pieces:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min((s for _, s in vocab.pieces), default=0.0) - UNKNOWN_COST
        self.separable = self._separable()

    def _separable(self) -> bool:
        """Sums of scores are exact in any order, and pieces with a mark or line end after other characters always lose."""
        if any(s != int(s) or abs(s) > 2**40 for _, s in self.vocab.pieces):
            return False
        for piece, score in self.vocab.pieces:
            if "\n" in piece:
                return False
            body = piece.lstrip(MARK)
            if MARK in body:
                parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", piece)
                if sum(self.best(x)[0] for x in parts) <= score:
                    return False
        return True

    def best(self, chunk: str) -> tuple[float, int]:
        """Score and number of tokens of the best segmentation of a marked chunk.

        Matches come by their end, the longest first, and only a higher score replaces what an end has: so of
        segmentations with equal scores the one stays whose last piece is longest, as in the tokenizer. A character
        that is no piece by itself may be unknown.
        """
        n = len(chunk)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.found.iter(chunk)
        end, (length, value) = next(matches, (n, (0, 0.0)))
        for at in range(1, n + 1):
            top, number, single = None, 0, False
            while end == at - 1:
                total = score[at - length] + value
                if top is None or total > top:
                    top, number = total, count[at - length] + 1
                single = single or length == 1
                end, (length, value) = next(matches, (n, (0, 0.0)))
            if not single:
                total = score[at - 1] + self.unknown
                if top is None or total > top:
                    top, unknown[at] = total, True
                    if self.vocab.bytes_for_unknown:
                        number = count[at - 1] + len(chunk[at - 1].encode("utf-8", "replace"))
                    else:
                        number = count[at - 1] + (not unknown[at - 1])
            score[at], count[at] = top, number
        return score[n], count[n]

    def __missing__(self, chunk: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.best(chunk)[1]
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not (self.separable and self.vocab.bytes_for_unknown) or "\0" in text:
            return self.best(marked)[1]
        cut = marked.replace(MARK, f"\0{MARK}")
        if MARK + MARK in marked:  # runs of marks stay together; one pass joins every other mark
            cut = cut.replace(f"{MARK}\0{MARK}", MARK + MARK).replace(f"{MARK}\0{MARK}", MARK + MARK)
        return sum(map(self.__getitem__, cut.replace("\n", "\0\n\0").split("\0")))


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, vocab: Vocabulary | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens for each row: the number of tokens of the whole text under the unigram vocabulary.

    A null or empty text has none; repeated rows are counted each; other columns are ignored; an empty table gives
    no rows. The vocabulary (MODEL's if none is given) goes to every task, which it must fit; texts are never moved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _counters.get(hash(shared.value))
        if mine is None:
            _counters.clear()
            mine = _counters[hash(shared.value)] = Counter(shared.value)
        for batch in batches:
            n = [mine.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, f"{key} {dict(docs.dtypes)[key]}, n_tokens long")


def op2(docs: DataFrame) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(docs)

"""Operator 6: token counts by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary of a unigram model gives all pieces that end at each
position of a word; dynamic programming keeps, for each position, the best score and the number of pieces
that reach it, and nothing else: no path and no pieces are built.

The rules are those of the unigram model of the `tokenizers` library with a metaspace splitter:

* A space becomes `▁` and begins a word; a text that does not begin with a space gets one. An empty text has no tokens.
* Of equal scores for a position, the piece that starts first wins (a later one must be better).
* Where no piece of one character stands, the character may be unknown, at the lowest score less 10. Unknown
  characters count by their UTF-8 bytes if the vocabulary has all byte pieces; otherwise a stretch of them is one token.

Counting is a map over rows; equal words of a task are searched once. Scores are added in doubles word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sliced, table

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the unigram model
PIECE = 4_000_000
REMEMBERED = 150_000  # words in each of the two generations that a worker remembers
BLOCK = 200_000  # words of a text that are in memory at once


class Unigram:
    """A vocabulary of `(piece, score)`; later ones of equal pieces count, as in the library."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.recent: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def search(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        open_ = [False] * (n + 1)  # whether the best way to a position ends in an unknown character
        score[0] = 0.0
        single = bytearray(n)
        matches = self.automaton.iter(word)
        end, value = next(matches, (n, None))
        for at in range(n):
            best, pieces = None, 0
            while value is not None and end == at:  # longest first, so the first of equal scores starts first
                length, own = value
                if length == 1:
                    single[at] = 1
                before = score[at + 1 - length]
                if best is None or before + own > best:
                    best, pieces = before + own, count[at + 1 - length] + 1
                end, value = next(matches, (n, None))
            if not single[at] and (best is None or score[at] + self.unknown > best):
                best, open_[at + 1] = score[at] + self.unknown, True
                pieces = count[at] + (len(word[at].encode()) if self.bytes else not open_[at])
            score[at + 1], count[at + 1] = best, pieces
        return count[n], score[n]

    def measure(self, word: str) -> tuple[int, float]:
        found = self.recent.get(word)
        if found is None:
            found = self.older.get(word) or self.search(word)
            if len(self.recent) >= REMEMBERED:
                self.older, self.recent = self.recent, {}
            self.recent[word] = found
        return found

    def text(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text."""
        if not text:
            return 0, 0.0
        words = iter(text.replace(SPACE_MARK, " ").split(" "))
        if text[0] in (" ", SPACE_MARK):
            next(words)
        tokens, total, measure = 0, 0.0, self.measure
        while block := list(islice(words, BLOCK)):
            for n, s in map(measure, [SPACE_MARK + w for w in block]):
                tokens += n
                total += s
        return tokens, total


_LOADED: dict[int, Unigram] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """`doc_id, n_tokens, score` of every row of `docs`: tokens of the whole text, and the score of its best segmentation.

    Null and empty texts have 0 tokens. Rows are counted one by one, whatever their ids. An empty table gives no
    rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: of fixed size
    mark = hash(tuple(vocabulary))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _LOADED:
            _LOADED.clear()
            _LOADED[mark] = Unigram(shared.value)
        own = _LOADED[mark]
        for batch in sliced(batches, PIECE):
            found = [own.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")


def public_pieces(name: str = "piece_bpe_32k.model") -> list[tuple[str, float]]:
    """Pieces and scores of an installed public vocabulary.

    None of the installed files is a unigram model; this one has scored pieces and byte pieces, and its
    scores are taken as those of a unigram model.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_pieces())

"""Token counts without tokens: Viterbi over a unigram vocabulary, best score and piece count only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from centwise.llm.tokens import Remembered, rows

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character scores this much below the lowest piece; fixed value of the tokenizer.
UNKNOWN_PENALTY = 10.0
#: Characters of segments that a worker remembers before it starts anew; changes no result.
REMEMBERED = 8_000_000


class UnigramCounter:
    """Piece count and score of the best segmentation.

    Text is cut before every space, as the tokenizer's own pre-tokenizer does,
    and each segment is scored alone.  Ties: at an end position the candidate
    that starts first wins, since a later one must score strictly more.  A
    character that is no piece by itself counts as the bytes it falls back to.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.matcher = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.known, self.scores, self.held = Remembered(self._count), {}, 0

    def segment(self, text: str) -> tuple[int, float]:
        size = len(text)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        if not self.single.issuperset(text):
            return self._with_unknown(text, score, count)
        at = 0
        for last, (length, value) in self.matcher.iter(text):  # by end, the longest first
            start = last + 1 - length
            got = score[start] + value
            if last != at - 1:
                at = last + 1
                score[at], count[at] = got, count[start] + 1
            elif got > score[at]:
                score[at], count[at] = got, count[start] + 1
        return count[size], score[size]

    def _with_unknown(self, text, score, count) -> tuple[int, float]:
        ends = [[] for _ in range(len(text) + 1)]
        for last, match in self.matcher.iter(text):
            ends[last + 1].append(match)
        fallen = [False] * (len(text) + 1)  # the best path ends in an unknown run
        for at in range(1, len(text) + 1):
            self._settle(text, at, ends[at], score, count, fallen)
        return count[-1], score[-1]

    def _settle(self, text, end, matches, score, count, fallen) -> None:
        best = None
        for length, value in matches:  # longest first
            got = score[end - length] + value
            if best is None or got > best:
                best, count[end], fallen[end] = got, count[end - length] + 1, False
        character = text[end - 1]
        if character not in self.single:
            got = score[end - 1] + self.unknown
            if best is None or got > best:
                joined = fallen[end - 1] and not self.byte_fallback  # a run of unknown characters is one piece
                best, fallen[end] = got, True
                count[end] = count[end - 1] + (len(character.encode()) if self.byte_fallback else 0 if joined else 1)
        score[end] = best

    def __call__(self, text: str | None) -> tuple[int, float]:
        """(pieces, score); null and empty texts have none."""
        words = self._words(text)
        return sum(map(self.known.__getitem__, words)), float(sum(map(self.scores.__getitem__, words)))

    def count(self, text: str | None) -> int:
        """Pieces only."""
        return sum(map(self.known.__getitem__, self._words(text)))

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if SPACE in text:  # the same to the tokenizer; plain spaces keep most texts at one byte a character
            text = text.replace(SPACE, " ")
        if text[0] == " ":
            text = text[1:]
        if self.held > REMEMBERED:
            self.known.clear()
            self.scores.clear()
            self.held = 0
        return text.split(" ")

    def _count(self, word: str) -> int:
        pieces, self.scores[word] = self.segment(SPACE + word)
        self.held += len(word) + 20
        return pieces


@lru_cache(maxsize=4)
def counter(vocabulary: str = VOCABULARY) -> UnigramCounter:
    """Counter over the pieces and scores of a sentencepiece file; one for each worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    made = UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in plain], any(map(model.is_byte, range(model.get_piece_size()))))
    if crossing := [p for p, *_ in ((model.id_to_piece(i),) for i in plain) if SPACE in p[1:]]:
        for piece in crossing:  # no segment holds a space behind its first character
            made.matcher.remove_word(piece)
        made.matcher.make_automaton()
    return made


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, score, n_chars for every row of ``docs`` (doc_id, text).

    ``score`` is the sum of the segments' best scores.  Null and empty texts have
    0 tokens and score 0; a null doc_id is passed through; repeated rows are
    counted each; other columns are not looked at; no rows give no rows.  Work
    per text is linear in its length, whatever the length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = counter(vocabulary)
        for batch in rows(batches):
            found = batch.column("text").to_pylist()
            counts = [count_one(t) for t in found]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([c for c, _ in counts], pa.int64()), pa.array([s for _, s in counts], pa.float64()), pa.array([len(t or "") for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score", "n_chars"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint, score double, n_chars bigint")


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of ``token_counts``, without the scores' sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = counter(vocabulary).count
        for batch in rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(count_one, batch.column("text").to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")

"""Count-only Viterbi for unigram tokenizers.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; dynamic programming over end positions carries the
best score and its number of pieces, not the pieces. Tie rule, as in the public unigram encoders: candidates
for an end position come by ascending start, and only a strictly better score replaces the one held, so of equals
the longest last piece stays. A character without a piece of its own may also be an unknown (score: lowest piece
score less 10); runs of unknowns are one token, or, with byte fallback, one token per UTF-8 byte of each.

Texts are marked as SentencePiece does: one mark in front, and a mark for each space. If no piece holds a mark after
another character and all scores are whole numbers (so sums have no rounding), the best path of a text is that of its
words on end, and each worker remembers the counts of words (two bounded generations). Otherwise texts are counted whole.

Cases: null or empty text has 0 tokens and score 0; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_counters: dict[tuple, "Counter"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file's ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, limit: int = 250_000):
        self.byte_fallback, self.limit = byte_fallback, limit
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.auto.add_word(piece, (len(piece), float(score)))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - 10
        inner = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.by_word = not inner and all(float(s).is_integer() for _, s in pieces)
        self.held: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a marked text, by one pass over its matches."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        tail = [False] * (n + 1)  # the best path to here ends in an unknown
        at, ends = 0, iter(self.auto.iter(text))
        item = next(ends, None)
        unknown, fallback = self.unknown, self.byte_fallback
        for at in range(1, n + 1):
            found = False
            best, pieces, unk = 0.0, 0, False
            single = False
            while item is not None and item[0] == at - 1:  # longest first, so starts ascend
                length, s = item[1]
                candidate = score[at - length] + s
                if not found or candidate > best:
                    best, pieces, unk, found = candidate, count[at - length] + 1, False, True
                single = single or length == 1
                item = next(ends, None)
            if not single:
                candidate = score[at - 1] + unknown
                if not found or candidate > best:
                    more = len(text[at - 1].encode()) if fallback else 0 if tail[at - 1] else 1
                    best, pieces, unk = candidate, count[at - 1] + more, True
            score[at], count[at], tail[at] = best, pieces, unk
        return count[n], score[n]

    def _word(self, word: str) -> tuple[int, float]:
        got = self.held.get(word)
        if got is None:
            got = self.old.get(word) or self.best(word)
            if len(word) <= 64:
                if len(self.held) >= self.limit:
                    self.old, self.held = self.held, {}
                self.held[word] = got
        return got

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.by_word or not self.byte_fallback:
            return self.best(MARK + text.replace(" ", MARK))
        tokens, score = 0, 0.0
        run = 0  # marks in front of the next word
        for part in text.replace(MARK, " ").split(" "):
            run += 1
            if part:
                key = MARK * run + part
                t, s = self.held.get(key) or self._word(key)
                tokens, score, run = tokens + t, score + s, 0
        if run:
            t, s = self._word(MARK * run)
            tokens, score = tokens + t, score + s
        return tokens, score


def counter(path: str, byte_fallback: bool) -> Counter:
    """This process's counter for the file."""
    key = (path, byte_fallback)
    if key not in _counters:
        _counters[key] = Counter(load_pieces(path), byte_fallback)
    return _counters[key]


def count_tokens(docs: DataFrame, path: str | None = None, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (sum of the piece scores of the best path) of every whole text."""
    file = path or default_path()

    def run(batches):
        c = counter(file, byte_fallback)
        for batch in batches:
            got = [c.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.int64()), pa.array(np.array([s for _, s in got], np.float64))], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, docs.select(F.col(id_col).alias("doc_id")).schema.add("n_tokens", "long").add("score", "double"))

"""Token counts by count-only Viterbi: Aho-Corasick finds the pieces, dynamic programming keeps two numbers.

An automaton over the whole vocabulary enumerates every piece that ends at each character, longest first;
for each character only the best score and the number of pieces of the best segmentation are kept. Scores,
ties, byte fallback and words are those of pieces.py, so the count is the length of what encoding gives.

Edge cases. Null and empty texts: 0 pieces. Repeated rows: counted each. No rows: no rows. Extra columns are
ignored. Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.common import slices
from changeloom.llm.pieces import DEFAULT_MODEL, MARKER, Vocabulary
from changeloom.llm.sentencepiece_codec import REMEMBERED, WordCodes


class Counter:
    """(pieces, byte pieces, score) of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        scores = vocabulary.scores.tolist()
        for piece, i in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), scores[i]))
        self.automaton.make_automaton()
        self.unknown = vocabulary.unknown

    def count(self, word: str) -> tuple[int, int, float]:
        n, unknown = len(word), self.unknown
        best, pieces, fallen = [float("-inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        single, done = bytearray(n + 1), 0
        best[0] = 0.0
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while done < last:  # positions before this end are final once their unknown characters are in
                done += 1
                if not single[done]:
                    self._unknown(word, done, best, pieces, fallen)
            if size == 1:
                single[end] = 1
            total = best[end - size] + score
            if total > best[end]:
                best[end], pieces[end], fallen[end] = total, pieces[end - size] + 1, fallen[end - size]
        while done < n:
            done += 1
            if not single[done]:
                self._unknown(word, done, best, pieces, fallen)
        return pieces[n], fallen[n], best[n]

    def _unknown(self, word, end, best, pieces, fallen) -> None:
        total = best[end - 1] + self.unknown
        if total > best[end]:
            size = len(word[end - 1].encode())
            best[end], pieces[end], fallen[end] = total, pieces[end - 1] + size, fallen[end - 1] + size


SCHEMA = "doc_id long, n_tokens long, n_byte_tokens long, score double"


def _counting(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, find = Counter(vocabulary.value), vocabulary.value.segments().findall
        codes, known = WordCodes(), np.zeros((0, 3))
        for batch in batches:
            for part in slices(batch, "text"):
                if len(codes) > REMEMBERED:
                    codes, known = WordCodes(), np.zeros((0, 3))
                code = codes.__getitem__
                words = [np.array([code(w) for w in find(" " + t)] if t else [], np.int64) for t in part.column("text").to_pylist()]
                new = list(codes)[len(known) :]
                if new:
                    found = [counter.count(w.replace(" ", MARKER)) if w != MARKER else (3, 3, counter.unknown) for w in new]
                    known = np.concatenate([known, np.array(found, np.float64)])
                at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                sums = np.concatenate([np.zeros((1, 3)), np.cumsum(known[np.concatenate(words)] if words else np.zeros((0, 3)), axis=0)])
                totals = np.diff(sums[at], axis=0)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(totals[:, 0].astype(np.int64)), pa.array(totals[:, 1].astype(np.int64)), pa.array(totals[:, 2])],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "score"],
                )

    return run


def count_tokens(docs: DataFrame, *, model: str = DEFAULT_MODEL) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_tokens, n_byte_tokens and the score of the best segmentation."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_counting(vocabulary), SCHEMA)

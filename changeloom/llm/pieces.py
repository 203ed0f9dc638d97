"""Unigram pieces: a vocabulary with log scores, a double-array trie over it, and Viterbi on the trie.

The vocabulary is read from a SentencePiece model file; the score that the file gives each piece is taken
as its log score. A text gets one space in front, spaces become the marker U+2581, and the segmentation
with the highest sum of scores is chosen. Ties go as in SentencePiece's unigram encoder: of equal sums at
a position the one whose last piece starts first (is longest) stays. A character that is no piece costs
the lowest score less 10 and is written as the pieces of its UTF-8 bytes.

No piece reaches over a place where a marker follows another character, so the best segmentation of a
text is that of its words, each with the spaces before it, one by one. Words are put through Viterbi once
for each task and looked up after that.

A marker character that a text itself contains is written as bytes, so decoding gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import sentencepiece

MARKER = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Bytes of a UTF-8 character by its first byte.
CHAR_BYTES = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.int32)


@dataclass(frozen=True)
class Vocabulary:
    """A few MB, whatever the corpus: it is sent to the tasks whole."""

    strings: list[bytes]  #: of each id what it decodes to; empty for control pieces
    pieces: dict[str, int]  #: piece to id, without bytes and control pieces
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """From a SentencePiece model file of the driver."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, pieces, strings, byte_ids = range(model.vocab_size()), {}, [], np.full(256, -1, np.int32)
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[value := int(piece[1:-1], 16)] = i
                strings.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                strings.append(b"")
            else:
                pieces[piece] = i
                strings.append(piece.replace(MARKER, " ").encode())
        return cls.of(pieces, strings, np.array([model.get_score(i) for i in ids]), byte_ids)

    @classmethod
    def of(cls, pieces: dict[str, int], strings: list[bytes], scores: np.ndarray, byte_ids: np.ndarray) -> Vocabulary:
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece reaches over the start of a word")
        return cls(strings, pieces, scores.astype(np.float64), byte_ids, float(min(scores[i] for i in pieces.values()) - UNKNOWN_PENALTY))

    def segments(self) -> re.Pattern:
        """Finds words with the spaces before them; a character that no piece holds stands alone."""
        alone = "".join(c for c in ("\n", MARKER) if c == MARKER or not any(c in p for p in self.pieces))
        return re.compile(f"[{alone}]| *[^ {alone}]+| +")


@dataclass
class DoubleArray:
    """Transition from state s by byte b: to base[s] + b + 1, if check there is s. value: a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: dict[str, int]) -> DoubleArray:
        keys = sorted((p.encode(), i) for p, i in pieces.items())
        size = 1024
        base, check, value, used = [0] * size, [-1] * size, [-1] * size, bytearray(size)
        used[0] = 1
        first_free, todo = 1, [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if len(keys[low][0]) == depth:
                value[state] = keys[low][1]
                low += 1
            groups = []
            while low < high:
                code, start = keys[low][0][depth], low
                while low < high and keys[low][0][depth] == code:
                    low += 1
                groups.append((code + 1, start, low))
            if not groups:
                continue
            at = max(first_free, groups[0][0] + 1)
            while True:
                at = used.find(0, at)
                if at < 0 or at + 260 > len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    for x, empty in ((base, 0), (check, -1), (value, -1)):
                        x.extend([empty] * more)
                    at = at if at >= 0 else more
                    continue
                to = at - groups[0][0]
                if all(not used[to + c] for c, _, _ in groups):
                    break
                at += 1
            base[state] = to
            for code, start, end in groups:
                used[to + code], check[to + code] = 1, state
                todo.append((to + code, start, end, depth + 1))
            first_free = max(first_free, to) if len(groups) > 4 else first_free
            if len(groups) == 1 and at == first_free:
                first_free = used.find(0, first_free)
        pad = 300
        return cls(np.array(base + [0] * pad, np.int32), np.array(check + [-1] * pad, np.int32), np.array(value + [-1] * pad, np.int32))


@dataclass
class Segmenter:
    """Best piece ids of words; words of like length go through the trie together."""

    vocabulary: Vocabulary
    trie: DoubleArray
    group: int = 4096
    longest: int = 128  #: longer words (in bytes) go one by one
    _lists: tuple = field(default=())

    def one(self, word: bytes) -> list[int]:
        """Viterbi over one word."""
        if not self._lists:
            self._lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.vocabulary.scores.tolist())
        (base, check, value, scores), unknown, n = self._lists, self.vocabulary.unknown, len(word)
        best, came, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            end_char, state, single, here = start + int(CHAR_BYTES[word[start]]), 0, False, best[start]
            for end in range(start, n):
                to = base[state] + word[end] + 1
                if check[to] != state:
                    break
                state = to
                if (i := value[state]) >= 0:
                    single |= end + 1 == end_char
                    if here + scores[i] > best[end + 1]:
                        best[end + 1], came[end + 1], ids[end + 1] = here + scores[i], start, i
            if not single and here + unknown > best[end_char]:
                best[end_char], came[end_char], ids[end_char] = here + unknown, start, -1
            start = end_char
        out: list[int] = []
        while n:
            out += [ids[n]] if ids[n] >= 0 else [int(self.vocabulary.byte_ids[b]) for b in reversed(word[came[n] : n])]
            n = came[n]
        return out[::-1]

    def many(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if len(words[i]) <= self.longest]
        for i in order[len(short) :]:
            out[i] = self.one(words[i])
        for at in range(0, len(short), self.group):
            part = short[at : at + self.group]
            for i, ids in zip(part, self._together([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _together(self, words: list[bytes]) -> list[list[int]]:
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.vocabulary.scores
        lens = np.array([len(w) for w in words], np.int32)
        n, width = len(words), int(lens.max(initial=0))
        codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        best = np.full((n, width + 5), -np.inf)
        came, ids = np.zeros((n, width + 5), np.int32), np.full((n, width + 5), -1, np.int32)
        best[:, 0] = 0.0
        for start in range(width):
            rows = np.flatnonzero((best[:, start] > -np.inf) & (lens > start))
            if not len(rows):
                continue
            here, size = best[rows, start], CHAR_BYTES[codes[rows, start]]
            single, live, state, end = np.zeros(len(rows), bool), np.arange(len(rows)), np.zeros(len(rows), np.int32), start
            while len(live) and end < width:
                to = base[state] + codes[rows[live], end] + 1
                ok = check[to] == state
                live, state, end = live[ok], to[ok], end + 1
                found = value[state]
                hit = np.flatnonzero((found >= 0) & (end <= lens[rows[live]]))
                if len(hit):
                    who, piece = live[hit], found[hit]
                    single[who[size[who] == end - start]] = True
                    score, at = here[who] + scores[piece], rows[who]
                    better = score > best[at, end]
                    at = at[better]
                    best[at, end], came[at, end], ids[at, end] = score[better], start, piece[better]
            alone = np.flatnonzero(~single)
            if len(alone):
                at, to = rows[alone], start + size[alone]
                score = here[alone] + self.vocabulary.unknown
                better = score > best[at, to]
                at, to = at[better], to[better]
                best[at, to], came[at, to], ids[at, to] = score[better], start, -1
        steps, at, live, strange = [], lens.copy(), np.flatnonzero(lens > 0), np.zeros(n, bool)
        while len(live):
            column = np.full(n, -2, np.int32)
            column[live] = ids[live, at[live]]
            strange[live[column[live] == -1]] = True
            at[live] = came[live, at[live]]
            live = live[at[live] > 0]
            steps.append(column)
        table = np.stack(steps[::-1], axis=1) if steps else np.zeros((n, 0), np.int32)
        flat, ends = table[table != -2].tolist(), np.cumsum((table != -2).sum(axis=1)).tolist()
        return [self.one(w) if odd else flat[a:b] for w, odd, a, b in zip(words, strange.tolist(), [0, *ends[:-1]], ends, strict=True)]

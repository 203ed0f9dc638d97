"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, markers.

See pieces.py for scores, ties and words. Decoding joins the pieces, turns byte pieces into bytes and
markers into spaces, and drops the one space that encoding put in front; it gives every text back exactly.

Edge cases. Null text: null ids. Empty text: no ids. Repeated rows: encoded each. No rows: no rows. All
columns of the input are kept; those that clash with the new ones give way. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.common import slices
from changeloom.llm.pieces import DEFAULT_MODEL, MARKER, DoubleArray, Segmenter, Vocabulary

#: Words that a task remembers, about 150 bytes each; beyond, it starts anew.
REMEMBERED = 150_000


class WordCodes(dict):
    """A number for each word, in the order in which words are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Encoder:
    """Encodes texts in batches, with the ids of words that it has met."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray):
        self.segmenter, self.find = Segmenter(vocabulary, trie), vocabulary.segments().findall
        self.forget()

    def forget(self) -> None:
        self.codes = WordCodes()
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        new = list(self.codes)[len(self.counts) :]
        if not new:
            return
        byte_ids = self.segmenter.vocabulary.byte_ids
        found = self.segmenter.many([w.replace(" ", MARKER).encode() for w in new])
        for i, word in enumerate(new):
            if word == MARKER:
                found[i] = [int(byte_ids[b]) for b in MARKER.encode()]
        counts = np.array([len(x) for x in found], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.array([i for x in found for i in x], np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of ids of each)."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        code = self.codes.__getitem__
        words = [np.array([code(w) for w in self.find(" " + t)] if t else [], np.int64) for t in texts]
        self._learn()
        every = np.concatenate(words) if words else np.zeros(0, np.int64)
        counts = self.counts[every]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[every] - (ends - counts), counts) + np.arange(total)]
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        bounds = np.concatenate([[0], ends])[at]
        return ids, np.diff(bounds)


def decode(ids: list[int], strings: list[bytes]) -> str:
    return b"".join(map(strings.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _encoder(vocabulary, trie, keep: list[str], decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, trie.value)
        byte_id = np.zeros(len(vocabulary.value.strings), bool)
        byte_id[vocabulary.value.byte_ids] = True
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, counts = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                none = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=none)
                n_bytes = np.diff(np.concatenate([[0], np.cumsum(byte_id[ids])])[offsets])
                columns = [*(part.column(c) for c in keep), lists, pa.array(counts, pa.int64()), pa.array(n_bytes, pa.int64())]
                if decoded:
                    strings, back = vocabulary.value.strings, []
                    for i, text in enumerate(texts):
                        back.append(None if text is None else decode(ids[offsets[i] : offsets[i + 1]].tolist(), strings))
                    columns += [pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)])]
                yield pa.record_batch(columns, names=[*keep, *NEW, *(CHECKED if decoded else ())])

    return run


NEW, CHECKED = ("ids", "n_pieces", "n_byte_pieces"), ("decoded_sha256", "round_trip")


def encode_texts(docs: DataFrame, *, model: str = DEFAULT_MODEL, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """docs (with text) plus ids array<int>, n_pieces and n_byte_pieces.

    keep: the columns of docs to return (all if None). decoded: the ids are decoded as well, and the digest of
    that and whether it is the text are returned, in the same pass.
    """
    spark, vocabulary = docs.sparkSession, Vocabulary.load(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*NEW, *(CHECKED if decoded else ()))]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    both = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(DoubleArray.build(vocabulary.pieces))
    needed = keep if "text" in keep else [*keep, "text"]
    schema = f"{fields}ids array<int>, n_pieces long, n_byte_pieces long" + ", decoded_sha256 string, round_trip boolean" * decoded
    return docs.select(*[f"`{c}`" for c in needed]).mapInArrow(_encoder(*both, keep, decoded), schema)


def _decoder(strings, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = strings.value
        for batch in batches:
            column = batch.column("ids")
            for start in range(0, len(column), 512):
                part = batch.slice(start, 512)
                texts = [None if x.values is None else decode(x.values.to_pylist(), known) for x in part.column("ids")]
                hashes = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts]
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(hashes, pa.string())], names=[*keep, "decoded", "decoded_sha256"])

    return run


def decode_ids(encoded: DataFrame, *, model: str = DEFAULT_MODEL) -> DataFrame:
    """encoded (with ids) plus decoded and decoded_sha256."""
    keep = [c for c in encoded.columns if c not in ("decoded", "decoded_sha256")]
    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    strings = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model).strings)
    return encoded.select(*[f"`{c}`" for c in keep]).mapInArrow(_decoder(strings, keep), f"{fields}, decoded string, decoded_sha256 string")

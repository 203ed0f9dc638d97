"""Substring deduplication by line hashing: the earliest occurrence of a repeated unit stays, the rest go.

Units are the lines of a text (unit="paragraph": what blank lines part) of at least `line_words` words, and
within them and across them runs of sentences, so that a passage set into the middle of a line is found as
well: from each sentence on, and up to each, the shortest run of `min_words` words or more. Every repeated
line, and every run of whole sentences of that many words that is found twice, is covered by such units,
whatever the length of its sentences. unit="sentence" takes single sentences of `min_words` words only.

Units are normalised: lower case, single spaces, no stops at the ends of sentences. Digests of 128 bits are
grouped over all documents. Of a digest's occurrences the one of the smallest (doc_id, start) stays, null ids
last. Units may overlap; where one overlaps its own first occurrence, only what lies behind that goes.

Edge cases. Null and empty texts: no units. Repeated rows: the first keeps its units, the others lose
theirs. Ties: by the order in which rows were read. No rows: no rows. Extra columns are ignored by
find_repeats and kept by strip_repeats. Texts are read whole. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import by_chunk, shielded, slices, stage

BREAKS = {"sentence": re.compile(r"[.!?]+\s+|\n+"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n")}
UNIT_SCHEMA = "doc_id long, tag long, start int, `end` int, n_words int, digest binary"


def units_of(text: str, unit: str, min_words: int) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of the units that are long enough."""
    found, at = [], 0
    ends = [(m.start() + len(m[0].rstrip()), m.end()) for m in BREAKS[unit].finditer(text)]
    for end, following in [*ends, (len(text), len(text))]:
        words = text[at:end].lower().split()
        if len(words) >= min_words:
            raw = text[at:end]
            start = at + len(raw) - len(raw.lstrip())
            found.append((start, start + len(raw.strip()), len(words), " ".join(words).rstrip(".!?")))
        at = following
    return found


def passages_of(text: str, unit: str, min_words: int, line_words: int) -> list[tuple[int, int, int, str]]:
    """As units_of, the long enough lines or paragraphs and the shortest runs of sentences that are long enough."""
    atoms = units_of(text, "sentence", 1)
    sums = [0, *accumulate(atom[2] for atom in atoms)]
    runs = set()
    for first in range(len(atoms)):  # the shortest run that starts here
        last = bisect_left(sums, sums[first] + min_words) - 1
        if last < len(atoms):
            runs.add((first, last))
    for last in range(len(atoms)):  # the shortest run that ends here
        first = bisect_right(sums, sums[last + 1] - min_words) - 1
        if first >= 0:
            runs.add((first, last))
    starts = [atom[0] for atom in atoms]
    for start, end, _, _ in units_of(text, unit, line_words):
        runs.add((bisect_left(starts, start), bisect_left(starts, end) - 1))
    return [(atoms[a][0], atoms[b][1], sums[b + 1] - sums[a], "\n".join(x[3] for x in atoms[a : b + 1])) for a, b in sorted(runs)]


def _units(unit: str, min_words: int, line_words: int):
    cut = (lambda text: units_of(text, unit, min_words)) if unit == "sentence" else (lambda text: passages_of(text, unit, min_words, line_words))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, tag, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")], strict=True):
                rows += [(doc_id, tag, start, end, n, xxhash.xxh3_128_digest(plain)) for start, end, n, plain in cut(text or "")]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "tag", "start", "end", "n_words", "digest"])

        return each

    return by_chunk(make)


def _repeats(rows: DataFrame, unit: str, min_words: int, line_words: int) -> DataFrame:
    """As find_repeats, of rows (doc_id, tag, text)."""
    units = stage(rows.mapInArrow(_units(unit, min_words, line_words), UNIT_SCHEMA), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "tag", "end")
    groups = stage(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"), "unit-groups")
    # Digests with a thousandth of all units or more are a thousand at most, and are broadcast.
    hot_from = max(1000, units.count() // 1000)
    named = groups.select("digest", "n", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "start", "tag", "end")])
    hot, cold = F.broadcast(named.where(F.col("n") >= hot_from)), named.where(F.col("n") < hot_from)
    found = units.join(hot, "digest").unionByName(units.join(hot, "digest", "left_anti").join(cold, "digest")).where("tag <> first_tag OR start <> first_start")
    start = F.when(F.col("tag") == F.col("first_tag"), F.greatest("start", "first_end")).otherwise(F.col("start"))
    return found.select("doc_id", "tag", start.alias("start"), "end", "n_words", "first_doc_id", "first_start")


def find_repeats(docs: DataFrame, *, unit: str = "line", min_words: int = 16, line_words: int = 8) -> DataFrame:
    """docs (doc_id, text) to the units that go: doc_id, tag, start, end, n_words, first_doc_id, first_start.

    tag tells rows of the same doc_id and text apart. n_words counts the whole unit.
    """
    return _repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tag"), "text"), unit, min_words, line_words)


def without(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without the spans, which may overlap."""
    if text is None or not spans:
        return text
    kept, at = [], 0
    for start, end in sorted((x["start"], x["end"]) for x in spans):
        kept.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join((*kept, text[at:]))


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [without(t, x) for t, x in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist(), strict=True)]
            columns = {c: part.column(c) for c in part.schema.names if c != "_spans"} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.record_batch(list(columns.values()), names=list(columns))


def strip_repeats(docs: DataFrame, *, unit: str = "line", min_words: int = 16, line_words: int = 8) -> DataFrame:
    """docs without the units that find_repeats names; n_chars, if there, follows the text. All rows stay.

    The rows are numbered in a table of the shared folder first, so repeated rows are told apart.
    """
    docs, restore = shielded(docs, ("doc_id", "text", "n_chars"))
    rows = stage(docs.withColumn("_tag", F.monotonically_increasing_id()), "numbered")
    found = _repeats(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_tag").alias("tag"), "text"), unit, min_words, line_words)
    spans = found.groupBy(F.col("tag").alias("_tag")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    return restore(rows.join(spans, "_tag", "left").select(*docs.columns, "_spans").mapInArrow(_stripped, docs.schema))

"""Quality classifier by co-training of two views.

One view sees the text (shares of hashed byte pairs, word statistics, compressibility), the other the
metadata of the page: language, source and length. Both are logistic regressions. They start from a bounded
sample of labelled rows (at most `max_labelled`, those of the smallest hashes of their ids), whose features
are all that the driver sees of single rows; a fifth of it is held back for calibration.

Each round, one Spark pass scores all other documents with both views. What the text view is sure of is
counted by language, source and length (hashed to buckets); what the metadata view is sure of is summed, as
text features by source bucket and label. These tables, whose size is that of the models whatever the corpus,
are what the other view is fitted on next, beside the labelled rows; together they weigh as much as those at
most, and in the labels' proportions. In the end each view is calibrated on the rows held back and the log odds
of both, less those of the prior, are added. All documents are scored with that.

Features are whole multiples of 1/8192, so sums do not depend on the order of tasks. They are worked out once
for all rounds and kept as a table of the shared folder.

Edge cases. Null text: as empty. Null language, source or length: a value of their own. Null labels and
labels without a document are left out; of several labels of one document the lowest counts. Without labels
of both classes all documents get the smoothed share of good labels and are kept if that is half or more.
Repeated rows: scored each; of a labelled id's
rows the least, by features, is fitted. No rows: no rows. Extra columns are ignored by score_quality and kept by
keep_good.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import discard, slices, stage

BUCKETS = 512
PAIR_BUCKET = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
CLASSES = np.zeros((256, 6))
for _i, _chars in enumerate((b" \t\r\n", b"0123456789", bytes(range(65, 91)), b".,;:'\"-", b"!?#$%&*|@^~<>{}[]\\/=+_`()", bytes(range(128, 256)))):
    CLASSES[list(_chars), _i] = 1
META_BUCKETS = 64
#: Features are kept as whole numbers of this unit, from 0 to 65535.
UNIT = 8192


def text_features(raw: bytes) -> np.ndarray:
    """The text view: BUCKETS shares of byte pairs, then statistics, all roughly between 0 and 1."""
    data = np.frombuffer(raw, np.uint8)
    pairs = np.zeros(BUCKETS)
    if len(data) > 1:
        pairs = np.bincount(PAIR_BUCKET[data[:-1].astype(np.int64) << 8 | data[1:]], minlength=BUCKETS).astype(float)
        pairs = np.sqrt(pairs / pairs.sum())
    words = raw.split()
    n = len(words)
    distinct = set(words)
    again = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    shares = np.bincount(data, minlength=256) @ CLASSES / max(1, len(data))
    packed = len(zlib.compress(raw, 1)) / len(raw) if raw else 1.0
    stats = [len(distinct) / n**0.85 if n else 0.0, again / max(1, n - 1), sum(map(len, words)) / max(1, n) / 10, np.log1p(n) / 10, min(2.0, packed), np.sqrt((pairs**4).sum()), raw.count(b"\n") / max(1, n) * 10, *shares * 5]
    return np.clip(np.rint(np.concatenate([pairs * 4, stats]) * UNIT), 0, 65535).astype(np.uint16)


def meta_buckets(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The metadata view: language, source and length by the power of two, each one of a few buckets."""
    length = 0 if n_chars is None else min(META_BUCKETS - 1, 1 + int(2 * np.log2(1 + max(0, n_chars))))
    return zlib.crc32(f"lang {lang}".encode()) % META_BUCKETS, zlib.crc32(f"source {source}".encode()) % META_BUCKETS, length


def text_matrix(units: np.ndarray) -> np.ndarray:
    return units.astype(np.float32) / UNIT


def meta_matrix(buckets: np.ndarray) -> np.ndarray:
    """Three ones a row."""
    out = np.zeros((len(buckets), 3 * META_BUCKETS), np.float32)
    for i in range(3):
        out[np.arange(len(buckets)), i * META_BUCKETS + buckets[:, i]] = 1
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Logistic:
    """Weights of a logistic regression on standardised features, and its calibration."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 250) -> Logistic:
        weight = np.ones(len(x)) if weight is None else weight
        share = (weight / weight.sum()).astype(np.float32)
        mean = share @ x
        spread = np.sqrt(np.maximum(0, share @ (x * x) - mean * mean)) + 1e-3
        z = np.hstack([(x - mean) / spread, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
        v = np.ones(z.shape[1], np.float32)
        for _ in range(12):  # the largest curvature, by power iteration
            v = z.T @ (share * (z @ v))
            v /= np.linalg.norm(v)
        step = 1 / (0.25 * 1.1 * float(v @ (z.T @ (share * (z @ v)))) + ridge)
        w = ahead = np.zeros(z.shape[1], np.float32)
        for t in range(rounds):  # accelerated gradient descent
            gradient = z.T @ (share * (sigmoid(z @ ahead) - y)) + ridge * ahead
            new = ahead - step * gradient
            ahead, w = new + t / (t + 3) * (new - w), new
        weights = w[:-1] / spread
        return cls(weights.astype(np.float32), float(w[-1] - mean @ weights))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """With the scale at which its log odds fit the rows held back best."""
        s = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method, with a weak prior on a = 1, b = 0
            p = sigmoid(a * s + b)
            g = np.array([((p - y) * s).sum() + (a - 1), (p - y).sum() + b])
            q = p * (1 - p)
            h = np.array([[(q * s * s).sum() + 1, (q * s).sum()], [(q * s).sum(), q.sum() + 1]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
        return Logistic(self.weights, self.bias, (float(max(a, 0.0)), float(b)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.raw(x) + self.scale[1]


@dataclass
class Given:
    """Pseudo-labelled rows in sums: mean features, labels, and how many documents each row stands for."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    def weights(self, share: float, most: int) -> np.ndarray:
        """Of each label its share of `most`, or less where there are fewer documents."""
        out = self.n.astype(np.float64)
        for value, part in ((1, share), (0, 1 - share)):
            mine = self.y == value
            out[mine] *= min(1.0, most * part / max(1.0, out[mine].sum()))
        return out


@dataclass
class CoTrained:
    """Both views, calibrated; None where there were no labels of both classes. exchanged: documents that the text view and the metadata view labelled last."""

    text: Logistic | None
    meta: Logistic | None
    prior: float
    exchanged: tuple[int, int] = (0, 0)

    @classmethod
    def of(cls, text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, ask: Callable[[CoTrained], tuple[Given, Given]], rounds: int) -> CoTrained:
        """text and meta: matrices of labelled rows; label: 1 or 0; held: rows kept for calibration; ask: what both views are sure of."""
        share = (float((label == 1).sum()) + 1) / (len(label) + 2)
        prior = float(np.log(share / (1 - share)))
        train = ~held
        if any(len(np.unique(label[rows])) < 2 for rows in (train, held)):
            return cls(None, None, prior)
        given: tuple[Given | None, Given | None] = (None, None)
        for turn in range(rounds + 1):
            models = []
            for x, more in zip((text, meta), given, strict=True):
                rows, y, weight = x[train], label[train].astype(np.float32), np.ones(int(train.sum()))
                if more is not None and len(more.y):
                    rows, y, weight = np.concatenate([rows, more.x]), np.concatenate([y, more.y]), np.concatenate([weight, more.weights(share, len(weight))])
                models.append(Logistic.fit(rows, y, weight).calibrated(x[held], label[held]))
            found = cls(models[0], models[1], prior, tuple(0 if g is None else int(g.n.sum()) for g in given[::-1]))
            if turn < rounds:
                given = ask(found)
        return found

    def chances(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by the text, by the metadata, and by both."""
        if self.text is None:
            p = np.full(len(text), sigmoid(self.prior))
            return p, p, p
        a, b = self.text.odds(text), self.meta.odds(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


COLUMNS = ("lang", "source", "n_chars")


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text units and metadata buckets, a row each."""
    raw = part.column("text").cast(pa.binary()).to_pylist()
    meta = zip(*(part.column(c).to_pylist() for c in COLUMNS), strict=True)
    return np.stack([text_features(t or b"") for t in raw]), np.array([meta_buckets(*m) for m in meta], np.int32)


FEATURE_SCHEMA = "doc_id long, units binary, lang int, source int, length int"


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            if len(part):
                units, buckets = features(part)
                yield pa.record_batch([part.column("doc_id"), pa.array([u.tobytes() for u in units], pa.binary()), *(pa.array(buckets[:, i]) for i in range(3))], names=["doc_id", "units", "lang", "source", "length"])


def matrices(units: list[bytes], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return text_matrix(np.frombuffer(b"".join(units), np.uint16).reshape(len(units), -1)), meta_matrix(buckets)


SURE_SCHEMA = "view string, value int, lang int, source int, length int, n long, sums array<long>"


def _sure_of(model: CoTrained, fitted: set[int], sure: float):
    """A mapInArrow function: each task's rows of what the views are sure of, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, int] = {}
        sums: dict[tuple, list] = {}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                buckets = np.stack([part.column(c).to_numpy() for c in ("lang", "source", "length")], axis=1)
                raw = part.column("units").to_pylist()
                by_text, by_meta, _ = model.chances(*matrices(raw, buckets))
                free = np.array([i not in fitted for i in part.column("doc_id").to_pylist()], bool)
                for value, text_sure, meta_sure in ((1, by_text >= sure, by_meta >= sure), (0, by_text <= 1 - sure, by_meta <= 1 - sure)):
                    for i, n in zip(*np.unique(buckets[free & text_sure], axis=0, return_counts=True), strict=True):
                        key = (value, *map(int, i))
                        cells[key] = cells.get(key, 0) + int(n)
                    hit = np.flatnonzero(free & meta_sure)
                    for source in np.unique(buckets[hit, 1]).tolist():
                        rows = hit[buckets[hit, 1] == source]
                        units = np.frombuffer(b"".join(raw[i] for i in rows), np.uint16).reshape(len(rows), -1)
                        entry = sums.setdefault((value, source), [0, np.zeros(units.shape[1], np.int64)])
                        entry[0] += len(rows)
                        entry[1] += units.sum(axis=0, dtype=np.int64)
        out = [("text", *k, n, None) for k, n in cells.items()] + [("meta", value, None, source, None, n, total.tolist()) for (value, source), (n, total) in sums.items()]
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["view", "value", "lang", "source", "length", "n", "sums"])

    return run


def what_is_sure(views: DataFrame, model: CoTrained, fitted: set[int], sure: float) -> tuple[Given, Given]:
    """What the metadata view gives the text view, and the other way round, over all rows of views but the fitted ones."""
    told = stage(views.mapInArrow(_sure_of(model, fitted, sure), SURE_SCHEMA), "sure")
    cells = told.where("view = 'text'").groupBy("value", "lang", "source", "length").agg(F.sum("n").alias("n")).orderBy("value", "lang", "source", "length").collect()  # 2 * 64 ** 3 at most
    flat = told.where("view = 'meta'").select("value", "source", "n", F.posexplode("sums").alias("pos", "x")).groupBy("value", "source", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = flat.groupBy("value", "source").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sums")).orderBy("value", "source").collect()  # 2 * 64 at most
    discard(told)
    width = len(text_features(b""))
    means = np.array([np.array(r["sums"], np.float64) / r["n"] / UNIT for r in rows], np.float32).reshape(len(rows), width)
    buckets = np.array([(r["lang"], r["source"], r["length"]) for r in cells], np.int64).reshape(len(cells), 3)
    to = lambda rows, x: Given(x, np.array([r["value"] for r in rows], np.float32), np.array([r["n"] for r in rows], np.int64))
    return to(rows, means), to(cells, meta_matrix(buckets))


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, rounds: int = 3, sure: float = 0.97, seed: int = 5) -> CoTrained:
    """Fit on labels (doc_id, quality) of docs (doc_id, text, lang, source, n_chars)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = ids.join(known, "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled).select("doc_id", F.when(F.col("quality") > 0, 1).otherwise(0).alias("label"))
    views = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *COLUMNS).mapInArrow(_views, FEATURE_SCHEMA), "views")
    # Of repeated ids the least row, so reruns agree; max_labelled rows at most.
    found = views.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("units", "lang", "source", "length")).alias("v")).select("doc_id", "label", "v.*").collect()
    if not found:
        return CoTrained(None, None, 0.0)
    found.sort(key=lambda r: r["doc_id"])
    text, meta = matrices([bytes(r["units"]) for r in found], np.array([(r["lang"], r["source"], r["length"]) for r in found]))
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found])
    fitted = {r["doc_id"] for r in found}
    model = CoTrained.of(text, meta, np.array([r["label"] for r in found]), held, lambda m: what_is_sure(views, m, fitted, sure), rounds)
    discard(views)
    return model


SCORE_SCHEMA = "doc_id long, p_text double, p_meta double, p_good double, kept boolean"


def chances_of(model: CoTrained, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units, buckets = features(part)
    return model.chances(text_matrix(units), meta_matrix(buckets))


def _score(model: CoTrained, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = [x.astype(np.float64) for x in chances_of(model, part)]
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= least)], names=["doc_id", "p_text", "p_meta", "p_good", "kept"])

    return run


def score_quality(docs: DataFrame, model: CoTrained, *, least: float = 0.5) -> DataFrame:
    """docs to doc_id, p_text, p_meta, p_good and kept (p_good >= least)."""
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *COLUMNS)
    return view.mapInArrow(_score(model, least), SCORE_SCHEMA)


def _filter(model: CoTrained, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(chances_of(model, part)[2] >= least))

    return run


def keep_good(docs: DataFrame, model: CoTrained, *, least: float = 0.5) -> DataFrame:
    """docs that the model does not reject; all columns stay."""
    return docs.mapInArrow(_filter(model, least), docs.schema)

"""Quality classifier: naive Bayes features, linear hinge loss by dual coordinate descent (operator 2).

A text is a set of n-gram indicators: its words and word pairs in lower case, and runs of one to three word shapes
(letters by case, digits and other characters, repeats collapsed, with a mark for a word that repeats the one
before). The log-count ratio of an n-gram compares how often it occurs in texts of either class. An indicator is
scaled by that ratio, a text's vector to length one, and a linear model with hinge loss is fitted in the dual, one
text at a time. A sigmoid fitted on a fifth of the sample, with a model that has not seen it, turns margins into
scores.

The fit takes at most ``SAMPLE`` labelled rows, those with the smallest hash of their doc_id; it never sees more
rows, however many are labelled. N-grams are counted by Spark; the driver gets those in at least ``MIN_TEXTS``
sampled texts and, for each sampled text, the numbers of the n-grams it has. All documents are scored, whole.

Defined results: null and empty texts have no n-gram and get the score of the bare intercept. Without labels every
score is 0.5; with labels of one class only it is that class's smoothed share. A doc_id labelled several times
counts once, with its highest label; null labels are ignored. Repeated rows get equal scores; an empty table gives
an empty result. Other columns are carried along; a column named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import batches, settle, unused

SAMPLE = 12_000
MIN_TEXTS = 5
PENALTY = 4.0
EPOCHS = 12
FOLDS = 5
KEEP_AT = 0.3

_SHAPES: dict[bytes, bytes] = {}
_KIND = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def _shape(word: bytes) -> bytes:
    """``Word-12!!`` -> ``Aa-0!``; kept for short words, forgotten when there are too many."""
    shape = _SHAPES.get(word)
    if shape is None:
        kinds = word.translate(_KIND)
        shape = bytes(c for i, c in enumerate(kinds[:64]) if not i or c != kinds[i - 1])
        if len(_SHAPES) > 500_000:
            _SHAPES.clear()
        if len(word) < 32:
            _SHAPES[word] = shape
    return shape


def grams(text: bytes | None) -> set:
    """The n-grams of a text: words as bytes, word pairs as pairs, shapes as tuples that begin with their number."""
    raw = (text or b"").split()
    words = [w.lower() for w in raw]
    shapes = [_shape(w) if w != last else b"=" for w, last in zip(raw, [None, *raw], strict=False)]
    found: set = set(words)
    found.update(zip(words, words[1:], strict=False))
    found.update((1, s) for s in set(shapes))
    found.update((2, *s) for s in set(zip(shapes, shapes[1:], strict=False)))
    found.update((3, *s) for s in set(zip(shapes, shapes[1:], shapes[2:], strict=False)))
    return found


def _name(gram: object) -> bytes:
    """One byte string per n-gram; words hold no white space, so it can be undone."""
    if isinstance(gram, bytes):
        return gram
    if isinstance(gram[0], int):
        return b" %d " % gram[0] + b" ".join(gram[1:])
    return b" ".join(gram)


def _gram(name: bytes) -> object:
    if name.startswith(b" "):
        return (int(name[1:2]), *name[3:].split(b" "))
    return tuple(name.split(b" ")) if b" " in name else name


@dataclass
class Model:
    """Weights by n-gram: (share of the squared length, weight); score = sigmoid(slope * margin + shift)."""

    grams: dict = field(default_factory=dict)
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def score(self, text: bytes | None) -> float:
        at = [self.grams[g] for g in grams(text) & self.grams.keys()]
        return float(sigmoid(self.slope * margin(at, self.ratios, self.weights, self.bias) + self.shift))


def sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def margin(at: list[int] | np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    r = ratios[at] if len(at) else np.zeros(0)
    length = np.sqrt((r * r).sum())
    return float((r * weights[at]).sum() / length + bias) if length else bias


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Log of the smoothed share of positive texts' n-grams by that of negative texts'."""
    counts = np.ones((2, size))
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge loss with squared penalty: one dual variable per text, solved exactly in turn, in shuffled order."""
    weights, bias = np.zeros(len(ratios)), 0.0
    values = []
    for row in rows:
        r = ratios[row]
        length = np.sqrt((r * r).sum())
        values.append(r / length if length else r)
    signs = np.where(labels > 0, 1.0, -1.0)
    limits = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels <= 0).sum())) * len(labels) * PENALTY
    duals = np.zeros(len(rows))
    shuffle = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in shuffle.permutation(len(rows)):
            row, value = rows[i], values[i]
            gradient = signs[i] * (weights[row] @ value + bias) - 1
            new = min(max(duals[i] - gradient / (value @ value + 1), 0.0), limits[i])
            if new != duals[i]:
                step = (new - duals[i]) * signs[i]
                weights[row] += step * value
                bias += step
                duals[i] = new
    return weights, bias


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid with the highest likelihood, by Newton steps; labels slightly smoothed."""
    positive = (labels > 0).sum()
    negative = len(labels) - positive
    goal = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = sigmoid(a @ x)
        gradient = x @ (p - goal) + 1e-3 * a
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that are not held out."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # ``sample`` bounds the broadcast side; a doc_id that occurs in many rows is thinned out to the same bound.
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = settle(rows.dropDuplicates(["doc_id"]).select("text", F.col("label").cast("long")))

    def name_all(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([_name(g) for g in grams(text.as_py())], pa.binary())], ["gram"])

    names = (
        rows.mapInArrow(name_all, "gram binary").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_TEXTS)
    )
    vocabulary = {_gram(bytes(r["gram"])): i for i, r in enumerate(names.select("gram").collect())}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches(frames):
            found = [np.sort([known[g] for g in grams(t.as_py()) & known.keys()]).astype(np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["at", "label"])

    got = rows.mapInArrow(number, "at binary, label long").collect()
    got.sort(key=lambda r: bytes(r["at"]))
    texts = [np.frombuffer(bytes(r["at"]), np.int32) for r in got]
    return fit(vocabulary, texts, np.array([int(r["label"] > 0) for r in got]))


def fit(vocabulary: dict, rows: list[np.ndarray], labels: np.ndarray) -> Model:
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(shift=float(np.log(share / (1 - share))))
    fold = np.random.default_rng(3).permutation(len(rows)) % FOLDS
    outside = fold == 0
    if len(np.unique(labels[~outside])) == 2 and outside.any():
        seen = [r for r, o in zip(rows, outside, strict=True) if not o]
        ratios = log_ratios(seen, labels[~outside], len(vocabulary))
        weights, bias = dual_descent(seen, labels[~outside], ratios)
        unseen = [r for r, o in zip(rows, outside, strict=True) if o]
        slope, shift = platt(np.array([margin(r, ratios, weights, bias) for r in unseen]), labels[outside])
    else:
        slope, shift = 1.0, 0.0
    ratios = log_ratios(rows, labels, len(vocabulary))
    weights, bias = dual_descent(rows, labels, ratios)
    return Model(vocabulary, ratios, weights, bias, slope, shift)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    at = kept.columns.index("text")
    names = [*kept.columns, name]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(frames):
            texts = batch.column(at).cast(pa.binary())
            scores = [model.score(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    return kept.mapInArrow(work, kept.withColumn(name, F.lit(0.0)).schema)


def accepted(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents with a score of at least ``keep_at``; same columns."""
    name = unused(docs, "_score")
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= keep_at).select(*docs.columns)

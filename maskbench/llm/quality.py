"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .base import mapped, remainder, staged

BITS = 18
PER_CLASS = 10_000
WIDTH = 3
SMOOTH = 1.0
COST = 1.0
ROUNDS = 12
KEEP_ABOVE = 0.3


@dataclass(frozen=True)
class Model:
    """Weights by hashed n-gram, the bias, and slope and shift of the score's logistic."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def recurrence(units: list, lags: int) -> np.ndarray:
    """A sign for each unit: 2 if it repeats the one before, 1 if one of the last ``lags``, else 0."""
    h = np.fromiter(map(hash, units), np.int64, len(units))
    sign = np.zeros(len(h), np.uint32)
    for lag in range(min(lags, len(h) - 1), 0, -1):
        sign[lag:][h[lag:] == h[:-lag]] = 2 if lag == 1 else 1
    return sign


#: Marks reused from text to text; each call clears what it has set.
_SEEN: dict[int, np.ndarray] = {}


def indicators(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct codes of the n-grams of a whole text, each kind in its own region of the hash.

    Kinds: byte n-grams; n-grams of the signs by which words, and lines, repeat earlier ones; and the power
    of two of the word count.
    """
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    words = raw.split()
    if bits not in _SEEN:
        _SEEN[bits] = np.zeros(1 << bits, bool)
    seen = _SEEN[bits]
    spread, shift = np.uint32(2654435761), np.uint32(32 - bits)
    if words:
        seen[(np.array([(9 << 24) | len(words).bit_length()], np.uint32) * spread) >> shift] = True
    code = np.zeros(len(b), np.uint32)
    for w in range(1, WIDTH + 1):
        if len(b) >= w:
            code = (code[:len(b) - w + 1] << np.uint32(8)) | b[w - 1:]
            seen[((code | np.uint32(w << 28)) * spread) >> shift] = True
    for kind, sign in ((5, recurrence(words, 8)), (6, recurrence(raw.split(b"\n"), 4))):
        for w in (1, 2, 4):
            if len(sign) >= w:
                code = np.full(len(sign) - w + 1, w, np.uint32)
                for i in range(w):
                    code = code * np.uint32(4) + sign[i:len(sign) - w + 1 + i]
                seen[((code | np.uint32(kind << 24)) * spread) >> shift] = True
    codes = np.flatnonzero(seen)
    seen[codes] = False
    return codes.astype(np.uint32)


def fit_model(rows: list[np.ndarray], good: np.ndarray, weight: np.ndarray, bits: int = BITS) -> Model:
    """Fit on the indicator rows of a bounded sample; ``weight`` tells how many labelled rows each stands for."""
    n, y = len(rows), np.where(good, 1.0, -1.0)
    ratio = np.zeros(1 << bits)
    if n == 0 or good.all() or not good.any():
        return Model(ratio, 0.0, 1.0, 8.0 if n and good.all() else -8.0 if n else 0.0)
    for cls, sign in ((True, 1.0), (False, -1.0)):
        seen = np.full(1 << bits, SMOOTH)
        for i in np.flatnonzero(good == cls):
            seen[rows[i]] += 1.0
        ratio += sign * np.log(seen / (np.count_nonzero(good == cls) + 2 * SMOOTH))
    # the scaled rows have unit length, so long texts weigh as much as short ones
    values = [ratio[r] for r in rows]
    values = [v / max(np.linalg.norm(v), 1e-9) for v in values]
    # dual coordinate descent on the hinge loss: one dual variable a row, between 0 and its cost
    w, bias, alpha = np.zeros(1 << bits), 0.0, np.zeros(n)
    cost = COST * np.where(good, 1.0, np.count_nonzero(good) / np.count_nonzero(~good))
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(n):
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    margin = np.array([w[r] @ v for r, v in zip(rows, values)]) + bias
    slope, shift = 4.0, 0.0                                  # logistic of the margin by Newton's method
    target = np.where(good, 1 - 1e-3, 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([g @ margin + 1e-3 * slope, g.sum()])
        hess = np.array([[h @ margin ** 2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return Model(np.stack([ratio, w]), bias, float(slope), float(shift))


def score_of(model: Model, codes: np.ndarray) -> float:
    if model.weights.ndim == 1:
        margin = model.bias
    else:
        v = model.weights[0][codes]
        margin = float(model.weights[1][codes] @ v) / max(float(np.linalg.norm(v)), 1e-9) + model.bias
    return float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30))))


def sample(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, lowest hash first, and the rows each stands for."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(
        "doc_id is not null and quality in (0, 1)")
    sizes = known.groupBy("quality").agg(F.count("*").alias("of_class"))
    picked = None
    for q in (0, 1):
        one = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.union(one)
    return picked.join(sizes, "quality").select(F.col("doc_id").alias("l_doc"), "quality", F.least(
        F.lit(1.0), F.lit(float(per_class)) / F.col("of_class")).alias("share"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class.

    The sample's bound is the parameter; its ids are chosen from the labels alone and, being few, are
    broadcast, so no text is shuffled but those of the sample, as hashed indicators. One task fits.
    """
    ids = F.broadcast(staged(sample(labels, per_class)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [indicators(t.as_py() or "", bits).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), b.column(1), b.column(2), b.column(3)],
                                             ["codes", "quality", "share", "doc_id"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        rows.sort(key=lambda r: (r[3], r[1], xxhash.xxh64_intdigest(r[0])))
        m = fit_model([np.frombuffer(r[0], np.uint32) for r in rows], np.array([r[1] == 1 for r in rows], bool),
                      np.array([1 / r[2] for r in rows]), bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.weights.ndim]),
                                          pa.array([m.bias]), pa.array([m.slope]), pa.array([m.shift])],
                                         ["weights", "dims", "bias", "slope", "shift"])

    rows = mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, F.col("doc_id") == F.col("l_doc"))
                  .select("text", "quality", "share", "doc_id"), features, "codes binary, quality int, share double, doc_id long")
    got = mapped(rows.repartition(1), train, "weights binary, dims long, bias double, slope double, shift double").first()
    w = np.frombuffer(got["weights"])
    return Model(w.reshape(2, -1) if got["dims"] == 2 else w, got["bias"], got["slope"], got["shift"])


def score(spark: SparkSession, docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """Add ``score`` to all columns of the documents; the model, 2 * 2^bits numbers, is broadcast."""
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    text = names.index("text")
    plain = [f"c{i}" for i in range(len(names))]             # whatever the names hold, dots too
    kept = docs.toDF(*plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = pa.array([score_of(m, indicators(t.as_py() or "", bits)) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*plain, "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return mapped(kept, run, schema).toDF(*names, "score")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, keep_above: float = KEEP_ABOVE,
             per_class: int = PER_CLASS) -> DataFrame:
    """Documents with held_out, score and predicted.

    Labels of rows whose crc32(doc_id as text) leaves no remainder by ``folds`` are never read. Null text is
    empty and gets the score that the bias gives; a label that is null or neither 0 nor 1, and a label of a
    null id, is left out; a repeated row is scored each time; columns called held_out, score or predicted
    are replaced; without labels every score is 0.5; an empty table gives an empty result.
    """
    model = fit(docs, labels.where(remainder("doc_id", folds) != 0), per_class)
    base = docs.drop("held_out", "score", "predicted")
    return (score(docs.sparkSession, base, model).withColumn("held_out", remainder("doc_id", folds) == 0)
            .withColumn("predicted", (F.col("score") >= keep_above).cast("int")))

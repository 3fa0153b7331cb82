"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

``fit`` counts, on labelled text, in how many documents of either class each hashed n-gram of 4 to
6 characters occurs, keeps those whose shares differ by more than chance explains, scales each by
its log-count ratio and fits a logistic regression on the scaled presence vectors. The fit runs on
a sample of at most ``max_rows`` labelled rows, the same rows on every run; ``score`` reads every
whole text of the table.

Edge cases: a text with no n-gram of the model (a null or empty one, say) gives no evidence and gets the
score of the bias alone, but ``NO_EVIDENCE`` at most; rows without
a label (or a null one) are not learned from; with fewer than one labelled row of either class no
n-gram counts and every score is the smoothed share of toxic rows; repeated rows and extra columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTHS = (4, 5, 6)
BITS = 22
MAX_ROWS = 6000
MAX_FEATURES = 20_000
LEAST_ROWS, LEAST_Z = 5, 4.0
STEPS, DECAY = 150, 1e-2
# Toxic rows are the rare class; an error on one counts this many times.
TOXIC_WEIGHT = 2.0
# Highest score of a text that holds nothing the model knows.
NO_EVIDENCE = 0.49
_M = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    """Kept n-gram buckets, their log-count ratios and weights; some thousand numbers at most."""

    buckets: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float


def ngram_buckets(text: str | None) -> np.ndarray:
    """Hash bucket of every character n-gram, lower-cased, white space collapsed; one array, with repeats."""
    plain = " " + " ".join((text or "").lower().split()) + " "
    points = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    found, h = [], None
    for n in range(1, LENGTHS[-1] + 1):
        if len(points) < n:
            break
        at = points[n - 1 :]
        h = at * _M if h is None else (h[: len(at)] ^ at) * _M
        h ^= h >> np.uint32(15)
        if n in LENGTHS:
            found.append((h * np.uint32(2 * n + 1)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Model of labelled texts."""
    labels = np.array([int(y) for _, y in rows], dtype=np.float64)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    nothing = np.empty(0, np.int64)
    if not n1 or not n0:
        share = (n1 + 0.5) / (len(labels) + 2)
        return Model(nothing, np.empty(0), np.empty(0), float(np.log(share / (1 - share))))
    counts = np.zeros((2, 1 << BITS), np.int32)
    for text, y in rows:
        counts[int(y)][np.unique(ngram_buckets(text))] += 1
    q, p = counts.astype(np.float64)
    both = (p + q + 1) / (n1 + n0 + 2)
    z = np.abs(p / n1 - q / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    kept = np.nonzero((p + q >= LEAST_ROWS) & (z >= LEAST_Z))[0]
    kept = np.sort(kept[np.argsort(-z[kept], kind="stable")[:MAX_FEATURES]])
    ratios = np.log((p[kept] + 1) / (n1 + 2)) - np.log((q[kept] + 1) / (n0 + 2))
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    columns = [np.unique(c[c >= 0]) for c in (place[ngram_buckets(text)] for text, _ in rows)]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    column = np.concatenate(columns)
    value = ratios[column]
    value = value / (np.sqrt(np.bincount(row, value * value, minlength=len(rows))) + 1)[row]
    weights, bias = np.ones(len(kept)), 0.0
    past, past_bias = np.full(len(kept), 1e-3), 1e-3
    for _ in range(STEPS):
        margin = np.bincount(row, weights[column] * value, minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-margin)) - labels) * np.where(labels == 1, TOXIC_WEIGHT, 1.0)
        slope, slope_bias = np.bincount(column, error[row] * value, minlength=len(kept)) + DECAY * weights, error.sum()
        past, past_bias = past + slope * slope, past_bias + slope_bias * slope_bias
        weights, bias = weights - slope / np.sqrt(past), bias - slope_bias / np.sqrt(past_bias)
    return Model(kept, ratios, weights, float(bias))


def sample(docs: DataFrame, labels: DataFrame, rows: Column, max_rows: int = MAX_ROWS) -> list[tuple[str | None, int]]:
    """At most ``max_rows`` labelled texts among the labels that ``rows`` admits, spread by a hash of doc_id."""
    wanted = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & rows).select("doc_id", "toxic")
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    # The hinted side has max_rows rows of two numbers at most.
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "toxic", F.xxhash64("text"))
    return [(r["text"], r["toxic"]) for r in found.limit(max_rows).toLocalIterator()]


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Column ``out``: the probability of label 1, from the text alone."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[model.buckets] = np.arange(len(model.buckets))
        squares, scaled = model.ratios**2, model.weights * model.ratios
        no_evidence = np.log(NO_EVIDENCE / (1 - NO_EVIDENCE))
        for batch in batches:
            margins = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                at = place[ngram_buckets(t)]
                at = np.unique(at[at >= 0])
                margins[i] = scaled[at].sum() / (np.sqrt(squares[at].sum()) + 1) + model.bias
                if not len(at):
                    margins[i] = min(margins[i], no_evidence)
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(1 / (1 + np.exp(-margins)))], names=[*keep, out])

    return df.mapInArrow(run, schema)

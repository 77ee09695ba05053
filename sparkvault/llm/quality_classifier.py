"""Quality scores by regularised quadratic discriminant analysis (operator 9).

Each document becomes a vector of transformed statistics of its text. The
classes' means and covariances come from one aggregation over all labelled
training rows (sums and sums of products, which add up in any order). Each
covariance is shrunk towards the pooled one and that towards its diagonal;
its Cholesky factor is computed once. A score is the logistic of the
log-density difference, two Mahalanobis distances and the log-determinants,
plus the log prior ratio.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvault.llm._common import materialize, slices, text_bytes, trimmed

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "marks", "bars", "stops", "non_ascii",
    "spaces", "lines", "repeated_lines", "distinct_words", "short_words", "ended_words",
)
#: Shrinkage of a class covariance towards the pooled one, and of the result towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
#: Bytes of text looked at at once.
CHUNK = 4 << 20

# Byte classes, one bit each.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>@^~={}[]_\\", "marks": b"!?",
    "bars": b"|", "stops": b".,;:", "blank": b" \t\n\x0b\f\r",
}


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null counts as empty."""
    texts = [t or b"" for t in texts]
    out = np.empty((len(texts), len(FEATURES)))
    tables = {name: np.isin(np.arange(256), list(members)).astype(np.uint8) for name, members in _CLASSES.items()}
    tables["non_ascii"] = (np.arange(256) >= 128).astype(np.uint8)
    for first, last in slices([len(t) + 1 for t in texts], CHUNK):
        some = texts[first:last]
        # A newline after each text keeps the sums of empty texts apart; it is taken off again.
        joined = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in some])
        starts = np.concatenate([[0], ends[:-1]])
        sums = {name: np.add.reduceat(table[joined], starts, dtype=np.int64) for name, table in tables.items()}
        n = np.maximum(ends - starts - 1, 1)
        sums["blank"] -= 1
        for i, t in enumerate(some):
            words, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            w, size = max(1, len(words)), int(n[i])
            out[first + i] = (
                np.log1p(len(words)),
                np.log1p(lengths.sum() / w),
                *(np.sqrt(sums[c][i] / size) for c in ("upper", "digits", "symbols", "marks", "bars", "stops", "non_ascii", "blank")),
                np.log1p(len(lines) / w * 50),
                np.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
                len(set(words)) / w,
                float((lengths <= 2).mean()) if words else 0.0,
                np.sqrt(sum(not x[-1:].isalpha() and x[-1] < 128 for x in words) / w),
            )
    return out


def with_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x array<double>) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(text_bytes(batch, "text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch({"key": batch.column("key"), "x": values})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"key {kind}, x array<double>")


@dataclass
class Discriminant:
    """Frozen class models."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_prior_ratio: float
    cap: float = 30.0

    @classmethod
    def from_moments(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_diagonal: float) -> Discriminant:
        """``moments``: of class 0 and 1 the count, the sums and the sums of products."""
        means, spread, total = [], [], 0.0
        for c in (0, 1):
            n, s, p = moments[c]
            means.append(s / n)
            spread.append(p - np.outer(s, s) / n)
            total += n
        pooled = (spread[0] + spread[1]) / max(1.0, total - 2)
        factors, log_dets = [], []
        for c in (0, 1):
            own = spread[c] / max(1.0, moments[c][0] - 1)
            weight = to_pooled + (1 - to_pooled) * (len(pooled) / (len(pooled) + moments[c][0]))
            cov = (1 - weight) * own + weight * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
            factors.append(np.linalg.cholesky(cov))
            log_dets.append(2 * float(np.log(np.diag(factors[-1])).sum()))
        return cls(means, factors, log_dets, float(np.log(moments[1][0] / moments[0][0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from 0 to 1."""
        d = []
        for c in (0, 1):
            z = (x - self.means[c]).T.copy()
            for i, row in enumerate(self.factors[c]):  # forward substitution, as the factor is triangular
                z[i] = (z[i] - row[:i] @ z[:i]) / row[i]
            d.append((z * z).sum(axis=0) + self.log_dets[c])
        logit = np.clip((d[0] - d[1]) / 2 + self.log_prior_ratio, -self.cap, self.cap)
        return 1 / (1 + np.exp(-logit))


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant | None:
    """The class models of ``rows`` (x array<double>, label 0 or 1); None unless both classes are there.

    The sums of every partition are added by Spark; the driver sees one row
    for each class and sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                if len(own := x[label == c]):
                    s = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    sums[c] = sums[c] + s if c in sums else s
        for c, s in sums.items():
            yield pa.record_batch({"label": pa.array([c] * len(s), pa.int32()), "at": pa.array(range(len(s)), pa.int32()), "v": pa.array(s)})

    parts = rows.select("x", "label").mapInArrow(trimmed(run), "label int, at int, v double")
    collected = parts.groupBy("label", "at").agg(F.sum("v").alias("v")).orderBy("label", "at").toPandas()
    moments = {}
    for c, own in collected.groupby("label"):
        v = own["v"].to_numpy()
        d = round((-1 + (1 + 4 * (len(v) - 1)) ** 0.5) / 2)
        moments[int(c)] = (float(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return Discriminant.from_moments(moments, to_pooled, to_diagonal) if set(moments) == {0, 1} else None


def score(rows: DataFrame, model: Discriminant | None, threshold: float = 0.3) -> DataFrame:
    """``rows`` (key, x, ...) with score double and predicted int instead of x; 0.5 without a model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in rows.columns if c not in ("x", "score", "predicted")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            s = shared.value.scores(x) if shared.value and len(x) else np.full(len(x), 0.5)
            yield pa.record_batch({c: batch.column(c) for c in columns} | {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return rows.mapInArrow(trimmed(run), f"{kinds}, score double, predicted int")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Callable[[Column], Column],
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.3,
) -> DataFrame:
    """(key, score, predicted) of every row of ``docs``, learnt from the labelled rows of ``learn_from``.

    ``learn_from`` makes a condition of the key's column. Keys labelled more than once
    with different values teach nothing; labels other than 0 and 1 are
    ignored. Without both classes every score is 0.5. Empty and null texts
    are scored like any text; repeated rows stay; an empty table gives an
    empty table.
    """
    x = materialize(with_features(docs, key, text), "features")
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter(F.col("label").isin(0, 1))
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("key", "label")
    train = x.filter(learn_from(F.col("key"))).join(known, "key")
    return score(x, fit(train), threshold).withColumnRenamed("key", key)


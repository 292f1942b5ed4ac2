"""Toxicity severity by cumulative-link (ordinal) logistic regression.

A text is its set of hashed words and word beginnings, of which those take part that tell the labels apart beyond chance. One weight vector w is shared by all grades; with ordered thresholds
t_1 < t_2 < ..., P(grade >= k) = sigmoid(w.x - t_k). The output is the expected severity, the sum of P(grade >= k).

Labels say only whether a text is toxic, so grades are made from them: 0 is not toxic; toxic texts are graded from 1 up by how many of
their features are marks (taking part, and found more often in toxic texts), in equal parts of the toxic texts, GRADES at most. Near copies
count once in all this. The model is fitted on a bounded sample of labelled rows, TRAIN_ROWS by hash of the id, on the driver; every
document is scored on the executors with the weights of the features that take part.

Defined results: a null or empty text has no features; it gets severity 0 and is not toxic. Labels that are null or without a document are not used; an id that is labelled twice counts as toxic if one label says so.
Repeated rows are scored one by one. Without a toxic or without a clean label every severity is 0 (or 1, if all labels are toxic). An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.llm.words import PUNCTUATION, Words, _BYTES, column_words, mix, span_hashes

FEATURE_BITS = 31
TRAIN_ROWS = 12_000
GRADES = 3
BEGINNINGS = (4, 5, 6, 8)  # bytes of a word's beginning that are a feature, for longer words


def words_and_beginnings(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), as often as it occurs."""
    row, size = w.owner(), w.ends - w.starts
    found = [(row, w.hashes)]
    data = w.data.astype(np.uint64) + np.uint64(1)
    for k in BEGINNINGS:
        longer = np.flatnonzero(size > k)
        found.append((row[longer], mix(span_hashes(data, w.starts[longer], w.starts[longer] + k, _BYTES) ^ np.uint64(1000 + k))))
    return np.concatenate([f[0] for f in found]), (np.concatenate([f[1] for f in found]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def once(row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row << FEATURE_BITS | name)
    return both >> FEATURE_BITS, both & (1 << FEATURE_BITS) - 1


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def text_features(texts: pa.Array) -> pa.Array:
    counts, names = [], []
    for w in column_words(texts, fold=True, breaks=PUNCTUATION):
        row, name = once(*words_and_beginnings(w))
        counts.append(np.bincount(row, minlength=w.rows))
        names.append(name.astype(np.int32))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(names) if names else np.zeros(0, np.int32)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def evidence(row: np.ndarray, name: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature: the log-likelihood ratio of its being found apart by label, and whether toxic texts have it more often."""
    size, n = int(name.max(initial=0)) + 1, np.array([toxic.sum(), (~toxic).sum()], np.float64)
    have = np.stack([np.bincount(name[toxic[row]], minlength=size), np.bincount(name[~toxic[row]], minlength=size)]).astype(np.float64)
    table = np.stack([have, n[:, None] - have])
    expected = table.sum(1, keepdims=True) * n[None, :, None] / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * np.where(table > 0, table * np.log(table / expected), 0.0).sum((0, 1))
    return ratio, have[0] * n[1] > have[1] * n[0]


def grades(row: np.ndarray, name: np.ndarray, toxic: np.ndarray, marks: np.ndarray, most: int = GRADES) -> np.ndarray:
    """0 for clean texts; 1 to `most` for toxic ones, by their number of marks."""
    count = np.bincount(row[marks[name]], minlength=len(toxic))
    out = np.zeros(len(toxic), np.int64)
    mine = np.sort(count[toxic])
    cuts = sorted({mine[len(mine) * k // most] for k in range(1, most)} - {mine[0]}) if len(mine) else []
    out[toxic] = 1 + np.searchsorted(cuts, count[toxic], "right")
    return out


@dataclass
class OrdinalModel:
    names: np.ndarray  # of the features that take part, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def places(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the features take part, and where they are in names."""
        if not len(self.names):
            none = np.zeros(0, np.int64)
            return none, none
        spot = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        hit = np.flatnonzero(self.names[spot] == name)
        return hit, spot[hit]

    def severity(self, row: np.ndarray, name: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and P(grade >= 1) of texts with these features."""
        if not len(self.thresholds):
            return np.zeros(rows), np.zeros(rows)
        hit, spot = self.places(name)
        both = np.unique(row[hit] * max(1, len(self.names)) + spot)
        z = np.bincount(both // max(1, len(self.names)), self.weights[both % max(1, len(self.names))], minlength=rows) if len(both) else np.zeros(rows)
        p = _sigmoid(z[:, None] - self.thresholds[None, :])
        full = np.bincount(row, minlength=rows) > 0
        return np.where(full, p.sum(1), 0.0), np.where(full, p[:, 0], 0.0)


NO_MODEL = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def fit(row: np.ndarray, name: np.ndarray, grade: np.ndarray, rounds: int = 400, penalty: float = 1e-4, step: float = 0.1) -> OrdinalModel:
    """Proportional-odds likelihood with a quadratic penalty, by Adam on all rows. Thresholds are a first one and positive gaps."""
    top, rows = int(grade.max(initial=0)), len(grade)
    if not top or not (grade == 0).any():
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(1, -40.0)) if top else NO_MODEL
    used, column = np.unique(name, return_inverse=True)
    if not len(used):  # nothing tells the grades apart: their shares are all there is
        more = np.array([(grade >= k).mean() for k in range(1, top + 1)])
        return OrdinalModel(used, np.zeros(0), np.log((1 - more) / more))
    share = (grade > 0).mean()
    theta = np.concatenate([np.zeros(len(used)), [np.log((1 - share) / share)], np.zeros(top - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # Clean and toxic texts weigh the same together: severity is meant for all texts, not for the share of toxic ones in the labels.
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())
    for t in range(1, rounds + 1):
        w, first, gaps = theta[: len(used)], theta[len(used)], np.exp(theta[len(used) + 1 :])
        cuts = np.concatenate([[first], first + np.cumsum(gaps)])
        z = np.bincount(row, w[column], minlength=rows)
        over = np.concatenate([np.ones((rows, 1)), _sigmoid(z[:, None] - cuts[None, :]), np.zeros((rows, 1))], 1)
        lo, hi = np.take_along_axis(over, grade[:, None], 1)[:, 0], np.take_along_axis(over, grade[:, None] + 1, 1)[:, 0]
        p = np.maximum(lo - hi, 1e-12)
        d_lo, d_hi = lo * (1 - lo) / p * weight, hi * (1 - hi) / p * weight  # of the log-likelihood, by z at either threshold
        g_w = -np.bincount(column, (d_lo - d_hi)[row], minlength=len(used)) + penalty * w
        g_cut = np.array([(d_lo[grade == k + 1]).sum() - (d_hi[grade == k]).sum() for k in range(top)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(used, theta[: len(used)], theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """The model fitted on `rows` labelled documents at most, those with the least hash of their id."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    found = docs.join(chosen, docs[id_col].cast("long") == F.col("_id")).groupBy("_id").agg(F.min(text_col).alias("_text"), F.first("_toxic").alias("_toxic"))
    # Copies and near copies of one text would make marks of all its words: texts with the same least window count once.
    single = found.withColumn("_w", least_window(F.col("_text"))).groupBy("_w", "_toxic").agg(F.min(F.struct("_id", "_text")).alias("r"))
    table = single.select(F.col("_toxic"), text_features(F.col("r._text")).alias("f")).toArrow()
    if not table.num_rows:
        return NO_MODEL
    lists = table.column("f").combine_chunks()
    name = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    toxic = table.column("_toxic").to_numpy() > 0
    return fit_labels(row, name, toxic)


def fit_labels(row: np.ndarray, name: np.ndarray, toxic: np.ndarray) -> OrdinalModel:
    """Choose the features that tell the labels apart, grade the toxic texts by their marks, and fit."""
    names, column = np.unique(name, return_inverse=True)
    ratio, bad = evidence(row, column, toxic)
    # As much as the best of so many features reaches by chance, about: twice the logarithm of their number.
    used = ratio >= 2 * np.log(max(2, len(names)))
    grade = grades(row, column, toxic, used & bad)
    keep = used[column]
    return fit(row[keep], name[keep], grade)


@F.arrow_udf(T.LongType())
def least_window(texts: pa.Array) -> pa.Array:
    """The least hash of a text's five-word windows, or of its words where there are fewer: near copies have it in common."""
    out = []
    for w in column_words(texts, fold=True, breaks=PUNCTUATION):
        size = min(5, int(w.counts.max(initial=1)) or 1)
        _, hashes, at = w.windows(size)
        least = np.zeros(w.rows, np.uint64)
        full = np.diff(at) > 0
        if full.any():
            least[full] = np.minimum.reduceat(hashes, at[:-1][full])
        few = np.flatnonzero(~full & (w.counts > 0))
        least[few] = w.span_hashes(w.first[few], w.first[few + 1])
        out.append(least.view(np.int64))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the features of a bounded sample that take part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for w in column_words(b.column(1), fold=True, breaks=PUNCTUATION):
                severity, p = m.severity(*words_and_beginnings(w), w.rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row, w.rows), pa.array(severity), pa.array(p), pa.array(p >= threshold)], ["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")

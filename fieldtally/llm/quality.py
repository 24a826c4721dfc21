"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight per hashed character trigram is shared by all grades; ordered thresholds cut the score into grades:
P(grade >= k) = logistic(score - threshold k). The expected grade and the probability of the upper grades select documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import distinct_labelled, ngram_buckets, sampled_rows, sampled_texts


def vector(text: str | None, buckets: int) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, case and marks as they are; empty texts are zero."""
    found = np.bincount(ngram_buckets(text or "", 3, buckets), minlength=buckets).astype(np.float32)
    total = found.sum()
    return np.sqrt(found / total) if total else found


class Model:
    """Weights by bucket and ascending thresholds, one fewer than grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, vectors: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        score = vectors @ self.weights.astype(vectors.dtype, copy=False)
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def _vectors(buckets: int):
    """Used buckets and their values of sampled texts; no text leaves its task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                found = vector(text.as_py(), buckets)
                used = np.flatnonzero(found)
                sent = [pa.array([a.tobytes()], pa.binary()) for a in (used.astype(np.int32), found[used])]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in ("h1", "h2")] + sent, names=["h1", "h2", "used", "share"])

    return work


def fit(
    docs: DataFrame, rated: DataFrame, grades: int, buckets: int = 4096, sample: int = 6000, rounds: int = 300, rate: float = 0.3
) -> Model:
    """Learns from ``docs`` (``doc_id, text``) and ``rated`` (``doc_id, grade``, 0 to ``grades`` - 1): at most ``sample`` distinct texts,
    chosen by a hash of their text.

    Copies of a text with one grade are one row, that is chosen the sooner and weighs more, by the logarithm of their number. Ids,
    hashes and grades are joined, never texts; the texts of the sample are read where they are, and the driver gets their vectors.
    """
    known = rated.where("grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    rows = sampled_rows(distinct_labelled(docs, known, "grade"), sample)
    steps = np.linspace(-1, 1, grades - 1)
    if not rows:
        return Model(np.zeros(buckets, np.float32), steps)
    sent = sampled_texts(docs, rows).mapInArrow(_vectors(buckets), "h1 long, h2 long, used binary, share binary").collect()
    found = {(r.h1, r.h2): (np.frombuffer(r.used, np.int32), np.frombuffer(r.share, np.float32)) for r in sent}
    x = np.zeros((len(rows), buckets), np.float32)
    for line, r in zip(x, rows):
        used, share = found[r.h1, r.h2]
        line[used] = share
    y = np.array([r.grade for r in rows])
    above = (y[:, None] >= np.arange(1, grades)[None, :]).astype(np.float64)
    copies = np.array([r.weight for r in rows])
    share = np.bincount(y, copies, minlength=grades) / copies.sum()
    weight = copies * (1.0 / np.maximum(share[y], 1e-3)) ** 0.5
    weight /= weight.sum()
    w, first, gaps = np.zeros(buckets), steps[0], np.log(np.maximum(np.diff(steps), 1e-3))
    state = [np.zeros(buckets), np.zeros(buckets), np.zeros(grades - 1), np.zeros(grades - 1)]
    for t in range(1, rounds + 1):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        tails = Model(w, cuts).tails(x)
        whole = np.concatenate([np.ones((len(y), 1)), tails, np.zeros((len(y), 1))], 1)
        likely = np.maximum(whole[np.arange(len(y)), y] - whole[np.arange(len(y)), y + 1], 1e-9)
        slope = tails * (1 - tails)  # of each tail by the score
        own = (above - np.pad(above[:, 1:], ((0, 0), (0, 1))) > 0) * slope  # the tail at the row's grade
        up = np.zeros_like(slope)
        rest = y < grades - 1
        up[np.flatnonzero(rest), y[rest]] = slope[np.flatnonzero(rest), y[rest]]
        pull = (own - up) / likely[:, None] * weight[:, None]
        grad_w = pull.sum(1).astype(np.float32) @ x - 1e-4 * w
        grad_cut = -pull.sum(0)
        grad_c = np.concatenate([[grad_cut.sum()], np.cumsum(grad_cut[::-1])[::-1][1:] * np.exp(gaps)])
        out = []
        for value, grad, m, v in ((w, grad_w, state[0], state[1]), (np.concatenate([[first], gaps]), grad_c, state[2], state[3])):
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.999 * v + 0.001 * grad**2
            out.append(value + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
        w, first, gaps = out[0], out[1][0], out[1][1:]
    return Model(w.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _grader(model: Model, least: int, keep: float):
    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [np.zeros((0, len(model.thresholds)))]
            texts = batch.column("text")
            for first in range(0, len(texts), 500):
                block = np.stack([vector(t.as_py(), len(model.weights)) for t in texts[first : first + 500]])
                tails.append(model.tails(block))
            tails = np.concatenate(tails)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (tails.sum(1), tails[:, least - 1], tails[:, least - 1] >= keep))],
                names=["doc_id", "expected_grade", "tail_probability", "keep"],
            )

    return grade


def graded(docs: DataFrame, model: Model, least: int = 1, keep: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_probability`` (of grade ``least`` or more) and ``keep`` for every row.

    NULL and empty texts have the score zero. Repeated rows each get their row; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_grader(model, least, keep), "doc_id long, expected_grade double, tail_probability double, keep boolean")

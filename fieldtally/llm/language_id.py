"""Language identification as a mixture of languages per document.

Each language is a distribution over hashed character trigrams, counted over all training documents. A document's
proportions of languages come from expectation-maximisation on the likelihood of its trigrams; the set of languages
is the one with the best likelihood less a penalty per language. The largest proportion names the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldtally.llm.common import ngram_buckets, quoted

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def trigrams(text: str, size: int, buckets: int) -> np.ndarray:
    """Buckets of the runs of letters in lower case; everything else counts as one blank."""
    return ngram_buckets(_OTHER.sub(" ", text.lower()), size, buckets)


class Model:
    """Names of the languages and the log probability of every bucket in each."""

    def __init__(self, names: list[str], log_p: np.ndarray, size: int):
        self.names, self.log_p, self.size = names, log_p, size


def _counter(size: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = totals.setdefault(lang, np.zeros(buckets, np.int64))
                found, times = np.unique(trigrams(text.as_py(), size, buckets), return_counts=True)
                own[found] += times
        for lang, own in totals.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int64()), "n": pa.array(own[used])
            })

    return count


def learn(labelled: DataFrame, size: int = 3, buckets: int = 1 << 14, most_languages: int = 500, prior: float = 0.1) -> Model:
    """Counts all rows of ``labelled`` (``text, lang``); rows without either are left out.

    What reaches the driver is one number per language and bucket; more than ``most_languages`` are refused.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", "text")
    counted = known.mapInArrow(_counter(size, buckets), "lang string, bucket long, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.limit(most_languages * buckets + 1).toArrow()
    if rows.num_rows > most_languages * buckets:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted(set(rows.column("lang").to_pylist()))
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    place = {name: i for i, name in enumerate(names)}
    counts = np.full((len(names), buckets), prior)
    at = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[at, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    log_p = np.log(counts / counts.sum(1, keepdims=True)) if names else counts
    return Model(names, log_p.astype(np.float32), size)


def proportions(log_p: np.ndarray, times: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Share of each language (row of ``log_p``) in a document; languages outside the chosen set have none.

    ``log_p`` has a column per distinct trigram, ``times`` how often it occurs. All languages are tried together first;
    then sets of the largest ones, from one language up, as long as the likelihood gains more than the penalty.
    """
    n, total = len(log_p), times.sum()
    alone = log_p @ times
    best = int(np.argmax(alone))
    share = np.zeros(n)
    share[best] = 1.0
    if n == 1:
        return share
    peak = log_p.max(0)
    p = np.exp(log_p - peak)
    base = float(peak @ times)

    def fit(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        own = p[chosen]
        weight, before = np.full(len(chosen), 1.0 / len(chosen)), -np.inf
        for _ in range(rounds):
            mixed = weight @ own
            weight = weight * (own @ (times / mixed)) / total
            value = float(np.log(mixed) @ times)
            if value - before < 0.05:
                break
            before = value
        return weight, float(np.log(np.maximum(weight @ own, 1e-30)) @ times) + base

    cost = penalty * np.log(total + 1.0)
    whole, value = fit(np.arange(n))
    if value - alone[best] <= cost:  # no larger set can make up for its penalty
        return share
    order, kept = np.argsort(-whole, kind="stable"), float(alone[best])
    for k in range(2, n + 1):
        weight, value = fit(order[:k])
        if value - kept <= cost:
            break
        share, kept = np.zeros(n), value
        share[order[:k]] = weight
    return share


def _identifier(model: Model, rounds: int, penalty: float, names: tuple[str, str]):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = model.log_p.shape[1]
        for batch in batches:
            langs, scores = [], []
            for value in batch.column("text"):
                text = value.as_py()
                if text is None or not model.names or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                found, times = np.unique(trigrams(text, model.size, buckets), return_counts=True)
                share = proportions(model.log_p[:, found].astype(np.float64), times.astype(np.float64), rounds, penalty)
                best = int(np.argmax(share))
                langs.append(model.names[best])
                scores.append(float(min(1.0, max(0.0, share[best]))))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return identify


def identified(
    docs: DataFrame, model: Model, rounds: int = 12, penalty: float = 4.0, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the language of the largest proportion and that proportion, under ``names``.

    NULL texts and texts without a letter are ``und`` with score 0, as is everything where nothing was learned.
    Columns of ``docs`` with these names are replaced; all others, and repeated rows, stay.
    """
    columns = [c for c in docs.columns if c not in names]
    # under plain names through the tasks, as a name may hold anything
    kept = docs.select(*quoted(columns)).toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(columns)])
    added = [StructField(name, kind) for name, kind in zip(("lang_pred", "score"), (StringType(), DoubleType()))]
    schema = StructType([*kept.schema.fields, *added])
    return kept.mapInArrow(_identifier(model, rounds, penalty, ("lang_pred", "score")), schema).toDF(*columns, *names)

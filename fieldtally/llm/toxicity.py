"""Toxic spans by a linear-chain conditional random field over words.

Labels are given per document. A word of a toxic document is labelled toxic if its form or its beginning is clearly more
frequent, by documents, in toxic than in other documents of all training rows, copies counted once and once more each
time they double; all words of other documents are not.
The field has two states, weights for hashed features of a word and of its neighbours, and weights for the four
transitions, and is fitted by forward-backward on a bounded sample of labelled documents of any length, long ones cut into
windows. Marginals of all words give the spans; the document's score is a logistic function of how much toxic mass they
hold, calibrated on whole documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage, distinct_labelled, sampled_rows, sampled_texts, with_digest

_WORD = re.compile(r"\w+")
_FEATURES = 3  # form, beginning, previous form with this one's beginning


class Hashes(dict):
    """Hashes of a word's form (low half) and beginning (high half), kept between texts and emptied at 400,000 words."""

    def __init__(self, start: int):
        self.start = start

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        low = word.lower()
        pair = xxhash.xxh32_intdigest("w" + low) | xxhash.xxh32_intdigest("h" + low[: self.start]) << 32
        self[word] = pair
        return pair


def features(text: str | None, buckets: int, known: Hashes) -> np.ndarray:
    """Buckets of every word, one row each."""
    words = _WORD.findall(text) if text else []
    pairs = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    rows = np.empty((len(words), _FEATURES), np.int64)
    rows[:, 0], rows[:, 1] = pairs & np.uint64(0xFFFFFFFF), pairs >> np.uint64(32)
    rows[:1, 2], rows[1:, 2] = 0, rows[:-1, 1] * 7919
    rows[:, 2] += rows[:, 1] * 104729
    return rows % buckets


def places(text: str, chosen: np.ndarray) -> list[tuple[int, int]]:
    """Start and end, in code points, of the words with the ascending numbers ``chosen``."""
    wanted = set(chosen.tolist())
    return [m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted]


class Field:
    """Weights of the two-state chain: ``emit`` per bucket for state 1 (state 0 has none), ``step`` from state to state."""

    def __init__(self, buckets: int, start: int):
        self.buckets, self.start = buckets, start
        self.emit = np.zeros(buckets)
        self.bias = -3.0
        self.step = np.zeros((2, 2))
        self.slope, self.level = 1.0, 0.0
        self.lexicon: frozenset[int] = frozenset()

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of state 1 at every word.

        ``scores`` is (documents, longest), padded; rows are worked on side by side. The passes carry the odds of state 1
        against state 0.
        """
        count, longest = scores.shape
        alive = np.arange(longest)[None, :] < lengths[:, None]
        (s00, s01), (s10, s11) = np.exp(self.step).tolist()
        gain = np.exp(np.clip(scores, -30, 30)).T.copy()
        forward, backward = np.empty((longest, count)), np.ones((longest, count))
        forward[0] = gain[0]
        for t in range(1, longest):
            odds = forward[t - 1]
            forward[t] = gain[t] * (s01 + s11 * odds) / (s00 + s10 * odds)
        ends = np.bincount(np.maximum(lengths, 1) - 1, minlength=longest)
        for t in range(longest - 1, 0, -1):
            odds = gain[t] * backward[t]
            backward[t - 1] = (s10 + s11 * odds) / (s00 + s01 * odds)
            if ends[t - 1]:
                backward[t - 1, lengths <= t] = 1.0
        both = forward * backward
        return (both / (1.0 + both)).T * alive

    def pairs(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each pair of states, summed over a document's steps: by the state before and after."""
        count, longest = scores.shape
        found = self.marginals(scores, lengths)
        out = np.zeros((count, 2, 2))
        if longest < 2:
            return out
        # given the state before, the state after depends only on what follows: solved from both marginals
        step, gain = np.exp(self.step), np.exp(np.clip(scores, -30, 30))
        backward = np.ones((count, longest))
        for t in range(longest - 1, 0, -1):
            odds = gain[:, t] * backward[:, t]
            before = (step[1, 0] + step[1, 1] * odds) / (step[0, 0] + step[0, 1] * odds)
            backward[:, t - 1] = np.where(t < lengths, before, 1.0)
        odds = gain[:, 1:] * backward[:, 1:]
        alive = np.arange(1, longest)[None, :] < lengths[:, None]
        for i in (0, 1):
            after = step[i, 1] * odds / (step[i, 0] + step[i, 1] * odds)
            own = (found[:, :-1] if i else 1.0 - found[:, :-1]) * alive
            out[:, i, 1], out[:, i, 0] = (own * after).sum(1), (own * (1.0 - after)).sum(1)
        return out

    def word_scores(self, rows: np.ndarray) -> np.ndarray:
        return self.emit[rows].sum(1) + self.bias

    def batches(self, documents: list[np.ndarray], cells: int = 400_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Documents of like length side by side: their numbers, padded scores, lengths. No batch exceeds ``cells`` by much."""
        order = sorted(range(len(documents)), key=lambda i: len(documents[i]))
        first = 0
        while first < len(order):
            end = first + 1
            while end < len(order) and (end + 1 - first) * max(1, len(documents[order[end]])) <= cells:
                end += 1
            chosen = order[first:end]
            lengths = np.array([len(documents[i]) for i in chosen])
            scores = np.zeros((len(chosen), max(1, int(lengths.max()))))
            for row, i in zip(scores, chosen):
                row[: len(documents[i])] = self.word_scores(documents[i])
            yield chosen, scores, lengths
            first = end

    def all_marginals(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(documents)
        for chosen, scores, lengths in self.batches(documents):
            for i, row, n in zip(chosen, self.marginals(scores, lengths), lengths):
                out[i] = row[:n]
        return out

    def mass(self, marginal: np.ndarray) -> float:
        """Log odds that any word is toxic, from the marginals as if independent."""
        none = np.log1p(-np.minimum(marginal, 1 - 1e-9)).sum()
        return float(np.clip(np.log(-np.expm1(min(none, -1e-12))) - none, -25, 25))

    def score(self, marginal: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.mass(marginal) + self.level, -30, 30))))


def _counts(buckets: int, start: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, known = np.zeros((2, buckets)), Hashes(start)
        for batch in batches:
            for text, label, weight in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("toxic", "weight"))):
                totals[int(label > 0), np.unique(features(text.as_py(), buckets, known)[:, :2])] += weight
        for label in (0, 1):
            used = np.flatnonzero(totals[label])
            yield pa.RecordBatch.from_pydict({
                "label": pa.array(np.full(len(used), label), pa.int64()), "bucket": pa.array(used, pa.int64()), "n": pa.array(totals[label, used]),
            })

    return count


def lexicon(docs: DataFrame, known: DataFrame, buckets: int, start: int, odds: float, least: int) -> tuple[frozenset[int], int, int]:
    """Buckets of words and beginnings found in ``least`` or more toxic documents and there ``odds`` times as often; documents per label.

    Counted over all texts of ``known``, one document each, as often as it weighs. Every text is shuffled once, by its document,
    to meet its label, at any size of the tables; what reaches the driver is at most one number per bucket and label.
    """
    weighed = known.select("doc_id", "h1", "h2", "toxic", (F.col("weight") / F.col("rows")).alias("weight"))
    labelled = with_digest(docs).join(weighed.hint("merge"), ["doc_id", "h1", "h2"]).select("text", "toxic", "weight")
    counted = labelled.mapInArrow(_counts(buckets, start), "label long, bucket long, n double")
    sums = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    size = known.agg(F.sum(F.when(F.col("toxic") > 0, F.col("weight"))), F.sum("weight")).first()
    toxic, clean = int(size[0] or 0), int((size[1] or 0) - (size[0] or 0))
    table = np.zeros((2, buckets))
    table[sums.column("label").to_numpy(), sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    rate = (table[1] / max(1, toxic)) / ((table[0] + 0.5) / max(1, clean))
    return frozenset(np.flatnonzero((table[1] >= least) & (rate >= odds)).tolist()), toxic, clean


def windows(lengths: list[int], longest: int, budget: int) -> list[tuple[int, int, int]]:
    """Document, first and end word of training windows of at most ``longest`` words, which cover all documents.

    Where that makes more than ``budget`` words, long documents give as many windows as fit, spread over their whole text.
    """
    counts = np.array([-(-n // longest) for n in lengths], np.int64)
    most = int(counts.max(initial=1))
    low, high = 1, most
    while low < high:  # the largest number of windows a document may give
        middle = (low + high + 1) // 2
        words = sum(n if c <= middle else middle * longest for n, c in zip(lengths, counts))
        low, high = (middle, high) if words <= budget else (low, middle - 1)
    out = []
    for i, (n, count) in enumerate(zip(lengths, counts)):
        for k in np.unique(np.linspace(0, count - 1, min(int(count), low)).round().astype(int)) if n else ():
            out.append((i, int(k * n // count), int((k + 1) * n // count)))
    return out


def _keyed(kind: str, answer):
    """A task over rows ``h1, h2, text`` that answers with rows ``h1, h2`` and what ``answer(key, text)`` yields."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("text")):
                rows = [(a, b, *found) for found in answer((a, b), text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["h1", "h2", *(k.split()[0] for k in kind.split(", "))])

    return work, f"h1 long, h2 long, {kind}"


def fit(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 18,
    start: int = 5,
    sample: int = 1500,
    longest: int = 800,
    rounds: int = 25,
    odds: float = 8.0,
    least: int = 3,
) -> Field:
    """Learns from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    The field is fitted on at most ``sample`` distinct documents of each label, of any length, chosen by a hash of their text, in
    windows of at most ``longest`` words and ``sample * longest`` words a label; slope and level are set on the whole documents,
    by their tasks. Copies of a document are one, that is chosen the sooner and weighs more, by the logarithm of their number. The
    word counts behind the labels cover all distinct documents. Texts do not reach the driver: only the windows' numbers do.
    Without a toxic row every document gets one low score.
    """
    marked = labels.where("toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = cut_lineage(distinct_labelled(docs, marked, "toxic"))
    field = Field(buckets, start)
    field.lexicon, toxic, _ = lexicon(docs, known, buckets, start, odds, least)
    rows = [r for want in ("toxic > 0", "toxic <= 0") for r in sampled_rows(known.where(want), sample)]
    if not toxic or not rows:
        field.slope, field.level = 0.0, -3.0
        return field
    marks = np.zeros(buckets, bool)
    marks[list(field.lexicon)] = True
    labels = np.array([r.toxic for r in rows]) > 0
    copies = np.array([r.weight for r in rows])
    keys = [(r.h1, r.h2) for r in rows]
    picked = sampled_texts(docs, rows)
    sizes = _keyed("n long", lambda key, text: [(sum(1 for _ in _WORD.finditer(text)),)])
    lengths = {(r.h1, r.h2): r.n for r in picked.mapInArrow(*sizes).collect()}
    cuts = []
    for label in (True, False):
        mine = np.flatnonzero(labels == label)
        cuts += [(mine[i], a, b) for i, a, b in windows([lengths[keys[i]] for i in mine], longest, sample * longest)]
    if not cuts:
        field.slope, field.level = 0.0, -3.0
        return field
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, a, b in cuts:
        asked.setdefault(keys[i], []).append((a, b))

    def cut_out(key: tuple[int, int], text: str) -> Iterator[tuple[int, int, bytes]]:
        rows = features(text, buckets, Hashes(start)).astype(np.int32)
        return ((a, b, rows[a:b].tobytes()) for a, b in set(asked[key]))

    sent = picked.mapInArrow(*_keyed("first long, last long, rows binary", cut_out)).collect()
    found = {(r.h1, r.h2, r.first, r["last"]): np.frombuffer(r.rows, np.int32).reshape(-1, _FEATURES).astype(np.int64) for r in sent}
    documents = [found[(*keys[i], a, b)] for i, a, b in cuts]
    truth = [marks[d[:, :2]].any(1).astype(float) if labels[i] else np.zeros(len(d)) for (i, _, _), d in zip(cuts, documents)]
    used, place = np.unique(np.concatenate([d.ravel() for d in documents]), return_inverse=True)
    ends = np.cumsum([len(d) for d in documents])
    errors = np.zeros(ends[-1])
    squares, square_bias, square_step = np.full(len(used), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(rounds):
        bias, step = 0.0, np.zeros((2, 2))
        for chosen, scores, lengths in field.batches(documents):
            found = field.marginals(scores, lengths)
            for i, row, n, pair in zip(chosen, found, lengths, field.pairs(scores, lengths)):
                much = copies[cuts[i][0]]
                off = much * (truth[i] - row[:n])
                errors[ends[i] - n : ends[i]] = off
                bias += off.sum()
                y = truth[i].astype(int)
                step += much * (np.bincount(2 * y[:-1] + y[1:], minlength=4).reshape(2, 2) - pair)
        slope = np.bincount(place, np.repeat(errors, _FEATURES), minlength=len(used)) - 0.02 * field.emit[used]
        squares += slope**2
        square_bias += bias**2
        square_step += step**2
        field.emit[used] += 0.7 * slope / np.sqrt(squares)
        field.bias += 0.7 * bias / np.sqrt(square_bias)
        field.step += 0.3 * step / np.sqrt(square_step)
    weigh = _keyed("mass double", lambda key, text: [(field.mass(field.all_marginals([features(text, buckets, Hashes(start))])[0]),)])
    masses = {(r.h1, r.h2): r.mass for r in picked.mapInArrow(*weigh).collect()}
    mass = np.array([masses[key] for key in keys])
    weight = copies * np.where(labels, 0.5 / max(1, copies[labels].sum()), 0.5 / max(1, copies[~labels].sum()))
    center, spread = mass.mean(), max(1e-6, mass.std())
    z, a, b = (mass - center) / spread, 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a += 2.0 * ((weight * (labels - p) * z).sum() - 0.001 * a)
        b += 2.0 * (weight * (labels - p)).sum()
    field.slope, field.level = a / spread, b - a * center / spread
    return field


def _tagger(field: Field, cut: float):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(field.start)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = part.column("text").to_pylist()
                marginals = field.all_marginals([features(t, field.buckets, known) for t in texts])
                spans = []
                for text, m in zip(texts, marginals):
                    chosen = np.flatnonzero(m >= cut)
                    found = places(text, chosen) if len(chosen) else []
                    spans.append([{"start": s, "end": e, "p": p} for (s, e), p in zip(found, m[chosen].tolist())])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([field.score(m) for m in marginals]), pa.array(spans, kind)],
                    names=["doc_id", "score", "spans"],
                )

    return tag


def tagged(docs: DataFrame, field: Field, cut: float = 0.5) -> DataFrame:
    """``doc_id, score`` and the toxic ``spans`` (start, end in code points, probability) of every row.

    NULL and texts without words have no spans and the score of no toxic mass. Repeated rows each get their row; other
    columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _tagger(field, cut), "doc_id long, score double, spans array<struct<start:bigint,end:bigint,p:double>>"
    )

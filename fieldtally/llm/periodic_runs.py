"""Periodic runs of words, found in tiles scaled to the period and stitched by document and period.

A run is a stretch of consecutive words with smallest period q, of ``max(least, times * q)`` words or more, that no
neighbouring word extends. Periods are worked on by octaves: for periods from K to 2K - 1 a text is exploded into tiles of
4K words, one at each multiple c of K (from c - K to c + 3K). Two Z-functions at the boundary c tell for every period of the
octave how far words a period apart agree before and behind it, which gives the fragment of the run inside the tile. Every
run with its least length holds such a boundary, and fragments of neighbouring tiles overlap by a period or more. Fragments
are shuffled by document and period and stitched where they overlap by a period; an interval with several periods keeps the
smallest. Tiles in which no run of eight words comes again at a distance of the octave are not solved.

Texts of up to ``block`` words are tiled inside the task that reads them. Longer ones are dealt as blocks over all tasks:
blocks that overlap by three of the largest periods for all small octaves together, and larger ones for each octave beyond.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage, window_hashes

_SHIFTED = 16  # periods below it: tiles this small are compared by shifts, all at once
_SEEN = 8  # words of a run whose return makes a tile worth solving
_PIECE = 1_000_000  # words that are worked on side by side


def z_function(x: list[int]) -> list[int]:
    """For every place, how many values from there on equal the first ones."""
    n, left, right = len(x), 0, 0
    out = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _tile(words: np.ndarray, c: int, octave: int) -> np.ndarray:
    """Fragments (period, start, end) of the periods ``octave`` to 2 * ``octave`` - 1 at the boundary ``c``."""
    low, high = max(0, c - octave), min(len(words), c + 3 * octave)
    ahead = z_function(words[c:high].tolist())
    before = words[low:c][::-1].tolist()
    end = min(high, c + 2 * octave)
    back = z_function(before + [-(1 << 40)] + words[low:end][::-1].tolist())
    periods = np.arange(octave, min(2 * octave, high - c))
    forward = np.array(ahead, np.int64)[periods]
    place = len(before) + 1 + end - (c + periods)
    backward = np.minimum(np.array(back + [0], np.int64)[np.minimum(place, len(back))], len(before))
    keep = forward + backward >= octave
    q, f, b = periods[keep], forward[keep], backward[keep]
    return np.stack([q, c - b, c + q + f], 1)


def stitched(found: np.ndarray) -> np.ndarray:
    """Fragments of a period that overlap by a period or more as one."""
    if not len(found):
        return found.reshape(0, 3)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    q, s = found[:, 0], found[:, 1]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    reach = found[:, 2].copy()
    for a, b in zip(first, np.r_[first[1:], len(q)]):
        np.maximum.accumulate(reach[a:b], out=reach[a:b])
    new = np.r_[True, (q[1:] != q[:-1]) | (s[1:] > reach[:-1] - q[1:])]
    starts = np.flatnonzero(new)
    return np.stack([q[starts], s[starts], reach[np.r_[starts[1:], len(q)] - 1]], 1)


def fragments(words: np.ndarray, first: int, last: int) -> np.ndarray:
    """Maximal stretches (period, start, end) with a period from ``first`` to ``last``, of two periods or more.

    ``words`` are numbers of words; a number that occurs once parts texts laid end to end.
    """
    out = []
    for q in range(first, min(last, _SHIFTED - 1, len(words) - 1) + 1):
        same = np.flatnonzero(words[:-q] == words[q:])
        if len(same):
            cut = np.flatnonzero(np.diff(same) != 1)
            s, e = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1 + q
            much = e - s >= max(2 * q, 4)
            out.append(np.stack([np.full(much.sum(), q), s[much], e[much]], 1))
    if last >= _SHIFTED and len(words) >= 2 * _SHIFTED:
        hashes = window_hashes(words.astype(np.uint64), _SEEN)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        equal = ranked[1:] == ranked[:-1]
        again = np.r_[False, equal] | np.r_[equal, False]
        group = np.cumsum(np.r_[True, ~equal])[again]
        width = np.int64(2 * len(words) + 2 * last + 4)
        keys = group * width + order[again]
        groups = np.full(len(hashes), -1, np.int64)
        groups[order[again]] = group
        octave = 1 << (max(first, _SHIFTED).bit_length() - 1)
        while octave <= last and len(keys):
            asked = np.arange(0, len(hashes), octave // 2)
            asked = asked[groups[asked] >= 0]
            key = groups[asked] * width + asked
            at = np.minimum(np.searchsorted(keys, key + octave), len(keys) - 1)
            asked = asked[(keys[at] >= key + octave) & (keys[at] < key + 2 * octave)]
            whole = asked % octave == 0
            anchors = np.unique(np.r_[asked[whole], asked[~whole] - octave // 2, asked[~whole] + octave // 2])
            solved = [_tile(words, int(c), octave) for c in anchors if c < len(words)]
            if solved:
                out.append(np.concatenate(solved))
            octave *= 2
    found = stitched(np.concatenate(out)) if out else np.zeros((0, 3), np.int64)
    return found[(found[:, 0] >= first) & (found[:, 0] <= last) & (found[:, 2] - found[:, 1] >= 2 * found[:, 0])]


def _numbering() -> defaultdict[bytes, int]:
    return defaultdict(count().__next__)


def _numbers(words: list[bytes], known: defaultdict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def kept_words(words: list[bytes], runs: list[dict]) -> bytes:
    """Words joined by one space, without those of a run behind its first period."""
    keep = np.ones(len(words), bool)
    for run in runs:
        keep[run["start"] + run["period"] : run["start"] + run["length"]] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


_FRAGMENT = pa.list_(pa.struct([("q", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]))
_FRAGMENT_SQL = "array<struct<q:bigint,s:bigint,e:bigint>>"


def _reader(block: int, times: int, least: int, hashed: bool):
    """Rows ``doc_id, n_words, text, kept, found``: ``kept`` where no run is possible, ``text`` else; no ``found``: too long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _numbering()

        def solve(ids: list, texts: list[bytes], words: list[list[bytes]]) -> pa.RecordBatch:
            nonlocal known
            if len(known) > 400_000:
                known = _numbering()
            short = [i for i, w in enumerate(words) if len(w) <= block]
            lengths = np.array([len(words[i]) for i in short], np.int64)
            starts = np.cumsum(np.r_[0, lengths + 1])
            line = np.empty(starts[-1], np.int64)
            for at, i, n in zip(starts, short, lengths):
                line[at : at + n] = _numbers(words[i], known)
            line[starts[1:] - 1] = -1 - np.arange(len(short))
            found: list[list | None] = [None] * len(ids)
            for i in short:
                found[i] = []
            for q, s, e in fragments(line, 1, int(lengths.max(initial=0)) // times).tolist():
                if e - s >= max(least, times * q):
                    at = int(np.searchsorted(starts, s, side="right")) - 1
                    found[short[at]].append({"q": q, "s": s - int(starts[at]), "e": e - int(starts[at])})
            plain = [f is not None and not f for f in found]
            kept = [b" ".join(w) if p else None for w, p in zip(words, plain)]
            if hashed:
                kept = [None if k is None else hashlib.sha256(k).hexdigest().encode() for k in kept]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([None if p else t for t, p in zip(texts, plain)], pa.binary()).cast(pa.string()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(found, _FRAGMENT),
                ],
                names=["doc_id", "n_words", "text", "kept", "found"],
            )

        for batch in batches:
            ids, texts, words, size = [], [], [], 0
            for i, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                text = value.as_py() or b""
                ids.append(i), texts.append(text), words.append(text.split())
                size += len(words[-1])
                if size >= _PIECE:
                    yield solve(ids, texts, words)
                    ids, texts, words, size = [], [], [], 0
            if ids:
                yield solve(ids, texts, words)

    return read


def _blocks(block: int, times: int):
    """Blocks ``key, first, last, start, whole, words`` of long texts: all periods below ``block`` / 8 together, then each octave."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary())):
                words = _numbers(text.as_py().split(), _numbering()).astype(np.int32)
                first, last = 1, 1 << (max(block // 8, _SHIFTED).bit_length() - 1)
                while times * first <= len(words):
                    step, size = 8 * last, 8 * last + 3 * last
                    for start in range(0, len(words), step):
                        part = words[start : start + size]
                        yield pa.RecordBatch.from_pydict({
                            "key": pa.array([key], pa.int64()), "first": pa.array([first], pa.int64()),
                            "last": pa.array([min(last - 1, len(words) // times)], pa.int64()), "start": pa.array([start], pa.int64()),
                            "ends": pa.array([start + size >= len(words)]), "words": pa.array([part.tobytes()], pa.binary()),
                        })
                        if start + size >= len(words):
                            break
                    first, last = last, 2 * last

    return cut


def _solver(times: int, least: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.int32).astype(np.int64)
                found = fragments(words, row["first"], row["last"])
                open_left = (found[:, 1] == 0) & (row["start"] > 0)
                open_right = (found[:, 2] == len(words)) & (not row["ends"])
                enough = found[:, 2] - found[:, 1] >= np.maximum(least, times * found[:, 0])
                found = found[open_left | open_right | enough]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), row["key"]), pa.int64()),
                        pa.array(found[:, 0]),
                        pa.array(found[:, 1] + row["start"]),
                        pa.array(found[:, 2] + row["start"]),
                    ],
                    names=["key", "q", "s", "e"],
                )

    return solve


def _collapser(hashed: bool):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, runs in zip(batch.column("text").cast(pa.binary()), batch.column("runs")):
                left = kept_words(text.as_py().split(), runs.as_py() or [])
                kept.append(hashlib.sha256(left).hexdigest() if hashed else left.decode())
            names = ["doc_id", "n_words", "runs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.string())], names=[*names, "kept"])

    return collapse


def stitch(found: DataFrame, times: int, least: int) -> DataFrame:
    """``key, runs`` from fragments ``key, q, s, e``: shuffled by document and period, stitched, smallest period of each interval."""
    ordered = Window.partitionBy("key", "q").orderBy("s", "e")
    reach = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("new", F.when(F.col("s") <= reach - F.col("q"), 0).otherwise(1))
    numbered = parted.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "q", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    whole = whole.where(F.col("e") - F.col("s") >= F.greatest(F.lit(least), times * F.col("q")))
    smallest = whole.groupBy("key", "s", "e").agg(F.min("q").alias("q"))
    run = F.struct(F.col("s").alias("start"), F.col("q").alias("period"), (F.col("e") - F.col("s")).alias("length"))
    return smallest.groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))


_RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, block: int = 65_536, hashed: bool = False) -> DataFrame:
    """``doc_id, n_words, runs`` (start, period, length in words, by start, then period) and ``kept`` for every row of ``doc_id, text``.

    ``kept`` is the text without the words of a run behind its first period, words joined by one space, or with ``hashed``
    its SHA-256. Words are parted by ASCII white space. NULL and texts without words have no runs and an empty ``kept``;
    repeated rows and NULL ids each get their row; other columns, of any name, are not looked at; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = rows.mapInArrow(
        _reader(block, times, least, hashed), f"doc_id long, n_words long, text string, kept string, found {_FRAGMENT_SQL}"
    )
    # only texts with fragments and long ones are kept for the second look
    found = cut_lineage(read.withColumn("key", F.monotonically_increasing_id()))
    inside = found.where(F.size("found") > 0).select("key", F.explode("found").alias("f")).select("key", "f.q", "f.s", "f.e")
    blocks = (
        found.where("found is null")
        .select("key", "text")
        .mapInArrow(_blocks(block, times), "key long, first long, last long, start long, ends boolean, words binary")
    )
    solved = blocks.repartition("key", "first", "start").mapInArrow(_solver(times, least), "key long, q long, s long, e long")
    runs = stitch(inside.unionByName(solved), times, least)
    plain = found.where("text is null").select("doc_id", "n_words", F.lit(None).cast(_RUNS).alias("runs"), "kept")
    rest = found.where("text is not null").select("key", "doc_id", "n_words", "text").join(runs, "key", "left").drop("key")
    collapsed = rest.mapInArrow(_collapser(hashed), f"doc_id long, n_words long, runs {_RUNS}, kept string")
    both = plain.unionByName(collapsed)
    return both.withColumn("runs", F.coalesce("runs", F.array().cast(_RUNS)))

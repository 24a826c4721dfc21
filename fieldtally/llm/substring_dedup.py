"""Removes word passages that an earlier document holds, by fixed-block anchors.

A window of ``size`` = 2b - 1 words always holds one whole block of b words that starts at a multiple
of b. So the blocks that do not overlap are the index (one per b words), every rolling run of b words
probes it, and a hit is extended to all windows around it. Windows that extend hits are compared whole
across documents; consecutive repeated windows join to maximal repeats, whose words are removed.

Only compact arrays are shuffled. Documents travel in chunks of a few MB, compressed, once. A chunk sends
each distinct run at most once, as 32 bits within a bucket of the hash range; buckets grow in number with
the corpus, so a bucket's size, and the rate of chance hits, do not. A passage that a third of all
documents holds is one entry per chunk. Chance hits only cost a comparison: windows are compared by 96 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import utf8_of, window_hashes

_CHUNKS = "chunk long, n_bytes long, ids binary, offsets binary, packed binary"
_SENT = "bucket long, chunk long, plain binary, anchors binary"
_FOUND = "chunk long, bucket long, found binary"
_WINDOWS = "bucket long, chunk long, hashes binary, checks binary, owners binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept binary, removed array<struct<start:bigint,end:bigint>>"


def _packer(chunk_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, zipper = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            first = 0
            while first < len(ids):
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1)
                end = min(end, len(ids))
                low, high = int(offsets[first]), int(offsets[end])
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([(task << 32) + count], pa.int64()),
                    "n_bytes": pa.array([high - low], pa.int64()),
                    "ids": [ids[first:end].tobytes()],
                    "offsets": [(offsets[first : end + 1] - low).tobytes()],
                    "packed": [zipper.compress(data[low:high].tobytes())],
                })
                count, first = count + 1, end

    return pack


class _Words(dict):
    """64 bits of the BLAKE2 digest of each word: unlike words meet by chance only, however they are made. Emptied at 400,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


class _Chunk:
    """Words of one chunk: hash, document row and id, place in the document."""

    def __init__(self, ids: bytes, offsets: bytes, packed: bytes):
        self.ids, self.offsets = np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.offsets[-1])))
        self.words = [raw[a:b].split() for a, b in zip(self.offsets.tolist(), self.offsets[1:].tolist())]
        self.n_words = np.array([len(words) for words in self.words], np.int64)
        total = int(self.n_words.sum())
        self.hashes = np.fromiter(map(_Words().__getitem__, chain.from_iterable(self.words)), np.uint64, total)
        self.rows = np.repeat(np.arange(len(self.ids)), self.n_words)
        self.place = np.arange(total) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)

    def runs(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of ``size`` words within a document."""
        every = window_hashes(self.hashes, size, seed)
        at = np.flatnonzero(self.rows[: len(every)] == self.rows[size - 1 :]) if len(every) else np.zeros(0, np.int64)
        return every[at], at


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of the hash, above 32 bits of the lower half."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | low


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts ``values``, start of each group in it, group of each sorted value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _pieces(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and end of the codes of each bucket; codes are sorted."""
    bucket = (codes >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(bucket)]):
        if high > low:
            yield int(bucket[low]), int(low), int(high)


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _table(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ARROW = {
    "sent": pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("plain", pa.binary()), ("anchors", pa.binary())]),
    "found": pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary())]),
    "windows": pa.schema(
        [("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("checks", pa.binary()), ("owners", pa.binary())]
    ),
    "result": pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
            ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    ),
}


def _sender(block: int, buckets: int):
    """Each distinct run of ``block`` words of a chunk, those that start a block of the index apart."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row["ids"], row["offsets"], row["packed"])
                hashes, at = chunk.runs(block)
                codes = _codes(hashes, buckets)
                anchors = np.unique(codes[chunk.place[at] % block == 0])
                plain = np.unique(codes)
                plain = plain[~_within(plain, anchors)]
                parts: dict[int, list[bytes]] = {}
                for i, kind in enumerate((plain, anchors)):
                    for bucket, low, high in _pieces(kind):
                        parts.setdefault(bucket, [b"", b""])[i] = kind[low:high].astype(np.uint32).tobytes()
                yield from _table(
                    _ARROW["sent"],
                    [list(parts), [row["chunk"]] * len(parts), [p[0] for p in parts.values()], [p[1] for p in parts.values()]],
                ).to_batches()

    return send


def _hits(group: pa.Table) -> pa.Table:
    """Per chunk, the runs of a bucket that another chunk's index holds, or its own blocks that others hold."""
    bucket, chunks = group.column("bucket")[0].as_py(), group.column("chunk").to_pylist()
    values, owner, anchor = [], [], []
    for i, name in ((0, "plain"), (1, "anchors")):
        for k, raw in enumerate(group.column(name).to_pylist()):
            part = np.frombuffer(raw, np.uint32)
            values.append(part)
            owner.append(np.full(len(part), k, np.int32))
            anchor.append(np.full(len(part), i, bool))
    values, owner, anchor = np.concatenate(values), np.concatenate(owner), np.concatenate(anchor)
    order, starts, group_of = _groups(values)
    held, anchored = np.diff([*starts, len(order)]), np.add.reduceat(anchor[order].astype(np.int64), starts)
    mine = anchor[order]
    live = (anchored[group_of] > mine) | (mine & (held[group_of] > 1))
    values, owner = values[order][live], owner[order][live]
    return _by_owner(values, owner, chunks, bucket)


def _by_owner(values: np.ndarray, owner: np.ndarray, chunks: list[int], bucket: int) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    values, cuts = values[order], np.searchsorted(owner[order], np.arange(len(chunks) + 1))
    kept = [k for k in range(len(chunks)) if cuts[k + 1] > cuts[k]]
    return _table(
        _ARROW["found"],
        [[chunks[k] for k in kept], [bucket] * len(kept), [values[cuts[k] : cuts[k + 1]].tobytes() for k in kept]],
    )


def _extender(block: int, size: int, buckets: int):
    """Windows around the hits of a chunk, each distinct one with its smallest document."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for row in left.to_pylist():
            chunk = _Chunk(row["ids"], row["offsets"], row["packed"])
            hashes, at = chunk.runs(block)
            codes = _codes(hashes, buckets)
            found = [
                np.frombuffer(r["found"], np.uint32).astype(np.uint64) | np.uint64(r["bucket"] << 32) for r in right.to_pylist()
            ]
            hit = _within(codes, np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64))
            if len(codes):  # hits between documents of this chunk
                order, starts, group_of = _groups(codes)
                rows = chunk.rows[at][order]
                anchored = np.logical_or.reduceat(chunk.place[at][order] % block == 0, starts)
                shared = anchored & (np.minimum.reduceat(rows, starts) != np.maximum.reduceat(rows, starts))
                hit[order] |= shared[group_of]
            seen = np.zeros(len(chunk.hashes) + 1, np.int64)
            seen[at[hit] + 1] = 1
            seen = np.cumsum(seen)
            whole, start = chunk.runs(size)
            checks = chunk.runs(size, seed=77)[0] & np.uint64(0xFFFFFFFF)
            near = seen[start + size - block + 1] > seen[start] if len(start) else np.zeros(0, bool)
            whole, checks, owners = whole[near], checks[near].astype(np.uint32), chunk.ids[chunk.rows[start[near]]]
            if not len(whole):
                continue
            order = np.lexsort((owners, checks, whole))
            whole, checks, owners = whole[order], checks[order], owners[order]
            new = np.ones(len(whole), bool)
            new[1:] = (whole[1:] != whole[:-1]) | (checks[1:] != checks[:-1])
            whole, checks, owners = whole[new], checks[new], owners[new]
            base = int(owners.min())
            narrow = int(owners.max()) - base < 1 << 32
            for bucket, low, high in _pieces(_codes(whole, buckets)):
                out[0].append(bucket)
                out[1].append(row["chunk"])
                out[2].append(whole[low:high].tobytes())
                out[3].append(checks[low:high].tobytes())
                ids = (owners[low:high] - base).astype(np.uint32) if narrow else owners[low:high]
                out[4].append(np.int64(base if narrow else 0).tobytes() + ids.tobytes())
        return _table(_ARROW["windows"], out)

    return extend


def _owners(raw: bytes, count: int) -> np.ndarray:
    base, body = np.frombuffer(raw[:8], np.int64)[0], raw[8:]
    return np.frombuffer(body, np.uint32 if len(body) == 4 * count else np.int64).astype(np.int64) + base


_PAIR = np.dtype([("whole", np.uint64), ("check", np.uint32)])


def _repeats(group: pa.Table) -> pa.Table:
    """Per chunk, the windows of a bucket that a smaller document of another chunk holds."""
    bucket, chunks = group.column("bucket")[0].as_py(), group.column("chunk").to_pylist()
    whole = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    checks = [np.frombuffer(x, np.uint32) for x in group.column("checks").to_pylist()]
    owners = [_owners(x, len(w)) for x, w in zip(group.column("owners").to_pylist(), whole)]
    chunk = np.repeat(np.arange(len(chunks)), [len(w) for w in whole])
    whole, checks, owners = np.concatenate(whole), np.concatenate(checks), np.concatenate(owners)
    order = np.lexsort((checks, whole))
    whole, checks, owners, chunk = whole[order], checks[order], owners[order], chunk[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (checks[1:] != checks[:-1])
    least = np.minimum.reduceat(owners, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = owners > least
    pairs = np.empty(int(late.sum()), _PAIR)
    pairs["whole"], pairs["check"] = whole[late], checks[late]
    return _by_owner(pairs, chunk[late], chunks, bucket)


def _remover(size: int):
    """Word counts, the kept words and the removed spans, per document of a chunk."""

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for row in left.to_pylist():
            chunk = _Chunk(row["ids"], row["offsets"], row["packed"])
            found = [np.frombuffer(r["found"], _PAIR) for r in right.to_pylist()]
            found = np.concatenate(found) if found else np.zeros(0, _PAIR)
            whole, start = chunk.runs(size)
            checks = chunk.runs(size, seed=77)[0] & np.uint64(0xFFFFFFFF)
            with np.errstate(over="ignore"):  # both hashes folded to one, for the lookups of this chunk
                key = window_hashes(np.stack([whole, checks], 1).ravel(), 2)[::2] if len(whole) else whole
                folded = np.stack([found["whole"], found["check"].astype(np.uint64)], 1).ravel()
                sought = np.sort(window_hashes(folded, 2)[::2]) if len(found) else np.zeros(0, np.uint64)
            repeated = _within(key, sought)
            if len(key):
                order, starts, group_of = _groups(key)
                ids = chunk.ids[chunk.rows[start]][order]
                repeated[order] |= ids > np.minimum.reduceat(ids, starts)[group_of]
            change = np.zeros(len(chunk.hashes) + 1, np.int64)
            change[start[repeated]] += 1
            change -= np.bincount(start[repeated] + size, minlength=len(change))[: len(change)]
            kept = np.cumsum(change)[:-1] == 0
            ends = np.cumsum(chunk.n_words)
            for i, doc_id in enumerate(chunk.ids):
                mask = kept[ends[i] - chunk.n_words[i] : ends[i]]
                words = chunk.words[i]
                left_words = words if mask.all() else compress(words, mask.tolist())
                out[0].append(int(doc_id))
                out[1].append(len(mask))
                out[2].append(int(len(mask) - mask.sum()))
                out[3].append(b" ".join(left_words))
                edges = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]]).astype(np.int8))) if len(words) else mask
                out[4].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
        return _table(_ARROW["result"], out)

    return remove


def deduplicated(
    docs: DataFrame, size: int = 13, chunk_bytes: int = 4_000_000, bucket_bytes: int = 8_000_000
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed``, the kept words and the removed ones.

    ``kept_text`` has the kept words with one blank between them; ``removed`` has the maximal runs of removed words as numbers
    of the first word and of the one after the last, from 0.

    A word goes if a window of ``size`` words (odd) covers it that also starts in a document with a smaller
    ``doc_id``. Words are runs of anything but ASCII white space. NULL text has no words. Rows that share an
    id do not remove from each other. A NULL id has no order: its row loses and causes nothing. Other columns
    are not looked at. ``docs`` is read more than once, so it must give the same rows each time (a file does).
    """
    if size % 2 == 0:
        raise ValueError("size must be odd")
    block = (size + 1) // 2
    spark = docs.sparkSession
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = known.mapInArrow(_packer(chunk_bytes), _CHUNKS).repartition(parts, "chunk")
    sent = chunks.mapInArrow(_sender(block, buckets), _SENT)
    hits = sent.groupBy("bucket").applyInArrow(_hits, _FOUND)
    windows = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extender(block, size, buckets), _WINDOWS)
    repeats = windows.groupBy("bucket").applyInArrow(_repeats, _FOUND)
    result = chunks.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_remover(size), _RESULT)
    nameless = docs.where("doc_id is null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "").alias("words"),
    )
    every = result.unionByName(
        nameless.select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_removed"),
            F.array_join("words", " ").cast("binary").alias("kept"),
            F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"),
        )
    )
    return every.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "removed")


def remove_repeats(
    docs: DataFrame, size: int = 13, chunk_bytes: int = 4_000_000, bucket_bytes: int = 8_000_000
) -> DataFrame:
    """``doc_id, n_words, n_removed`` of ``deduplicated`` and ``kept_sha256``, the digest of its kept text."""
    found = deduplicated(docs, size, chunk_bytes, bucket_bytes)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

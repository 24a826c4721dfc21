"""SimHash near-duplicates: a self-join over the binary trie of the fingerprints.

Node pairs are traversed together from the root; differing bits add up and a pair beyond the error budget
is dropped. The upper levels are a plain expansion: each distinct fingerprint goes to the pairs of upper
nodes within the budget that hold it, and each pair of upper nodes is one group, traversed on in a task. Only
distinct fingerprints travel, so copies meet as one. A group answers with a spanning forest of its links, not with
all pairs; the components come from joins over those links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage, free_name, quoted

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 16


def simhash(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of a UTF-8 text: majority per bit over the XXH64 of its word shingles."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for first in range(0, count, _BLOCK):
        n = min(_BLOCK, count - first)
        hashes = np.fromiter((digest(run, seed) for _, run in zip(range(n), runs)), "<u8", n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def batch_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash((t.as_py() or "").encode(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(np.array(prints, np.uint64).view(np.int64))],
                names=["doc_id", "mark", "bits"],
            )

    return batch_prints


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, mark`` (a hash of the text) and the 64 fingerprint ``bits`` (signed) of every row; NULL text has no words and fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, mark long, bits long")


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each vertex's component."""
    label = np.arange(count)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints below two trie nodes at ``depth`` (one node if ``right`` is None).

    ``left`` and ``right`` are sorted and distinct; ``errors`` bits differ above. Node pairs are walked in
    blocks, depth first, so the frontier stays small however many pairs there are.
    """
    same = right is None
    right = left if same else right
    found_a, found_b = [], []
    stack = [(depth, np.array([[0, len(left), 0, len(right), errors]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > 1 << 18:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:]), (depth, pairs[:half])]
            continue
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16) | (depth >= 64)
        leaves = pairs[small]
        if len(leaves):
            width = leaves[:, 3] - leaves[:, 2]
            size = (leaves[:, 1] - leaves[:, 0]) * width
            leaf = np.repeat(np.arange(len(leaves)), size)
            at = np.arange(len(leaf)) - np.repeat(np.cumsum(size) - size, size)
            i, j = leaves[leaf, 0] + at // width[leaf], leaves[leaf, 2] + at % width[leaf]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            found_a.append(i[near])
            found_b.append(j[near])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        cut_a = np.searchsorted(left, (left[pairs[:, 0]] & above) | bit)
        cut_b = np.searchsorted(right, (right[pairs[:, 2]] & above) | bit)
        a0, a1, b0, b1, wrong = pairs.T
        mirrored = (a0 == b0) & (a1 == b1) if same else np.zeros(len(pairs), bool)
        below = np.concatenate([
            np.stack([a0, cut_a, b0, cut_b, wrong], 1),
            np.stack([cut_a, a1, cut_b, b1, wrong], 1),
            np.stack([a0, cut_a, cut_b, b1, wrong + 1], 1),
            np.stack([cut_a, a1, b0, cut_b, wrong + 1], 1)[~mirrored],
        ])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            stack.append((depth + 1, below))
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _node_pair(depth: int, budget: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(group: pa.Table) -> pa.Table:
        bits = group.column("bits").to_numpy().view(np.uint64)
        node, other = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        errors = (node ^ other).bit_count()
        if node == other:
            values = np.sort(bits)
            a, b = trie_links(values, None, depth, 0, budget)
        else:
            own = (bits >> np.uint64(64 - depth)) == np.uint64(node)
            left, right = np.sort(bits[own]), np.sort(bits[~own])
            values = np.concatenate([left, right])
            a, b = trie_links(left, right, depth, errors, budget) if len(left) and len(right) else (bits[:0], bits[:0])
            a, b = a.astype(np.int64), b.astype(np.int64) + len(left)
        label = _forest(len(values), a, b)
        linked = np.flatnonzero(label != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.Table.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], schema=schema)

    return links


def links(distinct: DataFrame, count: int, budget: int = 2, node_rows: int = 4096) -> DataFrame:
    """A spanning set of links ``a, b`` between distinct ``bits`` that differ in at most ``budget`` bits.

    The expanded part of the trie is as deep as makes nodes of about ``node_rows`` of the ``count`` values.
    """
    depth = min(40, max(1, math.ceil(math.log2(max(2, count / node_rows)))))
    masks = [sum(1 << i for i in c) for k in range(min(budget, depth) + 1) for c in combinations(range(depth), k)]
    node = F.shiftrightunsigned("bits", 64 - depth)
    spread = distinct.select("bits", node.alias("node"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    spread = spread.select("bits", F.least("node", other).alias("low"), F.greatest("node", other).alias("high"))
    return spread.groupBy("low", "high").applyInArrow(_node_pair(depth, budget), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every vertex of ``edges`` (a, b): the smallest vertex it can reach.

    Alternates two joins until nothing changes: larger neighbours of a vertex point to its smallest
    neighbour, then the others. Every step keeps the components; each is checkpointed.
    """
    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut_lineage(df.where("a <> b").distinct())
        state = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, tuple(state)

    edges, state = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        before = state
        edges, state = settled(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")))
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, node_rows: int = 4096) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fingerprint`` and ``component_id`` of :func:`grouped`."""
    return grouped(docs, shingle, budget, node_rows).drop("mark", "root")


def grouped(docs: DataFrame, shingle: int = 3, budget: int = 2, node_rows: int = 4096) -> DataFrame:
    """Per row of ``docs``: ``doc_id, mark`` (a hash of the text), ``fingerprint`` (16 hex digits), ``component_id`` and the ``root`` that tells components apart.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``budget`` differing bits reach. Empty and NULL
    texts have fingerprint zero and link like any other. Repeated rows stay, each with its component. A NULL id is
    never the smallest; a component without any id has a NULL one. Other columns are not looked at.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("bits"), distinct.count(), budget, node_rows))
    rooted = distinct.join(roots, F.col("bits") == F.col("node"), "left")
    rooted = cut_lineage(rooted.select("bits", "first", F.coalesce("root", "bits").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "root", "component_id")
    return prints.join(named, "bits").select(
        "doc_id", "mark", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "root"
    )


def first_of_each(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest ``doc_id``.

    Of rows that share that id the one with the smallest hash of its text is kept, and of rows alike in both any one. Rows of
    other components stay, also where they share an id. Rows with a NULL id cannot be chosen between and stay. Columns may have
    any names; no rows give no rows.
    """
    own, mark = quoted(docs.columns), free_name(docs, "mark")
    known = docs.where("doc_id is not null")
    found = grouped(known, shingle, budget).where("doc_id = component_id")
    first = found.groupBy("root").agg(F.min("doc_id").alias("of_id"), F.min("mark").alias("of_mark")).drop("root")
    marked = known.select(*own, F.xxhash64("text").alias(mark))
    taken = first.withColumnsRenamed({c: free_name(marked, c) for c in first.columns})
    same = (marked["doc_id"] == taken[taken.columns[0]]) & (marked[mark] == taken[taken.columns[1]])
    chosen = marked.join(taken, same, "left_semi").dropDuplicates(["doc_id", mark])
    return chosen.select(*own).unionByName(docs.where("doc_id is null"))

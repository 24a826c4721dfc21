"""Helpers shared by the operators: tables, training folds, vectorised word and character hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fieldtally.lineage import cut_lineage

__all__ = ["cut_lineage"]

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a name like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def with_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and two independent 64-bit hashes of the text (NULL: empty), by which equal texts are known."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    return plain.select("doc_id", "text", *(F.xxhash64(F.lit(i), F.col("text")).alias(f"h{i}") for i in (1, 2)))


def distinct_labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``h1, h2, label, doc_id, weight, rows, turn``: each text of a label once, without the text; ``doc_id`` has it, in ``rows`` rows.

    Only ids, hashes and labels are joined and grouped. A single text weighs one, and one more each time its copies double.
    Texts in order of ``turn``, a number made from their hash, are a random sample in which a text with n copies comes as early
    as the first of n texts would.
    """
    known = labels.select("doc_id", label).where(F.col(label).isNotNull())
    rows = with_digest(docs).drop("text").join(known, "doc_id")
    per_doc = rows.groupBy("h1", "h2", label, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    found = per_doc.groupBy("h1", "h2", label).agg(
        F.sum("rows").alias("copies"), F.min("doc_id").alias("doc_id"), F.min_by("rows", "doc_id").alias("rows")
    )
    share = (F.shiftrightunsigned("h1", 11) + 1).cast("double") / float(1 << 53)
    weight = F.length(F.bin("copies")).cast("long").alias("weight")
    return found.select("h1", "h2", label, "doc_id", weight, "rows", (-F.log(share) / F.col("copies")).alias("turn"))


def sampled_rows(distinct: DataFrame, sample: int) -> list[Row]:
    """The first ``sample`` rows of ``distinct_labelled`` by turn: a bounded number of short rows."""
    return distinct.orderBy("turn", "h1", "h2").limit(sample).collect()


def sampled_texts(docs: DataFrame, rows: list[Row]) -> DataFrame:
    """``h1, h2, text`` of sampled rows, which are few and sent to all tasks; the texts stay in the shared folder."""
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.h1, r.h2) for r in rows], "doc_id long, h1 long, h2 long").distinct()
    found = with_digest(docs).join(F.broadcast(wanted), ["doc_id", "h1", "h2"])
    return cut_lineage(found.select("h1", "h2", "text"))


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; NULL counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _WHITE, lower: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, row, first byte and end byte of every word; bytes of ``separator`` part words, as do rows."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    gap = separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        power = np.full(len(data), _MULTIPLIER)
        power[0] = 1
        np.cumprod(power, out=power)
        power *= _BYTE_CODES[data]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(power, out=total[1:])
        power[:] = _INVERSE
        power[0] = 1
        np.cumprod(power, out=power)
        hashes = mixed((total[ends] - total[starts]) * power[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, rows, starts, ends


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` words, one for each start (rows not yet looked at)."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(seed * 2 + 1))
        for j in range(size):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += words[j : j + n]
        return mixed(out)


def characters(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_buckets(text: str, size: int, buckets: int) -> np.ndarray:
    """Bucket of each run of ``size`` code points; runs of white space count as one blank, ends are padded."""
    points = characters(" " + " ".join(text.split()) + " ")
    if len(points) < size:
        return np.zeros(0, np.int64)
    return (window_hashes(points.astype(np.uint64), size) % np.uint64(buckets)).astype(np.int64)

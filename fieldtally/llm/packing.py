"""Packs tokenised documents into windows of fixed length by the sum-of-squares rule.

Each partition packs its own rows: whole windows are cut off a document first, the rest is placed online
into the fill level that leaves the least sum of squared counts of partly filled windows. The counts stand
in an array over the levels. Windows still open when a task ends are laid end to end and cut into whole windows; its very
last ids become windows of powers of two, without padding. ``open_windows`` bounds the memory (8,192 hold 34 MB of ids at most, real
lengths need about 1,000): beyond it the windows of the fullest level are closed in the same way, and no others.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
_SPECIAL = "<|endoftext|>"
_ODD = re.compile(r"^\s|\s\s|\s\Z")


class Encoder:
    """Token ids of a text as bytes of little-endian uint32, equal to those of the tokenizer file at ``special_path``.

    No token crosses a single blank between two words, so words are encoded once and looked up after that.
    Texts with other white space next to a blank, or at an end, are encoded whole; those that spell a special token
    go to the tokenizer itself. The table of words is emptied when it has ``entries`` words.
    """

    def __init__(self, ranks_path: str, special_path: str, entries: int = 400_000):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special, self.special_path = None, special_path
        self.known: dict[str, bytes] = {}
        self.entries = entries

    def _whole(self, text: str) -> bytes:
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            if self.special is None:
                self.special = Tokenizer.from_file(self.special_path)
            return array("I", self.special.encode(text, add_special_tokens=False).ids).tobytes()
        if _ODD.search(text):
            return self._whole(text)
        first, *words = text.split(" ")
        known = self.known
        out = [self._whole(first)]
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.entries:
                    known.clear()
                ids = known[word] = self._whole(" " + word)
            out.append(ids)
        return b"".join(out)


class SumOfSquares:
    """Open windows by fill level; ``take`` yields finished windows as lists of pieces."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.limit = size, open_windows
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]
        self.open = 0

    def place(self, piece, length: int) -> list | None:
        """The window that ``piece`` fills up, if it does. ``length`` is below the window's size."""
        counts, size = self.counts, self.size
        top = size - length
        change = 2 * (counts[length:] - counts[: top + 1])  # level f to f + length
        change[1:] += 2
        change[top] = 1 - 2 * counts[top]  # a full window leaves the counts
        change[0] = 2 * counts[length] + 1  # level 0: a new window
        allowed = np.flatnonzero(counts[1 : top + 1]) + 1
        level = 0
        if len(allowed):
            best = int(allowed[::-1][np.argmin(change[allowed][::-1])])  # ties: the fullest
            level = best if change[best] <= change[0] else 0
        if level:
            window = self.windows[level].pop()
            counts[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + length == size:
            return window
        counts[level + length] += 1
        self.windows[level + length].append(window)
        self.open += 1
        return None

    def fullest(self) -> list:
        """Pieces of the open windows of the fullest level in use, which are closed."""
        level = int(np.flatnonzero(self.counts[: self.size])[-1])
        pieces = [piece for window in self.windows[level] for piece in window]
        self.open -= len(self.windows[level])
        self.counts[level], self.windows[level] = 0, []
        return pieces

    def emptied(self) -> list:
        """Pieces of all open windows, which are closed."""
        pieces = [piece for level in self.windows for window in level for piece in window]
        self.counts[:] = 0
        self.windows = [[] for _ in self.windows]
        self.open = 0
        return pieces


def _pack(size: int, end_id: int, ranks_path: str, special_path: str, open_windows: int):
    end = np.uint32(end_id).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(ranks_path, special_path), SumOfSquares(size, open_windows)
        sequence, out = TaskContext.get().partitionId() << 40, [[] for _ in range(8)]

        def close(window) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                for column, value in zip(out, (doc, start, n, zlib.crc32(ids), total, sequence, offset, ids)):
                    column.append(value)
                offset += n
            sequence += 1

        def cut(pieces: list, last: bool) -> None:
            """Lays pieces end to end; what fills no window goes back, or at the end into windows of powers of two."""
            left = sum(len(p[2]) // 4 for p in pieces)
            window, room = [], size

            def wanted() -> int:
                return size if left >= size else 1 << (left.bit_length() - 1)

            if last and left:
                room = wanted()
            for doc, start, ids, total in pieces:
                while ids:
                    part = ids[: 4 * room]
                    window.append((doc, start, part, total))
                    n = len(part) // 4
                    start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                    if not room:
                        close(window)
                        window, room = [], wanted() if last and left else size
            for piece in window:
                put(*piece)

        def put(doc, start, ids, total) -> None:
            full = packer.place((doc, start, ids, total), len(ids) // 4)
            if full:
                close(full)

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in out[:-1]]
            ends = np.cumsum([0, *(len(ids) // 4 for ids in out[-1])], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out[-1]), np.int32))))
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total // size * size
                for start in range(0, whole, size):
                    close([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                if whole < total:
                    put(doc, whole, ids[4 * whole :], total)
                if packer.open > packer.limit:
                    cut(packer.fullest(), last=False)
                if len(out[0]) >= 20_000:
                    yield batch_of()
        cut(packer.emptied(), last=True)
        yield batch_of()

    return pack


def pack(
    docs: DataFrame,
    ranks_path: str,
    special_path: str,
    size: int = 1024,
    end_id: int = 0,
    open_windows: int = 8192,
) -> DataFrame:
    """One row per piece of a document: its place in the document and in its window (``sequence_id, offset``), and its ``ids``.

    Every document's ids end with ``end_id``; NULL and empty texts are that id alone. Repeated rows are packed
    each on its own; a NULL ``doc_id`` stays NULL. An empty table gives no rows. Windows hold ``size`` ids, but for
    a few of a smaller power of two at the end of each partition. Window numbers hold the partition's number, so
    ``docs`` must be dealt alike when a task runs again (files are).
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(_pack(size, end_id, ranks_path, special_path, open_windows), _PIECES)

"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs' 64-bit digests. Each digest goes to one cell in each of three subtables;
a cell holds a count, the xor of its digests and of their check hashes. Two sketches subtract cell by cell; cells
with a single digest are peeled until nothing is left, which recovers the digests that differ. Where peeling
gets stuck, the texts are sketched again with sixteen times the cells. Sketches are kept sparse, one row per cell that
is not empty. Rows are dealt once by text, so adding up, subtracting and peeling are aggregates inside a partition,
and the number of partitions follows the number of digests. Column expressions, joins and aggregates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage

_SLOTS = 64  # cells of a subtable of the sketch that is the fingerprint
_RETRIES = (1024, 16384, 262144)
_ROUNDS = 15  # one subtable is peeled in each
_DEALT = 250_000  # digests per partition
_SIDES = ("keys", "edited_keys", "next_keys")


def digests(text: Column, ends: str = r"[\n.!?]+") -> Column:
    """Sorted distinct digests of the paragraphs, which end at line ends and sentence marks; blank ones have none."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ends), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _cells(key: Column, slots: int) -> list[Column]:
    """A digest's cell in each subtable."""
    return [(F.shiftright(key, 20 * j).bitwiseAND(F.lit(slots - 1)) + j * slots).cast("int") for j in range(3)]


def sketches(rows: DataFrame, slots: int, sides: Sequence[str] = _SIDES) -> DataFrame:
    """Sketches of the sides of every ``row``: ``row, c`` and per side i ``n{i}, k{i}, h{i}``, one row per cell in use."""
    found = [F.struct(F.lit(i).alias("side"), F.col(keys).alias("found")) for i, keys in enumerate(sides)]
    keys = rows.select("row", F.explode(F.array(*found)).alias("s")).select("row", "s.side", F.explode("s.found").alias("k"))
    entries = keys.select("row", "side", "k", F.xxhash64("k").alias("h"), F.explode(F.array(*_cells(F.col("k"), slots))).alias("c"))
    sums = []
    for i in range(len(sides)):
        own = lambda x: F.when(F.col("side") == i, x).otherwise(F.lit(0).cast("long"))  # noqa: E731, B023
        sums += [F.sum(own(F.lit(1))).alias(f"n{i}"), F.bit_xor(own(F.col("k"))).alias(f"k{i}"), F.bit_xor(own(F.col("h"))).alias(f"h{i}")]
    return entries.groupBy("row", "c").agg(*sums)


def _cell(pair: Column, place: Column, own: Column, n: Column, k: Column, h: Column) -> Column:
    return F.struct(pair.alias("pair"), place.alias("c"), own.alias("own"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))


def _used() -> Column:
    return (F.col("n") != 0) | (F.col("k") != 0) | (F.col("h") != 0)


def subtracted(sketched: DataFrame, sides: int = len(_SIDES)) -> DataFrame:
    """First side less each other one: ``row, pair, c, own, n, k, h``, cells that are not empty."""
    none = F.lit(0).cast("long")
    pairs = [
        _cell(F.lit(i), F.col("c"), none, F.col("n0") - F.col(f"n{i}"), F.col("k0").bitwiseXOR(F.col(f"k{i}")), F.col("h0").bitwiseXOR(F.col(f"h{i}")))
        for i in range(1, sides)
    ]
    return sketched.select("row", F.inline(F.array(*pairs))).where(_used())


def peeled(cells: DataFrame, slots: int, rounds: int = _ROUNDS) -> DataFrame:
    """Takes single digests out of subtracted sketches, in turn from each subtable, where a digest has one cell.

    The same columns: a recovered digest is a row of its own with ``c`` -1, the digest in ``k`` and ``own``, and ``n`` 1 if the first side
    has it, -1 if the other one has it. Rows with ``c`` from 0 are cells that could not be peeled.
    """
    none = F.lit(0).cast("long")
    for turn in range(rounds):
        j = turn % 3
        places, (pair, c, own, n, k, h) = _cells(F.col("k"), slots), (F.col(x) for x in ("pair", "c", "own", "n", "k", "h"))
        single = c.between(j * slots, (j + 1) * slots - 1) & (F.abs(n) == 1) & (h == F.xxhash64(k))
        elsewhere = [_cell(pair, places[i], none, -n, k, h) for i in range(3) if i != j]
        taken = F.array(_cell(pair, F.lit(-1), k, n, k, none), *elsewhere)
        moved = F.when(single, taken).otherwise(F.array(_cell(pair, c, own, n, k, h)))
        cells = cells.select("row", F.inline(moved)).groupBy("row", "pair", "c", "own")
        cells = cells.agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where(_used())
    return cells


def differing(rows: DataFrame, parts: int) -> DataFrame:
    """``row, d1, d2``: how many digests differ between the first side and each other one; rows without a difference are absent.

    ``rows`` is stored and dealt by ``row``. The digests that peeling recovers are counted. Rows whose sketches do not peel are
    sketched larger; beyond the largest size the digests themselves are compared.
    """
    out, numbers = None, [f"d{i}" for i in range(1, len(_SIDES))]
    stuck = F.col("d1").isNull() | F.col("d2").isNull()
    for slots in (_SLOTS, *_RETRIES):
        own = [F.col("pair") == i for i in range(1, len(_SIDES))]
        left = [F.coalesce(F.max(F.when(x, F.col("c"))), F.lit(-1)) >= 0 for x in own]
        found = [F.when(~over, F.count_if(x & (F.col("c") < 0))).alias(name) for x, over, name in zip(own, left, numbers)]
        tried = cut_lineage(peeled(subtracted(sketches(rows, slots)), slots).groupBy("row").agg(*found))
        done = tried.where(~stuck)
        out = done if out is None else out.unionByName(done)
        again = tried.where(stuck).select("row")
        if again.isEmpty():
            return out
        rows = rows.join(again, "row", "left_semi").repartition(parts, "row")
    apart = [
        (F.size(F.array_except("keys", other)) + F.size(F.array_except(other, "keys"))).cast("long").alias(name)
        for other, name in zip(_SIDES[1:], numbers)
    ]
    return out.unionByName(rows.select("row", *apart))


def changed_paragraphs(before: DataFrame, after: DataFrame, sizes: Sequence[int] = (_SLOTS, *_RETRIES)) -> DataFrame:
    """Digests of the paragraphs that only one of two versions has: ``doc_id, digest, side`` ('before' or 'after').

    The versions' sketches (each ``doc_id, text``) are subtracted and peeled; a document that gets stuck is sketched again with
    the next of ``sizes`` cells in a subtable, and beyond the largest its digests are compared. A document in one version only, a
    NULL text or an empty one has no paragraph there. Rows that share an id in a version, NULL ids too, are one document with the
    paragraphs of all; repeated paragraphs count once. Equal versions and empty tables have no row. Other columns are not looked at.
    """
    sides = ("keys", "other_keys")

    def side(docs: DataFrame, i: int) -> DataFrame:
        one = docs.select("doc_id", digests(F.col("text").cast("string")).alias("found"))
        none = F.array().cast("array<bigint>")
        return one.select("doc_id", *(F.col("found").alias(name) if i == j else none.alias(name) for j, name in enumerate(sides)))

    single = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    rows = side(before, 0).unionByName(side(after, 1)).groupBy("doc_id").agg(*(single(name) for name in sides))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    many = rows.agg(F.sum((F.size(sides[0]) + F.size(sides[1])).cast("long"))).first()[0] or 0
    parts = max(1, -(-many // _DEALT))
    label = lambda first: F.when(first, "before").otherwise("after").alias("side")
    left, out = rows.repartition(parts, "row"), None
    for slots in sizes:
        tried = cut_lineage(peeled(subtracted(sketches(left, slots, sides), len(sides)), slots).select("row", "c", "n", "k"))
        again = tried.where("c >= 0").select("row").distinct()
        done = tried.join(again, "row", "left_anti").select("row", F.col("k").alias("digest"), label(F.col("n") > 0))
        out = done if out is None else out.unionByName(done)
        left = left.join(again, "row", "left_semi").repartition(parts, "row")
        if again.isEmpty():
            break
    else:
        missing = lambda x, y, first: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("digest"), label(F.lit(first))))
        apart = F.concat(missing(*sides, True), missing(*reversed(sides), False))
        out = out.unionByName(left.select("row", F.inline(apart)))
    return out.join(rows.select("row", "doc_id"), "row").select("doc_id", "digest", "side")


def likeness(a: str, b: str, differ: Column) -> Column:
    """Shared digests by all digests of two sets, from their sizes and the number that differ; 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def written(sketched: DataFrame) -> DataFrame:
    """Sketches of the first two sides as text, ``row, fingerprint, edited_fingerprint``: place, count, digests and check of each cell."""

    def text(i: int) -> Column:
        check = F.lower(F.hex(F.col(f"h{i}").bitwiseAND(F.lit(0xFFFFFFFF))))
        cell = F.concat_ws(".", "c", f"n{i}", F.lower(F.hex(f"k{i}")), check)
        return F.when(F.col(f"n{i}") > 0, F.struct("c", cell.alias("cell")))

    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["cell"]), ",")
    cells = sketched.select("row", text(0).alias("a"), text(1).alias("b"))
    return cells.groupBy("row").agg(joined("a").alias("fingerprint"), joined("b").alias("edited_fingerprint"))


def next_ids(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id`` of each distinct known id in ascending order; the last one's next is the first.

    Ids are dealt by range; inside a range it is a window, between ranges a window over one row per range.
    """
    ranged = ids.where("doc_id is not null").distinct().repartitionByRange("doc_id")
    ranged = cut_lineage(ranged.select("doc_id", F.spark_partition_id().alias("part")))
    edges = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    edges = edges.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    first = ranged.agg(F.min("doc_id").alias("lowest"))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(edges, "part").crossJoin(F.broadcast(first)).select(
        "doc_id", F.coalesce("next_id", "after", "lowest").alias("next_id")
    )


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last ``floor(n_chars / share)`` characters are replaced by the first as many (or all) of the next
    document in ascending ``doc_id``, after the last the first. NULL text is empty. Rows that share an id have the
    same next document; as a next document they are the smallest of their texts. A NULL id is next to none, and the
    first document is next to it. Other columns are not looked at.
    """
    size = F.length("text")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = texts.where("doc_id is not null").repartition("doc_id")
    known = base.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.floor(size / share)).alias("k"))
    order = cut_lineage(next_ids(docs.select("doc_id")))
    wanted = known.select("doc_id", "k").join(order, "doc_id").select(F.col("doc_id").alias("of"), "next_id", "k")
    heads = known.select(F.col("doc_id").alias("next_id"), "text").join(wanted, "next_id")
    heads = heads.select(
        F.col("of").alias("doc_id"),
        F.substring(F.col("text"), F.lit(1), F.col("k").cast("int")).alias("head"),
        digests(F.col("text")).alias("next_keys"),
    )
    lowest = F.broadcast(order.agg(F.min("doc_id").alias("next_id")))
    first = known.select(F.col("doc_id").alias("next_id"), "text").join(lowest, "next_id")
    first = first.select(F.col("text").alias("head"), digests(F.col("text")).alias("next_keys"))
    nameless = texts.where("doc_id is null").join(F.broadcast(first), F.lit(True), "left")
    rows = base.join(heads, "doc_id", "left").unionByName(nameless)
    kept = size - F.floor(size / share)
    rows = rows.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        digests(F.col("text")).alias("keys"),
        F.concat(
            F.substring(F.col("text"), F.lit(1), kept.cast("int")),
            F.substring(F.coalesce("head", F.lit("")), F.lit(1), F.floor(size / share).cast("int")),
        ).alias("edited"),
        F.coalesce("next_keys", F.array().cast("array<bigint>")).alias("next_keys"),
    )
    rows = rows.withColumns({"edited_keys": digests(F.col("edited")), "edited_sha256": F.sha2("edited", 256)}).drop("edited")
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    many = rows.agg(F.sum(sum((F.size(x) for x in _SIDES), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(1, -(-many // _DEALT))
    dealt = rows.repartition(parts, "row")
    whole = dealt.join(written(sketches(dealt, _SLOTS)), "row", "left").join(differing(dealt, parts), "row", "left")
    count = lambda name: F.coalesce(name, F.lit(0))
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), count("d1")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), count("d2")).alias("near_next"),
    )

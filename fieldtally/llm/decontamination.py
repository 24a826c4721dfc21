"""Benchmark decontamination by a prefix-filtered join.

Benchmark items are cut into windows of ``size`` words. A window occurs in a document only if all its words
do, so it is enough to join on one necessary word: the rarest by its count in all documents. A joined occurrence
fixes where the window would have to start; positions and lengths that cannot hold it are dropped, and what is
left is compared word for word. Column expressions and joins only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage, free_name, quoted

_UPPER = "".join(map(chr, range(65, 91)))
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, in its case: runs of digits, letters A-Z, a-z and characters beyond ASCII; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lowered(word: Column) -> Column:
    """``word`` with A-Z in lower case and everything else as it is; ASCII words take the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows of all items: ``window`` (text), ``words``, ``items`` (the ids as text that have it)."""
    words = items.select(F.col("item_id").cast("string").alias("item"), F.transform(words_of(F.col("text")), lowered).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (size - 1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda s: F.slice("all", s, size))).alias("words"))
    named = cut.withColumn("window", F.array_join("words", " "))
    return named.groupBy("window").agg(F.first("words").alias("words"), F.collect_set("item").alias("items"))


def _sender(words: DataFrame, limit: int) -> Callable[[DataFrame], DataFrame]:
    """Broadcast for frames of at most the texts in ``words`` (``bytes`` a row), if these are within ``limit``; else Spark's choice."""
    held = words.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0  # an entry of a hash table has some 64 bytes beside its text
    return F.broadcast if held <= limit else lambda df: df


def occurrences(
    docs: DataFrame, items: DataFrame, size: int = 13, broadcast_bytes: int = 32_000_000
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, mark, n_words`` of every row, and ``doc_id, mark, start, length, items`` of every place of a window.

    Places count from 1. ``mark`` is a hash of the text and tells rows of one ``doc_id`` apart. The windows' words, which are
    few, and the windows themselves are broadcast while what is stored of them has at most ``broadcast_bytes``, each on its own.
    Beyond that they are shuffled, and of the documents only the words that some window is looked up by.
    """
    windows = cut_lineage(windows_of(items, size))
    small = _sender(windows.select((2 * F.octet_length("window") + 24 * F.size("words") + 16 * F.size("items")).alias("bytes")), broadcast_bytes)
    vocabulary = cut_lineage(windows.select(F.explode("words").alias("word")).distinct())
    few = _sender(vocabulary.select(F.octet_length("word").alias("bytes")), broadcast_bytes)
    words = words_of(F.col("text"))
    # the outer form keeps Spark from cutting every text twice to look for empty arrays
    seen = docs.select(F.explode_outer(words).alias("raw")).select(lowered(F.col("raw")).alias("word"))
    counts = seen.join(few(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    # words that no document has rule their windows out
    ranked = windows.select("window", F.posexplode("words").alias("place", "word"), F.size("words").alias("length")).join(
        few(counts), "word", "left"  # counts of words of the vocabulary, so no more than it; a frequent word's windows stay where they are
    )
    rarest = ranked.groupBy("window").agg(
        F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "word", "place", "length")).alias("r")
    )
    prefixes = rarest.where("r.k > 0").select("window", "r.word", "r.place", "r.length")
    prefixes = cut_lineage(prefixes)
    start = F.col("at") - F.col("place")
    fits = (start >= 1) & (start + F.col("length") - 1 <= F.col("n_words"))
    if small is F.broadcast:
        # an empty word at place 0 keeps one row per document, with its length; no row is shuffled
        spoken = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.concat(F.array(F.lit("")), words).alias("words"))
        probes = spoken.select("doc_id", "mark", (F.size("words") - 1).alias("n_words"), F.posexplode_outer("words").alias("at", "raw"))
        found = probes.withColumn("word", lowered(F.col("raw"))).join(small(prefixes), "word", "left")
        found = found.where((F.col("at") == 0) | fits)
        found = cut_lineage(found.select("doc_id", "mark", "n_words", "at", start.alias("start"), "length", "window"))
        counted, found = found.where("at = 0").select("doc_id", "mark", "n_words"), found.where("at > 0")
    else:
        spoken = docs.select("doc_id", F.xxhash64("text").alias("mark"), words.alias("words"))
        counted = spoken.select("doc_id", "mark", F.size("words").alias("n_words"))
        probes = spoken.select("doc_id", "mark", F.size("words").alias("n_words"), F.posexplode("words").alias("before", "raw"))
        probes = probes.select("doc_id", "mark", "n_words", (F.col("before") + 1).alias("at"), lowered(F.col("raw")).alias("word"))
        probes = probes.join(few(prefixes.select("word").distinct()), "word", "left_semi")
        # adaptive execution splits the rows of a frequent word over several tasks
        found = probes.join(prefixes, "word").where(fits)
        found = cut_lineage(found.select("doc_id", "mark", start.alias("start"), "length", "window"))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"), "text")
    # one row per document, so that its words are cut once however many places are to be compared
    tries = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "length", "window")).alias("tries"))
    joined = tries.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")))
    joined = joined.select("doc_id", "mark", words.alias("words"), "tries")
    joined = joined.select("doc_id", "mark", "words", F.explode_outer("tries").alias("t")).select("doc_id", "mark", "words", "t.*")
    said = F.array_join(F.transform(F.slice("words", F.col("start"), F.col("length")), lowered), " ")
    proven = joined.where(said == F.col("window")).select("doc_id", "mark", "start", "length", "window")
    placed = proven.join(small(windows.select("window", "items")), "window").drop("window")
    return counted, placed


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, broadcast_bytes: int = 32_000_000
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, mark``.

    ``n_hit`` counts the words inside any occurring window; ``n_items`` the known item ids with one, and
    ``items_sha256`` digests them, sorted as text and joined by commas. ``contaminated``: at least one word in
    ``share`` is hit. NULL texts have no words; items without words have no windows. Repeated rows each get their
    row. Other columns are not looked at.
    """
    counted, found = occurrences(docs, items, size, broadcast_bytes)
    hits = found.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("items").alias("items")
    )

    def cover(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(span["start"], state["at"]))
        return F.struct(F.greatest(state["at"], end).alias("at"), (state["n"] + fresh).alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")), cover, lambda s: s["n"])
    hits = hits.select(
        F.col("doc_id").alias("id"), F.col("mark").alias("of"), covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )
    joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        "mark",
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows; all others stay as they are, whatever their columns are called."""
    bad = contamination(docs, items, size, share).where("contaminated").select("doc_id", "mark").distinct()
    mark = free_name(docs, "mark")
    marked = docs.select(*quoted(docs.columns), F.xxhash64("text").alias(mark))
    named = bad.toDF(free_name(marked, "of_id"), free_name(marked, "of_mark"))
    same = marked["doc_id"].eqNullSafe(named[named.columns[0]]) & (marked[mark] == named[named.columns[1]])
    return marked.join(named, same, "left_anti").select(*quoted(docs.columns))

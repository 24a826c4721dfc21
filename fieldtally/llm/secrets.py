"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the digest of its text. An entry of the ledger says which rule versions have
scanned a blob and what they found; entries are only ever added. A run scans one version of each blob that lacks a rule, and
only for the rules it lacks; findings are joined back to all paths of a blob. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import cut_lineage, free_name, quoted

LEDGER = "blob binary, scanned array<string>, spans array<struct<start:bigint,rule:int,end:bigint>>"
_SPANS = "array<struct<start:bigint,rule:int,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, its least length, and a cheap first test."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    literal: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


# Patterns the contract fixes. The values of group 2 are measured after the match, so a short one still uses up its text.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", literal="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
)


_BLOCK = 256  # entries that one fold goes over: a fold copies what it has gathered at each step


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(entries: Column) -> Column:
    """An array as an array of blocks."""
    numbers = F.when(F.size(entries) > 0, F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / _BLOCK).cast("int")))
    cut = F.transform(numbers, lambda b: F.slice(entries, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.coalesce(cut, F.slice(F.transform(F.array(F.lit(0)), lambda b: F.slice(entries, 1, 1)), 1, 0))


def _running(blocks: Column, step, value) -> Column:
    """What the blocks before each block come to, from 0 on by ``step``."""

    def add(state: Column, block: Column) -> Column:
        return F.struct(step(state["at"], value(block)).alias("at"), F.concat(state["list"], F.array(state["at"])).alias("list"))

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("list"))
    return F.aggregate(blocks, nothing, add, lambda s: s["list"])


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """``start, rule, end`` of a rule's matches in code points, end exclusive, from the left without overlap.

    The texts between the matches and the matches alternate; places are running sums of their lengths, in blocks, so that many
    matches in a text cost as much each as few.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, 0)
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)).alias("gap"),
        found.alias("hit"),
        F.regexp_extract_all(text, pattern, rule.group).alias("value"),
    )

    def walk(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        spans = F.when(F.length(part["value"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def placed(blocks: Column) -> Column:
        starts = _running(blocks, lambda before, block: before + block["at"], lambda block: block)
        moved = F.zip_with(
            blocks, starts,
            lambda block, at: F.transform(
                block["spans"],
                lambda s: F.struct((s["start"] + at).alias("start"), s["rule"].alias("rule"), (s["end"] + at).alias("end")),
            ),
        )
        return F.flatten(moved)

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))
    first = text.contains(rule.literal) if rule.literal else text.rlike(rule.pattern)
    walked = _let(parts, lambda p: _let(F.transform(_blocks(p), lambda block: F.aggregate(block, nothing, walk)), placed))
    return F.when(first, walked).otherwise(F.array().cast(_SPANS))


def addressed(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the ``blob`` digest of every version; NULL text is the empty blob."""
    return docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "blob", F.unhex(F.sha2("text", 256))
    )


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def unseen_entries(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Entries that ``ledger`` lacks of ``versions`` (``path, text, blob``): ``blob``, the rule versions it lacked, their spans.

    One path stands for a blob, so a blob with very many paths is read once. Blobs whose rule versions are all known are not
    read; of the ledger only digests and rule versions are. A changed rule has another version and is scanned again. The
    ``rule`` of a span is its place in the entry's ``scanned``, so an entry holds whatever rules later runs have.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    chosen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("done"))
        chosen = chosen.join(known, "blob", "left").withColumn("lacks", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
        chosen = chosen.where(F.size("lacks") > 0).drop("done")
    else:
        chosen = chosen.withColumn("lacks", keys)
    v, c = versions.alias("v"), chosen.alias("c")
    unseen = v.join(c, F.col("v.path").eqNullSafe(F.col("c.path")) & (F.col("v.blob") == F.col("c.blob")))
    nothing = F.array().cast(_SPANS)
    found = [
        F.when(F.array_contains("c.lacks", r.key), spans_of(F.col("v.text"), r, i)).otherwise(nothing) for i, r in enumerate(rules)
    ]
    scanned = unseen.select(F.col("v.blob").alias("blob"), F.col("c.lacks").alias("scanned"), F.concat(*found).alias("spans"))
    entries = scanned.dropDuplicates(["blob"])
    return entries.select("blob", "scanned", F.array_sort(_numbered("spans", keys, F.col("scanned"))).alias("spans"))


def _numbered(spans: str, old: Column, new: Column) -> Column:
    """Spans whose ``rule`` is a place in ``old``, with the same rule's place in ``new``; rules that ``new`` lacks go."""

    def place(span: Column) -> Column:
        return (F.array_position(new, F.element_at(old, span["rule"] + 1)) - 1).cast("int")

    moved = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("rule"), s["end"].alias("end")))
    return F.when(old == new, F.col(spans)).otherwise(F.filter(moved, lambda s: s["rule"] >= 0))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the entries that it lacked of ``versions``. Its own entries stay as they are."""
    entries = cut_lineage(unseen_entries(versions, ledger, rules))
    if ledger is None:
        return entries
    # columns of their own: a checkpointed frame keeps conditions on columns it no longer has, which a union does not survive
    old, new = (df.select(*[F.col(c).alias(c) for c in ("blob", "scanned", "spans")]) for df in (ledger, entries))
    return old.unionByName(new)


def scan_into(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Appends the entries that the ledger stored at ``path`` lacks of ``versions``, and returns it; it may not exist yet.

    What is stored is never rewritten. A run that is lost has appended nothing, and another one does its work; entries that two
    runs at once have both appended count once.
    """
    spark = versions.sparkSession
    empty_ledger(spark).write.mode("ignore").parquet(path)
    known = spark.read.schema(LEDGER).parquet(path)
    unseen_entries(versions, known, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` of the blobs in which ``rules`` found something; ``rule`` is the place in ``rules``.

    Spans of rule versions that are not in ``rules`` do not count.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    valid = ledger.where(F.size("spans") > 0).select("blob", _numbered("spans", F.col("scanned"), keys).alias("spans"))
    valid = valid.where(F.size("spans") > 0)
    return valid.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, spans`` of every version; only blobs with findings are joined to."""
    return versions.select("path", "blob").join(blob_findings(ledger, rules), "blob", "left").select(
        "path", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )


def described(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas, in order of start and rule."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_<kind>`` of each rule, ``base_sha256`` and ``spans``.

    NULL text is empty and has no spans. Repeated rows each get their row. Other columns are not looked at.
    """
    versions = addressed(docs)
    found = by_path(versions, scan_unseen(versions, ledger, rules), rules).withColumn("text", described(F.col("spans"), rules))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2("text", 256).alias("base_sha256"), F.col("text").alias("spans")
    )


def _marked_over(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of its spans, which are in order; overlapping spans get one mark.

    A block of spans works on its own piece of the text, so no step walks the text from its start.
    """

    def last(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda end, s: F.greatest(end, s["end"]))

    def cut_block(block: Column, begin: Column) -> Column:
        length = F.greatest(begin, last(block)) - begin
        own = F.substring(text, (begin + 1).cast("int"), length.cast("int"))

        def cut(piece: Column) -> Column:
            def step(state: Column, span: Column) -> Column:
                fresh = span["start"] - begin >= state["at"]
                between = F.substring(piece, (state["at"] + 1).cast("int"), (span["start"] - begin - state["at"]).cast("int"))
                out = F.when(fresh, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
                return F.struct(F.greatest(state["at"], span["end"] - begin).alias("at"), out.alias("out"))

            return F.aggregate(block, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

        return _let(own, cut)

    def joined(blocks: Column) -> Column:
        begins = _running(blocks, lambda before, end: F.greatest(before, end), last)
        return F.array_join(F.zip_with(blocks, begins, cut_block), "")

    rest = F.substring(text, (last(spans) + 1).cast("int"), F.length(text))
    return F.concat(_let(_blocks(spans), joined), rest)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one mark. ``n_chars`` follows.

    Rows without findings come back as they are, as do all other columns, whatever their names. NULL texts stay NULL, repeated
    rows each get their row, no rows give no rows.
    """
    own = quoted(docs.columns)
    address = free_name(docs, "address")
    addressed_docs = docs.select(*own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias(address))
    blob, spans, clean = (free_name(addressed_docs, name) for name in ("blob", "spans", "clean"))
    found = blob_findings(scan_unseen(addressed(docs), None, rules), rules).toDF(blob, spans)
    joined = addressed_docs.join(found, addressed_docs[address] == found[blob], "left")
    changed = F.col(spans).isNotNull()
    joined = joined.select(*own, F.when(changed, _marked_over(F.col("text"), F.col(spans), mark)).alias(clean))
    changed = F.col(clean).isNotNull()
    out = {"text": F.coalesce(F.col(clean), F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*[out[c].alias(c) if c in out else column for c, column in zip(docs.columns, own)])

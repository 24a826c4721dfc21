"""Registered queries of the operators, each over whole tables with production settings, and their SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import (
    conversation_repair,
    decontamination,
    fingerprints,
    language_id,
    license_scan,
    packing,
    periodic_runs,
    quality,
    quality_rules,
    secrets,
    simhash_dedup,
    substring_dedup,
    toxicity,
)
from fieldtally.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = re.sub(r"\n\s*\n", "\n", sql).strip()
        return function

    return register


@query(r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
    SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS t
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
firsts AS (SELECT t, min(doc_id) AS f FROM g GROUP BY t),
gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(s, s + 13)))) AS p
    FROM g JOIN firsts USING (t) WHERE f < doc_id GROUP BY doc_id),
j AS (SELECT d.doc_id, w, coalesce(p, CAST([] AS BIGINT[])) AS p FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM j
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=13)


_ASSIGN = r"""(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["''\''']?\x20*[:=]\x20*["''\''']?([A-Za-z0-9+/_.=-]+))""".replace(
    "''\\'''", "''"
)


def _sql_spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: places are running sums of the pieces between and of the matches."""
    return f"""
    SELECT doc_id, {number} AS rule, '{kind}' AS kind,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
           length(hits[i]) AS n
    FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
               regexp_extract_all(t, '{pattern}', {group}) AS vals FROM d))
    WHERE length(vals[i]) >= {least}"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_sql_spans("assign", 0, _ASSIGN, 3, 8)}
    UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]+", 0, 16)}
    UNION ALL {_sql_spans("hex", 2, "[0-9a-f]+", 0, 32)}),
j AS (
    SELECT doc_id, sum(CASE WHEN rule = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN rule = 1 THEN 1 ELSE 0 END) AS k,
           sum(CASE WHEN rule = 2 THEN 1 ELSE 0 END) AS h,
           string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, rule) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access,
       CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
""")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


_SQL_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)


@query(f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS t
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (
    SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, g.n, s, item FROM g JOIN win ON g.n = win.n AND g.t = win.t),
j AS (
    SELECT doc_id, len(list_distinct(flatten(list(range(s, s + n))))) AS n_hit, count(DISTINCT item) AS n_items,
           sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items
    FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN j USING (doc_id)
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items, size=13, share=20).drop("mark")


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labels without the held-out fifth."""
    docs, labels = (table(spark, sf_dir, name).where(fold("doc_id", 5) != 0) for name in ("documents", "labels"))
    return docs.select("doc_id", "text"), labels


def _held_out() -> Column:
    return F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = toxicity.fit(*_training(spark, sf_dir))
    found = toxicity.tagged(table(spark, sf_dir, "documents"), field)
    return found.select("doc_id", _held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    docs, labels = _training(spark, sf_dir)
    model = quality.fit(docs, labels.select("doc_id", grade.alias("grade")), grades=3)
    found = quality.graded(table(spark, sf_dir, "documents"), model, least=1)
    return found.select("doc_id", _held_out(), "expected_grade", "tail_probability", "keep")


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


@query()
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"), share=4)


@query()
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=2)


def tokenizer_files() -> tuple[str, str]:
    """The byte-level BPE vocabulary as ranks, and as the tokenizer file whose ids are asked for."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files(), size=1024, end_id=0).drop("ids")


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from documents outside the held-out third; a NULL id is in no fold and teaches nothing."""
    return language_id.learn(docs.where(fold("doc_id", 3) != 1).select("text", "lang"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    named = language_id.identified(docs.select("doc_id", "text"), language_model(docs))
    return named.select("doc_id", held_out, "lang_pred", "score")


@query()
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Rows with the damage that the repair is asked to mend, and how often each of them stands there."""
    words = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    harm = F.crc32(F.concat(words["conv_id"], F.lit(":"), words["turn"]).cast("binary")) % 20
    text = F.when(harm == 1, F.lit("")).when(harm == 2, F.translate(words["text"], ".!?", "")).otherwise(words["text"])
    return rows.select(
        "conv_id", "turn", F.when(harm == 4, F.lit("user")).otherwise(words["role"]).alias("role"), text.alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"),
    )


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged_conversations(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(rows, F.col("copies"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document, by a hash of its id, goes on with a period of its own words."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", hashed.alias("h"), F.when(hashed % 10 == 0, words).alias("w"))
    start = F.when(F.size("w") > 0, F.floor(F.col("h") / 10) % F.size("w"))
    some = some.withColumn("a", start.cast("int"))
    period = 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.floor(F.col("h") / 10) % 8))
    some = some.withColumn("p", period.cast("int"))
    again = F.expr("transform(w, (x, i) -> get(w, CASE WHEN i < a THEN i ELSE a + (i - a) % p END))")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_period(table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs, times=4, least=6, hashed=True)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    length = -best["less"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"),
        best["period"].alias("period"), F.floor(1000 * length / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.col("kept").alias("collapsed_sha256"),
    )

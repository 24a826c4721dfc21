"""The text operators against brute force, on small frames with every awkward row, and against their SQL."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldtally.llm import decontamination, fingerprints, language_id, license_scan, packing, quality, queries, secrets
from fieldtally.llm import simhash_dedup, substring_dedup, toxicity

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, mark string, words int, `end` int"


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%03d" % x for x in rng.integers(0, 900, n))


SHARED, LONG = passage(1, 40), passage(2, 3000)
TEXTS = [
    (0, "intro one two " + SHARED + " tail"),
    (1, None),
    (2, ""),
    (3, SHARED),
    (4, "other words before\t" + SHARED + "\nand after; password = 'abcdefgh12'"),
    (5, passage(3, 12)),
    (6, passage(3, 12)),
    (7, LONG),
    (8, LONG + " x"),
    (8, LONG + " x"),
    (None, SHARED),
    (9, "token: secret: abcdefghijk  API_KEY=\"ABCDEFGH\" AKIAABCDEFGHIJKL " + "0123456789abcdef" * 3),
    (10, "É!\n.\n Ärger <|endoftext|>   zwei  drei"),
    (11, "no letters? 12 34"[12:]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "m", 1, 2) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def removed(rows, size=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        kept = [True] * len(w)
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                kept[k : k + size] = [False] * size
        text = b" ".join(x for x, y in zip(w, kept) if y)
        out.append((i, len(w), len(w) - sum(kept), hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, bucket", [(4_000_000, 8_000_000), (300, 2_000)])
def test_repeated_passages_go(docs, chunk, bucket):
    got = substring_dedup.remove_repeats(docs, chunk_bytes=chunk, bucket_bytes=bucket).collect()
    assert sorted(map(tuple, got), key=str) == removed(TEXTS)


def test_secrets_and_ledger(spark, docs):
    rows = {r.doc_id: r for r in secrets.secret_report(docs).collect() if r.doc_id is not None}
    assert rows[9].spans.startswith("assign:28:") and (rows[9].n_assign, rows[9].n_access, rows[9].n_hex) == (1, 1, 1)
    assert rows[1].spans == "" and rows[4].n_assign == 1
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[4].endswith("and after; [secret]'") and clean[1] is None and clean[7] == LONG
    versions = secrets.addressed(docs)
    ledger = secrets.scan_unseen(versions)
    assert ledger.count() == len({t or "" for _, t in TEXTS})
    assert secrets.unseen_entries(versions, ledger).collect() == []
    again = secrets.scan_unseen(versions, ledger)
    assert sorted(map(str, again.collect())) == sorted(map(str, ledger.collect()))
    newer = (*secrets.RULES[1:], secrets.Rule("assign", r"(intro) (one)", 2, 3, version=2))
    both = secrets.scan_unseen(versions, ledger, newer)
    assert {tuple(r.scanned) for r in secrets.unseen_entries(versions, ledger, newer).collect()} == {("assign:2",)}
    found = {r.path: [(s.start, s.rule, s.end) for s in r.spans] for r in secrets.by_path(versions, both, newer).collect()}
    assert found[0] == [(0, 2, 9)] and [x[1] for x in found[9]] == [0, 1]  # the former rule's spans go, the others keep theirs
    former = {r.path: r.spans for r in secrets.by_path(versions, ledger).collect()}
    assert {r.path: r.spans for r in secrets.by_path(versions, both).collect()} == former


def test_stored_ledger_is_only_appended_to(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    parts = lambda: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "ledger").glob("part-*")}
    versions = secrets.addressed(docs)
    secrets.scan_into(versions.where("path < 5"), path)
    first = parts()
    ledger = secrets.scan_into(versions, path)
    assert first.items() <= parts().items()
    assert ledger.count() == ledger.select("blob").distinct().count() == len({t or "" for _, t in TEXTS})
    assert sorted(map(str, secrets.secret_report(docs, ledger).collect())) == sorted(map(str, secrets.secret_report(docs).collect()))
    before = ledger.count()
    assert secrets.scan_into(versions, path).count() == before  # nothing is new
    ledger.limit(4).write.mode("append").parquet(path)  # as by two runs at once
    twice = spark.read.schema(secrets.LEDGER).parquet(path)
    assert sorted(map(str, secrets.secret_report(docs, twice).collect())) == sorted(map(str, secrets.secret_report(docs).collect()))


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "a token: abcdefghij b", "x", "y", "z", 21, "p"), (2, None, None, "y", None, None, None), (3, "plain", "x", None, "z", 5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string, spans string, clean string, n_chars int, `path` string")
    found = {tuple(r) for r in secrets.redacted(df).collect()}
    assert found == {(1, "a [secret] b", "x", "y", "z", 12, "p"), rows[1], rows[2]}


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, SHARED.upper()), (2, "Ärger, ZWEI"), (3, None), (4, ""), (5, "absent")], "item_id long, text string")
    for limit in (32_000_000, 8_000, 0):  # windows and words broadcast, words only, both shuffled
        rows = {r.doc_id: r for r in decontamination.contamination(docs, items, broadcast_bytes=limit).collect()}
        assert len(rows) == len({i for i, _ in TEXTS})
        assert (rows[3].n_words, rows[3].n_hit, rows[3].n_items, rows[3].contaminated) == (40, 40, 1, True)
        assert (rows[0].n_hit, rows[7].n_hit, rows[1].n_words, rows[1].contaminated) == (40, 0, 0, False)
        assert rows[10].n_hit == 0 and rows[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 7, 8, 9, 10, 11}


def test_windows_are_shuffled_by_what_is_stored_of_them(spark, monkeypatch):
    items = spark.createDataFrame([(i, passage(50 + i, 200)) for i in range(12)], "item_id long, text string")
    texts = [(i, "before " + passage(50 + i % 20, 200)[: 300 + 40 * i] + " after") for i in range(40)] + [(90, None), (91, "w001 " * 500)]
    many = spark.createDataFrame(texts, "doc_id long, text string")
    stored = sum(len(r.window) for r in decontamination.windows_of(items, 13).collect())
    sent = []
    real = F.broadcast
    monkeypatch.setattr(decontamination.F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    rows = []
    for limit in (100 * stored, stored, 0):
        sent.clear()
        rows.append(sorted(decontamination.contamination(many, items, broadcast_bytes=limit).drop("mark").collect()))
        assert any("window" in columns for columns in sent) == (limit > stored) and bool(sent) == (limit > 0)
    assert rows[0] == rows[1] == rows[2] and sum(r.contaminated for r in rows[0]) == 24


def brute_simhash(text):
    words = (text or "").encode().translate(simhash_dedup._LOWER).split()
    runs = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs] if words else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_near_duplicates(docs):
    rows = simhash_dedup.near_duplicates(docs, node_rows=2).collect()
    prints = [(i, brute_simhash(t)) for i, t in TEXTS]
    assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in rows if r.doc_id is not None) == sorted(p for p in prints if p[0] is not None)
    group = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    wanted = {i: min(j for (j, _), g in zip(prints, group) if g == group[k] and j is not None) for k, (i, _) in enumerate(prints)}
    assert {r.doc_id: r.component_id for r in rows} == wanted
    kept = simhash_dedup.first_of_each(docs)
    known = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(known) == sorted({v for v in wanted.values()}) and kept.columns == docs.columns


def test_trie_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, near ^ np.uint64(1 << 40)]))
    a, b = simhash_dedup.trie_links(values, None, 0, 0, 2)
    wanted = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == wanted and len(a) == len(wanted)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    ranks, special = queries.tokenizer_files()
    rows = packing.pack(docs.where("doc_id is not null and doc_id <> 8"), ranks, special, size=64, open_windows=3).collect()
    real = Tokenizer.from_file(special)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text in TEXTS:
        if i in (None, 8):
            continue
        ids = np.array(real.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows_of in windows.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    known = sorted({(i, t or "") for i, t in TEXTS if i is not None})
    parts = lambda t: {p.strip(" ") for p in re.split(r"[\n.!?]+", t)} - {""}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, text) in enumerate(known):
        after = known[(k + 1) % len(known)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert rows[i].near_edited == pytest.approx(like(parts(text), parts(edited)))
        assert rows[i].near_next == pytest.approx(like(parts(text), parts(after)))
    assert rows[5].fingerprint == rows[6].fingerprint


def test_larger_sketches_recover_what_small_ones_cannot(spark):
    one, two = "\n".join(f"a{i}" for i in range(700)), "\n".join(f"a{i}" for i in range(300, 1100))
    row = fingerprints.edited_fingerprints(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).where("doc_id = 1").first()
    assert row.near_next == pytest.approx(400 / 1100)


@pytest.mark.parametrize("sizes", [(64, 1024), (8,), (8, 16, 1024)])
def test_peeling_recovers_the_changed_paragraphs(spark, sizes):
    lines = lambda a, b: "\n".join(f"line {i}" for i in range(a, b))
    old = [(1, lines(0, 400)), (2, "a. b! c"), (3, None), (4, "same. text"), (5, "gone"), (7, "x. y"), (7, "z"), (None, "n. m"), (8, "")]
    new = [(1, lines(150, 600)), (2, "b. c. d. d\nd"), (3, "now"), (4, "text\nsame"), (6, "born. born"), (7, "z. w"), (None, "m"), (8, " \n.")]
    schema = "doc_id long, text string, digest string, side string"
    frames = [spark.createDataFrame([(i, t, "d", "s") for i, t in rows], schema) for rows in (old, new)]
    found = fingerprints.changed_paragraphs(*frames, sizes=sizes).collect()

    def parts(rows):
        return {(i, p.strip(" ")) for i, t in rows for p in re.split(r"[\n.!?]+", t or "")} - {(i, "") for i, _ in rows}

    texts = sorted({p for _, p in parts(old) | parts(new)})
    named = spark.createDataFrame([(t,) for t in texts], "p string").select("p", F.xxhash64("p").alias("k")).collect()
    by_digest = {r.k: r.p for r in named}
    got = sorted((r.doc_id or 0, by_digest[r.digest], r.side) for r in found)
    want = [(i or 0, p, "before") for i, p in parts(old) - parts(new)] + [(i or 0, p, "after") for i, p in parts(new) - parts(old)]
    assert got == sorted(want)
    assert fingerprints.changed_paragraphs(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_language_mixture(spark):
    rows = [(i, ("the cat and the dog with this " if i % 2 else "der hund und die katze mit dem ") * 5, "en" if i % 2 else "de") for i in range(40)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "the dog and this cat"), (2, "die katze und der hund"), (3, None), (4, "12 ?"), (5, rows[0][1] * 3 + rows[1][1])]
    found = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "de"]
    assert 0.5 < found[5].score < 1.0 and found[3].score == 0.0


def labelled(spark, rows, name):
    """Documents and their labels as two tables."""
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    return texts, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], f"doc_id long, {name} int")


def test_toxicity_marginals_and_spans(spark):
    field = toxicity.Field(1 << 12, 5)
    field.step = np.array([[0.3, -0.2], [0.1, 0.5]])
    scores = np.array([[0.5, -1.0, 2.0], [1.5, 0.2, 0.0]])
    got = field.marginals(scores, np.array([3, 2]))
    for row, n, mine in zip(scores, (3, 2), got):
        weights = {}
        for path in range(1 << n):
            y = [path >> t & 1 for t in range(n)]
            weights[tuple(y)] = np.exp(sum(row[t] * y[t] for t in range(n)) + sum(field.step[y[t - 1], y[t]] for t in range(1, n)))
        total = sum(weights.values())
        for t in range(n):
            assert mine[t] == pytest.approx(sum(w for y, w in weights.items() if y[t]) / total)
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"word{x}" for x in rng.integers(0, 300, 30)) + (" vileness" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    model = toxicity.fit(*labelled(spark, rows, "toxic"), buckets=1 << 14)
    texts = [(1, "word1 vileness word2"), (2, "word1 word2 word7"), (3, None), (4, "")]
    found = {r.doc_id: r for r in toxicity.tagged(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert found[1].score > 0.5 > max(found[i].score for i in (2, 3, 4))
    assert [(s.start, s.end) for s in found[1].spans] == [(6, 14)]


def test_quality_grades_are_ordered(spark):
    rows = [(word * 8, grade) for grade, word in enumerate(("%%% ", "plain ", "good ")) for _ in range(30)]
    model = quality.fit(*labelled(spark, rows, "grade"), 3, buckets=512)
    assert (np.diff(model.thresholds) > 0).all()
    texts = [(0, "%%% %%%"), (1, "plain plain"), (2, "good good"), (3, None), (4, "")]
    found = {r.doc_id: r for r in quality.graded(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert found[0].expected_grade < found[1].expected_grade < found[2].expected_grade and not found[0].keep and found[2].keep
    assert found[3].expected_grade == found[4].expected_grade


def test_licenses(spark):
    texts = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, None), (3, "Released under the MIT License"), (4, "a license of sorts")]
    found = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [found[i].licenses for i in (1, 2, 3, 4)] == ["Apache-2.0", "", "MIT", ""] and found[1].findings[0].line == 1
    assert found[1].findings[0].changes == "" and found[4].n_blocks == 1


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    ranks, special = queries.tokenizer_files()
    model = language_id.learn(none)
    for df in (
        substring_dedup.remove_repeats(none), secrets.secret_report(none), decontamination.contamination(none, items),
        simhash_dedup.near_duplicates(none), packing.pack(none, ranks, special), fingerprints.edited_fingerprints(none),
        language_id.identified(none, model), license_scan.scanned(none),
        toxicity.tagged(none, toxicity.fit(none.select("doc_id", "text"), none.selectExpr("doc_id", "words toxic"))),
        quality.graded(none, quality.fit(none.select("doc_id", "text"), none.selectExpr("doc_id", "words grade"), 3)),
    ):
        assert df.collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_held_out_languages(spark):
    found = queries.QUERIES["op10_language_id"](spark, SF_DIR)
    right = found.join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, left = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF_DIR)
        assert left.columns == columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert len(ids) == left.count() > 150
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().collect()} == ids


def test_toxicity_pairs_of_states():
    field, rng = toxicity.Field(8, 5), np.random.default_rng(1)
    field.step = rng.normal(size=(2, 2))
    lengths, scores = np.array([4, 2, 1, 0]), rng.normal(size=(4, 4))
    for row, n, mine in zip(scores, lengths, field.pairs(scores, lengths)):
        total, pairs = 0.0, np.zeros((2, 2))
        for path in range(1 << n):
            y = [path >> t & 1 for t in range(n)]
            w = np.exp(sum(row[t] * y[t] for t in range(n)) + sum(field.step[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            for t in range(1, n):
                pairs[y[t - 1], y[t]] += w
        assert mine == pytest.approx(pairs / total)


def test_licenses_over_lines_whole_texts_and_tags(spark):
    wordings = license_scan.forms()
    whole = {name: max((t for n, t in wordings if n == name), key=len) for name, _ in wordings}
    edited = " ".join("other" if i % 13 == 5 else w for i, w in enumerate(whole["GPL-3.0"].split(" ")))
    wanted = [
        ("x\nLicensed under the Apache License,\nVersion 2.0.\ny", "Apache-2.0"),
        ("# Licensed under\n#\n# the Apache License,\n# Version 2.0.", "Apache-2.0"),
        ("Copyright 2020 A. N. Other\n * " + whole["MIT"].replace("\n", "\n * "), "MIT"),
        ("some code\n" + whole["BSD-2-Clause"] + "\nmore code", "BSD-2-Clause"),
        (whole["BSD-3-Clause"], "BSD-3-Clause"),
        (whole["MIT"] + "\n\n" + whole["Apache-2.0"], "Apache-2.0,MIT"),
        (edited, "GPL-3.0"),
        (" ".join(whole["ISC"].split()), "ISC"),
        ("Licensed under the MIT License or the Apache License, Version 2.0", "Apache-2.0,MIT"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY-ND 4.0.", ""),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-or-later WITH Classpath-exception-2.0", "Apache-2.0,GPL-3.0,MIT"),
        ("SPDX-License-Identifier: EUPL-1.2", "EUPL-1.2"),
        ("no permission of any kind is named in these words", ""),
        (whole["MIT"].split("\n", 1)[1], "MIT"),
        (whole["0BSD"].split("\n", 1)[1], "0BSD"),
    ]
    found = license_scan.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(wanted)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert [rows[i].licenses for i in range(len(wanted))] == [names for _, names in wanted]
    assert [(f.line, f.last, f.changes) for f in rows[0].findings] == [(1, 2, "")] and rows[13].n_blocks == 0


def test_licence_blocks_equal_a_search_over_all_lines(spark):
    """Whole lines of a text that are notices or whole licences, by plain compression and comparison with every template."""
    rng = np.random.default_rng(12)
    named, whole = license_scan.notices(), license_scan.whole_texts()
    texts = []
    for i in range(30):
        lines = [" ".join(rng.choice(["river", "stone", "map", "seven", "green"], 8)) for _ in range(6)]
        for k in rng.choice(6, 2, replace=False):
            form = (named + whole)[int(rng.integers(len(named + whole)))][1]
            words = " ".join(form.split()).split(" ")
            if len(words) > 60:
                words[int(rng.integers(20, len(words) - 20))] = "pebble"
            lines[k] = " ".join(words)
        texts.append((i, "\n".join(lines)))

    def best(line):
        gains = []
        for f, (name, form) in enumerate(named + whole):
            shared, said = license_scan.differences(line, form)
            if shared >= 0.8 * len(license_scan._WORD.findall(form.lower())) and shared:
                gone = [w[1:] for w in said.split() if w[0] == "-"]
                added = [w[1:] for w in said.split() if w[0] == "+"]
                same = lambda w: w.lstrip("v").removesuffix(".0")
                bare = [w for w in gone if w in license_scan._NAMES or any(c.isdigit() for c in w) and same(w) not in map(same, added)]
                if f >= len(named) or not bare and not license_scan._OTHERS.intersection(added):
                    gain = license_scan.compressed(line.encode(), None) - license_scan.compressed(line.encode(), form.encode())
                    gains.append((gain, shared - len(said.split()), name))
        near = [g for g in gains if g[0] >= 0.9 * max(gains)[0] - 2]
        return max(near, key=lambda g: (g[1], g[0], g[2]))[2] if near else None

    for row in license_scan.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        wanted = [(n, best(line)) for n, line in enumerate(dict(texts)[row.doc_id].split("\n"))]
        assert [(f.line, f.template) for f in row.findings or [] if f.confirmed] == [x for x in wanted if x[1]]


def test_licences_in_words_without_a_gap(spark):
    """A notice whose words are joined by dots, half a million times over, is one stretch and is walked once."""
    notice = license_scan.TEMPLATES["MIT"].rstrip(".").replace(" ", ".")
    text = ".".join([notice] * 2_000)
    rows = [(1, text), (2, "see " + license_scan.TEMPLATES["MIT"] + " " + "x." * 600_000)]
    found = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2].licenses == "MIT" and len(found) == 2


def test_whole_texts_of_ones_own(spark):
    wording = " ".join(f"clause{i} binds" for i in range(40))
    df = spark.createDataFrame([(1, "Own License\n" + wording), (2, "Released under the MIT License.")], "doc_id long, text string")
    found = {r.doc_id: r.licenses for r in license_scan.scanned(df, texts={"Own": wording}).collect()}
    assert found == {1: "Own", 2: ""}


def test_every_copy_of_a_notice_is_found(spark):
    text = "\n".join([license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["CC-BY-4.0"]] * 50)
    row = license_scan.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_blocks == 100 and [f.line for f in row.findings] == list(range(100)) and all(f.confirmed for f in row.findings)


def test_toxicity_of_long_documents(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"word{x}" for x in rng.integers(0, 300, n)]
    rows = []
    for i in range(60):
        text = words(1500)
        if i % 3 == 0:
            text[int(rng.integers(0, 1500))] = "vileness"
        rows.append((" ".join(text), int(i % 3 == 0)))
    assert min(len(t) for t, _ in rows) > 4800
    model = toxicity.fit(*labelled(spark, rows, "toxic"), buckets=1 << 14)
    texts = [(1, " ".join([*words(1400), "vileness", *words(200)])), (2, " ".join(words(1600))), (3, " ".join(words(20)))]
    schema = "doc_id long, text string"
    found = {r.doc_id: r for r in toxicity.tagged(spark.createDataFrame(texts, schema), model).collect()}
    assert found[1].score > 0.5 > max(found[2].score, found[3].score) and len(found[1].spans) == 1
    plain = toxicity.fit(*labelled(spark, [(t, 0) for t, _ in rows], "toxic"), buckets=1 << 14)
    scores = [r.score for r in toxicity.tagged(spark.createDataFrame([*texts, (4, None), (5, " ".join(words(20_000)))], schema), plain).collect()]
    assert max(scores) < 0.1


def test_training_windows_cover_documents():
    lengths = [0, 5, 800, 801, 20_000]
    found = toxicity.windows(lengths, 800, 10**6)
    for i, n in enumerate(lengths):
        mine = [(a, b) for k, a, b in found if k == i]
        assert sum(b - a for a, b in mine) == n and all(b - a <= 800 for a, b in mine)
    few = [(a, b) for k, a, b in toxicity.windows(lengths, 800, 6000) if k == 4]
    assert 1 < len(few) < 8 and few[0][0] == 0 and few[-1][1] == 20_000


def test_copies_do_not_fill_the_training_sample(spark):
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 300, n))
    copied, others = words(30) + " vileness", [words(30) + " spite" for _ in range(30)]
    clean = [words(30) for _ in range(400)]
    rows = [(t, 1) for t in [copied] * 400 + others] + [(t, 0) for t in clean + [clean[0]] * 400]
    model = toxicity.fit(*labelled(spark, rows, "toxic"), buckets=1 << 14, sample=40)
    texts = [(1, copied), (2, words(10) + " spite " + words(10)), (3, words(20)), (4, " ".join(copied.split()[:-1]))]
    found = {r.doc_id: r.score for r in toxicity.tagged(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert min(found[1], found[2]) > 0.5 > max(found[3], found[4])
    graded = [("%%% poor", 0)] * 500 + [(f"plain text {i}", 1) for i in range(20)] + [(f"good deed {i}", 2) for i in range(20)]
    model = quality.fit(*labelled(spark, graded, "grade"), 3, buckets=512, sample=41)
    texts = [(0, "%%% poor"), (1, "plain text 99"), (2, "good deed 99")]
    found = {r.doc_id: r.expected_grade for r in quality.graded(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert found[0] < 0.5 < found[1] < found[2]


def test_deduplicated_text_and_removed_spans(docs):
    rows = substring_dedup.deduplicated(docs, chunk_bytes=300, bucket_bytes=2_000).collect()
    texts = {i: [w.decode() for w in (t or "").encode().split()] for i, t in TEXTS}
    for r in rows:
        words, gone = texts[r.doc_id], [k for s in r.removed for k in range(s.start, s.end)]
        assert len(gone) == r.n_removed and r.kept_text == " ".join(w for k, w in enumerate(words) if k not in set(gone))
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    found = {r.doc_id: r for r in rows}
    assert found[3].kept_text == "" and [(s.start, s.end) for s in found[4].removed] == [(3, 43)]
    assert found[4].kept_text.startswith("other words before and after;")


def test_packed_pieces_hold_their_ids(docs):
    from tokenizers import Tokenizer

    ranks, special = queries.tokenizer_files()
    real = Tokenizer.from_file(special)
    pieces = defaultdict(list)
    for r in packing.pack(docs.where("doc_id <> 8"), ranks, special, size=64, open_windows=3).collect():
        pieces[r.doc_id].append(r)
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes())
    for i, text in TEXTS:
        if i not in (None, 8):
            whole = [x for r in sorted(pieces[i], key=lambda r: r.start) for x in r.ids]
            assert whole == real.encode(text or "", add_special_tokens=False).ids + [0]


def test_labels_are_joined_without_texts(spark):
    """No exchange below the sample holds a text, and the word counts shuffle each text once whatever the tables' sizes."""
    from fieldtally.llm import common

    docs, labels = labelled(spark, [(f"w{i % 7} x", i % 2) for i in range(40)] + [(None, 1)], "toxic")
    found = common.distinct_labelled(docs, labels, "toxic")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "text" not in plan[:join] and found.count() == 15
    rows = {(r.h1, r.h2): r for r in common.sampled_rows(found.where("toxic = 1"), 100)}
    texts = {(r.h1, r.h2): r.text for r in common.sampled_texts(docs, list(rows.values())).collect()}
    assert set(texts) == set(rows) and sorted(texts.values()) == ["", *(f"w{i} x" for i in range(7))]
    assert {r.weight for r in rows.values()} == {1, 2}


def test_unlike_words_are_never_taken_for_each_other(spark):
    """Two words that collide under any polynomial hash modulo 2^64: Thue-Morse order and its mirror."""
    bits = [k.bit_count() & 1 for k in range(4096)]
    words = passage(9, 12)
    rows = [(1, words + " " + "".join("ab"[b] for b in bits)), (2, words + " " + "".join("ba"[b] for b in bits))]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 0}


def test_many_findings_in_a_text(spark):
    """More findings than a block holds, overlapping ones too; places and redaction equal to Python's."""
    text = "".join(f"é{k} token: {'ab12' * 3}{k} {'0123456789abcdef' * 2}{k % 10} AKIA{'ABCD' * 3}{k} secret={'f0' * 20}\n" for k in range(900))
    df = spark.createDataFrame([(1, text, len(text)), (2, "x" + text, 0), (3, "secret: short", 13)], "doc_id long, text string, n_chars int")
    wanted = []
    for i, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                wanted.append((m.start(), i, m.end()))
    rows = {r.doc_id: r for r in secrets.secret_report(df).collect()}
    kinds = [r.kind for r in secrets.RULES]
    assert rows[1].spans == ",".join(f"{kinds[i]}:{a}:{b}" for a, i, b in sorted(wanted)) and len(wanted) > 3000
    out, at = [], 0
    for a, _, b in sorted(wanted):
        if a >= at:
            out.append(text[at:a] + "[secret]")
        at = max(at, b)
    clean = "".join(out) + text[at:]
    found = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(df).collect()}
    assert found == {1: (clean, len(clean)), 2: ("x" + clean, len(clean) + 1), 3: ("secret: short", 13)}


def test_ledger_grows_by_unseen_blobs(spark, docs):
    old = docs.where("doc_id < 5")
    ledger = secrets.scan_unseen(secrets.addressed(old))
    whole = sorted(map(str, secrets.secret_report(docs).collect()))
    assert sorted(map(str, secrets.secret_report(docs, ledger).collect())) == whole


AWKWARD_NAMES = "`a.b` string, `mark` string, score double, lang_pred string, address string, blob string, spans string, clean string, of_id int"


def test_stages_keep_columns_of_any_name_and_repeated_ids(spark):
    import corpus_pipeline

    shared, extra = passage(21, 60), ("p", "q", 1.5, "r", "s", "t", "u", "v", 9)
    texts = [(5, "first text " + passage(22, 50)), (5, "another one " + passage(23, 50)), (6, "first text " + passage(22, 50)), (7, None),
             (8, "12 34"), (9, shared + " token: abcdefgh123"), (9, shared + " token: abcdefgh123"), (10, passage(24, 70))]
    kind = "doc_id long, text string, lang string, n_chars int, " + AWKWARD_NAMES
    df = spark.createDataFrame([(i, t, "en", len(t or ""), *extra) for i, t in texts], kind)
    left = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF_DIR)
        assert left.columns == df.columns, name
    rows = sorted(left.collect(), key=lambda r: (r.doc_id, r.text))
    assert [(r.doc_id, r.text) for r in rows] == sorted([texts[0], texts[1], (9, shared + " [secret]"), texts[7]])
    assert all(tuple(r)[4:] == extra and r.n_chars == len(r.text) for r in rows)
    none = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).collect() == []


def test_windows_are_packed_by_least_squares():
    """Every placement is one of least sum of squared counts; real lengths stay far below the bound on open windows."""
    rng = np.random.default_rng(5)
    packer, counts = packing.SumOfSquares(64, 10_000), np.zeros(65, int)
    for n in rng.integers(1, 64, 600).tolist():
        costs = {}
        for level in range(0, 64 - n + 1):
            if level == 0 or counts[level]:
                after = counts.copy()
                after[level] -= level > 0
                after[level + n] += 1
                costs[level] = int((after[1:64] ** 2).sum())
        before = packer.counts.copy()
        packer.place(("d", 0, b"", n), n)
        change = packer.counts - before
        gone = np.flatnonzero(change[:64] < 0)
        level = int(gone[0]) if len(gone) else 0
        assert costs[level] == min(costs.values())
        counts[level] -= level > 0
        counts[level + n] += 1
        counts[64] = 0


def test_languages_equal_a_search_over_all_sets(spark):
    rng = np.random.default_rng(11)
    letters = ("abcdeo", "mnopqa", "tuvwxa")
    word = lambda k: "".join(rng.choice(list(letters[k]), rng.integers(3, 7)))
    speech = lambda k, n: " ".join(word(k) for _ in range(n))
    known = [(f"l{k}", speech(k, 400)) for k in range(3) for _ in range(4)] + [(None, "zz"), ("l0", None)]
    model = language_id.learn(spark.createDataFrame(known, "lang string, text string"))
    buckets, counts = 1 << 14, {f"l{k}": defaultdict(int) for k in range(3)}
    for lang, text in known:
        if lang and text:
            for b in language_id.trigrams(text, 3, buckets).tolist():
                counts[lang][b] += 1
    assert model.names == sorted(counts)
    log_p = [lambda b, own=own, whole=sum(own.values()) + 0.1 * buckets: np.log((own[b] + 0.1) / whole) for _, own in sorted(counts.items())]
    mixes = [(60, 0, 0), (0, 60, 0), (60, 30, 0), (0, 25, 75), (50, 30, 20), (1, 0, 0), (100, 2, 0), (0, 5, 3)]
    texts = [(i, " ".join(speech(k, n) for k, n in enumerate(mix) if n)) for i, mix in enumerate(mixes)] + [(90, None), (91, "12 !?")]
    found = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in texts[: len(mixes)]:
        grams = language_id.trigrams(text, 3, buckets).tolist()
        p = np.array([[np.exp(f(b)) for b in grams] for f in log_p])
        best = None
        for chosen in range(1, 8):
            own = [k for k in range(3) if chosen >> k & 1]
            share = np.full(len(own), 1 / len(own))
            for _ in range(300):
                parts = share[:, None] * p[own]
                share = (parts / parts.sum(0)).mean(1)
            value = np.log(share @ p[own]).sum() - 4.0 * np.log(len(grams) + 1) * (len(own) - 1)
            if best is None or value > best[0]:
                best = value, own[int(np.argmax(share))], share.max()
        assert (found[i].lang_pred, found[i].score) == (f"l{best[1]}", pytest.approx(best[2], abs=0.05)), i
    assert [(found[i].lang_pred, found[i].score) for i in (90, 91)] == [("und", 0.0)] * 2


def test_quality_grades_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    speech = lambda k: " ".join(f"{'abc'[k]}{x}" for x in rng.integers(0, 40, 30))
    rows = [(speech(i % 3), i % 3) for i in range(120)]
    docs, grades = labelled(spark, rows, "grade")
    model = quality.fit(docs, grades, 3, buckets=1024)
    texts = [(i, speech(i % 3)) for i in range(30)] + [(40, None), (41, ""), (42, "ab"), (42, "ab"), (43, "long " * 20000)]
    found = quality.graded(spark.createDataFrame(texts, "doc_id long, text string"), model, least=1).collect()
    assert len(found) == len(texts)
    for r, (_, text) in zip(sorted(found, key=lambda r: r.doc_id), texts):
        times = defaultdict(int)
        for b in quality.ngram_buckets(text or "", 3, 1024).tolist():
            times[b] += 1
        whole = sum(times.values())
        score = sum((n / whole) ** 0.5 * float(model.weights[b]) for b, n in times.items())
        tails = [1 / (1 + np.exp(cut - score)) for cut in model.thresholds]
        assert (r.expected_grade, r.tail_probability) == (pytest.approx(sum(tails), abs=1e-3), pytest.approx(tails[0], abs=1e-3))
        assert r.keep == (r.tail_probability >= 0.5)
    right = [r for r in found if r.doc_id < 30 and round(r.expected_grade) == r.doc_id % 3]
    assert len(right) >= 27
    share = np.bincount([g for _, g in rows]) / len(rows)
    tails = model.tails(np.stack([quality.vector(t, 1024) for t, _ in rows]))
    likely = -np.diff(np.concatenate([np.ones((len(rows), 1)), tails, np.zeros((len(rows), 1))], 1))
    assert np.log([likely[i, g] for i, (_, g) in enumerate(rows)]).mean() > np.log(share).mean() + 0.5

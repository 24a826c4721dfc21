"""Quality rules, conversation repair and periodic runs against plain Python, with awkward rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import conversation_repair, periodic_runs, quality_rules, queries

SF_DIR = "/root/testdata/sf0.001"


# periodic runs


def brute_runs(words, times=4, least=6):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, q, e - s) for (s, e), q in out.items())


def planted(r, n, letters):
    words = [str(r.randrange(letters)) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n > 9 else 0):
        p, s = r.randint(1, max(1, n // 4)), r.randrange(n)
        for i in range(s + p, min(n, s + r.randint(3 * p, 6 * p))):
            words[i] = words[i - p]
    return words


def brute_collapsed(words, runs):
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (4, "b b b b b"), (None, "x y x y x y x y"),
    (5, "é è é è é è é è é"), (6, "one\n" * 5 + "one"), (7, "           "),
]


def test_z_function():
    r = random.Random(5)
    for _ in range(200):
        x = [r.randrange(2) for _ in range(r.randint(1, 30))]
        lcp = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert periodic_runs.z_function(x)[1:] == lcp[1:]


def test_fragments_of_many_texts_at_once():
    r = random.Random(6)
    for _ in range(150):
        words = planted(r, r.randint(0, 500), r.choice([1, 2, 3, 60]))
        found = periodic_runs.fragments(np.array([int(w) for w in words], np.int64), 1, len(words) // 4)
        whole = {}
        for q, s, e in found.tolist():
            if e - s >= max(6, 4 * q):
                whole.setdefault((s, e), q)
        assert sorted((s, q, e - s) for (s, e), q in whole.items()) == brute_runs(words)


@pytest.mark.parametrize("block", [65_536, 128])
def test_runs_of_whole_and_of_dealt_texts(spark, block):
    """With small blocks the longer texts are cut, dealt and stitched."""
    r = random.Random(7)
    rows = AWKWARD + [(100 + i, " ".join(planted(r, r.randint(1, 900), r.choice([1, 2, 50])))) for i in range(60)]
    rows.append((300, " ".join(["w"] * 3000)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, `a.b` string, runs int")
    got = [
        (x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.kept)
        for x in periodic_runs.periodic_runs(df.repartition(3), block=block).collect()
    ]
    expected = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words)
        expected.append((i, len(words), runs, brute_collapsed(words, runs)))
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_runs_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(none).collect() == []


def test_query_of_runs_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF_DIR, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF_DIR).collect()}
    assert set(got) == set(docs)
    periodic = 0
    for i, text in docs.items():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        periodic += bool(runs)
        best = min(((-m, s, q) for s, q, m in runs), default=None)
        assert got[i].n_runs == len(runs)
        head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (got[i].start, got[i].length, got[i].period, got[i].exponent_milli) == head
        lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
        assert got[i].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        gone = {k for s, q, m in runs for k in range(s + q, s + m)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert got[i].collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert periodic > 5


# conversation repair

NEXT, KEEP = (2, 2, 3, 2), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTED = {2: "user", 3: "assistant"}


def brute_repair(rows):
    """Cheapest and then least audit by search over (cost, audit), rows in order as (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        new = (INSERTED[NEXT[state]] + ":",)
        heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[state], out + new))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] in ("blank", "duplicate"):
                continue
            more = 5 if faults[i] == "truncated" else 0
            if (state, role[:1]) in KEEP:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEP[state, role[:1]], out + (f"{role}:{text}",)))
            changed = f"{INSERTED[NEXT[state]]}:{text}"
            heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, NEXT[state], out + (changed,)))
    turns = [t for t, _, _ in rows if t is not None]
    legal = {"su", "ua", "au"}
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a[1][:1] + b[1][:1] not in legal or not a[1] or not b[1] for a, b in zip(rows, rows[1:])),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def in_order(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]

    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


def test_least_audits_of_codes():
    r, steps = random.Random(1), conversation_repair.Steps()
    codes = [bytes(r.choice([0, 0, 1, 1, 1, 2, 2, 2, 3, 4, 5, 9, 10, 12, 13, 14]) for _ in range(r.randint(0, 12))) for _ in range(800)]
    whole = conversation_repair.audits(codes, steps)
    assert conversation_repair.audits(codes, conversation_repair.Steps(), block=3, beside=50) == whole
    for code, (cost, audit) in zip(codes, whole):
        names, seen = {0: "s", 1: "u", 2: "a", 3: "tool"}, []
        for k, c in enumerate(code):
            text = {0: f"t{k}.", 4: "", 8: "again.", 12: f"t{k}"}[c & 12]
            seen.append((k, names[c & 3], text))
        if any(c & 12 == 8 for c in code):
            continue  # a first copy would have to stand before it
        found = brute_repair(seen)
        assert (found[5], found[6].encode()) == (cost, audit)


def conversations(spark, rows):
    kind = "conv_id long, turn long, role string, text string, copies int, `a.b` string, audit string"
    return spark.createDataFrame([(*r, "x", "clash") for r in rows], kind)


def test_repair_equals_search(spark):
    r, rows = random.Random(2), []
    for conv in [None, *range(150)]:
        for k in range(r.randint(1, 9)):
            turn = r.choice([k, k, k, k + 3, None, 1])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            text = r.choice([f"t{k}.", f"t{k}?", "same.", "same.", "cut", "", " \t", None, "é!\n"])
            rows.append((conv, turn, role, text, r.choice([1, 1, 1, 1, 2, 0])))
    rows += [(500, 1, "user", "gone.", 0), (501, None, "user", "only nulls.", 1)]
    rows += [(502, k, "assistant" if k % 2 else "user", f"long {k}.", 1) for k in range(3000)]
    df = conversations(spark, rows).repartition(5)
    got = {x.conv_id: tuple(x)[1:] for x in conversation_repair.repair_report(df, F.col("copies")).collect()}
    by = {}
    for conv, turn, role, text, n in rows:
        by.setdefault(conv, []).extend([(turn, role, text)] * n)
    assert got == {conv: brute_repair(in_order(some)) for conv, some in by.items()}
    messages = conversation_repair.repaired(df, F.col("copies")).collect()
    for conv in (3, 502, None):
        mine = sorted((m.place, f"{m.role}:{m.text}") for m in messages if m.conv_id == conv)
        assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == got[conv][-1]
    assert not [m for m in messages if m.conv_id == 500] and got[500] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_no_rows(spark):
    none = conversations(spark, [])
    assert conversation_repair.repair_report(none).collect() == []
    assert conversation_repair.repaired(none).collect() == []


def test_query_of_repairs_equals_search(spark):
    by = {}
    for row in queries.table(spark, SF_DIR, "conversations").collect():
        turn, role, text = row.turn, " " if row.role is None else row.role, " " if row.text is None else row.text
        key = f"{' ' if row.conv_id is None else row.conv_id}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(harm, text)
        role = "user" if harm == 4 else role
        by.setdefault(row.conv_id, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1))
    got = {x.conv_id: tuple(x)[1:] for x in queries.op12_conversation_repair(spark, SF_DIR).collect()}
    assert got == {conv: brute_repair(in_order(rows)) for conv, rows in by.items()}


# quality rules


def brute_statistics(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def brute_distances(rows, share=0.75, steps=6):
    """Squared distance of each vector in the concentrated estimate of all of them."""
    y = np.array(rows, np.int64)
    floor = np.diag([(f * 1024) ** 2 for f in quality_rules.FLOORS])
    freedom = y.shape[1]
    q = quality_rules.chi_squared(share, freedom)
    factor = share / quality_rules._gamma_share((freedom + 2) / 2, q / 2)

    def distance(centre, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov), (y - centre).T)
        return (z**2).sum(0)

    def moments(some, by):
        return some.mean(0), np.cov(some.T, bias=True).reshape(freedom, freedom) * by + floor

    low = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    middle = low(y)
    best = None
    for centre, cov in ((middle, np.diag((1.4826 * low(np.abs(y - middle))) ** 2) + floor), moments(y, 1.0)):
        for _ in range(steps):
            step = np.floor(64 * np.log(1 + distance(centre, cov)))
            chosen = step <= np.sort(step)[math.ceil(len(y) * share) - 1]
            centre, cov = moments(y[chosen], factor)
        size = np.linalg.slogdet(cov)[1]
        if best is None or size < best[0] - 1e-9:
            best = (size, centre, cov)
    return distance(*best[1:])


def brute_vector(n, chars, symbols, lines, again):
    parts = math.log(math.log(n)), math.log(chars / n), math.log(1 + 100 * symbols / chars), math.log(1 + lines), math.log(1 + 10 * again / n)
    return [round(1024 * p) for p in parts]


def brute_rules(rows, least=50):
    stats = [brute_statistics(t) for _, t, _, _ in rows]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    sizes = Counter((lang, source) for (_, _, lang, source), f in zip(rows, failed) if not f)
    cells = [(lang, source) if sizes[lang, source] >= least else "pooled" for _, _, lang, source in rows]
    out = [None] * len(rows)
    for cell in set(cells):
        mine = [i for i, c in enumerate(cells) if c == cell and not failed[i]]
        if len(mine) >= least:
            for i, d in zip(mine, brute_distances([brute_vector(*stats[i]) for i in mine])):
                out[i] = d
    cut = quality_rules.chi_squared(1 - 1e-6, 5)
    kept = [not f and (d is None or d <= cut) for f, d in zip(failed, out)]
    return sorted(((row[0], *s, f, k) for row, s, f, k in zip(rows, stats, failed, kept)), key=str), out


def text_of(r, n, junk=False):
    words = [r.choice("abcdefgh") * r.randint(1, 9) + r.choice("ijklmnop") * r.randint(0, 3) for _ in range(n)]
    if junk:
        words = [w + r.choice(["###", "&&&", "$$$"]) for w in words]
    return "".join(w + r.choice([" ", " ", " ", "\n", ". "]) for w in words)


def test_rules_equal_plain_python(spark):
    r = random.Random(4)
    rows = [(i, text_of(r, r.randint(51, 400), i % 17 == 0), r.choice(["en", "de"]), "web") for i in range(300)]
    rows += [(1000 + i, text_of(r, r.randint(51, 90), i == 3), None, f"rare{i % 9}") for i in range(80)]
    rows += [(2000 + k, t, "en", None) for k, t in enumerate([None, "", "a b", "x y z " * 40, "same\n" * 30, "é " * 60, " \t\n"])]
    rows += [rows[0], rows[0], (None, text_of(r, 70), "en", "web"), (3000, text_of(r, 20_000), "en", "web")]
    df = spark.createDataFrame([(*x, "z", 1.0) for x in rows], "doc_id long, text string, lang string, source string, `a.b` string, y0 double")
    found = quality_rules.quality_rules(df.repartition(3)).collect()
    expected, distances = brute_rules(rows)
    assert sorted((tuple(x)[:8] for x in found), key=str) == expected
    by = {x.doc_id: x.distance for x in found}
    for row, d in zip(rows, distances):
        assert (by[row[0]] is None) == (d is None) and (d is None or abs(by[row[0]] - d) < 1e-5 * (1 + d))
    assert not any(x.kept for x in found if x.doc_id in (0, 17, 34, 1003)) and by[3000] is not None
    assert sum(not x.kept for x in found if x.doc_id is not None and x.doc_id < 1000 and x.doc_id % 17) == 0


def test_rules_without_enough_texts(spark):
    df = spark.createDataFrame([(1, "w x " * 30, "en", "a"), (2, text_of(random.Random(1), 60), "en", "a")], "doc_id long, text string, lang string, source string")
    assert {x.doc_id: (x.kept, x.distance) for x in quality_rules.quality_rules(df).collect()} == {1: (False, None), 2: (True, None)}
    assert quality_rules.quality_rules(df.limit(0)).collect() == []


def test_chi_squared_quantiles():
    assert abs(quality_rules.chi_squared(0.95, 5) - 11.0705) < 1e-3 and abs(quality_rules.chi_squared(0.75, 5) - 6.6257) < 1e-3


def test_rules_use_no_python_workers(spark):
    plan = quality_rules.statistics(queries.table(spark, SF_DIR, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

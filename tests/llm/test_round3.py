"""Vector codes, repeated passages and spelling variants against brute force, and their edge cases; operators side by side."""

import hashlib
import os
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import clashing
from test_operators import EDGE, docs_of

import __spark_entry__
from latentspark.llm import common, packing, queries, secret_scan, sharding, spelling_variants, substring_dedup, vector_codes

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<double>, label int"


# ---- 11: vector codes ------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows of (id, vector, label), all usable and of one length: {row: (code, error, label error, hash)} on Python's whole numbers."""
    d = len(rows[0][1])
    v = [[int(np.floor(1024 * x)) for x in r[1]] for r in rows]
    cut = [d * k // parts for k in range(parts + 1)]
    seeds = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))[:entries]
    part = [[x[cut[k] : cut[k + 1]] for x in v] for k in range(parts)]
    books = [[list(part[k][i]) for i in seeds] for k in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            of = defaultdict(list)
            for x in part[k]:
                of[near(x, books[k])[1]].append(x)
            for j, xs in of.items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = [[near(x, books[k]) for x in part[k]] for k in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(last[k][i][0] for k in range(parts)) for i in range(len(rows))]
    total = Counter()
    for r, e in zip(rows, error, strict=True):
        total[r[2]] += e
    return [(r[0], "".join(f"{last[k][i][1]:02x}" for k in range(parts)), error[i], total[r[2]], digest) for i, r in enumerate(rows)]


def codes_of(spark, rows):
    got = vector_codes.compress(spark, clashing(spark.createDataFrame(rows, VECTORS))).collect()
    return Counter(tuple(r) for r in got)


@pytest.mark.parametrize("seed,size", [(1, 8), (2, 12), (3, 10)])
def test_codes_equal_brute_force(spark, seed, size):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-3, 4, size) / 2 + rng.normal(0, 0.2, size)).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(400)]
    rows += [rows[0]] * 150 + [(7, rows[3][1], 1), (None, rows[4][1], None)]  # a hot vector, a repeated and a null id
    assert codes_of(spark, rows) == Counter(brute_codes(rows))


def test_codes_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [1.0, nan, 0.0, 0.0], 1), (3, [inf, 0.0, 0.0, 0.0], 1), (4, [None, 0.0, 0.0, 0.0], 1), (5, [1.0], 1), (6, [], 1)]
    good = [(10 + i, [float(i), -0.3, 0.0, 2.5], 1) for i in range(4)]
    assert codes_of(spark, bad + good) == Counter(brute_codes(good))
    assert codes_of(spark, bad[:4]) == Counter()
    short = [(i, [float(i)], None) for i in range(3)]  # shorter than the number of parts
    assert codes_of(spark, short) == Counter(brute_codes(short))
    huge = codes_of(spark, [(1, [1e300, -1e300, 0.0, 0.0], 1), (2, [0.0] * 4, 1), (3, [5.0] * 4, 1)])
    assert len(huge) == 3


def test_nearest_entries_are_exact_on_large_numbers():
    rng = np.random.default_rng(5)
    x, e = rng.integers(-(1 << 25), 1 << 25, (200, 16)), rng.integers(-(1 << 25), 1 << 25, (50, 16))
    at, d = vector_codes.nearest(x, e)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in enumerate(e)) for p in x]
    assert [(int(b), int(a)) for a, b in zip(at, d, strict=True)] == want


def test_residents_stay_where_they_are(spark):
    """Owners' sums need no exchange, and only parts that change entry pass one."""
    home = vector_codes.Residents(spark, 4)
    rows = spark.range(500).select(F.col("id").alias("row"), F.array(*(F.hash("id", F.lit(k)) % 100 for k in range(4))).cast("array<long>").alias("v"))
    books = [np.arange(-50, 50, 10).reshape(-1, 1)] * 4
    try:
        with common.passing(spark):
            members = home.settle(vector_codes.placed(rows, books, [0, 1, 2, 3, 4]).withColumn("salt", F.lit(0)).repartition(4, *home.KEYS))
            plan = vector_codes.owners_sums(members, [0, 1, 2, 3, 4])._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
            home.leave()
    finally:
        home.leave()


# ---- 12: repeated passages ---------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    words = [SPACE.findall(t or "") for _, t in rows]
    order = [(i is None, i or 0) for i, _ in rows]
    first = {}
    for o, w in zip(order, words, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (o, s)), (o, s))
    out = []
    for (i, _), o, w in zip(rows, order, words, strict=True):
        gone = {j for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (o, s) for j in range(s, s + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "FLUSH", 150)
    monkeypatch.setattr(substring_dedup, "PER_GROUP", 100)
    rng = random.Random(seed)
    words = ["a", "b", "é", "ccc"] if seed % 2 else [f"w{i}" for i in range(60)] + ["日本"]
    passages = [rng.choices(words, k=rng.randrange(4, 30)) for _ in range(8)]
    rows = []
    for i in range(80):
        w = [x for _ in range(rng.randrange(0, 6)) for x in (rng.choice(passages) if rng.random() < 0.6 else rng.choices(words, k=rng.randrange(0, 9)))]
        rows.append((rng.randrange(60) if seed > 2 else i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(None, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), rows[7], rows[7]]
    window = rng.choice([3, 4, 5])
    got = substring_dedup.remove_repeats(spark, clashing(docs_of(spark, rows).repartition(3)), window, with_text=True).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_repeats(rows, window))


def test_repeats_of_edge_rows(spark):
    got = substring_dedup.remove_repeats(spark, clashing(docs_of(spark, EDGE)), 20, with_text=True).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_repeats(EDGE, 20))
    assert substring_dedup.remove_repeats(spark, docs_of(spark, [])).count() == 0


def test_large_inputs_carry_more_bytes_of_a_window(spark, monkeypatch):
    assert substring_dedup.extra_bytes(1e8) == 0 < substring_dedup.extra_bytes(1e10) < substring_dedup.extra_bytes(1e13)
    monkeypatch.setattr(substring_dedup, "extra_bytes", lambda n: 3)
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices("abcd", k=40))
    rows = [(i, text()) for i in range(40)] + [(100, None)]
    got = substring_dedup.remove_repeats(spark, docs_of(spark, rows), 4, with_text=True).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_repeats(rows, 4))


def test_rolling_hashes_are_polynomials():
    h = np.random.default_rng(1).integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    p, base = substring_dedup.PRIME, substring_dedup.BASES[1]
    for size in (1, 2, 3, 7, 16, 20, 31):
        want = [sum(int(x) * pow(base, size - 1 - j, p) for j, x in enumerate(h[i : i + size])) % p for i in range(61 - size)]
        assert substring_dedup.rolling(h, size, base).tolist() == want
    assert len(substring_dedup.rolling(h[:3], 4, base)) == 0


# ---- 13: spelling variants -----------------------------------------------------------------------------------------------------


def brute_variants(rows, least=5, factor=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [u for u in n if near(w, u)] for w in n}
    best = {w: min(us, key=lambda u: (-n[u], u)) for w, us in by.items() if us}
    form = {w: u for w, u in best.items() if n[u] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(by[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("seed,per_range", [(1, 100_000), (2, 40), (3, 7), (4, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, per_range):
    monkeypatch.setattr(spelling_variants, "PER_RANGE", per_range)
    monkeypatch.setattr(spelling_variants, "HELD", 50)
    rng = random.Random(seed)
    letters = "abÀ" if seed % 2 else "abcdeÿ"
    words = ["".join(rng.choices(letters, k=rng.randrange(5, 9))) for _ in range(60)]
    for w in words[:40]:
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters).upper() + w[k + 1 :], w + w[-1]]
    words += ["x" * 300, "x" * 299, "y" + "x" * 299]
    weights = [rng.choice([1, 1, 2, 6, 40, 250]) for _ in words]
    rows = [(i if i % 9 else None, rng.choice([" ", "1", ", ", "日"]).join(rng.choices(words, weights, k=120))) for i in range(150)]
    rows += [(1, "same words" * 30)] * 2 + [(2, " ".join(["x" * 300, "x" * 299, "y" + "x" * 299] * 6))]
    rows.append((3, " ".join(["qrstuvw"] * 150 + ["qrstuvx"] * 30 + ["qrstuxx"] * 6)))  # a chain of forms
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.group_variants(spark, clashing(docs_of(spark, rows).repartition(3))).collect()}
    want = brute_variants(rows)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(want[v[0]][0] for v in want.values() if v[0])


def test_variants_of_edge_rows(spark):
    got = spelling_variants.group_variants(spark, clashing(docs_of(spark, EDGE + EDGE))).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(EDGE + EDGE)
    assert spelling_variants.group_variants(spark, docs_of(spark, [])).count() == 0
    assert spelling_variants.group_variants(spark, docs_of(spark, [(1, "few words here")])).count() == 0


def test_a_long_word_takes_linear_work():
    big = "ab" * 100_000
    got = list(spelling_variants.nodes_of([big, big + "c"], spelling_variants.Border("", np.zeros(0, np.int64)), spelling_variants.Border("", np.zeros(0, np.int64)), 0))
    assert [m for m, _ in got] == [len(big)] * 2 and (got[0][1] == got[1][1]).all()


# ---- SQL, and operators side by side -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    at, db = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(at):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}/{f}'")
    got, want = queries.queries()[name](spark, at), db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.select(", ".join(columns)).fetchall())
    assert __spark_entry__.oracle_sql()[name] == queries.oracle_sql()[name]


def test_operators_run_side_by_side(spark, tmp_path):
    """Four operators in four threads give what they give alone, leave one result each, and the settings as they were."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(50)], k=60))) for i in range(60)]
    docs = docs_of(spark, rows)
    jobs = {
        "packing": lambda: packing.pack_documents(spark, docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32"),
        "sharding": lambda: sharding.shard_documents(docs, sharding.Tree.even(5)).select("doc_id", "shard"),
        "repeats": lambda: substring_dedup.remove_repeats(spark, docs, 4),
        "secrets": lambda: secret_scan.scan_digest(docs),
    }
    alone = {k: Counter(map(tuple, f().collect())) for k, f in jobs.items()}
    names, folder = list(common.BATCHES), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, there, got = [spark.conf.get(k) for k in names], set(os.listdir(folder)), {}

    def run(k):
        try:
            got[k] = Counter(map(tuple, jobs[k]().collect()))
        except Exception as e:  # noqa: BLE001
            got[k] = e

    threads = [threading.Thread(target=run, args=(k,)) for k in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == alone
    assert [spark.conf.get(k) for k in names] == before
    assert len(set(os.listdir(folder)) - there) == len(jobs)


def test_warc_query_leaves_no_archives(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(folder))
    queries.op2_warc(spark, "/root/testdata/sf0.001").count()
    left = set(os.listdir(folder)) - there
    assert len(left) == 1 and not any(f.endswith(".zst") for _, _, fs in os.walk(f"{folder}/{left.pop()}") for f in fs)

"""Regressions by key, nulls by bin and distances against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from latentspark.functions.seeds import hash_number
from latentspark.operators import distances, perievent


def plain_regression(x, y, clusters=None):
    x = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    s = x * (y - x @ b)[:, None]
    n, k = x.shape
    if clusters is None:
        scale = n / (n - k)
    else:
        names = sorted(set(clusters))
        s = np.stack([s[[c == name for c in clusters]].sum(0) for name in names])
        scale = len(names) / (len(names) - 1) * (n - 1) / (n - k)
    return b, np.sqrt(np.diag(inv @ s.T @ s @ inv) * scale)


def test_robust_regressions_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(c), *(float(v) for v in rng.normal(0, 1, 2)), float(rng.normal(0, 1 + c % 3))) for s in ("a", "b") for c in range(8) for _ in range(6)]
    rows += [("a", 1, None, 1.0, 1.0), ("a", 1, 1.0, 1.0, None), ("flat", 1, 1.0, 2.0, 3.0), ("flat", 2, 1.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "session string, event int, u double, v double, y double")
    for cluster in (None, ["event"]):
        got = {(r.session, r.term): r for r in perievent.robust_regression(df, "y", ["u", "v"], ["session"], cluster).collect()}
        for s in ("a", "b"):
            own = [r for r in rows if r[0] == s and None not in r]
            b, se = plain_regression(np.array([r[2:4] for r in own]), np.array([r[4] for r in own]), [r[1] for r in own] if cluster else None)
            for k, term in enumerate(("intercept", "u", "v")):
                r = got[s, term]
                assert np.allclose((r.coef, r.se, r.z), (b[k], se[k], b[k] / se[k])) and r.n == len(own)
                assert np.isclose(r.low, b[k] - 1.959963984540054 * se[k]) and np.isclose(r.high, b[k] + 1.959963984540054 * se[k])
        assert got["flat", "u"].coef is None and got["flat", "u"].se is None
    own = [r for r in rows if r[0] in "ab" and None not in r]
    b, se = plain_regression(np.array([r[2:4] for r in own]), np.array([r[4] for r in own]), [(r[0], r[1]) for r in own])
    got = {r.term: r for r in perievent.robust_regression(df.where("session != 'flat'"), "y", ["u", "v"], [], ["session", "event"]).collect()}
    assert np.allclose([got[t].se for t in ("intercept", "u", "v")], se) and np.allclose([got[t].coef for t in ("intercept", "u", "v")], b)


def test_nulls_by_bin_equal_permuted_labels(spark, monkeypatch):
    monkeypatch.setattr(distances, "PAIRS", 7)
    rng = np.random.default_rng(2)
    places, n = [], {"a": 9, "b": 6}
    for s, k in n.items():
        places += [(s, i + 1, float(rng.integers(0, 5)), rng.normal(0, 1, 3).tolist()) for i in range(k)]
    p = spark.createDataFrame(places, "series string, i int, label double, x array<double>")
    d = {(s, i, j): float(np.linalg.norm(np.array(x) - np.array(y))) for s, i, _, x in places for t, j, _, y in places if s == t and i < j}
    pairs = spark.createDataFrame([(*k, v) for k, v in d.items()], "series string, i int, j int, d double")
    shuffles, edges = 12, [0, 1, 3, 100]
    drawn = p.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(shuffles)))).withColumn("h", hash_number(F.col("shuffle").cast("string"), "series", F.col("i").cast("string"))).collect()
    labels = {(s, 0): [r[2] for r in places if r[0] == s] for s in n}
    for s in n:
        for k in range(1, shuffles + 1):
            labels[s, k] = [r.label for r in sorted((r for r in drawn if r.series == s and r.shuffle == k), key=lambda r: (r.h, r.i))]
    mean = {}
    for (s, k), l in labels.items():
        for b in range(3):
            v = [x for (t, i, j), x in d.items() if t == s and edges[b] <= abs(l[i - 1] - l[j - 1]) < edges[b + 1]]
            if v:
                mean[s, k, b] = (len(v), np.mean(v))
    got = distances.distance_label_bin_null(pairs, p, edges, shuffles, ["series"]).collect()
    assert {(r.series, r.bin) for r in got} == {(s, b) for s, k, b in mean if k == 0}
    for r in got:
        null = [mean[r.series, k, r.bin][1] for k in range(1, shuffles + 1) if (r.series, k, r.bin) in mean]
        assert r.n == mean[r.series, 0, r.bin][0] and np.allclose((r.mean, r.null_mean, r.low, r.high), (mean[r.series, 0, r.bin][1], np.mean(null), *np.quantile(null, [0.025, 0.975])))
    plan = distances.shuffled_sums(pairs, p, shuffles, ["series"]).count()
    assert plan == sum(1 for s, k in labels)


def test_cumulative_distances(spark):
    rng = np.random.default_rng(3)
    a, b, w = rng.random((5, 7)), rng.random((5, 7)), rng.random(7)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(5)], "i int, a array<double>, b array<double>")
    for norm in (False, True):
        got = {r.i: r.w for r in df.select("i", distances.wasserstein1(F.col("a"), F.col("b"), w.tolist(), norm).alias("w")).collect()}
        for i in range(5):
            x, y = (v / v.sum() if norm else v for v in (a[i], b[i]))
            assert np.isclose(got[i], (np.abs(np.cumsum(x - y)) * w).sum())

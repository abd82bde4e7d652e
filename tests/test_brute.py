"""Queries that SQL cannot express, and forms of operators, against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__
from latentspark.operators import behaviour, decode, distances, fit, intervals, kernels, latents, nulls, perievent, selection, signals, transitions
from latentspark.plans import binding, queries_decode, queries_more, queries_stats

SF = "/root/testdata/sf0.001"
Q = __spark_entry__.queries()
KEYS = ["session"]


def dense(spark):
    """Counts (session, bin, unit) of the hourly table, and the units."""
    rows = binding.hourly_counts(spark, SF).collect()
    units = sorted({r.unit for r in rows})
    out = defaultdict(lambda: np.zeros((720, len(units))))
    for r in rows:
        out[r.session][r.bin, units.index(r.unit)] = r.n
    return dict(out), units


def plain_filter(y, rates, kernel):
    """Causal and smooth probabilities and step of a model with one kernel, by the textbook recursions on whole probabilities."""
    like = np.array([[math.exp(sum(n * math.log(m + 1e-20) - m - 1e-20 - math.lgamma(n + 1) for n, m in zip(row, rate, strict=True))) for rate in rates] for row in y])
    now, causal, step = np.full(len(rates), 1 / len(rates)), [], []
    for x in like:
        now = now @ kernel * x
        step.append(math.log(now.sum()))
        now = now / now.sum()
        causal.append(now)
    beta, smooth = np.ones(len(rates)), [None] * len(y)
    for t in range(len(y) - 1, -1, -1):
        p = causal[t] * beta
        smooth[t] = p / p.sum()
        beta = kernel @ (like[t] * beta)
        beta /= beta.sum()
    return np.array(smooth), np.array(step)


def test_clean_transition_decode_equals_its_steps_made_plainly(spark):
    ys, units = dense(spark)
    tuning = np.array([np.mean([y[b] for y in ys.values() for b in range(720) if b % 24 // 4 == l], axis=0) for l in range(6)])
    a, b = np.zeros((6, len(units))), np.zeros(6)
    for y in ys.values():
        ll = np.array([[sum(n * math.log(m + 1e-20) - m - math.lgamma(n + 1) for n, m in zip(row, rate, strict=True)) for rate in tuning] for row in y])
        p = np.exp(ll - ll.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        a, b = a + p.T @ y, b + p.sum(0)
    rates = a / (b[:, None] + 1e-12)
    total = rates.sum(1)
    d = np.abs(np.subtract.outer(total, total))
    seen = np.zeros((6, 6))
    for r in decode.posterior_transitions(binding.day_counts(spark, SF), queries_decode._model(spark, SF), ["session", "event"]).collect():
        seen[r.i, r.j] = r.conditional
    soft = lambda beta: np.exp(-beta * d) / np.exp(-beta * d).sum(1, keepdims=True)
    beta = min([0.0, 1.0, 2.0, 4.0], key=lambda x: -(seen * np.log(soft(x))).sum())
    got = defaultdict(dict)
    for r in Q["h10_clean_transition_decode"](spark, SF).collect():
        got[r.session][r.bin] = (r.p_latent, r.step)
    for s, y in ys.items():
        smooth, step = plain_filter(y, rates, soft(beta))
        assert np.allclose([got[s][t][0] for t in range(720)], smooth, atol=1e-6) and np.allclose([got[s][t][1] for t in range(720)], step, atol=1e-6)


def test_iterative_refit_equals_plain_rounds(spark):
    ys, units = dense(spark)
    rates = np.array([np.mean([y[b] for y in ys.values() for b in range(720) if b % 24 // 4 == l], axis=0) for l in range(6)])
    d = np.subtract.outer(np.arange(6), np.arange(6))
    norm = lambda k: k / k.sum(1, keepdims=True)
    smooth, move = norm(np.exp(-0.5 * d**2.0)), norm(np.exp(-(d**2.0)))
    for _ in range(8):
        a, b = np.zeros((6, len(units))), np.zeros(6)
        for y in ys.values():
            p, _ = plain_filter(y, rates, move)
            a, b = a + p.T @ y, b + p.sum(0)
        rates = (smooth @ a) / (smooth @ b)[:, None]
    got = np.zeros_like(rates)
    for r in Q["g8_iterative_label_refit"](spark, SF).collect():
        got[r.latent, units.index(r.unit)] = r.rate
    assert np.allclose(got, rates, atol=1e-5)


def test_model_selection_ranks_by_its_own_marginals(spark):
    rows = Q["g10_model_selection"](spark, SF).collect()
    assert len(rows) == 8 and len({r.config for r in rows}) == 4
    mean = {c: np.mean([r.downsampled for r in rows if r.config == c]) for c in range(4)}
    assert {r.config for r in rows if r.best} == {max(mean, key=lambda c: (mean[c], -c))}
    assert all(r.test_marginal > r.downsampled - 1e-9 or r.downsampled < 0 for r in rows)


def test_kmeans_equals_nearest_of_its_own_centres(spark):
    table = queries_stats._table(spark, SF)
    got = perievent.cluster_kmeans(table, KEYS, 2).collect()
    rows = defaultdict(dict)
    for r in table.collect():
        rows[r.session, r.event_bin][r.rel] = r.y
    x = {k: np.array([v[i] for i in sorted(v)]) for k, v in rows.items()}
    label = {(r.session, r.event_bin): r.cluster for r in got}
    assert set(label) == set(x)
    centres = np.array([np.mean([x[k] for k in x if label[k] == c], axis=0) for c in (0, 1)])
    assert all(np.linalg.norm(centres - x[k], axis=1).argmin() == label[k] for k in x)
    means = perievent.cluster_means(table, perievent.cluster_kmeans(table, KEYS, 2), KEYS).collect()
    assert np.allclose([r.mean for r in sorted(means, key=lambda r: (r.cluster, r.rel))], centres.reshape(-1))


def test_logit_equals_the_library(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.1]
    y = (x[:, 0] + rng.normal(size=300) * 0.5 > 0).astype(int) + (x[:, 1] > 4)
    score, w = selection.multinomial_l1(x, y, 3, 0.02, 5000)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x.tolist(), y, strict=True)], ["label", "features"])
    model = LogisticRegression(regParam=0.02, elasticNetParam=1.0, family="multinomial", maxIter=500, tol=1e-10).fit(df)
    mine = w[:-1].T / x.std(0, ddof=1)
    theirs = model.coefficientMatrix.toArray()
    assert np.allclose(mine, theirs, atol=2e-2 * np.abs(theirs).max())
    assert abs(float((score.argmax(1) == y).mean()) - model.summary.accuracy) < 0.01


def test_logit_finds_what_a_label_follows(spark):
    rng = np.random.default_rng(1)
    rows = [(s, t, int(v > 0), float(v), float(rng.normal())) for s in ("a", "b") for t, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "session string, event_bin long, label int, x double, noise double")
    got = {r.session: r for r in selection.logit_test(selection.label_logit(df, "label", ["x", "noise"], 20, keys=KEYS), KEYS).collect()}
    assert all(r.observed > 0.95 and r.significant for r in got.values())
    none = selection.logit_test(selection.label_logit(df, "label", ["noise"], 20, keys=KEYS), KEYS).collect()
    assert all(r.observed < 0.75 for r in none)


def test_pca_start_equals_numpy(spark):
    ys, units = dense(spark)
    sessions = sorted(ys)
    x = np.sqrt(np.concatenate([ys[s] for s in sessions]))
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2]
    score = x @ v.T
    z = (score - score.mean(0)) / score.std(0)
    rows = defaultdict(dict)
    for r in Q["g7_init_pca"](spark, SF).collect():
        rows[r.session, r.bin][r.latent] = r.p
    got = np.array([[rows[s, b][k] for k in range(5)] for s in sessions for b in range(720)])
    logs = np.log(got) - np.log(got).mean(1, keepdims=True)
    # components are free in sign: each difference of two logs is a sum of signed scores
    best = min(np.abs(logs - (z * s - (z * s).mean(1, keepdims=True))).max() for s in np.array(np.meshgrid(*[[-1, 1]] * 5)).T.reshape(-1, 5))
    assert best < 1e-6


def test_em_equals_plain_rounds_and_saves_its_iterations(spark):
    rng = np.random.default_rng(5)
    y = rng.poisson(2.0, (60, 4)).astype(float)
    c = spark.createDataFrame([("s", t, f"u{u}", int(y[t, u])) for t in range(60) for u in range(4)], "session string, bin long, unit string, n long")
    start = fit.init_random(c.select("session", "bin").distinct(), KEYS, 3)
    p = np.zeros((60, 3))
    for r in start.collect():
        p[r.bin, r.latent] = r.p
    basis, one = fit.tuning_basis(fit.rbf(3, 1.0)), np.ones((1, 1))
    k = kernels.as_arrays(kernels.move_kernel(spark, 3, 1.0), 3)
    saved = []
    tuning, history = fit.fit_em(spark, c, start, k, one, basis, KEYS, 2, noise=0.5, save_every=1, kept=saved)
    for _ in range(2):
        rates = np.maximum(fit.gaussian_m_step(basis, p.T @ y, p.sum(0), 0.5, 1.0), 0)
        p, step = plain_filter(y, rates, k[0])
    got = {(r.latent, r.unit): r.rate for r in tuning.collect()}
    assert all(abs(got[l, f"u{u}"] - rates[l, u]) < 1e-8 for l in range(3) for u in range(4))
    assert abs(history[-1] - step.sum()) < 1e-6 and [n for n, _ in saved] == [1, 2]


def test_roughness_makes_tuning_smoother():
    a, b = np.array([10.0, 0, 12, 0, 11, 0, 9]), np.full(7, 10.0)
    basis = np.column_stack([np.ones(7), np.eye(7)])
    bent = [np.abs(np.diff(basis @ fit.poisson_unit(basis, a, b, 1e3, rough=r), 2)).sum() for r in (0.0, 10.0)]
    assert bent[1] < 0.2 * bent[0]


def test_basis_of_a_grid():
    one, two = fit.rbf(4, 1.0), fit.rbf(3, 2.0)
    b = fit.tuning_basis_nd([one, two])
    parts = [fit.tuning_basis(k, bias=False) for k in (one, two)]
    assert b.shape == (12, 1 + parts[0].shape[1] * parts[1].shape[1]) and np.allclose(b[:, 1], np.outer(parts[0][:, 0], parts[1][:, 0]).reshape(-1))


def test_density_clusters_equal_a_plain_search(spark):
    rows = [r.asDict() for r in queries_stats._map(spark, SF).collect()]
    got = {(r.session, r.bin): r.cluster for r in Q["k5_dbscan_per_latent"](spark, SF).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r["session"], r["latent"]].append((r["bin"], r["speed"], r["away"]))
    for (session, _), points in groups.items():
        x = np.array([p[1:] for p in points])
        near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 5.0
        core = near.sum(1) >= 5
        cluster = [got[session, p[0]] for p in points]
        for i in range(len(points)):
            assert (cluster[i] == -1) == (not core[i] and not (near[i] & core).any())
            for j in np.flatnonzero(near[i] & core):
                if core[i]:
                    assert cluster[i] == cluster[j]


def test_unknown_metric_is_an_error(spark):
    with pytest.raises(ValueError):
        signals.vector_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0)), "chebyshev")


def test_supervised_job_agrees_with_its_parts(spark):
    e = binding.events(spark, SF)
    from latentspark.plans import workflows

    got = workflows.replay_supervised(e.select("session", "unit", "t"), e.select("session", "t", F.col("k").alias("label")), binding.whole_span(spark, SF), KEYS, tuning_dt=3600.0, low=0.0, size=10.0, bins=10, std=10.0, burst_dt=1800.0, burst_std=2.0, z_peak=1.5, shortest=3600.0, longest=36000.0, event_dt=1800.0, n_shuffles=10, gains=[1.0, 2.0])
    windows, tests, metrics, whole = (got[k].collect() for k in ("windows", "tests", "metrics", "events"))
    key = lambda r: (r.session, r.interval_id)
    assert {key(r) for r in windows} == {key(r) for r in tests} == {key(r) for r in metrics} == {key(r) for r in whole} and len(whole) == len(windows) > 5
    assert all(r.significant == (r.observed > max(r.unit_limit, r.circular_limit)) for r in whole)
    length = {key(r): round((r.end - r.start) / 1800.0) for r in windows}
    assert all(r.n_bins == length[key(r)] and 0 <= r.fraction_continuous <= 1 for r in metrics)
    inside = Counter()
    spikes = [(r.session, r.t) for r in e.select("session", "t").collect()]
    for w in windows:
        inside[key(w)] = sum(s == w.session and w.start <= t < w.end for s, t in spikes)
    counts = intervals.count_in_bins(e.select("session", "unit", "t"), got["windows"], 1800.0, KEYS).groupBy("session", "interval_id").agg(F.sum("n").alias("n")).collect()
    assert {key(r): r.n for r in counts} == dict(inside)


def test_unsupervised_job_prefers_the_kernel_that_made_the_events(spark):
    from latentspark.plans import workflows

    got = workflows.replay_unsupervised(spark, binding.hourly_counts(spark, SF), binding.day_counts(spark, SF), KEYS, "event", 4, 2)
    rows = got["events"].collect()
    by = defaultdict(list)
    for r in rows:
        by[r.session, r.event].append(r)
    assert len(by) == 120 and all(abs(sum(r.probability for r in v) - 1) < 1e-9 for v in by.values())
    for v in by.values():
        top = max(r.log_marginal for r in v)
        e = [math.exp(r.log_marginal - top) for r in v]
        assert np.allclose([r.probability for r in v], np.array(e) / sum(e))
    assert got["history"][1] >= got["history"][0]


def test_alignment_to_labels_equals_numpy(spark):
    samples = defaultdict(dict)
    for r in binding.events(spark, SF).collect():
        samples[r.session][r.t] = min(r.k, samples[r.session].get(r.t, r.k))
    rows = Q["e2_align_labels"](spark, SF).collect()
    for r in rows[:: max(1, len(rows) // 200)]:
        t = sorted(samples[r.session])
        assert abs(r.k - np.interp(r.t, t, [samples[r.session][x] for x in t])) < 1e-3


def test_block_follows_the_intervals(spark):
    iv = spark.createDataFrame([("s", k, 10.0 * k, 10.0 * k + 0.1) for k in range(50)], "session string, interval_id int, start double, end double")
    block = intervals.fitting_block(iv)
    assert 0.1 < block < 1
    points = spark.createDataFrame([("s", 0.05 * k) for k in range(2000)], "session string, t double")
    assert intervals.interval_join(points, iv, KEYS, block=block).count() == intervals.interval_join(points, iv, KEYS).count()


def test_chunks_of_uneven_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, u, int(rng.poisson(1.0))) for s, n in (("a", 50), ("b", 7), ("c", 21)) for t in range(n) for u in ("x", "y")]
    c = spark.createDataFrame(rows, "session string, bin long, unit string, n long")
    tuning = spark.createDataFrame([(l, u, 0.5 + l) for l in range(3) for u in ("x", "y")], "latent long, unit string, rate double")
    m = decode.Model.of(tuning, kernels.as_arrays(kernels.stacked_kernels([kernels.move_kernel(spark, 3, 1.0)], 3), 3), kernels.switching(0.1, 0.2))
    whole = {(r.session, r.bin): r for r in decode.decode_hmm(c, m, KEYS).collect()}
    for size in (10, 21, 1000):
        got = decode.decode_in_chunks(c, m, KEYS, size).collect()
        assert len(got) == len(whole)
        for r in got:
            w = whole[r.session, r.bin]
            assert np.allclose(r.p_latent, w.p_latent) and np.allclose(r.p_dyn, w.p_dyn) and np.allclose(r.causal_latent, w.causal_latent) and abs(r.step - w.step) < 1e-9
    assert decode.decode_in_chunks(c.limit(0), m, KEYS, 5).count() == 0


def test_event_nulls_are_the_joined_shuffles(spark):
    c, t = binding.day_counts(spark, SF).where("event < 3"), binding.hourly_tuning(binding.hourly_counts(spark, SF))
    ek = ["session", "event"]
    got = {(r.session, r.event, r.kind, r.shuffle): r.log_marginal for r in nulls.event_nulls(c, t, ek, 3, [1.0]).collect()}
    for kind, shuffled in (("unit", nulls.unit_shuffle(c, 3, ek)), ("circular", nulls.circular_shuffle(c, 3, ek))):
        for r in nulls.event_log_marginal(shuffled, t, [*ek, "shuffle"]).collect():
            assert abs(got[r.session, r.event, kind, r.shuffle] - r.log_marginal) < 1e-6
    tests = nulls.tested_events(nulls.event_nulls(c, t, ek, 3, [1.0]), ek)
    marked = nulls.significant_bins(c.select("session", "event", "bin").distinct(), tests, ek)
    assert marked.count() == 4 * 3 * 24

"""Recursions, fits and helpers against brute force and invariants."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from latentspark.functions import predicates
from latentspark.operators import decode, fit, intervals, kernels, latents, nulls, segments
from latentspark.sources import tables


def random_model(rng, dyn, size):
    k = rng.random((dyn, size, size)) + 0.05
    s = rng.random((dyn, dyn)) + 0.05
    return k / k.sum(2, keepdims=True), s / s.sum(1, keepdims=True)


@pytest.mark.parametrize(("dyn", "size", "n"), [(1, 3, 4), (2, 2, 4), (2, 3, 3)])
def test_forward_backward_equals_all_paths(dyn, size, n):
    rng = np.random.default_rng(dyn * 10 + size)
    k, s = random_model(rng, dyn, size)
    ll = rng.normal(size=(n, size))
    states = list(itertools.product(range(dyn), range(size)))
    total, marginal, joint = 0.0, np.zeros((n, dyn, size)), np.zeros((dyn, size, dyn, size))
    for path in itertools.product(states, repeat=n):
        for start in states:
            p, before = 1 / (dyn * size), start
            for t, (d, x) in enumerate(path):
                p *= s[before[0], d] * k[d, before[1], x] * math.exp(ll[t, x])
                before = (d, x)
            total += p
            for t, st in enumerate(path):
                marginal[t][st] += p
            for a, b in zip(path[:-1], path[1:], strict=True):
                joint[a + b] += p
    got = decode.forward_backward(ll, k, s)
    assert np.isclose(got["step"].sum(), math.log(total))
    assert np.allclose(got["smooth"], marginal / total) and np.allclose(decode.joint_sums(got["causal"], got["ratio"], k, s, "full"), joint / total)
    for what, axes in (("latent", (0, 2)), ("dynamics", (1, 3))):
        assert np.allclose(decode.joint_sums(got["causal"], got["ratio"], k, s, what), (joint / total).sum(axes))


def test_uniform_kernels_make_bins_independent():
    rng = np.random.default_rng(3)
    ll = rng.normal(size=(20, 5))
    got = decode.forward_backward(ll, np.full((1, 5, 5), 0.2), np.ones((1, 1)))
    bins = np.log(np.exp(ll).sum(1))
    assert np.isclose(got["step"].sum(), bins.sum() - 20 * math.log(5))
    assert np.allclose(got["smooth"][:, 0], np.exp(ll - bins[:, None]))


def test_kernels(spark):
    for k in (kernels.move_kernel(spark, 6, 2.0), kernels.jump_kernel(spark, 6), kernels.isolated_kernel(spark, 6, 1.5, 0.01), kernels.product_kernel(kernels.move_kernel(spark, 2, 1.0), 3, kernels.move_kernel(spark, 3, 1.0))):
        assert np.allclose(kernels.as_arrays(k, 6).sum(2), 1)
    zero = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 2.0)], "i long, j long, p double")
    assert kernels.as_arrays(kernels.stacked_kernels([zero], 2), 2)[0].tolist() == [[1, 0], [0.5, 0.5]]


def test_poisson_fit_finds_the_optimum():
    rng = np.random.default_rng(1)
    basis = fit.tuning_basis(fit.rbf(12, 2.0))
    b = rng.random(12) * 50 + 1
    a = rng.poisson(b * 3).astype(float)
    w = fit.poisson_unit(basis, a, b, 1.0)
    f = lambda v: -(a * np.log(fit.softplus(basis @ v)) - fit.softplus(basis @ v) * b).sum() + v @ v / 2
    assert all(f(w) <= f(w + 1e-3 * rng.standard_normal(len(w))) + 1e-9 for _ in range(200))


def test_gaussian_step_solves_its_equations():
    rng = np.random.default_rng(2)
    basis, a, b = rng.random((6, 3)), rng.random((6, 2)), rng.random(6)
    rate = fit.gaussian_m_step(basis, a, b, 0.5, 2.0)
    w = np.linalg.lstsq(basis, rate, rcond=None)[0]
    assert np.allclose((basis.T @ np.diag(b) @ basis / 0.25 + np.eye(3) / 4) @ w, basis.T @ a / 0.25)


def plain_dbscan(x, eps, least):
    cells: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, np.floor(x / eps).astype(int))):
        cells.setdefault(c, []).append(i)

    def near(i: int) -> list[int]:
        a, b = np.floor(x[i] / eps).astype(int)
        around = [j for p in (a - 1, a, a + 1) for q in (b - 1, b, b + 1) for j in cells.get((p, q), ())]
        around = np.array(around)
        return around[((x[around] - x[i]) ** 2).sum(1) <= eps * eps].tolist()

    label, k = np.full(len(x), -2), 0
    for i in range(len(x)):
        if label[i] != -2:
            continue
        around = near(i)
        if len(around) < least:
            label[i] = -1
            continue
        label[i], todo = k, around
        while todo:
            j = todo.pop()
            if label[j] < 0:
                first = label[j] == -2
                label[j] = k
                if first and len(more := near(j)) >= least:
                    todo.extend(more)
        k += 1
    return label


@pytest.mark.parametrize("seed,tile", [(1, 32), (2, 1), (3, 3)])
def test_density_clusters_over_tiles_equal_a_plain_search(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(latents, "TILE", tile)
    rng = np.random.default_rng(seed)
    rows = []
    for latent in range(2):
        t = np.arange(120) / 119
        snake = np.column_stack([30 * t, 5 * np.sin(8 * t)]) + rng.normal(0, 0.15, (120, 2))  # runs through many tiles
        x = np.concatenate([snake, rng.normal((-6, 3), 0.4, (40, 2)), np.repeat([[50.0, 50.0]], 6, axis=0), np.repeat([[-40.0, 1.0]], 4, axis=0), rng.random((40, 2)) * 60 - 20])
        order = rng.permutation(len(x))
        rows += [("a", latent, int(b), float(x[i, 0]), float(x[i, 1])) for b, i in enumerate(order)]
    df = spark.createDataFrame([*rows, ("a", 0, 900, None, 1.0), ("a", 1, 901, float("nan"), 1.0)], "session string, latent int, bin long, x double, y double")
    got = {(r.latent, r.bin): r.cluster for r in latents.dbscan_per_latent(df, "latent", 1.0, 5, ["session"]).collect()}
    assert got.pop((0, 900)) == got.pop((1, 901)) == -1
    for latent in range(2):
        own = [r for r in rows if r[1] == latent]
        want = plain_dbscan(np.array([r[3:] for r in own]), 1.0, 5)
        assert [got[latent, r[2]] for r in own] == want.tolist() and want.max() >= 2
    assert latents.dbscan_per_latent(df.limit(0), "latent", 1.0, 5, ["session"]).count() == 0


def test_poisson_draws_follow_the_distribution():
    u = (np.arange(20000) + 0.5) / 20000
    k = nulls.poisson_draw(np.full(20000, 2.5), u)
    assert abs(k.mean() - 2.5) < 0.01 and abs(k.var() - 2.5) < 0.05 and (np.diff(k) >= 0).all()


def counts(spark):
    rng = np.random.default_rng(0)
    rows = [("s", e, b, u, int(rng.poisson(2))) for e in range(3) for b in range(2 + e * 3) for u in "abcd"]
    return spark.createDataFrame(rows, "session string, event int, bin long, unit string, n long")


def test_shuffles_keep_totals(spark):
    c = counts(spark)
    total = lambda df, *by: {tuple(r)[:-1]: r.s for r in df.groupBy(*by).agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    want = total(c, "event", "unit")
    rolled = total(nulls.circular_shuffle(c, 3, ["session", "event"]), "event", "unit", "shuffle")
    assert all(v == want[k[:2]] for k, v in rolled.items()) and len(rolled) == 3 * len(want)
    bins = total(c, "event", "bin")
    assert all(v == bins[k[:2]] for k, v in total(nulls.unit_shuffle(c, 3, ["session", "event"]), "event", "bin", "shuffle").items())


def test_event_nulls_hold_the_observed_marginal(spark):
    c = counts(spark)
    t = spark.createDataFrame([(k, u, 0.5 + k + i) for k in range(3) for i, u in enumerate("abcd")], "latent long, unit string, rate double")
    want = {r.event: r.log_marginal for r in nulls.event_log_marginal(c, t, ["session", "event"]).collect()}
    got = nulls.event_nulls(c, t, ["session", "event"], 2, [1.0, 2.0]).collect()
    for r in got:
        if r.kind == "observed" and r.gain == 1.0:
            assert abs(r.log_marginal - want[r.event]) < 1e-6
    assert len(got) == 3 * 2 * 5


def test_decoding_rows_sum_to_one(spark):
    t = spark.createDataFrame([(k, u, 0.5 + k + i) for k in range(3) for i, u in enumerate("abcd")], "latent long, unit string, rate double")
    m = decode.Model.of(t, kernels.as_arrays(kernels.stacked_kernels([kernels.move_kernel(spark, 3, 1.0)], 3), 3), kernels.switching(0.1, 0.1))
    got = decode.decode_hmm(counts(spark), m, ["session", "event"]).collect()
    assert len(got) == 15 and all(abs(sum(r.p_latent) - 1) < 1e-9 and abs(sum(r.p_dyn) - 1) < 1e-9 for r in got)


def test_em_raises_the_marginal(spark):
    c = counts(spark)
    k = np.concatenate([kernels.as_arrays(kernels.move_kernel(spark, 3, 1.0), 3), kernels.as_arrays(kernels.jump_kernel(spark, 3), 3)])
    start = fit.init_random(c.select("session", "event", "bin").distinct(), ["session", "event"], 3)
    _, history = fit.fit_em(spark, c, start, k, kernels.switching(0.05, 0.05), fit.tuning_basis(fit.rbf(3, 1.0)), ["session", "event"], 3, prior=1e3)
    assert all(b > a - 1e-6 for a, b in zip(history[:-1], history[1:], strict=True))


@pytest.mark.parametrize(("op", "want"), [("union", [(0, 4), (5, 9)]), ("intersect", [(1, 2), (6, 7)]), ("diff", [(0, 1), (5, 6)])])
def test_interval_algebra(spark, op, want):
    a = spark.createDataFrame([("s", 0.0, 2.0), ("s", 5.0, 7.0)], "session string, start double, end double")
    b = spark.createDataFrame([("s", 1.0, 4.0), ("s", 6.0, 8.0), ("s", 8.0, 9.0)], a.schema)
    got = sorted((r.start, r.end) for r in intervals.set_operation(a, b, op, ["session"]).collect())
    assert got == want


def test_runs_merge_and_durations(spark):
    s = spark.createDataFrame([("s", float(t), float(v)) for t, v in enumerate([0, 1, 1, 0, 1, 0, 0, 0, 1, 1])], "session string, t double, v double")
    got = sorted((r.start, r.end) for r in intervals.threshold_runs(s, "v", 0.5, "above", ["session"]).collect())
    assert got == [(1, 2), (4, 4), (8, 9)]
    assert sorted((r.start, r.end) for r in intervals.state_intervals(s, "v", 0.5, 3.0, 1.0, ["session"]).collect()) == [(1, 4)]


def test_segments_break_at_missing_and_large_steps(spark):
    rows = [("e", b, 0.9, x) for b, x in enumerate([1.0, 2.0, None, 4.0, 5.0, 50.0, 51.0])]
    df = spark.createDataFrame(rows, "event string, bin long, p double, x double")
    parts = segments.split_segments(segments.continuous_segments(df, "p", 0.8, 2, ["event"]), "x", 10.0, 2, ["event"])
    got = {}
    for r in parts.collect():
        got.setdefault(r.segment, set()).add(r.bin)
    assert sorted(map(sorted, got.values())) == [[0, 1], [3, 4], [5, 6]]


def test_predicates_treat_missing_as_no_match(spark):
    df = spark.createDataFrame([("A b", 1.0), (None, float("nan")), ("c", None)], "`a b` string, x double")
    n = lambda spec: predicates.filter_by_spec(df, spec)[0].count()
    assert n(["x", "==", 1.0]) == 1 and n(["x", "!=", 1.0]) == 2 and n(["x", "not in", [1.0]]) == 2 and n(["x", "isna"]) == 2
    assert n(["a b", "contains", "a", {"case": False}]) == 1 and n(["a b", "startswith", "c", {"na": True}]) == 2
    assert n([["x", "between", [1, 2]], {"not": ["a b", "regex", "z"]}]) == 1
    with pytest.raises(KeyError):
        n(["y", "==", 1])
    for bad in ([], {"all": []}, ["x", "~", 1], {"some": []}, 3):
        with pytest.raises(ValueError):
            n(bad)


def test_results_are_saved_once(spark, tmp_path):
    a = spark.createDataFrame([("s0", 1)], "session string, v int")
    tables.save_results({"a": a}, str(tmp_path), {"k": 1})
    tables.save_results({"a": a.withColumn("v", a.v + 1)}, str(tmp_path), {"k": 2})
    got, parameters = tables.load_results(spark, str(tmp_path), ["a"])
    assert got["a"].first().v == 1 and parameters == {"k": 1}
    tables.save_results({"a": a.withColumn("v", a.v + 1)}, str(tmp_path), {"k": 2}, force=True)
    assert tables.load_results(spark, str(tmp_path), ["a"])[0]["a"].first().v == 2
    tables.export_csv(a, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["session", "v"]


def test_grid_index_round_trip(spark):
    got = tables.flat_to_grid(spark.range(12).withColumnRenamed("id", "f"), "f", [3, 4]).toPandas()
    assert (got.d0 * 4 + got.d1 == got.f).all() and got.d0.max() == 2 and isinstance(got, pd.DataFrame)

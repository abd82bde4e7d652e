"""The queries run over all rows of their tables, not over some ids of them."""

import numpy as np
import pytest

import __spark_entry__
from latentspark.operators import decode, fit, kernels, nulls, selection
from latentspark.plans.binding import DAYS, day_counts, hourly_counts, hourly_tuning

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
SESSIONS = {"s0", "s1", "s2", "s3"}


def test_shuffle_test_has_every_day(spark):
    got = {(r.session, r.event) for r in QUERIES["m3_shuffle_test_marginal"](spark, SF).collect()}
    assert got == {(s, e) for s in SESSIONS for e in range(DAYS)}


def test_gain_sweep_counts_every_day(spark):
    n = nulls.event_nulls(day_counts(spark, SF), hourly_tuning(hourly_counts(spark, SF)), ["session", "event"], 100, [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0])
    assert n.select("session", "event").distinct().count() == len(SESSIONS) * DAYS
    got, want = QUERIES["m4_gain_sweep"](spark, SF), nulls.gain_sweep(n, ["session", "event"])
    assert [(r.gain, r.train, r.test) for r in got.orderBy("gain").collect()] == [(r.gain, pytest.approx(r.train, abs=1e-6), pytest.approx(r.test, abs=1e-6)) for r in want.orderBy("gain").collect()]


def embeddings(tmp_path, spark):
    """Three series of 100, 100 and 30 vectors; labels follow the first component in the second series only."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(230, 6)).astype(np.float32)
    label = [int(v) for v in rng.integers(0, 10, 230)]
    x[100:200, 0] = 5 * np.array(label[100:200])
    spark.createDataFrame([(k, x[k].tolist(), label[k]) for k in range(230)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return x.astype(float), np.array(label, float)


def test_label_shuffle_test_takes_every_series(spark, tmp_path):
    x, label = embeddings(tmp_path, spark)
    got = {r.series: r for r in QUERIES["i8_distance_label_shuffle_test"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2}
    for k, r in got.items():
        a, l = x[100 * k : 100 * k + 100], label[100 * k : 100 * k + 100]
        i, j = np.triu_indices(len(a), 1)
        assert r.slope == pytest.approx(np.polyfit(np.abs(l[i] - l[j]), np.linalg.norm(a[i] - a[j], axis=1), 1)[0], abs=1e-6)
        assert 1 / 51 - 1e-6 <= r.p <= 1
    assert got[1].p == pytest.approx(1 / 51, abs=1e-6) and max(got[0].p, got[2].p) > 1 / 51


def test_mean_distances_take_every_step_and_component(spark, tmp_path):
    x, _ = embeddings(tmp_path, spark)
    at = []
    for k in range(3):
        a = x[100 * k : 100 * k + 100]
        t = np.linspace(0, len(a) - 1, 6)
        at.append(np.array([np.interp(t, np.arange(len(a)), c) for c in a.T]).T)
    got = QUERIES["i10_mean_distance_matrix"](spark, str(tmp_path)).collect()
    assert len(got) == 21
    for r in got:
        assert r["mean"] == pytest.approx(np.mean([np.linalg.norm(a[r.p] - a[r.q]) for a in at]), abs=1e-5)


@pytest.mark.parametrize("name", ["l3_pre_post_circular_null", "l4_relabel_pre_post", "k5_dbscan_per_latent", "j12_previous_label_logit"])
def test_query_has_every_session(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.session for r in rows} == SESSIONS


def test_model_selection_takes_every_session(spark):
    frame = spark.createDataFrame([(s, b, u, (b * 7 + s * 3 + k) % 5) for s in range(3) for b in range(40) for k, u in enumerate("ab")], "session int, bin long, unit string, n long")
    grid = spark.createDataFrame([(0, 2, 1.0), (1, 3, 1.0)], "config int, latents int, lengthscale double")
    got = selection.model_selection(spark, frame.where("bin < 30"), frame.where("bin >= 30"), grid, ["session"], 2, 3, 0.5).collect()
    assert {(r.config, r.repeat) for r in got} == {(c, r) for c in range(2) for r in range(2)} and len({r.config for r in got if r.best}) == 1
    y, z = ({s: np.array([[(b * 7 + s * 3 + k) % 5 for k in range(2)] for b in bins], float) for s in range(3)} for bins in (range(30), range(30, 40)))
    by_config = {}
    for r in got:
        n = r.config + 2
        basis, (_, k), switch = fit.tuning_basis(fit.rbf(n, 1.0)), selection._smoothing(n, 1.0), kernels.switching(0.02, 0.02)
        post = {s: selection._start(30, n, r.config, r.repeat, s) for s in y}
        for _ in range(3):
            a, b = sum(post[s].T @ y[s] for s in y), sum(post[s].sum(0) for s in y)
            rates = np.column_stack([fit.softplus(basis @ fit.poisson_unit(basis, a[:, u], b, 1.0)) for u in range(2)])
            post = {s: decode.forward_backward(decode.loglik_matrix(y[s], rates, 1.0, 1.0), k, switch)["smooth"].sum(1) for s in y}
        marginal = lambda v: sum(decode.forward(decode.loglik_matrix(z[s], rates, 1.0, 1.0, v), k, switch, start=decode.uniform_start(2, n, v))[1].sum() for s in z)  # noqa: B023, E731
        down = np.mean([marginal(selection.kept_latents(n, 0.5, r.repeat, d)) for d in range(3)])
        assert r.test_marginal == pytest.approx(marginal(None)) and r.downsampled == pytest.approx(down)
        by_config.setdefault(r.config, []).append(r)
    for rows in by_config.values():
        assert rows[0]["mean"] == pytest.approx(np.mean([r.downsampled for r in rows])) and rows[0]["std"] == pytest.approx(np.std([r.downsampled for r in rows], ddof=1))
    assert {r.config for r in got if r.best} == {max(by_config, key=lambda c: by_config[c][0]["mean"])}

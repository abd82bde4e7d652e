"""The logit of a label over rows that are never copied: groups in a task and groups in passes, permutations, and the plain fit."""

import numpy as np

from latentspark.operators import selection


def table(spark, sizes=(90, 150, 4)):
    rng = np.random.default_rng(3)
    rows = [(g, t, "abc"[int(v > 0) + int(v > 1)], float(v + 0.3 * rng.normal()), float(rng.normal()), 5.0) for g, n in enumerate(sizes) for t, v in enumerate(rng.normal(size=n))]
    return rows, spark.createDataFrame([*rows, (0, 1000, None, 1.0, 1.0, 5.0), (0, 1001, "a", None, 1.0, 5.0)], "session int, event_bin long, label string, x double, noise double, flat double")


def test_permutations_are_whole_and_even():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(selection.permuted(np.arange(n), n, 11 * n)) == list(range(n))
    assert np.array_equal(selection.permuted(np.arange(100, 200), 1000, 4), selection.permuted(np.arange(1000), 1000, 4)[100:200])
    seen = np.array([selection.permuted(np.arange(6), 6, seed) for seed in range(6000)])
    share = np.array([[(seen[:, i] == j).mean() for j in range(6)] for i in range(6)])
    assert np.abs(share - 1 / 6).max() < 0.03


def test_groups_in_passes_fit_as_groups_in_a_task(spark):
    _, df = table(spark)
    get = lambda most: {(r.session, r.shuffle): r.accuracy for r in selection.label_logit(df, "label", ["x", "noise", "flat"], 3, keys=["session"], one_task=most, rounds=6).collect()}
    in_task = get(1000)
    assert len(in_task) == 12 and in_task[1, 0] > 0.7
    for most in (100, 0):
        assert get(most) == in_task


def test_observed_fit_is_the_plain_one(spark):
    rows, df = table(spark)
    got = {r.session: r.accuracy for r in selection.label_logit(df, "label", ["x", "noise"], 0, keys=["session"]).collect()}
    for g in (0, 1):
        part = [r for r in rows if r[0] == g]
        kinds, y = np.unique([r[2] for r in part], return_inverse=True)
        x = np.array([r[3:5] for r in part])
        z = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), np.ones(len(x))])
        w = np.zeros((3, len(kinds)))
        for _ in range(30000):  # plain proximal steps
            e = np.exp(z @ w)
            w = w - 0.5 * z.T @ (e / e.sum(1, keepdims=True) - np.eye(len(kinds))[y]) / len(z)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 0.5 * 0.01, 0)
        assert abs(((z @ w).argmax(1) == y).mean() - got[g]) < 0.02


def test_empty_and_keyless(spark):
    _, df = table(spark)
    assert selection.label_logit(df.where("false"), "label", ["x"], 2, keys=["session"]).count() == 0
    got = selection.label_logit(df.where("session = 1"), "label", ["x"], 1, one_task=0, rounds=3).collect()
    assert sorted(r.shuffle for r in got) == [0, 1]


def test_no_row_is_copied(spark):
    _, df = table(spark)
    plan = selection.label_logit(df, "label", ["x"], 50, keys=["session"])._jdf.queryExecution().toString()
    assert "Generate" not in plan

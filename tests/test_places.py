"""Nearest places through cells against all distances."""

import numpy as np
import pytest

from latentspark.operators import behaviour, places

INF, NAN = float("inf"), float("nan")


def plain_nearest(x, y, edges):
    """(away, edge, share) by all edges."""
    best = None
    for e in edges:
        a, b = np.array(e[:2]), np.array(e[2:4])
        d = b - a
        share = float(np.clip((np.array([x, y]) - a) @ d / (d @ d), 0, 1)) if d @ d > 0 else 0.0
        got = (float(np.hypot(*(np.array([x, y]) - a - share * d))), e, share)
        best = got if best is None or got[:2] < best[:2] else best
    return best


def cases(seed, n, edges):
    rng = np.random.default_rng(seed)
    spread = [1.0, 40.0, 4000.0][seed % 3]
    xy = rng.normal(0, spread, (n, 2)).tolist()
    ends = rng.normal(0, 20, (edges, 2))
    length = rng.choice([0.0, 0.5, 60.0], (edges, 1))
    return [(i, *p) for i, p in enumerate(xy)], [(*a, *(a + l * rng.normal(size=2)), f"e{i}") for i, (a, l) in enumerate(zip(ends, length))]


def frames(spark, position, edges):
    return spark.createDataFrame(position, "id long, x double, y double"), spark.createDataFrame([tuple(map(float, e[:4])) + (e[4],) for e in edges], "x0 double, y0 double, x1 double, y1 double, name string")


@pytest.mark.parametrize("seed,cell,most", [(0, None, 500_000), (1, 0.7, 500_000), (2, 30.0, 0), (3, 1000.0, 0), (4, None, 0)])
def test_nearest_edge_is_that_of_all(spark, monkeypatch, seed, cell, most):
    monkeypatch.setattr(places, "BROADCAST_PLACES", most)
    position, edges = cases(seed, 60, 25)
    got = {r.id: r for r in places.nearest_edge(*frames(spark, position, edges), ["name"], cell).collect()}
    assert len(got) == len(position)
    for i, x, y in position:
        away, edge, share = plain_nearest(x, y, edges)
        r = got[i]
        assert r.away == pytest.approx(away, abs=1e-9) and r.name == edge[4] and r.share == pytest.approx(share, abs=1e-9)
        assert np.hypot(r.at_x - x, r.at_y - y) == pytest.approx(away, abs=1e-9)


def test_missing_positions_ties_and_repeats(spark):
    position = [(0, None, 1.0), (1, NAN, 0.0), (2, INF, 0.0), (3, 0.0, 0.0), (3, 0.0, 0.0), (4, 5.0, -INF)]
    edges = [(1.0, 0.0, 1.0, 0.0, "right"), (-1.0, 0.0, -1.0, 0.0, "left"), (0.0, 1.0, 0.0, 1.0, "up"), (-1.0, 0.0, -1.0, 0.0, "left"), (NAN, 0.0, 0.0, 0.0, "unknown")]
    got = sorted((r.id, r.away, r.name) for r in places.nearest_edge(*frames(spark, position, edges), ["name"]).collect())
    assert got == [(0, None, None), (1, None, None), (2, None, None), (3, 1.0, "left"), (3, 1.0, "left"), (4, None, None)]


def test_without_edges_or_positions(spark):
    position, edges = frames(spark, [(0, 1.0, 2.0)], [(0.0, 0.0, 1.0, 0.0, "a")])
    none = places.nearest_edge(position, edges.where("false"), ["name"])
    assert [tuple(r) for r in none.collect()] == [(0, 1.0, 2.0, None, None, None, None, None)]
    assert none.schema["name"].dataType == edges.schema["name"].dataType
    assert places.nearest_edge(position.where("false"), edges, ["name"]).count() == 0
    assert places.nearest_edge(position.where("id = 1"), edges, ["name"]).columns == none.columns


def test_distance_to_points_is_the_least(spark):
    rng = np.random.default_rng(5)
    points, position = rng.uniform(0, 100, (300, 2)), rng.uniform(-20, 120, (200, 2))
    got = behaviour.distance_to_points(spark.createDataFrame([(i, *p) for i, p in enumerate(position.tolist())], "id long, x double, y double"), spark.createDataFrame(points.tolist(), "x double, y double"), ["id"]).collect()
    want = np.hypot(*(position[:, None] - points[None]).transpose(2, 0, 1)).min(1)
    assert len(got) == 200 and all(r.away == pytest.approx(want[r.id], abs=1e-9) for r in got)


def test_rows_meet_only_places_near_their_cell(spark):
    """No join without equal keys, and few places for each row."""
    position, edges = cases(1, 200, 400)
    found = places.nearest_edge(*frames(spark, position, edges), ["name"])
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    cells = spark.createDataFrame([(c, d) for c in range(-20, 20) for d in range(-20, 20)], "cx long, cy long")
    e = frames(spark, position, edges)[1].selectExpr("named_struct('x0', x0, 'y0', y0, 'x1', x1, 'y1', y1) AS edge")
    near = places._near_cells(cells, e, 1.0, lambda df: df.cache())
    assert near.count() == 1600 and near.selectExpr("avg(size(near)) AS n").first().n < 25


def test_linear_position_along_a_line(spark):
    line = places.polyline(spark.createDataFrame([(2, 3.0, 4.0), (0, 0.0, 0.0), (1, 3.0, 0.0), (3, None, 1.0)], "o int, x double, y double"), "o")
    assert [tuple(r) for r in line.orderBy("start").collect()] == [(0.0, 0.0, 3.0, 0.0, 0.0), (3.0, 0.0, 3.0, 4.0, 3.0)]
    position = spark.createDataFrame([(0, 1.0, 0.5), (1, 3.2, 2.0), (2, 9.0, 9.0), (3, -2.0, 0.0), (4, None, None)], "id long, x double, y double")
    assert {r.id: r.lin for r in places.linear_position(position, line).collect()} == {0: 1.0, 1: 5.0, 2: 7.0, 3: 0.0, 4: None}
    assert sorted(tuple(r) for r in places.projected_points(position, line, 0).collect()) == [(0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (5.0, 3.0, 2.0), (7.0, 3.0, 4.0)]

"""Positions along the line of the reference points, where sums come in another order and where there is no line."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__

NAME = "d10_linear_position"
#: Their mean is 49.77125; added up in the first order it is a little more, in the second a little less.
ORDERS = [[81.27, 27.96, 63.64, 17.09, 39.43, 45.45, 73.74, 49.59], [73.74, 45.45, 81.27, 39.43, 17.09, 27.96, 49.59, 63.64]]
#: Their mean is 45, added up in the first order; in the second a little less.
TENS = [[17.67, 45.04, 62.84, 53.48, 51.5, 36.48, 53.54, 39.45], [36.48, 53.48, 45.04, 53.54, 51.5, 17.67, 62.84, 39.45]]


def table(folder, hours):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=h, seconds=i), 4, "view", float(v), f'{{"k": {10 + h}}}') for i, (h, v) in enumerate((h, v) for h, values in enumerate(hours) for v in values)]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return c


@pytest.mark.parametrize("name", [NAME, "d10_projected_points"])
def test_the_order_of_a_sum_does_not_decide_a_half(spark, tmp_path, name):
    found = []
    for k, order in enumerate(ORDERS):
        (tmp_path / str(k)).mkdir()
        table(tmp_path / str(k), [order, [80.0, 82.0]])
        found.append(sorted(map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path / str(k))).collect())))
    assert found[0] == found[1]
    assert 49.7713 in {v for row in found[1] for v in row}


def test_the_order_of_a_sum_does_not_decide_a_ten(spark, tmp_path):
    found = []
    for k, order in enumerate(TENS):
        (tmp_path / str(k)).mkdir()
        table(tmp_path / str(k), [order, [80.0, 82.0]])
        found.append([r.lin for r in __spark_entry__.queries()["d10_reference_points"](spark, str(tmp_path / str(k))).orderBy("lin").collect()])
    assert found == [[50.0, 80.0]] * 2


def test_one_reference_point_makes_no_line(spark, tmp_path):
    c = table(tmp_path, [[49.0, 50.0], [50.5], [51.0, 50.0]])
    assert c.sql(__spark_entry__.oracle_sql()[NAME]).fetchall() == []
    assert __spark_entry__.queries()[NAME](spark, str(tmp_path)).collect() == []

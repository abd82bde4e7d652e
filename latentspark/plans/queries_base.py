"""Tables, filters, intervals, signals and tuning, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentspark.functions import predicates, seeds
from latentspark.operators import intervals as I
from latentspark.operators import signals as S
from latentspark.operators import tuning as T
from latentspark.sources import tables

from .binding import EV, HC, IV, KEYS, SIG, TUN, Query, events, half_days, hourly_counts, hourly_signal, hourly_tuning, rounded, table, whole_span, with_

SPEC = {"all": [["c_acctbal", "between", [0, 5000], {"inclusive": "left"}], {"any": [["c_mktsegment", "in", ["BUILDING", "MACHINERY"]], ["c_name", "regex", "7$"]]}, {"not": ["c_nationkey", "<", 3]}]}
NAMES = {0: "low", 2: "middle", 4: "high"}


def _t_series(spark, sf):
    return events(spark, sf).select("session", "t", "value", "event_id")


def _runs(spark, sf, method, threshold):
    return I.threshold_runs(_t_series(spark, sf), "value", threshold, method, KEYS, order=["t", "event_id"])


def _two_sets(spark, sf):
    a = half_days(spark, sf).select("session", "start", "end")
    b = a.select("session", (F.col("start") + 21600.0).alias("start"), (F.col("end") + 21600.0).alias("end")).where(F.pmod(F.col("start"), F.lit(172800.0)) >= 86400.0)
    return a, b


def _uneven(spark, sf):
    """Per session and day the span of its events: session, interval_id, start, end."""
    e = events(spark, sf)
    return e.groupBy("session", F.floor((F.col("t") - tables.T0) / 86400).cast("int").alias("interval_id")).agg(F.min("t").alias("start"), F.max("t").alias("end"))


def _targets(spark, sf):
    return whole_span(spark, sf).select("session", F.explode(F.sequence(F.lit(0), F.lit(239))).alias("i")).select("session", (F.lit(tables.T0) + F.col("i") * 10800.0).alias("t"))


def _epochs(spark, sf):
    h = half_days(spark, sf)
    a = h.select("session", "start", "end", F.lit("early").alias("name"), F.lit(1).alias("priority"))
    b = h.where("interval_id % 3 = 0").select("session", (F.col("start") + 21600).alias("start"), (F.col("end") + 10800).alias("end"), F.lit("third").alias("name"), F.lit(2).alias("priority"))
    return a.unionByName(b)


def _label_bins(spark, sf):
    """Hours with the mean of k as their label, in ten bins of 10."""
    e = events(spark, sf)
    lab = e.groupBy("session", F.floor((F.col("t") - tables.T0) / 3600).cast("long").alias("bin")).agg(F.avg("k").alias("label"))
    return lab.withColumn("flat", T.digitize(F.col("label"), 0.0, 10.0, 10))


LAB = "lab AS (SELECT session, CAST(floor((t - 1704067200e0) / 3600) AS BIGINT) AS bin, greatest(0, least(9, CAST(floor(avg(k) / 10) AS BIGINT))) AS flat FROM ev GROUP BY 1, 2)"
OCC = "occ AS (SELECT flat, count(*) * 3600e0 AS seconds FROM lab GROUP BY 1)"
CBB = "cbb AS (SELECT flat, unit, sum(n) AS n FROM hc JOIN lab USING (session, bin) GROUP BY 1, 2)"
KER = """ker AS (SELECT i.flat AS i, j.flat AS j, exp(-0.5 * pow((i.flat - j.flat) / 1.5, 2)) / sum(exp(-0.5 * pow((i.flat - j.flat) / 1.5, 2))) OVER (PARTITION BY i.flat) AS w FROM occ i, occ j)"""


def _occupancy(spark, sf):
    return T.occupancy(_label_bins(spark, sf), "flat", 3600.0)


def _kernel(spark, sf):
    return T.smoothing_kernel(_occupancy(spark, sf).withColumn("x", F.col("flat").cast("double")), "flat", [("x", 1.5)])


def _tuning(spark, sf):
    c = T.counts_by_bin(hourly_counts(spark, sf), _label_bins(spark, sf), ["session", "bin"], "flat")
    return T.tuning_by_label(c, _occupancy(spark, sf), "flat", _kernel(spark, sf), 7200.0)


def _smooth(spark, sf):
    c = S.population_rate(events(spark, sf), whole_span(spark, sf), 3600.0, KEYS)
    return S.gaussian_smooth(c, "n", 1.0, KEYS, name="rate")


SMOOTH = """pop AS (SELECT session, bin, sum(n) AS n FROM hc GROUP BY 1, 2),
      w AS (SELECT o, exp(-0.5 * o * o) AS g FROM range(-4, 5) r(o)),
      sm AS (SELECT a.session, a.bin, a.n, sum(b.n * g) / sum(g) AS rate FROM pop a CROSS JOIN w JOIN pop b ON b.session = a.session AND b.bin = a.bin + o GROUP BY 1, 2, 3)"""


def _zscore(spark, sf):
    s = _smooth(spark, sf)
    return S.zscore_with_baseline(s, "rate", half_days(spark, sf).where("interval_id < 10"), KEYS)


ZS = """base AS (SELECT sm.session, avg(rate) AS m, stddev_pop(rate) AS sd FROM sm JOIN iv ON iv.session = sm.session AND interval_id < 10 AND 1704067200e0 + (bin + 0.5) * 3600 BETWEEN s AND e GROUP BY 1),
      z AS (SELECT sm.session, bin, rate, (rate - m) / sd AS z FROM sm JOIN base USING (session))"""


def _bursts(spark, sf):
    return S.detect_bursts(events(spark, sf), whole_span(spark, sf), 3600.0, 1.0, KEYS, z_peak=1.5, shortest=3600.0, longest=36000.0).select("session", "start", "end", "n", "peak")


def _derivative(spark, sf):
    return S.derivative(hourly_signal(spark, sf), "value", KEYS, "bin").select("session", "bin", "slope")


def _angular(spark, sf):
    x = events(spark, sf).groupBy("session", F.floor((F.col("t") - tables.T0) / 3600).cast("double").alias("t")).agg(F.avg("value").alias("x"), F.avg("k").alias("y"))
    return S.angular_velocity(x, KEYS).select("session", "t", "omega")


def _consecutive(spark, sf, metric):
    return S.consecutive_in_ranges(table(spark, sf, "embeddings"), "embedding", metric, "vec_id", 128).select("vec_id", "distance")


def _grid_maps(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(F.col("p_size").alias("ix")).distinct().withColumn("x", F.col("ix") * 2.0)
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("ix")).withColumn("y", F.col("ix") * 3.0)
    return T.grid_maps({"a": a, "b": b}).select("maze", "flat_idx", "ix", "x", "y")


UNEVEN = "un AS (SELECT session, CAST(floor((t - 1704067200e0) / 86400) AS INTEGER) AS interval_id, min(t) AS s, max(t) AS e FROM ev GROUP BY 1, 2)"
EV_IV = with_(EV, IV)
RUNS = """r0 AS (SELECT session, t, event_id, value, coalesce({test}, false) AS inside FROM ev),
      r1 AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER w, false) AS b FROM r0 WINDOW w AS (PARTITION BY session ORDER BY t, event_id)),
      r2 AS (SELECT *, sum(b::INT) OVER (PARTITION BY session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r1),
      runs AS (SELECT session, run, min(t) AS s, max(t) AS e, count(*) AS n FROM r2 WHERE inside GROUP BY 1, 2)"""
MERGE = """m0 AS (SELECT *, max(e) OVER (PARTITION BY session ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs),
      m1 AS (SELECT *, CASE WHEN reach IS NULL OR s - reach >= {gap} THEN 1 ELSE 0 END AS new FROM m0),
      m2 AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1),
      merged AS (SELECT session, min(s) AS s, max(e) AS e, count(*) AS parts FROM m2 GROUP BY session, g)"""
SETS = """b AS (SELECT session, s + 21600 AS s, e + 21600 AS e FROM iv WHERE (s + 21600) % 172800 >= 86400),
      cuts AS (SELECT session, s AS x FROM iv UNION SELECT session, e FROM iv UNION SELECT session, s FROM b UNION SELECT session, e FROM b),
      sp AS (SELECT session, x, lead(x) OVER (PARTITION BY session ORDER BY x) AS nx FROM cuts),
      fl AS (SELECT sp.*, EXISTS (SELECT 1 FROM iv WHERE iv.session = sp.session AND iv.s <= x AND iv.e > x) AS ia, EXISTS (SELECT 1 FROM b WHERE b.session = sp.session AND b.s <= x AND b.e > x) AS ib FROM sp WHERE nx IS NOT NULL),
      kp AS (SELECT *, {keep} AS keep FROM fl),
      k1 AS (SELECT *, keep AND NOT coalesce(lag(keep) OVER (PARTITION BY session ORDER BY x), false) AS bg FROM kp),
      k2 AS (SELECT *, sum(bg::INT) OVER (PARTITION BY session ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM k1)
SELECT session, min(x) AS start, max(nx) AS "end" FROM k2 WHERE keep GROUP BY session, g"""


def _set_query(op: str, keep: str) -> Query:
    return Query(f"c8_interval_{op}", lambda s, d: I.set_operation(*_two_sets(s, d), op, KEYS), EV_IV.rstrip() + ",\n     " + SETS.format(keep=keep))


ALIGN = """tg AS (SELECT session, 1704067200e0 + i * 10800 AS t FROM (SELECT DISTINCT session FROM ev), range(240) r(i)),
      one AS (SELECT session, t, min(value) AS value FROM ev GROUP BY 1, 2),
      bk AS (SELECT tg.session, tg.t, one.t AS bt, one.value AS bv FROM tg ASOF LEFT JOIN one ON tg.session = one.session AND tg.t >= one.t),
      al AS (SELECT bk.*, one.t AS at_, one.value AS av FROM bk ASOF LEFT JOIN one ON bk.session = one.session AND bk.t <= one.t)"""

QUERIES = [
    Query("a4_tables_to_long", lambda s, d: tables.to_long(table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")), ["c_custkey"], ["c_acctbal", "c_nationkey"]),
          "SELECT c_custkey, 'c_acctbal' AS feature, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer"),
    Query("a4_tables_to_wide", lambda s, d: tables.to_wide(events(s, d).groupBy("session", "unit").agg(F.count(F.lit(1)).alias("n")), ["session"], "unit", "n", ["click", "error", "purchase", "signup", "view"]),
          with_(EV) + "SELECT session, " + ", ".join(f"nullif(count(*) FILTER (unit = '{u}'), 0) AS {u}" for u in ("click", "error", "purchase", "signup", "view")) + " FROM ev GROUP BY 1"),
    Query("b1_filter_by_spec", lambda s, d: predicates.filter_by_spec(table(s, d, "customer"), SPEC)[0].select("c_custkey", "c_acctbal"),
          "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR regexp_matches(c_name, '7$')) AND NOT c_nationkey < 3"),
    Query("b2_compare_mask", lambda s, d: predicates.filter_by_spec(table(s, d, "part"), [["p_size", "!=", 10], ["p_retailprice", ">=", 1000.0]])[1].groupBy("mask").agg(F.count(F.lit(1)).alias("n")),
          "SELECT (p_size <> 10 AND p_retailprice >= 1000) AS mask, count(*) AS n FROM part GROUP BY 1"),
    Query("b6_string_tests", lambda s, d: predicates.filter_by_spec(table(s, d, "part"), {"any": [["p_name", "contains", "ALM", {"case": False}], ["p_brand", "endswith", "3"], ["p_type", "startswith", "STAN"]]})[0].select("p_partkey"),
          "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'ALM', 'i') OR p_brand LIKE '%3' OR p_type LIKE 'STAN%'"),
    Query("b8_select_units", lambda s, d: I.select_units(events(s, d), events(s, d).groupBy("unit").agg(F.avg("value").alias("m")).orderBy(F.desc("m"), "unit").limit(2)).groupBy("session", "unit").agg(F.count(F.lit(1)).alias("n")),
          with_(EV) + "SELECT session, unit, count(*) AS n FROM ev WHERE unit IN (SELECT unit FROM ev GROUP BY 1 ORDER BY avg(value) DESC, unit LIMIT 2) GROUP BY 1, 2"),
    Query("b9_event_phase", lambda s, d: rounded(I.event_phase(events(s, d).select("session", "event_id", "t"), half_days(s, d), KEYS).select("event_id", "phase")),
          EV_IV + "SELECT event_id, round((t - s) / (e - s), 6) AS phase FROM ev JOIN iv ON ev.session = iv.session AND t BETWEEN s AND e"),
    Query("b10_normalize_units", lambda s, d: rounded(S.normalize_units(hourly_counts(s, d), "zscore", KEYS).select("session", "bin", "unit", "norm")),
          with_(EV, HC) + "SELECT session, bin, unit, round((n - avg(n) OVER w) / stddev_pop(n) OVER w, 6) + 0.0 AS norm FROM hc WINDOW w AS (PARTITION BY session, unit)"),
    Query("b11_sort_units_by_peak", lambda s, d: T.sort_units_by_peak(hourly_tuning(hourly_counts(s, d))),
          with_(EV, HC, TUN) + ", pk AS (SELECT unit, latent AS peak FROM tun QUALIFY row_number() OVER (PARTITION BY unit ORDER BY rate DESC, latent) = 1) SELECT unit, peak, CAST(row_number() OVER (ORDER BY peak, unit) AS INTEGER) AS position FROM pk"),
    Query("c1_restrict", lambda s, d: I.restrict(events(s, d), half_days(s, d), KEYS).groupBy("session", "unit").agg(F.count(F.lit(1)).alias("n")),
          EV_IV + "SELECT session, unit, count(*) AS n FROM ev WHERE EXISTS (SELECT 1 FROM iv WHERE iv.session = ev.session AND t BETWEEN s AND e) GROUP BY 1, 2"),
    Query("c2_in_interval", lambda s, d: I.in_interval(events(s, d).select("session", "event_id", "t"), half_days(s, d), KEYS, ["event_id"]).select("event_id", "interval_id"),
          EV_IV + "SELECT event_id, min(interval_id) AS interval_id FROM ev LEFT JOIN iv ON iv.session = ev.session AND t BETWEEN s AND e GROUP BY 1"),
    Query("c3_count_in_bins", lambda s, d: I.count_in_bins(events(s, d), half_days(s, d), 3600.0, KEYS).select("session", "interval_id", "bin", "unit", "n"),
          EV_IV + """, c AS (SELECT ev.session, interval_id, CAST(floor((t - s) / 3600) AS BIGINT) AS bin, unit, count(*) AS n FROM ev JOIN iv ON iv.session = ev.session AND t >= s AND t < e GROUP BY ALL),
          g AS (SELECT session, interval_id, bin, unit FROM iv JOIN (SELECT DISTINCT session, unit FROM ev) USING (session), range(12) r(bin))
          SELECT session, interval_id, bin, unit, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (session, interval_id, bin, unit)"""),
    Query("c4_bin_to_events", lambda s, d: I.event_bins(_uneven(s, d), 3600.0, KEYS),
          with_(EV, UNEVEN) + """, nb AS (SELECT session, interval_id, CAST(floor((e - s) / 3600 + 1e-9) AS BIGINT) AS n FROM un), cu AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY interval_id) AS c FROM nb)
          SELECT session, interval_id, n AS n_bins, CASE WHEN n > 0 THEN CAST(c - n AS INTEGER) END AS start_index, CASE WHEN n > 0 THEN CAST(c - 1 AS INTEGER) END AS end_index, n > 0 AS valid FROM cu"""),
    Query("c5_threshold_runs", lambda s, d: _runs(s, d, "above", 60.0).select("session", "start", "end", "n"), with_(EV, RUNS.format(test="value > 60")) + 'SELECT session, s AS start, e AS "end", n FROM runs'),
    Query("c6_merge_close", lambda s, d: I.merge_close(_runs(s, d, "below", 30.0), 900.0, KEYS), with_(EV, RUNS.format(test="value < 30"), MERGE.format(gap=900)) + 'SELECT session, s AS start, e AS "end", parts FROM merged'),
    Query("c7_state_intervals", lambda s, d: I.state_intervals(_t_series(s, d), "value", 50.0, 1800.0, 3600.0, KEYS, order=["t", "event_id"]).select("session", "start", "end"),
          with_(EV, RUNS.format(test="value > 50"), MERGE.format(gap=1800)) + 'SELECT session, s AS start, e AS "end" FROM merged WHERE e - s > 3600'),
    _set_query("union", "ia OR ib"), _set_query("intersect", "ia AND ib"), _set_query("diff", "ia AND NOT ib"),
    Query("c9_states_to_intervals", lambda s, d: I.states_to_intervals(_t_series(s, d).withColumn("state", F.floor(F.col("value") / 20).cast("int")), "state", NAMES, KEYS, ["t", "event_id"]),
          with_(EV) + """, a AS (SELECT session, t, event_id, CAST(floor(value / 20) AS INTEGER) AS state FROM ev),
          b AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY session ORDER BY t, event_id) THEN 0 ELSE 1 END AS c FROM a),
          g AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM b)
          SELECT session, CASE state WHEN 0 THEN 'low' WHEN 2 THEN 'middle' ELSE 'high' END AS name, min(t) AS start, max(t) AS "end" FROM g WHERE state IN (0, 2, 4) GROUP BY session, g, state"""),
    Query("c10_events_by_state", lambda s, d: I.events_by_state(events(s, d).where("unit = 'purchase'").select("session", "t", F.col("unit").alias("kind")), half_days(s, d).withColumn("name", F.concat(F.lit("w"), F.pmod("interval_id", F.lit(7)))), KEYS).groupBy("event_state").agg(F.count(F.lit(1)).alias("n")),
          EV_IV + "SELECT unit || '_w' || (interval_id % 7) AS event_state, count(*) AS n FROM ev JOIN iv ON iv.session = ev.session AND t BETWEEN s AND e WHERE unit = 'purchase' GROUP BY 1"),
    Query("c11_interpolate_to", lambda s, d: rounded(I.interpolate_to(events(s, d), _targets(s, d), "value", KEYS), 4),
          with_(EV, ALIGN) + "SELECT session, t, round(CASE WHEN bt IS NULL THEN av WHEN at_ IS NULL OR at_ = bt THEN bv ELSE bv + (av - bv) * (t - bt) / (at_ - bt) END, 4) AS value FROM al"),
    Query("c12_nearest_to", lambda s, d: I.nearest_to(events(s, d), _targets(s, d), "value", KEYS),
          with_(EV, ALIGN) + "SELECT session, t, CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt <= at_ - t) THEN bv ELSE av END AS value FROM al"),
    Query("c14_mean_in_intervals", lambda s, d: rounded(I.mean_in_intervals(events(s, d), half_days(s, d), ["value", "k"], KEYS)),
          EV_IV + "SELECT ev.session, interval_id, round(min(t), 6) AS t, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM ev JOIN iv ON iv.session = ev.session AND t BETWEEN s AND e GROUP BY 1, 2"),
    Query("c15_count_points", lambda s, d: I.count_points(events(s, d).where("unit = 'purchase'").select("session", "t"), half_days(s, d), KEYS),
          EV_IV + "SELECT iv.session, interval_id, count(t) AS n FROM iv LEFT JOIN (SELECT * FROM ev WHERE unit = 'purchase') p ON iv.session = p.session AND t BETWEEN s AND e GROUP BY 1, 2"),
    Query("c16_label_by_epoch", lambda s, d: I.label_by_epoch(events(s, d), _epochs(s, d), KEYS, ["event_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
          EV_IV + """, x AS (SELECT event_id, bool_or(t BETWEEN s AND e) AS a, bool_or(interval_id % 3 = 0 AND t BETWEEN s + 21600 AND e + 10800) AS b FROM ev JOIN iv USING (session) GROUP BY 1)
          SELECT CASE WHEN b THEN 'third' WHEN a THEN 'early' ELSE 'unknown' END AS label, count(*) AS n FROM x GROUP BY 1"""),
    Query("c17_threshold_crossings", lambda s, d: I.threshold_crossings(events(s, d).withColumn("trial", F.floor((F.col("t") - tables.T0) / 86400).cast("int")), "value", 50.0, 20.0, "arrival", KEYS, "trial", ["t", "event_id"]),
          with_(EV) + """, x AS (SELECT session, CAST(floor((t - 1704067200e0) / 86400) AS INTEGER) AS trial, t, value, lead(value) OVER (PARTITION BY session, CAST(floor((t - 1704067200e0) / 86400) AS INTEGER) ORDER BY t, event_id) AS nx FROM ev)
          SELECT session, trial, min(t) AS t FROM x WHERE value BETWEEN 30 AND 50 AND nx > 50 AND nx <= 70 GROUP BY 1, 2"""),
    Query("c18_arrival_times", lambda s, d: I.arrival_times(_t_series(s, d), "value", 40.0, 60.0, KEYS, order=["t", "event_id"]), with_(EV, RUNS.format(test="value BETWEEN 40 AND 60")) + "SELECT session, s AS t FROM runs"),
    Query("d1_gaussian_smooth", lambda s, d: rounded(_smooth(s, d).select("session", "bin", "rate")), with_(EV, HC, SMOOTH) + "SELECT session, bin, round(rate, 6) AS rate FROM sm"),
    Query("d2_derivative", lambda s, d: rounded(_derivative(s, d)),
          with_(EV, SIG) + """, x AS (SELECT session, bin, coalesce(lag(bin) OVER w, bin) AS b0, coalesce(lag(value) OVER w, value) AS v0, coalesce(lead(bin) OVER w, bin) AS b1, coalesce(lead(value) OVER w, value) AS v1 FROM sig WINDOW w AS (PARTITION BY session ORDER BY bin))
          SELECT session, bin, round((v1 - v0) / nullif(b1 - b0, 0), 6) + 0.0 AS slope FROM x"""),
    Query("d3_zscore_with_baseline", lambda s, d: rounded(_zscore(s, d).select("session", "bin", "z")), with_(EV, IV, HC, SMOOTH, ZS) + "SELECT session, bin, round(z, 6) + 0.0 AS z FROM z"),
    Query("d4_population_rate", lambda s, d: S.population_rate(events(s, d), half_days(s, d), 1800.0, KEYS).groupBy("session", "interval_id").agg(F.sum("n").alias("n"), F.max("n").alias("most")),
          EV_IV + """, c AS (SELECT ev.session, interval_id, floor((t - s) / 1800) AS bin, count(*) AS n FROM ev JOIN iv ON iv.session = ev.session AND t >= s AND t < e GROUP BY ALL)
          SELECT iv.session, iv.interval_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(max(n), 0) AS most FROM iv LEFT JOIN c USING (session, interval_id) GROUP BY 1, 2"""),
    Query("d5_detect_bursts", lambda s, d: rounded(_bursts(s, d)),
          with_(EV, HC, SMOOTH) + """, zz AS (SELECT session, bin, (rate - avg(rate) OVER w) / stddev_pop(rate) OVER w AS z FROM sm WINDOW w AS (PARTITION BY session)),
          a AS (SELECT *, z > 0 AND NOT coalesce(lag(z > 0) OVER (PARTITION BY session ORDER BY bin), false) AS b FROM zz), g AS (SELECT *, sum(b::INT) OVER (PARTITION BY session ORDER BY bin ROWS UNBOUNDED PRECEDING) AS g FROM a)
          SELECT session, 1704067200e0 + (min(bin) + 0.5) * 3600 AS start, 1704067200e0 + (max(bin) + 0.5) * 3600 AS "end", count(*) AS n, round(max(z), 6) AS peak FROM g WHERE z > 0 GROUP BY session, g HAVING max(z) > 1.5 AND (max(bin) - min(bin)) * 3600 BETWEEN 3600 AND 36000"""),
    Query("d6_ramp_onsets", lambda s, d: S.ramp_onsets(hourly_signal(s, d), "value", 3, 1.0, 0.05, KEYS).select("session", "bin")),
    Query("d8_angular_velocity", lambda s, d: rounded(_angular(s, d))),
    Query("d13_consecutive_euclidean", lambda s, d: rounded(_consecutive(s, d, "euclidean")),
          "SELECT vec_id, round(array_distance(CAST(embedding AS DOUBLE[64]), lag(CAST(embedding AS DOUBLE[64])) OVER (ORDER BY vec_id)), 6) AS distance FROM embeddings"),
    Query("d13_consecutive_cosine", lambda s, d: rounded(_consecutive(s, d, "cosine")),
          "SELECT vec_id, round(array_cosine_distance(CAST(embedding AS DOUBLE[64]), lag(CAST(embedding AS DOUBLE[64])) OVER (ORDER BY vec_id)), 6) AS distance FROM embeddings"),
    Query("e1_infer_categorical", lambda s, d: T.infer_categorical(events(s, d), ["value", "k"]),
          with_(EV) + "SELECT 'value' AS \"column\", bool_and(value = floor(value)) AS categorical FROM ev UNION ALL SELECT 'k', bool_and(k = floor(k)) FROM ev"),
    Query("e3_label_grid", lambda s, d: rounded(T.label_grid(events(s, d), "k", 10.0, categorical=True)),
          with_(EV) + "SELECT CAST(i AS BIGINT) AS edge_ix, round(lo + i * 10, 6) AS edge FROM (SELECT min(k) - 5 AS lo, max(k) + 5 AS hi FROM ev), range(100) r(i) WHERE lo + i * 10 <= hi + 1e-9"),
    Query("e4_digitize", lambda s, d: _label_bins(s, d).select("session", "bin", "flat"), with_(EV, LAB) + "SELECT session, bin, flat FROM lab"),
    Query("e5_occupancy", lambda s, d: _occupancy(s, d), with_(EV, LAB, OCC) + "SELECT flat, seconds FROM occ"),
    Query("e6_counts_by_bin", lambda s, d: T.counts_by_bin(hourly_counts(s, d), _label_bins(s, d), ["session", "bin"], "flat"), with_(EV, HC, LAB, CBB) + "SELECT flat, unit, CAST(n AS BIGINT) AS n FROM cbb"),
    Query("e7_smoothing_kernel", lambda s, d: rounded(_kernel(s, d)), with_(EV, LAB, OCC, KER) + "SELECT i, j, round(w, 6) AS w FROM ker"),
    Query("e8_tuning_by_label", lambda s, d: rounded(_tuning(s, d), 8),
          with_(EV, HC, LAB, OCC, CBB, KER) + """, f AS (SELECT occ.flat, u.unit, seconds, coalesce(n, 0) AS n FROM occ CROSS JOIN (SELECT DISTINCT unit FROM cbb) u LEFT JOIN cbb ON cbb.flat = occ.flat AND cbb.unit = u.unit),
          x AS (SELECT i AS flat, unit, sum(w * n) / sum(w * seconds) AS rate FROM f JOIN ker ON j = flat GROUP BY 1, 2)
          SELECT flat, unit, CASE WHEN seconds >= 7200 THEN round(rate, 8) END AS rate FROM x JOIN occ USING (flat)"""),
    Query("e9_grid_maps", lambda s, d: _grid_maps(s, d),
          """WITH a AS (SELECT DISTINCT CAST(p_size AS INTEGER) AS ix FROM part), b AS (SELECT CAST(n_nationkey AS INTEGER) AS ix FROM nation)
          SELECT 'a' AS maze, row_number() OVER (ORDER BY ix) - 1 AS flat_idx, ix, ix * 2e0 AS x, NULL AS y FROM a UNION ALL SELECT 'b', (SELECT count(*) FROM a) + row_number() OVER (ORDER BY ix) - 1, ix, NULL, ix * 3e0 FROM b"""),
    Query("seeds_permutation", lambda s, d: table(s, d, "nation").withColumn("all", F.lit(1)).select("n_nationkey", seeds.permuted_rank(["all"], "n_nationkey", F.lit("7")).alias("place")),
          "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CAST(('0x' || substr(md5('7|' || n_nationkey), 1, 8)) AS BIGINT), n_nationkey) AS INTEGER) AS place FROM nation"),
]

"""Intervals and points in time: joins, runs, set algebra, alignment. Times are seconds; `keys` are the columns of a series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], how: str = "inner", t: str = "t", start: str = "start", end: str = "end", block: float = 86400.0, right_open: bool = False) -> DataFrame:
    """points joined with the intervals that hold them (both ends included, or the right one not), keys and time block being equal.

    Intervals are repeated for the blocks that they touch, so the join is an equality join whatever the sizes.
    """
    dealt = intervals.withColumn("__block", F.explode(F.sequence(F.floor(F.col(start) / block).cast("long"), F.floor(F.col(end) / block).cast("long"))))
    for k in keys:
        dealt = dealt.withColumnRenamed(k, f"__{k}")
    p = points.withColumn("__pblock", F.floor(F.col(t) / block).cast("long"))
    last = F.col(t) < F.col(end) if right_open else F.col(t) <= F.col(end)
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys], (F.col("__pblock") == F.col("__block")) & (F.col(t) >= F.col(start)) & last)
    return p.join(dealt, cond, how).drop("__block", "__pblock", *(f"__{k}" for k in keys))


def restrict(points: DataFrame, intervals: DataFrame, keys: list[str], **more) -> DataFrame:
    """Points inside any interval, once each."""
    return interval_join(points, intervals.select(*keys, "start", "end"), keys, "left_semi", **more)


def in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: list[str], **more) -> DataFrame:
    """points with interval_id, the least of those that hold the point, or null."""
    found = interval_join(points, intervals.select(*keys, "interval_id", "start", "end"), keys, **more).groupBy(*point_id).agg(F.min("interval_id").alias("interval_id"))
    return points.join(found, point_id, "left")


def bins_of(intervals: DataFrame, dt: float) -> DataFrame:
    """intervals exploded to their full bins [start + i dt, start + (i + 1) dt): bin, t (the centre)."""
    n = F.floor((F.col("end") - F.col("start")) / dt + 1e-9).cast("long")
    return intervals.where(n > 0).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("t", F.col("start") + (F.col("bin") + 0.5) * dt)


def bins_in(intervals: DataFrame, dt: float, keys: list[str]) -> DataFrame:
    """keys, interval_id, n_bins: the full bins of each interval, 0 too."""
    n = F.floor((F.col("end") - F.col("start")) / dt + 1e-9).cast("long")
    return intervals.select(*keys, "interval_id", F.greatest(n, F.lit(0)).cast("long").alias("n_bins"))


def count_in_bins(spikes: DataFrame, intervals: DataFrame, dt: float, keys: list[str], units: DataFrame | None = None, block: float = 86400.0) -> DataFrame:
    """keys, interval_id, bin, unit, n of every bin and unit, zeros kept; without `units` only those that occur in spikes, by keys."""
    inside = interval_join(spikes, intervals.select(*keys, "interval_id", "start", "end"), keys, right_open=True, block=block)
    n = F.floor((F.col("end") - F.col("start")) / dt + 1e-9)
    counted = inside.withColumn("bin", F.floor((F.col("t") - F.col("start")) / dt).cast("long")).where(F.col("bin") < n).groupBy(*keys, "interval_id", "bin", "unit").agg(F.count(F.lit(1)).alias("n"))
    frame = bins_of(intervals.select(*keys, "interval_id", "start", "end"), dt).select(*keys, "interval_id", "bin")
    units = spikes.select(*keys, "unit").distinct() if units is None else units
    return frame.join(units, keys).join(counted, [*keys, "interval_id", "bin", "unit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def event_bins(intervals: DataFrame, dt: float, keys: list[str]) -> DataFrame:
    """Bins of event windows: row (of the series, in time), start_index and end_index (first and last row of the event), n_bins; events without a full bin come with valid false."""
    bins = bins_of(intervals, dt).withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("interval_id", "bin")) - 1)
    spans = bins.groupBy(*keys, "interval_id").agg(F.count(F.lit(1)).alias("n_bins"), F.min("row").alias("start_index"), F.max("row").alias("end_index"))
    return intervals.select(*keys, "interval_id").join(spans, [*keys, "interval_id"], "left").withColumns({"n_bins": F.coalesce("n_bins", F.lit(0)), "valid": F.col("n_bins").isNotNull()})


def runs(series: DataFrame, passes: Column, keys: list[str], t: str = "t", aggregates: list[Column] | None = None, order: list[str] | None = None, block: float = B.BLOCK) -> DataFrame:
    """Maximal runs of consecutive rows that pass: keys, run, start, end (first and last time), n, and `aggregates`. A missing test fails. Rows are gone through a block of time at a time; runs go on over its ends."""
    flagged = B.cut(series, t, block).withColumn("__in", F.coalesce(passes, F.lit(False)))
    numbered = B.run_numbers(flagged, "__in", F.col("__in"), keys, order or [t], "run").where("__in")
    return numbered.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"), *(aggregates or []))


def runs_in_blocks(series: DataFrame, passes: Column, keys: list[str], block: float, t: str = "t", order: list[str] | None = None) -> DataFrame:
    """What runs gives (keys, start, end, n), its blocks' length given."""
    return runs(series, passes, keys, t, None, order, block).drop("run")


def threshold_runs(series: DataFrame, value: str, threshold: float, method: str, keys: list[str], **more) -> DataFrame:
    """runs of rows above, below, aboveequal or belowequal a threshold."""
    v = F.col(value)
    test = {"above": v > threshold, "below": v < threshold, "aboveequal": v >= threshold, "belowequal": v <= threshold}[method]
    return runs(series, test, keys, **more)


def merge_close(intervals: DataFrame, gap: float, keys: list[str], block: float = B.BLOCK) -> DataFrame:
    """Intervals joined where less than `gap` lies between them: keys, start, end, parts. Inside blocks of time first, then what that leaves."""

    def merged(x: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start", "end")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = x.withColumn("__new", F.when(reach.isNull() | (F.col("start") - reach >= gap), 1).otherwise(0))
        return marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("parts").alias("parts")).drop("__g")

    local = merged(B.cut(intervals, "start", block).select(*keys, "__block", "start", "end", F.lit(1).cast("long").alias("parts")), [*keys, "__block"])
    return merged(local.drop("__block"), keys)


def state_intervals(series: DataFrame, value: str, threshold: float, gap: float, longer_than: float, keys: list[str], **more) -> DataFrame:
    """Runs above the threshold, close ones joined, those longer than `longer_than`."""
    return merge_close(threshold_runs(series, value, threshold, "above", keys, **more), gap, keys).where(F.col("end") - F.col("start") > longer_than)


def set_operation(a: DataFrame, b: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """Union, intersection or difference of two interval sets by a sweep over their edges; spans of no length are dropped."""
    def edges(x: DataFrame, side: str) -> DataFrame:
        at = lambda c, v: x.select(*keys, F.col(c).alias("at"), F.lit(v if side == "a" else 0).alias("da"), F.lit(v if side == "b" else 0).alias("db"))
        return at("start", 1).unionByName(at("end", -1))

    steps = edges(a, "a").unionByName(edges(b, "b")).groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = steps.withColumns({"in_a": F.sum("da").over(so_far) > 0, "in_b": F.sum("db").over(so_far) > 0, "next": F.lead("at").over(w)}).where("next is not null")
    keep = {"union": F.col("in_a") | F.col("in_b"), "intersect": F.col("in_a") & F.col("in_b"), "diff": F.col("in_a") & ~F.col("in_b")}[op]
    spans = spans.withColumn("keep", keep)
    begins = (F.col("keep") & ~F.coalesce(F.lag("keep").over(w), F.lit(False))).cast("int")
    return spans.withColumn("__b", begins).withColumn("__g", F.sum("__b").over(so_far)).where("keep").groupBy(*keys, "__g").agg(F.min("at").alias("start"), F.max("next").alias("end")).drop("__g")


def states_to_intervals(series: DataFrame, state: str, names: dict[int, str], keys: list[str], order: list[str] | None = None, block: float = B.BLOCK) -> DataFrame:
    """Runs of equal state, by the state's name; states without a name are left out."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    numbered = B.run_numbers(B.cut(series, "t", block), state, F.lit(True), keys, order or ["t"], "__g")
    return numbered.withColumn("name", table[F.col(state)]).where("name is not null").groupBy(*keys, "name", "__g").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("__g")


def events_by_state(events: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """events with `kind_name` for each named interval that holds them."""
    return interval_join(events, intervals.select(*keys, "name", "start", "end"), keys).withColumn("event_state", F.concat_ws("_", "kind", "name")).drop("name", "start", "end")


def neighbours(signal: DataFrame, targets: DataFrame, value: str, keys: list[str], block: float = B.BLOCK) -> DataFrame:
    """keys, t of each target with the samples before (or at) and after (or at) it: bt, bv, at, av. Of samples at one time the least by value counts.

    Targets and samples meet in blocks of time; the last sample of the blocks before and the first of those behind are copied into each block.
    """
    sample = F.struct(F.col("t").alias("t"), F.col(value).alias("v"))
    one = B.cut(signal.groupBy(*keys, "t").agg(F.min(value).alias(value)), "t", block)
    asked = B.cut(targets.select(*keys, "t").distinct(), "t", block)
    ends = one.groupBy(*keys, "__block").agg(F.min_by(sample, "t").alias("first"), F.max_by(sample, "t").alias("last"))
    every = ends.unionByName(asked.select(*keys, "__block").distinct().withColumns({"first": F.lit(None).cast(ends.schema["first"].dataType), "last": F.lit(None).cast(ends.schema["last"].dataType)}))
    line = every.groupBy(*keys, "__block").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    back = F.last("last", True).over(B.before(keys))
    ahead = F.first("first", True).over(B.line(keys).rowsBetween(1, Window.unboundedFollowing))
    halo = line.select(*keys, "__block", back.alias("__l"), ahead.alias("__r")).select(*keys, "__block", F.explode(F.array_compact(F.array("__l", "__r"))).alias("__s")).select(*keys, F.col("__s.t").alias("t"), "__block", "__s")
    none = F.lit(None).cast(ends.schema["first"].dataType)
    both = asked.withColumns({"__s": none, "__q": F.lit(1)}).unionByName(one.select(*keys, "t", "__block", sample.alias("__s"), F.lit(0).alias("__q"))).unionByName(halo.withColumn("__q", F.lit(0)))
    up_to, from_on = (B.inside(keys, [o, "__q"]).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("t"), F.desc("t")))
    both = both.withColumns({"__b": F.last("__s", True).over(up_to), "__a": F.last("__s", True).over(from_on)})
    return both.where("__q = 1").select(*keys, "t", F.col("__b.t").alias("bt"), F.col("__b.v").alias("bv"), F.col("__a.t").alias("at"), F.col("__a.v").alias("av"))


def interpolate_to(signal: DataFrame, targets: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, t, value: linear between the samples around, the end samples beyond them."""
    line = F.col("bv") + (F.col("av") - F.col("bv")) * (F.col("t") - F.col("bt")) / (F.col("at") - F.col("bt"))
    found = F.when(F.col("bt").isNull(), F.col("av")).when(F.col("at").isNull() | (F.col("at") == F.col("bt")), F.col("bv")).otherwise(line)
    return neighbours(signal, targets, value, keys).select(*keys, "t", found.alias(value))


def nearest_to(signal: DataFrame, targets: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, t, value of the nearest sample, the earlier of two as near."""
    before = F.col("at").isNull() | (F.col("t") - F.col("bt") <= F.col("at") - F.col("t"))
    return neighbours(signal, targets, value, keys).select(*keys, "t", F.when(F.col("bt").isNotNull() & before, F.col("bv")).otherwise(F.col("av")).alias(value))


def value_from(signal: DataFrame, bins: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """bins (keys, bin, t) with the value of the sample nearest to each bin's t, the earlier of two as near."""
    return bins.join(nearest_to(signal, bins.select(*keys, "t"), value, keys), [*keys, "t"])


def event_phase(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """points with phase, (t - start) / (end - start), for each interval that holds them."""
    held = interval_join(points, intervals.select(*keys, "start", "end"), keys)
    return held.withColumn("phase", (F.col("t") - F.col("start")) / (F.col("end") - F.col("start"))).drop("start", "end")


def select_units(rows: DataFrame, units: DataFrame, on: list[str] | None = None) -> DataFrame:
    """rows of the units that are listed, by `unit` or the given columns."""
    return rows.join(units.select(*(on or ["unit"])).distinct(), on or ["unit"], "left_semi")


def fitting_block(intervals: DataFrame, least: float = 1e-3) -> float:
    """A time block for interval_join: twice the mean length of the intervals, so that an interval touches two blocks or so and points meet few others. One aggregate."""
    mean = intervals.agg(F.avg(F.col("end") - F.col("start"))).first()[0]
    return max(least, 2 * float(mean or 0.0))


def mean_in_intervals(points: DataFrame, intervals: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """keys, interval_id, t (first sample), mean of each value; intervals without samples are dropped."""
    return interval_join(points, intervals.select(*keys, "interval_id", "start", "end"), keys).groupBy(*keys, "interval_id").agg(F.min("t").alias("t"), *(F.avg(v).alias(v) for v in values))


def count_points(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """intervals (keys, interval_id) with the number of points in them, zeros kept."""
    n = interval_join(points, intervals.select(*keys, "interval_id", "start", "end"), keys).groupBy(*keys, "interval_id").agg(F.count(F.lit(1)).alias("n"))
    return intervals.select(*keys, "interval_id").join(n, [*keys, "interval_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def label_by_epoch(points: DataFrame, epochs: DataFrame, keys: list[str], point_id: list[str], unknown: str = "unknown") -> DataFrame:
    """point_id with the name of the epoch of the highest priority that holds the point, else `unknown`."""
    found = interval_join(points, epochs.select(*keys, "name", "priority", "start", "end"), keys).groupBy(*point_id).agg(F.max_by("name", "priority").alias("label"))
    return points.select(*point_id).join(found, point_id, "left").withColumn("label", F.coalesce("label", F.lit(unknown)))


def threshold_crossings(trials: DataFrame, value: str, point: float, tolerance: float, which: str, keys: list[str], trial: str, order: list[str] | None = None) -> DataFrame:
    """Per trial the first (arrival) or last (departure) time at which value goes from [point - tolerance, point] to (point, point + tolerance]."""
    w = Window.partitionBy(*keys, trial).orderBy(*(order or ["t"]))
    v, after = F.col(value), F.lead(value).over(w)
    hit = (v >= point - tolerance) & (v <= point) & (after > point) & (after <= point + tolerance)
    pick = F.min("t") if which == "arrival" else F.max("t")
    return trials.withColumn("__h", hit).where("__h").groupBy(*keys, trial).agg(pick.alias("t"))


def arrival_times(series: DataFrame, value: str, low: float, high: float, keys: list[str], **more) -> DataFrame:
    """Start of each run inside [low, high]."""
    return runs(series, (F.col(value) >= low) & (F.col(value) <= high), keys, **more).select(*keys, F.col("start").alias("t"))

"""What latents stand for: epochs, positions, sequences, jumps and their agreement between chains."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.seeds import hash_number
from latentspark.sources.shared import passing, saved

from .graphs import components
from .perievent import peri_event


def mean_latent_per_epoch(posterior: DataFrame, epoch: str = "label") -> DataFrame:
    return posterior.groupBy(epoch, "latent").agg(F.avg("p").alias("mean"))


def classify_latents(means: DataFrame, threshold: float | dict[str, float], epoch: str = "label") -> DataFrame:
    """latent, kind, score: the epoch with the largest share of a latent's mean if it is at least the threshold (one for all, or one for each epoch), else `unclassified`."""
    share = means.withColumn("score", F.col("mean") / F.sum("mean").over(Window.partitionBy("latent")))
    best = share.groupBy("latent").agg(F.max_by(epoch, F.struct("score", F.col(epoch))).alias("kind"), F.max("score").alias("score"))
    return best.withColumn("kind", F.when(F.col("score") >= (threshold if not isinstance(threshold, dict) else F.create_map(*(F.lit(x) for kv in threshold.items() for x in kv))[F.col("kind")]), F.col("kind")).otherwise("unclassified"))


def with_level(rows: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """rows with level: k for values in [levels[k - 1], levels[k])."""
    return rows.withColumn("level", reduce(lambda a, x: a + (F.col(value) >= x).cast("int"), levels, F.lit(0)))


def occurrence_by_level(rows: DataFrame, latent: str, value: str, levels: list[float]) -> DataFrame:
    """latent, level, n of rows with_level."""
    return with_level(rows, value, levels).groupBy(latent, "level").agg(F.count(F.lit(1)).alias("n"))


def classify_spatial(rows: DataFrame, latent: str, speed: str, away: str, fast: float, far: float, least_total: int, least_run: int, least_off: int) -> DataFrame:
    """latent, kind: spatial with more than least_run fast rows, else immobility; off_maze, the last rule, with more than least_off fast rows further than far. Latents with least_total rows or fewer are left out."""
    fast_row = F.col(speed) > fast
    n = rows.groupBy(latent).agg(F.count(F.lit(1)).alias("total"), F.sum(fast_row.cast("int")).alias("run"), F.sum((fast_row & (F.col(away) > far)).cast("int")).alias("off"))
    kind = F.when(F.col("off") > least_off, "off_maze").when(F.col("run") > least_run, "spatial").otherwise("immobility")
    return n.where(F.col("total") > least_total).withColumn("kind", kind)


#: Side of a tile in units of eps.
TILE = 32


def _near_in_tile(x: np.ndarray, eps: float):
    """For each point the indexes of the points of x within eps, itself too; x is a tile with its halo."""
    cell = np.floor(x / eps).astype(np.int64)
    cell -= cell.min(0) - 1
    width = int(cell[:, 1].max()) + 2
    name = cell[:, 0] * width + cell[:, 1]
    order = np.argsort(name, kind="stable")
    held = name[order]
    around = np.array([p * width + q for p in (-1, 0, 1) for q in (-1, 0, 1)])
    for i in range(len(x)):
        lo, hi = np.searchsorted(held, name[i] + around), np.searchsorted(held, name[i] + around, "right")
        near = np.concatenate([order[u:v] for u, v in zip(lo, hi, strict=True)])
        yield near[((x[near] - x[i]) ** 2).sum(1) <= eps * eps]


def dbscan_per_latent(rows: DataFrame, latent: str, eps: float, least: int, keys: list[str] | None = None) -> DataFrame:
    """keys, latent, bin, cluster of the points x, y of each latent within keys; -1 for noise, and for points without finite coordinates. Clusters are
    numbered by the bin of their first core point; a point that several clusters reach belongs to the first of them.

    The plane is dealt into tiles with a halo of eps, so no task holds a latent. A tile counts its points' neighbours (points at one place count as often as they
    are there), then joins core points, its halo's too; clusters that run over tiles' borders are joined by the components of a graph of the tiles' clusters.
    The result stays until the application ends.
    """
    by, spark, side = [*(keys or []), latent], rows.sparkSession, TILE * eps
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    placed = rows.select(*by, "bin", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    with passing(spark) as save:
        points = save(placed.where(fine("x") & fine("y")).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w"), F.min("bin").alias("first")).withColumn("pid", F.monotonically_increasing_id()))

        def dealt(p: DataFrame) -> DataFrame:
            """Each point in its tile and in those within eps of it."""
            over = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d * eps) / side).cast("long") for d in (-1, 0, 1))))
            return p.withColumn("__a", F.explode(over("x"))).withColumn("__b", F.explode(over("y"))).withColumn("own", (F.col("__a") == tile("x")) & (F.col("__b") == tile("y")))

        def count(g: pd.DataFrame) -> pd.DataFrame:
            w, own = g["w"].to_numpy(), g["own"].to_numpy()
            total = np.array([w[near].sum() for near in _near_in_tile(g[["x", "y"]].to_numpy(), eps)])
            return pd.DataFrame({"pid": g["pid"][own], "core": total[own] >= least})

        def join(g: pd.DataFrame) -> pd.DataFrame:
            pid, core, own, out = g["pid"].to_numpy(), g["core"].to_numpy(), g["own"].to_numpy(), []
            near = [n[core[n]] for n in _near_in_tile(g[["x", "y"]].to_numpy(), eps)]
            root = np.arange(len(g))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in np.flatnonzero(core):
                for j in near[i]:
                    root[top(int(j))] = top(int(i))
            for i in range(len(g)):
                if core[i]:
                    out.append((pid[i], pid[top(i)], True))
                elif own[i]:
                    out += [(pid[i], p, False) for p in {pid[top(int(j))] for j in near[i]}]
            return pd.DataFrame(out, columns=["pid", "root", "core"])

        group = [*by, "__a", "__b"]
        cores = save(dealt(points).groupBy(*group).applyInPandas(count, "pid long, core boolean"))
        reached = save(dealt(points.join(cores, "pid")).groupBy(*group).applyInPandas(join, "pid long, root long, core boolean"))
        # a core point that several tiles see ties their clusters together
        ties = reached.where("core").groupBy("pid").agg(F.collect_set("root").alias("r")).where(F.size("r") > 1).select(F.array_min("r").alias("a"), F.explode("r").alias("b")).where("a != b")
        joined = components(ties, save)
        named = save(reached.join(joined.withColumnRenamed("node", "root"), "root", "left").select("pid", "core", F.coalesce("comp", "root").alias("cluster_id")).distinct())
        begins = named.where("core").join(points, "pid").groupBy(*by, "cluster_id").agg(F.min("first").alias("__f"))
        number = begins.withColumn("cluster", F.row_number().over(Window.partitionBy(*by).orderBy("__f", "cluster_id")) - 1)  # a row for each cluster
        of_point = named.join(number.select("cluster_id", "cluster"), "cluster_id").groupBy("pid").agg(F.min("cluster").alias("cluster"))
        known = points.join(of_point, "pid").select(*by, "x", "y", F.col("cluster").cast("long").alias("cluster"))
        out = saved(placed.join(known, [*by, "x", "y"], "left").select(*by, "bin", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")))
    return out


def field_properties(rows: DataFrame, by: list[str], value: str, early, late) -> DataFrame:
    """by, n, mean, std, early and late means and their difference; cluster -1 must be dropped before."""
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(F.when(early, F.col(value))).alias("early"), F.avg(F.when(late, F.col(value))).alias("late"))
    return agg.withColumn("change", F.col("late") - F.col("early"))


def circular_stats(df: DataFrame, value: str, low: float, high: float, keys: list[str]) -> DataFrame:
    """keys, mean, std of a variable that wraps around [low, high]."""
    span = high - low
    angle = (F.col(value) - low) / span * (2 * np.pi)
    g = df.groupBy(*keys).agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    return g.select(*keys, (F.pmod(F.atan2("s", "c"), F.lit(2 * np.pi)) / (2 * np.pi) * span + low).alias("mean"), (F.sqrt(-2 * F.log(F.least(r, F.lit(1.0)))) / (2 * np.pi) * span).alias("std"))


def circular_diff(a, b, low: float, high: float):
    """a - b on a variable that wraps around [low, high]: the shorter way, from -span / 2 to below span / 2."""
    span = float(high - low)
    return F.pmod(a - b + F.lit(span / 2), F.lit(span)) - F.lit(span / 2)


def latent_in_range(rows: DataFrame, latent: str, arm: str, value: str, low: float, high: float) -> DataFrame:
    """latent, arm, n (rows with the value in range), frac (of the latent's rows in that arm), share (of the latent's rows in range over arms)."""
    inside = F.col(value).between(low, high).cast("int")
    g = rows.groupBy(latent, arm).agg(F.sum(inside).alias("n"), F.avg(inside.cast("double")).alias("frac"))
    total = F.sum("n").over(Window.partitionBy(latent))
    return g.withColumn("share", F.when(total > 0, F.col("n") / total))


def sided_latents(ranges: DataFrame, latent: str, frac: float, total: int) -> DataFrame:
    """latent, arms (1 or 2) that have more than `frac` of their rows in range and more than `total` of them."""
    return ranges.where((F.col("frac") > frac) & (F.col("n") > total)).groupBy(latent).agg(F.count(F.lit(1)).alias("arms")).where("arms <= 2")


def sequence_occurrence(rows: DataFrame, latent: str, sequence: list[int], tolerance: int, keys: list[str]) -> DataFrame:
    """keys, bin where the latent follows the sequence within the tolerance."""
    w = Window.partitionBy(*keys).orderBy("bin")
    hit = reduce(lambda a, b: a & b, [F.abs((F.lead(latent, k).over(w) if k else F.col(latent)) - s) <= tolerance for k, s in enumerate(sequence)])
    return rows.withColumn("__h", hit).where("__h").select(*keys, "bin")


def latent_pairs(rows: DataFrame, latent: str, pairs: list[tuple[int, int]], tolerance: int, keys: list[str]) -> DataFrame:
    """keys, a, b, bin where the step into bin matches a listed pair within the tolerance."""
    before = F.lag(latent).over(Window.partitionBy(*keys).orderBy("bin"))
    listed = F.broadcast(rows.sparkSession.createDataFrame(pairs, "a int, b int"))  # a parameter
    return rows.withColumn("__p", before).join(listed, (F.abs(F.col("__p") - F.col("a")) <= tolerance) & (F.abs(F.col(latent) - F.col("b")) <= tolerance)).select(*keys, "a", "b", "bin")


def contrast_projection(counts: DataFrame, tuning: DataFrame, before: int, after: int, window: int, keys: list[str]) -> DataFrame:
    """keys, bin, projection of counts on the unit vector from the mean tuning around `before` to that around `after`."""
    near = lambda at: F.avg(F.when(F.abs(F.col("latent") - at) <= window, F.col("rate")))
    axis = tuning.groupBy("unit").agg((near(after) - near(before)).alias("a"))
    unit = axis.withColumn("a", F.col("a") / F.sqrt(F.sum(F.col("a") ** 2).over(Window.partitionBy(F.lit(0)))))
    return counts.join(F.broadcast(unit), "unit").groupBy(*keys, "bin").agg(F.sum(F.col("n") * F.col("a")).alias("projection"))


def jump_consensus(chains: DataFrame, reference: int, window: int, threshold: float, share: float, closed: bool = False) -> DataFrame:
    """bin, agreeing (share of other chains with any p > threshold in [bin - window, bin + window), or up to it if closed), consensus, of the reference's bins with p >= threshold. Windows that reach below bin 0 are cut there."""
    jumps = chains.where((F.col("chain") == reference) & (F.col("p") >= threshold)).select("bin")
    others = chains.where(F.col("chain") != reference)
    many = others.select("chain").distinct()
    reach = F.sequence(F.lit(-window), F.lit(window if closed else window - 1))
    asked = jumps.withColumn("at", F.explode(reach)).withColumn("at", F.col("at") + F.col("bin"))
    hit = asked.join(others.where(F.col("p") > threshold).select(F.col("bin").alias("at"), "chain"), "at").select("bin", "chain").distinct().groupBy("bin").agg(F.count(F.lit(1)).alias("k"))
    n = many.agg(F.count(F.lit(1)).alias("n"))
    out = jumps.join(hit, "bin", "left").join(F.broadcast(n), F.lit(True)).withColumn("agreeing", F.coalesce("k", F.lit(0)) / F.col("n"))
    return out.select("bin", "agreeing", (F.col("agreeing") >= share).alias("consensus"))


def jump_consensus_shuffle(chains: DataFrame, reference: int, window: int, threshold: float, share: float, n_shuffles: int) -> DataFrame:
    """shuffle, fraction of consensus when each other chain is rolled by its own hashed shift; windows are closed on both sides."""
    n = chains.groupBy("chain").agg((F.max("bin") + 1).alias("__n"))
    rolled = chains.join(F.broadcast(n), "chain").withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles))))
    shift = F.pmod(hash_number(F.col("shuffle").cast("string"), F.col("chain").cast("string")), F.col("__n"))
    others = rolled.where(F.col("chain") != reference).withColumn("bin", F.pmod(F.col("bin") + shift, F.col("__n"))).where(F.col("p") > threshold).select("shuffle", "chain", F.col("bin").alias("at"))
    jumps = chains.where((F.col("chain") == reference) & (F.col("p") >= threshold)).select("bin")
    asked = jumps.withColumn("o", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("at", F.col("bin") + F.col("o"))
    hit = asked.join(others, "at").select("shuffle", "bin", "chain").distinct().groupBy("shuffle", "bin").agg(F.count(F.lit(1)).alias("k"))
    total = chains.where(F.col("chain") != reference).select("chain").distinct().agg(F.count(F.lit(1)).alias("n"))
    frame = jumps.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles))))
    all_rows = frame.join(hit, ["shuffle", "bin"], "left").join(F.broadcast(total), F.lit(True))
    return all_rows.groupBy("shuffle").agg(F.avg((F.coalesce("k", F.lit(0)) / F.col("n") >= share).cast("double")).alias("fraction"))


def consensus_null_summary(fractions: DataFrame) -> DataFrame:
    """One row: low, high (2.5 and 97.5 %), mean, std (population) of the fractions of jump_consensus_shuffle."""
    return fractions.agg(F.percentile("fraction", 0.025).alias("low"), F.percentile("fraction", 0.975).alias("high"), F.avg("fraction").alias("mean"), F.stddev_pop("fraction").alias("std"))


def jump_triggered_features(rows: DataFrame, latent: str, features: DataFrame, counts: DataFrame, tuning: DataFrame, pair: tuple[int, int], tolerance: int, reach: int, keys: list[str]) -> DataFrame:
    """keys, feature, event_bin, rel, y: features (keys, feature, bin, value), and the projection of counts on the contrast of the pair, around each step between the pair of latents."""
    projected = contrast_projection(counts, tuning, *pair, tolerance, keys).select(*keys, F.lit("projection").alias("feature"), "bin", F.col("projection").alias("value"))
    series = features.select(*keys, "feature", "bin", F.col("value").cast("double").alias("value")).unionByName(projected)
    steps = latent_pairs(rows, latent, [pair], tolerance, keys).select(*keys, F.col("bin").alias("event_bin")).distinct()
    return peri_event(series, steps.join(series.select(*keys, "feature").distinct(), keys), reach, [*keys, "feature"])


def null_contrast_projection(steps: DataFrame, rows: DataFrame, latent: str, counts: DataFrame, tuning: DataFrame, window: int, reach: int, keys: list[str]) -> DataFrame:
    """keys, event_bin, a, b, rel, y: counts around each step (keys, event_bin, as null_steps gives them), projected on the unit vector from the mean tuning around the latent before the step, a, to that around the one behind, b."""
    before = rows.select(*keys, F.col("bin").alias("event_bin"), F.col(latent).alias("b"), F.lag(latent).over(Window.partitionBy(*keys).orderBy("bin")).alias("a"))
    named = steps.join(before, [*keys, "event_bin"]).where("a is not null")
    near = lambda c: F.avg(F.when(F.abs(F.col("latent") - F.col(c)) <= window, F.col("rate")))
    axis = named.select("a", "b").distinct().join(F.broadcast(tuning), F.lit(True)).groupBy("a", "b", "unit").agg((near("b") - near("a")).alias("w"))
    axis = axis.withColumn("w", F.col("w") / F.nullif(F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy("a", "b"))), F.lit(0.0)))
    table = peri_event(counts.select(*keys, "unit", "bin", F.col("n").alias("value")), named.join(counts.select(*keys, "unit").distinct(), keys), reach, [*keys, "unit"], ["a", "b"])
    return table.join(axis, ["a", "b", "unit"]).groupBy(*keys, "event_bin", "a", "b", "rel").agg(F.sum(F.col("y") * F.col("w")).alias("y"))


def jump_triggered(rows: DataFrame, latent: str, series: DataFrame, pair: tuple[int, int], tolerance: int, reach: int, keys: list[str]) -> DataFrame:
    """keys, event_bin, rel, y: a series (keys, bin, value) around each step between a pair of latents."""
    steps = latent_pairs(rows, latent, [pair], tolerance, keys).select(*keys, F.col("bin").alias("event_bin")).distinct()
    return peri_event(series, steps, reach, keys)


def null_steps(rows: DataFrame, latent: str, chains: DataFrame, threshold: float, most: int, keys: list[str], seed: int = 0) -> DataFrame:
    """keys, event_bin of at most `most` changes of the latent in each series, drawn by hash, at bins where no chain's p is above the threshold."""
    w = Window.partitionBy(*keys).orderBy("bin")
    changes = rows.withColumn("__p", F.lag(latent).over(w)).where(F.col("__p").isNotNull() & (F.col("__p") != F.col(latent))).select(*keys, "bin")
    calm = changes.join(chains.where(F.col("p") > threshold).select("bin").distinct(), "bin", "left_anti")
    draw = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_number(F.lit(str(seed)), *(F.col(k).cast("string") for k in [*keys, "bin"])), "bin"))
    return calm.withColumn("__r", draw).where(F.col("__r") <= most).select(*keys, F.col("bin").alias("event_bin"))

"""Windows over series in time order, a block of time at a time: no window holds a whole series.

A series is cut into blocks of its order column. What a row needs from before its block (a running sum, a running maximum, the row before) or
behind it comes from one row for each block, over which alone a window runs by series. Each function names the columns it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block in units of the order column (seconds of a time, rows of a bin number): a day of seconds. It changes how a job is dealt, never its result.
BLOCK = 86400.0
#: Rows in a block of `halo`, beside the rows copied in.
ROWS = 65536


def cut(series: DataFrame, t: str, block: float = BLOCK) -> DataFrame:
    """series with __block."""
    return series.withColumn("__block", F.floor(F.col(t) / block).cast("long"))


def inside(keys: list[str], order: list) -> object:
    """The window of a block."""
    return Window.partitionBy(*keys, "__block").orderBy(*order)


def carried(series: DataFrame, keys: list[str], **carry: tuple[Column, Column]) -> DataFrame:
    """series (with __block) with a column for each name in carry: (how a block is summed up, a window expression over blocks in order, of the column `name`)."""
    per_block = series.groupBy(*keys, "__block").agg(*(summed.alias(name) for name, (summed, _) in carry.items()))
    known = per_block.select(*keys, "__block", *(over.alias(name) for name, (_, over) in carry.items()))
    return series.join(known, [*keys, "__block"])


def line(keys: list[str]):
    """The window over a series' blocks."""
    return Window.partitionBy(*keys).orderBy("__block")


def before(keys: list[str]):
    return line(keys).rowsBetween(Window.unboundedPreceding, -1)


def run_numbers(series: DataFrame, value: str, counts: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """series (with __block) with `name`, the number of its run of equal, known values; a run whose rows don't count has the number of the last one that does.

    Runs are numbered inside blocks; one row for each block says how many begin in it, and whether its first one goes on from the block before.
    """
    w = inside(keys, order)
    same = F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))
    first = F.row_number().over(w) == 1
    local = series.withColumns({"__new": (counts & ~same).cast("int"), "__first": first}).withColumn("__v", F.struct(F.col(value).alias("v")))
    goes_on = F.max(F.when(F.col("__first") & counts, F.struct(F.col(value).alias("v"))))
    per_block = local.groupBy(*keys, "__block").agg(F.sum("__new").alias("__begin"), goes_on.alias("__head"), F.max_by("__v", F.struct(*order)).alias("__tail"))
    joins = F.coalesce(F.col("__head.v") == F.lag("__tail").over(line(keys))["v"], F.lit(False)).cast("int")
    shift = per_block.withColumn("__joins", joins).withColumn("__before", F.coalesce(F.sum(F.col("__begin") - F.col("__joins")).over(before(keys)), F.lit(0)) - F.col("__joins"))
    numbered = local.join(shift.select(*keys, "__block", "__before"), [*keys, "__block"])
    return numbered.withColumn(name, F.col("__before") + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "__first", "__v", "__before")


def row_numbers(series: DataFrame, keys: list[str], t: str, name: str, block: float = BLOCK, order: list[str] | None = None) -> DataFrame:
    """series with `name`, 0, 1, 2, ... in order within keys."""
    counted = carried(cut(series, t, block), keys, __n=(F.count(F.lit(1)), F.coalesce(F.sum("__n").over(before(keys)), F.lit(0))))
    return counted.withColumn(name, F.col("__n") + F.row_number().over(inside(keys, order or [t])) - 1).drop("__n", "__block")


def halo(series: DataFrame, keys: list[str], t: str, reach: int, block: float = BLOCK, rows: int = ROWS) -> tuple[DataFrame, object, Column]:
    """(series dealt into blocks of rows, each with the `reach` rows before and behind it copied in; the window of a block; what is true of a row in its own block only).

    Columns __row and __at are added. A lag or lead of up to `reach` rows over that window is what it is over the whole series.
    """
    numbered = row_numbers(series, keys, t, "__row", block)
    near = F.sequence(F.floor(F.greatest(F.col("__row") - reach, F.lit(0)) / rows).cast("long"), F.floor((F.col("__row") + reach) / rows).cast("long"))
    dealt = numbered.withColumn("__at", F.explode(near))
    return dealt, Window.partitionBy(*keys, "__at").orderBy("__row"), F.col("__at") == F.floor(F.col("__row") / rows)

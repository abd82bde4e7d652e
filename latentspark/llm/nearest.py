"""Approximate nearest neighbours by collision counting over single projections (query-aware hashing).

Vectors are dealt into blocks by a hash; in a block, PROJECTIONS random projections are each kept as one sorted array. A query lays a
window around its own projection in every array; virtual rehashing widens all windows by a factor, and only what enters a window is
counted. A vector that has fallen into the windows of at least a share of the arrays is a candidate and is verified by its exact inner
product. A query stops when its windows are so wide, measured by the distance of the k-th best verified vector, that a nearer one
would be a candidate in all likelihood; so work follows how far the neighbours lie from all else, not the number of vectors.
Largest inner product becomes least distance by one more coordinate, sqrt(M^2 - |x|^2), M the largest norm of all vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_of, saved, whole

#: Projections, share of them that makes a candidate, factor of a round.
PROJECTIONS, SHARE, FACTOR = 64, 0.66, 1.5
#: A query stops at windows of so many times the distance of its k-th best: a vector at that distance falls into each with a probability of 0.73.
REACH = 1.1
#: Vectors and queries in a block at most on average; queries in a block at least, as long as there are fewer blocks than partitions.
BLOCK, QUERY_BLOCK, LEAST_QUERIES = 32_768, 65_536, 256
#: Queries whose first windows are found together.
TOGETHER = 64
#: Entries into windows, in blocks, from which comparing places is the cheaper way to the same counts.
DENSE = 8
NEIGHBOURS = 20


class CollisionIndex:
    """One block: sorted projections of its vectors, lifted so that distance follows the inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int = 5) -> None:
        self.ids, self.vectors, self.largest = ids, vectors, largest
        lift = np.sqrt(np.maximum(0.0, largest**2 - (vectors**2).sum(1)))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        shadow = (np.column_stack([vectors, lift]) @ self.lines).T
        self.order = np.argsort(shadow, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order, 1)
        self.place = np.zeros(shadow.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)
        #: half width of the first windows: a little less than the queries before needed
        self.width = 0.1 * float(shadow.std()) or 1.0

    def search_all(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """(id, places, inner products) for each query: the k best verified vectors of other ids, best first, ties to smaller ids."""
        for a in range(0, len(ids), TOGETHER):
            part = queries[a : a + TOGETHER]
            at, width = part @ self.lines[:-1], self.width
            low = np.stack([s.searchsorted(c - width) for s, c in zip(self.sorted, at.T, strict=True)], 1)
            high = np.stack([s.searchsorted(c + width, "right") for s, c in zip(self.sorted, at.T, strict=True)], 1)
            for j, i in enumerate(ids[a : a + TOGETHER].tolist()):
                yield i, *self.search(part[j], at[j], low[j], high[j], width, i, k)

    def counted(self, low: np.ndarray, high: np.ndarray, before: np.ndarray | None = None, hits: np.ndarray | None = None) -> np.ndarray:
        """In how many windows each vector lies. low, high: places of the windows; before: where they were when there were `hits`."""
        n = len(self.ids)
        entered = (high - low).sum() if hits is None else (before[0] - low + high - before[1]).sum()
        if entered > n * DENSE:  # cheaper to compare all places
            kind = self.place.dtype.type
            return np.less(self.place - low.astype(kind)[:, None], (high - low).astype(kind)[:, None]).sum(0, dtype=np.uint8) if n < 1 << 16 else ((self.place >= low[:, None]) & (self.place < high[:, None])).sum(0, dtype=np.uint8)
        if hits is None:
            parts = [o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist(), strict=True)]
        else:
            parts = [o[x:y] for o, a, b, c, d in zip(self.order, low.tolist(), before[0].tolist(), before[1].tolist(), high.tolist(), strict=True) for x, y in ((a, b), (c, d)) if x < y]
        more = np.bincount(np.concatenate(parts), minlength=n).astype(np.uint8) if parts else np.zeros(n, np.uint8)
        return more if hits is None else hits + more

    def search(self, query: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: float, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """low, high: the first windows, of half width `width`, in each array."""
        n, least = len(self.ids), int(np.ceil(SHARE * PROJECTIONS))
        around = float(query @ query) + self.largest**2
        hits = self.counted(low, high)
        found = np.flatnonzero(hits >= least)
        score = self.vectors[found] @ query
        while True:
            others = self.ids[found] != own
            enough = int(others.sum()) >= k
            need = REACH * np.sqrt(max(0.0, around - 2 * float(np.partition(score[others], -k)[-k]))) if enough else np.inf
            if width >= need or not low.any() and (high == n).all():
                break
            width = min(need, width * FACTOR) if enough else width * FACTOR
            wide = [np.minimum(low, [s.searchsorted(c - width) for s, c in zip(self.sorted, at, strict=True)]), np.maximum(high, [s.searchsorted(c + width, "right") for s, c in zip(self.sorted, at, strict=True)])]
            more = self.counted(*wide, (low, high), hits)
            low, high = wide
            new = np.flatnonzero((hits < least) & (more >= least))
            hits = more
            found, score = np.concatenate([found, new]), np.concatenate([score, self.vectors[new] @ query])
        self.width += 0.1 * (0.98 * min(width, need) - self.width)
        found, score = found[others], score[others]
        if len(found) > 4 * k:  # what surely isn't among the k best needs no sorting
            near = score >= np.partition(score, -k)[-k] - 1e-9
            found, score = found[near], score[near]
        score = (self.vectors[found] * query).sum(1)  # the measure itself, whatever order a product of matrices sums in
        best = np.lexsort((self.ids[found], -score))[:k]
        return found[best], score[best]


def _usable(df: DataFrame, name: str) -> DataFrame:
    v = F.col(name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


@whole
def nearest_neighbours(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row whose id is divisible by `every`, among all rows of other ids.

    Nearness is the inner product in double precision of the vectors as given; ties go to the smaller id. Vectors that are null, zero,
    or hold null or non-finite parts take no part; nor do rows with a null id, or whose length isn't the commonest. Of rows that repeat an id the first by vector counts.
    With fewer than k others all are returned. An empty table gives an empty one; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    rows = saved(_usable(rows, "v").groupBy("id").agg(F.min("v").alias("v")))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == size.d)
    # computed by value, so that it is the same however the rows are dealt
    largest = float(rows.select(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]) * (1 + 1e-12)
    blocks = -(-size.n // BLOCK)
    queries = rows.where(F.col("id") % every == 0)
    asking = queries.count()
    query_blocks = max(-(-asking // QUERY_BLOCK), min(-(-asking // LEAST_QUERIES), partitions_of(spark) // blocks)) or 1
    data = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        flat = np.concatenate([np.asarray(c.flatten()) for c in table.column("v").chunks]) if len(ids) else np.zeros(0)
        by = np.argsort(ids, kind="stable")
        return ids[by], flat.reshape(len(ids), -1)[by]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            index = CollisionIndex(*matrix(left), largest)
            for i, places, score in index.search_all(*matrix(right), k):
                ids.append(np.column_stack([np.full(len(places), i), index.ids[places]]).astype(np.int64))
                scores.append(score)
        pairs = np.concatenate(ids)
        return pa.table({"query_id": pairs[:, 0], "vec_id": pairs[:, 1], "score": np.concatenate(scores)})

    found = data.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(block, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(vectors: list[tuple[int, list[float]]], every: int = 20, k: int = NEIGHBOURS) -> dict[int, list[int]]:
    """Brute force over a small list, to measure recall against."""
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for i, v in zip(ids.tolist(), x, strict=True):
        if i % every == 0:
            score = (x * v).sum(1)
            by = [j for j in np.lexsort((ids, -score)).tolist() if ids[j] != i][:k]
            out[i] = ids[by].tolist()
    return out

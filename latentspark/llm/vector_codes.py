"""Vectors compressed to codes of their parts, by member-resident Lloyd rounds on whole numbers.

Parts live where their codebook entry lives: a table of them is bucketed by (position, entry, salt), salted so that an entry that many
parts choose has many owners. In a round each owner sums its resident members, sums of a few numbers for each entry make the new codebook, and each member
looks for its nearest entry where it lies. Who stays is written where it was; only parts that change entry are shuffled, to the bucket of
the new one. All is computed on whole numbers, so the result is the same however rows are dealt.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_of, removed, saved, shared_folder, tidy, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors for each salt; there are no more salts than buckets.
PER_OWNER = 1000
#: Scaled components are held within these bounds, so that squared distances of thousands of them fit a long.
LARGEST = 1 << 25
#: Distances computed at once.
CELLS = 1 << 21


def cuts_of(size: int) -> list[int]:
    """Where the parts of a vector begin, and its end: parts are equal, or as equal as can be."""
    return [size * k // PARTS for k in range(PARTS + 1)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the index of the nearest row of entries, the least of several, and the squared distance; exact."""
    at, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    if not parts.shape[1]:
        return at, distance
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * parts.shape[1] * largest**2 < 1 << 53 else np.int64  # floats are exact as long as all sums are whole numbers below 2^53
    e = entries.astype(kind)
    ee = (e * e).sum(1)
    step = max(1, CELLS // len(entries))
    for a in range(0, len(parts), step):
        x = parts[a : a + step].astype(kind)
        d = ee - 2 * (x @ e.T)  # the part's own square is the same for all entries
        i = d.argmin(1)
        at[a : a + step] = i
        distance[a : a + step] = (d[np.arange(len(i)), i] + (x * x).sum(1)).astype(np.int64)
    return at, distance


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (floor(SCALE x) of each component) of rows whose vector is there and finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bound = float(LARGEST // SCALE)
    scaled = F.transform(v, lambda x: F.floor(F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)) * SCALE).cast("long"))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled.alias("v"))


class Residents:
    """Tables of parts bucketed by (position, entry, salt) in the shared folder; each goes when its successor is written."""

    KEYS = ("position", "entry", "salt")

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.now = spark, buckets, None

    def settle(self, parts: DataFrame) -> DataFrame:
        name, path = f"latentspark_{uuid.uuid4().hex}", shared_folder(self.spark)
        parts.write.bucketBy(self.buckets, *self.KEYS).option("path", path).saveAsTable(name)
        self.leave()
        self.now = name, path
        return self.spark.table(name)

    def leave(self) -> None:
        if self.now:
            self.spark.sql(f"DROP TABLE {self.now[0]}")
            removed(self.spark, self.now[1])
            self.now = None


def arrays_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A matrix of the lists of a column, which are `width` long."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(column), width)


def owners_sums(members: DataFrame, cuts: list[int]) -> DataFrame:
    """position, entry, n and total (the sum of each component) of the members of each (position, entry, salt): they lie together, so no row moves."""

    def sums(table: pa.Table) -> pa.Table:
        k = table.column("position")[0].as_py()
        x = arrays_of(table.column("part"), cuts[k + 1] - cuts[k])
        return pa.table({"position": pa.array([k], pa.int32()), "entry": table.column("entry")[:1], "n": pa.array([len(x)], pa.int64()), "total": pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))})

    return members.groupBy(*Residents.KEYS).applyInArrow(sums, "position int, entry int, n long, total array<long>")


def updated(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Codebooks whose entries are floor(sum / count) of their members; as they were without members. What comes here has the size of the codebooks."""
    n = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"))
    totals = sums.select("position", "entry", F.posexplode("total").alias("at", "x")).groupBy("position", "entry", "at").agg(F.sum("x").alias("x"))
    new = [b.copy() for b in books]
    for r in totals.join(n, ["position", "entry"]).collect():
        new[r.position][r.entry, r["at"]] = r.x // r.n
    return new


def placed(rows: DataFrame, books: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """row, position, entry, part of the parts of rows (row, v), each at its nearest entry."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = arrays_of(batch.column(1), cuts[-1])
            for k, book in enumerate(books):
                own = x[:, cuts[k] : cuts[k + 1]]
                width = own.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(own).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), k), pa.int32()), pa.array(nearest(own, book)[0], pa.int32()), lists], ["row", "position", "entry", "part"])

    return rows.select("row", "v").mapInArrow(tidy(parts), "row long, position int, entry int, part array<long>")


def reassigned(members: DataFrame, books: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """members with `to`, the nearest entry, and `distance`, each found where the member lies."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, part = batch.column(batch.schema.get_field_index("position")).to_numpy(), batch.column(batch.schema.get_field_index("part"))
            to, distance = np.zeros(len(position), np.int32), np.zeros(len(position), np.int64)
            for k, book in enumerate(books):
                i = np.flatnonzero(position == k)
                to[i], distance[i] = nearest(arrays_of(part.take(pa.array(i)), cuts[k + 1] - cuts[k]), book)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to), pa.array(distance)], [*batch.schema.names, "to", "distance"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return members.mapInArrow(tidy(look), f"{fields}, to int, distance long")


@whole
def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 of every row of vectors whose vector is there and finite.

    Components become floor(SCALE x), held within LARGEST. Vectors are cut into PARTS parts, equal ones if their length allows it; vectors
    of another length than most (the shorter, of two that are as common) are dropped. Codebooks start from the ENTRIES rows of least id, fewer if there are fewer;
    null ids come last, rows of one id by their vectors. Repeated rows count each. Null labels are one label; a label's error that no
    long holds is null. An empty table gives an empty one; other columns aren't read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = saved(whole_numbers(vectors, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    cuts = cuts_of(size.d)
    rows = rows.where(F.size("v") == size.d)
    seeds = np.array([r.v for r in rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(ENTRIES).collect()], np.int64).reshape(-1, size.d)
    books = [seeds[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    buckets = partitions_of(spark)
    salts = min(buckets, max(1, ceil(size.n / PER_OWNER)))
    home = Residents(spark, buckets)
    dealt = lambda parts: parts.repartition(buckets, *Residents.KEYS)
    try:
        salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
        members = home.settle(dealt(placed(rows, books, cuts).withColumn("salt", salt)))
        books = updated(books, owners_sums(members, cuts))
        for _ in range(ROUNDS - 1):
            looked = reassigned(members, books, cuts).persist(StorageLevel.DISK_ONLY)  # made again from the table if an executor is lost
            here = members.columns
            stay = looked.where("to = entry").select(here)
            move = looked.where("to != entry").withColumn("entry", F.col("to")).select(here)
            members = home.settle(stay.unionByName(dealt(move)))
            looked.unpersist()
            books = updated(books, owners_sums(members, cuts))
        last = saved(reassigned(members, books, cuts).select("row", "position", F.col("to").alias("entry"), "distance"))
    finally:
        home.leave()
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    two = lambda k: F.max(F.when(F.col("position") == k, F.lower(F.lpad(F.hex("entry"), 2, "0"))))
    coded = last.groupBy("row").agg(F.concat(*(two(k) for k in range(PARTS))).alias("code"), F.sum("distance").alias("error"))
    named = saved(rows.select("row", "id", "label").join(coded, "row"))
    total = named.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(F.col("label").alias("of"), F.col("sum").try_cast("long").alias("label_error"))
    return named.join(total, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

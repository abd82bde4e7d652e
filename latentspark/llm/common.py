"""What the text operators share: a folder that all executors see, word hashing by whole buffers, gapless ranks."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; longer texts are taken alone.
SLICE_BYTES = 1 << 19


#: Folders of the operators that are running in this thread, the innermost last: what they save on the way goes there.
_open: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("latentspark_folders", default=())


@contextlib.contextmanager
def _folders(*folders: str) -> Iterator[None]:
    token = _open.set(folders)
    try:
        yield
    finally:
        _open.reset(token)


def shared_folder(spark: SparkSession, lasting: bool = False) -> str:
    """A new name in the folder of spark.checkpoint.dir, or, if not lasting, inside the folder of the operator that is running; where the setting is missing on one machine, as in tests, it is set to a new temporary folder."""
    if _open.get() and not lasting:
        return f"{_open.get()[-1]}/{uuid.uuid4().hex}"
    with _LOCK:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/latentspark-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost no more than their tasks. Outside any operator it stays until the application ends."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    if not _open.get():
        until_exit(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def removed(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def until_exit(spark: SparkSession, folder: str) -> None:
    """folder goes when the application ends."""
    files, path = _file_system(spark, folder)
    files.deleteOnExit(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables saved inside are removed at the end, but for those that the function given saves."""
    outer, own = _open.get(), shared_folder(spark)

    def keep(df: DataFrame) -> DataFrame:
        with _folders(*outer):
            return saved(df)

    try:
        with _folders(*outer, own):
            yield keep
    finally:
        removed(spark, own)


def whole(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator, run with small batches and its result saved; tables that it saves on the way are removed, and settings are as before, when it returns. Its first argument is the session, or a frame of it.

    Operators may run side by side in several threads: each has folders of its own, and the batch settings come back when the last one ends.
    """

    @functools.wraps(operator)
    def run(first: SparkSession | DataFrame, *args, **kwargs) -> DataFrame:
        spark = first.sparkSession if isinstance(first, DataFrame) else first
        with small_batches(spark), passing(spark) as keep:
            return keep(operator(first, *args, **kwargs))

    return run


#: Rows and bytes that pass to Python at once: texts vary from nothing to megabytes, and two workers share an executor's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}
_LOCK = threading.Lock()
#: For each session that has BATCHES set: how many operators need them, and what was set before the first.
_needing: dict[SparkSession, tuple[int, dict[str, str]]] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES hold inside; behind the last of those that overlap, the session's settings are as they were before the first."""
    with _LOCK:
        many, before = _needing.get(spark, (0, {}))
        if not many:
            before = {k: spark.conf.get(k) for k in BATCHES}
            for k, v in BATCHES.items():
                spark.conf.set(k, v)
        _needing[spark] = many + 1, before
    try:
        yield
    finally:
        with _LOCK:
            many, before = _needing.pop(spark)
            if many > 1:
                _needing[spark] = many - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column more, a whole number of each row's own, since ids may be null or repeated; and that column's name.

    A frame as read from Parquet files takes it from each row's file and place there, the same whenever it is read; any other is saved with the number first.
    Of a frame from files that repeats its rows (explode, join), pass a saved copy.
    """
    name = fresh(df, "__row")
    try:
        at = df.metadataColumn("_metadata")
        files = sorted(r[0] for r in df.select(at["file_path"]).distinct().collect())  # names of files, not rows
        file, place = fresh(df, "__file"), fresh(df, "__place")
        placed = df.select("*", at["file_path"].alias(file), at["row_index"].alias(place))
    except AnalysisException:
        return saved(df.withColumn(name, F.monotonically_increasing_id())), name
    known = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], f"{file} string, {name} long")
    return placed.join(F.broadcast(known) if len(files) <= 100_000 else known, file).withColumn(name, F.col(name) + F.col(place)).drop(file, place), name


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving freed memory back to the system when a task ends: a worker serves many tasks, and what it keeps counts for its executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def sized_hint(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most most_rows rows by a count; beyond that a shuffled join serves the same result."""
    return F.broadcast(df) if df.count() <= most_rows else df


def least_by_hash(ids: DataFrame, key: str, name: str, most: Column | int) -> DataFrame:
    """key, name: at most `most` different ids `name` of each key, the least by a hash; a null id is one id.

    From an estimate of how many each key has, all but about twice as many are left out before any are ranked, so no task holds a key.
    """
    most = most if isinstance(most, Column) else F.lit(most)
    place = F.xxhash64(name, F.lit(17)) / F.lit(2.0**64) + 0.5
    many = ids.groupBy(key).agg(F.approx_count_distinct(F.xxhash64(name)).alias("__many"))
    near = ids.select(key, name).join(sized_hint(saved(many), 100_000), key).where(place * F.col("__many") <= 2 * most + 200).select(key, name).distinct()
    first = Window.partitionBy(key).orderBy(place, name)
    return near.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= most).select(key, name)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- bytes and words -------------------------------------------------------------------------------------------------

#: 0x20 and 0x09-0x0D divide words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places of a word's bytes whose random values are in a table; values of later places are computed.
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place_values(at: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value of each byte at each place of a word."""
    return mix((at.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xA24BAED4963EE407))


_VALUES = _place_values(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES))


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of rows that hold about `most` bytes; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, row of each word) of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    data = _LOWER[data] if lower else data
    full = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(full & ~before)
    ends = np.flatnonzero(full & ~after) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of random values of its bytes at their places (tabulation), finished by `mix`.

    Words that differ get unrelated sums wherever they differ; no structure of the bytes, repetition for one, makes them collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(data), np.int32)
    begin[starts] = np.diff(starts, prepend=0)
    at = np.arange(len(data), dtype=np.int32) - np.cumsum(begin, dtype=np.int32)
    far = np.flatnonzero(at >= _PLACES)
    index = np.minimum(at, _PLACES - 1)
    index <<= 8
    index |= data
    index[: starts[0]] = 0
    values = _VALUES[index]
    if len(far):
        values[far] = _place_values(at[far], data[far])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Odd multipliers, one for each place in a shingle.
PLACES = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(column: pa.Array, size: int = 5):
    """For each row the sorted distinct 64-bit hashes of its `size`-word shingles; all its words as one if there are fewer; none without words."""
    for _, data, offsets in text_slices(column):
        data, starts, ends, rows = words_of(data, offsets)
        h = word_hashes(data, starts, ends)
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        many = max(0, len(h) - size + 1)
        grams = np.zeros(many, np.uint64)
        for j in range(size):
            grams += h[j : j + many] * PLACES[j]
        grams = mix(grams)
        for i in range(len(offsets) - 1):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if b - a >= size:
                x = np.sort(grams[a : b - size + 1])
                keep = np.ones(len(x), bool)
                keep[1:] = x[1:] != x[:-1]
                yield x[keep]
            elif b > a:
                short = sum((h[a + j : a + j + 1] * PLACES[j] for j in range(b - a)), np.zeros(1, np.uint64))
                yield mix(short + np.array([b - a], np.uint64) * np.uint64(0xB492B66FBE98F273))
            else:
                yield np.zeros(0, np.uint64)


# ---- bytes of number columns -----------------------------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, first bytes of all numbers first: what barely varies compresses away in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# ---- ranks -----------------------------------------------------------------------------------------------------------


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], spread: str, name: str, buckets: int) -> DataFrame:
    """df with `name`, 0, 1, 2, ... within `keys`, though a key may hold any share of the rows.

    Rows of a key are dealt over `buckets` by column `spread`, ranked there, and shifted by the counts of the buckets before;
    so no task holds a whole key. df must give the same rows whenever it is read: pass a saved table.
    """
    b = "__bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(shift, [*keys, b]).withColumn(name, F.col("__r") + F.col("__shift")).drop(b, "__r", "__shift")

"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of WINDOW words at half-window steps. Words are hashed to WIDTH terms and weighted by the inverse of the number
of documents that have them. One pass over all passages (of half a window, without overlap) multiplies their covariance with random vectors, task by task; from the
sum, which is WIDTH x RANK whatever the corpus, a randomised (Nystrom) decomposition gives the latent directions. A second pass maps
each passage there and takes the benchmark items with a window of a large cosine as candidates, if they share enough weighted terms too. Each is
settled by the words around the passage: their longest common subsequence with the item, and the share of the item's closing words, its answer, among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, passing, saved, sized_hint, text_slices, tidy, whole, word_hashes

WINDOW, WIDTH, RANK = 32, 1 << 13, 64
#: Leading directions that are left out: they tell languages and common words apart, not passages. A window of an item that keeps less than KEPT
#: of its squared length without them is compared in all directions: where the corpus is small or an item frequent, they tell that item apart.
COMMON, KEPT = 16, 0.5
#: Least latent cosine of a candidate (of items shorter than a window that times the fourth root of their share of it, as the rest of the passage dilutes them); least shared share of the item's words in order; that with its answer; closing words that are its answer, and their least share.
COSINE, SHARED, SHARED_WITH_ANSWER, ANSWER_WORDS, ANSWER = 0.42, 0.8, 0.6, 5, 0.6
#: Share of an item's weight that a passage must have before words are compared in order.
OVERLAP = 0.45
#: Items compared in one pass; a larger benchmark takes several.
ITEMS = 4096
#: Numbers of rows that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000

#: ASCII bytes other than letters and digits divide words here.
_DIVIDES = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def divided(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words."""
    full = ~_DIVIDES[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = full[0], full[-1]
    np.not_equal(full[1:], full[:-1], out=edge[1:-1])
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    # a text may end inside what looks like one word
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[full[inner] & full[inner - 1]] if len(inner) else inner
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


def hashed_words(column: pa.Array):
    """(first row, hash of each word, first word of each row) of runs of rows; letters in lower case."""
    column = pc.utf8_lower(column.cast(pa.large_string()))
    for at, data, offsets in text_slices(column, 1 << 19):
        if not len(data):
            yield at, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
            continue
        starts, ends = divided(data, offsets)
        yield at, word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (WIDTH - 1)


def term_rows(docs: DataFrame) -> DataFrame:
    """A saved table: term and df (documents that have it; term -1: all documents) of each task, and with term -2 the terms of all words and where texts begin."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH, np.int64), 0
        names = ["term", "df", "terms", "cuts"]
        for batch in batches:
            for _, h, cuts in hashed_words(batch.column(0)):
                t = terms(h)
                own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                for a in range(0, len(cuts) - 1, 256):
                    part = slice(cuts[a], cuts[min(a + 256, len(cuts) - 1)])
                    has = np.zeros((min(256, len(cuts) - 1 - a), WIDTH), bool)
                    has[own[part] - a, t[part]] = True
                    df += has.sum(0)
                n += len(cuts) - 1
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array([-2]), pa.array([0]), pa.array([t.astype(np.uint16).tobytes()]), pa.array([cuts.astype(np.int64).tobytes()])], names)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH)), pa.array(np.concatenate([[n], df])), pa.nulls(WIDTH + 1, pa.binary()), pa.nulls(WIDTH + 1, pa.binary())], names)

    return saved(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), "term long, df long, terms binary, cuts binary"))


def term_weights(rows: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the term)) + 0.1 of each term, over all documents."""
    got = np.zeros(WIDTH + 1, np.int64)
    for r in rows.where("term > -2").groupBy("term").agg(F.sum("df").alias("df")).collect():  # WIDTH + 1 rows
        got[r.term + 1] = r.df
    return (np.log((1 + got[0]) / (1 + got[1:])) + 0.1).astype(np.float32)


def half_windows(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of blocks of half a window, which restart in each row; their rows; whether the next block is of the same row."""
    half, words = WINDOW // 2, np.diff(cuts)
    many = -(-words // half)
    row = np.repeat(np.arange(len(words)), many)
    first = cuts[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * half
    follows = np.zeros(len(row), bool)
    follows[:-1] = row[1:] == row[:-1]
    return first, row, follows


def block_sums(table: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each block's terms. The table ends with a row of zeros, which stands for words that a short block lacks."""
    size = np.diff(np.append(first, len(t)))
    out = table[t[first]]
    for k in range(1, WINDOW // 2):
        at = np.where(k < size, t[np.minimum(first + k, len(t) - 1)], len(table) - 1)
        out += table[at]
    return out


def latent_directions(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """WIDTH x at most RANK: maps a sum of terms to latent coordinates of equal spread; and how many of the first ones are common."""
    omega = np.random.default_rng(11).standard_normal((WIDTH, RANK)).astype(np.float32)
    weighted = np.zeros((WIDTH + 1, RANK + 1), np.float32)
    weighted[:-1, :-1], weighted[:-1, -1] = omega * weights[:, None], weights**2
    held = rows.sparkSession.sparkContext.broadcast((weighted, weights))
    chunk = 256

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = held.value
        total = np.zeros((RANK, WIDTH))
        for batch in batches:
            for t, cuts in zip(batch.column(0), batch.column(1), strict=True):
                t, cuts = np.frombuffer(t.as_py(), np.uint16).astype(np.int64), np.frombuffer(cuts.as_py(), np.int64)
                first, _, _ = half_windows(cuts)
                block = block_sums(table, t, first)
                y = block[:, :-1] / np.maximum(block[:, -1:], 1e-9)  # a unit passage times its random products, for both sides
                y, size = np.ascontiguousarray(y.T, np.float64), np.diff(np.append(first, len(t)))
                for j in range(RANK):
                    total[j] += np.bincount(t, np.repeat(y[j], size), WIDTH)
        sums = (total.T * weights[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH // chunk)), pa.array([sums[a : a + chunk].tobytes() for a in range(0, WIDTH, chunk)])], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("sums"))
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()])})

    got = rows.where("term = -2").select("terms", "cuts").mapInArrow(tidy(products), "part long, sums binary").groupBy("part").applyInArrow(add, "part long, sums binary").collect()  # WIDTH / 256 rows
    plain = omega * weights[:, None]
    if not got:
        return plain, 0
    y = np.concatenate([np.frombuffer(r.sums, np.float64).reshape(-1, RANK) for r in sorted(got, key=lambda r: r.part)])
    core = omega.astype(np.float64).T @ y
    core = (core + core.T) / 2
    values, q = np.linalg.eigh(core)
    good = values > max(values.max(), 1e-12) * 1e-9
    if not good.any():
        return plain, 0
    u, s, _ = np.linalg.svd(y @ (q[:, good] / np.sqrt(values[good])), full_matrices=False)
    s = np.maximum(s, s[0] * 1e-6)
    skip = COMMON if len(s) >= 2 * COMMON else 0
    return (u / s * s[-1] * weights[:, None]).astype(np.float32), skip


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of b at a time over all of a in one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = places.get(x, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def windows_of(words: np.ndarray) -> list[np.ndarray]:
    """words in windows of WINDOW at half-window steps, the last one at the end; all of fewer words as one."""
    last = max(0, len(words) - WINDOW)
    return [words[k : k + WINDOW] for k in sorted({*range(0, last, WINDOW // 2), last})]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def items_of(rows: list[tuple[int, str]], directions: np.ndarray, skip: int) -> tuple[list, list[tuple[int, np.ndarray, np.ndarray]], list[list[int]]]:
    """(ids, (first direction, unit latent vectors of windows, the item of each) for windows with and without the common directions, hashes of the words) of the benchmark items that have words."""
    ids, words = [], []
    for at, h, cuts in hashed_words(pa.array([t for _, t in rows], pa.string())):
        for i in range(len(cuts) - 1):
            if cuts[i + 1] > cuts[i]:
                ids.append(rows[at + i][0])
                words.append(h[cuts[i] : cuts[i + 1]])
    parts = [windows_of(w) for w in words]
    vectors = np.array([directions[terms(x)].sum(0) for p in parts for x in p], np.float32).reshape(-1, directions.shape[1])
    of = np.repeat(np.arange(len(words)), [len(p) for p in parts])
    lost = (vectors[:, skip:] ** 2).sum(1) < KEPT * (vectors**2).sum(1)
    return ids, [(skip, unit(vectors[~lost, skip:]), of[~lost]), (0, unit(vectors[lost]), of[lost])], [w.tolist() for w in words]


def held_weights(lists: list[list[int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, term): the term's weight in fifteenths of the largest if the item has it; and the sum that a passage must share: OVERLAP of the item, or of the part of it that some passage holds."""
    scaled = np.maximum(1, np.rint(weights / max(float(weights.max()), 1e-9) * 15)).astype(np.uint8)
    held, need = np.zeros((len(lists), WIDTH), np.uint8), np.zeros(len(lists))
    for i, x in enumerate(lists):
        t = terms(np.array(x, np.uint64))
        held[i, t] = scaled[t]
        need[i] = OVERLAP * scaled[t].astype(int).sum() * min(1.0, 0.75 * WINDOW / len(x))
    return held, need


def candidates(h: np.ndarray, cuts: np.ndarray, directions: np.ndarray, spaces: list[tuple[int, np.ndarray, np.ndarray]], limits: np.ndarray, held: np.ndarray, need: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(row, first word, item, cosine) of passages whose latent cosine with some window of an item is at least the item's limit and that share enough of its weight. spaces: as items_of gives them, items ascending."""
    first, row, follows = half_windows(cuts)
    if not len(first):
        return []
    t = terms(h)
    least = min((skip for skip, windows, _ in spaces if len(windows)), default=0)
    halves = block_sums(np.ascontiguousarray(directions[:, least:]), t, first)
    sums = halves.copy()
    sums[:-1][follows[:-1]] += halves[1:][follows[:-1]]
    end = np.minimum(first + WINDOW, cuts[1:][row])
    out = []
    for skip, windows, of in spaces:
        if not len(windows):
            continue
        x, rows = unit(sums[:, skip - least :]), max(16, (1 << 20) // len(windows))
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        item = of[begins]
        for a in range(0, len(x), rows):
            cos = x[a : a + rows] @ windows.T
            if len(begins) < len(of):
                cos = np.maximum.reduceat(cos, begins, axis=1)
            p, j = np.nonzero(cos >= limits[item])
            i = item[j]
            total = np.zeros(len(p), np.int64)
            begin, until = first[a + p], end[a + p]
            for k in range(WINDOW):
                at = begin + k
                total += np.where(at < until, held[i, t[np.minimum(at, len(t) - 1)]], 0)
            good = np.flatnonzero(total >= need[i])
            out += zip(row[a + p[good]].tolist(), begin[good].tolist(), i[good].tolist(), cos[p[good], j[good]].tolist(), strict=True)
    return out


def settled(h: np.ndarray, begin: int, end: int, at: int, words: list[int]) -> tuple[int, float] | None:
    """(common words in order, share of the answer) if the words of h around `at`, between begin and end, hold the item."""
    n = len(words)
    around = h[max(begin, at - n) : min(end, at + WINDOW + n)].tolist()
    lcs = common_subsequence(words, around)
    if lcs < SHARED_WITH_ANSWER * n:
        return None
    answer = words[-ANSWER_WORDS:]
    share = common_subsequence(answer, around) / len(answer)
    return (lcs, share) if lcs >= SHARED * n or share >= ANSWER else None


@whole
def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs, item_words, shared, answer_share, cosine of each row of docs and each item that it holds, whole or reworded.

    Null and empty texts hold nothing and are held by nothing; null ids stay null; a row that is repeated is reported as often.
    Documents without a find have no row. Whole texts of any length are read, no other columns. An empty table or benchmark gives an empty table.
    """
    rows_of_terms = term_rows(docs)
    weights = term_weights(rows_of_terms)
    directions, skip = latent_directions(rows_of_terms, weights)
    directions = np.concatenate([directions, np.zeros((1, directions.shape[1]), np.float32)])
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    given = saved(benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).withColumn("number", F.monotonically_increasing_id()))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = -(-max(1, given.count()) // ITEMS)
    out = None
    for k in range(parts):
        # about ITEMS rows are collected here, equal ones too, as each is dealt by its number; more items take several passes
        mine = given.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == k).orderBy("number").collect()
        items = spark.sparkContext.broadcast((*items_of([(r.item_id, r.text) for r in mine], directions, skip), directions, weights))

        def rows(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            ids, spaces, lists, directions, weights = items.value
            limits = COSINE * np.minimum(1.0, np.array([len(x) / WINDOW for x in lists])) ** 0.25
            held, need = held_weights(lists, weights)
            for batch in batches:
                row, found = [], []
                for at, h, cuts in hashed_words(batch.column(1)):
                    best: dict[tuple[int, int], tuple] = {}
                    for r, first, i, cos in candidates(h, cuts, directions, spaces, limits, held, need):
                        if best.get((r, i), (0,))[0] == len(lists[i]):
                            continue  # whole already
                        got = settled(h, int(cuts[r]), int(cuts[r + 1]), first, lists[i])
                        if got and (*got, cos) > best.get((r, i), (0, 0.0, 0.0)):
                            best[r, i] = (*got, cos)
                    for (r, i), (lcs, share, cos) in sorted(best.items()):
                        row.append(at + r)
                        n = len(lists[i])
                        found.append((ids[i], lcs, n, lcs / n, share, cos))
                columns = list(zip(*found, strict=True)) if found else [()] * 6
                types = [item_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "item_id", "lcs", "item_words", "shared", "answer_share", "cosine"])

        item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
        part = source.mapInArrow(tidy(rows), f"doc_id {kind}, item_id {item_kind}, lcs long, item_words long, shared double, answer_share double, cosine double")
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, whatever their ids and other columns: null and repeated ids are rows like others.

    Rows with a null or empty text stay; each copy of a row has the same fate; an empty table or benchmark takes nothing away.
    """
    rows, number = numbered(docs)
    with passing(spark) as keep:
        found = keep(contaminated(spark, rows.select(F.col(number).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(number)).distinct())
    return rows.join(sized_hint(found, BROADCAST_ROWS), number, "left_anti").select(*docs.columns)

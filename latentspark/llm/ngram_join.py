"""Jaccard self-join of documents on word shingles, size-aware: subsets for small sets, inverted lists for large ones.

All sets are sorted by one global order, common shingles last. Two sets that link share at least `ceil(t * n)` shingles, so the k
first shingles that they share lie among the first `n - ceil(t * n) + k` of each. Small sets publish every 2-subset of that prefix
(k = 2); large sets, and small ones that a large one may link with, publish single shingles (k = 1) and meet in inverted lists.
The size from which lists are cheaper is chosen by cost from the histogram of set sizes and the mean list length.

A list or subset held by many sets is never expanded into all its pairs at first: each member is compared with one leader, then in
some rounds with one neighbour in a hashed order of the list; only pairs that this leaves in different components are compared at
last. Links are exact: shared 64-bit shingle hashes are counted. That gives the components; each set's links, which all lie inside its
component, are then counted over all pairs of sets there, a pair of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import from_planes, mix, partitions_of, passing, planes, saved, shingle_sets, signed, sized_hint, tidy, whole

#: A pair links when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Shingles of at least so many documents count as common; so many of them at most, the most common ones, go last in the order.
COMMON_FROM, COMMON_MOST = 12, 1 << 18
#: Hashes that a map task holds, shingles a reduce group gets on average, postings of one list that one group may get.
FLUSH, PER_GROUP, PER_LIST = 1_000_000, 1_000_000, 100_000
#: Rounds at most in which members of a list are compared with neighbours in a hashed order, and the share of links that makes another round worth while, before the pairs that are left.
NEIGHBOUR_ROUNDS, FRUITFUL = 4, 0.1
#: Document ids that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles and sets that a block of a component holds on average when its links are counted, and cells of a dense block at once.
BLOCK_ITEMS, BLOCK_SETS, CELLS = 1_000_000, 512, 1 << 22


def least_shared(n: int) -> int:
    """The least intersection of a set of n shingles with any set that it links with."""
    return -(-SHARE[0] * n // SHARE[1])


def set_id(x: np.ndarray) -> int:
    """A 64-bit name of a set, whatever its order."""
    return int(np.sum(mix(x * np.uint64(0x9FB21C651E98DF25) + np.uint64(len(x))), dtype=np.uint64).view(np.int64))


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cid (name of the set; equal sets have one) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(x), set_id(x)) for x in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([c for _, c in sets], pa.int64())], ["doc_id", "n_shingles", "cid"])

    return docs.select("doc_id", "text").mapInArrow(tidy(rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cid long")


def _first_seen(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    for x in shingle_sets(batch.column(0)):
        if len(x) and (c := set_id(x)) not in seen:
            seen.add(c)
            yield c, x


def _group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(groups)


def shingle_counts(docs: DataFrame, groups: int) -> DataFrame:
    """grp, key, df of every shingle of at least COMMON_FROM documents; and one row for each group with key -1, its sum of counts and of their squares below that.

    A shingle is known by its group and 32 bits; what collides only looks more common than it is, and any order is right.
    """

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def out() -> pa.RecordBatch:
            h = np.concatenate(held)
            h = np.sort(_group_of(h, groups) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, n = h[first], np.diff(np.append(first, len(h))).astype(np.uint32)
            g = (h >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = (h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((int(g[a]), planes(np.diff(key, prepend=np.uint32(0))), planes(n[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])], ["grp", "keys", "counts"])

        for batch in batches:
            for _, x in _first_seen(batch, seen):
                held.append(x)
                size += len(x)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def counts(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(from_planes(x.as_py(), np.uint32), dtype=np.uint32) for x in table.column("keys")])
        n = np.concatenate([from_planes(x.as_py(), np.uint32) for x in table.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df = np.add.reduceat(n, first)
        common = df >= COMMON_FROM
        rest = df[~common]
        g = table.column("grp")[0].as_py()
        many = int(common.sum())
        return pa.table({"grp": pa.array([g] * (many + 1), pa.int64()), "key": pa.array([*keys[first][common].tolist(), -1], pa.int64()), "df": pa.array([*df[common].tolist(), int(rest.sum())], pa.int64()), "squares": pa.array([0] * many + [int((rest * rest).sum())], pa.int64())})

    packed = docs.select("text").mapInArrow(tidy(blobs), "grp long, keys binary, counts binary")
    return packed.groupBy("grp").applyInArrow(counts, "grp long, key long, df long, squares long")


class Order:
    """The global order of shingles: uncommon ones by hash, then common ones by count and hash."""

    def __init__(self, names: np.ndarray, df: np.ndarray, groups: int) -> None:
        """names: group << 32 | key of the common shingles; df: their counts."""
        by = np.argsort(names)
        self.names, self.df, self.groups = names[by], df[by], groups
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.names & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def sort(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x, sorted by hash, in the order; and the count of each common shingle, 0 for others."""
        df = np.zeros(len(x), np.int64)
        if len(self.names):
            maybe = np.flatnonzero(self.maybe[(x & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(maybe):
                y = x[maybe]
                name = _group_of(y, self.groups) << np.uint64(32) | y & np.uint64(0xFFFFFFFF)
                at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
                df[maybe] = np.where(self.names[at] == name, self.df[at], 0)
                by = np.argsort(df, kind="stable")
                return x[by], df[by]
        return x, df


def boundary(sizes: list[tuple[int, int]], mean_list: float) -> int:
    """The set size from which inverted lists cost less than 2-subsets, from (size, sets) and the mean length of a list."""
    best, at, sizes = None, 2, sorted(sizes)
    subsets = [c * (p := n - least_shared(n) + 2) * (p - 1) / 2 for n, c in sizes]
    lists = [c * (n - least_shared(n) + 1) * max(1.0, mean_list) for n, c in sizes]
    left, right = 0.0, sum(lists)
    for i, (n, _) in enumerate(sizes):
        if best is None or left + right < best:
            best, at = left + right, n
        left, right = left + subsets[i], right - lists[i]
    if best is not None and left < best:
        at = sizes[-1][0] + 1
    return at


def postings(docs: DataFrame, order, large_from: int, groups: int) -> DataFrame:
    """sig, cid, n, pos of the subsets and list entries that at least two different sets publish. order: a broadcast of what makes an Order."""
    listed_from = least_shared(large_from)

    def publish(x: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x)
        spare = n - least_shared(n)
        sigs, pos, hot = [], [], []
        if 1 < n < large_from:
            p = min(n, spare + 2)
            i, j = np.triu_indices(p, 1)
            sigs.append(mix(x[i] * np.uint64(0xC2B2AE3D27D4EB4F) + x[j] * np.uint64(0x165667B19E3779F9)))
            pos.append(j)
            hot.append(np.minimum(df[i], df[j]))
        if n >= listed_from:
            p = min(n, spare + 1)
            sigs.append(mix(x[:p] * np.uint64(0x27D4EB2F165667C5)))
            pos.append(np.arange(p))
            hot.append(df[:p])
        return (np.concatenate(sigs), np.concatenate(pos), np.concatenate(hot)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size, by = set(), [], 0, Order(*order.value)

        def out() -> pa.RecordBatch:
            sig, cid, n, pos, split = (np.concatenate([h[i] for h in held]) for i in range(5))
            group = np.where(split > 1, mix(sig + (cid % np.maximum(split, 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups), _group_of(sig, groups)).astype(np.int64)
            to = np.lexsort((sig, group))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[to]) != 0, [True]]))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                t = to[a:b]
                rows.append((int(group[t[0]]), planes(np.diff(sig[t], prepend=np.uint64(0))), planes(cid[t]), planes(n[t].astype(np.uint32)), planes(pos[t].astype(np.uint32)), planes((split[t] > 1).astype(np.uint8))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(6)], ["grp", "sig", "cid", "n", "pos", "split"])

        for batch in batches:
            for c, x in _first_seen(batch, seen):
                sig, pos, hot = publish(*by.sort(x))
                if len(sig):
                    held.append((sig, np.full(len(sig), c, np.int64).view(np.uint64), np.full(len(sig), len(x)), pos, -(-hot // PER_LIST)))
                    size += len(sig)
                if size >= FLUSH // 3:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def lists(table: pa.Table) -> pa.Table:
        col = lambda c, kind: np.concatenate([from_planes(x.as_py(), kind) for x in table.column(c)])
        sig = np.concatenate([np.cumsum(from_planes(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("sig")])
        cid, n, pos, split = col("cid", np.uint64), col("n", np.uint32), col("pos", np.uint32), col("split", np.uint8)
        by = np.lexsort((cid, sig))
        sig, cid, n, pos, split = sig[by], cid[by], n[by], pos[by], split[by]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])
        sig, cid, n, pos, split = sig[new], cid[new], n[new], pos[new], split[new]
        alone = np.ones(len(sig), bool)
        same = sig[1:] == sig[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        keep = ~alone | (split > 0)
        return pa.table({"sig": signed(sig[keep]), "cid": signed(cid[keep]), "n": n[keep].astype(np.int64), "pos": pos[keep].astype(np.int64)})

    packed = docs.select("text").mapInArrow(tidy(blobs), "grp long, sig binary, cid binary, n binary, pos binary, split binary")
    return packed.groupBy("grp").applyInArrow(lists, "sig long, cid long, n long, pos long")


def _may_link(large_from: int):
    """Columns a_*, b_*: sizes that may link, at least one of them large in a list, and enough left behind the shared place (which is the first shared one in some list)."""
    n, m, i, j = F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos")
    small, big = F.least(n, m), F.greatest(n, m)
    rest = F.least(n - i, m - j) + F.when(big < large_from, 1).otherwise(0)
    return (F.lit(SHARE[1]) * small >= F.lit(SHARE[0]) * big) & (F.lit(sum(SHARE)) * rest >= F.lit(SHARE[0]) * (n + m))


def set_items(cids: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """A saved table: cid, items (the shingles) of the sets named by cids, made again from the texts of just their documents. Where an id is repeated a set can come from several tasks, once from each."""
    wanted = saved(cids.distinct().join(sets, "cid").select("cid", F.col("doc").alias("__doc")))
    texts = docs.select("doc_id", "text").join(sized_hint(wanted.select("__doc").distinct(), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi").select("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            got = list(_first_seen(batch, seen))
            for k in range(0, len(got), 500):
                part = got[k : k + 500]
                flat = signed(np.concatenate([x for _, x in part]))
                cuts = np.cumsum([0, *(len(x) for _, x in part)])
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))], ["cid", "items"])

    made = texts.mapInArrow(tidy(rows), "cid long, items array<long>")
    return saved(made.join(sized_hint(wanted.select("cid"), BROADCAST_ROWS), "cid", "left_semi"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """A saved table: those of pairs (a, b, both cids) that link, by the sets themselves."""
    with passing(docs.sparkSession) as keep:
        items = set_items(pairs.select(F.explode(F.array("a", "b")).alias("cid")), docs, sets)
        shared = F.size(F.array_intersect("a_items", "b_items"))
        linked = (
            pairs.join(items.select(F.col("cid").alias("b"), F.col("items").alias("b_items")), "b")
            .join(items.select(F.col("cid").alias("a"), F.col("items").alias("a_items")), "a")
            .where(F.lit(sum(SHARE)) * shared >= F.lit(SHARE[0]) * (F.size("a_items") + F.size("b_items")))
            .select("a", "b")
            .distinct()
        )
        return keep(linked)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of every node of edges (a, b), by alternating stars: O(log n) rounds, each cut off in the shared folder."""
    e = saved(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    while True:
        # every neighbour that is larger than a node goes to the node's least neighbour
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # every smaller neighbour, and the node itself, go to the least of them
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionByName(down.select(F.col("m").alias("lo"), "hi"))
        new = saved(small.distinct())
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first() for x in (e, new)]
        e = new
        if sums[0] == sums[1]:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


def _with_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp), joined by links between their nodes or new ones."""
    of = lambda s: comps.select(F.col("node").alias(s), F.col("comp").alias(f"{s}_comp"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    over = saved(components(named)).select(F.col("node").alias("comp"), F.col("comp").alias("over"))
    known = comps.join(over, "comp", "left").select("node", F.coalesce("over", "comp").alias("comp"))
    new = over.select(F.col("comp").alias("node"), F.col("over").alias("comp")).join(comps.select("node"), "node", "left_anti")
    return known.unionByName(new)


def _in_mixed_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """lists with each member's comp, and the list's length m, where a list has members of several components."""
    named = lists.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("sig", "m")
    return saved(named.join(mixed, "sig"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def _neighbours(left: DataFrame, large_from: int, turn: int) -> DataFrame:
    """Each member and the one before it in an order of the list by hash; a very long list is ordered in parts."""
    part = F.pmod(F.xxhash64("cid", F.lit(turn)), F.ceil(F.col("m") / PER_LIST))
    order = Window.partitionBy("sig", part).orderBy(F.xxhash64("sig", "cid", F.lit(turn)), "cid")
    before = F.lag(F.struct("cid", "n", "pos", "comp")).over(order)
    pairs = left.select("sig", F.col("cid").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), "comp", before.alias("p")).where("p is not null and comp != p.comp")
    return pairs.select("a", "a_n", "a_pos", F.col("p.cid").alias("b"), F.col("p.n").alias("b_n"), F.col("p.pos").alias("b_pos")).where(_may_link(large_from))


def _all_pairs(left: DataFrame, large_from: int) -> DataFrame:
    """All pairs of members in different components that may still link."""
    side = lambda s: left.select("sig", *(F.col(c).alias(t) for c, t in (("cid", s), ("n", f"{s}_n"), ("pos", f"{s}_pos"), ("comp", f"{s}_comp"))))
    return side("a").join(side("b"), "sig").where("a < b and a_comp != b_comp").where(_may_link(large_from)).select("a", "b")


def linked_with(sets: list[np.ndarray], first: int) -> np.ndarray:
    """For each set the sets that it links with: all pairs if first is 0, else only those of one of the first and one of the others."""
    size = np.array([len(x) for x in sets])
    own = np.repeat(np.arange(len(sets)), size)
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = many[at] > 1
    at, own = (np.cumsum(many > 1) - 1)[at[held]], own[held]
    by = np.argsort(at, kind="stable")
    at, own = at[by], own[by]
    a, b = (slice(first), slice(first, None)) if first else (slice(None), slice(None))
    shared, width = np.zeros((len(size[a]), len(size[b])), np.float64), max(64, CELLS // len(sets))
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        part = slice(*np.searchsorted(at, [k, k + width]))
        dense = np.zeros((len(sets), width), np.float32)
        dense[own[part], at[part] - k] = 1
        shared += dense[a] @ dense[b].T
    link = sum(SHARE) * shared >= SHARE[0] * np.add.outer(size[a], size[b])
    if first:
        return np.concatenate([link.sum(1), link.sum(0)])
    np.fill_diagonal(link, False)
    return link.sum(1)


def link_counts(spark: SparkSession, comps: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """cid, n_links: all links of each set of comps. The sets of a component are dealt over blocks by hash, and a task counts inside a pair of blocks; small components share tasks."""
    named = comps.select(F.col("node").alias("cid"), "comp").join(sets.select("cid", "n"), "cid")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int")
    of_comp = saved(named.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"), blocks.alias("blocks")))
    groups = max(partitions_of(spark), -(-(of_comp.where("m > 2 and blocks = 1").agg(F.sum("items")).first()[0] or 0) // BLOCK_ITEMS))
    members = saved(named.join(of_comp.where("m > 2"), "comp").select("cid", "comp", "blocks", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")).cast("int").alias("block")))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.xxhash64("comp", "lo", "hi"))
    rows = dealt.join(set_items(members.select("cid"), docs, sets), "cid").select(group.alias("grp"), "comp", "lo", "hi", "block", "cid", "items")

    def count(table: pa.Table) -> pa.Table:
        comp, lo, hi, block, cid = (table.column(c).to_numpy() for c in ("comp", "lo", "hi", "block", "cid"))
        items = table.column("items").combine_chunks()
        items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        flat, cuts = items.values.to_numpy(), items.offsets.to_numpy()
        by = np.lexsort((block, hi, lo, comp))
        key = np.stack([comp[by], lo[by], hi[by]])
        edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
        n = np.zeros(len(by), np.int64)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            t = by[s:e]
            t = t[np.sort(np.unique(cid[t], return_index=True)[1])]  # each set once
            cross = lo[t[0]] < hi[t[0]]
            first = int((block[t] == lo[t[0]]).sum()) if cross else 0
            if not cross or 0 < first < len(t):
                n[t] = linked_with([flat[cuts[k] : cuts[k + 1]] for k in t], first)
        return pa.table({"cid": pa.array(cid), "n_links": pa.array(n)})

    counted = rows.groupBy("grp").applyInArrow(count, "cid long, n_links long").groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    return counted.unionByName(named.join(of_comp.where("m = 2"), "comp").select("cid", F.lit(1).cast("long").alias("n_links")))


@whole
def jaccard_components(spark: SparkSession, docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, n_links for every row of docs; without count_links no n_links.

    component_id is the least doc_id reachable by links, the row's own included. n_copies counts rows with the row's own set, n_links
    all other sets that link with its set. Sets without shingles link with nothing. Rows with a null doc_id take part; a null is never the least of several ids. Repeated rows come back as often as they
    are given. Null and empty texts have n_shingles 0; an empty table gives an empty one. Other columns are not read.
    """
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = saved(set_rows(docs))
    sets = saved(rows.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_copies")))
    sizes = [(r.n, r.c) for r in sets.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toLocalIterator()]
    groups = max(partitions_of(spark), -(-sum(n * c for n, c in sizes) // PER_GROUP))

    counted = saved(shingle_counts(docs, groups))
    common = [(r.grp, r.key, r.df) for r in counted.where("key >= 0").orderBy(F.desc("df"), "grp", "key").limit(COMMON_MOST).collect()]
    total = counted.where("key < 0").agg(F.sum("df").alias("df"), F.sum("squares").alias("squares")).first()
    large_from = boundary(sizes, (total.squares or 0) / max(1, total.df or 0))
    order = spark.sparkContext.broadcast((np.array([g << 32 | k for g, k, _ in common], np.uint64), np.array([n for _, _, n in common], np.int64), groups))
    lists = saved(postings(docs, order, large_from, groups))

    # each member of a list against the one that shares most
    shares = lists.groupBy("cid").agg(F.count(F.lit(1)).alias("k"))
    lead = lists.join(shares, "cid").groupBy("sig").agg(F.max(F.struct("k", "cid", "n", "pos")).alias("l"))
    as_b = lists.select("sig", F.col("cid").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"))
    star = as_b.join(lead.select("sig", F.col("l.cid").alias("a"), F.col("l.n").alias("a_n"), F.col("l.pos").alias("a_pos")), "sig").where("a != b").where(_may_link(large_from))
    tried = saved(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comps = saved(components(verified(tried, docs, sets)))

    # then against its neighbours in hashed orders, as long as that joins much; at last all that is left in different ones
    for turn in range(NEIGHBOUR_ROUNDS):
        pairs = saved(_untried(_neighbours(_in_mixed_lists(lists, comps), large_from, turn), tried))
        more = verified(pairs, docs, sets)
        tried = tried.unionByName(pairs)
        found = more.count()
        if found:
            comps = saved(_with_links(comps, more))
        if found < FRUITFUL * pairs.count() or not found:
            break
    more = verified(saved(_untried(_all_pairs(_in_mixed_lists(lists, comps), large_from), tried)), docs, sets)
    if not more.isEmpty():
        comps = saved(_with_links(comps, more))

    final = sets.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = final.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of_set = final.join(least, "comp").select("cid", "component_id", "n_copies")
    names = ["doc_id", "n_shingles", "component_id", "n_copies"]
    if count_links:
        of_set = of_set.join(link_counts(spark, comps, docs, sets), "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        names.append("n_links")
    linked = rows.where("n_shingles > 0").join(of_set, "cid").select(*names)
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone.select(*names))

"""Operators that SQL cannot express against versions of their own, written plainly."""

import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import xxhash
from test_operators import DOCS, WORDS, docs_of

from latentspark.llm import decontamination, language_id, sharding


def test_shards_equal_draws_made_one_by_one(spark):
    """Law `key`: at each level the child with the largest ln(u) / weight, u from xxhash64 of key and child."""
    tree = sharding.Tree((((((0, 1.0), (1, 2.0)), ((2, 0.5),))), (((3, 1.0), (4, 1.0), (5, 3.0)),)))

    def won(key, level, children):
        draws = []
        for name, weight in children:
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
            h = xxhash.xxh64_intdigest(f"{level}/{name}".encode(), seed=h)
            draws.append(math.log(((h >> 11) + 1.0) / 2.0**53) / weight)
        return draws.index(max(draws))

    def shard(key):
        r = won(key, "root", [(str(r), sum(w for k in x for _, w in k)) for r, x in enumerate(tree.regions)])
        k = won(key, f"region {r}", [(str(k), sum(w for _, w in x)) for k, x in enumerate(tree.regions[r])])
        return tree.regions[r][k][won(key, f"rack {r}.{k}", [(str(s), w) for s, w in tree.regions[r][k]])][0]

    rows = [(i, "x") for i in [*range(3000), -5, 2**62]]
    got = {r.doc_id: r.shard for r in sharding.shard_documents(docs_of(spark, rows), tree).collect()}
    assert got == {i: shard(i) for i, _ in rows}
    share = Counter(got.values())
    assert all(abs(share[s] / len(rows) - w / 8.5) < 0.04 for x in tree.regions for k in x for s, w in k)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_decontamination_equals_common_subsequences_of_all_pairs(spark):
    """Every document against every item by plain dynamic programming over windows; what is clear either way must be found, or not be."""
    rng = random.Random(31)
    items = [(k, rng.choices(WORDS, k=rng.choice([12, 25, 40]))) for k in range(12)]
    docs = []
    for i in range(160):
        w = rng.choices(WORDS, k=rng.choice([20, 70, 150]))
        if i % 2:
            x = list(items[i % 12][1])
            for _ in range(int(len(x) * rng.choice([0, 0.05, 0.1, 0.7, 0.9]))):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            at = rng.randrange(len(w))
            w[at:at] = x
        docs.append((i, w))
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(spark, docs_of(spark, [(i, " ".join(w)) for i, w in docs]), spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")).collect()}
    clear, missed = 0, 0
    for i, w in docs:
        for k, x in items:
            n = len(x)
            lcs = max(plain_lcs(x, w[a : a + 2 * n + decontamination.WINDOW]) for a in range(0, max(1, len(w) - n), n))
            if lcs >= 0.85 * n:
                clear += 1
                missed += (i, k) not in found
            elif plain_lcs(x, w) < decontamination.SHARED_WITH_ANSWER * n:
                assert (i, k) not in found
            if (i, k) in found:
                r = found[i, k]
                assert r.lcs <= plain_lcs(x, w) and r.item_words == n and r.shared == r.lcs / n
    assert clear > 30 and missed <= 1


def test_language_equals_centroids_computed_plainly(spark):
    """With at most as many rows as centroids, each row is a centroid: the nearest training text by cosine of TF-IDF decides."""
    texts = {"en": ["the cat sat on the mat", "a dog and the house"], "de": ["der hund und die katze", "das haus ist grün"], "fr": ["le chat est sur la table", "une maison et un chien"]}
    ids = [i for i in range(200) if not _held(i)]
    rows, train = [], []
    for lang, some in texts.items():
        for t in some:
            i = ids.pop()
            rows.append((i, t, lang, "s", 0))
            train.append((lang, t))
    asked = ["the dog sat", "die katze und das haus", "la maison est grande", "un chat", "der the le", "zzz", "12 !", None, ""]
    rows += [(1000 + k, t, None, "s", 0) for k, t in enumerate(asked)]
    got = {r.doc_id: r for r in language_id.identify(spark, spark.createDataFrame(rows, DOCS)).collect()}

    def grams(t):
        x = "".join(c if c.isalpha() else " " for c in t.lower())
        out, keep = Counter(), [c for k, c in enumerate(x) if c != " " or (k and x[k - 1] != " ")]
        for n in (1, 2, 3):
            out.update("".join(keep[k : k + n]) for k in range(len(keep) - n + 1))
        return out

    df = Counter(g for _, t in train for g in grams(t))
    idf = lambda g: math.log((1 + len(train)) / (1 + df[g])) + 1

    def cosine(a, b):
        va, vb = ({g: math.log1p(c) * idf(g) for g, c in grams(t).items()} for t in (a, b))
        dot = sum(x * vb.get(g, 0.0) for g, x in va.items())
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return dot / (norm(va) * norm(vb))

    best = defaultdict(float)
    for k, t in enumerate(asked):
        r = got[1000 + k]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = sorted(((cosine(t, x), lang) for lang, x in train), reverse=True)
        assert abs(r.score - best[0][0]) < 0.03  # hashed grams may share a place
        if best[0][0] - max((c for c, lang in best if lang != best[0][1]), default=0) > 0.06:
            assert r.lang_pred == best[0][1]


def _held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_latent_directions_are_those_of_an_exact_decomposition(spark):
    """On a corpus of few topics the leading latent space holds what numpy's decomposition of the same matrix finds."""
    rng = np.random.default_rng(3)
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(4)]
    docs = [(i, " ".join(rng.choice(topics[i % 4], 16))) for i in range(400)]
    rows = decontamination.term_rows(docs_of(spark, docs))
    weights = decontamination.term_weights(rows)
    directions, _ = decontamination.latent_directions(rows, weights)
    x = np.zeros((len(docs), decontamination.WIDTH))
    at = 0
    for r in rows.where("term = -2").collect():
        t, cuts = np.frombuffer(r.terms, np.uint16), np.frombuffer(r.cuts, np.int64)
        for k in range(len(cuts) - 1):
            np.add.at(x[at], t[cuts[k] : cuts[k + 1]], 1)
            at += 1
    x *= weights
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.linalg.svd(x, full_matrices=False)[2][:4]
    mine = np.linalg.qr(directions[:, :4].astype(float) / weights[:, None])[0]
    assert np.linalg.svd(exact @ mine, compute_uv=False).min() > 0.95

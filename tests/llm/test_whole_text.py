"""The text operators count and keep everything that they should, row by row."""

import random

import corpus_pipeline
import pytest
from test_operators import DOCS, WORDS

from latentspark.llm import decontamination, ngram_join


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


@pytest.mark.parametrize("block", [512, 7])
def test_links_inside_a_component_are_all_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(3)
    rows, base = [], rng.choices(WORDS, k=150)
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    chain = rng.choices(WORDS, k=200)
    rows += [(100 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(8)]
    pair = rng.choices(WORDS, k=80)
    rows += [(200, " ".join(pair)), (201, " ".join(pair[:-1])), (202, " ".join(rng.choices(WORDS, k=60)))]
    got = ngram_join.jaccard_components(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)).collect()
    sets = {i: shingles(t) for i, t in rows}
    kinds = set(sets.values())
    want = {i: sum(x != y and 100 * len(x & y) >= 75 * len(x | y) for y in kinds) for i, x in sets.items()}
    assert max(want.values()) > 5 and 0 in want.values() and 1 in want.values()
    assert {r.doc_id: r.n_links for r in got} == want


def test_filters_of_the_pipeline_remove_rows_not_ids(spark, tmp_path):
    rng = random.Random(8)
    some = lambda n=80: " ".join(rng.choices(WORDS, k=n))
    copied, other, only, item, null_copy = some(), some(), some(), some(40), some()
    rows = [(1, copied), (5, copied), (5, other), (1, copied), (None, copied), (None, only), (7, f"{some(30)} {item} {some(30)}"), (7, some()), (None, item), (None, null_copy), (None, null_copy), (8, None), (8, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near, rows = docs, rows + [(1000 + k, some(200)) for k in range(200)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert texts(stage["near_duplicates"](spark, near, str(tmp_path))) == sorted([rows[k] for k in (0, 2, 5, 6, 7, 8, 9, 11, 12)], key=str)
    assert texts(stage["decontamination"](spark, docs, str(tmp_path))) == sorted([rows[k] for k in (0, 1, 2, 3, 4, 5, 7, *range(9, len(rows)))], key=str)


def test_items_longer_than_a_window_are_found(spark):
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in WORDS for b in range(40)]
    some = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, some(n)) for k, n in enumerate([20, 32, 40, 180, 300, 500] * 4)]
    docs = [(k, " ".join(some(rng.randrange(40)) + w + some(60))) for k, w in items] + [(1000 + k, " ".join(some(300))) for k in range(300)]
    found = decontamination.contaminated(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in docs], DOCS), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k, _ in items}

"""Bounded tables take few files, however many partitions a shuffle has."""

from test_edges import LABELS
from test_operators import DOCS

from latentspark.llm import toxicity


def test_the_toxicity_sample_and_its_counts_take_few_files(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k} of many vile{'abc'[k % 3]} words" if k % 4 == 0 else f"text number {k} of many words", "en", "s", 0) for k in range(400)], DOCS)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], LABELS)
    want = sorted(map(tuple, toxicity.score_documents(spark, docs, labels).collect()))
    files, save = [], toxicity.saved

    def noted(df):
        out = save(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(toxicity, "saved", noted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(tuple, toxicity.score_documents(spark, docs, labels).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert len(files) == 3 and max(files) <= 16

"""Small tables of components are not written by a task for each part of a shuffle."""

from tracelight.llm import jaccard


def test_components_write_few_files(spark, monkeypatch):
    written = []

    def told(df, label):
        written.append((label, df.rdd.getNumPartitions()))
        return materialize(df, label)

    materialize = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", told)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = [(i, i - 1) for i in range(1, 40) if i % 10] + [(100, 5), (200, 200)]
        got = dict(jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {**{i: i - i % 10 for i in range(40)}, 100: 0}
    assert len(written) > 4 and max(n for _, n in written) <= spark.sparkContext.defaultParallelism

"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashes."""

import os

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, count int, node string"


def odd_rows():
    w = lambda k: " ".join(f"w{i}" for i in range(k, k + 20))
    rows = [(-1, None), (-2, ""), (-3, w(0) + " zz " + w(100)), (-4, w(0) + " " + w(100)), (None, w(0)), (None, None), (7000, "x y z"), (7000, "x y z"), (7001, w(100) * 3), (7001, w(0)), (-1, w(5)), (8000, "ab" * 400), (8001, "q" * 1000), (8001, "q" * 1000), (8002, "z" + "ab" * 60), (8003, "1234 !? 5"), (8004, "é " * 20_000)]
    return [(d, t, None if (d or 0) % 2 else "en", None, None, "s", 1, "n") for d, t in rows]


def documents(spark, every=2):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).filter(F.col("doc_id") % every == 0)
    more = docs.withColumns({"score": F.lit("s"), "count": F.lit(1), "node": F.lit("n")})
    return more.unionByName(spark.createDataFrame(odd_rows(), SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

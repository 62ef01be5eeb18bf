"""Rules that ask for the same, or differ in their bounds alone, are looked at together."""

import datetime
import time
from collections import Counter

from pyspark.sql import functions as F

from tracelight.operators import rules

SCHEMA = "rule string, field string, op string, value string"


def test_rules_that_differ_in_bounds(spark):
    conditions = [("a", "actor", "eq", "x"), ("a", "k", "at_least", "5"), ("b", "actor", "eq", "x"), ("b", "k", "at_least", "5.0"), ("c", "actor", "eq", "x"), ("c", "k", "at_least", "7"), ("c", "v", "at_least", "1"), ("d", "actor", "eq", "x"),
                  ("e", "k", "at_least", "8"), ("f", "k", "at_least", "8"), ("f", "v", "at_least", "2"), ("g", "actor", "glob", "?*"), ("g", "k", "at_least", "9"), (None, "actor", "eq", "x"), ("h", "actor", "eq", "x"), ("h", "k", "at_least", None)]
    rows = [("x", k, v) for k in (4, 5, 7, 9, None) for v in (0.5, 2.5, None)] + [("", 9, 2.0), (None, 9, 2.0)]
    df = spark.createDataFrame(rows, "actor string, k int, v double")
    asks = {"a": lambda a, k, v: a == "x" and k >= 5, "b": lambda a, k, v: a == "x" and k >= 5, "c": lambda a, k, v: a == "x" and k >= 7 and v >= 1, "d": lambda a, k, v: a == "x", "e": lambda a, k, v: k >= 8, "f": lambda a, k, v: k >= 8 and v >= 2, "g": lambda a, k, v: a and k >= 9}
    low = lambda r: (r[0], -1 if r[1] is None else r[1], -1 if r[2] is None else r[2])
    want = Counter((n, r) for n, f in asks.items() for r in rows if f(*low(r)))
    got = rules.rule_hits(df, spark.createDataFrame(conditions, SCHEMA), ("actor", "k", "v"), ("actor", "k", "v")).collect()
    assert Counter((r.rule, (r.actor, r.k, r.v)) for r in got) == want


def test_many_rules_alike(spark):
    """20,000 events of one actor and 10,000 rules for it: 200 million pairs, none of which is made."""
    events = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("x").alias("actor"), F.concat(F.lit("/home/x/doc"), F.col("id").cast("string"), F.lit(".zip")).alias("path"), (F.col("id") % 50).cast("int").alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 7200).alias("ts"))
    numbered = spark.range(10_000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule"), F.explode(F.array(
        F.struct(F.lit("actor").alias("field"), F.lit("eq").alias("op"), F.lit("x").alias("value")),
        F.struct(F.lit("path").alias("field"), F.lit("glob").alias("op"), F.concat(F.lit("*/doc*"), (F.col("id") % 4).cast("string"), F.lit(".???")).alias("value")),
        F.struct(F.lit("k").alias("field"), F.lit("at_least").alias("op"), (F.col("id") % 45).cast("string").alias("value")))).alias("c")).select("rule", "c.*")
    began = time.time()
    got = rules.match_rule_table(events, numbered, 60, 1, ("actor", "path", "k")).collect()
    assert time.time() - began < 60
    want = Counter((d, b, i % 7200 // 3600) for i in range(20_000) for d in (i % 10,) if d < 4 for b in range(45) if i % 50 >= b)
    start = datetime.datetime(2024, 1, 1)
    told = {(r.rule, int((r.window_start.replace(tzinfo=None) - start).total_seconds()) // 3600): r.hits for r in got}
    assert len(told) == len(got)
    assert told == {(f"r{i}", w): n for i in range(10_000) for w in (0, 1) if (n := want[(i % 4, i % 45, w)])}


def test_few_runs_and_many(spark):
    """Runs are looked for one by one or among all of a text: the same rules are met."""
    globs = [f"*/d{i}x*" for i in range(200)]
    df = spark.createDataFrame([(f"/a/d{i}x/é=~{i}",) for i in range(0, 260, 3)] + [(None,), ("",)], "path string")
    for n in (3, 60, 200):
        table = spark.createDataFrame([(f"r{i}", "path", "glob", g) for i, g in enumerate(globs[:n])], SCHEMA)
        got = rules.rule_hits(df, table, ("path",), ("path",)).collect()
        assert sorted((r.rule, r.path) for r in got) == sorted((f"r{i}", f"/a/d{i}x/é=~{i}") for i in range(0, n, 3))

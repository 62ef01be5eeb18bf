"""Texts with thousands of spans, and texts of several MB."""

import random

from pyspark.sql import functions as F

from tracelight.llm import pii


def test_running_sums(spark):
    values = [random.Random(n).choices(range(100), k=n) for n in (0, 1, 2, 3, 4, 5, 17, 100, 101)]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    got = df.select("v", pii.running(F.col("v"), lambda a, b: a + b).alias("sum"), pii.running(F.col("v"), F.greatest).alias("most")).collect()
    for r in got:
        assert r["sum"] == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.most == [max(r.v[: i + 1]) for i in range(len(r.v))]


def test_places_in_a_text(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(3500))
    cuts = [(0, 0), (0, 1), (0, 3500), (999, 1000), (999, 1001), (1000, 2000), (1, 3499), (2500, 3500), (3500, 3500), (500, 400)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    for r in df.select("a", "b", pii._between(pii._stretches(F.col("t")), F.col("a"), F.col("b")).alias("cut")).collect():
        assert r.cut == text[r.a : max(r.a, r.b)]


def test_thousands_of_spans_in_one_text(spark):
    n = 40_000
    mails = "".join(f"u{i}@host.org call (602) 555-{i % 10_000:04d}, " for i in range(n))
    df = spark.createDataFrame([(1, mails), (2, "x " * 2_000_000 + "a@b.org")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[1].n_email == n and got[2].spans == "email:4000000:4000007"
    spans = [s.split(":") for s in got[1].spans.split(",")]
    assert len(spans) == 2 * n and all(mails[int(a) : int(b)].startswith("u" if k == "email" else "(") for k, a, b in spans)
    clean = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert clean[1] == "<EMAIL> call <TEL>, " * n and clean[2] == "x " * 2_000_000 + "<EMAIL>"

"""Hard negatives against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelight.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, block int, stripe int"
FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, n=5):
    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and usable(v)]
    out = []
    for a, (ident, label, v) in enumerate(rows):
        if ident % 100:
            continue
        others = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, l == label) for b, (i, l, w) in enumerate(rows) if a != b and len(w) == len(v)]
        for p, pid, _ in sorted(o for o in others if o[2])[:n]:
            window = sorted((s, i) for s, i, same in others if not same and 80 * -p <= 100 * -s <= 100 * -p)
            out += [(ident, pid, r, i, -p, -s) for r, (s, i) in enumerate(window[:n], 1)]
    return sorted(out)


def made(seed, n, dim):
    dice = random.Random(seed)
    centre = [[dice.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    rows = []
    for i in range(n):
        v = [c + dice.gauss(0, 0.3) for c in centre[dice.randrange(3)]]
        rows.append((i * 10, [x / math.sqrt(sum(y * y for y in v)) for x in v], dice.choice([0, 0, 1, 2])))
    return rows


ODD = [(None, [0.1] * 4, 1), (1, None, 1), (2, [], 1), (3, [0.1, None, 0, 0], 1), (4, [0.1, float("nan"), 0, 0], 1), (5, [0.1, float("inf"), 0, 0], 1), (6, [0.5] * 4, None), (0, [0.5] * 4, 1), (0, [0.5] * 4, 1), (100, [0.5] * 4, 1), (7, [0.5] * 4, 2), (7, [0.5] * 4, 2), (8, [0.5] * 4, 2), (9, [0.49] * 4, 0), (200, [-0.5] * 4, 1), (300, [1.0, 2.0], 1), (301, [1.0, 2.0], 1), (302, [0.9, 2.0], 2), (400, [0.0] * 4, 3), (401, [0.0] * 4, 3)]


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label, "u", 1, 1) for i, v, label in rows], SCHEMA)
    vectors = H.labelled(df, F.col("label"))
    return vectors, sorted(tuple(r[f] for f in FIELDS) for r in H.mine(vectors, vectors.filter("id % 100 = 0"), **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 30, "anchor_rows": 4}])
def test_every_anchor(spark, sizes):
    rows = made(1, 300, 20) + ODD
    assert run(spark, rows, **sizes)[1] == brute(rows)


def test_few_rows(spark):
    assert run(spark, [])[1] == []
    assert run(spark, ODD[:7])[1] == []
    assert run(spark, ODD)[1] == brute(ODD)


def test_components_beyond_doubles(spark):
    rows = [(0, [1e7 + 1 / 256, 1.0, 1e6], 1), (1, [1e7, 5.0, 1e6], 1), (2, [1e7, 5.0, 1e6 - 1 / 256], 2), (3, [1e7, 4.0, 1e6], 2), (4, [0.9e7, 4.0, 1e6], 3)]
    assert run(spark, rows)[1] == brute(rows)
    assert run(spark, [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e300, -1.0], 2)])[1][0][:4] == (0, 1, 1, 2)


def test_the_bitmap_shrinks(spark):
    """Most components of most candidates are never read."""
    dice = random.Random(2)
    rows = [(i, [dice.gauss(0, 1) * 0.7**d for d in range(40)], i % 4) for i in range(2000)]
    vectors, got = run(spark, rows)
    assert got == brute(rows)
    assert H.mine(vectors, vectors.filter("id % 100 = 0")).agg(F.avg("read_share")).first()[0] < 0.7

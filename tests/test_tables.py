"""Kept aliases, names in free text, and rules that are tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelight.functions import patterns as P
from tracelight.operators import aliases, leaks, rules


def loops(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in plan or "Cartesian" in plan


def test_aliases_stay_when_ids_come(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "who string")
    named = lambda *x: {r.id: r.alias for r in aliases.stable_aliases(ids(*x), "who", "USER-", path)[1].collect()}
    assert named("c", "b", "b", None) == {"b": "USER-001", "c": "USER-002"}
    assert named("a", "c", "z") == {"b": "USER-001", "c": "USER-002", "a": "USER-003", "z": "USER-004"}
    out, table = aliases.stable_aliases(ids("z", None, "a"), "who", "USER-", path)
    assert sorted(str(r.who_alias) for r in out.collect()) == ["None", "USER-003", "USER-004"]
    assert table.agg(F.max("version")).first()[0] == 1 and aliases.versions(spark, path) == ([0, 1], 2)
    # a version that was begun and never finished is passed over
    (tmp_path / "map" / "version=2").mkdir()
    assert named("a", "q")["q"] == "USER-005" and aliases.versions(spark, path) == ([0, 1, 3], 4)


NAMES = [("Ann Lee", "<P1>"), ("Lee Grant Smith", "<P2>"), ("db1.corp", "<H>"), ("Grant", "<P3>"), ("ann  LEE", "<P9>"), ("...", "<X>"), ("Zoë", "<Z>"), (None, "<N>"), ("x y", None), ("a b a", "<A>")]
TEXTS = ["Ann Lee Grant Smith met ann-lee.", "Grant, Lee Grant Smith; lee GRANT", "DB1.CORP and db1 corp, db1_corp", "ZOË zoë Zoé", None, "", "...", "a b a b a b a", "(Ann Lee)\nLee\tGrant\nSmith", "xAnn Lee Ann Leex"]


def plain(text):
    """Leftmost, longest, token by token."""
    if text is None:
        return None, 0
    table = {}
    for name, mark in NAMES:
        key = tuple(t.lower() for t in re.findall(r"\w+", name or ""))
        if key and mark:
            table[key] = min(mark, table.get(key, mark))
    found = list(re.finditer(r"\w+", text))
    out, at, i, n = [], 0, 0, 0
    while i < len(found):
        for size in range(3, 0, -1):
            key = tuple(m[0].lower() for m in found[i : i + size])
            if len(key) == size and key in table:
                out += [text[at : found[i].start()], table[key]]
                at, i, n = found[i + size - 1].end(), i + size, n + 1
                break
        else:
            i += 1
    return "".join(out) + text[at:], n


def test_names_in_free_text(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS + TEXTS[:2] + ["Ann Lee " * 3000])], "doc_id long, text string, pos int")
    names = spark.createDataFrame(NAMES, "name string, mark string")
    got = {r.doc_id: (r.redacted, r.n_names) for r in aliases.replace_names(docs, names).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}
    assert aliases.replace_names(docs, names.limit(0)).filter("n_names > 0 OR NOT redacted <=> text").count() == 0
    assert aliases.replace_names(docs.limit(0), names).count() == 0


def test_names_keep_their_aliases(spark, tmp_path):
    path = f"file://{tmp_path}/names"
    docs = spark.createDataFrame([(1, "Bob met Ann Lee."), (2, "ann lee left")], "doc_id long, text string")
    told = lambda *x: [r.redacted for r in aliases.alias_names(docs, spark.createDataFrame([(n,) for n in x], "name string"), "USER-", path).orderBy("doc_id").collect()]
    assert told("Bob") == ["USER-001 met Ann Lee.", "ann lee left"]
    assert told("Ann Lee", "Al") == ["USER-001 met USER-003.", "USER-003 left"]


def test_a_hundred_thousand_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = spark.range(100_000).select(F.concat(F.lit("host"), "id", F.lit(".example lan")).alias("name"), F.lit("<H>").alias("mark"))
    planted = docs.select("doc_id", F.concat("text", F.lit(" Host"), F.col("doc_id").cast("string"), F.lit(".example.lan")).alias("text"))
    found = aliases.replace_names(planted, names)
    assert not loops(found)
    assert found.agg(F.sum("n_names")).first()[0] == docs.count()


def test_ten_thousand_roots(spark):
    roots = [("k%d" % (i % 3), f"/r/{i % 100}/{i}") for i in range(10_000)] + [("top", "/r/5/"), ("top", "/"), ("z", "/r/6"), ("a", "/r/6/"), (None, None)]
    paths = [f"/r/{i % 100}/{i}/x" for i in range(0, 10_000, 37)] + ["/r/5", "/r/55x", "/r/5/1234", "r/1/1", "/r/6", "/r/6/6", "/", "", None, "/r/1/1", "/r/1/1"]
    df = spark.createDataFrame([(p, "s") for p in paths], "path string, root string")
    got = rules.scope_by_roots(df, spark.createDataFrame(roots, "kind string, root string"))
    assert not loops(got) and got.columns == ["path", "root", "scope"]
    held = {}
    for kind, root in sorted(r for r in roots if r[1] is not None)[::-1]:
        held[root.rstrip("/")] = kind

    def scope(path):
        fits = [r for r in held if path is not None and (path == r or path.startswith(r + "/"))]
        return held[max(fits, key=len)] if fits else "approval_needed"

    assert sorted((str(r.path), r.scope) for r in got.collect()) == sorted((str(p), scope(p)) for p in paths)
    few = [("in", "/r/1"), ("out", "/r/1/1"), ("in", "/r/2/")]
    literal = leaks.scope_check(df, few).select("scope").collect()
    assert sorted(literal) == sorted(rules.scope_by_roots(df, spark.createDataFrame(few, "kind string, root string")).select("scope").collect())


def decide(command, table):
    fits = [(a != "deny", -len(p), p, a) for p, a in table if command is not None and re.search(P.glob_regex(p)[:-1] + r"\Z", command)]
    return min(fits)[2:] if fits else ("*", "ask")


def test_many_rules(spark):
    dice = random.Random(4)
    table = [(f"tool{i} *", dice.choice(["allow", "deny", "ask"])) for i in range(9_990)] + [("*", "allow"), ("??", "deny"), ("?*", "ask"), ("*?", "allow"), ("a.c(*", "deny"), ("a*c", "allow"), ("*x[1]$*", "deny"), ("tool7 *z*", "allow"), ("", "deny"), ("é?é", "deny")]
    commands = [f"tool{i} x" for i in range(0, 12_000, 97)] + ["ab", "a", "", "abc", "a.c(d", "axc(d", "qx[1]$", "tool7 az", "éaé", "éé", None, "a\nc", "ab"]
    df = spark.createDataFrame([(c, 1) for c in commands], "command string, key int")
    got = rules.policy_by_rules(df, spark.createDataFrame(table, "pattern string, action string"))
    assert not loops(got)
    assert sorted((str(r.command), r.pattern, r.action) for r in got.collect()) == sorted((str(c), *decide(c, table)) for c in commands)
    assert {r.action for r in rules.policy_by_rules(df, spark.createDataFrame([], "pattern string, action string")).collect()} == {"ask"}


@pytest.mark.parametrize("n", [0, 3000])
def test_detection_rules(spark, n):
    conditions = [("two", "actor", "eq", "bob"), ("two", "path", "glob", "*/etc/*"), ("num", "k", "at_least", "5"), ("bad", "k", "at_least", "five"), ("none", "colour", "eq", "red"), ("null", "actor", "eq", None), ("all", "path", "glob", "*"), ("odd", "actor", "like", "bob"), *[(f"r{i}", "actor", "eq", f"a{i}") for i in range(n)]]
    rows = [("bob", "/etc/x", 1), ("bob", "/var", 7), ("ann", "/etc/x", 5), (None, None, None), ("a7", "x", 0), ("bob", "/etc/", None)]
    df = spark.createDataFrame([("2024-01-01 00:00:00", *r) for r in rows], "ts string, actor string, path string, k int")
    got = rules.rule_hits(df, spark.createDataFrame(conditions, "rule string, field string, op string, value string"), ("actor", "path", "k"), ("actor", "path"))
    want = [("bob", "/etc/x", "two"), ("bob", "/etc/", "two"), ("bob", "/var", "num"), ("ann", "/etc/x", "num")] + [(a, p, "all") for a, p, _ in rows if p] + ([("a7", "x", "r7")] if n else [])
    assert not loops(got) and sorted(map(tuple, got.collect())) == sorted(want)

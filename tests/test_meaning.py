"""What JSON values, white space, identifiers and profiles mean."""

import json

import pytest

from tracelight.operators import evidence, leaks, runs, transcripts
from tracelight.sources import files


@pytest.mark.parametrize("line, kind", [
    ('{"type":"0","event":"x"}', "0"), ('{"type":"false"}', "false"), ('{"type":0,"event":"x"}', "x"), ('{"type":0.0,"kind":"k"}', "k"), ('{"type":false,"event":[],"kind":{}}', "unknown"),
    ('{"type":null,"event":"e"}', "e"), ('{"type":7}', "7"), ('{"type":true}', "True"), ('{"type":"a","type":"b"}', "b"), (' {"n":1,"n":{"m":2}} \t', "unknown"), ("[1]", None), ('{"type":"a"} x', None), ('{"type":"a"},{"type":"b"}', None), ('{"type":"a"} {"type":"b"}', None), ("{", None), (None, None)])
def test_event_types(spark, line, kind):
    rows = runs.parse_event_lines(spark.createDataFrame([(1, line)], "run_id int, line string"))
    assert [r.event_type for r in runs.event_type_counts(rows).collect()] == ([kind] if kind else [])


def test_only_texts_are_texts(spark):
    message = spark.createDataFrame([(1, '{"role":"assistant"}')], "id int, data string")
    data = ['{"text":5,"content":"c"}', '{"text":{"a":1},"part":{"text":"p"}}', '{"text":""}', '{"content":["x"]}']
    part = spark.createDataFrame([(1, 1, i, d) for i, d in enumerate(data)], "session_id int, message_id int, ord int, data string")
    assert {r.ord: r.text for r in runs.parts_with_role(part, message).collect()} == {0: "c", 1: "p", 2: "", 3: ""}


@pytest.mark.parametrize("message, verdict", [({"content": "0"}, "visible"), ({"content": "false"}, "visible"), ({"content": ""}, "nothing visible"), ({"tool_calls": []}, "nothing visible"), ({"tool_calls": [], "reasoning_details": [1]}, "reasoning only")])
def test_replies(spark, message, verdict):
    df = spark.createDataFrame([(json.dumps({"choices": [{"message": message}]}),)], "reply string")
    assert runs.reply_verdict(df).collect()[0].verdict == verdict


def test_a_heading_may_end_in_any_white_space(spark):
    lines = [(1, 1, "## Release Recommendation\t"), (1, 2, "ready"), (2, 1, "\t##  Release recommendation\r"), (2, 2, "not ready"), (3, 1, "##Release recommendation"), (3, 2, "ready")]
    got = dict(transcripts.release_recommendation(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).collect())
    assert got == {1: "ready", 2: "not ready", 3: None}


@pytest.mark.parametrize("text, redacted", [
    ("see www.language.org and the localised text", "see www.language.org and the localised text"), ("db1.corp.internal, x.lan.", "<HOST>, <HOST>."), ("a.local.b ..c.local", "a.local.b ..<HOST>"),
    ("PASSWORD=abcdefgh123 Api_Key: 12345678", "<TOKEN> <TOKEN>"), ("999.888.777.666 10.0.0.1 1.2.3.4.5 v10.0.0.255.", "999.888.777.666 <IP> 1.2.3.4.5 v<IP>."),
    ("/home/user /home/user/x /home/users /Users/ANALYST/y C:\\Users\\name\\z", "/home/user /home/user/x <USER> /Users/ANALYST/y C:\\Users\\name\\z"), ("a@b.c_d@e.f", "<EMAIL><EMAIL>"),
    ("/evidence/image.E01 /evidence/image.E01x /mnt/c/a", "/evidence/image.E01 <WORKSPACE_PATH> <WORKSPACE_PATH>"), (None, None), ("", "")])
def test_redaction(spark, text, redacted):
    row = leaks.redact(spark.createDataFrame([(text,)], "text string")).collect()[0]
    assert row.redacted == redacted
    assert sum(row[c] for c in row.asDict() if c.startswith("n_") and c != "n_placeholder") == (redacted or "").count("<")


def test_the_corpus_has_a_decision(spark):
    df = spark.createDataFrame([(1, "clean"), (2, "HOST-A"), (None, "mail a@b.org")], "doc_id int, text string")
    got = {r.doc_id: r.decision for r in leaks.release_decision(leaks.redact(df)).collect()}
    assert got == {1: "ready", 2: "ready with noted placeholders", None: "blocked"}


def test_profiles(spark):
    paths = [("a", "x.evtx"), ("a", "y.e01"), ("b", "z.e01"), ("b", "/live/p"), ("c", "/var/www/a.journal"), ("c", "/srv/docker/b.journal"), ("d", "BitLocker key"), ("e", None), (None, "x.evtx")]
    got = {r.evidence_id: tuple(r)[1:] for r in evidence.platform_profile(spark.createDataFrame(paths, "evidence_id string, path string")).collect()}
    assert got == {"a": ("windows", "dead-box image", "unknown", False), "b": ("unknown", "unknown", "unknown", True), "c": ("linux", "unknown", "unknown", False), "d": ("windows", "unknown", "unknown", False), "e": ("unknown", "unknown", "unknown", True), None: ("windows", "unknown", "unknown", False)}


def test_artifacts_without_a_profile_are_deferred(spark):
    artifacts = spark.createDataFrame([(1, "a", "x.evtx"), (2, "b", "x.evtx"), (3, None, "x.evtx")], "artifact_id int, evidence_id string, path string")
    profiles = spark.createDataFrame([("a", "windows")], "evidence_id string, os string")
    got = {r.artifact_id: r.lane for r in evidence.route_artifacts(artifacts, profiles, [("logs", "windows", r"\.evtx$", True)], True).collect()}
    assert got == {1: "logs", 2: "deferred", 3: "deferred"}


def test_loop_rules(spark):
    steps = {1: ["senior", "profiler", "researcher", "provisioner", "report_stub", "collect-", "status", "collect"], 2: ["senior", "researcher", "profiler", "provisioner"], 3: ["senior", "researcher", "report_stub", "collect-", "collect"], 4: ["researcher", "senior", "collect"]}
    rows = [(c, t, s.rstrip("-"), 0 if s.endswith("-") else 1) for c, own in steps.items() for t, s in enumerate(own)]
    got = {r.conv_id: tuple(r)[1:] for r in transcripts.loop_order_check(spark.createDataFrame(rows, "conv_id int, turn int, step string, found int")).collect()}
    assert got == {1: (True, True, True, True), 2: (True, False, True, True), 3: (True, True, True, False), 4: (False, False, False, True)}


def test_a_session_store_is_read(spark, tmp_path):
    for name in ("session", "message", "part"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{name}")
    assert {k: df.count() for k, df in files.read_session_store(spark, f"file://{tmp_path}").items()} == {"session": 3, "message": 3, "part": 3}

"""Semantics that are easy to get wrong, on rows written out here."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelight.operators import evidence, leaks, runs, timeline, transcripts
from tracelight.sources import files
from tracelight.streaming import streams


def one(df):
    return df.collect()[0]


def test_urls_raise_the_drive_flag(spark):
    row = one(leaks.leak_flags(spark.createDataFrame([("https://x.org",)], "text string")))
    assert row.windows_drive_path and row.any_leak


@pytest.mark.parametrize("text, flagged", [("éRAW", False), ("RAW é", True), ("a.e01", True), ("e01x", False), (None, False)])
def test_format_words_have_bounds_in_any_script(spark, text, flagged):
    assert one(leaks.leak_flags(spark.createDataFrame([(text,)], "text string"))).evidence_ext_or_format is flagged


def test_release_words_match_without_bounds(spark):
    lines = [(1, 1, "## Release Recommendation"), (1, 2, "already fine"), (2, 1, "### Release recommendation"), (2, 2, "ready"), (3, 1, "## release recommendation"), (3, 2, "Not ready, not Ready")]
    got = dict(transcripts.release_recommendation(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).collect())
    assert got == {1: "ready", 2: None, 3: "not ready"}


def test_placeholder_owners_are_left_alone(spark):
    texts = [("a", "/home/user/x /home/User/x/ /home/user/home/bob/"), ("b", "/mnt/C/users/Analyst/x/ /mnt/c/Users/dave/"), ("c", None)]
    got = {(r.path, r.label, r.match) for r in leaks.local_path_leaks(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {("a", "Linux home path", "/home/User/"), ("a", "Linux home path", "/home/bob/"), ("b", "WSL-mounted Windows user path", "/mnt/c/Users/dave/"), ("b", "macOS home path", "/Users/dave/")}


def test_objects_only_are_events(spark):
    lines = [("[1]",), ("5",), ('{"type":""}',), ('{"type":0,"event":"x"}',), ("{bad",), ('{"kind":"k"}',)]
    got = {(r.event_type, r.events) for r in runs.event_type_counts(runs.parse_event_lines(spark.createDataFrame(lines, "line string").withColumn("run_id", F.lit(1)))).collect()}
    assert got == {("unknown", 1), ("x", 1), ("k", 1)}


def test_empty_file_keeps_the_hash_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,)], "text string")
    assert [r.sha256_prefix for r in runs.fingerprint(df).collect()] == ["E3B0C44298FC1C14", ""]
    assert [r.sha256_prefix for r in runs.fingerprint(df, stored=True).collect()] == ["", ""]


def test_session_ties_go_to_the_greater_id(spark):
    assert one(runs.latest_session(spark.createDataFrame([(1, "t", "a", 5), (2, "t", "a", 5)], "id int, title string, agent string, time_created int"))).id == 2


def test_leaks_count_in_direct_runs_only(spark):
    rows = [(True, True, True, True, "ok"), (True, False, True, True, "ok"), (True, False, False, True, "failed"), (False, True, False, True, "ok")]
    df = spark.createDataFrame(rows, "preflight_ok boolean, direct boolean, leaks boolean, run_ok boolean, comparison string")
    assert [r.verdict for r in runs.eval_verdict(df).collect()] == ["needs_harness_adjustment", "ok", "needs_harness_adjustment", "blocked"]


def test_sibling_prefixes_are_out_of_scope(spark):
    df = spark.createDataFrame([("/case/a",), ("/case2/a",), ("/case/out/b",), ("/case",)], "path string")
    assert [r.scope for r in leaks.scope_check(df, [("input", "/case"), ("output", "/case/out")]).collect()] == ["input", "approval_needed", "output", "input"]
    assert one(leaks.scope_check(df, [])).scope == "approval_needed"


def test_deny_wins_then_the_longest_pattern(spark):
    df = spark.createDataFrame([("git push x",), ("git status",), ("ls",)], "command string")
    got = leaks.command_policy(df, [("git *", "allow"), ("git push*", "deny"), ("git status*", "ask"), ("*", "ask")]).collect()
    assert [(r.action, r.pattern) for r in got] == [("deny", "git push*"), ("ask", "git status*"), ("ask", "*")]


def test_daylight_saving_and_bad_times(spark):
    rows = [("2024-07-01 12:00:00", "Europe/Berlin"), ("2024-01-01 12:00:00Z", "Europe/Berlin"), ("soon", "UTC"), (None, "UTC")]
    got = timeline.normalise_time(spark.createDataFrame(rows, "local_time string, zone string")).select(F.col("utc").cast("string"), "label_error").collect()
    assert [tuple(r) for r in got] == [("2024-07-01 10:00:00", False), ("2024-01-01 11:00:00", True), (None, False), (None, False)]


def test_sessions_at_the_same_moment_count(spark):
    t = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    sessions = spark.createDataFrame([(1, "h", "a", t(5)), (2, "h", "b", t(5)), (3, "g", "c", t(9))], "event_id long, host string, actor string, ts timestamp_ntz")
    events = spark.createDataFrame([(10, "h", t(4)), (11, "h", t(5)), (12, "h", t(80)), (13, "g", t(8))], "event_id long, host string, ts timestamp_ntz")
    assert {r.event_id: r.actor for r in timeline.attribute_by_session(events, sessions, 3600).collect()} == {10: "unattributed", 11: "b", 12: "b", 13: "unattributed"}


def test_hash_states_cover_both_sides(spark):
    own = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc")], "item_id int, sha256 string")
    listed = spark.createDataFrame([(1, "AA"), (2, "xx"), (4, "dd")], "item_id int, expected string")
    assert dict(evidence.verify_hashes(own, listed).collect()) == {1: "match", 2: "mismatch", 3: "unexpected", 4: "missing"}


def test_redaction_is_complete_and_keeps_placeholders(spark):
    row = one(leaks.redact(spark.createDataFrame([('a.b@c.org 10.0.0.1 token = "0123456789abcdef" /home/bob <EMAIL> box.local',)], "text string")))
    assert row.redacted == "<EMAIL> <IP> <TOKEN> <USER> <EMAIL> <HOST>" and row.n_placeholder == 1 and row.n_email == 1


def test_alias_numbers_follow_the_text_order(spark):
    out, table = leaks.alias_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("ca",), ("cb",)], "u string"), "u", "USER-")
    assert dict(table.collect()) == {"a": "USER-001", "b": "USER-002", "ca": "USER-003", "cb": "USER-004"}
    assert out.filter("u_alias IS NULL").count() == 1 and out.count() == 6


def test_inventory_and_text(spark, tmp_path):
    for path, data in {"a.txt": b"x\xffy", ".git/c": b"1", ".github/d": b"1", "sub/venv/e": b"1", "exports/f": b"1", "sub/exports/g": b"ok", "n.bin": b"a\x00"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    inventory = files.file_inventory(spark, str(tmp_path))
    assert {r.path for r in inventory.select("path").collect()} == {"a.txt", "sub/exports/g", "n.bin"}
    assert dict(files.text_files(inventory).select("path", "text").collect()) == {"a.txt": "xy", "sub/exports/g": "ok"}
    assert dict(files.text_files(inventory, True).select("path", "text").collect())["a.txt"] == "x�y"


def test_expectations_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"required_substrings": ["x"], "forbidden_substrings": []}))
    (tmp_path / "b.json").write_text("{bad")
    assert {r.file: r.status for r in files.load_expectations(spark, str(tmp_path)).collect()} == {"a.json": "ok", "b.json": "blocked"}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_written_rows_are_counted(spark, tmp_path, fmt):
    status = files.write_result(spark.range(7), str(tmp_path / "out"), fmt)
    assert status["row_count"] == 7 and spark.read.format(fmt).load(str(tmp_path / "out")).count() == 7


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("source"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streams.stream_source_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {tuple(r) for r in spark.table("counts").collect()}
    batch = {tuple(r) for r in streams.stream_source_counts(events).collect()}
    last = max(r[0] for r in batch)
    assert got <= batch and len(got) > 0 and all(r in got for r in batch if (last - r[0]).total_seconds() > 2 * 3600)


def test_gate_parts_the_stream_once(spark, tmp_path):
    rows = [(1, "plain", datetime(2024, 1, 1)), (1, "plain", datetime(2024, 1, 1)), (2, "see /home/bob/x", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "doc_id int, text string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string, ts timestamp").parquet(str(tmp_path / "in"))
    to = lambda name: lambda df, n: df.write.mode("append").parquet(str(tmp_path / name))
    streams.stream_leak_gate(stream, to("clean"), to("held"), str(tmp_path / "c")).awaitTermination(60)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "clean")).collect()] == [1]
    held = spark.read.parquet(str(tmp_path / "held")).collect()
    assert [(r.doc_id, r.redacted) for r in held] == [(2, "see <USER>/x")] and "text" not in held[0].asDict()


@pytest.mark.parametrize("minutes", [30, 600])
def test_corroboration_equals_a_plain_interval_join(spark, minutes):
    from tracelight.plans.fixtures import view

    ev = view(spark, "/root/testdata/sf0.001", "ev").filter("event_id % 5 = 0")
    rows = ev.select("event_id", "actor", "source", timeline.micros().alias("us")).collect()
    want = {a.event_id: len({b.source for b in rows if b.actor == a.actor and b.source != a.source and abs(a.us - b.us) <= minutes * 60_000_000}) for a in rows}
    assert {r.event_id: r.sources for r in timeline.corroborate(ev, minutes).collect()} == want

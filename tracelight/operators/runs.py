"""Run logs, session stores, fingerprints and the verdicts on runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import patterns as P

MENTION = "platform-profiler"


def _get(variant: str, path: str) -> Column:
    return F.try_variant_get(F.col(variant), path, "string")


def _last_wins(listed: Column) -> Column:
    """VARIANT of a JSON object that repeats keys, which a VARIANT may not: of each key the last
    value. listed is a list that holds the object alone; null for other texts."""
    rows = F.from_json(F.when(F.get_json_object(listed, "$").isNotNull(), listed), "array<map<string,variant>>")
    pairs = F.map_entries(F.when(F.size(rows) == 1, F.get(rows, F.lit(0))))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"])
    return F.when(F.size(keys) > 0, F.to_variant_object(F.map_from_arrays(keys, values)))


def parse_object(text: Column) -> Column:
    """VARIANT of a text that is a JSON object and nothing else, else null. The text is parsed as
    the one item of a list, so that what follows an object is seen."""
    text = P.strip(text)
    listed = F.concat(F.lit("["), text, F.lit("]"))
    items = F.try_parse_json(listed)
    plain = F.when(F.try_variant_get(items, "$[1]", "variant").isNull(), F.try_variant_get(items, "$[0]", "variant"))
    return F.when(text.startswith("{"), F.when(items.isNotNull(), plain).otherwise(_last_wins(listed)))


def parse_event_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Add event (VARIANT) and keep lines that are JSON objects; others count as malformed."""
    return df.withColumn("event", parse_object(F.col(line_col))).filter(F.col("event").isNotNull())


def _truthy(variant: str, path: str) -> Column:
    """Text of a field, or null where it is absent or counts as false: an empty text, list or
    object, zero, false or null. It is the value's type that decides: the texts 0 and false count."""
    value, kind = _get(variant, path), F.schema_of_variant(F.try_variant_get(F.col(variant), path, "variant"))
    absent = (
        F.when(kind == "STRING", value == "").when(kind.isNull() | (kind == "VOID"), True).when(kind == "BOOLEAN", value == "false")
        .when(kind.startswith("ARRAY"), value == "[]").when(kind.startswith("OBJECT"), value == "{}").otherwise(F.coalesce(value.try_cast("double") == 0, F.lit(False))))
    return F.when(~absent, F.when(kind == "BOOLEAN", F.initcap(value)).otherwise(value))


def _text(variant: str, path: str) -> Column:
    """A field's value where that is a text."""
    return F.when(F.schema_of_variant(F.try_variant_get(F.col(variant), path, "variant")) == "STRING", _get(variant, path))


def event_type(variant: str = "event") -> Column:
    return F.coalesce(*[_truthy(variant, f"$.{k}") for k in ("type", "event", "kind")], F.lit("unknown"))


def event_type_counts(events: DataFrame, key: str = "run_id") -> DataFrame:
    return events.groupBy(key, event_type().alias("event_type")).agg(F.count(F.lit(1)).alias("events"))


def run_event_summary(events: DataFrame, key: str = "run_id", line_col: str = "line", mention: str = MENTION) -> DataFrame:
    line = F.col(line_col)
    task = line.contains(mention) | F.lower(line).contains('"task"')
    final = line.contains("PLATFORM:") | line.contains("HARNESS_VERDICT")
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("parsed_events"), F.count_if(task).alias("task_mentions"), F.count_if(final).alias("final_like"))


def fingerprint(df: DataFrame, text_col: str = "text", stored: bool = False) -> DataFrame:
    """Add bytes and sha256_prefix. Missing text gives an empty prefix; so does empty text that
    comes from a store, while an empty file keeps the hash of no bytes."""
    text = F.col(text_col)
    empty = text.isNull() | (text == "") if stored else text.isNull()
    return df.withColumns({"bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "sha256_prefix": F.when(empty, "").otherwise(P.digest_prefix(text))})


def markers(text: Column) -> dict[str, Column]:
    return {"has_platform": F.contains(text, F.lit("PLATFORM:")), "has_verdict": F.contains(text, F.lit("HARNESS_VERDICT")), "has_minimal_ok": text.rlike(r"(?m)^\s*OK\.?\s*$")}


def output_markers(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in markers(F.col(text_col)).items()})


def latest_session(session: DataFrame) -> DataFrame:
    """The newest session of each (title, agent); ties go to the greater id."""
    order = Window.partitionBy("title", "agent").orderBy(F.desc("time_created"), F.desc("id"))
    return session.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def latest_session_digest(session: DataFrame, message: DataFrame, part: DataFrame, mention: str = MENTION) -> DataFrame:
    """session_digest() of the newest session of each (title, agent), with those. A session
    without assistant parts has no row."""
    newest = latest_session(session).select("title", "agent", F.col("id").alias("session_id"))
    own = part.join(newest.select("session_id"), "session_id", "left_semi")
    return newest.join(session_digest(parts_with_role(own, message), mention), "session_id")


def parts_with_role(part: DataFrame, message: DataFrame) -> DataFrame:
    """part with role, type and text, the first of four fields that holds one. No message, or one
    that cannot be read: empty role. A part that cannot be read: type unparsed."""
    role = message.select(F.col("id").alias("message_id"), F.coalesce(F.try_variant_get(F.try_parse_json("data"), "$.role", "string"), F.lit("")).alias("role"))
    df = part.join(role, "message_id", "left").withColumn("v", F.try_parse_json("data"))
    kind = F.when(F.col("v").isNull(), "unparsed").otherwise(F.coalesce(P.first_text(_get("v", "$.type"), _get("v", "$.part.type")), F.lit("unknown")))
    text = F.coalesce(*[_text("v", p) for p in ("$.text", "$.content", "$.part.text", "$.part.content")], F.lit(""))
    return df.select("session_id", "message_id", "ord", F.coalesce("role", F.lit("")).alias("role"), kind.alias("part_type"), F.when(F.col("v").isNull(), "").otherwise(text).alias("text"), "data")


def part_type_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id", "part_type").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("role") == "assistant").alias("assistant_parts"))


def session_digest(parts: DataFrame, mention: str = MENTION) -> DataFrame:
    """Assistant texts of each session in order, joined by newlines, and what they show. Memory
    is bound by one session, a conversation's worth of text."""
    own = parts.filter(F.col("role") == "assistant")
    mentions = P.occurrences(F.col("data"), mention) + P.occurrences(F.lower("data"), '"task"')
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("ord", "message_id", "text")))), lambda s: s["text"]), "\n")
    found = own.groupBy("session_id").agg(joined.alias("text"), F.count_if(F.col("text") != "").alias("text_parts"), F.sum(mentions).alias("task_mentions"))
    found = fingerprint(found, "text", stored=True)
    flags = P.flags(F.col("text"))
    return found.withColumns({**flags, "any_leak": P.any_of(flags), **markers(F.col("text"))}).drop("text")


def probe_verdict(runs: DataFrame) -> DataFrame:
    """Add verdict to runs (run_ok, usable, leaks, delegation_mode, mentions)."""
    return runs.withColumn(
        "verdict",
        F.when(~F.col("run_ok") & F.col("usable") & ~F.col("leaks"), "partial_ok_process_timeout")
        .when(~F.col("run_ok"), "blocked")
        .when(F.col("leaks"), "needs_harness_adjustment")
        .when(F.col("delegation_mode") & (F.col("mentions") == 0), "needs_harness_adjustment")
        .otherwise("ok"))


def eval_verdict(evals: DataFrame) -> DataFrame:
    """Add verdict to evals (preflight_ok, direct, leaks, run_ok, comparison). Only direct runs
    are checked for leaks."""
    return evals.withColumn(
        "verdict",
        F.when(~F.col("preflight_ok") | ~F.col("run_ok"), "blocked")
        .when(F.col("direct") & F.col("leaks"), "needs_harness_adjustment")
        .when(F.col("comparison").isin("ok", "skipped"), "ok")
        .otherwise("needs_harness_adjustment"))


def reply_verdict(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Add verdict to logged model replies."""
    df = replies.withColumn("v", parse_object(F.col(reply_col)))
    at = lambda name: _truthy("v", f"$.choices[0].message.{name}").isNotNull()
    visible, reasoning = at("content") | at("tool_calls"), at("reasoning_content") | at("reasoning_details")
    verdict = F.when(_get("v", "$.choices[0]").isNull(), "no choices").when(visible, "visible").when(reasoning, "reasoning only").otherwise("nothing visible")
    return df.withColumn("verdict", verdict).drop("v")


def context_fit(requests: DataFrame, limit: int = 16_384, least: int = 16_000, key: str = "request_id") -> DataFrame:
    """Tokens of each request against the context limit; a limit under the minimum fails."""
    total = requests.groupBy(key).agg(F.sum("tokens").alias("tokens"))
    return total.withColumn("verdict", F.when(F.lit(limit) < least, "fail").when(F.col("tokens") > limit, "overflow").otherwise("fits"))


def compare_reports(reports: DataFrame, expectations: DataFrame, key: str = "case_id") -> DataFrame:
    """reports (key, text) against expectations (key, expected JSON with two string arrays):
    key, status, missing, forbidden. No expectation: skipped; no text, or an expectation that
    cannot be read: blocked."""
    schema = "required_substrings array<string>, forbidden_substrings array<string>"
    told = expectations.select(key, "expected", parse_object(F.col("expected")).isNull().alias("broken"), F.from_json("expected", schema).alias("e"))
    df = reports.join(told, key, "left")
    empty = F.lit([]).cast("array<string>")
    missing = F.filter(F.coalesce("e.required_substrings", empty), lambda x: ~F.contains(F.col("text"), x))
    present = F.filter(F.coalesce("e.forbidden_substrings", empty), lambda x: F.contains(F.col("text"), x))
    status = F.when(F.col("expected").isNull(), "skipped").when(F.col("text").isNull() | F.col("broken"), "blocked").when((F.size(missing) == 0) & (F.size(present) == 0), "ok").otherwise("failed")
    counted = status.isin("ok", "failed")
    return df.select(key, status.alias("status"), F.when(counted, F.size(missing)).otherwise(0).alias("missing"), F.when(counted, F.size(present)).otherwise(0).alias("forbidden"))


def run_log(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """rows (key, ts, level): start, end, rows, warnings, errors."""
    return rows.groupBy(key).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("level") == "error").alias("errors"))

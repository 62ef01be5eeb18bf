"""Notes, Markdown reports and agent transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import patterns as P

# Fixed value: the three recommendations.
RELEASE = "(?i)(ready with caveats|not ready|ready)"


def markdown_sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add heading (is the line one?) and section: the last `## ` heading, lower case, at or
    above the line."""
    line = P.strip("line")
    heading = F.coalesce(line.startswith("## "), F.lit(False))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", heading).withColumn("section", F.last(F.when(heading, F.lower(P.strip(F.substr(line, F.lit(4))))), ignorenulls=True).over(order))


def release_recommendation(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, recommendation: the first match in the section of that name; null if there is none. Of a
    line only its heading or its match goes through the window, not its text."""
    line = P.strip("line")
    heading = F.coalesce(line.startswith("## "), F.lit(False))
    title = F.when(heading, F.lower(P.strip(F.substr(line, F.lit(4)))))
    match = F.when(~heading, F.nullif(F.lower(F.regexp_extract("line", RELEASE, 1)), F.lit("")))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.select(key, "line_no", title.alias("title"), match.alias("match")).withColumn("section", F.last("title", ignorenulls=True).over(order))
    found = F.when((F.col("section") == "release recommendation") & F.col("match").isNotNull(), F.struct("line_no", F.col("match").alias("found")))
    return own.groupBy(key).agg(F.min(found).alias("m")).select(key, F.col("m.found").alias("recommendation"))


def release_gate(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add gate: only ready may export."""
    r = F.col("recommendation")
    return release_recommendation(lines, key).withColumn("gate", F.when(r.isNull(), "error").when(r == "ready", "export").when(r == "ready with caveats", "hold").otherwise("block"))


def report_order_check(lines: DataFrame, key: str = "doc_id", wanted: tuple[str, str] = ("executive summary", "findings")) -> DataFrame:
    """key, first, second, in_order: the first two sections of a report."""
    heads = markdown_sections(lines, key).filter("heading").groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "section"))), 1, 2).alias("h"))
    first, second = F.get("h.section", F.lit(0)), F.get("h.section", F.lit(1))
    return heads.select(key, first.alias("first"), second.alias("second"), F.coalesce((first == wanted[0]) & (second == wanted[1]), F.lit(False)).alias("in_order"))


def review_note_check(lines: DataFrame, key: str = "doc_id", required: tuple[str, ...] = P.SECTIONS) -> DataFrame:
    """key, missing (required headings that the note lacks, in order)."""
    own = markdown_sections(lines, key)
    title = F.max((F.lower(P.strip("line")) == "# forensic peer review note").cast("int"))
    per = own.groupBy(key).agg(F.collect_set(F.when(F.col("heading"), F.col("section"))).alias("have"), title.alias("titled"))
    missing = F.concat(F.when(F.col("titled") == 1, F.lit([]).cast("array<string>")).otherwise(F.array(F.lit("title"))), F.array_except(F.array(*[F.lit(s) for s in required]), "have"))
    return per.select(key, missing.alias("missing"))


def helper_note_check(notes: DataFrame, marker: str, required: tuple[str, ...], most_lines: int, least_concrete: int = 0, key: str = "note_id") -> DataFrame:
    """key, verdict: the first rule that a note breaks, or ok."""
    body = F.coalesce("body", F.lit(""))
    lines = F.filter(P.lines_of(body), lambda x: P.strip(x) != "")
    keys = F.regexp_extract_all(body, F.lit(r"(?m)^- ([a-z_]+):"), 1)
    verdict = (
        F.when(P.strip(body) == "", "empty").when(~body.startswith(marker), "no marker").when(F.size(lines) > most_lines, "too long")
        .when(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), keys)) > 0, "missing keys")
        .when(F.size(F.filter(lines, lambda x: x.startswith("- "))) < least_concrete, "too few lines").otherwise("ok"))
    return notes.select(key, verdict.alias("verdict"))


def script_status_check(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """key, statuses, verdict: a script review holds exactly one status line."""
    found = F.regexp_count(F.coalesce("body", F.lit("")), F.lit("SCRIPT_REVIEW: (?:approved-for-controlled-use|blocked)"))
    return notes.select(key, found.cast("long").alias("statuses"), F.when(found == 1, "ok").otherwise("bad").alias("verdict"))


def task_prompt_check(calls: DataFrame, fields: tuple[str, ...], forbidden: tuple[str, ...] = (), most_words: int = 30, key: str = "call_id") -> DataFrame:
    """key, verdict of task calls (JSON in `call`): exact fields, prompt of under most_words
    words on one line."""
    have = F.array_sort(F.coalesce(F.json_object_keys("call"), F.lit([]).cast("array<string>")))
    prompt = F.coalesce(F.get_json_object("call", "$.prompt"), F.lit(""))
    verdict = (
        F.when(F.size(F.array_intersect(have, F.lit(list(forbidden)).cast("array<string>"))) > 0, "forbidden field")
        .when(have != F.lit(sorted(fields)).cast("array<string>"), "wrong fields").when(F.contains(prompt, F.lit("\n")), "more than one line")
        .when(F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != "")) >= most_words, "too long").otherwise("ok"))
    return calls.select(key, verdict.alias("verdict"))


def loop_order_check(steps: DataFrame, order: tuple[str, ...] = ("senior", "profiler", "researcher", "provisioner"), optional: tuple[str, ...] = ("profiler",), key: str = "conv_id") -> DataFrame:
    """key, first_ok, order_ok, stub_ok, status_ok of agent steps (key, turn, step, found): the
    first step is the first of the order; each step of the order comes after the one before it,
    optional ones where they occur; the report stub before the first collection; and after a
    collection that found nothing a status record before the next collection."""
    first = {s: F.min(F.when(F.col("step") == s, F.col("turn"))) for s in (*order, "report_stub", "collect")}
    # of collections and status records, what follows an empty collection
    kept = F.col("step").isin("collect", "status")
    after = F.lead(F.when(kept, F.col("step")), 1).over(Window.partitionBy(key, kept).orderBy("turn"))
    bad = kept & (F.col("step") == "collect") & (F.col("found") == 0) & (after == "collect")
    per = steps.withColumn("__bad", F.coalesce(bad, F.lit(False))).groupBy(key).agg(F.min_by("step", "turn").alias("first_step"), F.max("__bad").alias("bad"), *[c.alias(f"t_{s}") for s, c in first.items()])
    ordered, past = F.lit(True), F.lit(-1)
    for n, s in enumerate(order):
        at = F.col(f"t_{s}")
        if n:
            ordered = ordered & (at.isNull() | F.coalesce(past < at, F.lit(False)))
        past = F.coalesce(at, past) if s in optional else at
    stub = F.col("t_collect").isNull() | F.coalesce(F.col("t_report_stub") < F.col("t_collect"), F.lit(False))
    return per.select(key, (F.col("first_step") == order[0]).alias("first_ok"), ordered.alias("order_ok"), stub.alias("stub_ok"), (~F.col("bad")).alias("status_ok"))


def recent_context(steps: DataFrame, turns: int, tokens: int, key: str = "conv_id") -> DataFrame:
    """The turns to keep: the last `turns`, and newest first as long as their tokens sum up to
    no more than `tokens`."""
    order = Window.partitionBy(key).orderBy(F.desc("turn"))
    df = steps.withColumn("back", F.row_number().over(order)).withColumn("running", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.filter((F.col("back") <= turns) | (F.col("running") <= tokens)).drop("back")


def script_approval(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Runs (run_id, script_id, ts) of generated code with no approved review before them."""
    first = reviews.filter(F.col("status") == "approved").groupBy("script_id").agg(F.min("ts").alias("approved_at"))
    return runs.join(first, "script_id", "left").filter(F.col("approved_at").isNull() | (F.col("approved_at") > F.col("ts"))).select("run_id", "script_id")

"""Timelines: time, windows, gaps, attribution and corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.aliases import numbered_by
from tracelight.sources.files import scratch_dir

def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def fixed_window(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of [start, end); the bounds are literals, so the scan gets the filter."""
    return df.filter((F.col(ts) >= F.to_timestamp_ntz(F.lit(start))) & (F.col(ts) < F.to_timestamp_ntz(F.lit(end))))


def normalise_time(df: DataFrame, local_col: str = "local_time", zone_col: str = "zone") -> DataFrame:
    """Add utc and label_error (a local time that claims to be UTC by a trailing Z). Text that is
    no time gives null."""
    local = F.regexp_replace(F.col(local_col), "Z$", "")
    return df.withColumns({"utc": F.to_utc_timestamp(F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")), F.col(zone_col)), "label_error": F.coalesce(F.col(local_col).endswith("Z"), F.lit(False))})


def super_timeline(*sources: DataFrame) -> DataFrame:
    """All sources as one table, each row once, provisional rows marked unverified."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    status = F.when(F.coalesce(F.col("provisional"), F.lit(False)), "unverified").otherwise("verified")
    return out.withColumn("status", status).dropDuplicates()


def ordered_timeline(df: DataFrame, order: tuple[str, ...] = ("ts", "source", "event_id")) -> DataFrame:
    """df with number, from 1, its place in the whole order: ranges are sorted on their own and
    shifted by the rows before them, so no task sees all rows."""
    return numbered_by(df, list(order), "number")


def lay_out(df: DataFrame, name: str, buckets: int, key: str = "actor", order: str = "number") -> DataFrame:
    """Write df as the table `name`, in buckets by key, each sorted, and return it. What groups or
    joins by the key, and by the key and a slice of time, reads it without an exchange of its rows:
    activity_gaps(), trailing rows, corroborate() and staging_without_transfer(); where what they join
    is too large to broadcast, spark.sql.requireAllClusterKeysForCoPartition must be off. A bucket holds all
    rows of its keys, so a table in which one actor has very many is better left as it is: those
    operators then deal it by slices."""
    spark = df.sparkSession
    df.write.bucketBy(buckets, key).sortBy(key, order).option("path", scratch_dir(spark)).saveAsTable(name)
    return spark.table(name)


def source_status(expected: DataFrame, rows: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each expected source, also where the window holds nothing of it. expected
    (source, negative_evidence)."""
    counts = fixed_window(rows, start, end).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    reason = F.when(n > 0, "rows found").when(F.col("negative_evidence"), "no rows: supports negative evidence").otherwise("no rows: limitation")
    return expected.join(counts, "source", "left").select("source", n.alias("row_count"), reason.alias("reason"))


#: Length of the slices of time that a busy actor's rows are cut into.
SLICE_SECONDS = 86_400


def activity_gaps(df: DataFrame, minutes: int, key: str = "actor", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add segment (from 0, a new one after each idle gap) and gap_minutes before the event.

    An actor's rows are cut into slices of time, each a window of its own. What a slice starts
    with, the last event and the number of gaps before it, comes from one row for each slice. Rows
    without an actor or a time have no such row: each of their slices is by itself."""
    slices = [key, "__slice"]
    rows = df.withColumn("__us", micros()).withColumn("__slice", F.floor(F.col("__us") / (slice_seconds * 1_000_000)))
    order = Window.partitionBy(*slices).orderBy("__us", "event_id")
    along = Window.partitionBy(key).orderBy("__slice")
    ends = rows.groupBy(*slices).agg(F.max("__us").alias("end"))
    ends = ends.select(*slices, F.lag("end").over(along).alias("__before"))
    gap = (F.col("__us") - F.coalesce(F.lag("__us").over(order), F.col("__before"))) / 60_000_000
    rows = _on_slices(rows, ends, key).withColumn("__gap", gap).withColumn("__new", F.coalesce(F.col("__gap") > minutes, F.lit(False)).cast("int"))
    gaps = rows.groupBy(*slices).agg(F.sum("__new").alias("gaps"))
    gaps = gaps.select(*slices, F.coalesce(F.sum("gaps").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    rows = _on_slices(rows, gaps, key).withColumn("segment", F.coalesce("__earlier", F.lit(0)) + F.sum("__new").over(order))
    return rows.select(*df.columns, "segment", F.when(F.col("__new") == 1, F.round("__gap", 3)).alias("gap_minutes"))


def _on_slices(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """rows with what told has for each slice, partitioned as the windows over slices are."""
    return rows.join(told, [key, "__slice"], "left")


def trailing(df: DataFrame, seconds: int, value: Column, name: str, key: str = "actor", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add name: value, an aggregate, over the actor's events in the preceding seconds, this one
    included. Each slice of time is a window of its own, with the events before it that its own
    ones can reach."""
    width, reach = slice_seconds * 1_000_000, seconds * 1_000_000
    rows = df.withColumn("__us", micros())
    own, last = F.floor(F.col("__us") / width), F.floor((F.col("__us") + reach) / width)
    rows = rows.withColumn("__own", own).withColumn("__slice", F.explode_outer(F.sequence(own, last)))
    order = Window.partitionBy(key, "__slice").orderBy("__us").rangeBetween(-reach, 0)
    return rows.withColumn(name, value.over(order)).filter(F.col("__slice").eqNullSafe(F.col("__own"))).drop("__us", "__own", "__slice")


def trailing_activity(df: DataFrame, seconds: int, key: str = "actor", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add trailing: the actor's events in the preceding seconds, this one included."""
    return trailing(df, seconds, F.count(F.lit(1)), "trailing", key, slice_seconds)


def attribute_by_session(events: DataFrame, sessions: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """events (event_id, host, ts) with the actor of the host's last session at or before each.

    A host's rows are cut into slices of time. Within a slice a window carries the last session
    forward; what a slice starts with is the last session of the slices before it, found over
    one row for each host and slice. So one busy host does not end up in one task."""
    own = sessions.select("host", micros().alias("us"), F.lit(None).cast("long").alias("event_id"), F.struct(micros().alias("us"), F.col("event_id").alias("sid"), F.col("actor")).alias("s"))
    asked = events.select("host", micros().alias("us"), "event_id", F.lit(None).cast(own.schema["s"].dataType).alias("s"))
    both = own.unionByName(asked).withColumn("part", F.floor(F.col("us") / (slice_seconds * 1_000_000)))
    order = Window.partitionBy("host", "part").orderBy("us", F.desc_nulls_last(F.col("s").isNotNull()), "s.sid").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("near", F.last("s", ignorenulls=True).over(order)).filter(F.col("event_id").isNotNull())
    heads = both.groupBy("host", "part").agg(F.max("s").alias("s"))
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("host", "part", F.last("s", ignorenulls=True).over(before).alias("earlier"))
    found = carried.join(heads, ["host", "part"], "left").withColumn("s", F.coalesce("near", "earlier"))
    return found.select("event_id", "host", F.coalesce("s.actor", F.lit("unattributed")).alias("actor"))


def corroborate(timeline: DataFrame, minutes: int) -> DataFrame:
    """event_id, sources (distinct other sources of the actor within the minutes either side)
    and confidence.

    For each event only the nearest event of every other source counts, so rows are first
    reduced to one for each actor, source and bucket of time: its earliest and latest. Those of an
    actor's bucket and its neighbours, three for each source, travel as one short array, so that
    each event finds all in one row of one join, however busy its actor."""
    width = minutes * 60_000_000
    rows = timeline.select("event_id", "actor", "source", micros().alias("us")).withColumn("bucket", F.floor(F.col("us") / width))
    ends = rows.groupBy("actor", "source", "bucket").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    spread = ends.select("actor", F.struct("source", "low", "high").alias("end"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    around = spread.groupBy("actor", "bucket").agg(F.collect_list("end").alias("ends"))
    us = F.col("us")
    # a bucket before: its latest row is the nearest; a bucket after: its earliest; the own one is near throughout
    near = lambda e: (e["source"] != F.col("source")) & ((us - e["high"]).between(0, width) | (e["low"] - us).between(0, width) | ((e["low"] <= us) & (us <= e["high"])))
    sources = F.coalesce(F.size(F.array_distinct(F.transform(F.filter("ends", near), lambda e: e["source"]))), F.lit(0)).cast("long")
    found = rows.join(around, ["actor", "bucket"], "left").withColumn("sources", F.when(F.col("ends").isNull(), 0).otherwise(sources).cast("long"))
    return found.select("event_id", "actor", "source", "sources", confidence(F.col("sources") + 1).alias("confidence"))


def confidence(sources: Column) -> Column:
    return F.when(sources >= 3, "high").when(sources == 2, "moderate").otherwise("low")


def staging_without_transfer(df: DataFrame, hours: int, accesses: int, seconds: int = 3600, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Archive events after repeated access by their actor, with no transfer in the hours after:
    event_id, actor, accesses, label."""
    width = hours * 3_600_000_000
    seen = df.filter(F.col("source").isin("file_access", "archive_log"))
    seen = trailing(seen, seconds, F.count_if(F.col("source") == "file_access"), "accesses", "actor", slice_seconds)
    archives = seen.filter((F.col("source") == "archive_log") & (F.col("accesses") >= accesses)).select("event_id", "actor", "accesses", micros().alias("us"))
    last = df.filter(F.col("source") == "transfer_log").select("actor", micros().alias("t")).withColumn("bucket", F.floor(F.col("t") / width))
    last = last.groupBy("actor", "bucket").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    # a transfer after the event is its bucket's latest, or the next bucket's earliest: both stand in one row
    none = F.lit(None).cast("long")
    ends = F.explode(F.array(F.struct("bucket", F.col("high").alias("high"), none.alias("low")), F.struct((F.col("bucket") - 1).alias("bucket"), none.alias("high"), F.col("low").alias("low"))))
    after = last.select("actor", ends.alias("e")).groupBy("actor", "e.bucket").agg(F.max("e.high").alias("high"), F.min("e.low").alias("low"))
    found = archives.withColumn("bucket", F.floor(F.col("us") / width)).join(after, ["actor", "bucket"], "left")
    moved = F.coalesce(F.col("high") > F.col("us"), F.lit(False)) | F.coalesce(F.col("low") <= F.col("us") + width, F.lit(False))
    return found.filter(~moved).select("event_id", "actor", "accesses", F.lit("staging, not exfiltration").alias("label"))


#: Paths that speak of backups or staging, and files of a shell's profile: neither shows that someone was there.
BACKUP_PATH = r"(?i)(^|/)(backups?|staging|dumps?|snapshots?)(/|$)|\.(bak|old|dump)$"
PROFILE_FILE = r"(^|/)\.(bashrc|bash_profile|bash_login|bash_logout|profile|zshrc|zprofile|zshenv|cshrc|kshrc)$"
#: Records that do.
HUMAN_SOURCES = ("session_log", "auth_log", "sudo", "shell_history", "cron")


def server_activity_gate(df: DataFrame, servers: DataFrame, minutes: int, web: tuple[str, ...] = ("browser", "file_access"), human: tuple[str, ...] = HUMAN_SOURCES) -> DataFrame:
    """event_id, host, activity. On server hosts, events of the web sources, and those of any source
    but the human ones whose path is one of a backup or of a shell's profile (where df has paths),
    count as human only with a record of the human sources by the same actor within the minutes
    either side."""
    width = minutes * 60_000_000
    doubtful = F.col("source").isin(*web)
    if "path" in df.columns:
        doubtful = doubtful | (~F.col("source").isin(*human) & (F.col("path").rlike(BACKUP_PATH) | F.col("path").rlike(PROFILE_FILE)))
    rows = df.select("event_id", "host", "actor", "source", F.coalesce(doubtful, F.lit(False)).alias("doubtful"), micros().alias("us")).withColumn("bucket", F.floor(F.col("us") / width))
    on = rows.join(servers.select("host").distinct().withColumn("server", F.lit(True)), "host", "left")
    ends = rows.filter(F.col("source").isin(*human)).groupBy("actor", "bucket").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    ends = ends.select("actor", "low", "high", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    asked = on.filter(F.col("server") & F.col("doubtful"))
    near = (F.col("us") - F.col("high")).between(0, width) | (F.col("low") - F.col("us")).between(0, width) | ((F.col("low") <= F.col("us")) & (F.col("us") <= F.col("high")))
    backed = asked.join(ends, ["actor", "bucket"]).filter(near).select("event_id").distinct().withColumn("backed", F.lit(True))
    gated = F.coalesce("server", F.lit(False)) & F.col("doubtful")
    return on.join(backed, "event_id", "left").select("event_id", "host", F.when(gated & F.col("backed").isNull(), "service_or_unknown").otherwise("human").alias("activity"))


def match_rules(events: DataFrame, rules: dict[str, Column], minutes: int, least: int) -> DataFrame:
    """(rule, actor, window_start, hits): rules are named conditions; a window of an actor counts
    if it has the least hits."""
    named = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    hits = events.select("actor", F.col("ts").cast("timestamp").alias("ts"), F.explode(named).alias("rule"))
    found = hits.groupBy("rule", "actor", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return found.filter(F.col("hits") >= least).select("rule", "actor", F.col("w.start").alias("window_start"), "hits")

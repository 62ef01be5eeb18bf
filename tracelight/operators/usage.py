"""Usage of hosts by actors, from bitmaps that merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators.aliases import numbered

#: The columns that stay at each level, by what grouping_id() calls it.
LEVELS = {0: ("host", "actor"), 1: ("host",), 2: ("actor",), 3: ()}


def source_numbers(df: DataFrame) -> DataFrame:
    """(id, n) of the sources of df; aliases.extend_map() keeps such numbers from one day to the
    next."""
    return numbered(df.select(F.col("source").alias("id")).filter(F.col("id").isNotNull()).distinct())


def usage_state(df: DataFrame, sources: DataFrame) -> DataFrame:
    """(host, actor, kind, bucket, bits, events, first_seen, last_seen): for each host and actor the
    days and the numbers (id, n) of sources as bitmaps, a row for each 32,768 bits; events and
    bounds of time stand with the days. Events become a row for each day and source before anything
    else; sources must number all that occur."""
    few = df.groupBy("host", "actor", F.to_date("ts").alias("day"), "source").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    few = few.join(sources.select(F.col("id").alias("source"), "n"), "source", "left").withColumn("day", F.unix_date("day").cast("long"))
    none = lambda c: F.lit(None).cast(few.schema[c].dataType).alias(c)
    seen = ["events", "first_seen", "last_seen"]
    each = F.explode(F.array(F.struct(F.lit("day").alias("kind"), F.col("day").alias("bit"), *seen), F.struct(F.lit("source").alias("kind"), F.col("n").alias("bit"), *[none(c) for c in seen])))
    bits = few.select("host", "actor", each.alias("x")).select("host", "actor", "x.*")
    return bits.groupBy("host", "actor", "kind", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"), *_sums())


def _sums():
    return F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")


def merge_usage(*states: DataFrame) -> DataFrame:
    """One state of several, such as a kept one and that of a new day."""
    return reduce(DataFrame.unionByName, states).groupBy("host", "actor", "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), *_sums())


def usage_levels(state: DataFrame) -> DataFrame:
    """Activity by host and actor, by host, by actor and in all: host, actor, events, active_days,
    first_seen, last_seen, sources, level. What a level leaves out is joined in its bitmaps, and
    counts are their bits: no event is read again."""
    each = [F.struct(F.lit(level).cast("long").alias("level"), *[(F.col(c) if c in kept else F.lit(None).cast(state.schema[c].dataType)).alias(c) for c in ("host", "actor")]) for level, kept in LEVELS.items()]
    rows = state.withColumn("at", F.explode(F.array(*each))).select("at.*", "kind", "bucket", "bits", "events", "first_seen", "last_seen")
    joined = rows.groupBy("level", "host", "actor", "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), *_sums())
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits"))), F.lit(0))
    found = joined.groupBy("level", "host", "actor").agg(*_sums(), count("day").alias("active_days"), count("source").alias("n_sources"))
    return found.select("host", "actor", "events", "active_days", "first_seen", "last_seen", F.col("n_sources").alias("sources"), "level")


def usage_pattern(df: DataFrame) -> DataFrame:
    """The levels of one table; an empty table has no rows. Null days and sources count for nothing
    but their events."""
    return usage_levels(usage_state(df, source_numbers(df)))

"""Local times by a table of each zone's changes of offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"


def zone_transitions(spark: SparkSession, zones: list[str], first_year: int = 1970, last_year: int = 2037) -> DataFrame:
    """(zone, start, end, offset): the stretches of UTC in which a zone's clocks are `offset` seconds
    ahead, from the engine's own zone tables. The first has no start, the last no end. Days on
    which the offset changes are found first, then the minutes. Names that the engine does not
    know are left out."""
    known = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    days = spark.range(0, 1).select(F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date"))).alias("day"))
    named = F.array(*[F.lit(z) for z in sorted(set(zones)) if known.contains(z)]).cast("array<string>")
    start = F.unix_date("day") * F.lit(86_400).cast("long")
    ahead = lambda seconds: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), F.col("zone"))) - seconds
    by_day = Window.partitionBy("zone").orderBy("second")
    daily = days.select(F.explode(named).alias("zone"), start.alias("second")).withColumn("offset", ahead(F.col("second")))
    first = daily.withColumn("n", F.row_number().over(by_day)).filter("n = 1")
    changed = daily.withColumn("was", F.lag("offset").over(by_day)).filter("was <> offset")
    minutes = changed.select("zone", F.explode(F.sequence(F.col("second") - 86_400, F.col("second"), F.lit(60).cast("long"))).alias("second")).distinct().withColumn("offset", ahead(F.col("second")))
    turns = minutes.withColumns({"was": F.lag("offset").over(by_day), "before": F.lag("second").over(by_day)}).filter("was <> offset AND before = second - 60")
    rows = first.select("zone", F.lit(None).cast("long").alias("second"), "offset").unionByName(turns.select("zone", "second", "offset"))
    along = Window.partitionBy("zone").orderBy(F.col("second").asc_nulls_first())
    utc = lambda c: F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c)
    return rows.select("zone", utc(F.col("second")).alias("start"), utc(F.lead("second").over(along)).alias("end"), F.col("offset").cast("int").alias("offset"))


def _seconds(offset: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset)


def normalise_by_zones(df: DataFrame, transitions: DataFrame, local_col: str = "local_time", zone_col: str = "zone") -> DataFrame:
    """Add utc, utc_other, time_status and label_error (a local time that claims to be UTC by a
    trailing Z). A time that clocks showed once is ok; one that they showed twice (overlap) or never
    (gap) has both instants that it may stand for, the earlier one in utc. unknown zone and
    no time have none.

    Stretches of validity, in local time and widened over gaps, are dealt to the years that they
    touch, so a row joins one short list by zone and year."""
    along = Window.partitionBy("zone").orderBy(F.col("start").asc_nulls_first())
    t = transitions.select("zone", "start", "end", F.col("offset").cast("long").alias("offset")).withColumns({"was": F.lag("offset").over(along), "becomes": F.lead("offset").over(along)})
    low, high = (F.col(c) + _seconds(F.col("offset")) for c in ("start", "end"))
    t = t.select("zone", "offset", low.alias("low"), high.alias("high"),
                 (F.col("start") + _seconds(F.least("offset", F.coalesce("was", "offset")))).alias("from"), (F.col("end") + _seconds(F.greatest("offset", F.coalesce("becomes", "offset")))).alias("to"))
    first, last = t.agg(F.min(F.year("from")), F.max(F.year("to"))).first()
    first, last = (first or 1970) - 1, (last or 1970) + 1
    years = F.sequence(F.coalesce(F.year("from"), F.lit(first)), F.coalesce(F.year("to"), F.lit(last)))
    lists = t.withColumn("__year", F.explode(years)).groupBy(F.col("zone").alias("__zone"), "__year").agg(F.collect_list(F.struct("offset", "low", "high", "from", "to")).alias("__near"))
    text = F.regexp_replace(F.col(local_col), "Z$", "")
    local = F.when(text.rlike(LOCAL), text.try_cast("timestamp_ntz"))
    year = F.least(F.greatest(F.year("__local"), F.lit(first)), F.lit(last))
    rows = df.withColumn("__local", local).withColumns({"__year": F.coalesce(year, F.lit(first)), "__zone": F.col(zone_col)})
    at = F.col("__local")
    within = lambda a, b: (a.isNull() | (at >= a)) & (b.isNull() | (at < b))
    near = F.filter("__near", lambda x: within(x["from"], x["to"]))
    proper = F.size(F.filter("__near", lambda x: within(x["low"], x["high"])))
    utcs = F.when(proper == 1, F.transform(F.filter("__near", lambda x: within(x["low"], x["high"])), lambda x: at - _seconds(x["offset"]))).otherwise(F.transform(near, lambda x: at - _seconds(x["offset"])))
    found = rows.join(lists, ["__zone", "__year"], "left").withColumn("__utcs", F.when(at.isNotNull() & F.col("__near").isNotNull(), utcs))
    status = F.when(F.col("__near").isNull(), "unknown zone").when(at.isNull(), "no time").when(proper == 1, "ok").when(proper > 1, "overlap").otherwise("gap")
    return found.select(*df.columns, F.array_min("__utcs").alias("utc"), F.when(proper != 1, F.array_max("__utcs")).alias("utc_other"), status.alias("time_status"), F.coalesce(F.col(local_col).endswith("Z"), F.lit(False)).alias("label_error"))

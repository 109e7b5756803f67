"""The daily series of one report in many time zones at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import LAST_30D, instant, normalise_report_ts
from trailmetrics.functions.zones import day_in, day_start, days_before
from trailmetrics.operators.slots import slotted
from trailmetrics.sources.facts import between_days


def trend_by_zone(facts: DataFrame, report_ts: str, zones: Sequence[str]) -> DataFrame:
    """``(zone, date, failures)``: the zero-filled series of every zone, from one pass over the facts.

    The days of all zones cut time into slots; a fact is counted in its slot once, whatever the number of zones, and
    the counts of the slots, of which there are some 30 a zone, go to the days that hold them.
    """
    spark, report_ts = facts.sparkSession, normalise_report_ts(report_ts)
    anchor, zone = instant(report_ts), F.col("zone")
    listed = spark.createDataFrame([(name,) for name in sorted(set(zones))], "zone string")
    last = day_in(anchor, zone)
    dates = F.sequence(F.date_sub(last, fixed.TREND_DAYS - 1), last, F.expr("INTERVAL 1 DAY"))
    opened = F.unix_micros(days_before(anchor, LAST_30D.days, zone))
    spine = listed.select("zone", opened.alias("opened"), F.explode(dates).alias("date")).select(
        "zone",
        "date",
        F.greatest("opened", F.unix_micros(day_start(F.col("date"), zone))).alias("from"),
        F.least(F.unix_micros(anchor) + 1, F.unix_micros(day_start(F.date_add("date", 1), zone))).alias("until"),
    )
    days = spine.collect()  # 30 rows for each zone the caller named
    edges = sorted({edge for day in days for edge in (day["from"], day.until)})
    held = [(at, day.zone, day.date) for day in days for at in edges if day["from"] <= at < day.until]
    slots = spark.createDataFrame(held, "at bigint, zone string, date date")
    ends = [F.timestamp_micros(F.lit(end)) for end in (edges[0], edges[-1])]
    counts = slotted(between_days(facts, *ends), edges).groupBy("at").agg(F.count("*").alias("n"))
    found = counts.join(F.broadcast(slots), "at").groupBy("zone", "date").agg(F.sum("n").alias("n"))
    return spine.select("zone", "date").join(found, ["zone", "date"], "left").select(
        "zone", "date", F.coalesce("n", F.lit(0)).cast("bigint").alias("failures")
    )

"""Request telemetry: counts and bytes by window, with the change since the window before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(requests: DataFrame, ts: Column, size: Column, every: str = "1 second") -> DataFrame:
    """(window_start, requests, rx_bytes, total_requests, delta_requests) of every window with requests.

    Windows are aggregated first.  Running totals and differences are taken within a day, and
    each day adds the total, and compares with the last window, of the days before it: only
    the days, one row each, meet in one task.
    """
    per = requests.groupBy(F.window(ts, every)["start"].alias("window_start")).agg(F.count("*").alias("requests"), F.sum(size).cast("long").alias("rx_bytes"))
    per = per.withColumn("day", F.to_date("window_start"))
    days = per.groupBy("day").agg(F.sum("requests").alias("n"), F.max_by("requests", "window_start").alias("last"))
    by_day = Window.orderBy("day")
    days = days.select("day", F.coalesce(F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.coalesce(F.lag("last").over(by_day), F.lit(0)).alias("last"))
    w = Window.partitionBy("day").orderBy("window_start")
    own = per.withColumn("running", F.sum("requests").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("previous", F.lag("requests").over(w))
    return own.join(days, "day").select("window_start", "requests", "rx_bytes", (F.col("running") + F.col("before")).alias("total_requests"), (F.col("requests") - F.coalesce("previous", "last")).alias("delta_requests"))


def live_rates(requests: DataFrame, ts: str, size: Column, every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The same counts over a stream with a watermark."""
    return requests.withWatermark(ts, late).groupBy(F.window(ts, every)["start"].alias("window_start")).agg(F.count("*").alias("requests"), F.sum(size).cast("long").alias("rx_bytes"))

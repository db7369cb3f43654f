"""Case reports as a stream: daily totals as they come, with late deliveries up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_once(reports: DataFrame, lateness: str) -> DataFrame:
    """(series_id, at, amount) of a stream of reports (report_id, series_id, date, new_cases), each report once.

    Usable is what the batch operator takes.  A report delivered again within the watermark counts once; reports
    without report_id cannot be told to be redeliveries, so each counts by itself, as in the batch operator.
    """
    amount = F.col("new_cases").cast("double")
    ok = amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount < float("inf")) & F.col("series_id").isNotNull() & F.col("date").isNotNull()
    timed = reports.where(ok).select("report_id", "series_id", F.col("date").cast("timestamp").alias("at"), amount.alias("amount")).withWatermark("at", lateness)
    known = timed.where(F.col("report_id").isNotNull()).dropDuplicatesWithinWatermark(["report_id", "series_id", "at"])
    return known.unionByName(timed.where(F.col("report_id").isNull())).select("series_id", "at", "amount")


def daily_totals(reports: DataFrame, lateness: str = "30 days") -> DataFrame:
    """(series_id, day, total, n_reports) of the usable reports of each day."""
    days = usable_once(reports, lateness).groupBy("series_id", F.window("at", "1 day").alias("w")).agg(F.sum("amount").alias("total"), F.count("*").alias("n_reports"))
    return days.select("series_id", F.col("w.start").cast("date").alias("day"), "total", "n_reports")


def trailing_totals(reports: DataFrame, days: int = 7, lateness: str = "30 days") -> DataFrame:
    """(series_id, first_day, last_day, total): sliding windows of ``days`` days, one a day."""
    sums = usable_once(reports, lateness).groupBy("series_id", F.window("at", f"{days} days", "1 day").alias("w")).agg(F.sum("amount").alias("total"))
    return sums.select("series_id", F.col("w.start").cast("date").alias("first_day"), F.date_sub(F.col("w.end").cast("date"), 1).alias("last_day"), "total")

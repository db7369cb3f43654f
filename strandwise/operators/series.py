"""Irregular case reports as regular series: grids of periods and trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_reports(reports: DataFrame) -> DataFrame:
    """(series_id, day, amount, n) of the usable reports, redelivered reports once; n is 1 but for equal reports without an id.

    Usable means a finite non-negative amount that is neither null nor NaN, with a series and a date.
    Rows with one report_id are one report (the first delivered counts).  Rows without a
    report_id cannot be told to be redeliveries, so each counts by itself.
    """
    amount = F.col("new_cases").cast("double")
    ok = amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount < float("inf")) & F.col("series_id").isNotNull() & F.col("date").isNotNull()
    content = F.struct(F.col("series_id"), F.col("date").cast("date").alias("day"), amount.alias("amount"))
    return (
        reports.where(ok)
        .select("report_id", F.when(F.col("report_id").isNull(), content).alias("own"), F.struct(F.col("loaded_at"), content.alias("c")).alias("delivery"))
        .groupBy("report_id", "own")
        .agg(F.min("delivery").alias("first"), F.count("*").alias("n"))
        .select("first.c.series_id", "first.c.day", F.when(F.col("report_id").isNull(), F.col("first.c.amount") * F.col("n")).otherwise(F.col("first.c.amount")).alias("amount"), F.when(F.col("report_id").isNull(), F.col("n")).otherwise(1).alias("n"))
    )


def daily_totals(reports: DataFrame, series: DataFrame) -> DataFrame:
    """One row per series and day with a usable report inside the series' span.

    Reports are added up per (series, day) before they meet the series table, so a series with a
    third of all reports is a handful of partial sums by then.
    """
    days = usable_reports(reports).groupBy("series_id", "day").agg(F.sum("amount").alias("total"), F.sum("n").alias("n_reports"))
    return days.join(spans(series), "series_id").where(F.col("day").between(F.col("start_date"), F.col("end_date")))


def spans(series: DataFrame) -> DataFrame:
    """Series with a span; those with a null or reversed span or a step under one day are left out."""
    return (
        series.where(F.col("start_date") <= F.col("end_date")).where((F.col("step_days") >= 1) & F.col("series_id").isNotNull()).select("series_id", "step_days", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date")).dropDuplicates(["series_id"])
    )


def regular_grid(reports: DataFrame, series: DataFrame, max_validity: int | None = None) -> DataFrame:
    """One row per series and period of ``step_days`` from start_date to end_date.

    A day's total holds from its day until the next day with a report, not past end_date, and for ``max_validity`` days at
    most if that is given.  These validity intervals are cut at the period borders; a period's value
    is their average weighted by days, its coverage the share of its days that they cover.
    ``reported`` is the plain sum of the reports dated in the period, ``marked_missing`` that
    there is none (its average, if any, is what the last report before it carries over).
    Periods before the first report, or after ``max_validity``, have null values.
    """
    daily = daily_totals(reports, series)
    by_day = Window.partitionBy("series_id").orderBy("day")
    until = F.coalesce(F.lead("day").over(by_day), F.date_add("end_date", 1))
    if max_validity is not None:
        until = F.least(until, F.date_add("day", max_validity))
    cell = lambda d: F.floor(F.datediff(d, "start_date") / F.col("step_days")).cast("int")
    steps = daily.withColumn("until", until).withColumn("own", cell(F.col("day")))
    cut = (
        steps.withColumn("period", F.explode(F.sequence(F.col("own"), cell(F.date_sub("until", 1)))))
        .withColumn("_from", F.expr("greatest(day, date_add(start_date, period * step_days))"))
        .withColumn("_to", F.expr("least(until, date_add(start_date, (period + 1) * step_days))"))
        .withColumn("_days", F.datediff("_to", "_from"))
    )
    mine = F.col("period") == F.col("own")
    values = cut.groupBy("series_id", "period").agg(
        F.sum(F.col("total") * F.col("_days")).alias("_weighted"),
        F.sum("_days").alias("_covered"),
        F.sum(F.when(mine, F.col("total"))).alias("reported"),
        F.coalesce(F.sum(F.when(mine, F.col("n_reports"))), F.lit(0)).alias("n_reports"),
    )
    grid = spans(series).withColumn("period", F.explode(F.sequence(F.lit(0), cell(F.col("end_date")))))
    start = F.expr("date_add(start_date, period * step_days)")
    length = F.expr("datediff(least(date_add(start_date, (period + 1) * step_days), date_add(end_date, 1)), date_add(start_date, period * step_days))")
    return grid.join(values, ["series_id", "period"], "left").select(
        "series_id",
        start.alias("period_start"),
        length.alias("period_days"),
        (F.col("_weighted") / F.col("_covered")).alias("daily_average"),
        (F.coalesce("_covered", F.lit(0)) / length).alias("coverage"),
        "reported",
        F.coalesce("n_reports", F.lit(0)).alias("n_reports"),
        (F.coalesce("n_reports", F.lit(0)) == 0).alias("marked_missing"),
    )


def trailing_totals(reports: DataFrame, series: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals and averages over the trailing days of every day of every series' span.

    Each day's total adds at its day and subtracts after the window's length; the running sum of
    these deltas is the trailing total.  Days without a report count as zero; so do days before
    the span.  Averages divide by the window's length.  Totals are summed as decimals, so
    no rounding is left behind when an amount leaves the window.
    The groups of the running sum are calendars: one row per day of a span, whatever the reports.
    """
    daily = daily_totals(reports, series).select("series_id", "day", F.col("total").cast("decimal(30,6)").alias("total"))
    zero = F.lit(0).cast("decimal(30,6)")
    names = [f"d{w}" for w in windows]
    delta = lambda day, amounts: F.struct(day.alias("day"), *[x.cast("decimal(30,6)").alias(n) for x, n in zip(amounts, names, strict=True)])
    moves = [delta(F.col("day"), [F.col("total")] * len(windows)), *[delta(F.date_add("day", w), [-F.col("total") if v == w else zero for v in windows]) for w in windows]]
    calendar = spans(series).select("series_id", F.explode(F.sequence("start_date", "end_date")).alias("day"), *[zero.alias(n) for n in names], F.lit(True).alias("listed"))
    deltas = calendar.unionByName(daily.select("series_id", F.explode(F.array(*moves)).alias("x")).select("series_id", "x.*", F.lit(False).alias("listed")))
    per_day = deltas.groupBy("series_id", "day").agg(*[F.sum(n).alias(n) for n in names], F.max("listed").alias("listed"))
    upto = Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = per_day.select("series_id", "day", "listed", *[F.sum(n).over(upto).alias(n) for n in names]).where("listed")
    first = Window.partitionBy("series_id").orderBy("day")
    return summed.select(
        "series_id",
        "day",
        F.row_number().over(first).alias("day_of_span"),
        *[F.col(f"d{w}").cast("double").alias(f"total_{w}") for w in windows],
        *[(F.col(f"d{w}").cast("double") / w).alias(f"average_{w}") for w in windows],
    )

"""Reproduction numbers from case series, substitution rates from dated records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import nucleotides as N
from strandwise.operators import series as S

#: The serial interval's mean, deviation and horizon in days; window; prior shape and rate.
MEAN, DEVIATION, HORIZON, WINDOW, SHAPE, RATE = 5.0, 2.0, 20, 7, 1.0, 0.2


def serial_interval(mean: float = MEAN, deviation: float = DEVIATION, horizon: int = HORIZON) -> list[float]:
    """The gamma density at 1 to ``horizon`` days, scaled to sum to 1; its constant cancels out."""
    k, theta = (mean / deviation) ** 2, deviation**2 / mean
    w = [u ** (k - 1) * math.exp(-u / theta) for u in range(1, horizon + 1)]
    return [x / sum(w) for x in w]


def reproduction_number(reports: DataFrame, spans: DataFrame) -> DataFrame:
    """(series_id, day, infections, pressure, re): renewal estimate of each day from the 27th of the span on.

    Daily totals are filled with zeros over the span.  A day's pressure is the total of the days before weighted by the
    serial interval; re is the posterior mean over the latest 7 days.  Windows of a series look back 26 days
    and run over its calendar, whatever the number of reports.
    """
    daily = S.daily_totals(reports, spans).select("series_id", "day", "total")
    calendar = S.spans(spans).select("series_id", F.explode(F.sequence("start_date", "end_date")).alias("day"))
    filled = calendar.join(daily, ["series_id", "day"], "left").select("series_id", "day", F.coalesce("total", F.lit(0.0)).alias("infections"))
    order = Window.partitionBy("series_id").orderBy("day")
    past = F.collect_list("infections").over(order.rowsBetween(-HORIZON, -1))
    weights = F.array(*[F.lit(w) for w in serial_interval()])
    felt = F.aggregate(F.zip_with(F.reverse(past), weights, lambda i, w: F.coalesce(i, F.lit(0.0)) * w), F.lit(0.0), lambda a, x: a + x)
    lit = filled.select("series_id", "day", "infections", F.row_number().over(order).alias("nth"), felt.alias("pressure"))
    week = order.rowsBetween(-(WINDOW - 1), 0)
    return lit.select("series_id", "day", "nth", "infections", "pressure", ((SHAPE + F.sum("infections").over(week)) / (RATE + F.sum("pressure").over(week))).alias("re")).where(F.col("nth") > HORIZON + WINDOW - 1).drop("nth")


def growth_reproduction(rate: Column, mean: float = MEAN, deviation: float = DEVIATION) -> Column:
    """The reproduction number of exponential growth at ``rate`` a day: 1 over the serial interval's mean of exp(-rate u) (Euler and Lotka)."""
    weights = serial_interval(mean, deviation, max(HORIZON, math.ceil(mean + 6 * deviation)))
    total = F.lit(0.0)
    for u, w in enumerate(weights, 1):
        total = total + F.exp(-rate * u) * w
    return 1 / total


def latest_reproduction_number(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("series_id").agg(F.max("day").alias("day"), F.max_by("re", "day").alias("re"))


def dated_records(alignment: DataFrame, metadata: DataFrame) -> DataFrame:
    """The alignment with date, precision, location and host of the metadata; the last row of a key wins, columns may be null, records without a row stay.

    Keys lose surrounding spaces and tabs.  Rows are ordered by row_id.
    """
    key = F.btrim("sequence_id", F.lit(" \t"))
    day, precision = N.partial_date(F.col("collection_date"))
    last = metadata.select("dataset_id", key.alias("sequence_id"), "row_id", "collection_date", "location", "host").where(F.length("sequence_id") > 0).groupBy("dataset_id", "sequence_id").agg(F.max_by(F.struct("collection_date", "location", "host"), "row_id").alias("m"))
    flat = last.select("dataset_id", "sequence_id", "m.*").select("dataset_id", "sequence_id", day.alias("collected"), precision.alias("precision"), "location", "host")
    return alignment.join(flat, ["dataset_id", "sequence_id"], "left").withColumn("precision", F.coalesce("precision", F.lit("none")))


def clock_points(dated: DataFrame) -> DataFrame:
    """(dataset_id, year, d): what ``clock_rate`` is fitted on."""
    have = dated.where(F.col("collected").isNotNull())
    anchor = have.groupBy("dataset_id").agg(F.min(F.struct("collected", "seq_ord", "seq")).alias("a")).select("dataset_id", F.col("a.seq").alias("anchor"))
    st = N.pair_states(F.col("anchor"), F.col("seq"))
    rows = have.join(anchor, "dataset_id").select("dataset_id", N.decimal_year(F.col("collected")).alias("year"), st.alias("st"))
    p: Column = N.count_of(F.col("st"), "sv") / F.when(N.count_of(F.col("st"), "=sv") > 0, N.count_of(F.col("st"), "=sv"))
    return rows.select("dataset_id", "year", p.alias("p")).where(1 - F.col("p") * 4 / 3 > 0).withColumn("d", N.jukes_cantor(F.col("p"))).drop("p")


def clock_rate(dated: DataFrame) -> DataFrame:
    """Per dataset: slope, intercept and R squared of the JC69 distance to the earliest record on the decimal year.

    Undated records and saturated or incomparable pairs are left out.  Null with fewer than two distinct dates.
    """
    rows = clock_points(dated)
    fit = rows.groupBy("dataset_id").agg(F.count("*").alias("n_dated"), F.countDistinct("year").alias("n_dates"), F.regr_slope("d", "year").alias("mu"), F.regr_intercept("d", "year").alias("intercept"), F.regr_r2("d", "year").alias("r2"))
    two = F.col("n_dates") >= 2
    return fit.select("dataset_id", "n_dated", "n_dates", *[F.when(two, F.col(c)).alias(c) for c in ("mu", "intercept", "r2")])

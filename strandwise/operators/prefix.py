"""Running sums and numbers that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.session import checkpointed


def running_sums(df: DataFrame, keys: Sequence[str], bucket: Column, order: str, values: Sequence[str], prefix: str = "run_") -> DataFrame:
    """``df`` with the running sum of each value column over ``order`` within ``keys``.

    Rows with equal ``order`` see each other.  ``bucket`` must not decrease as ``order`` grows.
    The sum is taken in two levels: rows are summed within (keys, bucket), the totals of a key's
    buckets are summed over its buckets, and the two are added.  No task ever holds a whole key,
    only one of its buckets or one row per bucket.  Both levels use one exchange on (keys, bucket).
    Keys and bucket must not be null.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket).repartition(*[F.col(c) for c in [*keys, "_bucket"]])
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    base = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values])
    inner = cut.select("*", *[F.sum(v).over(within).alias(f"_w_{v}") for v in values])
    joined = inner.join(base, [*keys, "_bucket"])
    return joined.select(*[joined[c] for c in df.columns], *[(F.col(f"_b_{v}") + F.col(f"_w_{v}")).alias(f"{prefix}{v}") for v in values])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the place of each row within ``keys`` in ``order``, counted from 1, without ever sorting a whole key in one task.

    Rows are cut by range of (keys, order), so that a large key lies in several parts one after another; they are numbered
    within their part, after the rows of the parts before.  The order must tell all rows of a key apart, or
    equal rows take their places at will.  The parts are written once, as a cut by range is drawn anew each time.
    """
    keys = list(keys)
    cut = checkpointed(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = cut.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.equal_null(F.col(k), F.col(f"_{k}"))
    return own.join(base, same).select(*df.columns, (F.col("_base") + F.col("_nth")).alias(name))

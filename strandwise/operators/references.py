"""References to records that do not exist, report per table and period."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.prefix import running_sums

#: Rows whose own time is unknown are judged after every delivery.
END_OF_TIME = "9999-12-31 00:00:00"


def child_rows(children: Mapping[str, DataFrame], key: str = "sequence_id", row: str = "row_id", at: str = "loaded_at") -> DataFrame:
    """(child_table, row_id, key, t) of every row that refers to something.

    Keys lose surrounding spaces and tabs; null and empty ones refer to nothing and are left out.
    A null time counts as the end of time.  Other columns of the children are not read.
    """
    parts = [
        df.select(
            F.lit(name).alias("child_table"),
            F.col(row).cast("bigint").alias("row_id"),
            F.btrim(F.col(key), F.lit(" \t")).alias("key"),
            F.coalesce(F.col(at), F.lit(END_OF_TIME).cast(dict(df.dtypes)[at])).cast("timestamp").alias("t"),
        ).where(F.length("key") > 0)
        for name, df in children.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_references(
    children: Mapping[str, DataFrame],
    parents: DataFrame,
    key: str = "sequence_id",
    row: str = "row_id",
    at: str = "loaded_at",
    gone: str = "deleted_at",
) -> DataFrame:
    """(child_table, row_id, t, kind) of the rows whose key has no live parent at their time.

    A parent row is live at t if it was loaded at or before t and not deleted by t.  ``kind`` is
    ``missing`` if no parent ever had the key, ``late`` if all parents with it load after t, else
    ``deleted``.  A parent row without a load time never becomes live; one deleted at or before
    its load never does either, but counts as loaded.  Repeated child rows come out as often as
    they go in; repeated parent rows change nothing.  Empty tables give no rows, or ``missing``.

    The distinct foreign keys are anti-joined with the distinct parent keys.  For keys that exist,
    deliveries (+1) and deletions (-1) are put on one time line per key and summed up to each
    distinct (key, t); a key with a third of all rows is cut by day.  The orphans are
    joined back to the rows on (key, t).
    """
    rows = child_rows(children, key, row, at)
    held = parents.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("lo"), F.col(gone).cast("timestamp").alias("hi")).where(F.col("key").isNotNull())
    parent_keys = held.select("key").distinct()
    foreign = rows.select("key", "t").distinct()
    missing = foreign.join(parent_keys, "key", "left_anti").select("key", "t", F.lit("missing").alias("kind"))
    known = foreign.join(parent_keys, "key", "left_semi")

    ever = F.col("hi").isNull() | (F.col("hi") > F.col("lo"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    loads = held.where(F.col("lo").isNotNull()).select("key", F.col("lo").alias("t"), F.when(ever, one).otherwise(zero).alias("live"), one.alias("loads"), zero.alias("asked"))
    ends = held.where(F.col("hi") > F.col("lo")).select("key", F.col("hi").alias("t"), (-one).alias("live"), zero.alias("loads"), zero.alias("asked"))
    asked = known.select("key", "t", zero.alias("live"), zero.alias("loads"), one.alias("asked"))
    line = loads.unionByName(ends).unionByName(asked).groupBy("key", "t").agg(F.sum("live").alias("live"), F.sum("loads").alias("loads"), F.max("asked").alias("asked"))
    summed = running_sums(line, ["key"], F.to_date("t"), "t", ["live", "loads"])
    unheld = summed.where((F.col("asked") > 0) & (F.col("run_live") <= 0)).select("key", "t", F.when(F.col("run_loads") == 0, "late").otherwise("deleted").alias("kind"))
    return rows.join(missing.unionByName(unheld), ["key", "t"]).select("child_table", "row_id", "key", "t", "kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per child table, month and kind."""
    return orphans.groupBy("child_table", F.date_format("t", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"))

"""Column profiles of loads: induced patterns, ranges, nulls and shifts between loads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.prefix import running_sums
from strandwise.session import broadcast_if_small, checkpointed

#: An optional minus, digits, optionally a point and digits, optionally an exponent.
NUMBER = r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
#: Both ends belong to the range.
RANGES: Mapping[str, tuple[float, float]] = {"gvi": (0.0, 1.0), "coverage_pct": (0.0, 100.0), "mu": (0.0, 0.01)}
NULL_CHANGE, SHIFT = 0.1, 0.3
#: Parts that a range is cut into, and each part again.
BUCKETS = 256
#: Bits of one character of a text, of one element of an expression, and of naming an expression.
TEXT_BITS, ELEMENT_BITS, HEAD_BITS = 8.0, 10.0, 8.0


#: Code points that stand for parts of an expression: a digit, a run of digits, a number, a run of small letters, one of capitals.  Values that hold one of them keep their text.
DIGIT, DIGITS, AMOUNT, SMALL, CAPITAL = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
#: What each part says in a regular expression; all else stands for itself.
PARTS = {DIGIT: "[0-9]", DIGITS: "[0-9]+", AMOUNT: NUMBER, SMALL: "[a-z]+", CAPITAL: "[A-Z]+"}
#: Expressions of which every text is a number.
NUMBERS = f"\\A({AMOUNT}|-?[{DIGIT}{DIGITS}]+(\\.[{DIGIT}{DIGITS}]+)?([eE][+-]?[{DIGIT}{DIGITS}]+)?)\\z"
#: Bits that tell which of ten digits, 26 letters, and about how long a run.
DIGIT_BITS, LETTER_BITS, RUN_BITS = 3.3219, 4.7004, 2.0


def _shape(value: Column) -> Column:
    """The value with its digits replaced by DIGIT; null if it holds a stand-in already."""
    return F.when(~value.rlike(f"[{DIGIT}-{CAPITAL}]"), F.translate(value, "0123456789", DIGIT * 10))


def _regex(key: Column) -> Column:
    out = F.regexp_replace(key, f"([^0-9A-Za-z{DIGIT}-{CAPITAL}])", r"\\$1")
    for part, text in PARTS.items():
        out = F.replace(out, F.lit(part), F.lit(text))
    return out


def distinct_values(table: DataFrame, columns: list[str], load: str) -> DataFrame:
    """(load, column_name, value, n): the rows of each value, null included, added up before any shuffle."""
    long = table.select(F.col(load).alias("load_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.select("load_id", "x.*").groupBy("load_id", "column_name", "value").agg(F.count("*").alias("n"))


def induced_expressions(values: DataFrame) -> DataFrame:
    """(column_name, shape, fixed, key, expression, numbers, n_distinct): the expressions that shorten a column's description.

    A distinct value can be written as plain text or by an expression of one of four kinds, each a generalisation of
    the one before: its characters with any digits in their places; runs of digits of any length; numbers with or without
    sign, fraction and exponent; runs of letters as well.  An expression costs its own length once, plus for each
    distinct value the bits that pick its digits, run lengths, optional parts and letters.  From the most special to the most general,
    a family of values takes the general expression if that costs less than the best of the special ones:
    minimum description length over all distinct values.  Shapes cheapest as plain text get no row: their
    values conform to nothing.  ``numbers`` says that all texts of an expression are numbers, ``fixed`` shows the shape with 9, A and a.

    Costs depend on shapes only, so values are counted per shape first; nothing is ever gathered per column.
    """
    shapes = checkpointed(
        values.where(F.col("value").isNotNull()).select("column_name", "value").distinct()
        .withColumn("shape", _shape(F.col("value"))).where(F.col("shape").isNotNull())
        .groupBy("column_name", "shape").agg(F.count("*").cast("double").alias("n"))
    )
    runs = F.regexp_replace("shape", f"{DIGIT}+", DIGITS)
    amounts = F.regexp_replace("runs", f"-?{DIGITS}(\\.{DIGITS})?([eE][+-]?{DIGITS})?", AMOUNT)
    letters = F.regexp_replace(F.regexp_replace("amounts", "[a-z]+", SMALL), "[A-Z]+", CAPITAL)
    count = lambda c, x: F.length(c) - F.length(F.translate(c, x, ""))
    digits = count(F.col("shape"), DIGIT) * DIGIT_BITS
    lengths = digits + count(F.col("runs"), DIGITS) * RUN_BITS
    options = lengths + count(F.col("amounts"), AMOUNT) * 3.0
    picks = options + (count(F.col("letters"), SMALL) + count(F.col("letters"), CAPITAL)) * RUN_BITS + (F.length("shape") - F.length(F.regexp_replace("shape", "[A-Za-z]", ""))) * LETTER_BITS
    own = lambda key: HEAD_BITS + F.length(key) * ELEMENT_BITS
    n = F.col("n")
    one = shapes.withColumn("runs", runs).withColumn("amounts", amounts).withColumn("letters", letters)
    one = one.select("*", (own("shape") + n * digits).alias("cost"), (n * (F.length("shape") * TEXT_BITS + HEAD_BITS)).alias("plain"), (n * lengths).alias("b2"), (n * options).alias("b3"), (n * picks).alias("b4"))
    total = lambda c: F.sum(c).alias(c)
    two = one.groupBy("column_name", "runs", "amounts", "letters").agg(F.sum(F.least("cost", "plain")).alias("below"), total("b2"), total("b3"), total("b4")).withColumn("cost", own("runs") + F.col("b2"))
    three = two.groupBy("column_name", "amounts", "letters").agg(F.sum(F.least("cost", "below")).alias("below"), total("b3"), total("b4")).withColumn("cost", own("amounts") + F.col("b3"))
    four = three.groupBy("column_name", "letters").agg(F.sum(F.least("cost", "below")).alias("below"), total("b4")).withColumn("cost", own("letters") + F.col("b4"))
    pays = (F.col("cost") < F.col("below")).alias("pays")
    chosen = one.select("column_name", "shape", "runs", "amounts", "letters", "n", (F.col("cost") < F.col("plain")).alias("pays_1"))
    for name, level in (("runs", two), ("amounts", three), ("letters", four)):
        chosen = chosen.join(level.select("column_name", name, pays.alias(f"pays_{name}")), ["column_name", name])
    key = F.when(F.col("pays_letters"), F.col("letters")).when(F.col("pays_amounts"), F.col("amounts")).when(F.col("pays_runs"), F.col("runs")).when(F.col("pays_1"), F.col("shape"))
    plain = F.translate(F.regexp_replace(F.regexp_replace("shape", "[a-z]", "a"), "[A-Z]", "A"), DIGIT, "9")
    return chosen.withColumn("key", key).where(F.col("key").isNotNull()).select("column_name", "shape", plain.alias("fixed"), "key", _regex(F.col("key")).alias("expression"), F.col("key").rlike(NUMBERS).alias("numbers"), F.col("n").cast("bigint").alias("n_distinct"))


def judged_values(values: DataFrame, expressions: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """``values`` with the expression each conforms to, whether it is well-formed, its number if valid, and the part of the range that lies in.

    A value conforms if an induced expression covers it of which every text is a number.  The others are the candidates for
    ill-formed values and checked one by one, so a common wrong spelling that earned an
    expression of its own is found as surely as a rare one, and a rare right one is not called wrong.
    """
    joined = values.withColumn("shape", _shape(F.col("value"))).join(expressions.select("column_name", "shape", "expression", "numbers"), ["column_name", "shape"], "left")
    conforms = F.coalesce("numbers", F.lit(False))
    formed = F.when(F.col("value").isNull(), F.lit(None)).when(conforms, F.lit(True)).otherwise(F.col("value").rlike(rf"\A{NUMBER}\z"))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b) in ranges.items():
        low, high = F.when(F.col("column_name") == name, F.lit(a)).otherwise(low), F.when(F.col("column_name") == name, F.lit(b)).otherwise(high)
    out = joined.withColumn("conforms", conforms).withColumn("well_formed", formed).withColumn("number", F.when(F.col("well_formed"), F.col("value").try_cast("double")))
    out = out.withColumn("valid", F.when(F.col("well_formed"), F.coalesce(F.col("number").between(low, high) & ~F.isnan("number"), F.lit(False))))
    share = (F.col("number") - low) / (high - low) * BUCKETS * BUCKETS
    return out.withColumn("fine", F.when(F.col("valid"), F.floor(share).cast("int"))).withColumn("bucket", F.floor(F.col("fine") / BUCKETS).cast("int"))


def cells_of(judged: DataFrame) -> DataFrame:
    """Rows, distinct values and extremes of each load, column, expression and bucket of the range: all that is added up of the values, in one pass."""
    n = F.col("n")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    return judged.groupBy("load_id", "column_name", "expression", "bucket", F.col("value").isNull().alias("absent")).agg(
        F.sum(n).cast("bigint").alias("n_rows"), F.count_if(F.col("value").isNotNull()).alias("n_distinct"), some(~F.col("conforms")).alias("n_nonconforming"), some(~F.col("well_formed")).alias("n_ill_formed"),
        some(~F.col("valid")).alias("n_out_of_range"), some(F.col("valid")).alias("n_valid"), F.min(F.when(F.col("valid"), F.col("number"))).alias("min_valid"), F.max(F.when(F.col("valid"), F.col("number"))).alias("max_valid"),
    )


def load_statistics(cells: DataFrame) -> DataFrame:
    """One row per load and column: rows, nulls, distinct values, nonconforming and invalid rows, range, valid rows."""
    present = ~F.col("absent")
    some = lambda c, cond=None: F.coalesce(F.sum(c if cond is None else F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    return cells.groupBy("load_id", "column_name").agg(
        some("n_rows").alias("n_rows"), some("n_rows", ~present).alias("n_null"), some("n_distinct").alias("n_distinct"), some("n_nonconforming", present).alias("n_nonconforming"), some("n_ill_formed").alias("n_ill_formed"),
        some("n_out_of_range").alias("n_out_of_range"), some("n_valid").alias("n_valid"), F.min("min_valid").alias("min_valid"), F.max("max_valid").alias("max_valid"),
    )


def _pairs(loads: DataFrame) -> DataFrame:
    return loads.where(F.col("previous_load_id").isNotNull()).select("load_id", "previous_load_id").distinct()


def _roles(loads: DataFrame) -> DataFrame:
    """(source, load_id, now): each load with a previous one takes part in its own comparison as now, and the previous one as then."""
    both = F.array(F.struct(F.col("load_id").alias("source"), F.lit(1).alias("now")), F.struct(F.col("previous_load_id").alias("source"), F.lit(0).alias("now")))
    return broadcast_if_small(checkpointed(_pairs(loads).select("load_id", F.explode(both).alias("x")).select("x.source", "load_id", "x.now")))


def _now_and_then(counts: DataFrame, roles: DataFrame, n: str) -> DataFrame:
    """``counts`` of the loads in their roles, the rows' ``n`` as ``now`` or as ``then``."""
    zero = F.lit(0).cast("bigint")
    others = [c for c in counts.columns if c not in ("load_id", n)]
    met = counts.withColumnRenamed("load_id", "source").join(roles.withColumnRenamed("now", "_now"), "source")
    return met.select("load_id", *others, F.when(F.col("_now") == 1, F.col(n)).otherwise(zero).alias("now"), F.when(F.col("_now") == 0, F.col(n)).otherwise(zero).alias("then"))


def distribution_shifts(judged: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(load_id, column_name, shift, shifted): the largest difference of the shares of valid values <= x in a load and the one before.

    The differences at the borders of the range's buckets follow from the cells.  Inside a bucket the difference cannot leave
    what its own rows allow, so values are summed up in order only in the buckets that could hold more than the best border;
    those are cut again, so that no task holds more than a part of a bucket.  Null if either load has no valid value.
    """
    counts = cells.where("n_valid > 0").groupBy("load_id", "column_name", "bucket").agg(F.sum("n_valid").alias("n"))
    lines = _now_and_then(counts, roles, "n").groupBy("load_id", "column_name", "bucket").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    whole = Window.partitionBy("load_id", "column_name")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = lambda c: c.cast("decimal(18,0)")
    # One row per bucket of a load and column; shares are compared as whole numbers, without rounding.
    sums = lines.select("*", F.sum("now").over(whole).alias("n_now"), F.sum("then").over(whole).alias("n_then"), F.sum("now").over(upto).alias("r_now"), F.sum("then").over(upto).alias("r_then")).where("n_now > 0 and n_then > 0")
    gap = lambda now, then: big(now) * big(F.col("n_then")) - big(then) * big(F.col("n_now"))
    before = gap(F.col("r_now") - F.col("now"), F.col("r_then") - F.col("then"))
    most = F.greatest(before + big(F.col("now")) * big(F.col("n_then")), -before + big(F.col("then")) * big(F.col("n_now")))
    sums = checkpointed(sums.withColumn("gap", F.abs(gap(F.col("r_now"), F.col("r_then")))).withColumn("most", most).withColumn("best", F.max("gap").over(whole)))
    open_ = sums.where("most > best").select("load_id", "column_name", "bucket", "n_now", "n_then", (F.col("r_now") - F.col("now")).alias("b_now"), (F.col("r_then") - F.col("then")).alias("b_then"))
    open_ = broadcast_if_small(checkpointed(open_))
    asked = open_.join(roles, "load_id").select(F.col("source").alias("load_id"), "column_name", "bucket").distinct()
    inside = judged.where("valid").join(broadcast_if_small(checkpointed(asked)), ["load_id", "column_name", "bucket"], "left_semi").groupBy("load_id", "column_name", "bucket", "fine", "number").agg(F.sum("n").alias("n"))
    inside = checkpointed(inside)
    line = _now_and_then(inside, roles, "n").join(open_.select("load_id", "column_name", "bucket"), ["load_id", "column_name", "bucket"], "left_semi")
    summed = running_sums(line, ["load_id", "column_name", "bucket"], F.col("fine"), "number", ["now", "then"])
    exact = summed.join(open_, ["load_id", "column_name", "bucket"]).select("load_id", "column_name", "n_now", "n_then", F.abs(gap(F.col("b_now") + F.col("run_now"), F.col("b_then") + F.col("run_then"))).alias("gap"))
    scale = big(F.col("n_now")) * big(F.col("n_then"))
    return (
        sums.select("load_id", "column_name", "n_now", "n_then", "gap").unionByName(exact).groupBy("load_id", "column_name", "n_now", "n_then").agg(F.max("gap").alias("gap"))
        .select("load_id", "column_name", (F.col("gap").cast("double") / scale.cast("double")).alias("shift"), (F.col("gap") * 10 > scale * int(SHIFT * 10)).alias("shifted"))
    )


def coverage_changes(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(load_id, column_name, coverage_change): the largest change of an expression's share of the non-null rows since the load before.

    Null without such rows in the load or in the one before.
    """
    held = cells.where(~F.col("absent")).groupBy("load_id", "column_name", F.coalesce("expression", F.lit("")).alias("expression")).agg(F.sum("n_rows").alias("n"))
    line = _now_and_then(held, roles, "n").groupBy("load_id", "column_name", "expression").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    totals = line.groupBy("load_id", "column_name").agg(F.sum("now").alias("n_now"), F.sum("then").alias("n_then")).where("n_now > 0 and n_then > 0")
    change = F.max(F.abs(F.col("now") / F.col("n_now") - F.col("then") / F.col("n_then")))
    return line.join(totals, ["load_id", "column_name"]).groupBy("load_id", "column_name").agg(change.alias("coverage_change"))


def _judged(table: DataFrame, ranges: Mapping[str, tuple[float, float]], load: str) -> tuple[DataFrame, DataFrame]:
    """(judged values, cells).  The distinct values are written once, as expressions, cells and shifts read them; so are the few rows of expressions and cells."""
    values = checkpointed(distinct_values(table.where(F.col(load).isNotNull()), list(ranges), load))
    judged = judged_values(values, broadcast_if_small(checkpointed(induced_expressions(values))), ranges)
    return judged, checkpointed(cells_of(judged))


def load_profile(table: DataFrame, loads: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES, load: str = "load_id") -> DataFrame:
    """One row per load and column of ``ranges``: statistics, changes since the load before, and one flag per issue.

    Every row counts, repeated ones as often as they come.  Rows with a null load are no load's
    and are left out.  A load that ``loads`` does not list, or whose previous load is
    null or has no rows, has null changes and raises neither ``nulls`` nor ``shift``.  Values that
    differ in spelling only (0.5, 0.50) are equal.  Infinite numbers are out of range.
    Shares are compared as whole numbers, so a difference of just the limit is no issue.
    """
    judged, cells = _judged(table, ranges, load)
    stats, roles = load_statistics(cells), _roles(loads)
    pairs = loads.select("load_id", "previous_load_id").dropDuplicates(["load_id"])
    before = stats.select(F.col("load_id").alias("previous_load_id"), "column_name", F.col("n_rows").alias("p_rows"), F.col("n_null").alias("p_null"))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    nulls = F.abs(big("n_null") * big("p_rows") - big("p_null") * big("n_rows")) * 10 > big("n_rows") * big("p_rows") * int(NULL_CHANGE * 10)
    return (
        stats.join(pairs, "load_id", "left")
        .join(before, ["previous_load_id", "column_name"], "left")
        .join(distribution_shifts(judged, cells, roles), ["load_id", "column_name"], "left")
        .join(coverage_changes(cells, roles), ["load_id", "column_name"], "left")
        .select(
            "load_id", "column_name", "n_rows", (F.col("n_null") / F.col("n_rows")).alias("null_share"), "n_distinct", "n_nonconforming", "n_ill_formed", "n_out_of_range", "n_valid", "min_valid", "max_valid",
            (F.col("n_null") / F.col("n_rows") - F.col("p_null") / F.col("p_rows")).alias("null_change"), "shift", "coverage_change",
            (F.col("n_ill_formed") > 0).alias("pattern"), (F.col("n_out_of_range") > 0).alias("range"), ((F.col("n_valid") > 0) & (F.col("min_valid") == F.col("max_valid"))).alias("constant"),
            F.coalesce(nulls, F.lit(False)).alias("nulls"), F.coalesce("shifted", F.lit(False)).alias("shifted"),
        )
    )


def expression_profile(table: DataFrame, loads: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES, load: str = "load_id") -> DataFrame:
    """(load_id, column_name, n_nonconforming, coverage_change, expressions): how a load's values are spelt, against the load before.

    ``expressions`` lists (expression, n_rows) of the load's non-null values, most rows first; values without an expression
    come under the empty one.  ``coverage_change`` is the largest change of an expression's share of
    the non-null rows; null without a previous load that has such rows, or without such rows of its own.
    """
    _, cells = _judged(table, ranges, load)
    spelt = cells.where(~F.col("absent")).groupBy("load_id", "column_name", F.coalesce("expression", F.lit("")).alias("expression")).agg(F.sum("n_rows").alias("n_rows"))
    listed = spelt.groupBy("load_id", "column_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_rows")).alias("m"), "expression"))).alias("x"))
    listed = listed.select("load_id", "column_name", F.transform("x", lambda e: F.struct(e["expression"].alias("expression"), (-e["m"]).alias("n_rows"))).alias("expressions"))
    sums = load_statistics(cells).select("load_id", "column_name", "n_nonconforming")
    return sums.join(coverage_changes(cells, _roles(loads.where(F.col("previous_load_id").isNotNull()).dropDuplicates(["load_id"]))), ["load_id", "column_name"], "left").join(listed, ["load_id", "column_name"], "left").select("load_id", "column_name", "n_nonconforming", "coverage_change", "expressions")


def load_issues(profile: DataFrame) -> DataFrame:
    """(load_id, column_name, issue): one row per raised flag."""
    flags = [("pattern", "pattern"), ("range", "range"), ("constant", "constant"), ("nulls", "nulls"), ("shift", "shifted")]
    raised = F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) for name, c in flags]))
    return profile.select(F.col("load_id").cast("bigint").alias("load_id"), "column_name", F.explode(raised).alias("issue"))

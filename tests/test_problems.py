"""Edge cases of the general operators: nulls, empty tables, ties, repeated rows, hot keys, other columns."""

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise.operators import prefix, profile, references, rejects, series


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


CHILD = "row_id long, sequence_id string, loaded_at timestamp, kind string, t string"
PARENT = "sequence_id string, loaded_at timestamp, deleted_at timestamp, key string"


def test_orphans(spark):
    parents = spark.createDataFrame([
        ("a", t(5), None, "x"), ("b", t(5), t(10), "x"), ("b", t(15), None, "x"), ("c", t(5), t(5), "x"), (None, t(1), None, "x"),
        ("d", t(3), t(9), "x"), ("d", t(8), t(20), "x"), ("d", t(8), t(20), "x"), ("e", None, None, "x"), ("h", t(7), t(8), "x"),
    ], PARENT)
    child = spark.createDataFrame([
        (1, " a\t", t(5), "", ""), (2, "a", t(4), "", ""), (3, "b", t(10), "", ""), (4, "b", t(15), "", ""), (5, "c", t(6), "", ""), (6, "z", t(6), "", ""), (7, None, t(6), "", ""),
        (8, " \t ", t(6), "", ""), (9, "d", t(9), "", ""), (10, "d", t(20), "", ""), (11, "A", t(9), "", ""), (12, "e", t(9), "", ""), (13, "h", None, "", ""), (14, "a", None, "", ""), (6, "z", t(6), "", ""),
    ], CHILD)
    found = references.orphan_references({"m": child}, parents)
    assert rows(found, "row_id", "kind") == sorted([(2, "late"), (3, "deleted"), (5, "deleted"), (6, "missing"), (6, "missing"), (10, "deleted"), (11, "missing"), (12, "late"), (13, "deleted")], key=str)
    report = references.orphan_report(found)
    assert report.where("kind = 'missing'").agg(F.sum("n_rows")).first()[0] == 3
    assert references.orphan_references({"m": child.limit(0)}, parents).count() == 0
    assert {r.kind for r in references.orphan_references({"m": child}, parents.limit(0)).collect()} == {"missing"}


def test_running_sums_equal_a_plain_window(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("string").alias("k"), (F.col("id") * 7919 % 977).alias("o"), (F.col("id") % 5).alias("v"))
    got = {(r.k, r.o, r.run_v) for r in prefix.running_sums(df, ["k"], F.floor(F.col("o") / 50), "o", ["v"]).collect()}
    want = {(r.k, r.o, r.s) for r in df.select("k", "o", F.expr("sum(v) over (partition by k order by o range unbounded preceding)").alias("s")).collect()}
    assert got == want


def test_numbers_equal_a_plain_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.lit(None)).otherwise("b").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 7919 % 101).alias("o"), "id")
    order = [F.col("o").desc_nulls_last(), F.col("id").asc()]
    got = {(r.id, r.nth) for r in prefix.numbered(df, ["k"], order, "nth").collect()}
    assert got == {(r.id, r.nth) for r in df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).alias("nth")).collect()}


def reject(spark, records, header="id2,sequence_id,collection_date"):
    raw = spark.createDataFrame([("f", 1, header), *(("f", i + 2, r) for i, r in enumerate(records))], "source string, line_number long, raw_record string")
    found = {r.line_number - 2: r.reason for r in rejects.rejected_records(raw).collect()}
    return [found.get(i) for i in range(len(records))]


RULES = [
    ("1,a,2024-01-31", None), ("1,a,", None), ("1,a,2024-02-30", "invalid_date"), ("1,a,2023-02-29", "invalid_date"), ("1,a,2024-02-29\r", None), ("1,a,2024-13", "invalid_date"), ("1,a,2024", None),
    ("1,a,٢٠٢٤", "invalid_date"), ("1,a,2024-1-1", "invalid_date"), ("1,,2024", "blank_id"), ('1," ",x', "blank_id"), ("1,a", "column_count"), ("1,a,2024,", "column_count"), ('1,"a,b",2024', None),
    ('1,"a""b",2024', None), ('1,"a"b,2024', "quoting"), ('1,a"b,2024', "quoting"), ('1,"a,2024', "quoting"), ('1, "a" ,\t2024 ', None), ('1,"a\nb",2024', None), ('"","a",""', None), ('1,"""",2024', None), ('1,"a" "b",2024', "quoting"),
    ("   ", None), ("", None), (" ", None), ('1,"a"" ,2024', "quoting"), ("\x0b,\x0b,2024", None), ('1,"a","2024-06"', None), ("1,a\nb,2024", None), ("1,a,0000", None),
]


def test_record_rules(spark):
    got = reject(spark, [r for r, _ in RULES])
    assert list(zip(RULES, got, strict=True)) == [(x, x[1]) for x in RULES]


def brute_reason(record, names):
    """The rules again, read character by character."""
    fields, i, n = [], 0, len(record)
    while True:
        j = i
        while j < n and record[j] in " \t":
            j += 1
        if j < n and record[j] == '"':
            out, j = [], j + 1
            while True:
                if j >= n:
                    return "quoting"
                if record[j] == '"':
                    if j + 1 < n and record[j + 1] == '"':
                        out.append('"')
                        j += 2
                        continue
                    j += 1
                    break
                out.append(record[j])
                j += 1
            while j < n and record[j] in " \t":
                j += 1
            if j < n and record[j] != ",":
                return "quoting"
            fields.append("".join(out).strip(" \t"))
        else:
            k = record.find(",", j)
            k = n if k < 0 else k
            if '"' in record[j:k]:
                return "quoting"
            fields.append(record[j:k].strip(" \t"))
            j = k
        if j >= n:
            break
        i = j + 1
    if len(fields) != len(names):
        return "column_count"
    return "blank_id" if fields[names.index("sequence_id")] == "" else None


def test_records_against_a_scanner(spark):
    import itertools

    parts = ["a", '"', ",", " ", '""', '"b"', "\n"]
    records = ["".join(p) for k in (1, 2, 3, 4) for p in itertools.product(parts, repeat=k)]
    records = [r for r in records if r.strip()]
    raw = spark.createDataFrame([("f", 1, "﻿sequence_id,x"), *(("f", i + 2, r) for i, r in enumerate(records))], "source string, line_number long, raw_record string")
    found = {r.line_number - 2: r.reason for r in rejects.rejected_records(raw).collect()}
    for i, r in enumerate(records):
        assert found.get(i) == brute_reason(r, ["sequence_id", "x"]), repr(r)


def test_records_of_odd_sources(spark):
    raw = spark.createDataFrame([("a", 2, "x,y"), (None, 2, "x"), ("b", 1, '"sequence_id","n"'), ("b", 2, None), ("b", 3, "q," + "z" * 200_000), ("b", 4, '"' + 'r""' * 50_000 + '",1'), ("c", 1, ",".join(["sequence_id", *map(str, range(99))])), ("c", 2, ",".join("v" * 100))], "source string, line_number long, raw_record string")
    assert rows(rejects.rejected_records(raw), "source", "line_number", "reason") == [("a", 2, "column_count")]
    assert rejects.loaded_records(raw).count() == 3
    assert rejects.rejected_records(raw.limit(0)).count() == 0


def test_profile(spark):
    base = [("0.5", "50", "1e-3")] * 8 + [("0.25", "60.5", "0.002")] * 2
    bad = [("-0.5", "50", None), ("NaN", "5e1", None), ("0,5", "101", None), ("1", "50", None), ("0", "50", "0.01"), ("1e", "+1", "1E-3"), (None, "50", "0.005"), ("0.5 ", "50", None), ("0.5\n", "50", None), ("1e999", "50", None)]
    same = [("0.50", "1", "1e-3"), ("0.5", "1", "0.001")]
    data = [(1, *r) for r in base] + [(2, *r) for r in bad] + [(3, *r) for r in same] + [(None, "x", "x", "x")] + [(4, None, None, None)]
    df = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(data)], "row_id long, load_id long, gvi string, coverage_pct string, mu string, value string")
    loads = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "load_id long, previous_load_id long")
    p = profile.load_profile(df, loads)
    issues = {(r.load_id, r.column_name, r.issue) for r in profile.load_issues(p).collect()}
    assert {(2, "gvi", "pattern"), (2, "gvi", "range"), (2, "coverage_pct", "pattern"), (2, "coverage_pct", "range"), (2, "mu", "nulls"), (3, "gvi", "constant"), (3, "mu", "constant"), (3, "coverage_pct", "constant")} <= issues
    assert not {x for x in issues if x[0] in (1, 4)}
    assert (2, "mu", "pattern") not in issues
    assert profile.load_profile(df.limit(0), loads).count() == 0
    assert profile.load_profile(df, loads.limit(0)).where("nulls or shifted").count() == 0


def test_shift_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    data = [(i % 4 + 1, repr(round(min(1, max(0, rnd.gauss(0.3 + 0.05 * (i % 4) ** 2, 0.1))), 2))) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, None, None) for i, (a, b) in enumerate(data)], "row_id long, load_id long, gvi string, coverage_pct string, mu string")
    loads = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "load_id long, previous_load_id long")
    got = {r.load_id: r["shift"] for r in profile.load_profile(df, loads).where("column_name = 'gvi'").collect()}
    by = {k: [float(b) for a, b in data if a == k] for k in range(1, 5)}
    for k in (2, 3, 4):
        want = max(abs(sum(v <= x for v in by[k]) / len(by[k]) - sum(v <= x for v in by[k - 1]) / len(by[k - 1])) for x in by[k] + by[k - 1])
        assert math.isclose(got[k], want, abs_tol=1e-12)


def test_induced_expressions_leave_rare_spellings_out(spark):
    vals = [(1, "gvi", f"0.{i:04d}", 1) for i in range(300)] + [(1, "gvi", "n/a", 5), (1, "gvi", "#DIV/0!", 1)]
    df = spark.createDataFrame(vals, "load_id long, column_name string, value string, n long")
    got = profile.induced_expressions(df).collect()
    assert len(got) == 1
    import re

    assert re.fullmatch(got[0].expression, "0.1234")


def test_every_value_matches_its_expression(spark):
    """Signs, points, exponents and letters beside them; and what is rare or holds a stand-in has no expression."""
    import re

    odd = ["1.4e+04", "n-a104", "a+b", "-0.5", "1e-3", "(1,5)", "12 %", "x*y?", "[0]", "A1\\n", "é9", "²³", "0x1F", "9.9.9", "N/A", "+1", "1\ue0002"]
    vals = [(1, c, re.sub("[0-9]", lambda m, i=i: str((int(m.group()) + i * 7919) % 10), v) + s, 1) for c in ("a", "b") for v in odd for i in range(40) for s in ("", str(i), "q" * (i % 3))]
    vals += [(1, "b", w, 1) for w in ("kite", "lamp", "moon", "nest", "opal", "pike", "quay", "rose", "silk", "tide", "urge", "vine")]
    df = spark.createDataFrame(vals, "load_id long, column_name string, value string, n long").distinct()
    expressions = profile.induced_expressions(df)
    joined = df.withColumn("shape", profile._shape(F.col("value"))).join(expressions, ["column_name", "shape"]).collect()
    assert len(joined) > 1000 and {r.expression for r in joined} > {"[a-z]+"}
    for r in joined:
        assert re.fullmatch(r.expression, r.value), (r.expression, r.value)
        assert not r.numbers or re.fullmatch(profile.NUMBER, r.value)
        assert "\ue000" not in r.value


def test_expressions_generalise_only_where_it_is_shorter(spark):
    vals = [(1, "x", f"{i * 37 % 1000}.{i * 7919 % 10 ** (i % 7 + 1)}", 1) for i in range(60)] + [(1, "y", f"{i:04d}", 1) for i in range(500)]
    got = {}
    for r in profile.induced_expressions(spark.createDataFrame(vals, "load_id long, column_name string, value string, n long").distinct()).collect():
        got.setdefault(r.column_name, set()).add(r.expression)
    assert got["x"] == {r"[0-9]+\.[0-9]+"} and got["y"] == {"[0-9]" * 4}


REPORTS = "report_id long, series_id long, date date, new_cases double, loaded_at timestamp, day string"
SERIES = "series_id long, pathogen string, step_days int, start_date date, end_date date, total string"


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n - 1)


def test_grid(spark):
    reports = spark.createDataFrame([
        (1, 1, d(1), 4.0, t(1), ""), (1, 1, d(1), 4.0, t(2), ""), (2, 1, d(1), 6.0, t(1), ""), (3, 1, d(3), 2.0, t(1), ""), (4, 1, d(9), float("nan"), t(1), ""), (5, 1, d(9), -1.0, t(1), ""), (6, 1, d(9), None, t(1), ""),
        (7, 1, d(11), 0.0, t(1), ""), (8, 1, d(40), 5.0, t(1), ""), (9, None, d(1), 5.0, t(1), ""), (None, 1, d(3), 1.0, t(1), ""), (None, 1, d(3), 1.0, t(1), ""), (10, 3, d(1), 1.0, t(1), ""),
    ], REPORTS)
    spans = spark.createDataFrame([(1, "p", 4, d(1), d(14), ""), (2, "p", 5, d(1), d(1), ""), (3, "p", 0, d(1), d(9), ""), (4, "p", 1, d(5), d(1), ""), (5, "p", 1, None, d(1), "")], SERIES)
    got = {(r.series_id, r.period_start.day): r for r in series.regular_grid(reports, spans).collect()}
    assert set(got) == {(1, 1), (1, 5), (1, 9), (1, 13), (2, 1)}
    first = got[1, 1]
    assert (first.reported, first.n_reports, first.coverage, first.marked_missing) == (14.0, 5, 1.0, False)
    assert math.isclose(first.daily_average, (10 * 2 + 4 * 2) / 4)
    short = {(r.series_id, r.period_start.day): r for r in series.regular_grid(reports, spans, 4).collect()}
    second = short[1, 5]
    assert (second.reported, second.marked_missing, second.coverage, second.daily_average) == (None, True, 0.5, 4.0)
    # Without a limit a reading holds until the next one, over any number of periods.
    assert (got[1, 5].reported, got[1, 5].marked_missing, got[1, 5].coverage, got[1, 5].daily_average) == (None, True, 1.0, 4.0)
    assert got[1, 9].daily_average == (4.0 * 2 + 0.0 * 2) / 4
    assert not got[1, 9].marked_missing and got[1, 13].period_days == 2 and got[1, 13].daily_average == 0.0
    assert got[2, 1].marked_missing and got[2, 1].daily_average is None
    assert series.regular_grid(reports.limit(0), spans).where("not marked_missing").count() == 0
    assert series.regular_grid(reports, spans.limit(0)).count() == 0


def test_trailing_totals_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    data = [(i, rnd.choice([1, 1, 1, 2]), d(rnd.randint(-3, 70)), float(rnd.randint(0, 9)), t(1), "") for i in range(200)]
    data += data[:50] + [(900, 1, d(5), float("inf"), t(1), ""), (None, 2, d(9), 3.0, t(1), ""), (None, 2, d(9), 3.0, t(1), "")]
    spans = spark.createDataFrame([(1, "p", 1, d(1), d(60), ""), (2, "p", 7, d(4), d(50), "")], SERIES)
    got = {(r.series_id, r.day): (r.total_7, r.total_30, r.average_7) for r in series.trailing_totals(spark.createDataFrame(data, REPORTS), spans).collect()}
    once = {(r[0], *r[1:4]) for r in data if r[0] is not None and r[3] < 99}
    flat = [(s, day, v) for _, s, day, v in once] + [(2, d(9), 3.0)] * 2
    assert len(got) == 60 + 47
    for (s, day), (a, b, m) in got.items():
        lo = d(1) if s == 1 else d(4)
        tot = lambda w, s=s, day=day, lo=lo: sum(v for x, y, v in flat if x == s and lo <= y <= day and (day - y).days < w)
        assert (a, b) == (tot(7), tot(30)) and math.isclose(m, tot(7) / 7)


def test_expressions_of_loads_against_brute_force(spark):
    """A load whose spellings move while all stay well-formed shows in its coverage, though no issue is raised."""
    one, two = [f"0.{1000 + i}" for i in range(60)], [f"{i}e-4" for i in range(10, 70)]
    data = [(1, x) for x in one] + [(2, x) for x in one[:20] + two[:40]] + [(2, None), (2, "n/a"), (3, None)]
    table = spark.createDataFrame([(k, x, None, None) for k, x in data], "load_id long, gvi string, coverage_pct string, mu string")
    loads = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "load_id long, previous_load_id long")
    ranges = {"gvi": (0.0, 1.0)}
    known = {(r.fixed): r.expression for r in profile.induced_expressions(profile.distinct_values(table, ["gvi"], "load_id")).collect()}
    classes = lambda x: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in x)
    held = {k: {} for k in (1, 2, 3)}
    for k, x in data:
        if x is not None:
            e = known.get(classes(x), "")
            held[k][e] = held[k].get(e, 0) + 1
    got = {r.load_id: r for r in profile.expression_profile(table, loads, ranges).collect()}
    assert {k: {e.expression: e.n_rows for e in r.expressions or []} for k, r in got.items()} == held
    share = lambda k, e: held[k].get(e, 0) / sum(held[k].values())
    assert abs(got[2].coverage_change - max(abs(share(2, e) - share(1, e)) for e in held[1] | held[2])) < 1e-12 and got[2].coverage_change > 0.5
    assert got[1].coverage_change is None and got[3].coverage_change is None
    bad = sum(1 for k, x in data if k == 2 and x is not None and (x == "n/a" or classes(x) not in known))
    assert (got[1].n_nonconforming, got[2].n_nonconforming, got[3].n_nonconforming) == (0, bad, 0)

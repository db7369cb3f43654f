"""Queries of the general problems (p2 to p6) and their ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import profile, references, rejects, series
from strandwise.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references({n: table(spark, d, n) for n in ("metadata", "seq_results")}, table(spark, d, "sequences"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "row_id", "kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected_records(table(spark, d, "metadata_raw"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded_records(table(spark, d, "metadata_raw"))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_profile(table(spark, d, "all_pathogens_summary"), table(spark, d, "summary_loads"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_issues(_profile(spark, d))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    cols = ["null_share", "null_change", "shift"]
    return _profile(spark, d).select("load_id", "column_name", "n_rows", "n_distinct", "n_ill_formed", "n_out_of_range", "n_valid", "min_valid", "max_valid", *[F.round(c, 9).alias(c) for c in cols])


def p4_expressions(spark: SparkSession, d: str) -> DataFrame:
    """The induced expressions of each load and column, and how their coverage changed since the load before."""
    return profile.expression_profile(table(spark, d, "all_pathogens_summary"), table(spark, d, "summary_loads")).withColumn("coverage_change", F.round("coverage_change", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    grid = series.regular_grid(table(spark, d, "incidence"), table(spark, d, "incidence_series"))
    return grid.where("marked_missing").select("series_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = series.regular_grid(table(spark, d, "incidence"), table(spark, d, "incidence_series"))
    return grid.select("series_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "period_days", F.round("daily_average", 9).alias("daily_average"), F.round("coverage", 9).alias("coverage"), "reported", "n_reports", "marked_missing")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return series.trailing_totals(table(spark, d, "incidence"), table(spark, d, "incidence_series"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    hot = (F.col("day_of_span") >= 30) & (F.col("total_7") * 2 > F.col("total_30")) & (F.col("total_30") >= 20)
    return _rolling(spark, d).where(hot).select("series_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).select("series_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(c, 9).alias(c) for c in ("total_7", "total_30", "average_7", "average_30")])


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_loaded, p4_found, p4_profile, p4_expressions, p5_found, p5_grid, p6_found, p6_rolling)}

_P2 = """
WITH child AS (
  SELECT 'metadata' AS child_table, row_id, trim(sequence_id, chr(32) || chr(9)) AS k, coalesce(loaded_at, TIMESTAMP '9999-12-31') AS t FROM metadata
  UNION ALL SELECT 'seq_results', row_id, trim(sequence_id, chr(32) || chr(9)), coalesce(loaded_at, TIMESTAMP '9999-12-31') FROM seq_results),
judged AS (
  SELECT child_table, row_id, k, t,
    (SELECT count(*) FROM sequences s WHERE s.sequence_id = k) AS held,
    (SELECT count(*) FROM sequences s WHERE s.sequence_id = k AND s.loaded_at <= t) AS loaded,
    (SELECT count(*) FROM sequences s WHERE s.sequence_id = k AND s.loaded_at <= t AND (s.deleted_at IS NULL OR s.deleted_at > t)) AS live
  FROM child WHERE k <> ''),
orphan AS (SELECT *, CASE WHEN held = 0 THEN 'missing' WHEN loaded = 0 THEN 'late' ELSE 'deleted' END AS kind FROM judged WHERE live = 0)
"""
_FIELD = r"""[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*"""
_P3 = rf"""
WITH line AS (
  SELECT source, line_number, regexp_replace(raw_record, '\r$', '') AS r FROM metadata_raw),
head AS (
  SELECT source, list_transform(regexp_extract_all(regexp_replace(r, '^\x{{FEFF}}', '') || ',', '({_FIELD}),', 1), lambda x: trim(trim(x, ' ' || chr(9)), '"')) AS names
  FROM line WHERE line_number = 1),
body AS (
  SELECT source, line_number, r, regexp_full_match(r, '(?:{_FIELD})(?:,(?:{_FIELD}))*') AS good,
    list_transform(regexp_extract_all(r || ',', '({_FIELD}),', 1), lambda x: CASE WHEN trim(x, ' ' || chr(9)) LIKE '"%' THEN trim(replace(substr(trim(x, ' ' || chr(9)), 2, length(trim(x, ' ' || chr(9))) - 2), '""', '"'), ' ' || chr(9)) ELSE trim(x, ' ' || chr(9)) END) AS f
  FROM line WHERE line_number > 1 AND NOT regexp_full_match(r, '[\s]*')),
v AS (
  SELECT source, line_number, good, len(f) = len(names) AS fits, names, f,
    coalesce(f[list_position(names, 'sequence_id')], '') AS id, coalesce(f[list_position(names, 'collection_date')], '') AS d
  FROM body JOIN head USING (source)),
j AS (
  SELECT *, CASE WHEN NOT good THEN 'quoting' WHEN NOT fits THEN 'column_count' WHEN id = '' THEN 'blank_id'
    WHEN d <> '' AND NOT (regexp_full_match(d, '[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?') AND try_cast(substr(d || '-01-01', 1, 10) AS DATE) IS NOT NULL) THEN 'invalid_date' END AS reason FROM v)
"""
_P4 = r"""
WITH v AS (
  SELECT load_id, column_name, value FROM (
    SELECT load_id, 'gvi' AS column_name, gvi AS value FROM all_pathogens_summary
    UNION ALL SELECT load_id, 'coverage_pct', coverage_pct FROM all_pathogens_summary
    UNION ALL SELECT load_id, 'mu', mu FROM all_pathogens_summary)),
w AS (SELECT *, regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AS ok FROM v),
x AS (SELECT *, CASE WHEN ok THEN value::DOUBLE END AS num FROM w),
y AS (SELECT *, num BETWEEN 0 AND CASE column_name WHEN 'gvi' THEN 1.0::DOUBLE WHEN 'coverage_pct' THEN 100.0::DOUBLE ELSE 0.01::DOUBLE END AS valid FROM x),
s AS (
  SELECT load_id, column_name, count(*) AS n_rows, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_distinct, count(*) FILTER (NOT ok) AS n_ill_formed,
    count(*) FILTER (ok AND NOT valid) AS n_out_of_range, count(*) FILTER (valid) AS n_valid, min(num) FILTER (valid) AS min_valid, max(num) FILTER (valid) AS max_valid
  FROM y GROUP BY ALL),
pair AS (SELECT load_id, previous_load_id FROM summary_loads WHERE previous_load_id IS NOT NULL),
line AS (
  SELECT load_id, column_name, num, 1 AS a, 0 AS b FROM y JOIN pair USING (load_id) WHERE valid
  UNION ALL SELECT pair.load_id, column_name, num, 0, 1 FROM y JOIN pair ON y.load_id = pair.previous_load_id WHERE valid),
cum AS (
  SELECT load_id, column_name, sum(a) OVER up AS ra, sum(b) OVER up AS rb, sum(a) OVER al AS na, sum(b) OVER al AS nb FROM line
  WINDOW up AS (PARTITION BY load_id, column_name ORDER BY num RANGE UNBOUNDED PRECEDING), al AS (PARTITION BY load_id, column_name)),
ks AS (SELECT load_id, column_name, max(abs(ra * nb - rb * na))::DOUBLE / max(na * nb)::DOUBLE AS shift, max(abs(ra * nb - rb * na)) * 10 > 3 * max(na * nb) AS shifted FROM cum WHERE na > 0 AND nb > 0 GROUP BY ALL),
p AS (
  SELECT s.*, q.n_rows AS p_rows, q.n_null AS p_null, ks.shift, ks.shifted
  FROM s LEFT JOIN pair USING (load_id) LEFT JOIN s q ON q.load_id = pair.previous_load_id AND q.column_name = s.column_name
  LEFT JOIN ks ON ks.load_id = s.load_id AND ks.column_name = s.column_name)
"""
_DAILY = """
WITH r AS (SELECT DISTINCT report_id, series_id, date, new_cases FROM incidence WHERE new_cases IS NOT NULL AND NOT isnan(new_cases) AND new_cases >= 0),
daily AS (
  SELECT r.series_id, r.date AS day, sum(new_cases) AS total, count(*) AS n FROM r JOIN incidence_series s ON s.series_id = r.series_id AND r.date BETWEEN s.start_date AND s.end_date GROUP BY ALL),
"""
_P5 = (
    _DAILY
    + """
grid AS (
  SELECT series_id, start_date, end_date, step_days, unnest(range(0, date_diff('day', start_date, end_date) // step_days + 1)) AS k FROM incidence_series),
cell AS (SELECT series_id, start_date + (k * step_days)::INT AS lo, least(start_date + ((k + 1) * step_days)::INT, end_date + 1) AS hi FROM grid),
step AS (
  SELECT d.*, coalesce(lead(day) OVER (PARTITION BY d.series_id ORDER BY day), end_date + 1) AS until
  FROM daily d JOIN incidence_series USING (series_id)),
val AS (
  SELECT c.series_id, c.lo, c.hi, sum(total * date_diff('day', greatest(day, lo), least(until, hi))) AS weighted, sum(date_diff('day', greatest(day, lo), least(until, hi))) FILTER (day IS NOT NULL) AS covered,
    sum(total) FILTER (day >= lo) AS reported, coalesce(sum(n) FILTER (day >= lo), 0)::BIGINT AS n_reports
  FROM cell c LEFT JOIN step s ON s.series_id = c.series_id AND s.day < c.hi AND s.until > c.lo GROUP BY ALL)
"""
)
_P6 = (
    _DAILY
    + """
cal AS (SELECT series_id, start_date, unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM incidence_series),
f AS (SELECT c.series_id, c.start_date, c.day, coalesce(total, 0)::DOUBLE AS v FROM cal c LEFT JOIN daily d ON d.series_id = c.series_id AND d.day = c.day),
t AS (
  SELECT series_id, start_date, day, sum(v) OVER (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING) AS t7, sum(v) OVER (PARTITION BY series_id ORDER BY day ROWS 29 PRECEDING) AS t30 FROM f)
"""
)

ORACLE = {
    "p2_found": _P2 + "SELECT child_table, row_id, kind FROM orphan",
    "p2_report": _P2 + "SELECT child_table, strftime(t, '%Y-%m') AS month, kind, count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM orphan GROUP BY ALL",
    "p3_found": _P3 + "SELECT source, line_number, reason FROM j WHERE reason IS NOT NULL",
    "p3_loaded": _P3 + "SELECT source, line_number, nullif(f[list_position(names, 'sequence_id')], '') AS sequence_id, nullif(f[list_position(names, 'collection_date')], '') AS collection_date, nullif(f[list_position(names, 'location')], '') AS location, nullif(f[list_position(names, 'host')], '') AS host FROM j WHERE reason IS NULL",
    "p4_found": _P4
    + """SELECT load_id, column_name, 'pattern' AS issue FROM p WHERE n_ill_formed > 0
UNION ALL SELECT load_id, column_name, 'range' FROM p WHERE n_out_of_range > 0
UNION ALL SELECT load_id, column_name, 'constant' FROM p WHERE n_valid > 0 AND min_valid = max_valid
UNION ALL SELECT load_id, column_name, 'nulls' FROM p WHERE abs(n_null * p_rows - p_null * n_rows) * 10 > n_rows * p_rows
UNION ALL SELECT load_id, column_name, 'shift' FROM p WHERE shifted""",
    "p4_profile": _P4 + "SELECT load_id, column_name, n_rows, n_distinct, n_ill_formed, n_out_of_range, n_valid, min_valid, max_valid, round(n_null::DOUBLE / n_rows, 9) AS null_share, round(n_null::DOUBLE / n_rows - p_null::DOUBLE / p_rows, 9) AS null_change, round(shift, 9) AS shift FROM p",
    "p5_found": _P5 + "SELECT series_id, strftime(lo, '%Y-%m-%d') AS period_start FROM val WHERE n_reports = 0",
    "p5_grid": _P5 + "SELECT series_id, strftime(lo, '%Y-%m-%d') AS period_start, date_diff('day', lo, hi)::INT AS period_days, round(weighted / covered, 9) AS daily_average, round(coalesce(covered, 0)::DOUBLE / date_diff('day', lo, hi), 9) AS coverage, reported, n_reports, n_reports = 0 AS marked_missing FROM val",
    "p6_found": _P6 + "SELECT series_id, strftime(day, '%Y-%m-%d') AS day FROM t WHERE day >= start_date + 29 AND t7 * 2 > t30 AND t30 >= 20",
    "p6_rolling": _P6 + "SELECT series_id, strftime(day, '%Y-%m-%d') AS day, round(t7, 9) AS total_7, round(t30, 9) AS total_30, round(t7 / 7, 9) AS average_7, round(t30 / 30, 9) AS average_30 FROM t",
}

"""Queries of the genomic operators over the sequence tables, and their ANSI SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import genetic_code
from strandwise.functions.bands import COMPARABLE, RANGES, WEIGHTS
from strandwise.operators import alignment as A
from strandwise.operators import codons as C
from strandwise.operators import composite as M
from strandwise.operators import distance as D
from strandwise.operators import epidemic as E
from strandwise.operators import pairs as R
from strandwise.operators import phylo as P
from strandwise.operators.prefix import numbered
from strandwise.sources.tables import table


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    return A.current_alignment(table(spark, d, "sequences"))


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(A.alignment_summary(_alignment(spark, d)))


def site_profile(spark: SparkSession, d: str) -> DataFrame:
    return A.site_profile(_alignment(spark, d)).select("dataset_id", "pos", "n_alleles", "rarest", "n_gaps", "n_other", "alleles", "kind", "informative")


def site_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.site_summary(_alignment(spark, d))


def trimmed_alignment(spark: SparkSession, d: str) -> DataFrame:
    return A.trimmed(_alignment(spark, d), minimum=1)


def genetic_distance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.genetic_distance(_alignment(spark, d)))


def mutation_burden(spark: SparkSession, d: str) -> DataFrame:
    return D.mutation_burden(_alignment(spark, d))


def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.gc_content(_alignment(spark, d)))


def mutation_signatures(spark: SparkSession, d: str) -> DataFrame:
    return D.mutation_signatures(_alignment(spark, d))


def nucleotide_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.nucleotide_diversity(_alignment(spark, d)))


def diversity_interval(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.diversity_interval(_alignment(spark, d)))


def sliding_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.sliding_diversity(_alignment(spark, d)))


def preflight(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return _rounded(R.preflight(al, A.site_summary(al)))


def poor_overlap_examples(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return R.poor_overlap_examples(al, A.references(al))


def lineages(spark: SparkSession, d: str) -> DataFrame:
    return R.lineages(_alignment(spark, d))


def codon_usage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.codon_usage(_alignment(spark, d)))


def codon_positions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.codon_positions(_alignment(spark, d)))


def codon_adaptation(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return _rounded(C.codon_adaptation(al, C.codon_usage(al)))


def selection_by_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.selection(C.selection_counts(_alignment(spark, d))))


def selection_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.pooled_selection(C.selection_counts(_alignment(spark, d))))


def selection_windows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.selection_windows(_alignment(spark, d), 10, 5)).select("dataset_id", "start_codon", "n_codons", "s_sites", "s_diff", "n_diff", "omega")


def open_reading_frames(spark: SparkSession, d: str) -> DataFrame:
    return C.open_reading_frames(_alignment(spark, d))


def reproduction_number(spark: SparkSession, d: str) -> DataFrame:
    est = E.reproduction_number(table(spark, d, "incidence"), table(spark, d, "incidence_series"))
    return est.select("series_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "infections", F.round("pressure", 6).alias("pressure"), F.round("re", 6).alias("re"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return E.dated_records(_alignment(spark, d), table(spark, d, "metadata"))


def dated_records(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("dataset_id", "seq_ord", "sequence_id", F.date_format("collected", "yyyy-MM-dd").alias("collected"), "precision", "location", "host")


def clock_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.clock_rate(_dated(spark, d)), 7)


def index_values(spark: SparkSession, d: str) -> dict[str, Callable[[], DataFrame]]:
    """By index key, how its values (dataset_id, seq_ord or null, value) are made; nothing is read until one is asked for."""
    al = _alignment(spark, d)
    one = lambda df, value: df.select("dataset_id", F.lit(None).cast("bigint").alias("seq_ord"), F.col(value).alias("value"))
    each = lambda df, value: df.select("dataset_id", "seq_ord", F.col(value).alias("value"))
    return {
        "pi": lambda: one(R.nucleotide_diversity(al), "pi"),
        "GD": lambda: each(D.genetic_distance(al), "jc69"),
        "MB": lambda: each(D.mutation_burden(al), "burden"),
        "GC_Deviation": lambda: each(D.gc_content(al), "gc_deviation"),
        "CAI": lambda: each(C.codon_adaptation(al, C.codon_usage(al)), "cai"),
        "dN/dS": lambda: one(C.pooled_selection(C.selection_counts(al)), "omega"),
        "mu": lambda: one(E.clock_rate(_dated(spark, d)), "mu"),
    }


def _indices(spark: SparkSession, d: str, wanted: Iterable[str] | None = None) -> DataFrame:
    """(dataset_id, key, value) of the wanted indices, of all that the sequence tables allow unless given: the mean over queries where there is a value each."""
    makers = index_values(spark, d)
    keys = list(makers if wanted is None else wanted)
    if unknown := set(keys) - set(makers) or not keys:
        raise ValueError(f"unknown indices {unknown}; there are {list(makers)}")
    parts = [makers[k]().groupBy("dataset_id").agg(F.avg("value").alias("value")).select("dataset_id", F.lit(k).alias("key"), "value") for k in keys]
    return functools.reduce(DataFrame.unionByName, parts)


def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.composite(M.components(_indices(spark, d))), 6)


def composite_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.sensitivity(_indices(spark, d)), 6)


def recombination(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.recombination(_alignment(spark, d)))


def tree_clock(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.tree_clock(_dated(spark, d)))


def _full_indices(spark: SparkSession, d: str) -> DataFrame:
    """(dataset_id, key, value, excluded) of the indices of ``_indices`` and RI, with the tree clock's mu where there is a tree."""
    al = _alignment(spark, d)
    dated = _dated(spark, d)
    tree = P.tree_clock(dated)
    others = E.clock_points(dated).join(tree.where("status = 'computed'").select("dataset_id"), "dataset_id", "left_anti")
    clock = M.preferred_clock(E.clock_rate(dated).join(P.date_shuffles(others), "dataset_id", "left"), tree)
    ri = P.recombination(al).select("dataset_id", F.lit("RI").alias("key"), F.col("ri").alias("value"))
    mu = clock.select("dataset_id", F.lit("mu").alias("key"), F.col("mu").alias("value"))
    indices = _indices(spark, d).where("key <> 'mu'").unionByName(mu).unionByName(ri)
    return M.gate(indices, _evidence(al, clock))


def _evidence(al: DataFrame, clock: DataFrame) -> DataFrame:
    summary = A.alignment_summary(al).select("dataset_id", "gap_fraction", "length")
    burden = D.mutation_burden(al).groupBy("dataset_id").agg(F.avg("burden").alias("burden"))
    pooled = C.pooled_selection(C.selection_counts(al)).select("dataset_id", "omega", "verdict")
    return summary.join(burden, "dataset_id", "left").join(clock, "dataset_id", "left").join(pooled, "dataset_id", "left").withColumn("burden_share", F.col("burden") / F.col("length"))


def gated_composite(spark: SparkSession, d: str) -> DataFrame:
    """The composite of all indices that the gate lets through: RI and the tree clock take part."""
    return _rounded(M.composite(M.components(_full_indices(spark, d).where("excluded is null"))), 6)


def gated_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.sensitivity(_full_indices(spark, d).where("excluded is null")), 6)


def gated_indices(spark: SparkSession, d: str) -> DataFrame:
    """Every index with the reason that keeps it out of the composite, null if none does."""
    al = _alignment(spark, d)
    clock = E.clock_rate(_dated(spark, d)).select("dataset_id", "mu", "r2")
    return _rounded(M.gate(_indices(spark, d), _evidence(al, clock)), 6)


def beta_genomic(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.beta_genomic(M.components(_summary_indices(spark, d))))


def _summary_indices(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "all_pathogens_summary")
    cols = {"mu": F.col("mu").try_cast("double"), "MB": F.col("mb"), "GC_Deviation": F.col("gc")}
    return t.select(F.col("row_id").cast("string").alias("dataset_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in cols.items()])).alias("x")).select("dataset_id", "x.*")


def summary_composite(spark: SparkSession, d: str) -> DataFrame:
    """The composite of the indices that each corpus summary row carries."""
    return _rounded(M.composite(M.components(_summary_indices(spark, d))))


def corpus_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Per load: comparable rows by falling score, then the others by pathogen and row."""
    t = table(spark, d, "all_pathogens_summary").select("load_id", "row_id", "pathogen", F.col("gvi").try_cast("double").alias("gvi"), (F.lower("comparable") == "yes").alias("comparable"))
    comparable = F.coalesce("comparable", F.lit(False))
    ready = t.select("load_id", "row_id", "pathogen", comparable.alias("comparable"), F.when(comparable, F.col("gvi")).alias("score"))
    order = [F.col("comparable").desc(), F.col("score").desc_nulls_last(), F.col("pathogen").asc_nulls_first(), F.col("row_id").asc()]
    return numbered(ready, ["load_id"], order, "place").select("load_id", "row_id", F.col("place").cast("int").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        composite_score, composite_sensitivity, alignment_summary, site_profile, site_summary, trimmed_alignment, genetic_distance, mutation_burden, gc_content, mutation_signatures, nucleotide_diversity, diversity_interval, sliding_diversity, preflight, poor_overlap_examples, lineages,
        codon_usage, codon_positions, codon_adaptation, selection_by_query, selection_pooled, selection_windows, open_reading_frames, reproduction_number, dated_records, clock_rate, recombination, tree_clock, gated_indices, gated_composite, gated_sensitivity, beta_genomic, summary_composite, corpus_ranking,
    )
}


def _values(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {text}) AS t({names}))"


_AL = """WITH al AS (
  SELECT dataset_id, seq_ord, sequence_id, upper(seq) AS seq FROM sequences WHERE deleted_at IS NULL AND length(seq) > 0
  QUALIFY row_number() OVER (PARTITION BY dataset_id, seq_ord ORDER BY loaded_at DESC, sequence_id DESC, seq DESC) = 1),
ref AS (SELECT dataset_id, seq_ord AS ref_ord, sequence_id AS ref_id, seq AS ref FROM al QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY seq_ord) = 1),
q AS (SELECT al.*, ref.ref, ref_id FROM al JOIN ref USING (dataset_id) WHERE seq_ord <> ref_ord)
"""
_SITES = (
    _AL
    + """, site AS (SELECT dataset_id, seq_ord, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM al),
cnt AS (SELECT dataset_id, pos, base, count(*) AS n FROM site GROUP BY ALL),
prof AS (
  SELECT dataset_id, pos, count(*) FILTER (base IN ('A','C','G','T')) AS n_alleles, min(n) FILTER (base IN ('A','C','G','T')) AS rarest,
    coalesce(sum(n) FILTER (base IN ('-','.','?')), 0)::BIGINT AS n_gaps, coalesce(sum(n) FILTER (base NOT IN ('A','C','G','T')), 0)::BIGINT AS n_other,
    coalesce(string_agg(base, '' ORDER BY base) FILTER (base IN ('A','C','G','T')), '') AS alleles
  FROM cnt GROUP BY ALL),
pk AS (
  SELECT *, CASE WHEN n_alleles < 2 THEN NULL WHEN alleles IN ('AG','CT') THEN 'transition' ELSE 'transversion' END AS kind,
    coalesce(n_alleles = 2 AND rarest >= 2 AND n_gaps = 0, false) AS informative FROM prof)
"""
)
_PAIR = (
    _AL
    + """, z AS (SELECT dataset_id, seq_ord, sequence_id, unnest(range(length(seq))) AS pos, unnest(string_split(ref, '')) AS a, unnest(string_split(seq, '')) AS b FROM q),
st AS (
  SELECT *, CASE WHEN a IN ('A','C','G','T') AND b IN ('A','C','G','T') THEN CASE WHEN a = b THEN '=' WHEN a || b IN ('AG','GA','CT','TC') THEN 's' ELSE 'v' END
    WHEN a IN ('-','.','?') AND b IN ('-','.','?') THEN 'G' WHEN a IN ('-','.','?') THEN 'I' WHEN b IN ('-','.','?') THEN 'D' ELSE '.' END AS s FROM z),
gd AS (
  SELECT dataset_id, seq_ord, sequence_id, count(*) FILTER (s IN ('=','s','v')) AS comparable, count(*) FILTER (s = 's') AS transitions, count(*) FILTER (s = 'v') AS transversions FROM st GROUP BY ALL),
g AS (SELECT *, (transitions + transversions)::DOUBLE / nullif(comparable, 0) AS p, transitions::DOUBLE / nullif(comparable, 0) AS ps, transversions::DOUBLE / nullif(comparable, 0) AS pv FROM gd),
dist AS (
  SELECT *, CASE WHEN 1 - 4 * p / 3 <= 0 THEN p ELSE abs(-0.75 * ln(1 - 4 * p / 3)) END AS jc69,
    CASE WHEN 1 - 2 * ps - pv <= 0 OR 1 - 2 * pv <= 0 THEN p ELSE abs(-0.5 * ln(1 - 2 * ps - pv) - 0.25 * ln(1 - 2 * pv)) END AS k80, 1 - 4 * p / 3 <= 0 AS saturated FROM g),
ev AS (SELECT *, lag(s) OVER (PARTITION BY dataset_id, seq_ord ORDER BY pos) AS before FROM st),
mb AS (
  SELECT dataset_id, seq_ord, sequence_id, count(*) FILTER (s IN ('s','v')) AS substitutions, count(*) FILTER (s IN ('I','D') AND before IS DISTINCT FROM s) AS indels FROM ev GROUP BY ALL)
"""
)
_PI = """, zz AS (
  SELECT x.dataset_id, x.seq_ord AS i, y.seq_ord AS j, unnest(string_split(x.seq, '')) AS a, unnest(string_split(y.seq, '')) AS b FROM al x JOIN al y ON x.dataset_id = y.dataset_id AND x.seq_ord < y.seq_ord),
pr AS (SELECT dataset_id, i, j, count(*) FILTER (a <> b)::DOUBLE / count(*) AS p FROM zz WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T') GROUP BY ALL),
pi AS (SELECT al.dataset_id, count(p) AS n_pairs, avg(p) AS pi FROM (SELECT DISTINCT dataset_id FROM al) al LEFT JOIN pr USING (dataset_id) GROUP BY ALL)
"""
_F3X4 = """, c3 AS (SELECT s.dataset_id, (pos % 3 + 1)::INT AS codon_position, base FROM site s JOIN al USING (dataset_id, seq_ord) WHERE base IN ('A','C','G','T') AND pos < length(seq) - length(seq) % 3),
g3 AS (SELECT DISTINCT dataset_id, codon_position, b.base FROM c3, (VALUES ('A'), ('C'), ('G'), ('T')) b(base)),
n3 AS (SELECT dataset_id, codon_position, base, count(*) AS n FROM c3 GROUP BY ALL),
h3 AS (SELECT g3.dataset_id, g3.codon_position, g3.base, greatest(coalesce(n, 0) / sum(n) OVER (PARTITION BY g3.dataset_id, g3.codon_position), 1e-8::DOUBLE) AS least FROM g3 LEFT JOIN n3 USING (dataset_id, codon_position, base)),
f3 AS (SELECT *, least / sum(least) OVER (PARTITION BY dataset_id, codon_position) AS share FROM h3)
"""
_PAIRS = """, ln AS (SELECT *, length(regexp_extract(seq, '^[-.?]*')) AS lo, length(seq) - length(regexp_extract(seq, '[-.?]*$')) - 1 AS hi FROM al),
two AS (SELECT x.dataset_id, x.seq_ord AS i, y.seq_ord AS j, x.seq AS s, y.seq AS t, x.lo AS la, x.hi AS ha, y.lo AS lb, y.hi AS hb FROM ln x JOIN ln y ON x.dataset_id = y.dataset_id AND x.seq_ord < y.seq_ord),
base AS (SELECT dataset_id, i, j, unnest(range(length(s))) AS pos, unnest(string_split(s, '')) AS a, unnest(string_split(t, '')) AS b FROM two),
cmp AS (SELECT dataset_id, i, j, count(*) AS comparable, count(*) FILTER (a <> b) AS differ FROM base WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T') GROUP BY ALL)
"""
_CODE = f""", code AS {_values(genetic_code.code_rows(), "codon, amino_acid")},
cod AS (SELECT dataset_id, seq_ord, unnest(list_transform(range(length(seq) // 3), lambda i: translate(substr(seq, 3 * i + 1, 3), 'U', 'T'))) AS codon FROM al),
uc AS (SELECT dataset_id, codon, amino_acid, count(*) AS n FROM cod JOIN code USING (codon) WHERE amino_acid <> '*' GROUP BY ALL),
usage AS (SELECT *, greatest(n::DOUBLE / max(n) OVER (PARTITION BY dataset_id, amino_acid), 1e-4::DOUBLE) AS weight FROM uc),
cq AS (SELECT dataset_id, seq_ord, sequence_id, unnest(list_transform(range(length(seq) // 3), lambda i: translate(substr(seq, 3 * i + 1, 3), 'U', 'T'))) AS codon FROM q),
cai AS (SELECT dataset_id, seq_ord, sequence_id, exp(avg(ln(weight))) AS cai, count(*) AS n_codons FROM cq JOIN usage USING (dataset_id, codon) WHERE codon NOT IN ('ATG','TGG') GROUP BY ALL)
"""
_SEL = f""", pt AS {_values(genetic_code.pair_rows(), "ref_codon, query_codon, s_sites, s_diff, n_diff")},
cp AS (
  SELECT dataset_id, seq_ord, sequence_id, length(seq) // 3 AS total, unnest(range(length(seq) // 3)) AS at, unnest(list_transform(range(length(seq) // 3), lambda i: substr(ref, 3 * i + 1, 3))) AS ref_codon,
    unnest(list_transform(range(length(seq) // 3), lambda i: substr(seq, 3 * i + 1, 3))) AS query_codon FROM q),
cj AS (SELECT * FROM cp JOIN pt USING (ref_codon, query_codon)),
"""


def _omega(source: str, keys: str) -> str:
    """Selection from summed counts, as common table expressions ending in ``sel``."""
    return f"""cs AS (SELECT {keys}, count(*) AS n_codons, sum(s_sites) AS s_sites, count(*) * 3 - sum(s_sites) AS n_sites, sum(s_diff) AS s_diff, sum(n_diff) AS n_diff FROM {source} GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN s_diff = 0 AND s_sites > 0 THEN 0.5::DOUBLE / (s_sites + 1) WHEN s_sites > 0 THEN s_diff / s_sites END AS ps, CASE WHEN n_sites > 0 THEN n_diff / n_sites END AS pn FROM cs),
c2 AS (SELECT *, 1 - 4 * ps / 3 <= 0 OR 1 - 4 * pn / 3 <= 0 AS saturated FROM c1),
c3 AS (
  SELECT *, CASE WHEN saturated THEN ps ELSE abs(-0.75 * ln(CASE WHEN 1 - 4 * ps / 3 > 0 THEN 1 - 4 * ps / 3 ELSE 1 END)) END AS ds,
    CASE WHEN saturated THEN pn ELSE abs(-0.75 * ln(CASE WHEN 1 - 4 * pn / 3 > 0 THEN 1 - 4 * pn / 3 ELSE 1 END)) END AS dn FROM c2),
c4 AS (
  SELECT *, CASE WHEN ds = 0 THEN dn ELSE dn / ds END AS omega,
    CASE WHEN s_diff > 0 AND n_diff > 0 AND NOT saturated THEN ps * (1 - ps) / (s_sites * (1 - 4 * ps / 3) ^ 2) + pn * (1 - pn) / (n_sites * (1 - 4 * pn / 3) ^ 2) END AS var FROM c3),
c5 AS (SELECT *, CASE WHEN var > 0 THEN (dn - ds) / sqrt(var) END AS z FROM c4),
sel AS (SELECT * EXCLUDE (var), CASE WHEN z IS NULL THEN 'inconclusive' WHEN abs(z) <= 1.959963984540054 THEN 'neutral' WHEN z > 0 THEN 'positive' ELSE 'purifying' END AS verdict FROM c5)
"""


_DATED = """, md AS (
  SELECT dataset_id, trim(sequence_id, ' ' || chr(9)) AS k, row_id, collection_date AS c, location, host FROM metadata WHERE length(trim(sequence_id, ' ' || chr(9))) > 0
  QUALIFY row_number() OVER (PARTITION BY dataset_id, trim(sequence_id, ' ' || chr(9)) ORDER BY row_id DESC) = 1),
mp AS (
  SELECT *, CASE WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(c AS DATE) END AS full_day, CASE WHEN regexp_full_match(c, '[0-9]{4}-[0-9]{2}') THEN try_cast(c || '-01' AS DATE) END AS m,
    CASE WHEN regexp_full_match(c, '[0-9]{4}') THEN try_cast(c || '-01-01' AS DATE) END AS y FROM md),
mt AS (
  SELECT dataset_id, k, coalesce(full_day, m + day(last_day(m))::INT // 2, y + date_diff('day', y, (y + INTERVAL 1 YEAR)::DATE)::INT // 2)::DATE AS collected,
    CASE WHEN full_day IS NOT NULL THEN 'day' WHEN m IS NOT NULL THEN 'month' WHEN y IS NOT NULL THEN 'year' ELSE 'none' END AS precision, location, host FROM mp),
dated AS (SELECT al.*, collected, coalesce(precision, 'none') AS precision, location, host FROM al LEFT JOIN mt ON al.dataset_id = mt.dataset_id AND al.sequence_id = mt.k)
"""
_CLOCK = """, have AS (SELECT * FROM dated WHERE collected IS NOT NULL),
anc AS (SELECT dataset_id, seq AS anchor FROM have QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY collected, seq_ord) = 1),
cz AS (SELECT dataset_id, seq_ord, collected, unnest(string_split(anchor, '')) AS a, unnest(string_split(seq, '')) AS b FROM have JOIN anc USING (dataset_id)),
cd AS (SELECT dataset_id, seq_ord, collected, count(*) FILTER (a <> b)::DOUBLE / count(*) AS p FROM cz WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T') GROUP BY ALL),
cy AS (
  SELECT dataset_id, year(collected) + (dayofyear(collected) - 1)::DOUBLE / CASE WHEN year(collected) % 4 = 0 AND (year(collected) % 100 <> 0 OR year(collected) % 400 = 0) THEN 366 ELSE 365 END AS yr,
    abs(-0.75 * ln(1 - 4 * p / 3)) AS d FROM cd WHERE 1 - 4 * p / 3 > 0),
cf AS (SELECT dataset_id, count(*) AS n_dated, count(DISTINCT yr) AS n_dates, CASE WHEN count(DISTINCT yr) >= 2 THEN regr_slope(d, yr) END AS mu, CASE WHEN count(DISTINCT yr) >= 2 THEN regr_intercept(d, yr) END AS intercept, CASE WHEN count(DISTINCT yr) >= 2 THEN regr_r2(d, yr) END AS r2 FROM cy GROUP BY ALL)
"""
_SCHEME = _values([(k, w, *RANGES[k]) for k, w in WEIGHTS.items()], "key, weight, low, high")


def _composite(indices: str) -> str:
    return f""", scheme AS {_SCHEME},
idx AS ({indices}),
cpt AS (SELECT dataset_id, key, value, weight, greatest(0, least(1, (value - low) / (high - low))) AS nv, value >= high AS top FROM idx JOIN scheme USING (key) WHERE value IS NOT NULL AND NOT isnan(value)),
gvi AS (SELECT dataset_id, sum(weight * nv) / sum(weight) AS gvi, sum(weight) AS coverage, count(*) AS n_indices, count(*) FILTER (top) AS n_at_ceiling, sum(weight) >= {COMPARABLE} AS comparable FROM cpt GROUP BY ALL)
"""


_ALL = _PAIR + _PI + _CODE + _SEL + _omega("cj", "dataset_id") + _DATED + _CLOCK + _composite(
    """SELECT dataset_id, 'pi' AS key, pi AS value FROM pi UNION ALL SELECT dataset_id, 'GD', avg(jc69) FROM dist GROUP BY ALL UNION ALL SELECT dataset_id, 'MB', avg(substitutions + indels) FROM mb GROUP BY ALL
  UNION ALL SELECT dataset_id, 'GC_Deviation', avg(abs(gq - gr)) FROM (SELECT dataset_id, 100.0::DOUBLE * length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0) AS gq, 100.0::DOUBLE * length(regexp_replace(ref, '[^GC]', '', 'g')) / nullif(length(regexp_replace(ref, '[^ACGT]', '', 'g')), 0) AS gr FROM q) GROUP BY ALL
  UNION ALL SELECT dataset_id, 'CAI', avg(cai) FROM cai GROUP BY ALL UNION ALL SELECT dataset_id, 'dN/dS', omega FROM sel UNION ALL SELECT dataset_id, 'mu', mu FROM cf"""
)
_SENSITIVITY = f""", total AS (SELECT sum(weight) AS t FROM scheme), w AS (SELECT key, weight / t AS w FROM scheme, total),
mv AS (
  SELECT c.key AS changed, s.sign, k.key, CASE WHEN c.key = k.key THEN c.w * (1 + s.sign * 0.2::DOUBLE) ELSE greatest(0, k.w - c.w * s.sign * 0.2::DOUBLE * k.w / (1 - c.w)) END AS nw
  FROM w c, w k, (VALUES (-1), (1)) s(sign)),
sc AS (SELECT dataset_id, changed, sign, sum(nw * nv) / sum(nw) AS score FROM cpt JOIN mv USING (key) GROUP BY ALL)
SELECT dataset_id, changed AS key, round(min(score), 6) AS low, round(max(score), 6) AS high FROM sc WHERE (dataset_id, changed) IN (SELECT (dataset_id, key) FROM cpt) GROUP BY ALL"""
_RE_WEIGHTS = _values([(float(u), w) for u, w in enumerate(E.serial_interval(), 1)], "u, w")

ORACLE = {
    "composite_score": _ALL + "SELECT dataset_id, round(gvi, 6) AS gvi, round(coverage, 6) AS coverage, n_indices, n_at_ceiling, comparable FROM gvi",
    "composite_sensitivity": _ALL + _SENSITIVITY,
    "alignment_summary": _AL + "SELECT dataset_id, count(*) AS n_sequences, max(length(seq))::INT AS length, min(length(seq)) = max(length(seq)) AS equal_length, arg_min(sequence_id, seq_ord) AS reference_id, round(sum(length(seq) - length(regexp_replace(seq, '[-.?]', '', 'g')))::DOUBLE / sum(length(seq)), 9) AS gap_fraction FROM al GROUP BY dataset_id",
    "site_profile": _SITES + "SELECT dataset_id, pos::INT AS pos, n_alleles, rarest, n_gaps, n_other, alleles, kind, informative FROM pk",
    "site_summary": _SITES
    + """, isl AS (SELECT dataset_id, pos - row_number() OVER (PARTITION BY dataset_id ORDER BY pos) AS island FROM pk WHERE n_gaps = 0),
blk AS (SELECT dataset_id, max(n) AS longest_block FROM (SELECT dataset_id, island, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL)
SELECT pk.dataset_id, count(*) AS n_columns, count(*) FILTER (n_alleles > 1) AS n_variable, count(*) FILTER (informative) AS n_informative, count(*) FILTER (n_gaps = 0) AS n_gap_free, count(*) FILTER (n_other = 0) AS n_covered,
  count(*) FILTER (kind = 'transition') AS n_transition, count(*) FILTER (kind = 'transversion') AS n_transversion, coalesce(any_value(longest_block), 0) AS longest_block FROM pk LEFT JOIN blk USING (dataset_id) GROUP BY pk.dataset_id""",
    "trimmed_alignment": _SITES + "SELECT s.dataset_id, s.seq_ord, any_value(al.sequence_id) AS sequence_id, string_agg(s.base, '' ORDER BY s.pos) AS seq FROM site s JOIN pk ON pk.dataset_id = s.dataset_id AND pk.pos = s.pos AND n_gaps = 0 JOIN al ON al.dataset_id = s.dataset_id AND al.seq_ord = s.seq_ord GROUP BY s.dataset_id, s.seq_ord",
    "genetic_distance": _PAIR + "SELECT dataset_id, seq_ord, sequence_id, comparable, transitions, transversions, round(p, 9) AS p, round(jc69, 9) AS jc69, round(k80, 9) AS k80, saturated FROM dist",
    "mutation_burden": _PAIR + "SELECT *, substitutions + indels AS burden FROM mb",
    "gc_content": _AL
    + "SELECT dataset_id, seq_ord, sequence_id, round(gq, 9) AS gc, round(abs(gq - gr), 9) AS gc_deviation FROM (SELECT *, 100.0::DOUBLE * length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0) AS gq, 100.0::DOUBLE * length(regexp_replace(ref, '[^GC]', '', 'g')) / nullif(length(regexp_replace(ref, '[^ACGT]', '', 'g')), 0) AS gr FROM q)",
    "mutation_signatures": _PAIR
    + """, c AS (SELECT *, lag(a) OVER (PARTITION BY dataset_id, seq_ord ORDER BY pos) AS pa FROM z), f AS (SELECT * FROM c WHERE pa IN ('A','C','G','T') AND a IN ('A','C') AND b IN ('A','C','G','T'))
SELECT dataset_id, count(*) FILTER (a = 'C' AND pa = 'T') AS c_after_t, count(*) FILTER (a = 'C' AND pa = 'T' AND b = 'T') AS ct_after_t, count(*) FILTER (a = 'C') AS c_sites, count(*) FILTER (a = 'C' AND b = 'T') AS ct_sites,
  count(*) FILTER (a = 'A' AND pa IN ('T','A')) AS a_after_ta, count(*) FILTER (a = 'A' AND pa IN ('T','A') AND b = 'G') AS ag_after_ta, count(*) FILTER (a = 'A') AS a_sites, count(*) FILTER (a = 'A' AND b = 'G') AS ag_sites FROM f GROUP BY dataset_id""",
    "nucleotide_diversity": _AL + _PI + "SELECT dataset_id, n_pairs, round(pi, 9) AS pi FROM pi",
    "sliding_diversity": _AL
    + _PAIRS
    + """, wide AS (SELECT dataset_id, max(length(seq)) AS len, greatest(20, floor(max(length(seq)) / 12 + 0.5))::INT AS w FROM al GROUP BY ALL),
st AS (SELECT dataset_id, w, unnest(range(0, len - w + 1, greatest(5, floor(w / 4 + 0.5))::INT)) AS lo FROM wide),
wp AS (
  SELECT st.dataset_id, st.lo, i, j, count(*) AS n, count(*) FILTER (a <> b) AS d FROM st JOIN base ON base.dataset_id = st.dataset_id AND pos >= st.lo AND pos < st.lo + st.w
  WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T') GROUP BY ALL)
SELECT st.dataset_id, st.lo::INT + 1 AS start, count(n) AS n_pairs, round(avg(d / n), 9) AS pi FROM st LEFT JOIN wp ON wp.dataset_id = st.dataset_id AND wp.lo = st.lo GROUP BY ALL""",
    "preflight": _SITES
    + _PAIRS
    + """, ext AS (SELECT dataset_id, min(1 - differ / comparable) AS least FROM cmp GROUP BY ALL),
spn AS (SELECT dataset_id, count(*) AS n, count(*) FILTER (greatest(0, least(ha, hb) - greatest(la, lb) + 1) < 0.5::DOUBLE * least(ha - la + 1, hb - lb + 1)) AS poor FROM two WHERE ha >= la AND hb >= lb GROUP BY ALL),
cov AS (SELECT dataset_id, count(*) FILTER (n_other = 0) / count(*) AS share FROM pk GROUP BY ALL),
cnt_al AS (SELECT dataset_id, count(*) AS n_sequences FROM al GROUP BY ALL),
f AS (
  SELECT c.dataset_id, n_sequences, CASE WHEN n_sequences >= 2 THEN coalesce(least, 1) END AS min_identity, share AS covered_fraction, CASE WHEN n_sequences >= 3 AND n > 0 THEN poor / n END AS poor_overlap_fraction
  FROM cnt_al c LEFT JOIN ext USING (dataset_id) LEFT JOIN spn USING (dataset_id) LEFT JOIN cov USING (dataset_id))
SELECT dataset_id, n_sequences, round(min_identity, 9) AS min_identity, round(covered_fraction, 9) AS covered_fraction, round(poor_overlap_fraction, 9) AS poor_overlap_fraction,
  coalesce(min_identity < 0.7::DOUBLE, false) AS diverged, covered_fraction < 0.6::DOUBLE AS uncovered, coalesce(poor_overlap_fraction >= 0.15::DOUBLE, false) AS poorly_overlapping FROM f""",
    "poor_overlap_examples": _AL
    + """, o AS (
  SELECT dataset_id, seq_ord, sequence_id, length(regexp_extract(seq, '^[-.?]*')) AS a, length(seq) - length(regexp_extract(seq, '[-.?]*$')) AS b, length(regexp_extract(ref, '^[-.?]*')) AS c, length(ref) - length(regexp_extract(ref, '[-.?]*$')) AS d FROM q),
ex AS (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY seq_ord)::INT AS nth, seq_ord, sequence_id FROM o WHERE b > a AND d > c AND greatest(0, least(b, d) - greatest(a, c)) * 2 < least(b - a, d - c))
SELECT * FROM ex WHERE nth <= 3""",
    "lineages": _AL.replace("WITH al", "WITH RECURSIVE al")
    + _PAIRS
    + """, near AS (SELECT two.dataset_id, two.i, two.j FROM two LEFT JOIN cmp USING (dataset_id, i, j) WHERE coalesce(differ / comparable, 0) < 0.05::DOUBLE),
edge AS (SELECT dataset_id, i, j FROM near UNION ALL SELECT dataset_id, j, i FROM near),
reach AS (SELECT dataset_id, seq_ord, seq_ord AS root FROM al UNION SELECT r.dataset_id, e.j, r.root FROM reach r JOIN edge e ON e.dataset_id = r.dataset_id AND e.i = r.seq_ord WHERE e.j > r.root),
lab AS (SELECT dataset_id, seq_ord, min(root) AS lineage FROM reach GROUP BY ALL)
SELECT al.dataset_id, al.seq_ord, al.sequence_id, lineage, count(*) OVER (PARTITION BY al.dataset_id, lineage) AS n_members FROM al JOIN lab USING (dataset_id, seq_ord) WHERE dataset_id IN (SELECT dataset_id FROM al GROUP BY ALL HAVING count(*) >= 3)""",
    "codon_usage": _AL + _CODE + "SELECT dataset_id, codon, amino_acid, n, round(weight, 9) AS weight FROM usage",
    "codon_positions": _SITES
    + _F3X4
    + "SELECT dataset_id, codon_position, base, round(share, 9) AS share FROM f3",
    "codon_adaptation": _AL + _CODE + "SELECT dataset_id, seq_ord, sequence_id, round(cai, 9) AS cai, n_codons FROM cai",
    "selection_by_query": _AL + _SEL + _omega("cj", "dataset_id, seq_ord, sequence_id") + "SELECT * REPLACE (round(s_sites, 9) AS s_sites, round(n_sites, 9) AS n_sites, round(s_diff, 9) AS s_diff, round(n_diff, 9) AS n_diff, round(ps, 9) AS ps, round(pn, 9) AS pn, round(ds, 9) AS ds, round(dn, 9) AS dn, round(omega, 9) AS omega, round(z, 9) AS z) FROM sel",
    "selection_pooled": _AL + _SEL + _omega("cj", "dataset_id") + "SELECT * REPLACE (round(s_sites, 9) AS s_sites, round(n_sites, 9) AS n_sites, round(s_diff, 9) AS s_diff, round(n_diff, 9) AS n_diff, round(ps, 9) AS ps, round(pn, 9) AS pn, round(ds, 9) AS ds, round(dn, 9) AS dn, round(omega, 9) AS omega, round(z, 9) AS z) FROM sel",
    "selection_windows": _AL + _SEL + "win AS (SELECT cj.*, r.lo + 1 AS start_codon FROM cj, range(0, 1000, 5) r(lo) WHERE cj.at >= r.lo AND cj.at < r.lo + 10 AND r.lo + 10 <= cj.total),\n" + _omega("win", "dataset_id, start_codon") + "SELECT dataset_id, start_codon::INT AS start_codon, n_codons, round(s_sites, 9) AS s_sites, round(s_diff, 9) AS s_diff, round(n_diff, 9) AS n_diff, round(omega, 9) AS omega FROM sel",
    "dated_records": _AL + _DATED + "SELECT dataset_id, seq_ord, sequence_id, strftime(collected, '%Y-%m-%d') AS collected, precision, location, host FROM dated",
    "clock_rate": _AL + _DATED + _CLOCK + "SELECT dataset_id, n_dated, n_dates, round(mu, 7) AS mu, round(intercept, 7) AS intercept, round(r2, 7) AS r2 FROM cf",
    "reproduction_number": f"""WITH r AS (SELECT DISTINCT report_id, series_id, date, new_cases FROM incidence WHERE new_cases IS NOT NULL AND NOT isnan(new_cases) AND new_cases >= 0),
daily AS (SELECT series_id, date AS day, sum(new_cases) AS total FROM r GROUP BY ALL),
cal AS (SELECT series_id, unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM incidence_series),
f AS (SELECT c.series_id, c.day, row_number() OVER (PARTITION BY c.series_id ORDER BY c.day) AS nth, coalesce(total, 0)::DOUBLE AS i FROM cal c LEFT JOIN daily d ON d.series_id = c.series_id AND d.day = c.day),
w AS {_RE_WEIGHTS},
p AS (SELECT a.series_id, a.day, a.nth, any_value(a.i) AS i, coalesce(sum(w.w * b.i), 0) AS l FROM f a LEFT JOIN w ON true LEFT JOIN f b ON b.series_id = a.series_id AND b.nth = a.nth - w.u GROUP BY ALL),
e AS (SELECT *, (1 + sum(i) OVER k) / (0.2::DOUBLE + sum(l) OVER k) AS re FROM p WINDOW k AS (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING))
SELECT series_id, strftime(day, '%Y-%m-%d') AS day, i AS infections, round(l, 6) AS pressure, round(re, 6) AS re FROM e WHERE nth > 26""",
    "summary_composite": "WITH one AS (SELECT 1)"
    + _composite("SELECT row_id::VARCHAR AS dataset_id, 'mu' AS key, try_cast(mu AS DOUBLE) AS value FROM all_pathogens_summary UNION ALL SELECT row_id::VARCHAR, 'MB', mb FROM all_pathogens_summary UNION ALL SELECT row_id::VARCHAR, 'GC_Deviation', gc FROM all_pathogens_summary")
    + "SELECT dataset_id, round(gvi, 9) AS gvi, round(coverage, 9) AS coverage, n_indices, n_at_ceiling, comparable FROM gvi",
    "beta_genomic": "WITH one AS (SELECT 1)"
    + _composite("SELECT row_id::VARCHAR AS dataset_id, 'mu' AS key, try_cast(mu AS DOUBLE) AS value FROM all_pathogens_summary UNION ALL SELECT row_id::VARCHAR, 'MB', mb FROM all_pathogens_summary UNION ALL SELECT row_id::VARCHAR, 'GC_Deviation', gc FROM all_pathogens_summary")
    + "SELECT dataset_id, round(1 + gvi * 2, 9) AS beta FROM gvi",
    "corpus_ranking": """SELECT load_id, row_id, row_number() OVER (PARTITION BY load_id ORDER BY yes DESC, CASE WHEN yes THEN g END DESC NULLS LAST, pathogen ASC NULLS FIRST, row_id)::INT AS place
FROM (SELECT *, coalesce(lower(comparable) = 'yes', false) AS yes, try_cast(gvi AS DOUBLE) AS g FROM all_pathogens_summary)""",
}

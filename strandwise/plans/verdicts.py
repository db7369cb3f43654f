"""Queries of genes, tests, bands and reports over the sequence tables, and their ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import genetic_code
from strandwise.functions.bands import BANDS, WEIGHTS, index_band
from strandwise.operators import alignment as A
from strandwise.operators import codons as C
from strandwise.operators import composite as M
from strandwise.operators import distance as D
from strandwise.operators import epidemic as E
from strandwise.operators import genes as GN
from strandwise.operators import phylo as P
from strandwise.plans import genomics as Q
from strandwise.sources import files
from strandwise.sources.tables import table

_alignment, _rounded, _dated = Q._alignment, Q._rounded, Q._dated
#: Frames as short as this count as genes in these queries, as the alignments have some 30 codons.
SHORT_GENES = 8


def _genes(al: DataFrame) -> DataFrame:
    return GN.gene_table(al, minimum=SHORT_GENES)


def genes(spark: SparkSession, d: str) -> DataFrame:
    return _genes(_alignment(spark, d))


def trimmed_genes(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return GN.trimmed_genes(al, _genes(al))


def gene_cds(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return GN.gene_cds(al, _genes(al))


def selection_by_gene(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return _rounded(GN.selection_by_gene(al, _genes(al))).select("dataset_id", "seq_ord", "sequence_id", "gene_ord", "gene", "n_codons", "s_sites", "n_sites", "s_diff", "n_diff", "omega", "z", "verdict")


def worst_genes(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the gene with the largest omega, and its usual selection by its name."""
    al = _alignment(spark, d)
    return _rounded(GN.worst_genes(GN.selection_by_gene(al, _genes(al)))).select("dataset_id", "seq_ord", "sequence_id", "gene_ord", "gene", "omega")


def selection_pooled_genes(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: one ratio from the sums over its queries' worst genes."""
    al = _alignment(spark, d)
    return _rounded(C.pooled_selection(GN.worst_genes(GN.selection_by_gene(al, _genes(al))))).select("dataset_id", "n_codons", "s_sites", "n_sites", "s_diff", "n_diff", "omega", "verdict")


def adaptation_by_gene(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return _rounded(GN.adaptation_by_gene(al, _genes(al), C.codon_usage(al)))


def selection_test(spark: SparkSession, d: str) -> DataFrame:
    """The Z test of each query with its two-tailed p."""
    tested = C.with_p_value(C.selection(C.selection_counts(_alignment(spark, d))))
    return tested.select("dataset_id", "seq_ord", "sequence_id", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), "verdict")


def signature_test(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.signature_tests(D.context_counts(_alignment(spark, d), ["dataset_id", "seq_ord", "sequence_id"])), 7)


def index_bands(spark: SparkSession, d: str) -> DataFrame:
    """Every index of every dataset with the band that its value is in."""
    return Q._indices(spark, d).where("value is not null").select("dataset_id", "key", index_band(F.col("key"), F.col("value")).alias("band"))


def index_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Mean, least and largest value over the queries of the indices that each query has."""
    parts = [m().where("value is not null").groupBy("dataset_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")).withColumn("key", F.lit(k)) for k, m in Q.index_values(spark, d).items() if k in PER_QUERY]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _rounded(out, 7).select("dataset_id", "key", "n", "mean", "least", "most")


PER_QUERY = ("GD", "MB", "GC_Deviation", "CAI")


def per_sequence(spark: SparkSession, d: str) -> DataFrame:
    """One row per query with all its values, as the per-sequence report writes them."""
    al = _alignment(spark, d)
    keys = ["dataset_id", "seq_ord"]
    out = A.queries_beside_reference(al).select(*keys, "sequence_id")
    for k, m in Q.index_values(spark, d).items():
        if k in PER_QUERY:
            out = out.join(m().select(*keys, F.col("value").alias(k.lower())), keys, "left")
    omega = C.selection(C.selection_counts(al)).select(*keys, "omega")
    return _rounded(out.join(omega, keys, "left"), 7)


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """The weighted indices that each dataset's composite lacks, by cause."""
    al = _alignment(spark, d)
    clock = E.clock_rate(_dated(spark, d)).select("dataset_id", "mu", "r2")
    return M.exclusions(M.gate(Q._indices(spark, d), Q._evidence(al, clock))).select("dataset_id", "cause", F.array_join("keys", ",").alias("keys"))


def date_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The pairwise clock with the share of date shuffles that do as well, and whether that passes."""
    dated = _dated(spark, d)
    tested = E.clock_rate(dated).join(P.date_shuffles(E.clock_points(dated)), "dataset_id", "left")
    return _rounded(tested.select("dataset_id", "n_dated", "n_dates", "mu", "p_value", F.coalesce(F.col("p_value") < M.MOST_P, F.col("n_dates") >= 2).alias("passes")), 7)


def outbreak_age(spark: SparkSession, d: str) -> DataFrame:
    al = _alignment(spark, d)
    return _rounded(D.outbreak_age(D.mutation_burden(al), E.clock_rate(_dated(spark, d)), A.alignment_summary(al)), 4)


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = A.dataset_summary(_alignment(spark, d), _dated(spark, d))
    return rows.select("dataset_id", "n_sequences", "length", "reference_id", "n_dated", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_date", "last_date")])


def substitution_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.substitution_counts(A.site_counts(_alignment(spark, d)))


def base_composition(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.base_composition(A.site_counts(_alignment(spark, d))))


def codon_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.codon_frequencies(C.codon_positions(_alignment(spark, d))))


def summary_fit(spark: SparkSession, d: str) -> DataFrame:
    """Per load: how far the score of a corpus summary is from the composite of the indices it carries."""
    stored = table(spark, d, "all_pathogens_summary").select("load_id", F.col("row_id").cast("string").alias("dataset_id"), F.col("gvi").try_cast("double").alias("stored"))
    scores = M.composite(M.components(Q._summary_indices(spark, d)))
    return _rounded(M.fit_error(stored.join(scores, "dataset_id"), ["load_id"], "gvi", "stored"), 6)


def fasta_counts(spark: SparkSession, d: str) -> DataFrame:
    """The sequence table as FASTA text of one file per dataset, read again: what loads of each file and what does not, by reason."""
    t = table(spark, d, "sequences")
    raw = t.select(F.col("dataset_id").alias("source"), F.lit(1).alias("block"), F.col("seq_ord").alias("at"), F.concat("sequence_id", F.lit(" x\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    good, bad = files.parse_fasta(raw)
    return good.select("source", F.lit("loaded").alias("reason")).unionByName(bad.select("source", "reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """Date, place and host of the FASTA headers that the metadata rows would have."""
    header = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("sequence_id", "location", "host", "collection_date")])
    day, by_year, place, host = files.header_fields(header)
    return table(spark, d, "metadata").select("row_id", F.date_format(day, "yyyy-MM-dd").alias("day"), by_year.alias("by_year"), place.alias("location"), host.alias("host"))


QUERIES = {
    f.__name__: f
    for f in (
        genes, trimmed_genes, gene_cds, selection_by_gene, worst_genes, selection_pooled_genes, adaptation_by_gene, selection_test, signature_test, index_bands, index_ranges, per_sequence, exclusions, date_shuffle, outbreak_age,
        dataset_summary, substitution_counts, base_composition, codon_frequencies, summary_fit, fasta_counts, header_fields,
    )
}

_TURNED = "translate(reverse(regexp_replace({0}, '[^ACGTURYWSKMBVDH]', 'N', 'g')), 'ACGTURYWSKMBVDH', 'TGCAAYRWSMKVBHD')"


def _frames(source: str, least: int) -> str:
    """Open reading frames of (dataset_id, sequence_id, s) as common table expressions ending in ``orf``."""
    return f"""sides AS (SELECT dataset_id, sequence_id, '+' AS strand, s FROM {source} UNION ALL SELECT dataset_id, sequence_id, '-', {_TURNED.format("s")} FROM {source}),
framed AS (SELECT *, unnest([0, 1, 2]) AS frame FROM sides),
cods AS (SELECT dataset_id, sequence_id, strand, frame, length(s) AS len, unnest(range(greatest((length(s) - frame) // 3, 0))) AS k, unnest(list_transform(range(greatest((length(s) - frame) // 3, 0)), lambda i: translate(substr(s, 3 * i + frame + 1, 3), 'U', 'T'))) AS codon FROM framed),
cut AS (SELECT *, coalesce(sum((codon IN ('TAA','TAG','TGA'))::INT) OVER (PARTITION BY dataset_id, sequence_id, strand, frame ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cods),
ends AS (SELECT dataset_id, sequence_id, strand, frame, len, min(k) FILTER (codon = 'ATG') AS a, max(k) FILTER (codon IN ('TAA','TAG','TGA')) AS b FROM cut GROUP BY dataset_id, sequence_id, strand, frame, len, part),
orf AS (
  SELECT dataset_id, sequence_id, strand, frame::INT AS frame, (CASE strand WHEN '+' THEN frame + 3 * a + 1 ELSE len - frame - 3 * b - 2 END)::INT AS start, (CASE strand WHEN '+' THEN frame + 3 * b + 3 ELSE len - frame - 3 * a END)::INT AS "end", (b - a + 1)::INT AS codons
  FROM ends WHERE b > a AND b - a + 1 >= {least})
"""


# Alignments here have no frame of 90 codons, so that nothing is trained and the relative length decides.
_GENES = f""", refs AS (SELECT dataset_id, ref_id AS sequence_id, ref AS s FROM ref),
{_frames("refs", SHORT_GENES)}, named AS (
  SELECT *, CASE strand WHEN '+' THEN 'orf_fwd' ELSE 'orf_rev' END || frame || '_' || row_number() OVER (PARTITION BY dataset_id, strand, frame ORDER BY CASE strand WHEN '+' THEN start ELSE -"end" END) AS gene, max(codons) OVER (PARTITION BY dataset_id) AS longest FROM orf),
pred AS (SELECT dataset_id, gene, start, "end", strand, 'predicted' AS origin FROM named WHERE codons >= longest * 0.3::DOUBLE),
gene AS (
  SELECT dataset_id, (row_number() OVER (PARTITION BY dataset_id ORDER BY start - "end", start, "end", strand, gene) - 1)::INT AS gene_ord, gene, start::BIGINT AS start, "end"::BIGINT AS "end", strand, origin
  FROM (SELECT * FROM pred UNION ALL SELECT dataset_id, 'whole_genome', 1, length(s), '+', 'whole' FROM refs WHERE dataset_id NOT IN (SELECT dataset_id FROM pred))),
cds AS (
  SELECT q.dataset_id, seq_ord, sequence_id, gene_ord, gene, CASE WHEN "end" <= length(ref) THEN CASE strand WHEN '+' THEN substr(ref, start, "end" - start + 1) ELSE {_TURNED.format('substr(ref, start, "end" - start + 1)')} END END AS ref,
    CASE WHEN "end" <= length(seq) THEN CASE strand WHEN '+' THEN substr(seq, start, "end" - start + 1) ELSE {_TURNED.format('substr(seq, start, "end" - start + 1)')} END END AS seq FROM q JOIN gene USING (dataset_id))
"""
_BY_GENE = (
    Q._AL
    + _GENES
    + f""", pt AS {Q._values(genetic_code.pair_rows(), "ref_codon, query_codon, s_sites, s_diff, n_diff")},
gp AS (
  SELECT dataset_id, seq_ord, sequence_id, gene_ord, gene, unnest(list_transform(range(length(ref) // 3), lambda i: substr(ref, 3 * i + 1, 3))) AS ref_codon, unnest(list_transform(range(length(seq) // 3), lambda i: substr(seq, 3 * i + 1, 3))) AS query_codon FROM cds),
gj AS (SELECT * FROM gp JOIN pt USING (ref_codon, query_codon)),
"""
    + Q._omega("gj", "dataset_id, seq_ord, sequence_id, gene_ord, gene")
    + ", worst AS (SELECT * FROM sel QUALIFY row_number() OVER (PARTITION BY dataset_id, seq_ord ORDER BY omega DESC NULLS LAST, gene_ord) = 1)\n"
)
_SELECTED = "n_codons, round(s_sites, 9) AS s_sites, round(n_sites, 9) AS n_sites, round(s_diff, 9) AS s_diff, round(n_diff, 9) AS n_diff, round(omega, 9) AS omega"


def _band_case(value: str, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {end!r}::DOUBLE THEN '{name}'" for end, name in BANDS[key][:-1]) + f" ELSE '{BANDS[key][-1][1]}' END"


_BANDS = (
    Q._ALL
    + "SELECT dataset_id, key, CASE key WHEN 'dN/dS' THEN CASE WHEN value < 0.95::DOUBLE THEN 'purifying' WHEN value <= 1.05::DOUBLE THEN 'neutral' ELSE 'positive' END WHEN 'MB' THEN "
    + _band_case("floor(value + 0.5::DOUBLE)", "MB")
    + " "
    + " ".join(f"WHEN '{k}' THEN {_band_case('value', k)}" for k in BANDS if k not in ("MB", "mu, DNA"))
    + " END AS band FROM idx WHERE value IS NOT NULL"
)
_EACH = """, gcd AS (SELECT dataset_id, seq_ord, abs(gq - gr) AS v FROM (SELECT *, 100.0::DOUBLE * length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0) AS gq, 100.0::DOUBLE * length(regexp_replace(ref, '[^GC]', '', 'g')) / nullif(length(regexp_replace(ref, '[^ACGT]', '', 'g')), 0) AS gr FROM q)),
each AS (SELECT dataset_id, seq_ord, 'GD' AS key, jc69 AS v FROM dist UNION ALL SELECT dataset_id, seq_ord, 'MB', substitutions + indels FROM mb UNION ALL SELECT dataset_id, seq_ord, 'GC_Deviation', v FROM gcd UNION ALL SELECT dataset_id, seq_ord, 'CAI', cai FROM cai)
"""
_GATE = """, ev2 AS (
  SELECT a.dataset_id, gap, b.burden / a.len AS share, cf.mu, cf.r2, sel.omega, sel.verdict
  FROM (SELECT dataset_id, max(length(seq)) AS len, sum(length(seq) - length(regexp_replace(seq, '[-.?]', '', 'g')))::DOUBLE / sum(length(seq)) AS gap FROM al GROUP BY ALL) a
  LEFT JOIN (SELECT dataset_id, avg(substitutions + indels) AS burden FROM mb GROUP BY ALL) b USING (dataset_id) LEFT JOIN cf USING (dataset_id) LEFT JOIN sel USING (dataset_id)),
gated AS (
  SELECT idx.dataset_id, key, value, CASE WHEN key IN ('MB', 'GD', 'dN/dS', 'pi', 'mu') AND (gap >= 0.15::DOUBLE OR share >= 0.15::DOUBLE) THEN 'alignment' WHEN key = 'mu' AND mu <= 0 THEN 'rate not positive' WHEN key = 'mu' AND r2 < 0.3::DOUBLE THEN 'weak clock signal'
    WHEN key = 'dN/dS' AND omega > 1 AND verdict <> 'positive' THEN 'selection not significant' END AS excluded FROM idx LEFT JOIN ev2 USING (dataset_id))
"""
_FACT = lambda n: f"lgamma({n} + 1)"
_WAYS = lambda n, k: f"({_FACT(n)} - {_FACT(k)} - {_FACT(f'({n} - {k})')})"

ORACLE = {
    "gated_indices": Q._ALL + _GATE + "SELECT dataset_id, key, round(value, 6) AS value, excluded FROM gated",
    "open_reading_frames": Q._AL + ", bare AS (SELECT dataset_id, sequence_id, regexp_replace(seq, '[-.?]', '', 'g') AS s FROM al),\n" + _frames("bare", 30) + "SELECT * FROM orf",
    "genes": Q._AL + _GENES + "SELECT * FROM gene",
    "trimmed_genes": Q._SITES + _GENES
    + """, kept AS (SELECT dataset_id, pos, row_number() OVER (PARTITION BY dataset_id ORDER BY pos) AS nth FROM pk WHERE n_gaps = 0)
SELECT g.dataset_id, gene_ord, gene, min(nth) AS new_start, max(nth) AS new_end, strand FROM gene g JOIN kept k ON k.dataset_id = g.dataset_id AND pos BETWEEN start - 1 AND "end" - 1 GROUP BY ALL""",
    "gene_cds": Q._AL + _GENES + "SELECT * FROM cds",
    "selection_by_gene": _BY_GENE + f"SELECT dataset_id, seq_ord, sequence_id, gene_ord, gene, {_SELECTED}, round(z, 9) AS z, verdict FROM sel",
    "worst_genes": _BY_GENE + "SELECT dataset_id, seq_ord, sequence_id, gene_ord, gene, round(omega, 9) AS omega FROM worst",
    "selection_pooled_genes": _BY_GENE
    + ", total AS (SELECT dataset_id, sum(n_codons)::BIGINT AS n_codons, sum(s_sites) AS s_sites, sum(n_sites) AS n_sites, sum(s_diff) AS s_diff, sum(n_diff) AS n_diff FROM worst GROUP BY ALL), "
    + Q._omega("worst", "dataset_id").replace("count(*) AS n_codons", "sum(n_codons)::BIGINT AS n_codons").replace("count(*) * 3 - sum(s_sites) AS n_sites", "sum(n_sites) AS n_sites").replace("cs AS", "ws AS").replace("FROM cs)", "FROM ws)")
    .replace("c1", "w1").replace("c2", "w2").replace("c3", "w3").replace("c4", "w4").replace("c5", "w5").replace("sel AS", "wsel AS")
    + f"SELECT dataset_id, {_SELECTED}, verdict FROM wsel",
    "adaptation_by_gene": Q._AL + Q._CODE + _GENES
    + """, gc AS (SELECT dataset_id, seq_ord, sequence_id, gene_ord, unnest(list_transform(range(length(seq) // 3), lambda i: translate(substr(seq, 3 * i + 1, 3), 'U', 'T'))) AS codon FROM cds),
pg AS (SELECT dataset_id, seq_ord, sequence_id, gene_ord, exp(avg(ln(weight))) AS cai FROM gc JOIN usage USING (dataset_id, codon) WHERE codon NOT IN ('ATG','TGG') GROUP BY ALL)
SELECT dataset_id, seq_ord, sequence_id, round(avg(cai), 9) AS cai, count(*) AS n_genes FROM pg GROUP BY ALL""",
    # The normal integral by Simpson's rule on 400 steps.
    "selection_test": Q._AL + Q._SEL + Q._omega("cj", "dataset_id, seq_ord, sequence_id")
    + """SELECT dataset_id, seq_ord, sequence_id, round(z, 6) AS z,
  round(CASE WHEN z IS NOT NULL THEN greatest(0, 1 - sqrt(2 / pi()) * least(abs(z), 8) / 1200 * list_sum(list_transform(range(401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((least(abs(z), 8) * i / 400) ^ 2) / 2)))) END, 6) AS p_value, verdict FROM sel""",
    "signature_test": Q._PAIR
    + f""", c AS (SELECT *, lag(a) OVER (PARTITION BY dataset_id, seq_ord ORDER BY pos) AS pa FROM z), f AS (SELECT * FROM c WHERE pa IN ('A','C','G','T') AND a IN ('A','C') AND b IN ('A','C','G','T')),
s AS (
  SELECT dataset_id, seq_ord, sequence_id, 'ct' AS signature, count(*) FILTER (a = 'C' AND pa = 'T' AND b = 'T') AS hits, count(*) FILTER (a = 'C' AND pa = 'T') AS sites, count(*) FILTER (a = 'C' AND pa <> 'T' AND b = 'T') AS other_hits, count(*) FILTER (a = 'C' AND pa <> 'T') AS other_sites FROM f GROUP BY ALL
  UNION ALL SELECT dataset_id, seq_ord, sequence_id, 'ag', count(*) FILTER (a = 'A' AND pa IN ('T','A') AND b = 'G'), count(*) FILTER (a = 'A' AND pa IN ('T','A')), count(*) FILTER (a = 'A' AND pa IN ('C','G') AND b = 'G'), count(*) FILTER (a = 'A' AND pa IN ('C','G')) FROM f GROUP BY ALL),
h AS (SELECT *, CASE WHEN hits = 0 OR hits = sites OR other_hits = 0 OR other_hits = other_sites THEN 0.5::DOUBLE ELSE 0 END AS half FROM s),
o AS (SELECT *, (hits + half) * (other_sites - other_hits + half) / ((sites - hits + half) * (other_hits + half)) AS odds,
  CASE WHEN hits = 0 OR hits + other_hits = 0 OR hits + other_hits = sites + other_sites THEN 1 ELSE least(1, list_sum(list_transform(range(hits, least(hits + other_hits, sites) + 1), lambda k: CASE WHEN sites - k <= sites + other_sites - hits - other_hits
    THEN exp({_WAYS("(hits + other_hits)", "k")} + {_WAYS("(sites + other_sites - hits - other_hits)", "(sites - k)")} - {_WAYS("(sites + other_sites)", "sites")}) ELSE 0 END))) END AS p FROM h)
SELECT dataset_id, seq_ord, sequence_id, signature, hits, sites, other_hits, other_sites, CASE WHEN sites >= 10 AND other_sites >= 10 THEN round(odds, 7) END AS odds_ratio, CASE WHEN sites >= 10 AND other_sites >= 10 THEN round(p, 7) END AS p_value,
  CASE WHEN sites >= 10 AND other_sites >= 10 THEN p < 0.05::DOUBLE AND odds > 1 END AS significant FROM o""",
    "index_bands": _BANDS,
    "index_ranges": Q._PAIR + Q._CODE + _EACH + "SELECT dataset_id, key, count(v) AS n, round(avg(v), 7) AS mean, round(min(v), 7) AS least, round(max(v), 7) AS most FROM each WHERE v IS NOT NULL GROUP BY ALL",
    "per_sequence": Q._PAIR + Q._CODE + Q._SEL + Q._omega("cj", "dataset_id, seq_ord, sequence_id") + _EACH
    + """, w AS (SELECT dataset_id, seq_ord, max(v) FILTER (key = 'GD') AS gd, max(v) FILTER (key = 'MB') AS mb, max(v) FILTER (key = 'GC_Deviation') AS gc_deviation, max(v) FILTER (key = 'CAI') AS cai FROM each GROUP BY ALL)
SELECT q.dataset_id, q.seq_ord, q.sequence_id, round(gd, 7) AS gd, w.mb::BIGINT AS mb, round(gc_deviation, 7) AS gc_deviation, round(cai, 7) AS cai, round(omega, 7) AS omega FROM q LEFT JOIN w USING (dataset_id, seq_ord) LEFT JOIN sel ON sel.dataset_id = q.dataset_id AND sel.seq_ord = q.seq_ord""",
    "exclusions": Q._ALL + _GATE
    + f""", has AS (SELECT * FROM gated WHERE value IS NOT NULL AND NOT isnan(value)), want AS (SELECT DISTINCT dataset_id, unnest({list(WEIGHTS)!r}) AS key FROM gated)
SELECT dataset_id, coalesce(excluded, 'not computed') AS cause, string_agg(key, ',' ORDER BY key) AS keys FROM want LEFT JOIN has USING (dataset_id, key) WHERE has.key IS NULL OR excluded IS NOT NULL GROUP BY ALL""",
    "outbreak_age": Q._PAIR + Q._DATED + Q._CLOCK
    + """SELECT b.dataset_id, round(CASE WHEN mu > 0 AND len > 0 THEN burden / (mu * len) * 52.1775::DOUBLE END, 4) AS weeks FROM (SELECT dataset_id, avg(substitutions + indels) AS burden FROM mb GROUP BY ALL) b JOIN cf USING (dataset_id) JOIN (SELECT dataset_id, max(length(seq)) AS len FROM al GROUP BY ALL) USING (dataset_id)""",
    "dataset_summary": Q._AL + Q._DATED
    + "SELECT dataset_id, count(*) AS n_sequences, max(length(seq))::INT AS length, arg_min(sequence_id, seq_ord) AS reference_id, count(collected) AS n_dated, strftime(min(collected), '%Y-%m-%d') AS first_date, strftime(max(collected), '%Y-%m-%d') AS last_date FROM dated GROUP BY dataset_id",
    "substitution_counts": Q._SITES
    + """, b4 AS (SELECT DISTINCT dataset_id, pos, b.base FROM cnt, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) WHERE cnt.base IN ('A','C','G','T')),
full4 AS (SELECT b4.*, coalesce(n, 0) AS n FROM b4 LEFT JOIN cnt USING (dataset_id, pos, base))
SELECT x.dataset_id, x.base AS a, y.base AS b, sum(CASE WHEN x.base = y.base THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END)::BIGINT AS n_pairs FROM full4 x JOIN full4 y ON x.dataset_id = y.dataset_id AND x.pos = y.pos AND x.base <= y.base GROUP BY ALL""",
    "base_composition": Q._SITES
    + "SELECT d.dataset_id, b.base, round((count(site.base) + 0.5::DOUBLE) / sum(count(site.base) + 0.5::DOUBLE) OVER (PARTITION BY d.dataset_id), 9) AS share FROM (SELECT DISTINCT dataset_id FROM al) d CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base) LEFT JOIN site ON site.dataset_id = d.dataset_id AND site.base = b.base GROUP BY d.dataset_id, b.base",
    "codon_frequencies": Q._SITES + Q._F3X4
    + f""", code AS {Q._values(genetic_code.code_rows(), "codon, amino_acid")},
cp3 AS (SELECT x.dataset_id, codon, x.share * y.share * z.share AS p FROM code JOIN f3 x ON x.codon_position = 1 AND x.base = substr(codon, 1, 1) JOIN f3 y ON y.dataset_id = x.dataset_id AND y.codon_position = 2 AND y.base = substr(codon, 2, 1)
  JOIN f3 z ON z.dataset_id = x.dataset_id AND z.codon_position = 3 AND z.base = substr(codon, 3, 1) WHERE amino_acid <> '*')
SELECT dataset_id, codon, round(p / sum(p) OVER (PARTITION BY dataset_id), 9) AS share FROM cp3""",
    "fasta_counts": """WITH r AS (SELECT dataset_id AS source, split_part(split_part(sequence_id || ' x', ' ', 1), chr(9), 1) AS id, upper(seq) AS s FROM sequences),
g AS (SELECT *, regexp_full_match(s, '[ACGTURYWSKMBDHVN.?-]+') AS fits FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY source, id, fits) AS nth FROM g)
SELECT source, CASE WHEN id = '' THEN 'empty id' WHEN coalesce(s, '') = '' THEN 'empty sequence' WHEN NOT fits THEN 'invalid letters' WHEN nth > 1 THEN 'repeated id' ELSE 'loaded' END AS reason, count(*) AS n FROM n GROUP BY ALL""",
    "header_fields": """WITH h AS (SELECT row_id, concat_ws('|', coalesce(sequence_id, ''), coalesce(location, ''), coalesce(host, ''), coalesce(collection_date, '')) AS h FROM metadata),
p AS (
  SELECT row_id, list_filter(list_transform(regexp_extract_all(h, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: try_cast(x AS DATE)), lambda x: x IS NOT NULL)[1] AS day,
    try_cast(nullif(regexp_extract(h, '(^|[^0-9])((19|20)[0-9]{2})($|[^0-9])', 2), '') || '-01-01' AS DATE) AS y, string_split(h, '|') AS f FROM h),
q AS (SELECT *, len(f) = 4 AND list_bool_and(list_transform(f, lambda x: trim(x, ' ') <> '')) AND regexp_matches(f[4], '[0-9]{4}') AS fits FROM p)
SELECT row_id, strftime(coalesce(day, y + date_diff('day', y, (y + INTERVAL 1 YEAR)::DATE)::INT // 2)::DATE, '%Y-%m-%d') AS day, day IS NULL AND y IS NOT NULL AS by_year, CASE WHEN fits THEN trim(f[2], ' ') END AS location, CASE WHEN fits THEN trim(f[3], ' ') END AS host FROM q""",
    "summary_fit": "WITH one AS (SELECT 1)"
    + Q._composite("SELECT row_id::VARCHAR AS dataset_id, 'mu' AS key, try_cast(mu AS DOUBLE) AS value FROM all_pathogens_summary UNION ALL SELECT row_id::VARCHAR, 'MB', mb FROM all_pathogens_summary UNION ALL SELECT row_id::VARCHAR, 'GC_Deviation', gc FROM all_pathogens_summary")
    + """, t AS (SELECT load_id, row_id::VARCHAR AS dataset_id, try_cast(gvi AS DOUBLE) AS stored FROM all_pathogens_summary), e AS (SELECT load_id, gvi.gvi - stored AS gap FROM t JOIN gvi USING (dataset_id))
SELECT load_id, count(*) AS n, round(sum(gap * gap), 6) AS sse, round(sqrt(avg(gap * gap)), 6) AS rmse FROM e WHERE gap IS NOT NULL AND NOT isnan(gap) GROUP BY ALL""",
}

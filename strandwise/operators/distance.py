"""Distances, mutation burden and base composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import nucleotides as N
from strandwise.functions.statistics import hypergeometric_tail
from strandwise.operators.alignment import queries_beside_reference


def genetic_distance(alignment: DataFrame) -> DataFrame:
    """Per query: comparable columns, differences, transitions, transversions, p, JC69 and K80 distance to the reference.

    Columns count where both have a base.  Without any, the distances are null.  Saturated ones keep p.
    """
    states = queries_beside_reference(alignment).select("dataset_id", "seq_ord", "sequence_id", N.pair_states(F.col("ref"), F.col("seq")).alias("st"))
    c = states.select("dataset_id", "seq_ord", "sequence_id", N.count_of(F.col("st"), "=sv").alias("comparable"), N.count_of(F.col("st"), "s").alias("transitions"), N.count_of(F.col("st"), "v").alias("transversions"))
    some = F.when(F.col("comparable") > 0, F.col("comparable"))
    c = c.withColumn("p", (F.col("transitions") + F.col("transversions")) / some)
    return c.withColumn("jc69", N.jukes_cantor(F.col("p"))).withColumn("k80", N.kimura(F.col("transitions") / some, F.col("transversions") / some)).withColumn("saturated", 1 - F.col("p") * 4 / 3 <= 0)


def mutation_burden(alignment: DataFrame) -> DataFrame:
    """Per query: substitutions, and runs of adjacent columns with a gap on one side only, each run one event."""
    st = queries_beside_reference(alignment).select("dataset_id", "seq_ord", "sequence_id", N.pair_states(F.col("ref"), F.col("seq")).alias("st"))
    runs = F.regexp_replace(F.regexp_replace("st", "I+", "I"), "D+", "D")
    return st.select("dataset_id", "seq_ord", "sequence_id", N.count_of(F.col("st"), "sv").alias("substitutions"), N.count_of(runs, "ID").alias("indels")).withColumn("burden", F.col("substitutions") + F.col("indels"))


def gc_content(alignment: DataFrame) -> DataFrame:
    """Per query: GC percent of its bases and the absolute deviation from the reference's; null without bases."""
    percent = lambda c: N.count_of(F.col(c), "GC") * 100.0 / F.when(N.count_of(F.col(c), "ACGT") > 0, N.count_of(F.col(c), "ACGT"))
    return queries_beside_reference(alignment).select("dataset_id", "seq_ord", "sequence_id", percent("seq").alias("gc"), F.abs(percent("seq") - percent("ref")).alias("gc_deviation"))


def context_counts(alignment: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: sites and mutations C>T after T and after others, A>G after T or A and after others, by the reference base before."""
    letters = queries_beside_reference(alignment).select(*keys, N.letters(F.col("ref")).alias("r"), N.letters(F.col("seq")).alias("q"))
    # Each column beside the reference base before it; the first has none.
    before = F.concat(F.array(F.lit("")), F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0))))
    at = F.filter(F.arrays_zip(before.alias("before"), F.col("r").alias("r"), F.col("q").alias("q")), lambda s: s["before"].isin(*N.BASES) & s["r"].isin("A", "C") & s["q"].isin(*N.BASES))
    long = letters.select(*keys, F.explode(at).alias("s")).select(*keys, F.col("s.before").alias("before"), F.col("s.r").alias("r"), F.col("s.q").alias("q"))
    return long.groupBy(*keys).agg(
        F.count_if((F.col("r") == "C") & (F.col("before") == "T")).alias("c_after_t"), F.count_if((F.col("r") == "C") & (F.col("before") == "T") & (F.col("q") == "T")).alias("ct_after_t"),
        F.count_if(F.col("r") == "C").alias("c_sites"), F.count_if((F.col("r") == "C") & (F.col("q") == "T")).alias("ct_sites"),
        F.count_if((F.col("r") == "A") & F.col("before").isin("T", "A")).alias("a_after_ta"), F.count_if((F.col("r") == "A") & F.col("before").isin("T", "A") & (F.col("q") == "G")).alias("ag_after_ta"),
        F.count_if(F.col("r") == "A").alias("a_sites"), F.count_if((F.col("r") == "A") & (F.col("q") == "G")).alias("ag_sites"),
    )


def mutation_signatures(alignment: DataFrame) -> DataFrame:
    """``context_counts`` of each dataset."""
    return context_counts(alignment, ["dataset_id"])


#: Sites that either context needs, and the level of the test.
LEAST_SITES, SIGNIFICANCE = 10, 0.05


def signature_tests(counts: DataFrame) -> DataFrame:
    """``context_counts`` as one row per key and signature (``ct`` or ``ag``): hits and sites in the context and elsewhere, odds ratio, one-sided p, significant.

    Fisher's exact test of more hits in the context.  Odds get half a hit in every cell where one is empty.  Fewer than 10
    sites in either context are inconclusive: null odds, p and verdict.
    """
    keys = [c for c in counts.columns if c not in ("c_after_t", "ct_after_t", "c_sites", "ct_sites", "a_after_ta", "ag_after_ta", "a_sites", "ag_sites")]
    one = lambda name, sites, hits, total, all_hits: F.struct(F.lit(name).alias("signature"), F.col(hits).alias("a"), F.col(sites).alias("n"), (F.col(all_hits) - F.col(hits)).alias("c"), (F.col(total) - F.col(sites)).alias("m"))
    rows = counts.select(*keys, F.explode(F.array(one("ct", "c_after_t", "ct_after_t", "c_sites", "ct_sites"), one("ag", "a_after_ta", "ag_after_ta", "a_sites", "ag_sites"))).alias("x")).select(*keys, "x.*")
    a, b, c, d = F.col("a"), F.col("n") - F.col("a"), F.col("c"), F.col("m") - F.col("c")
    half = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    fit = (F.col("n") >= LEAST_SITES) & (F.col("m") >= LEAST_SITES)
    mixed = (a + c > 0) & (b + d > 0)
    p = F.when(mixed, hypergeometric_tail(a, F.col("n"), a + c, F.col("n") + F.col("m"))).otherwise(1.0)
    tested = rows.withColumn("odds_ratio", F.when(fit, (a + half) * (d + half) / ((b + half) * (c + half)))).withColumn("p_value", F.when(fit, p))
    return tested.select(*keys, "signature", F.col("a").alias("hits"), F.col("n").alias("sites"), F.col("c").alias("other_hits"), F.col("m").alias("other_sites"), "odds_ratio", "p_value", ((F.col("p_value") < SIGNIFICANCE) & (F.col("odds_ratio") > 1)).alias("significant"))


def substitution_counts(sites: DataFrame) -> DataFrame:
    """(dataset_id, a, b, n_pairs): over all pairs of records and columns, how often bases a <= b meet, from the counts of ``site_counts``."""
    bases = sites.where(F.col("base").isin(*N.BASES))
    wide = bases.groupBy("dataset_id", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(b) for b in N.BASES])
    pairs = [(x, y) for i, x in enumerate(N.BASES) for y in N.BASES[i:]]
    each = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), (F.col(x) * (F.col(x) - 1) / 2 if x == y else F.col(x) * F.col(y)).cast("bigint").alias("n")) for x, y in pairs])
    return wide.select("dataset_id", F.explode(each).alias("x")).groupBy("dataset_id", "x.a", "x.b").agg(F.sum("x.n").alias("n_pairs"))


def base_composition(sites: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """(dataset_id, base, share): base frequencies over all records, each base counted ``pseudo`` more."""
    wide = sites.groupBy("dataset_id").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).alias(b) for b in N.BASES])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T") + 4 * pseudo
    return wide.select("dataset_id", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), ((F.col(b) + pseudo) / total).alias("share")) for b in N.BASES])).alias("x")).select("dataset_id", "x.*")


#: Fixed value: weeks of a year.
WEEKS = 52.1775


def outbreak_age(burden: DataFrame, clock: DataFrame, lengths: DataFrame) -> DataFrame:
    """(dataset_id, weeks): the time that the mean burden takes at the clock's rate over the alignment's length; null without a positive rate and length."""
    both = burden.groupBy("dataset_id").agg(F.avg("burden").alias("burden")).join(clock.select("dataset_id", "mu"), "dataset_id").join(lengths.select("dataset_id", "length"), "dataset_id")
    return both.select("dataset_id", F.when((F.col("mu") > 0) & (F.col("length") > 0), F.col("burden") / (F.col("mu") * F.col("length")) * WEEKS).alias("weeks"))

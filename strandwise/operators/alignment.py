"""Alignments: which records they hold, their columns, and each query beside its reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import nucleotides as N


def current_alignment(sequences: DataFrame) -> DataFrame:
    """(dataset_id, seq_ord, sequence_id, seq) of the live records: the latest delivery of each place that is not deleted, in capitals."""
    live = sequences.where(F.col("deleted_at").isNull() & F.col("dataset_id").isNotNull() & F.col("seq_ord").isNotNull() & (F.length("seq") > 0))
    latest = F.max(F.struct("loaded_at", "sequence_id", "seq")).alias("r")
    return live.groupBy("dataset_id", "seq_ord").agg(latest).select("dataset_id", "seq_ord", "r.sequence_id", F.upper("r.seq").alias("seq"))


def references(alignment: DataFrame) -> DataFrame:
    """(dataset_id, ref_id, ref): the first record of each alignment."""
    return alignment.groupBy("dataset_id").agg(F.min(F.struct("seq_ord", "sequence_id", "seq")).alias("r")).select("dataset_id", F.col("r.seq_ord").alias("ref_ord"), F.col("r.sequence_id").alias("ref_id"), F.col("r.seq").alias("ref"))


def queries_beside_reference(alignment: DataFrame) -> DataFrame:
    """Every record but the reference with ``ref`` beside it; other columns are left out.

    The other side is one row per dataset; a dataset with a third of all records is split by Spark's skew join.
    """
    refs = references(alignment)
    return alignment.select("dataset_id", "seq_ord", "sequence_id", "seq").join(refs, "dataset_id").where(F.col("seq_ord") != F.col("ref_ord"))


def alignment_summary(alignment: DataFrame) -> DataFrame:
    """Per dataset: records, length, whether all lengths are equal, reference, gap share."""
    gaps = N.count_of(F.col("seq"), N.GAPS)
    return alignment.groupBy("dataset_id").agg(
        F.count("*").alias("n_sequences"), F.max(F.length("seq")).alias("length"), (F.min(F.length("seq")) == F.max(F.length("seq"))).alias("equal_length"),
        F.min(F.struct("seq_ord", "sequence_id")).getField("sequence_id").alias("reference_id"), (F.sum(gaps) / F.sum(F.length("seq"))).alias("gap_fraction"),
    )


def site_counts(alignment: DataFrame) -> DataFrame:
    """(dataset_id, pos, base, n), positions from 0; added up in each task before they are exchanged."""
    return alignment.select("dataset_id", F.posexplode(N.letters(F.col("seq"))).alias("pos", "base")).groupBy("dataset_id", "pos", "base").agg(F.count("*").alias("n"))


def site_profile(alignment: DataFrame) -> DataFrame:
    """Per dataset and column: distinct bases, count of the rarest, gaps, whether all records have a base, kind of variation."""
    is_base = F.col("base").isin(*N.BASES)
    alleles = F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("base")))), "")
    per = site_counts(alignment).groupBy("dataset_id", "pos").agg(
        F.count(F.when(is_base, 1)).alias("n_alleles"), F.min(F.when(is_base, F.col("n"))).alias("rarest"), F.coalesce(F.sum(F.when(F.col("base").isin(*N.GAPS), F.col("n"))), F.lit(0)).alias("n_gaps"),
        F.coalesce(F.sum(F.when(~is_base, F.col("n"))), F.lit(0)).alias("n_other"), alleles.alias("alleles"),
    )
    kind = F.when(F.col("n_alleles") < 2, None).when(F.col("alleles").isin("AG", "CT"), "transition").otherwise("transversion")
    informative = (F.col("n_alleles") == 2) & (F.col("rarest") >= 2) & (F.col("n_gaps") == 0)
    return per.withColumn("kind", kind).withColumn("informative", informative)


def site_summary(alignment: DataFrame) -> DataFrame:
    """Per dataset: variable, informative, gap-free and fully covered columns, transitions and transversions, longest gap-free block.

    A block's columns share (position - number of gap-free columns up to it); the window runs over a dataset's columns, not its records.
    """
    sites = site_profile(alignment)
    free = sites.where("n_gaps = 0").withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("dataset_id").orderBy("pos")))
    blocks = free.groupBy("dataset_id", "island").agg(F.count("*").alias("n")).groupBy("dataset_id").agg(F.max("n").alias("longest_block"))
    totals = sites.groupBy("dataset_id").agg(
        F.count("*").alias("n_columns"), F.count_if(F.col("n_alleles") > 1).alias("n_variable"), F.count_if("informative").alias("n_informative"), F.count_if(F.col("n_gaps") == 0).alias("n_gap_free"),
        F.count_if(F.col("n_other") == 0).alias("n_covered"), F.count_if(F.col("kind") == "transition").alias("n_transition"), F.count_if(F.col("kind") == "transversion").alias("n_transversion"),
    )
    return totals.join(blocks, "dataset_id", "left").withColumn("longest_block", F.coalesce("longest_block", F.lit(0)))


def trimmed(alignment: DataFrame, minimum: int = 100) -> DataFrame:
    """The alignment without the columns in which any record has a gap; datasets with fewer than ``minimum`` columns left are left out."""
    free = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("n_gaps") == 0).alias("free")))), lambda x: x["free"])
    keep = site_profile(alignment).groupBy("dataset_id").agg(free.alias("free"), F.count_if(F.col("n_gaps") == 0).alias("n_free")).where(F.col("n_free") >= minimum)
    chars = F.filter(F.zip_with(N.letters(F.col("seq")), "free", lambda c, k: F.when(k, c)), lambda c: c.isNotNull())
    return alignment.join(keep, "dataset_id").select("dataset_id", "seq_ord", "sequence_id", F.array_join(chars, "").alias("seq"))


def dataset_summary(alignment: DataFrame, dated: DataFrame) -> DataFrame:
    """(dataset_id, n_sequences, length, reference_id, n_dated, first_date, last_date)."""
    dates = dated.groupBy("dataset_id").agg(F.count("collected").alias("n_dated"), F.min("collected").alias("first_date"), F.max("collected").alias("last_date"))
    return alignment_summary(alignment).select("dataset_id", "n_sequences", "length", "reference_id").join(dates, "dataset_id")

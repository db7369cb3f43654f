"""Genes of alignments: where they come from, their coding sequences, and what is worked out per gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import genetic_code
from strandwise.functions import nucleotides as N
from strandwise.operators import codons as C
from strandwise.operators.alignment import queries_beside_reference, references, site_profile

#: Codons of a candidate, of a candidate to train on, candidates to train on, share of the longest that counts where there is nothing to train on.
LEAST_CODONS, TRAINING_CODONS, TRAINING_GENES, RELATIVE_LENGTH = 30, 90, 3, 0.3
WHOLE = "whole_genome"


def coding_sequence(sequence: Column, start: Column, end: Column, strand: Column) -> Column:
    """The stretch from ``start`` to ``end`` (1-based, ends included), turned round on the minus strand; null if it leaves the sequence."""
    cut = F.substring(sequence, start.cast("int"), (end - start + 1).cast("int"))
    return F.when((start >= 1) & (end <= F.length(sequence)), F.when(strand == "-", N.reverse_complement(cut)).otherwise(cut))


def gene_candidates(alignment: DataFrame, minimum: int = LEAST_CODONS) -> DataFrame:
    """(dataset_id, gene, start, end, strand, n_codons, cds): reading frames of each dataset's first record, in the alignment's columns."""
    refs = references(alignment)
    first = refs.select("dataset_id", F.col("ref_id").alias("sequence_id"), F.col("ref").alias("seq"))
    found = C.open_reading_frames(first, minimum, gapless=False).withColumnRenamed("codons", "n_codons")
    order = Window.partitionBy("dataset_id", "strand", "frame").orderBy(F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("end")))
    name = F.concat(F.when(F.col("strand") == "+", "orf_fwd").otherwise("orf_rev"), F.col("frame").cast("string"), F.lit("_"), F.row_number().over(order).cast("string"))
    named = found.withColumn("gene", name).join(refs.select("dataset_id", "ref"), "dataset_id")
    return named.select("dataset_id", "gene", "start", "end", "strand", "n_codons", coding_sequence(F.col("ref"), F.col("start"), F.col("end"), F.col("strand")).alias("cds"))


def predicted_genes(alignment: DataFrame, minimum: int = LEAST_CODONS) -> DataFrame:
    """(dataset_id, gene, start, end, strand, log_odds): candidates that read like genes of their own genome.

    Where at least three candidates have 90 codons or more, these train the codon frequencies (one added to each of the 61), and a candidate counts if the
    mean log ratio of its inner codons against the product of base frequencies is above 0; if none does, the best counts.  With
    less to train on, those of at least 0.3 times the longest count, and their log_odds is null.
    """
    spark = alignment.sparkSession
    sense = genetic_code.code_table(spark).where("amino_acid <> '*'").select("codon")  # 61 rows
    candidates = gene_candidates(alignment, minimum)
    size = candidates.groupBy("dataset_id").agg(F.count_if(F.col("n_codons") >= TRAINING_CODONS).alias("n_training"), F.max("n_codons").alias("longest"))
    all_codons = N.codons(F.col("cds"))
    inner = candidates.select("dataset_id", "gene", "n_codons", F.explode(F.slice(all_codons, F.lit(2), F.greatest(F.size(all_codons) - 2, F.lit(0)))).alias("codon")).join(sense, "codon")
    counted = inner.where(F.col("n_codons") >= TRAINING_CODONS).groupBy("dataset_id", "codon").agg(F.count("*").alias("n"))
    totals = counted.groupBy("dataset_id").agg(F.sum("n").alias("total"))
    refs = references(alignment).select("dataset_id", *[N.count_of(F.col("ref"), b).alias(b) for b in N.BASES])
    bases = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    share = lambda x: F.when(x == "A", F.col("A")).when(x == "C", F.col("C")).when(x == "G", F.col("G")).otherwise(F.col("T"))
    chance = lambda i: (share(F.substring("codon", i, 1)) + 1.0) / (bases + 4.0)
    scored = inner.join(counted, ["dataset_id", "codon"], "left").join(totals, "dataset_id").join(refs, "dataset_id")
    ratio = F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("total") + 61.0) / (chance(1) * chance(2) * chance(3)))
    odds = scored.groupBy("dataset_id", "gene").agg(F.avg(ratio).alias("log_odds"))
    judged = candidates.join(size, "dataset_id").join(odds, ["dataset_id", "gene"], "left").withColumn("trained", F.col("n_training") >= TRAINING_GENES)
    judged = judged.withColumn("log_odds", F.when(F.col("trained"), F.coalesce("log_odds", F.lit(float("-inf")))))
    best = judged.groupBy("dataset_id").agg(F.max("log_odds").alias("top"), F.max_by("gene", F.struct("log_odds", "n_codons", "strand", -F.col("start"))).alias("best"))
    keep = F.when(F.col("trained"), F.when(F.col("top") > 0, F.col("log_odds") > 0).otherwise(F.col("gene") == F.col("best"))).otherwise(F.col("n_codons") >= F.col("longest") * RELATIVE_LENGTH)
    return judged.join(best, "dataset_id").where(keep).select("dataset_id", "gene", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "strand", "log_odds")


def gene_table(alignment: DataFrame, given: DataFrame | None = None, minimum: int = LEAST_CODONS) -> DataFrame:
    """(dataset_id, gene_ord, gene, start, end, strand, origin): given genes where a dataset has any, else predicted ones, else the whole sequence.

    Genes count from 0, the longest first; given ones (dataset_id, gene, start, end, strand) in the order of their start.
    """
    cols = ["dataset_id", "gene", "start", "end", "strand"]
    found = predicted_genes(alignment, minimum).select(*cols, F.lit("predicted").alias("origin"))
    if given is not None:
        own = given.select("dataset_id", "gene", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "strand", F.lit("given").alias("origin"))
        found = own.unionByName(found.join(own.select("dataset_id").distinct(), "dataset_id", "left_anti"))
    whole = references(alignment).select("dataset_id", F.lit(WHOLE).alias("gene"), F.lit(1).cast("bigint").alias("start"), F.length("ref").cast("bigint").alias("end"), F.lit("+").alias("strand"), F.lit("whole").alias("origin"))
    genes = found.unionByName(whole.join(found.select("dataset_id").distinct(), "dataset_id", "left_anti"))
    order = Window.partitionBy("dataset_id").orderBy(F.when(F.col("origin") == "given", F.col("start")).otherwise(F.col("start") - F.col("end")), "start", "end", "strand", "gene")
    return genes.select("dataset_id", (F.row_number().over(order) - 1).alias("gene_ord"), "gene", "start", "end", "strand", "origin")


def trimmed_genes(alignment: DataFrame, genes: DataFrame) -> DataFrame:
    """(dataset_id, gene_ord, gene, new_start, new_end, strand): genes in the columns that are left when columns with gaps are trimmed.

    A gene goes from its first to its last column that is left; one without any is left out.
    """
    kept = site_profile(alignment).where("n_gaps = 0").groupBy("dataset_id").agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    before = F.size(F.filter("kept", lambda p: p < F.col("start") - 1))
    inside = F.size(F.filter("kept", lambda p: p.between(F.col("start") - 1, F.col("end") - 1)))
    return genes.join(kept, "dataset_id").where(inside > 0).select("dataset_id", "gene_ord", "gene", (before + 1).cast("bigint").alias("new_start"), (before + inside).cast("bigint").alias("new_end"), "strand")


def gene_cds(alignment: DataFrame, genes: DataFrame) -> DataFrame:
    """(dataset_id, seq_ord, sequence_id, gene_ord, gene, ref, seq): each query's coding sequence of each gene beside the reference's.

    Both are null where the gene leaves the sequence.  Genes of a dataset are few; records meet them by dataset.
    """
    cut = lambda c: coding_sequence(F.col(c), F.col("start"), F.col("end"), F.col("strand")).alias(c)
    return queries_beside_reference(alignment).join(genes.select("dataset_id", "gene_ord", "gene", "start", "end", "strand"), "dataset_id").select("dataset_id", "seq_ord", "sequence_id", "gene_ord", "gene", cut("ref"), cut("seq"))


def selection_by_gene(alignment: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per query and gene: sites, differences, omega and verdict; pairs without a comparable codon are left out."""
    cds = gene_cds(alignment, genes).where("ref is not null and seq is not null")
    return C.selection(C.counted_pairs(cds, ["dataset_id", "seq_ord", "sequence_id", "gene_ord", "gene"]))


def worst_genes(by_gene: DataFrame) -> DataFrame:
    """Of each query the gene with the largest omega, the first of equal ones; null omega is the least."""
    rank = F.struct(F.col("omega").isNotNull(), "omega", -F.col("gene_ord"))
    rest = [c for c in by_gene.columns if c not in ("dataset_id", "seq_ord", "sequence_id")]
    top = by_gene.groupBy("dataset_id", "seq_ord", "sequence_id").agg(F.max_by(F.struct(*rest), rank).alias("g"))
    return top.select("dataset_id", "seq_ord", "sequence_id", "g.*")


def adaptation_by_gene(alignment: DataFrame, genes: DataFrame, usage: DataFrame) -> DataFrame:
    """(dataset_id, seq_ord, sequence_id, cai, n_genes): the mean over genes of the codon adaptation to ``usage`` (dataset_id, codon, weight)."""
    cds = gene_cds(alignment, genes).where("seq is not null")
    rows = cds.select("dataset_id", "seq_ord", "sequence_id", "gene_ord", F.explode(N.codons(F.col("seq"))).alias("codon")).withColumn("codon", F.translate("codon", "U", "T")).where(~F.col("codon").isin(*C.SINGLE))
    per = rows.join(usage.select("dataset_id", "codon", "weight"), ["dataset_id", "codon"]).groupBy("dataset_id", "seq_ord", "sequence_id", "gene_ord").agg(F.exp(F.avg(F.log("weight"))).alias("cai"))
    return per.groupBy("dataset_id", "seq_ord", "sequence_id").agg(F.avg("cai").alias("cai"), F.count("*").alias("n_genes"))

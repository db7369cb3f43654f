"""Codon usage, adaptation, selection and open reading frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import genetic_code
from strandwise.functions import nucleotides as N
from strandwise.functions.statistics import two_tailed
from strandwise.operators.alignment import queries_beside_reference


#: Codons of amino acids that have no other.
SINGLE = ("ATG", "TGG")


def codon_usage(alignment: DataFrame) -> DataFrame:
    """(dataset_id, codon, amino_acid, n, weight): counts in frame 1, and each relative to the commonest synonym, at least 1e-4.

    Stops and codons with other than four bases do not count.
    """
    code = F.broadcast(genetic_code.code_table(alignment.sparkSession))  # 64 rows
    counted = alignment.select("dataset_id", F.explode(N.codons(F.col("seq"))).alias("codon")).select("dataset_id", F.translate("codon", "U", "T").alias("codon")).groupBy("dataset_id", "codon").agg(F.count("*").alias("n")).join(code, "codon").where("amino_acid <> '*'")
    top = F.max("n").over(Window.partitionBy("dataset_id", "amino_acid"))
    return counted.withColumn("weight", F.greatest(F.col("n") / top, F.lit(1e-4)))


#: Fixed value: the least share of a base at a codon position.
FLOOR = 1e-8


def codon_positions(alignment: DataFrame) -> DataFrame:
    """(dataset_id, codon_position, base, share): base frequencies by position in the codon (F3x4), at least 1e-8 before they are scaled to sum to 1.

    All four bases of all three positions come out.  Records shorter than a codon count for nothing.
    """
    letters = alignment.select("dataset_id", F.posexplode(N.letters(F.col("seq"))).alias("pos", "base"), F.length("seq").alias("len")).where(F.col("base").isin(*N.BASES) & (F.col("pos") < F.col("len") - F.col("len") % 3))
    counts = [F.count_if(F.col("base") == b).alias(b) for b in N.BASES]
    wide = letters.groupBy("dataset_id", (F.col("pos") % 3 + 1).alias("codon_position")).agg(*counts)
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    least = [F.greatest(F.col(b) / total, F.lit(FLOOR)).alias(b) for b in N.BASES]
    scaled = wide.select("dataset_id", "codon_position", *least).withColumn("total", total)
    return scaled.select("dataset_id", "codon_position", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), (F.col(b) / F.col("total")).alias("share")) for b in N.BASES])).alias("x")).select("dataset_id", "codon_position", "x.*")


def codon_frequencies(positions: DataFrame) -> DataFrame:
    """(dataset_id, codon, share): of the 61 codons without stops, the product of their bases' shares by position, scaled to sum to 1."""
    wide = positions.groupBy("dataset_id").agg(*[F.max(F.when((F.col("codon_position") == i) & (F.col("base") == b), F.col("share"))).alias(f"{b}{i}") for i in (1, 2, 3) for b in N.BASES])
    at = lambda i: F.when(F.substring("codon", i, 1) == "A", F.col(f"A{i}")).when(F.substring("codon", i, 1) == "C", F.col(f"C{i}")).when(F.substring("codon", i, 1) == "G", F.col(f"G{i}")).otherwise(F.col(f"T{i}"))
    listed = wide.withColumn("codon", F.explode(F.lit(genetic_code.SENSE))).withColumn("p", at(1) * at(2) * at(3))
    totals = listed.groupBy("dataset_id").agg(F.sum("p").alias("total"))
    return listed.join(totals, "dataset_id").select("dataset_id", "codon", (F.col("p") / F.col("total")).alias("share"))


def codon_adaptation(alignment: DataFrame, usage: DataFrame) -> DataFrame:
    """Per query: exp of the mean log weight of its codons; amino acids with one codon and stops do not count.

    ``usage`` has (dataset_id, codon, weight), e.g. of ``codon_usage``, or of a host's table repeated for each dataset.
    """
    rows = queries_beside_reference(alignment).select("dataset_id", "seq_ord", "sequence_id", F.explode(N.codons(F.col("seq"))).alias("codon")).withColumn("codon", F.translate("codon", "U", "T")).where(~F.col("codon").isin(*SINGLE))
    return rows.join(usage.select("dataset_id", "codon", "weight"), ["dataset_id", "codon"]).groupBy("dataset_id", "seq_ord", "sequence_id").agg(F.exp(F.avg(F.log("weight"))).alias("cai"), F.count("*").alias("n_codons"))


def counted_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` of rows with ``ref`` and ``seq``: sites and differences, synonymous and not, by counting in frame 1.

    Codon pairs with a stop or other than four bases are left out.  The 61 x 61 possible pairs are a table made by rule.
    """
    pairs = F.broadcast(genetic_code.pair_table(rows.sparkSession))  # 3721 rows
    both = F.arrays_zip(N.codons(F.col("ref")).alias("ref_codon"), N.codons(F.col("seq")).alias("query_codon"))
    long = rows.select(*keys, F.explode(both).alias("c")).select(*keys, F.col("c.ref_codon").alias("ref_codon"), F.col("c.query_codon").alias("query_codon"))
    return long.join(pairs, ["ref_codon", "query_codon"]).groupBy(*keys).agg(
        F.count("*").alias("n_codons"), F.sum("s_sites").alias("s_sites"), (F.count("*") * 3 - F.sum("s_sites")).alias("n_sites"), F.sum("s_diff").alias("s_diff"), F.sum("n_diff").alias("n_diff")
    )


def selection_counts(alignment: DataFrame) -> DataFrame:
    """``counted_pairs`` of each query against its reference."""
    return counted_pairs(queries_beside_reference(alignment), ["dataset_id", "seq_ord", "sequence_id"])


def _corrected(counts: DataFrame) -> DataFrame:
    safe = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    ps = F.when((F.col("s_diff") == 0) & (F.col("s_sites") > 0), 0.5 / (F.col("s_sites") + 1)).otherwise(safe("s_diff", "s_sites"))
    c = counts.withColumn("ps", ps).withColumn("pn", safe("n_diff", "n_sites"))
    raw = (1 - F.col("ps") * 4 / 3 <= 0) | (1 - F.col("pn") * 4 / 3 <= 0)
    c = c.withColumn("saturated", raw)
    return c.withColumn("ds", F.when(raw, F.col("ps")).otherwise(N.jukes_cantor(F.col("ps")))).withColumn("dn", F.when(raw, F.col("pn")).otherwise(N.jukes_cantor(F.col("pn"))))


def selection(counts: DataFrame) -> DataFrame:
    """``counts`` with dS, dN, omega and the Z test of dN = dS.

    No synonymous difference counts as half a one.  If either share is saturated, both stay uncorrected.  With dS = 0 omega is dN.
    The test is inconclusive without differences of either kind, when saturated, or without variance.
    """
    c = _corrected(counts)
    c = c.withColumn("omega", F.when(F.col("ds") == 0, F.col("dn")).otherwise(F.col("dn") / F.when(F.col("ds") != 0, F.col("ds"))))

    def variance(p: str, n: str) -> Column:
        arg = 1 - F.col(p) * 4 / 3
        return F.col(p) * (1 - F.col(p)) / F.when(F.col(n) > 0, F.col(n) * arg * arg)

    fit = (F.col("s_diff") > 0) & (F.col("n_diff") > 0) & ~F.col("saturated")
    var = F.when(fit, variance("ps", "s_sites") + variance("pn", "n_sites"))
    z = F.when(var > 0, (F.col("dn") - F.col("ds")) / F.sqrt(F.when(var > 0, var)))
    c = c.withColumn("z", z)
    verdict = F.when(F.col("z").isNull(), "inconclusive").when(F.abs("z") <= 1.959963984540054, "neutral").when(F.col("z") > 0, "positive").otherwise("purifying")
    return c.withColumn("verdict", verdict)


def with_p_value(selected: DataFrame) -> DataFrame:
    """``selected`` with the two-tailed p of its Z test; null where the test is inconclusive."""
    return selected.withColumn("p_value", two_tailed(F.col("z")))


def pooled_selection(counts: DataFrame) -> DataFrame:
    """Per dataset: one ratio from the sums over its queries."""
    return selection(counts.groupBy("dataset_id").agg(*[F.sum(x).alias(x) for x in ("n_codons", "s_sites", "n_sites", "s_diff", "n_diff")]))


def selection_windows(alignment: DataFrame, size: int = 30, step: int = 10) -> DataFrame:
    """Per dataset and window of codons (1-based start): pooled sites, differences and omega; windows that do not fit are left out."""
    pairs = F.broadcast(genetic_code.pair_table(alignment.sparkSession))
    both = F.arrays_zip(N.codons(F.col("ref")).alias("ref_codon"), N.codons(F.col("seq")).alias("query_codon"))
    rows = queries_beside_reference(alignment).select("dataset_id", F.size(N.codons(F.col("ref"))).alias("total"), F.posexplode(both).alias("at", "c")).select("dataset_id", "total", "at", F.col("c.ref_codon").alias("ref_codon"), F.col("c.query_codon").alias("query_codon"))
    per = rows.join(pairs, ["ref_codon", "query_codon"]).groupBy("dataset_id", "total", "at").agg(F.count("*").alias("n_codons"), F.sum("s_sites").alias("s_sites"), F.sum("s_diff").alias("s_diff"), F.sum("n_diff").alias("n_diff"))
    first = F.greatest(F.ceil((F.col("at") - size + 1) / step), F.lit(0)).cast("int")
    starts = F.filter(F.transform(F.sequence(first, F.floor(F.col("at") / step).cast("int")), lambda k: k * step), lambda s: s + size <= F.col("total"))
    wins = per.where(F.floor(F.col("at") / step) >= first).withColumn("start", F.explode(starts))
    summed = wins.groupBy("dataset_id", (F.col("start") + 1).alias("start_codon")).agg(*[F.sum(x).alias(x) for x in ("n_codons", "s_sites", "s_diff", "n_diff")])
    return selection(summed.withColumn("n_sites", F.col("n_codons") * 3 - F.col("s_sites")))


def open_reading_frames(records: DataFrame, minimum: int = 30, gapless: bool = True) -> DataFrame:
    """(dataset_id, sequence_id, strand, frame, start, end, codons): the first ATG of each stretch between stops, to the stop, in six frames.

    ``minimum`` counts codons with the stop.  Positions are 1-based on the given strand of the record, ends included.  Gaps are taken
    out first if ``gapless``; else they stay, codons with one being neither starts nor stops, and positions are alignment columns.
    """
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("bare").alias("s")), F.struct(F.lit("-").alias("strand"), N.reverse_complement(F.col("bare")).alias("s")))
    rows = records.select("dataset_id", "sequence_id", (F.regexp_replace("seq", r"[-.?]", "") if gapless else F.col("seq")).alias("bare")).select("dataset_id", "sequence_id", F.length("bare").alias("len"), F.explode(strands).alias("x")).select("dataset_id", "sequence_id", "len", "x.*")
    framed = rows.withColumn("frame", F.explode(F.array(*map(F.lit, range(3))))).withColumn("read", F.translate(F.expr("substring(s, frame + 1)"), "U", "T")).withColumn("c", N.codons(F.col("read")))
    stops = F.filter(F.transform("c", lambda x, i: F.when(x.isin("TAA", "TAG", "TGA"), i)), lambda i: i.isNotNull())
    starts = F.filter(F.transform("c", lambda x, i: F.when(x == "ATG", i)), lambda i: i.isNotNull())
    found = framed.withColumn("stops", stops).withColumn("starts", starts).select("*", F.posexplode("stops").alias("k", "stop"))
    found = found.withColumn("after", F.coalesce(F.get("stops", F.col("k") - 1), F.lit(-1)))
    found = found.withColumn("first", F.array_min(F.filter("starts", lambda i: (i > F.col("after")) & (i < F.col("stop"))))).where(F.col("stop") - F.col("first") + 1 >= minimum)
    a, b = F.col("frame") + F.col("first") * 3 + 1, F.col("frame") + F.col("stop") * 3 + 3
    plus = F.col("strand") == "+"
    return found.select("dataset_id", "sequence_id", "strand", "frame", F.when(plus, a).otherwise(F.col("len") - b + 1).alias("start"), F.when(plus, b).otherwise(F.col("len") - a + 1).alias("end"), (F.col("stop") - F.col("first") + 1).alias("codons"))

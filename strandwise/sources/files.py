"""Readers of the text formats: each gives the rows that load and, beside them, the records that do not, with the reason.

All read with Spark's splittable text or CSV sources; nothing is inferred and no file passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import genetic_code
from strandwise.functions import nucleotides as N
from strandwise.functions.bands import KEYS, RAW_WEIGHTS

LETTERS = r"\A[ACGTURYWSKMBDHVNacgturywskmbdhvn.?-]+\z"


def _split(df: DataFrame, reason: Column, keep: list[str], source: str, record: str) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").select(*keep), judged.where("reason is not null").select(F.col(source).alias("source"), F.col(record).alias("record"), "reason")


def read_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source, block, at, id, header, seq) of the records of FASTA files, and what was skipped.

    (block, at) orders the records of a file; its first record is the default reference.  The id is the header up to the first space or tab.
    Text before the first ">" , records without sequence or with other letters, and all but the first record of an id are skipped.
    An empty id is an error for its record.  Sequences come out in capitals.
    """
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))


def parse_fasta(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_fasta`` of text that is at hand: (source, block, at, value), one record per value without its ">", but for the first of block 0."""
    top = raw.where("block = 0").groupBy("source").agg(F.min("at").alias("top"))
    rows = raw.join(top, "source", "left").withColumn("is_top", (F.col("block") == 0) & (F.col("at") == F.col("top")))
    head_free = F.col("is_top") & ~F.col("value").startswith(">")
    text = F.when(F.col("is_top"), F.regexp_replace("value", r"\A>", "")).otherwise(F.col("value"))
    header = F.regexp_replace(F.element_at(F.split(text, "\n", 2), 1), r"\r\z", "")
    body = F.upper(F.regexp_replace(F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit("")), r"\s", ""))
    parsed = rows.select("source", "block", "at", "value", head_free.alias("loose"), header.alias("header"), body.alias("seq")).withColumn("id", F.element_at(F.split("header", r"[ \t]"), 1)).where("not (loose and trim(value) = '')")

    nth = F.row_number().over(Window.partitionBy("source", "id", F.col("seq").rlike(LETTERS)).orderBy("block", "at"))
    parsed = parsed.withColumn("nth", nth)
    reason = F.when(F.col("loose"), "before the first header").when(F.col("id") == "", "empty id").when(F.col("seq") == "", "empty sequence").when(~F.col("seq").rlike(LETTERS), "invalid letters").when(F.col("nth") > 1, "repeated id")
    return _split(parsed, reason, ["source", "block", "at", "id", "header", "seq"], "source", "header")


def header_fields(header: Column) -> tuple[Column, Column, Column, Column]:
    """(date, is it only a year?, location, host) of a FASTA header.

    The date is the first valid ISO date anywhere, else the first year 19xx or 20xx that stands alone (mid-year).
    Location and host come from ``acc|location|host|date`` with four fields, none blank and the last like a date.
    """
    days = F.filter(F.transform(F.regexp_extract_all(header, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda x: x.isNotNull())
    day = F.get(days, F.lit(0))
    years = F.regexp_extract_all(header, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1)
    year, _ = N.partial_date(F.get(years, F.lit(0)))
    fields = F.split(header, r"\|", -1)
    fits = (F.size(fields) == 4) & F.forall(fields, lambda x: F.btrim(x) != "") & F.get(fields, F.lit(3)).rlike(r"\d{4}")
    return F.coalesce(day, year), day.isNull() & year.isNotNull(), F.when(fits, F.btrim(F.get(fields, F.lit(1)))), F.when(fits, F.btrim(F.get(fields, F.lit(2))))


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source, gene, start, end, strand) of the CDS rows of GFF3 files, and malformed rows.

    Nine tab-separated columns; another strand than + or - counts as +; the name is gene=, else Name=, else ID=, else ``unnamed``.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", r"\r\z", "").alias("value")).where("trim(value) <> '' and not startswith(value, '#')").withColumn("c", F.split("value", "\t", -1))
    at = lambda i: F.get("c", F.lit(i))
    name = lambda k: F.nullif(F.regexp_extract(at(8), rf"(?:^|;)\s*{k}=([^;]*)", 1), F.lit(""))
    rows = rows.withColumn("start", at(3).try_cast("bigint")).withColumn("end", at(4).try_cast("bigint")).withColumn("strand", F.when(at(6) == "-", "-").otherwise("+")).withColumn("gene", F.coalesce(name("gene"), name("Name"), name("ID"), F.lit("unnamed")))
    short = F.size("c") < 9
    rows = rows.where(short | (F.lower(at(2)) == "cds"))
    reason = F.when(short, "too few columns").when(F.col("start").isNull() | F.col("end").isNull(), "position is no number").when(F.col("end") < F.col("start"), "end before start")
    return _split(rows, reason, ["source", "gene", "start", "end", "strand"], "source", "value")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source, chrom, pos, ref, alt, depth) of VCF files (plain or gzip), one row per alternative, and malformed rows.

    Depth is DP of INFO, else DP of the first sample.  ``.`` and ``*`` are no alternatives.  Of files without a ``#CHROM`` line no row loads.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    rows = lines.where("trim(value) <> '' and not startswith(value, '#')").withColumn("c", F.split("value", "\t", -1))
    at = lambda i: F.get("c", F.lit(i))
    info = F.nullif(F.regexp_extract(F.coalesce(at(7), F.lit("")), r"(?:^|;)DP=(\d+)", 1), F.lit("")).try_cast("int")
    keys = F.split(F.coalesce(at(8), F.lit("")), ":")
    spot = F.array_position(keys, "DP")
    sample = F.when(spot > 0, F.get(F.split(F.coalesce(at(9), F.lit("")), ":"), (spot - 1).cast("int")).try_cast("int"))
    rows = rows.withColumn("pos", at(1).try_cast("bigint")).withColumn("depth", F.coalesce(info, sample))
    named = lines.where(F.startswith("value", F.lit("#CHROM"))).select("source").distinct().withColumn("named", F.lit(True))
    rows = rows.join(named, "source", "left")
    reason = F.when(F.col("named").isNull(), "no #CHROM line").when(F.size("c") < 8, "too few columns").when(F.col("pos").isNull(), "position is no number").when(at(4) == ".", "no alternative")
    good, bad = _split(rows.withColumn("chrom", at(0)).withColumn("ref", at(3)).withColumn("alts", F.split(F.coalesce(at(4), F.lit("")), ",")), reason, ["source", "chrom", "pos", "ref", "alts", "depth"], "source", "value")
    return good.withColumn("alt", F.explode("alts")).where("alt <> '*' and alt <> '.'").select("source", "chrom", "pos", "ref", "alt", "depth"), bad


def variant_burden(variants: DataFrame, minimum_depth: int = 10) -> DataFrame:
    """Per source: variants of enough depth, those below, and those without a depth (counted as enough)."""
    low = F.col("depth") < minimum_depth
    return variants.groupBy("source").agg(F.count_if(F.col("depth").isNull() | ~low).alias("burden"), F.count_if(low).alias("below"), F.count_if(F.col("depth").isNull()).alias("without_depth"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequence_id, collected, precision, location, host) of metadata CSV files, and rows without id.

    ``sequence_id`` is required; the others may lack.  A date that does not parse leaves its row with a null date.
    """
    df = _csv(spark, path)
    if "sequence_id" not in df.columns:
        raise ValueError("metadata needs a column sequence_id")
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    day, precision = N.partial_date(col("collection_date"))
    rows = df.select(F.lit(path).alias("source"), F.btrim("sequence_id").alias("sequence_id"), day.alias("collected"), precision.alias("precision"), col("location").alias("location"), col("host").alias("host"))
    return _split(rows, F.when(F.coalesce("sequence_id", F.lit("")) == "", "blank id"), ["sequence_id", "collected", "precision", "location", "host"], "source", "location")


def read_incidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(date, new_cases) of incidence CSV files, and rows with an unreadable date or number or a negative number."""
    df = _csv(spark, path)
    if not {"date", "new_cases"} <= set(df.columns):
        raise ValueError("incidence needs columns date and new_cases")
    rows = df.select(F.lit(path).alias("source"), F.try_to_date("date", "yyyy-MM-dd").alias("day"), F.col("new_cases").try_cast("double").alias("n"), F.concat_ws(",", "date", "new_cases").alias("record"))
    reason = F.when(F.col("day").isNull(), "invalid date").when(F.col("n").isNull() | F.isnan("n"), "invalid number").when(F.col("n") < 0, "negative number")
    good, bad = _split(rows, reason, ["day", "n"], "source", "record")
    return good.select(F.col("day").alias("date"), F.col("n").alias("new_cases")), bad


def read_codon_usage(spark: SparkSession, path: str) -> DataFrame:
    """(codon, frequency, weight) of a codon usage CSV; a frequency that is no number is an error.  Weights are relative to the commonest synonym, at least 1e-4."""

    rows = _csv(spark, path).select(F.translate(F.upper(F.btrim("codon")), "U", "T").alias("codon"), F.col("frequency").cast("double").alias("frequency"))
    coded = rows.join(F.broadcast(genetic_code.code_table(spark)), "codon").where("amino_acid <> '*'")
    return coded.select("codon", "frequency", F.greatest(F.try_divide("frequency", F.max("frequency").over(Window.partitionBy("amino_acid"))), F.lit(1e-4)).alias("weight"))


def read_host_codon_usage(spark: SparkSession, path: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(host, codon, frequency, weight) of a folder with one codon usage CSV per host, named by it; ``aliases`` names a host after another's table.

    Hosts are compared without case, spaces and underscores; weights as in ``read_codon_usage``.
    """
    rows = _csv(spark, path).select(host_key(F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))).alias("host"), F.translate(F.upper(F.btrim("codon")), "U", "T").alias("codon"), F.col("frequency").cast("double").alias("frequency"))
    coded = rows.join(F.broadcast(genetic_code.code_table(spark)), "codon").where("amino_acid <> '*'")
    weighed = coded.select("host", "codon", "frequency", F.greatest(F.try_divide("frequency", F.max("frequency").over(Window.partitionBy("host", "amino_acid"))), F.lit(1e-4)).alias("weight"))
    if not aliases:
        return weighed
    same = spark.createDataFrame(list(aliases.items()), "alias string, host string").select(host_key(F.col("alias")).alias("alias"), host_key(F.col("host")).alias("host"))
    return weighed.unionByName(weighed.join(same, "host").select(F.col("alias").alias("host"), "codon", "frequency", "weight"))


def host_key(name: Column) -> Column:
    """A host's name as tables are found by it."""
    return F.translate(F.lower(F.regexp_replace(name, r"\.csv(\.gz)?\z", "")), " _-", "")


def read_generation_times(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pathogen, applicable, days) of a CSV of generation times, and rows against the rules: applicable ones have positive days, others none."""
    df = _csv(spark, path)
    if not {"pathogen", "applicable", "days"} <= set(df.columns):
        raise ValueError("generation times need columns pathogen, applicable and days")
    flag = F.lower(F.btrim("applicable"))
    rows = df.select(F.lit(path).alias("source"), F.btrim("pathogen").alias("pathogen"), F.when(flag.isin("true", "yes"), F.lit(True)).when(flag.isin("false", "no"), F.lit(False)).alias("applicable"), F.col("days").alias("text"), F.col("days").try_cast("double").alias("days"))
    wrong = F.col("text").isNotNull() & F.col("days").isNull()
    reason = (
        F.when(F.coalesce("pathogen", F.lit("")) == "", "blank pathogen").when(F.col("applicable").isNull(), "neither applicable nor not").when(wrong, "days are no number")
        .when(F.col("applicable") & ~F.coalesce(F.col("days") > 0, F.lit(False)), "applicable without positive days").when(~F.col("applicable") & F.col("days").isNotNull(), "days though not applicable")
    )
    return _split(rows, reason, ["pathogen", "applicable", "days"], "source", "pathogen")


def read_weights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, weight) of a JSON object of index labels and numbers, laid over the usual weights and scaled to sum to 1; and entries that do not count.

    Labels are compared without case.  Unknown labels, negative numbers and what is no number do not count.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "text"))
    usual = spark.createDataFrame(list(RAW_WEIGHTS.items()), "key string, usual double")  # nine rows
    rows = text.join(usual, F.lower(F.btrim("label")) == F.lower("key"), "left").withColumn("weight", F.col("text").try_cast("double")).withColumn("source", F.lit(path))
    reason = F.when(F.col("key").isNull(), "unknown index").when(F.col("weight").isNull() | F.isnan("weight"), "no number").when(F.col("weight") < 0, "negative")
    good, bad = _split(rows, reason, ["key", "weight"], "source", "label")
    laid = usual.join(good, "key", "left").select("key", F.coalesce("weight", "usual").alias("weight"))
    return laid.select("key", (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("weight")), bad


def parse_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(source, n_loaded, n_skipped, status) of a reader's two results with a source: how much loaded, and ``no valid record`` where nothing did."""
    both = good.select("source", F.lit(1).alias("loaded"), F.lit(0).alias("skipped")).unionByName(bad.select("source", F.lit(0).alias("loaded"), F.lit(1).alias("skipped")))
    sums = both.groupBy("source").agg(F.sum("loaded").alias("n_loaded"), F.sum("skipped").alias("n_skipped"))
    return sums.withColumn("status", F.when(F.col("n_loaded") == 0, "no valid record").otherwise("loaded"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(row, target, key, value) of a calibration CSV: one column ``target`` and one per index label, in any case."""
    df = _csv(spark, path)
    label = {k.lower(): k for k in KEYS}
    unknown = [c for c in df.columns if c.lower() != "target" and c.lower() not in label]
    if unknown or not any(c.lower() == "target" for c in df.columns):
        raise ValueError(f"unknown columns {unknown}" if unknown else "calibration needs a column target")
    target = next(c for c in df.columns if c.lower() == "target")
    keyed = F.array(*[F.struct(F.lit(label[c.lower()]).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns if c != target])
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(target).cast("double").alias("target"), F.explode(keyed).alias("x")).select("row", "target", "x.*")


def write_gff(genes: DataFrame, path: str, origin: str = "strandwise") -> None:
    """Genes (seqid, gene, start, end, strand) as GFF3 rows of type CDS."""
    line = F.concat_ws("\t", "seqid", F.lit(origin), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID="), F.col("gene"), F.lit(";gene="), F.col("gene")))
    genes.select(line.alias("value")).write.mode("overwrite").text(path)


def write_report(parts: DataFrame, scores: DataFrame, path: str) -> None:
    """One JSON document per dataset: its composite with the list of components."""
    listed = parts.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("key", "value", "normalised", "weight", "effective_weight", "contribution"))).alias("components"))
    scores.join(listed, "dataset_id").write.mode("overwrite").json(path)


def write_summary(parts: DataFrame, scores: DataFrame, path: str) -> None:
    """One CSV row per dataset: the composite and a column per index."""
    wide = parts.groupBy("dataset_id").pivot("key", list(KEYS)).agg(F.first("value"))
    scores.join(wide, "dataset_id").write.mode("overwrite").option("header", True).csv(path)


def write_per_sequence(rows: DataFrame, path: str) -> None:
    """One CSV row per query with its values."""
    rows.write.mode("overwrite").option("header", True).csv(path)

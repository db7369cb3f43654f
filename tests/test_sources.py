"""Readers: what loads, what is reported."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandwise.sources import files
from strandwise.streaming import incidence


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a one\nac\ngt\n>b|x|y|2020-01-02\r\nAC-N\r\n>a again\nAAAA\n>bad\nAC!T\n>empty\n> \nAC\n")
    (tmp_path / "b.fasta").write_text("junk\n>a\nACGU\n")
    good, bad = files.read_fasta(spark, str(tmp_path))
    assert pairs(good, "id", "seq") == [("a", "ACGT"), ("a", "ACGU"), ("b|x|y|2020-01-02", "AC-N")]
    assert sorted(r.reason for r in bad.collect()) == ["before the first header", "empty id", "empty sequence", "invalid letters", "repeated id"]


def test_headers(spark):
    df = spark.createDataFrame([("x 2020-13-01 2021-02-03",), ("x 12019 2018 y",), ("acc|Land: Ort|cow|2019",), ("nothing",), ("a| |c|2019",)], "h string")
    day, year, place, host = files.header_fields(F.col("h"))
    got = [tuple(r) for r in df.select(day.cast("string"), year, place, host).collect()]
    assert got == [("2021-02-03", False, None, None), ("2018-07-02", True, None, None), ("2019-07-02", True, "Land: Ort", "cow"), (None, False, None, None), ("2019-07-02", True, None, None)]


def test_gff(spark, tmp_path):
    p = tmp_path / "g.gff3"
    p.write_text("##gff-version 3\nr\ts\tCDS\t1\t9\t.\t-\t0\tID=i;gene=g\nr\ts\tgene\t1\t9\t.\t+\t0\tID=x\nr\ts\tcds\t3\t8\t.\t?\t0\tName=n\nr\ts\tCDS\tx\t8\t.\t+\t0\t.\nr\ts\tCDS\t9\t8\t.\t+\t0\t.\nshort\n")
    good, bad = files.read_gff(spark, str(p))
    assert pairs(good, "gene", "start", "end", "strand") == [("g", 1, 9, "-"), ("n", 3, 8, "+")]
    assert bad.count() == 3
    files.write_gff(good.withColumn("seqid", F.lit("r")), str(tmp_path / "out"))
    assert pairs(files.read_gff(spark, str(tmp_path / "out"))[0], "gene", "start") == [("g", 1), ("n", 3)]


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t5\t.\tA\tG,T,*\t.\t.\tDP=9\n1\t6\t.\tA\tC\t.\t.\tX=1\tGT:DP\t0/1:30\n1\tx\t.\tA\tC\t.\t.\t.\n1\t7\t.\tA\t.\t.\t.\t.\n1\t8\t.\tA\tC\t.\t.\t.\n"
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write(text)
    good, bad = files.read_vcf(spark, str(tmp_path / "v.vcf.gz"))
    assert sorted(pairs(good, "pos", "alt", "depth"), key=str) == [(5, "G", 9), (5, "T", 9), (6, "C", 30), (8, "C", None)]
    assert bad.count() == 2
    assert [tuple(r)[1:] for r in files.variant_burden(good).collect()] == [(2, 2, 1)]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sequence_id,collection_date,host,extra\na,2020,cow,1\n,2020,cow,1\nb,soon,,1\n")
    good, bad = files.read_metadata(spark, str(tmp_path / "m.csv"))
    assert [(r.sequence_id, str(r.collected), r.location) for r in good.orderBy("sequence_id").collect()] == [("a", "2020-07-02", None), ("b", "None", None)] and bad.count() == 1
    (tmp_path / "i.csv").write_text("date,new_cases\n2024-01-01,3\nx,3\n2024-01-02,-1\n2024-01-03,y\n")
    good, bad = files.read_incidence(spark, str(tmp_path / "i.csv"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["invalid date", "invalid number", "negative number"]
    (tmp_path / "c.csv").write_text("codon,frequency\nuuu,10\nTTC,5\nTAA,1\nATG,0\n")
    assert sorted((r.codon, r.weight) for r in files.read_codon_usage(spark, str(tmp_path / "c.csv")).collect()) == [("ATG", 0.0001), ("TTC", 0.5), ("TTT", 1.0)]
    (tmp_path / "k.csv").write_text("PI,target\n0.1,0.5\n")
    assert files.read_calibration(spark, str(tmp_path / "k.csv")).first().key == "pi"
    with pytest.raises(ValueError):
        files.read_metadata(spark, str(tmp_path / "i.csv"))


def test_host_tables_times_and_weights(spark, tmp_path):
    (tmp_path / "hosts").mkdir()
    (tmp_path / "hosts" / "pig.csv").write_text("codon,frequency\nuuu,10\nTTC,5\nTAA,1\n")
    (tmp_path / "hosts" / "Water Buffalo.csv").write_text("codon,frequency\nTTT,0\nTTC,4\n")
    usage = files.read_host_codon_usage(spark, str(tmp_path / "hosts"), {"wild_boar": "pig"})
    assert pairs(usage, "host", "codon", "weight") == [("pig", "TTC", 0.5), ("pig", "TTT", 1.0), ("waterbuffalo", "TTC", 1.0), ("waterbuffalo", "TTT", 1e-4), ("wildboar", "TTC", 0.5), ("wildboar", "TTT", 1.0)]
    (tmp_path / "t.csv").write_text("pathogen,applicable,days\na,yes,5\nb,no,\nc,yes,0\nd,no,3\ne,perhaps,1\nf,yes,x\n,yes,1\n")
    good, bad = files.read_generation_times(spark, str(tmp_path / "t.csv"))
    assert pairs(good, "pathogen", "applicable") == [("a", True), ("b", False)] and bad.count() == 5
    (tmp_path / "w.json").write_text('{"PI": 0.5, "mu": -1, "other": 2, "GD": "x"}')
    weights, bad = files.read_weights(spark, str(tmp_path / "w.json"))
    got = {r.key: r.weight for r in weights.collect()}
    assert len(got) == 9 and abs(sum(got.values()) - 1) < 1e-9 and abs(got["pi"] / got["GD"] - 5) < 1e-9
    assert sorted(r.reason for r in bad.collect()) == ["negative", "no number", "unknown index"]


def test_counts_of_what_loads(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a\nACGT\n>a\nAC\n")
    (tmp_path / "b.fasta").write_text(">x\nAC!T\n")
    counts = {r.source[-7:]: (r.n_loaded, r.n_skipped, r.status) for r in files.parse_counts(*files.read_fasta(spark, str(tmp_path))).collect()}
    assert counts == {"a.fasta": (1, 1, "loaded"), "b.fasta": (0, 1, "no valid record")}
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\n1\t5\t.\tA\tG\t.\t.\tDP=9\n")
    good, bad = files.read_vcf(spark, str(tmp_path / "v.vcf"))
    assert good.count() == 0 and [r.reason for r in bad.collect()] == ["no #CHROM line"]
    files.write_per_sequence(spark.createDataFrame([("d", 1, 0.5)], "dataset_id string, seq_ord int, gd double"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["dataset_id", "seq_ord", "gd"]


def test_stream_equals_batch(spark, tmp_path):
    """Every day before the watermark comes out as in the batch operator, redeliveries and reports without id too."""
    import datetime as dt

    from strandwise.operators import series

    rows = [(1, 1, "2024-01-01", 2.0), (1, 1, "2024-01-01", 2.0), (2, 1, "2024-01-01", 3.0), (3, 1, "2024-01-02", -1.0), (4, 1, "2024-01-03", 1.0), (None, 1, "2024-01-03", 4.0), (None, 1, "2024-01-03", 4.0), (8, 2, "2024-01-03", float("inf")), (9, 2, "2024-01-04", 7.0), (5, 1, "2024-04-03", 1.0), (6, 1, "2024-06-03", 1.0)]
    data = spark.createDataFrame(rows, "report_id long, series_id long, date string, new_cases double").withColumn("date", F.to_date("date"))
    data.write.parquet(str(tmp_path / "in"))
    stream = incidence.daily_totals(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.series_id, str(r.day), r.total, r.n_reports) for r in spark.table("daily").collect()}
    spans = spark.createDataFrame([(s, 1, dt.date(2024, 1, 1), dt.date(2024, 12, 31)) for s in (1, 2)], "series_id long, step_days int, start_date date, end_date date")
    batch = series.daily_totals(data.withColumn("loaded_at", F.lit(None).cast("timestamp")), spans)
    want = {(r.series_id, str(r.day), r.total, r.n_reports) for r in batch.collect() if r.day < dt.date(2024, 5, 1)}
    assert got == want and len(want) == 4

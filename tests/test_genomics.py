"""Hand-computed values and brute force for the genomic operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import genetic_code as G
from strandwise.functions import nucleotides as N
from strandwise.functions.bands import RANGES, WEIGHTS
from strandwise.operators import alignment as A
from strandwise.operators import codons as C
from strandwise.operators import composite as M
from strandwise.operators import distance as D
from strandwise.operators import epidemic as E
from strandwise.operators import genes as GN
from strandwise.operators import pairs as R
from strandwise.operators import phylo as P


def align(spark, *seqs, dataset="d"):
    return spark.createDataFrame([(dataset, i, f"s{i}", s) for i, s in enumerate(seqs)], "dataset_id string, seq_ord long, sequence_id string, seq string")


def test_current_alignment(spark):
    df = spark.createDataFrame([("d", 0, "a", "acg", 1, None, "x"), ("d", 0, "a", "act", 2, None, "x"), ("d", 1, "b", "AAA", 1, 3, "x"), ("d", None, "c", "AAA", 1, None, "x"), ("d", 2, "c", None, 1, None, "x"), (None, 2, "c", "A", 1, None, "x")], "dataset_id string, seq_ord long, sequence_id string, seq string, loaded_at long, deleted_at long, ref string")
    assert [tuple(r) for r in A.current_alignment(df).collect()] == [("d", 0, "a", "ACT")]


def test_distance_by_hand(spark):
    r = D.genetic_distance(align(spark, "A" * 20, "GG" + "A" * 18, "-" * 20, "CGTN" + "A" * 16)).orderBy("seq_ord").collect()
    assert math.isclose(r[0].jc69, -0.75 * math.log(1 - 4 / 3 * 0.1)) and math.isclose(r[0].k80, -0.5 * math.log(1 - 0.2))
    assert r[1].comparable == 0 and r[1].p is None and r[1].jc69 is None
    assert (r[2].comparable, r[2].transitions, r[2].transversions) == (19, 1, 2)
    assert D.genetic_distance(align(spark, "AAAA", "CCCC")).first().saturated


def test_burden_and_gc(spark):
    assert D.mutation_burden(align(spark, "ACGT---ACGT", "ACGTGGGACGT")).first().burden == 1
    assert D.mutation_burden(align(spark, "ACGTAC--GT", "A--TTCGG-T")).first().burden == 4
    r = D.gc_content(align(spark, "AAAAACCCAA", "GCGCAAAAAA")).first()
    assert r.gc == 40 and r.gc_deviation == 10


def test_diversity(spark):
    assert math.isclose(R.nucleotide_diversity(align(spark, "AAAAAAAAAA", "AAAAAAAAAG", "AAAAAAAAGG")).first().pi, 0.4 / 3)
    assert R.nucleotide_diversity(align(spark, "ACGT")).first().pi is None
    rnd = random.Random(5)
    seqs = ["".join(rnd.choice("AACCGT-N") for _ in range(7)) for _ in range(40)] + ["ACGTACG"] * 10 + ["-------"]
    ratios = []
    for i in range(len(seqs)):
        for j in range(i):
            both = [(a, b) for a, b in zip(seqs[i], seqs[j], strict=True) if a in "ACGT" and b in "ACGT"]
            if both:
                ratios.append(sum(a != b for a, b in both) / len(both))
    got = R.nucleotide_diversity(align(spark, *seqs)).first()
    assert got.n_pairs == len(ratios) and math.isclose(got.pi, sum(ratios) / len(ratios))


def test_sites_and_trim(spark):
    al = align(spark, "ACGTAC-T", "ACATCC-T", "GCATCCAT", "GC-TCNAT")
    s = A.site_summary(al).first()
    assert (s.n_columns, s.n_variable, s.n_informative, s.n_gap_free, s.n_covered, s.longest_block) == (8, 3, 1, 6, 5, 3)
    assert [r.seq for r in A.trimmed(al, 1).orderBy("seq_ord").collect()] == ["ACTACT", "ACTCCT", "GCTCCT", "GCTCNT"]
    assert A.trimmed(al).count() == 0


def test_genetic_code():
    assert len(G.SENSE) == 61 and math.isclose(G.synonymous_sites("TTT"), 1 / 3) and G.synonymous_sites("GGT") == 1
    assert G.differences("TTT", "TTT") == (0, 0) and sum(G.differences("TTT", "GGG")) == 3
    assert all(math.isclose(sum(G.differences(a, b)), sum(x != y for x, y in zip(a, b, strict=True))) for a in G.SENSE for b in G.SENSE)


def test_selection_by_hand(spark):
    r = C.selection(C.selection_counts(align(spark, "TTT", "TTA"))).first()
    jc = lambda p: -0.75 * math.log(1 - 4 * p / 3)
    assert math.isclose(r.ds, jc(0.5 / 1.5)) and math.isclose(r.dn, jc(1 / 2.5)) and r.verdict == "inconclusive"
    assert C.selection_counts(align(spark, "TAATTT", "TTTNNN")).count() == 0


def test_adaptation(spark):
    usage = spark.createDataFrame([("d", "TTT", 1.0), ("d", "TTC", 0.1)], "dataset_id string, codon string, weight double")
    got = {r.sequence_id: r.cai for r in C.codon_adaptation(align(spark, "TTTTTT", "TTTTTT", "TTTTTC", "ATGTTC"), usage).collect()}
    assert got["s1"] == 1.0 and math.isclose(got["s2"], math.sqrt(0.1)) and math.isclose(got["s3"], 0.1)


def brute_orfs(seq, minimum):
    """Every stretch between stops of every frame, read codon by codon."""
    comp = dict(zip("ACGT", "TGCA", strict=True))
    out = set()
    for strand, s in (("+", seq), ("-", "".join(comp[c] for c in reversed(seq)))):
        for f in range(3):
            start = None
            for i in range(f, len(s) - 2, 3):
                codon = s[i : i + 3]
                if codon == "ATG" and start is None:
                    start = i
                if codon in ("TAA", "TAG", "TGA"):
                    if start is not None and (i - start) // 3 + 1 >= minimum:
                        a, b = start + 1, i + 3
                        out.add((strand, f, a, b) if strand == "+" else (strand, f, len(s) - b + 1, len(s) - a + 1))
                    start = None
    return out


def test_open_reading_frames(spark):
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ATGATAG") for _ in range(rnd.randint(0, 200))) or "A" for _ in range(30)]
    got = {}
    for r in C.open_reading_frames(align(spark, *seqs), 3).collect():
        got.setdefault(r.sequence_id, set()).add((r.strand, r.frame, r.start, r.end))
    for i, s in enumerate(seqs):
        assert got.get(f"s{i}", set()) == brute_orfs(s, 3)


def test_expressions(spark):
    df = spark.createDataFrame([("AC-RN", "2021", "2020-02"), ("", "2021-13", "2021-02-29")], "s string, a string, b string")
    a, b = N.partial_date(F.col("a")), N.partial_date(F.col("b"))
    r = df.select(N.reverse_complement(F.col("s")).alias("rc"), a[0].cast("string").alias("a"), a[1].alias("ap"), b[0].cast("string").alias("b"), b[1].alias("bp"), N.codons(F.col("s")).alias("c")).collect()
    assert (r[0].rc, r[0].a, r[0].ap, r[0].b, r[0].bp, r[0].c) == ("NYNGT", "2021-07-02", "year", "2020-02-15", "month", ["AC-"])
    assert (r[1].rc, r[1].a, r[1].ap, r[1].b, r[1].c) == ("", None, "none", None, [])


def test_reproduction_number_recovers(spark):
    """A noiseless renewal series with R = 1.4 gives 1.4."""
    import datetime as dt

    w = E.serial_interval()
    assert math.isclose(sum(w), 1) and abs(sum(u * x for u, x in enumerate(w, 1)) - 5) < 0.05
    cases = [100.0] * 20
    for _ in range(60):
        cases.append(1.4 * sum(x * cases[-u] for u, x in enumerate(w, 1)))
    day = dt.date(2024, 1, 1)
    reports = spark.createDataFrame([(i, 1, day + dt.timedelta(i), c, None) for i, c in enumerate(cases)], "report_id long, series_id long, date date, new_cases double, loaded_at timestamp")
    spans = spark.createDataFrame([(1, 1, day, day + dt.timedelta(79))], "series_id long, step_days int, start_date date, end_date date")
    est = E.reproduction_number(reports, spans)
    assert est.count() == 80 - 26
    assert abs(E.latest_reproduction_number(est).first().re - 1.4) < 0.05


def test_clock_and_metadata(spark):
    al = align(spark, "A" * 1000, "G" * 10 + "A" * 990, "A" * 1000)
    md = spark.createDataFrame([(1, "d", "s0", "2020-01-01", "x", None), (2, "d", " s1\t", "bad", "x", "h"), (3, "d", "s1", "2021-01-01", None, "h"), (4, "d", None, "2021", "x", "h"), (5, "d", "zz", "2021", "x", "h")], "row_id long, dataset_id string, sequence_id string, collection_date string, location string, host string")
    dated = E.dated_records(al, md)
    assert {r.sequence_id: (str(r.collected), r.precision, r.location) for r in dated.collect()} == {"s0": ("2020-01-01", "day", "x"), "s1": ("2021-01-01", "day", None), "s2": ("None", "none", None)}
    r = E.clock_rate(dated).first()
    assert math.isclose(r.mu, -0.75 * math.log(1 - 4 / 3 * 0.01), rel_tol=1e-6) and r.n_dated == 2


def test_composite(spark):
    ix = spark.createDataFrame([("a", "pi", 0.01), ("a", "GD", 0.05), ("a", "MB", None), ("a", "nothing", 1.0), ("b", "Re", 1.5)], "dataset_id string, key string, value double")
    parts = M.components(ix)
    got = {r.dataset_id: r for r in M.composite(parts).collect()}
    assert math.isclose(got["a"].gvi, 0.75) and got["a"].n_at_ceiling == 1 and not got["a"].comparable and math.isclose(got["b"].gvi, 0.5)
    s = {(r.dataset_id, r.key): (r.low, r.high) for r in M.sensitivity(ix).collect()}
    assert set(s) == {("a", "pi"), ("a", "GD"), ("b", "Re")} and s["b", "Re"] == (0.5, 0.5)
    w = {k: v for k, v in WEIGHTS.items()}
    for sign in (-1, 1):
        t = w["pi"] * (1 + sign * 0.2)
        gd = w["GD"] - (t - w["pi"]) * w["GD"] / (1 - w["pi"])
        assert any(math.isclose((t * 0.5 + gd) / (t + gd), x) for x in s["a", "pi"])
    assert math.isclose(sum(WEIGHTS.values()), 1) and set(WEIGHTS) == set(RANGES)
    ev = spark.createDataFrame([("a", 0.2, 0.0, 0.5, 1.0, 0.5, "neutral")], "dataset_id string, gap_fraction double, burden_share double, r2 double, mu double, omega double, verdict string")
    assert {(r.key, r.excluded) for r in M.gate(ix.where("dataset_id = 'a' and key <> 'nothing'"), ev).collect()} == {("pi", "alignment"), ("GD", "alignment"), ("MB", "alignment")}


@pytest.mark.parametrize("name", ["nucleotide_diversity", "site_summary", "genetic_distance", "selection_by_query", "open_reading_frames"])
def test_empty_alignment(spark, name):
    al = align(spark, "A").limit(0)
    run = {"nucleotide_diversity": R.nucleotide_diversity, "site_summary": A.site_summary, "genetic_distance": D.genetic_distance, "selection_by_query": lambda x: C.selection(C.selection_counts(x)), "open_reading_frames": C.open_reading_frames}[name]
    assert run(al).count() == 0


def test_neighbor_joining_by_hand():
    d = np.array([[0, 3, 5, 8], [3, 0, 6, 9], [5, 6, 0, 9], [8, 9, 9, 0]], float)
    tips = P.root_to_tip(P.neighbor_joining(d), 0)
    assert [round(tips[i], 9) for i in range(4)] == [0, 3, 5, 8]


def test_tree_clock(spark):
    seqs = ["A" * 200, "G" * 2 + "A" * 198, "G" * 4 + "A" * 196, "G" * 6 + "A" * 194]
    al = align(spark, *seqs).unionByName(align(spark, "ACGT", "ACGT", dataset="small"))
    dated = al.withColumn("collected", F.make_date(F.col("seq_ord").cast("int") + 2001, F.lit(1), F.lit(1)))
    got = {r.dataset_id: r for r in P.tree_clock(dated).collect()}
    assert got["small"].status == "fewer than 3 records" and got["d"].status == "computed"
    assert abs(got["d"].mu - 0.01) < 5e-4 and got["d"].r2 > 0.99 and got["d"].p_value < 0.2
    assert {r.status for r in P.tree_clock(dated, 3).collect()} == {"more than 3 records", "fewer than 3 records"}


def test_recombination(spark):
    block = lambda *bits: "".join("AC"[b] for b in bits)
    seqs = [block(*([i % 2] * 100), *([i // 2 % 2] * 100)) for i in range(24)]
    inc = P.combinations(seqs, [98, 99, 100, 101], "AAAA", "CCCC").all(axis=0)
    assert not inc[0, 1] and inc[1, 2] and not inc[2, 3]
    r = P.recombination(align(spark, *seqs)).first()
    assert r.n_sites == 200 and r.p_value < 0.05 and r.ri > 0
    assert P.recombination(align(spark, "ACGT", "ACGT")).count() == 0


def test_gate_and_preferred_clock(spark):
    tree = spark.createDataFrame([("a", "computed", 0.004, 0.9, 0.01), ("b", "more than 300 records", None, None, None), ("c", "computed", 0.003, 0.8, 0.4)], "dataset_id string, status string, mu double, r2 double, p_value double")
    pairwise = spark.createDataFrame([("a", 0.1, 0.1, 0.9), ("b", 0.002, 0.7, 0.02), ("c", 0.1, 0.1, 0.9)], "dataset_id string, mu double, r2 double, p_value double")
    clock = M.preferred_clock(pairwise, tree)
    assert {r.dataset_id: (r.mu, r.p_value) for r in clock.collect()} == {"a": (0.004, 0.01), "b": (0.002, 0.02), "c": (0.003, 0.4)}
    ix = clock.select("dataset_id", F.lit("mu").alias("key"), F.col("mu").alias("value"))
    ev = clock.withColumns({c: F.lit(0.0) for c in ("gap_fraction", "burden_share", "omega")}).withColumn("verdict", F.lit("neutral"))
    assert {r.dataset_id: r.excluded for r in M.gate(ix, ev).collect()} == {"a": None, "b": None, "c": "dates no better than shuffled"}
    points = [("up", 2000.0 + i, 0.01 * i) for i in range(8)] + [("down", 2000.0 + i, -0.01 * i) for i in range(8)] + [("two", 2000.0, 0.0), ("two", 2001.0, 1.0)]
    p = {r.dataset_id: r.p_value for r in P.date_shuffles(spark.createDataFrame(points, "dataset_id string, year double, d double")).collect()}
    assert p["up"] < 0.05 and p["down"] == 1.0 and p["two"] is None


def test_gated_composite_against_brute_force(spark):
    """The score of the flagship, added up again in Python from the indices, clocks and reasons."""
    from strandwise.plans import genomics, registry

    d, q = "/root/testdata/sf0.001", genomics.QUERIES
    by = lambda name: {r.dataset_id: r for r in q[name](spark, d).collect()}
    tree, pair, ri, pooled = by("tree_clock"), by("clock_rate"), by("recombination"), by("selection_pooled")
    values = {}
    for r in q["gated_indices"](spark, d).collect():
        if r.key != "mu" and r.value is not None and r.excluded is None:
            values.setdefault(r.dataset_id, {})[r.key] = r.value
    for k, r in ri.items():
        if r.ri is not None:
            values.setdefault(k, {})["RI"] = r.ri
    poor = {k for k, r in by("alignment_summary").items() if r.gap_fraction >= 0.15}
    lengths, burdens = {k: r.length for k, r in by("alignment_summary").items()}, {}
    for r in q["mutation_burden"](spark, d).collect():
        burdens.setdefault(r.dataset_id, []).append(r.burden)
    poor |= {k for k, b in burdens.items() if np.mean(b) / lengths[k] >= 0.15}
    for k, t in tree.items():
        # All datasets here have trees, so no pairwise p is needed.
        if t.status == "computed" and k not in poor and t.mu > 0 and t.r2 >= 0.30 and (t.p_value is None or t.p_value < 0.05):
            values[k]["mu"] = t.mu
        assert t.status == "computed" or k not in pair
    assert all("dN/dS" not in v or not (pooled[k].omega > 1 and pooled[k].verdict != "positive") for k, v in values.items())
    norm = lambda key, v: min(1.0, max(0.0, (v - RANGES[key][0]) / (RANGES[key][1] - RANGES[key][0])))
    got = {r.dataset_id: r for r in registry.QUERIES[registry.FLAGSHIP](spark, d).collect()}
    assert set(got) == {k for k, v in values.items() if v}
    for k, v in values.items():
        weight = sum(WEIGHTS[x] for x in v)
        assert math.isclose(got[k].gvi, sum(WEIGHTS[x] * norm(x, y) for x, y in v.items()) / weight, abs_tol=3e-6)
        assert math.isclose(got[k].coverage, weight, abs_tol=1e-6) and got[k].n_indices == len(v)

"""Genes, tests and bands by hand and by brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import bands
from strandwise.functions import genetic_code as G
from strandwise.functions import statistics as S
from strandwise.operators import codons as C
from strandwise.operators import composite as M
from strandwise.operators import distance as D
from strandwise.operators import epidemic as E
from strandwise.operators import genes as GN

SCHEMA = "dataset_id string, seq_ord long, sequence_id string, seq string, start string"


def frame(spark, data):
    return spark.createDataFrame([(d, i, f"{d}{i}", s, "x") for d, seqs in data.items() for i, s in enumerate(seqs)], SCHEMA)


def turned(s):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(s))


def brute_frames(seq, least):
    out = []
    for strand, s in (("+", seq), ("-", turned(seq))):
        for frame in range(3):
            first = None
            for p in range(frame, len(s) - 2, 3):
                c = s[p : p + 3]
                if c == "ATG" and first is None:
                    first = p
                if c in ("TAA", "TAG", "TGA"):
                    if first is not None and (p + 3 - first) // 3 >= least:
                        out.append((strand, first + 1, p + 3) if strand == "+" else (strand, len(s) - p - 2, len(s) - first))
                    first = None
    return sorted(out)


def gene(rnd, n, bias):
    body = "".join(rnd.choices(G.SENSE, [bias.get(c, 1) for c in G.SENSE], k=n - 2))
    return "ATG" + body + "TAA"


def test_candidates_and_trained_genes(spark):
    rnd = random.Random(5)
    bias = {c: 12 for c in rnd.sample(G.SENSE, 15)}
    seq = "".join(gene(rnd, n, bias) + "".join(rnd.choices("ACGT", k=rnd.randint(20, 60))) for n in (120, 150, 100, 95, 40, 35))
    al = frame(spark, {"d": [seq, seq], "short": ["ATG" + "GCT" * 40 + "TAA" + "ACGT" * 5 + "ATG" + "GCA" * 10 + "TAA"], "none": ["ACGTACGTAC"]})
    found = sorted((r.strand, r.start, r.end) for r in GN.gene_candidates(al).where("dataset_id = 'd'").collect())
    assert found == brute_frames(seq, 30) and len(found) >= 6

    # The model again, by hand.
    cut = lambda s, a, b: seq[a - 1 : b] if s == "+" else turned(seq[a - 1 : b])
    inner = {g: [c for c in (x[i : i + 3] for i in range(3, len(x) - 3, 3)) if c in G.SENSE] for g in found for x in [cut(*g)]}
    counts = dict.fromkeys(G.SENSE, 1)
    for g, cs in inner.items():
        if (g[2] - g[1] + 1) // 3 >= 90:
            for c in cs:
                counts[c] += 1
    share = {b: (seq.count(b) + 1) / (len(seq) + 4) for b in "ACGT"}
    odds = {g: sum(math.log(counts[c] / sum(counts.values()) / math.prod(share[b] for b in c)) for c in cs) / len(cs) for g, cs in inner.items()}
    got = {(r.strand, r.start, r.end): r.log_odds for r in GN.predicted_genes(al).where("dataset_id = 'd'").collect()}
    assert set(got) == {g for g, x in odds.items() if x > 0} and all(math.isclose(got[g], odds[g], rel_tol=1e-9) for g in got)

    table = GN.gene_table(al)
    rows = {d: [(r.gene_ord, r.gene, r.start, r.end, r.origin) for r in table.where(F.col("dataset_id") == d).orderBy("gene_ord").collect()] for d in ("d", "short", "none")}
    assert rows["none"] == [(0, "whole_genome", 1, 10, "whole")]
    assert rows["short"] == [(0, "orf_fwd0_1", 1, 126, "predicted")]
    assert [x[3] - x[2] for x in rows["d"]] == sorted((x[3] - x[2] for x in rows["d"]), reverse=True)
    given = spark.createDataFrame([("none", "g2", 4, 9, "+"), ("none", "g1", 1, 6, "-")], "dataset_id string, gene string, start int, end int, strand string")
    assert [(r.gene, r.origin) for r in GN.gene_table(al, given).where("dataset_id = 'none'").orderBy("gene_ord").collect()] == [("g1", "given"), ("g2", "given")]
    assert GN.gene_table(al.limit(0)).count() == 0


def test_cut_remap_and_worst_gene(spark):
    al = frame(spark, {"d": ["ATGAAACCCGGGTTT", "ATGAAGCC-GGATTT", "ATGCAACCCGGGTTA"]})
    genes = spark.createDataFrame([("d", 0, "x", 1, 6, "+"), ("d", 1, "y", 7, 15, "-"), ("d", 2, "out", 10, 20, "+"), ("d", 3, "gap", 9, 9, "+")], "dataset_id string, gene_ord int, gene string, start bigint, end bigint, strand string")
    cds = {(r.seq_ord, r.gene): (r.ref, r.seq) for r in GN.gene_cds(al, genes).collect()}
    assert cds[1, "x"] == ("ATGAAA", "ATGAAG") and cds[1, "y"] == ("AAACCCGGG", "AAATCCNGG") and cds[1, "out"] == (None, None)
    remapped = {r.gene: (r.new_start, r.new_end) for r in GN.trimmed_genes(al, genes).collect()}
    assert remapped == {"x": (1, 6), "y": (7, 14), "out": (9, 14)}
    by = GN.selection_by_gene(al, genes)
    worst = {r.seq_ord: r.gene for r in GN.worst_genes(by).collect()}
    one = {(r.seq_ord, r.gene): r.omega for r in by.collect()}
    for q in (1, 2):
        mine = [(w, -o, g) for (s, g), w in one.items() if s == q for o in [["x", "y", "out", "gap"].index(g)] if w is not None]
        assert worst[q] == max(mine)[2]
    tie = spark.createDataFrame([("d", 1, "s", 0, "a", 0.5), ("d", 1, "s", 1, "b", 0.5), ("d", 2, "s", 0, "a", None)], "dataset_id string, seq_ord long, sequence_id string, gene_ord int, gene string, omega double")
    assert {r.seq_ord: r.gene for r in GN.worst_genes(tie).collect()} == {1: "a", 2: "a"}
    usage = C.codon_usage(al)
    one_gene = {r.seq_ord: r.cai for r in GN.adaptation_by_gene(al, genes.where("gene = 'x'"), usage).collect()}
    assert set(one_gene) == {1, 2} and all(0 < v <= 1 for v in one_gene.values())


def test_probabilities(spark):
    zs = [0.0, 0.5, -1.0, 1.959963984540054, 3.0, 5.5, 7.9, 12.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(S.two_tailed(F.col("z")).alias("p")).collect()]
    assert all(math.isclose(a, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-13) for a, z in zip(got, zs, strict=True))
    ns = [0, 1, 5, 20, 21, 50, 1000, 10**6]
    got = [r.p for r in spark.createDataFrame([(n,) for n in ns], "n long").select(S.ln_factorial(F.col("n")).alias("p")).collect()]
    assert all(math.isclose(a, math.lgamma(n + 1), rel_tol=1e-12, abs_tol=1e-12) for a, n in zip(got, ns, strict=True))
    cases = [(a, n, k, pop) for pop, n, k in ((30, 12, 9), (60, 20, 30), (10, 3, 10), (25, 10, 1)) for a in range(0, min(n, k) + 1)]
    got = [r.p for r in spark.createDataFrame(cases, "a long, n long, k long, pop long").select(S.hypergeometric_tail(F.col("a"), F.col("n"), F.col("k"), F.col("pop")).alias("p")).collect()]
    for (a, n, k, pop), p in zip(cases, got, strict=True):
        want = sum(math.comb(k, x) * math.comb(pop - k, n - x) for x in range(a, min(n, k) + 1)) / math.comb(pop, n)
        assert math.isclose(p, want, rel_tol=1e-10)


def test_signature_test_by_hand(spark):
    # TC sites mutate in 8 of 12, CC and GC sites in 1 of 14; too few A sites to tell.
    ref = "TC" * 12 + "GC" * 14
    query = "TT" * 8 + "TC" * 4 + "GT" + "GC" * 13
    rows = {r.signature: r for r in D.signature_tests(D.context_counts(frame(spark, {"d": [ref, query]}), ["dataset_id", "seq_ord"])).collect()}
    ct = rows["ct"]
    assert (ct.hits, ct.sites, ct.other_hits, ct.other_sites) == (8, 12, 1, 14) and math.isclose(ct.odds_ratio, 8 * 13 / (4 * 1))
    want = sum(math.comb(9, x) * math.comb(17, 12 - x) for x in range(8, 10)) / math.comb(26, 12)
    assert math.isclose(ct.p_value, want) and ct.significant
    assert rows["ag"].p_value is None and rows["ag"].significant is None


def test_bands(spark):
    cases = [("pi", 0.0005, "Acute outbreak"), ("pi", 0.00051, "Established outbreak"), ("MB", 5.4, "Within-household transmission"), ("MB", 5.5, "Community chain (1-2 weeks)"), ("GD", 9.0, "Highly divergent"), ("dN/dS", 1.0, "neutral"), ("dN/dS", None, None), ("mu", 1e-4, "High-fidelity")]
    got = [r.b for r in spark.createDataFrame([(k, v) for k, v, _ in cases], "key string, value double").select(bands.index_band(F.col("key"), F.col("value")).alias("b")).collect()]
    assert got == [b for *_, b in cases]
    names = ["Spike glycoprotein", "RdRp", "NP", "orf1", "Envelope", "3CLpro protease"]
    kinds = [r.k for r in spark.createDataFrame([(n,) for n in names], "g string").select(bands.gene_kind(F.col("g")).alias("k")).collect()]
    assert kinds == ["Spike / Surface", "RNA Polymerase", "Nucleocapsid", None, "Envelope", "Protease"]
    assert spark.range(1).select(bands.band(F.lit(2e-7), "mu, DNA")).first()[0] == "Lower-fidelity DNA / larger indel tolerance"


def test_gate_of_dna_rates_and_exclusions(spark):
    ix = spark.createDataFrame([("a", "mu", 2e-4), ("b", "mu", 2e-4), ("a", "pi", 0.1), ("a", "GD", None)], "dataset_id string, key string, value double")
    ev = spark.createDataFrame([(d, 0.0, 0.0, 0.9, 2e-4, 0.5, "neutral", g) for d, g in (("a", "DNA"), ("b", "RNA"))], "dataset_id string, gap_fraction double, burden_share double, r2 double, mu double, omega double, verdict string, genome string")
    gated = M.gate(ix, ev)
    assert {(r.dataset_id, r.key): r.excluded for r in gated.collect()} == {("a", "mu"): "rate implausible for a DNA genome", ("b", "mu"): None, ("a", "pi"): None, ("a", "GD"): None}
    causes = {(r.dataset_id, r.cause): set(r["keys"]) for r in M.exclusions(gated).collect()}
    assert causes["a", "rate implausible for a DNA genome"] == {"mu"} and "GD" in causes["a", "not computed"] and "pi" not in causes["a", "not computed"]
    fit = M.fit_error(spark.createDataFrame([("x", 1.0, 2.0), ("x", 0.0, 0.0), ("x", None, 1.0)], "k string, a double, b double"), ["k"], "a", "b").first()
    assert (fit.n, fit.sse) == (2, 1.0) and math.isclose(fit.rmse, math.sqrt(0.5))


def test_growth_age_and_frequencies(spark):
    w = E.serial_interval()
    rates = [0.0, 0.1, -0.05]
    got = [r.x for r in spark.createDataFrame([(r,) for r in rates], "r double").select(E.growth_reproduction(F.col("r")).alias("x")).collect()]
    assert all(math.isclose(x, 1 / sum(p * math.exp(-r * u) for u, p in enumerate(w, 1))) for x, r in zip(got, rates, strict=True))
    burden = spark.createDataFrame([("a", 4), ("a", 6), ("b", 5), ("c", 5)], "dataset_id string, burden int")
    clock = spark.createDataFrame([("a", 1e-3), ("b", -1e-3), ("c", None)], "dataset_id string, mu double")
    lengths = spark.createDataFrame([(d, 1000) for d in "abc"], "dataset_id string, length int")
    assert {r.dataset_id: r.weeks for r in D.outbreak_age(burden, clock, lengths).collect()} == {"a": pytest.approx(5 * 52.1775), "b": None, "c": None}
    al = frame(spark, {"d": ["ACGACG", "ACGATG"]})
    shares = {(r.codon_position, r.base): r.share for r in C.codon_positions(al).collect()}
    assert len(shares) == 12 and math.isclose(shares[2, "T"], 0.25, rel_tol=1e-6) and math.isclose(shares[1, "C"], 1e-8, rel_tol=1e-6)
    freq = {r.codon: r.share for r in C.codon_frequencies(C.codon_positions(al)).collect()}
    p = {c: math.prod(shares[i + 1, b] for i, b in enumerate(c)) for c in G.SENSE}
    assert len(freq) == 61 and all(math.isclose(freq[c], p[c] / sum(p.values()), rel_tol=1e-9) for c in p)


def test_substitution_counts_against_pairs(spark):
    from strandwise.operators import alignment as A

    seqs = ["ACGTN", "ACTT-", "CCGAA", "A-GTA"]
    want = {}
    for x, y in itertools.combinations(seqs, 2):
        for a, b in zip(x, y, strict=True):
            if a in "ACGT" and b in "ACGT":
                want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
    got = {(r.a, r.b): r.n_pairs for r in D.substitution_counts(A.site_counts(frame(spark, {"d": seqs}))).collect()}
    assert {k: v for k, v in got.items() if v} == want

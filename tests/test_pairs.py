"""What depends on every pair of records, against loops over all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import alignment as A
from strandwise.operators import pairs as R

SCHEMA = "dataset_id string, seq_ord long, sequence_id string, seq string, n string"


def records(n=60, width=40, seed=1):
    rnd = random.Random(seed)
    base = [rnd.choice("ACGT") for _ in range(width)]
    out = []
    for i in range(n):
        s = [rnd.choice("ACGT") if rnd.random() < 0.1 else c for c in base]
        a, b = sorted((rnd.randrange(width), rnd.randrange(width)))
        if i % 3 == 0:
            s[a:b] = ["-" if i % 2 else "N"] * (b - a)
        out.append("".join(s))
    return out + out[:7] + ["-" * width]


def frame(spark, data):
    return spark.createDataFrame([(d, i, f"{d}{i}", s, "x") for d, seqs in data.items() for i, s in enumerate(seqs)], SCHEMA)


DATA = {"a": records(), "b": records(9, seed=2), "one": ["ACGT"], "gaps": ["----", "----", "----"], "short": ["ACGTACGT", "ACGA", "AC"]}


def shares(seqs, columns=None):
    """(comparable, different) of every pair over ``columns``, each as often as it is listed."""
    for x, y in itertools.combinations(seqs, 2):
        both = [(x[k], y[k]) for k in (range(min(len(x), len(y))) if columns is None else columns) if k < min(len(x), len(y)) and x[k] in "ACGT" and y[k] in "ACGT"]
        yield len(both), sum(a != b for a, b in both)


def diversity(seqs, columns=None):
    p = [d / c for c, d in shares(seqs, columns) if c]
    return (len(p), sum(p) / len(p) if p else None)


@pytest.fixture(params=[2048, 16])
def blocks(request, monkeypatch):
    """Blocks of the usual size, and ones so small that datasets have several."""
    monkeypatch.setattr(R, "BLOCK_ROWS", request.param)


def test_diversity(spark, blocks):
    al = frame(spark, DATA).repartition(5)
    got = {r.dataset_id: (r.n_pairs, r.pi) for r in R.nucleotide_diversity(al).collect()}
    assert set(got) == set(DATA)
    for d, seqs in DATA.items():
        n, pi = diversity(seqs)
        assert got[d][0] == n and (got[d][1] is None if pi is None else math.isclose(got[d][1], pi, rel_tol=1e-9))


def test_interval_and_windows(spark, blocks):
    al = frame(spark, {k: DATA[k] for k in ("b", "one")})
    got = {r.dataset_id: r for r in R.diversity_interval(al, replicates=30).collect()}
    drawn = [diversity(DATA["b"], [k for k, n in enumerate(row) for _ in range(int(n))])[1] for row in R.resampled(40, range(30))]
    assert math.isclose(got["b"].low, np.percentile(drawn, 2.5)) and math.isclose(got["b"].high, np.percentile(drawn, 97.5))
    assert math.isclose(got["b"].pi, diversity(DATA["b"])[1]) and got["b"].n_valid == 30 and got["one"].low is None
    windows = {(r.dataset_id, r.start): (r.n_pairs, r.pi) for r in R.sliding_diversity(al).collect()}
    assert {s for d, s in windows if d == "b"} == {1, 6, 11, 16, 21}
    for (d, s), (n, pi) in windows.items():
        want = diversity(DATA[d], range(s - 1, s + 19))
        assert n == want[0] and math.isclose(pi, want[1])


def test_preflight(spark, blocks):
    al = frame(spark, DATA)
    got = {r.dataset_id: r for r in R.preflight(al, A.site_summary(al)).collect()}
    for d in ("a", "b", "gaps"):
        least = [1 - x / c for c, x in shares(DATA[d]) if c]
        assert math.isclose(got[d].min_identity, min(least, default=1.0), rel_tol=1e-6)
        spans = [(min(k), max(k)) for s in DATA[d] if (k := [i for i, c in enumerate(s) if c not in "-.?"])]
        poor = [max(0, min(b, e) - max(a, c) + 1) < 0.5 * min(b - a + 1, e - c + 1) for (a, b), (c, e) in itertools.combinations(spans, 2)]
        assert got[d].poor_overlap_fraction == (pytest.approx(sum(poor) / len(poor)) if poor else None)
    assert got["one"].min_identity is None and not got["one"].diverged


def test_lineages(spark, blocks):
    rnd = random.Random(4)
    roots = ["".join(rnd.choice("ACGT") for _ in range(60)) for _ in range(4)]
    seqs = []
    for i in range(80):
        s = list(roots[i % 4])
        s[rnd.randrange(60)] = rnd.choice("ACGT")
        seqs.append("".join(s))
    data = {"d": seqs, "two": ["ACGT", "ACGT"], "apart": ["AAAA", "CCCC", "GGGG", "----"]}
    got = {(r.dataset_id, r.seq_ord): (r.lineage, r.n_members) for r in R.lineages(frame(spark, data)).collect()}
    assert {got["d", i] for i in range(80)} == {(k, 20) for k in range(4)} and all(got["d", i][0] == i % 4 for i in range(80))
    assert ("two", 0) not in got
    # The record of gaps has no column in common with any, which counts as no distance, and so links all.
    assert {got["apart", i] for i in range(4)} == {(0, 4)}


def test_connected_chain(spark):
    edges = spark.createDataFrame([("d", i, i + 1) for i in range(300)] + [("e", 7, 3)], "dataset_id string, x long, y long").orderBy(F.rand(3))
    got = {(r.dataset_id, r.x): r.label for r in R.connected(edges).collect()}
    assert all(got["d", i] == 0 for i in range(301)) and got["e", 7] == got["e", 3] == 3


def test_examples_of_poor_overlap(spark):
    al = frame(spark, {"d": ["AAAA------", "-----AAAAA", "----------", "AAAAA-----", "------AAAA", "---AAAAAAA", "-------AAA"], "e": ["----", "ACGT"]})
    got = [(r.dataset_id, r.nth, r.seq_ord) for r in R.poor_overlap_examples(al, A.references(al)).orderBy("dataset_id", "nth").collect()]
    assert got == [("d", 1, 1), ("d", 2, 4), ("d", 3, 5)]

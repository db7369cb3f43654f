"""The standard genetic code and the tables that follow from it by rule."""

from __future__ import annotations

from functools import cache
from itertools import permutations, product

from pyspark.sql import DataFrame, SparkSession

#: Translation table 1, codons in the order of T, C, A, G.
ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODE = {"".join(c): aa for c, aa in zip(product(ORDER, repeat=3), AMINO_ACIDS, strict=True)}
SENSE = [c for c, aa in CODE.items() if aa != "*"]


@cache
def synonymous_sites(codon: str) -> float:
    """The sites of a codon whose changes keep the amino acid: a third for each of the nine neighbours that do."""
    near = (codon[:i] + b + codon[i + 1 :] for i in range(3) for b in ORDER if b != codon[i])
    return sum(CODE[n] == CODE[codon] for n in near) / 3


@cache
def differences(a: str, b: str) -> tuple[float, float]:
    """(synonymous, nonsynonymous) steps from codon to codon, averaged over the orders of the changes.

    Orders that pass through a stop are left out unless all do.
    """
    where = [i for i in range(3) if a[i] != b[i]]
    ways = []
    for order in permutations(where):
        at, steps, stops = a, [], 0
        for k, i in enumerate(order):
            then = at[:i] + b[i] + at[i + 1 :]
            stops += k < len(order) - 1 and CODE[then] == "*"
            steps.append(CODE[then] == CODE[at])
            at = then
        ways.append((stops, sum(steps), len(steps) - sum(steps)))
    kept = [w for w in ways if not w[0]] or ways
    return sum(w[1] for w in kept) / len(kept), sum(w[2] for w in kept) / len(kept)


def code_rows() -> list[tuple[str, str]]:
    return list(CODE.items())


def pair_rows() -> list[tuple[str, str, float, float, float]]:
    """(codon of the first, of the second, mean synonymous sites, synonymous, nonsynonymous differences) of all sense codons."""
    return [(a, b, (synonymous_sites(a) + synonymous_sites(b)) / 2, *differences(a, b)) for a in SENSE for b in SENSE]


def code_table(spark: SparkSession) -> DataFrame:
    """64 rows, whatever the data."""
    return spark.createDataFrame(code_rows(), "codon string, amino_acid string")


def pair_table(spark: SparkSession) -> DataFrame:
    """61 x 61 rows, whatever the data."""
    return spark.createDataFrame(pair_rows(), "ref_codon string, query_codon string, s_sites double, s_diff double, n_diff double")

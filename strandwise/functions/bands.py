"""Interpretation bands of the indices, and the composite's weights and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Index keys in order, weights before they are scaled to sum to 1, and normalisation ranges.
KEYS = ("mu", "Re", "pi", "MB", "dN/dS", "GD", "CAI", "GC_Deviation", "RI")
RAW_WEIGHTS = {"mu": 0.135, "Re": 0.30, "pi": 0.10, "MB": 0.215, "dN/dS": 0.15, "GD": 0.10, "CAI": 0.0275, "GC_Deviation": 0.0275, "RI": 0.035}
RANGES = {"mu": (0.0, 1e-2), "Re": (0.0, 3.0), "pi": (0.0, 0.02), "MB": (0.0, 100.0), "dN/dS": (0.0, 3.0), "GD": (0.0, 0.05), "CAI": (0.0, 1.0), "GC_Deviation": (0.0, 10.0), "RI": (0.0, 1.0)}
DNA_MU_RANGE = (0.0, 1e-4)
#: Weight that must be present for a composite to be comparable.
COMPARABLE = 0.60

WEIGHTS = {k: w / sum(RAW_WEIGHTS.values()) for k, w in RAW_WEIGHTS.items()}


#: Upper ends of the bands (ends included) and their names; the last has no end.
BANDS = {
    "mu": ((1e-4, "High-fidelity"), (1e-3, "RNA (moderate)"), (1e-2, "RNA (low-fidelity)"), (None, "Ultra high error")),
    "mu, DNA": ((1e-8, "High-fidelity dsDNA (proofreading)"), (1e-7, "Moderate-fidelity DNA"), (1e-6, "Lower-fidelity DNA / larger indel tolerance"), (1e-5, "Small ssDNA (no proofreading)"), (None, "Implausible for a DNA genome")),
    "Re": ((0.8, "Controlled"), (1.2, "Endemic"), (1.5, "Moderate growth"), (2.0, "High growth"), (None, "Pandemic")),
    "pi": ((0.0005, "Acute outbreak"), (0.005, "Established outbreak"), (0.02, "Endemic circulation"), (None, "Hyperendemic / highly recombinant")),
    "MB": ((5, "Within-household transmission"), (15, "Community chain (1-2 weeks)"), (40, "Established outbreak (months)"), (100, "Pandemic variant (6-18 months)"), (None, "Beyond reference table")),
    "GD": ((0.001, "Nearly identical"), (0.005, "Closely related"), (0.015, "Distinct lineage"), (0.05, "Divergent"), (None, "Highly divergent")),
    "CAI": ((0.50, "Unadapted"), (0.70, "Intermediate"), (0.80, "Adapted"), (None, "Optimized")),
    "GC_Deviation": ((1.0, "Native"), (3.0, "Minor drift"), (None, "Anomaly")),
    "RI": ((0.02, "Single-lineage outbreak"), (0.10, "Endemic multi-type circulation"), (0.30, "High co-circulation"), (None, "Extensive recombination / mosaic genomes")),
}
#: What a gene's name tells of its kind, the first match counts; and its usual selection.
GENE_KINDS = (
    ("RNA Polymerase", "Strong purifying", ("pol", "rdrp", "polymerase", "l gene")),
    ("Protease", "Moderate purifying", ("protease", "3clpro", "mpro", "nsp5")),
    ("Nucleocapsid", "Neutral-weak purifying", ("nucleocapsid", "capsid", "n gene", "nucleoprotein", "np")),
    ("Spike / Surface", "Positive (often) / relaxed", ("spike", "surface", "s gene", "hemagglutinin", "ha", "gp120", "env glycoprotein")),
    ("Envelope", "Positive", ("envelope", "e gene", "matrix")),
)
#: Fixed value: the largest credible rate of a DNA genome, per site and year.
MOST_DNA_RATE = 1e-5


def band(value: Column, key: str) -> Column:
    """The name of the first band whose upper end is not below ``value``; null for no value."""
    out = F.lit(BANDS[key][-1][1])
    for end, name in reversed(BANDS[key][:-1]):
        out = F.when(value <= end, name).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), out)


def index_band(key: Column, value: Column) -> Column:
    """The band of an index value by its key; a mean burden is rounded to a whole number first, and omega has its own three."""
    out = F.when(key == "dN/dS", omega_band(value)).when(key == "MB", band(F.floor(value + 0.5), "MB"))
    for k in BANDS:
        if k not in ("MB", "mu, DNA"):
            out = out.when(key == k, band(value, k))
    return out


def gene_kind(gene: Column, what: int = 0) -> Column:
    """The kind of a gene (or, for 1, its usual selection) by the words its name contains; null if none."""
    out = F.lit(None).cast("string")
    for row in reversed(GENE_KINDS):
        holds = [F.contains(F.lower(gene), F.lit(w)) for w in row[2]]
        anyof = holds[0]
        for h in holds[1:]:
            anyof = anyof | h
        out = F.when(anyof, row[what]).otherwise(out)
    return out


def omega_band(omega: Column) -> Column:
    return F.when(omega < 0.95, "purifying").when(omega <= 1.05, "neutral").when(omega.isNotNull(), "positive")


def normalised(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))

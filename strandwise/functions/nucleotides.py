"""Expressions over aligned nucleotide strings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four bases, what counts as a gap, ambiguity letters and their complements.
BASES = "ACGT"
GAPS = "-.?"
IUPAC, COMPLEMENT = "ACGTURYWSKMBVDH", "TGCAAYRWSMKVBHD"


def letters(sequence: Column) -> Column:
    return F.split(sequence, "")


def count_of(sequence: Column, chars: str) -> Column:
    """How many characters of ``sequence`` are among ``chars``."""
    return F.length(sequence) - F.length(F.translate(sequence, chars, ""))


def site_pairs(a: Column, b: Column) -> Column:
    """The two-letter strings of the columns of two aligned sequences."""
    return F.zip_with(letters(a), letters(b), lambda x, y: F.concat(x, y))


def pair_states(a: Column, b: Column) -> Column:
    """One letter per column: = same base, s transition, v transversion, I/D gap in the first/second only, others '.'."""
    purine, pyrimidine = ("AG", "GA"), ("CT", "TC")
    gap = lambda x: x.isin(*GAPS)
    base = lambda x: x.isin(*BASES)

    def state(x: Column, y: Column) -> Column:
        return (
            F.when(base(x) & base(y), F.when(x == y, "=").when(F.concat(x, y).isin(*purine, *pyrimidine), "s").otherwise("v"))
            .when(gap(x) & gap(y), "G")
            .when(gap(x), "I")
            .when(gap(y), "D")
            .otherwise(".")
        )

    return F.array_join(F.zip_with(letters(a), letters(b), state), "")


def reverse_complement(sequence: Column) -> Column:
    """IUPAC-aware; whatever has no complement, gaps too, becomes N."""
    return F.reverse(F.translate(F.regexp_replace(sequence, f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT))


def codons(sequence: Column) -> Column:
    """Codons from the first base on; one or two trailing bases are dropped."""
    n = F.floor(F.length(sequence) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(sequence, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def jukes_cantor(p: Column) -> Column:
    """-3/4 ln(1 - 4p/3); p itself where that is saturated."""
    arg = 1 - p * 4 / 3
    return F.when(arg <= 0, p).when(arg > 0, F.abs(F.log(F.when(arg > 0, arg).otherwise(1.0)) * -0.75))


def kimura(ts: Column, tv: Column) -> Column:
    """K80 from the shares of transitions and transversions; their sum where saturated."""
    a, b = 1 - ts * 2 - tv, 1 - tv * 2
    safe = lambda x: F.log(F.when(x > 0, x).otherwise(1.0))
    return F.when((a <= 0) | (b <= 0), ts + tv).when((a > 0) & (b > 0), F.abs(safe(a) * -0.5 - safe(b) * 0.25))


def decimal_year(day: Column) -> Column:
    y = F.year(day)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return y + (F.dayofyear(day) - 1) / F.when(leap, 366.0).otherwise(365.0)


def partial_date(text: Column) -> tuple[Column, Column]:
    """(date, precision) of yyyy-MM-dd, yyyy-MM (mid-month) or yyyy (mid-year); null and 'none' for anything else."""
    full = F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
    first = F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
    month = F.date_add(first, F.floor(F.dayofmonth(F.last_day(first)) / 2).cast("int"))
    start = F.when(text.rlike(r"\A[0-9]{4}\z"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
    days = F.datediff(F.add_months(start, 12), start)
    year = F.date_add(start, F.floor(days / 2).cast("int"))
    return F.coalesce(full, month, year), F.when(full.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year").otherwise("none")

"""The weighted composite of the indices: coverage, sensitivity, quality gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.bands import COMPARABLE, MOST_DNA_RATE, RANGES, WEIGHTS, normalised


#: Share of date shuffles from which a clock is by chance.
MOST_P = 0.05


def _scheme(df: DataFrame, weights: Mapping[str, float], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Weights and ranges as a table of nine rows."""
    total = sum(weights.values())
    return F.broadcast(df.sparkSession.createDataFrame([(k, float(w / total), *map(float, ranges[k])) for k, w in weights.items() if w > 0], "key string, weight double, low double, high double"))


def components(indices: DataFrame, weights: Mapping[str, float] = WEIGHTS, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """(dataset_id, key, value, weight, effective_weight, normalised, contribution, at_ceiling) from (dataset_id, key, value).

    Keys without weight and null values are left out; the weights of the others are scaled to sum to 1 in each dataset.
    """
    have = indices.where(F.col("value").isNotNull() & ~F.isnan("value")).join(_scheme(indices, weights, ranges), "key")
    totals = have.groupBy("dataset_id").agg(F.sum("weight").alias("present"))
    scaled = have.join(totals, "dataset_id").withColumn("effective_weight", F.col("weight") / F.col("present")).withColumn("normalised", normalised(F.col("value"), F.col("low"), F.col("high")))
    return scaled.select("dataset_id", "key", "value", "weight", "effective_weight", "normalised", (F.col("effective_weight") * F.col("normalised")).alias("contribution"), (F.col("value") >= F.col("high")).alias("at_ceiling"))


def composite(parts: DataFrame) -> DataFrame:
    """Per dataset: the score, the configured weight that is present, whether that makes it comparable, indices, indices at their ceiling."""
    return parts.groupBy("dataset_id").agg(F.sum("contribution").alias("gvi"), F.sum("weight").alias("coverage"), F.count("*").alias("n_indices"), F.count_if("at_ceiling").alias("n_at_ceiling")).withColumn("comparable", F.col("coverage") >= COMPARABLE)


def sensitivity(indices: DataFrame, share: float = 0.2, weights: Mapping[str, float] = WEIGHTS, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """(dataset_id, key, low, high): the score when one index's weight changes by ``share`` either way and the others make up for it in proportion.

    All nine weights are perturbed, unavailable ones too, before those present are scaled again.
    """
    total = sum(weights.values())
    w = {k: v / total for k, v in weights.items()}
    rows = []
    for key in w:
        for sign in (-1, 1):
            target = w[key] * (1 + sign * share)
            others = 1 - w[key]
            moved = {k: max(0.0, v - (target - w[key]) * v / others) if k != key else target for k, v in w.items()}
            scale = sum(moved.values())
            rows += [(key, sign, k, float(v / scale)) for k, v in moved.items()]
    moved = F.broadcast(indices.sparkSession.createDataFrame(rows, "changed string, sign int, key string, new_weight double"))  # 162 rows
    have = components(indices, weights, ranges).select("dataset_id", "key", "normalised")
    scores = have.join(moved, "key").groupBy("dataset_id", "changed", "sign").agg((F.sum(F.col("new_weight") * F.col("normalised")) / F.sum("new_weight")).alias("score"))
    present = have.select("dataset_id", F.col("key").alias("changed"))
    return scores.join(present, ["dataset_id", "changed"], "left_semi").groupBy("dataset_id", F.col("changed").alias("key")).agg(F.min("score").alias("low"), F.max("score").alias("high"))


def preferred_clock(pairwise: DataFrame, tree: DataFrame) -> DataFrame:
    """(dataset_id, mu, r2, p_value): the tree's clock, or the pairwise one where no tree was computed."""
    cols = ["dataset_id", "mu", "r2", "p_value"]
    computed = tree.where("status = 'computed'").select(cols)
    others = pairwise.join(computed, "dataset_id", "left_anti")
    return computed.unionByName(others.select(cols))


def gate(indices: DataFrame, evidence: DataFrame) -> DataFrame:
    """``indices`` with the reason why one is kept out of the composite, null if it is not.

    ``evidence`` has one row per dataset: gap_fraction, burden_share (mean burden over length), r2, mu, omega, verdict, p_value of the date shuffles if there
    were any, and genome (``DNA`` or other) if it is known; null evidence excludes nothing.
    The first reason that applies counts.
    """
    poor = (F.col("gap_fraction") >= 0.15) | (F.col("burden_share") >= 0.15)
    by_alignment = F.col("key").isin("MB", "GD", "dN/dS", "pi", "mu")
    is_mu = F.col("key") == "mu"
    by_chance = F.col("p_value") >= MOST_P if "p_value" in evidence.columns else F.lit(False)
    too_fast = (F.col("genome") == "DNA") & (F.col("mu") > MOST_DNA_RATE) if "genome" in evidence.columns else F.lit(False)
    reason = (
        F.when(by_alignment & poor, "alignment")
        .when(is_mu & by_chance, "dates no better than shuffled")
        .when(is_mu & (F.col("mu") <= 0), "rate not positive")
        .when(is_mu & (F.col("r2") < 0.30), "weak clock signal")
        .when(is_mu & too_fast, "rate implausible for a DNA genome")
        .when((F.col("key") == "dN/dS") & (F.col("omega") > 1) & (F.col("verdict") != "positive"), "selection not significant")
    )
    return indices.join(evidence, "dataset_id", "left").select(indices["dataset_id"], "key", "value", reason.alias("excluded"))


def exclusions(gated: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """(dataset_id, cause, keys): the weighted indices that the composite lacks, by cause: excluded by the gate, or ``not computed``."""
    have = gated.where(F.col("value").isNotNull() & ~F.isnan("value")).select("dataset_id", "key", "excluded")
    listed = gated.select("dataset_id").distinct().select("dataset_id", F.explode(F.lit([k for k, w in weights.items() if w > 0])).alias("key"))
    lacking = listed.join(have.where("excluded is null"), ["dataset_id", "key"], "left_anti").join(have, ["dataset_id", "key"], "left")
    return lacking.groupBy("dataset_id", F.coalesce("excluded", F.lit("not computed")).alias("cause")).agg(F.array_sort(F.collect_list("key")).alias("keys"))


def fit_error(pairs: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    """Per ``keys``: pairs with both values, their sum of squared differences and the root of its mean."""
    gap = F.col(score) - F.col(target)
    return pairs.where(gap.isNotNull() & ~F.isnan(gap)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(gap * gap).alias("sse"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def beta_genomic(parts: DataFrame, beta0: float = 1.0, scale: float = 2.0) -> DataFrame:
    """Per dataset: beta0 (1 + scale * score without Re)."""
    others = parts.where("key <> 'Re'")
    return others.groupBy("dataset_id").agg((beta0 * (1 + F.sum(F.col("weight") * F.col("normalised")) / F.sum("weight") * scale)).alias("beta"))

"""What depends on every pair of an alignment's records, worked out block against block: no pair is ever a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.session import checkpointed, ship_package

#: Bytes that the rows of a block take up as numbers, and rows of a block, at most.
BLOCK_BYTES, BLOCK_ROWS = 64 << 20, 2048
#: Replicates of one resampling, and level of the interval.
REPLICATES, LEVEL, SEED = 1000, 0.95, 43
#: Fixed: identity and share of covered columns that one locus should have; span overlap of a pair that is poor, and share of poor pairs that is reported; p-distance within a lineage.
LEAST_IDENTITY, LEAST_COVERED, POOR_OVERLAP, POOR_SHARE, LINEAGE = 0.70, 0.60, 0.5, 0.15, 0.05
BASES = np.frombuffer(b"ACGT", np.uint8)


def block_pairs(rows: DataFrame, width: Column, parts: int = 1) -> DataFrame:
    """``rows`` (dataset_id, h, ...) copied to every pair of blocks (_a, _b) that their own block is in.

    A dataset has as many blocks as its rows need; rows go to blocks by their hash ``h``.  ``_left`` tells whose
    side of the pair a copy is on.  Where a dataset has few pairs of blocks, they are repeated in up to ``parts`` parts (_part of _parts).
    """
    each = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (F.greatest(width, F.lit(1)) * 16))))
    blocks = rows.groupBy("dataset_id").agg(F.ceil(F.count("*") / F.min(each)).alias("_blocks"))
    parts_of = F.greatest(F.lit(1), F.ceil(F.lit(parts) / (F.col("_blocks") * F.col("_blocks")))).cast("int")
    own = rows.join(blocks, "dataset_id").withColumn("_own", F.pmod("h", "_blocks")).withColumn("_parts", parts_of)
    copies = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return copies.select(*rows.columns, F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), (F.col("_own") <= F.col("_other")).alias("_left"), "_part", "_parts")


def mask_classes(alignment: DataFrame) -> DataFrame:
    """(dataset_id, length, n, counts, h): records that have bases in the same columns, added up in each task.

    ``counts`` holds how many of the n records have A, C, G, T in each column, as little-endian 32-bit numbers.
    """
    ship_package(alignment.sparkSession)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes, int], tuple[int, np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(d, length, n, c.astype("<u4").tobytes()) for (d, _, length), (n, c) in held.items()]
            return pa.RecordBatch.from_pylist([dict(zip(("dataset_id", "length", "n", "counts"), r, strict=True)) for r in rows], SCHEMA)

        for batch in batches:
            for d, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hot = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)[None, :] == BASES[:, None]
                key = d, np.packbits(hot.any(axis=0)).tobytes(), hot.shape[1]
                if key in held:
                    n, counts = held[key]
                    counts += hot
                    held[key] = n + 1, counts
                else:
                    held[key] = 1, hot.astype(np.int64)
                    size += hot.size * 9
            if size > BLOCK_BYTES:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    classes = alignment.select("dataset_id", "seq").mapInArrow(add_up, "dataset_id string, length int, n long, counts binary")
    return classes.withColumn("h", F.xxhash64("counts", "n", F.spark_partition_id()))


SCHEMA = pa.schema([("dataset_id", pa.string()), ("length", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])


def _matrix(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, counts by column and base) of classes, shorter ones filled up with nothing."""
    counts = np.zeros((rows.num_rows, 4, width))
    for i, c in enumerate(rows.column("counts")):
        own = np.frombuffer(c.as_buffer(), "<u4").reshape(4, -1)
        counts[i, :, : own.shape[1]] = own
    return rows.column("n").to_numpy().astype(np.float64), counts


def pair_sums(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the pairs' shares of different bases, pairs with a common column) under each row of column weights.

    Of two classes the number of comparable columns is one number, and their pairs' differences follow from the base counts.
    Without ``right``, the pairs within ``left``.
    """
    (n, c), (m, d) = left, right or left
    v, w = (c.sum(axis=1) > 0).astype(np.float64), (d.sum(axis=1) > 0).astype(np.float64)
    flat, other = c.reshape(len(c), -1), d.reshape(len(d), -1)
    of = np.outer(n, m)
    own = np.arange(len(n))
    if right is None:
        of[own, own] -= n
    totals, pairs = np.zeros(len(weights)), np.zeros(len(weights))
    for k, x in enumerate(weights):
        comparable = (v * x) @ w.T
        same = (flat * np.tile(x, 4)) @ other.T
        if right is None:
            # Within a class, a record is no pair with itself.
            same[own, own] -= n * comparable[own, own]
        ok = comparable > 0
        totals[k] = ((of * comparable - same)[ok] / comparable[ok]).sum()
        pairs[k] = of[ok].sum()
    return (totals / 2, pairs / 2) if right is None else (totals, pairs)


def _diversities(alignment: DataFrame, weights: Callable[[int, int, int], tuple[np.ndarray, np.ndarray]], parts: int = 1) -> DataFrame:
    """(dataset_id, k, total, pairs) of each row of weights; ``weights`` gives (their numbers, the weights) for a width, a part and the number of parts."""
    classes = block_pairs(mask_classes(alignment), F.col("length"), parts)

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dataset, a, b, part, parts_ = (x.as_py() for x in key)
        width = table.column("widest")[0].as_py()
        numbers, w = weights(width, part, parts_)
        side = table.column("_left").to_numpy(zero_copy_only=False)
        if a == b:
            total, pairs = pair_sums(_matrix(table, width), None, w)
        elif side.all() or not side.any():
            total = pairs = np.zeros(len(w))
        else:
            total, pairs = pair_sums(_matrix(table.filter(pa.array(side)), width), _matrix(table.filter(pa.array(~side)), width), w)
        return pa.table({"dataset_id": pa.array([dataset] * len(w), pa.string()), "k": pa.array(numbers, pa.int32()), "total": total, "pairs": pairs})

    widest = alignment.groupBy("dataset_id").agg(F.max(F.length("seq")).alias("widest"))
    ready = classes.join(widest, "dataset_id").select("dataset_id", "_a", "_b", "_part", "_parts", "_left", "n", "counts", "widest")
    sums = ready.groupBy("dataset_id", "_a", "_b", "_part", "_parts").applyInArrow(kernel, "dataset_id string, k int, total double, pairs double")
    return sums.groupBy("dataset_id", "k").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def nucleotide_diversity(alignment: DataFrame) -> DataFrame:
    """(dataset_id, n_pairs, pi): the mean over pairs of records of their share of different bases, of pairs with a common column.

    Records are added up to classes, classes cut into blocks, and each pair of blocks is one task, however large a dataset is.
    Datasets with one record have no pair and a null mean.
    """
    sums = _diversities(alignment, lambda width, part, parts: (np.zeros(1, np.int32), np.ones((1, width))))
    return sums.select("dataset_id", F.round("pairs").cast("bigint").alias("n_pairs"), F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).alias("pi"))


def resampled(width: int, replicates: range, seed: int = SEED) -> np.ndarray:
    """How often each column is drawn in each replicate; the same whatever the task."""
    return np.stack([np.random.default_rng([seed, r]).multinomial(width, np.full(width, 1 / width)) for r in replicates]).astype(np.float64)


def diversity_interval(alignment: DataFrame, replicates: int = REPLICATES, level: float = LEVEL) -> DataFrame:
    """(dataset_id, pi, low, high, n_valid): diversity with the percentile interval of column resampling; null with fewer than two valid replicates."""

    def weights(width: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        own = range(part * replicates // parts, (part + 1) * replicates // parts)
        numbers = [-1, *own] if part == 0 else list(own)
        drawn = resampled(width, own) if len(own) else np.zeros((0, width))
        return np.array(numbers, np.int32), np.vstack([np.ones((1, width)), drawn]) if part == 0 else drawn

    sums = _diversities(alignment, weights, 20).withColumn("pi", F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")))
    drawn = F.when(F.col("k") >= 0, F.col("pi"))
    ends = sums.groupBy("dataset_id").agg(F.max(F.when(F.col("k") < 0, F.col("pi"))).alias("pi"), F.percentile(drawn, (1 - level) / 2).alias("low"), F.percentile(drawn, (1 + level) / 2).alias("high"), F.count(drawn).alias("n_valid"))
    return ends.select("dataset_id", "pi", *[F.when(F.col("n_valid") >= 2, F.col(c)).alias(c) for c in ("low", "high")], "n_valid")


def sliding_diversity(alignment: DataFrame, size: int | None = None, step: int | None = None) -> DataFrame:
    """(dataset_id, start, n_pairs, pi): diversity in windows of columns (1-based start); windows that do not fit are left out.

    Unless given, a window has a twelfth of the columns, at least 20, and a step a quarter of the window, at least 5.
    """

    def weights(width: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        wide = size or max(20, (2 * width + 12) // 24)
        starts = np.arange(0, width - wide + 1, step or max(5, (wide + 2) // 4))[part::parts]
        at = np.arange(width)
        return starts.astype(np.int32), ((at >= starts[:, None]) & (at < starts[:, None] + wide)).astype(np.float64)

    sums = _diversities(alignment, weights, 8)
    return sums.select("dataset_id", (F.col("k") + 1).alias("start"), F.round("pairs").cast("bigint").alias("n_pairs"), F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).alias("pi"))


def distinct_records(alignment: DataFrame) -> DataFrame:
    """(dataset_id, seq, first_ord, n, h): equal records once, with the first place and their number."""
    return alignment.groupBy("dataset_id", "seq").agg(F.min("seq_ord").alias("first_ord"), F.count("*").alias("n")).withColumn("h", F.xxhash64("seq"))


def _blocks_of(table: pa.Table) -> list[dict[str, np.ndarray]]:
    side = table.column("_left").to_numpy(zero_copy_only=False)
    width = max(map(len, table.column("seq").to_pylist()))
    out = []
    for part in (table.filter(pa.array(side)), table.filter(pa.array(~side))):
        text = np.frombuffer(b"".join(s.encode("latin-1", "replace").ljust(width, b"-") for s in part.column("seq").to_pylist()), np.uint8).reshape(part.num_rows, width)
        hot = (text[:, None, :] == BASES[:, None]).astype(np.float32)
        solid = ~np.isin(text, np.frombuffer(b"-.?", np.uint8))
        some = solid.any(axis=1)
        out.append({"ord": part.column("first_ord").to_numpy(), "n": part.column("n").to_numpy(), "hot": hot.reshape(len(text), 4 * width), "valid": hot.sum(axis=1), "some": some, "lo": np.where(some, solid.argmax(axis=1), 0), "hi": np.where(some, width - 1 - solid[:, ::-1].argmax(axis=1), -1)})
    return out


def pair_extremes(alignment: DataFrame) -> DataFrame:
    """(dataset_id, min_identity, n_spanning, n_poor): the least identity of two records with a common column, pairs of records with bases, and those whose spans overlap poorly.

    Null identity without such a pair.  Spans go from a record's first to its last character that is no gap; poor is an overlap of
    less than half of the shorter span.
    """
    ship_package(alignment.sparkSession)

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dataset, a, b = (x.as_py() for x in key[:3])
        left, right = _blocks_of(table)
        if a == b:
            right = left
        comparable, same = left["valid"] @ right["valid"].T, left["hot"] @ right["hot"].T
        of = np.outer(left["n"] * left["some"], right["n"] * right["some"]).astype(np.float64)
        if a == b:
            np.fill_diagonal(comparable, 0)
            np.fill_diagonal(of, left["n"] * (left["n"] - 1) * left["some"])
        overlap = np.maximum(0, np.minimum.outer(left["hi"], right["hi"]) - np.maximum.outer(left["lo"], right["lo"]) + 1)
        shorter = np.minimum.outer(left["hi"] - left["lo"], right["hi"] - right["lo"]) + 1
        ok = comparable > 0
        half = 2.0 if a == b else 1.0
        least = float((same[ok].astype(np.float64) / comparable[ok]).min()) if ok.any() else None
        return pa.table({"dataset_id": [dataset], "least": pa.array([least], pa.float64()), "spanning": [of.sum() / half], "poor": [of[overlap < POOR_OVERLAP * shorter].sum() / half]})

    ready = block_pairs(distinct_records(alignment), F.length("seq")).select("dataset_id", "_a", "_b", "_left", "seq", "first_ord", "n")
    parts = ready.groupBy("dataset_id", "_a", "_b").applyInArrow(kernel, "dataset_id string, least double, spanning double, poor double")
    return parts.groupBy("dataset_id").agg(F.min("least").alias("min_identity"), F.round(F.sum("spanning")).cast("bigint").alias("n_spanning"), F.round(F.sum("poor")).cast("bigint").alias("n_poor"))


def preflight(alignment: DataFrame, sites: DataFrame) -> DataFrame:
    """Per dataset: records, least pairwise identity, share of columns in which all have a base, share of poor overlaps, and a finding for each that is out of line.

    ``sites`` is ``site_summary`` of the alignment.  Identity needs two records, overlap three.
    """
    n = alignment.groupBy("dataset_id").agg(F.count("*").alias("n_sequences"))
    both = n.join(pair_extremes(alignment), "dataset_id").join(sites.select("dataset_id", "n_columns", "n_covered"), "dataset_id")
    identity = F.when(F.col("n_sequences") >= 2, F.coalesce("min_identity", F.lit(1.0)))
    poor = F.when((F.col("n_sequences") >= 3) & (F.col("n_spanning") > 0), F.col("n_poor") / F.col("n_spanning"))
    out = both.select("dataset_id", "n_sequences", identity.alias("min_identity"), (F.col("n_covered") / F.col("n_columns")).alias("covered_fraction"), poor.alias("poor_overlap_fraction"))
    return out.select(
        "*", F.coalesce(F.col("min_identity") < LEAST_IDENTITY, F.lit(False)).alias("diverged"), (F.col("covered_fraction") < LEAST_COVERED).alias("uncovered"),
        F.coalesce(F.col("poor_overlap_fraction") >= POOR_SHARE, F.lit(False)).alias("poorly_overlapping"),
    )


def lineage_edges(alignment: DataFrame, limit: float = LINEAGE) -> DataFrame:
    """(dataset_id, x, y) that link records, by the first place of their text, as distances under ``limit`` do: of each pair of blocks at most one link a record."""
    ship_package(alignment.sparkSession)

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dataset, a, b = (x.as_py() for x in key[:3])
        left, right = _blocks_of(table)
        if a == b:
            right = left
        comparable, same = left["valid"] @ right["valid"].T, left["hot"] @ right["hot"].T
        # Without a common column the distance counts as none.
        near = (comparable - same) < limit * comparable
        near |= comparable == 0
        nodes = left["ord"] if a == b else np.concatenate([left["ord"], right["ord"]])
        shift = 0 if a == b else len(left["ord"])
        label = np.arange(len(nodes))
        while True:
            # The least label of all neighbours, and then of theirs.
            rows, cols = label[: len(left["ord"])], label[shift:]
            new = label.copy()
            np.minimum(new[: len(rows)], np.where(near, cols[None, :], len(nodes)).min(axis=1, initial=len(nodes)), out=new[: len(rows)])
            np.minimum(new[shift:], np.where(near, rows[:, None], len(nodes)).min(axis=0, initial=len(nodes)), out=new[shift:])
            new = new[new]
            if (new == label).all():
                break
            label = new
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"dataset_id": pa.array([dataset] * len(linked), pa.string()), "x": pa.array(nodes[linked], pa.int64()), "y": pa.array(nodes[label[linked]], pa.int64())})

    ready = block_pairs(distinct_records(alignment), F.length("seq")).select("dataset_id", "_a", "_b", "_left", "seq", "first_ord", "n")
    return ready.groupBy("dataset_id", "_a", "_b").applyInArrow(kernel, "dataset_id string, x long, y long")


def connected(edges: DataFrame) -> DataFrame:
    """(dataset_id, x, label): the least member that each linked member reaches, by minimum labels until none changes."""
    both = checkpointed(edges.unionByName(edges.select("dataset_id", F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(both.groupBy("dataset_id", "x").agg(F.least(F.min("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels.select("dataset_id", F.col("x").alias("y"), "label"), ["dataset_id", "y"]).groupBy("dataset_id", "x").agg(F.min("label").alias("near"))
        step = labels.join(near, ["dataset_id", "x"]).select("dataset_id", "x", "label", F.least("label", "near").alias("new"))
        # And the label's own label, which halves the way.
        jump = step.join(labels.select("dataset_id", F.col("x").alias("new"), F.col("label").alias("far")), ["dataset_id", "new"], "left")
        new = checkpointed(jump.select("dataset_id", "x", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        if not new.where("new <> label").limit(1).count():
            return labels
        labels = new.select("dataset_id", "x", F.col("new").alias("label"))


def lineages(alignment: DataFrame, limit: float = LINEAGE) -> DataFrame:
    """(dataset_id, seq_ord, sequence_id, lineage, n_members): records by single linkage of p-distances under ``limit``; a lineage is named by its first place.

    Datasets with fewer than three records have no lineages and are left out.
    """
    labels = connected(lineage_edges(alignment, limit))
    enough = alignment.groupBy("dataset_id").agg(F.count("*").alias("n")).where("n >= 3").select("dataset_id")
    first = distinct_records(alignment).select("dataset_id", "seq", F.col("first_ord").alias("x"))
    rows = alignment.join(enough, "dataset_id").join(first, ["dataset_id", "seq"]).join(labels, ["dataset_id", "x"], "left").select("dataset_id", "seq_ord", "sequence_id", F.coalesce("label", "x").alias("lineage"))
    return rows.join(rows.groupBy("dataset_id", "lineage").agg(F.count("*").alias("n_members")), ["dataset_id", "lineage"]).select("dataset_id", "seq_ord", "sequence_id", "lineage", "n_members")


def poor_overlap_examples(alignment: DataFrame, references: DataFrame, most: int = 3) -> DataFrame:
    """(dataset_id, nth, seq_ord, sequence_id): the first records whose span overlaps the reference's poorly, ``most`` of each dataset."""
    solid = lambda c: F.regexp_replace(c, "[-.?]+", "-")
    lo = lambda c: F.length(F.regexp_extract(c, r"^[-.?]*", 0))
    hi = lambda c: F.length(c) - F.length(F.regexp_extract(c, r"[-.?]*$", 0)) - 1
    rows = alignment.select("dataset_id", "seq_ord", "sequence_id", "seq").join(references, "dataset_id").where((F.col("seq_ord") != F.col("ref_ord")) & (solid(F.col("seq")) != "-") & (solid(F.col("ref")) != "-"))
    spans = rows.select("dataset_id", "seq_ord", "sequence_id", lo("seq").alias("a"), hi("seq").alias("b"), lo("ref").alias("c"), hi("ref").alias("d"))
    overlap = F.greatest(F.lit(0), F.least("b", "d") - F.greatest("a", "c") + 1)
    poor = spans.where(overlap < F.least(F.col("b") - F.col("a"), F.col("d") - F.col("c")) * POOR_OVERLAP + POOR_OVERLAP)
    nth = F.row_number().over(Window.partitionBy("dataset_id").orderBy("seq_ord"))
    return poor.withColumn("nth", nth).where(F.col("nth") <= most).select("dataset_id", "nth", "seq_ord", "sequence_id")



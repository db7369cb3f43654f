"""Filling containers of fixed capacity with texts, hierarchically over several context sizes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.session import checkpointed, ship_package

#: Pieces of one size that are numbered in one group.
GROUP = 50_000
#: Containers of a step, e.g. one per device.
STEP = 8
#: Different sizes of all profiles together that the driver plans with, at most; beyond, packing raises an error.
MOST_SIZES = 20_000_000


class Bins:
    """Equal bins and what goes into them, as runs of bins with the same content.

    The plan is as small for a billion items as for a million: every placement leaves a run with less than half its free
    space or uses up a size, which bounds the placements by the capacity times its logarithm.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, 0
        self.free: list[tuple[int, int, int, int]] = []  # free space, first bin, bins, cost

    def fill(self, size: int, rank: int, count: int, cost: int, places: list[tuple[int, ...]], opens: bool) -> int:
        """Put the items of one size from ``rank`` on into the smallest gaps that hold one, then into new bins if it ``opens`` any.

        Appends (first rank, items, first bin, items in each bin, offset in the bin) and returns the first rank that found no place.
        """
        while rank < count:
            at = bisect_left(self.free, (size, -1, -1, -1))
            if at < len(self.free):
                free, first, bins, spent = self.free.pop(at)
            elif opens:
                free, first, bins, spent = self.capacity, self.count, -(-(count - rank) // (self.capacity // size)), 0
                self.count += bins
            else:
                break
            each = free // size
            whole = min(bins, (count - rank) // each)
            parts = [(each, whole), (count - rank - each * whole, 1)] if whole < bins else [(each, whole)]
            for items, n in parts:
                if items and n:
                    places.append((rank, items * n, first, items, self.capacity - free))
                    insort(self.free, (free - items * size, first, n, spent + items * cost))
                    rank, first, bins = rank + items * n, first + n, bins - n
            if bins:
                insort(self.free, (free, first, bins, spent))
        return rank


class Plan:
    """Where the pieces of each size go, from the number of pieces of each size alone.

    Pieces are routed to tiers by size.  From long to short, the pieces of a tier first fill the gaps of the longer tiers' windows and
    the others are packed into windows of the tier's own size, best fit decreasing.  Then the windows, filled as they are, are
    the items that the containers take up, and last the pieces of the shortest tier fill the gaps that are left.
    ``tiered`` false packs the pieces straight into the containers.
    """

    def __init__(self, counts: dict[int, int], capacity: int, tiers: Sequence[int], tiered: bool = True) -> None:
        levels = sorted({t for t in tiers if t < capacity} | {capacity}) if tiered else [capacity]
        #: (size, first rank, pieces, level or 0 for the containers themselves, first bin, pieces in each bin, offset)
        self.places: list[tuple[int, ...]] = []
        #: Per level (first window, windows, first container, windows in each, offset, size).
        self.windows: dict[int, list[tuple[int, ...]]] = {}
        top = Bins(capacity)
        own = {t: Bins(t) for t in levels[1:-1]} | {capacity: top}
        late = []
        for level, below in zip(reversed(levels), [*reversed(levels[:-1]), 0], strict=True):
            for size in sorted((s for s in counts if below < s <= level), reverse=True):
                rank = 0
                for t in sorted((t for t in own if t > level), reverse=True):
                    rank = self._put(size, rank, counts[size], own[t], t if t < capacity else 0, False)
                if level in own:
                    self._put(size, rank, counts[size], own[level], level if level < capacity else 0, True)
                elif rank < counts[size]:
                    late.append((size, rank))
        runs = sorted(((t - free, t, first, n, cost) for t in own if t < capacity for free, first, n, cost in own[t].free), reverse=True)
        for size, t, first, n, cost in runs:
            places: list[tuple[int, ...]] = []
            top.fill(size, 0, n, cost, places, True)
            self.windows.setdefault(t, []).extend((first + rank, m, bin_, each, offset, size) for rank, m, bin_, each, offset in places)
        for size, rank in late:
            self._put(size, rank, counts[size], top, 0, True)
        self.containers, self.free = top.count, top.free

    def _put(self, size: int, rank: int, count: int, bins: Bins, level: int, opens: bool) -> int:
        places: list[tuple[int, ...]] = []
        rank = bins.fill(size, rank, count, size * size, places, opens)
        self.places += [(size, first, n, level, bin_, each, offset) for first, n, bin_, each, offset in places]
        return rank

    def steps(self) -> list[tuple[int, int, int]]:
        """(first container, containers, first place in the order of steps): containers by cost, so that each step's are alike."""
        out, place = [], 0
        for _, first, n in sorted((cost, first, n) for _, first, n, cost in self.free):
            out.append((first, n, place))
            place += n
        return out


def best_plan(counts: dict[int, int], capacity: int, tiers: Sequence[int]) -> Plan:
    """The plan by tiers, unless packing straight into the containers needs fewer."""
    tiered, straight = Plan(counts, capacity, tiers), Plan(counts, capacity, tiers, tiered=False)
    return tiered if tiered.containers <= straight.containers else straight


class Lookup:
    """A plan as sorted arrays, in which many pieces find their container at once."""

    def __init__(self, plan: Plan) -> None:
        rows = lambda x, n: np.array(sorted(x), np.int64).reshape(-1, n)
        self.places = rows(plan.places, 7)
        self.keys = (self.places[:, 0] << 40) + self.places[:, 1]
        self.windows = {t: rows(x, 6) for t, x in plan.windows.items()}
        self.steps = rows(plan.steps(), 3)

    def __call__(self, size: np.ndarray, rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(container, offset in it, step) of pieces of these sizes and ranks among their size."""
        at = self.places[np.searchsorted(self.keys, (size.astype(np.int64) << 40) + rank, "right") - 1]
        nth = rank - at[:, 1]
        container, offset = at[:, 4] + nth // at[:, 5], at[:, 6] + nth % at[:, 5] * at[:, 0]
        for level, windows in self.windows.items():
            own = np.flatnonzero(at[:, 3] == level)
            w = windows[np.searchsorted(windows[:, 0], container[own], "right") - 1]
            nth = container[own] - w[:, 0]
            container[own] = w[:, 2] + nth // w[:, 3]
            offset[own] += w[:, 4] + nth % w[:, 3] * w[:, 5]
        run = self.steps[np.searchsorted(np.sort(self.steps[:, 0]), container, "right") - 1]
        return container, offset, (run[:, 2] + container - run[:, 0]) // step


def pieces_of(sizes: DataFrame, profiles: list[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """(profile, key, piece, n_pieces, token_start, n_tokens): each text cut only where it exceeds the capacity; a text without tokens is one piece."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in profiles]))
    cut = sizes.select(key, "tokens", each.alias("x")).select(key, "tokens", "x.*").withColumn("n_pieces", F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int"))
    return cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))).select(
        "profile", key, "piece", "n_pieces", (F.col("piece") * F.col("capacity")).alias("token_start"), F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("n_tokens")
    )


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", step: int = STEP) -> DataFrame:
    """Every text of ``sizes`` (key, tokens) in containers of each capacity.

    Columns: profile, key, piece, n_pieces, token_start, n_tokens, tier (the smallest listed capacity that
    holds the piece), container_id, container_offset, step_id.  Within a profile, containers are
    numbered from 0 and hold at most its capacity.  Only texts larger than the capacity are split: into full containers and a rest.
    Texts without tokens need no room: they come out once per profile with a null container
    and 0 tokens.  Null and negative sizes count as 0.  Rows with the same key are packed one by one.

    Only the counts per profile and size go to the driver: at most the sum of the capacities, whatever the corpus, and an
    error says so where they are more than ``MOST_SIZES``.  It plans runs of like containers and puts containers of like
    cost (sum of squared lengths) into one step.  Pieces of a size are numbered in groups of a bounded size
    and look their place up in the plan.
    """
    profiles = [(r.profile, int(r.capacity_tokens)) for r in capacities.where(F.col("capacity_tokens") >= 1).select("profile", "capacity_tokens").distinct().orderBy("profile").limit(MOST_SIZES).collect()]
    if not profiles:
        raise ValueError("no capacity")
    if len({p for p, _ in profiles}) < len(profiles):
        raise ValueError("a profile has two capacities")
    tiers = sorted({c for _, c in profiles})
    kept = checkpointed(sizes.select(key, F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("tokens")))
    pieces = pieces_of(kept, profiles, key)
    filled = pieces.where("n_tokens > 0")
    counted = checkpointed(filled.groupBy("profile", "n_tokens").agg(F.count("*").alias("n")))
    counts: dict[str, dict[int, int]] = {p: {} for p, _ in profiles}
    found = counted.limit(MOST_SIZES + 1).collect()
    if len(found) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} different sizes")
    for r in found:
        counts[r.profile][r.n_tokens] = r.n
    spark = sizes.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast([Lookup(best_plan(counts[p], c, tiers)) for p, c in profiles])

    whole = ["profile", "n_tokens"]
    grouped = filled.join(counted.select(*whole, F.ceil(F.col("n") / GROUP).alias("_groups")), whole).withColumn("_group", F.pmod(F.xxhash64(key, "piece"), F.col("_groups"))).drop("_groups")
    before = Window.partitionBy(*whole).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = grouped.groupBy(*whole, "_group").count().select(*whole, "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*whole, "_group").orderBy(key, "piece")
    ranked = grouped.withColumn("_nth", F.row_number().over(own)).join(base, [*whole, "_group"]).withColumn("_rank", F.col("_base") + F.col("_nth") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            profile, size, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("_profile", "n_tokens", "_rank"))
            out = np.zeros((3, b.num_rows), np.int64)
            for p in np.unique(profile):
                rows = np.flatnonzero(profile == p)
                out[:, rows] = shared.value[int(p)](size[rows], rank[rows], step)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *map(pa.array, out)], names=[*names, "container_id", "container_offset", "step_id"])

    names = ["profile", key, "piece", "n_pieces", "token_start", "n_tokens"]
    ready = ranked.select(*names, "_rank", (F.array_position(F.lit([p for p, _ in profiles]), F.col("profile")) - 1).cast("int").alias("_profile"))
    schema = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes if n in names) + ", container_id long, container_offset long, step_id long"
    placed = ready.mapInArrow(place, schema)
    none = F.lit(None).cast("bigint")
    empty = pieces.where("n_tokens = 0").select(*names, none.alias("container_id"), none.alias("container_offset"), none.alias("step_id"))
    return placed.unionByName(empty).withColumn("tier", F.array_min(F.filter(F.lit(tiers).cast("array<int>"), lambda t: t >= F.col("n_tokens"))))


def pack_faults(packed: DataFrame, sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(profile, capacity_tokens, n_docs, n_overfull, n_overlaps, n_split, n_wrong): containers above capacity, pieces that begin inside another, needless splits, texts of which tokens lack or come twice."""
    caps = capacities.select("profile", F.col("capacity_tokens").alias("capacity"))
    held = packed.where(F.col("container_id").isNotNull()).join(caps, "profile")
    order = Window.partitionBy("profile", "container_id").orderBy("container_offset")
    ends = held.withColumn("_gap", F.col("container_offset") - F.coalesce(F.lag(F.col("container_offset") + F.col("n_tokens")).over(order), F.lit(0)))
    per = ends.groupBy("profile", "container_id").agg(F.max((F.col("container_offset") + F.col("n_tokens") > F.col("capacity")).cast("int")).alias("over"), F.count_if(F.col("_gap") < 0).alias("overlaps"))
    bins = per.groupBy("profile").agg(F.sum("over").cast("bigint").alias("n_overfull"), F.sum("overlaps").alias("n_overlaps"))
    texts = packed.groupBy("profile", key).agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n_rows"), F.max("n_pieces").alias("n_pieces")).join(sizes.select(key, F.coalesce("tokens", F.lit(0)).alias("tokens")), key, "full").join(caps, "profile", "left")
    docs = texts.groupBy("profile").agg(
        F.count("*").alias("n_docs"), F.count_if((F.col("n_pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("n_split"),
        F.count_if(~F.equal_null(F.col("held"), F.col("tokens")) | (F.col("n_rows") != F.col("n_pieces"))).alias("n_wrong"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return caps.join(docs, "profile", "left").join(bins, "profile", "left").select("profile", F.col("capacity").alias("capacity_tokens"), *map(zero, ("n_docs", "n_overfull", "n_overlaps", "n_split", "n_wrong")))


def pack_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per profile: containers, the fewest that could do, and the share of space used."""
    by = packed.where(F.col("container_id").isNotNull()).groupBy("profile").agg(F.sum("n_tokens").alias("tokens"), (F.max("container_id") + 1).alias("containers"), (F.max("step_id") + 1).alias("steps"))
    return by.join(capacities, "profile").select("profile", "capacity_tokens", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), "steps")

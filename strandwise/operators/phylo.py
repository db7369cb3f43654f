"""Recombination and clock tests by shuffles, and clocks on the trees of small datasets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import nucleotides as N
from strandwise.operators.alignment import site_profile
from strandwise.session import ship_package

#: Columns within which sites are compared, permutations, most taxa of a tree, date shuffles.
REACH, PERMUTATIONS, MOST_TAXA, SHUFFLES, MOST_SITES = 100, 1000, 300, 100, 1500
#: Sites whose bits are joined in one task, parts of the permutations, points that dates are shuffled among, bytes of bits that a task holds.
STRETCH, SHUFFLE_PARTS, SHUFFLE_BLOCK, HELD_BYTES = 250, 10, 20_000, 64 << 20


def recombination(alignment: DataFrame, permutations: int = PERMUTATIONS, most_sites: int = MOST_SITES) -> DataFrame:
    """(dataset_id, n_sites, windowed, overall, p_value, ri): incompatible pairs of informative sites, near ones against all.

    Two sites are incompatible if all four combinations of their two bases occur.  Under recombination near
    sites are less so than others; p is the share of shuffles of the sites with no larger mean of near pairs.  ri is
    the relative shortfall if p < 0.05, else 0; null with fewer than four informative sites.  Of more than ``most_sites``
    informative sites so many are drawn by a hash of their place, as the test needs no more.

    Each task notes which combinations its records hold, a bit for each pair of sites; the bits of a stretch of sites are
    joined in a task of its own, and each part of the shuffles is one task, so neither records nor shuffles of a dataset come together.
    """
    ship_package(alignment.sparkSession)
    nth = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.xxhash64("dataset_id", "pos")))
    drawn = site_profile(alignment).where("informative").withColumn("nth", nth).where(F.col("nth") <= most_sites)
    listed = drawn.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.substring("alleles", 1, 1).alias("one"), F.substring("alleles", 2, 1).alias("two")))).alias("s"))
    sites = listed.select("dataset_id", F.transform("s", lambda x: x["pos"]).alias("sites"), F.array_join(F.transform("s", lambda x: x["one"]), "").alias("ones"), F.array_join(F.transform("s", lambda x: x["two"]), "").alias("twos"))

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[int], np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for d in table.column("dataset_id").unique().to_pylist():
                own = table.filter(pc.equal(table.column("dataset_id"), d))
                at, ones, twos = (own.column(c)[0].as_py() for c in ("sites", "ones", "twos"))
                bits = combinations(own.column("seq").to_pylist(), at, ones, twos)
                held[d] = at, held[d][1] | bits if d in held else bits
            if sum(b.nbytes for _, b in held.values()) > HELD_BYTES:
                yield from packed(held)
                held.clear()
        yield from packed(held)

    def packed(held: dict[str, tuple[list[int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for d, (at, bits) in held.items():
            for start in range(0, len(at), STRETCH):
                rows = np.packbits(bits[:, start : start + STRETCH]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([start], pa.int32()), pa.array([at], pa.list_(pa.int32())), pa.array([rows], pa.binary())], names=["dataset_id", "start", "sites", "bits"])

    def joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = table.column("sites")[0].as_py()
        rows = min(STRETCH, len(at) - key[1].as_py())
        seen = np.bitwise_or.reduce([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")])
        four = np.unpackbits(seen, count=4 * rows * len(at)).reshape(4, rows, len(at)).all(axis=0)
        return pa.table({"dataset_id": [key[0].as_py()], "start": pa.array([key[1].as_py()], pa.int32()), "sites": pa.array([at], pa.list_(pa.int32())), "bits": pa.array([np.packbits(four).tobytes()], pa.binary())})

    schema = "dataset_id string, start int, sites array<int>, bits binary"
    stretches = alignment.join(sites, "dataset_id").select("dataset_id", "seq", "sites", "ones", "twos").mapInArrow(note, schema).groupBy("dataset_id", "start").applyInArrow(joined, schema)
    parts = min(SHUFFLE_PARTS, permutations)
    shuffles = stretches.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def shuffled(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name, part = key[0].as_py(), key[1].as_py()
        table = table.sort_by("start")
        at = np.array(table.column("sites")[0].as_py())
        n = len(at)
        rows = [np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=min(STRETCH, n - s) * n).reshape(-1, n) for s, b in zip(table.column("start").to_pylist(), table.column("bits"), strict=True)]
        inc = np.concatenate(rows).astype(np.float64)
        i, j = np.triu_indices(n, 1)
        near = np.abs(at[i] - at[j]) <= REACH
        observed, overall, lower = None, float(inc[i, j].mean()) if n > 1 else None, 0
        if near.any():
            observed = float(inc[i[near], j[near]].mean())
            rng = np.random.default_rng([zlib.crc32(name.encode()), part])
            for _ in range(part * permutations // parts, (part + 1) * permutations // parts):
                s = rng.permutation(n)
                lower += bool(inc[s[i[near]], s[j[near]]].mean() <= observed + 1e-12)
        return pa.table({"dataset_id": [name], "n_sites": [n], "windowed": pa.array([observed], pa.float64()), "overall": pa.array([overall], pa.float64()), "lower": [lower]})

    counts = shuffles.groupBy("dataset_id", "part").applyInArrow(shuffled, "dataset_id string, n_sites long, windowed double, overall double, lower long")
    told = counts.groupBy("dataset_id").agg(F.max("n_sites").alias("n_sites"), F.max("windowed").alias("windowed"), F.max("overall").alias("overall"), F.sum("lower").alias("lower"))
    p = (F.col("lower") + 1) / (permutations + 1)
    tested = told.withColumn("p_value", F.when(F.col("windowed").isNotNull() & (F.col("n_sites") >= 4), p))
    shortfall = F.when((F.col("p_value") < 0.05) & (F.col("overall") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("overall") - F.col("windowed")) / F.col("overall")))).otherwise(0.0)
    some = lambda c: F.when(F.col("p_value").isNotNull(), F.col(c)).alias(c)
    return tested.select("dataset_id", "n_sites", some("windowed"), some("overall"), "p_value", F.when(F.col("p_value").isNotNull(), shortfall).alias("ri"))


def combinations(seqs: list[str], at: list[int], ones: str, twos: str) -> np.ndarray:
    """Four bits for each pair of the sites ``at``: does any sequence hold the first base at both, the first and the second, the second and the first, the second at both?"""
    letters = np.frombuffer("".join("".join([s[p] for p in at]) for s in seqs).encode("latin-1", "replace"), np.uint8).reshape(len(seqs), len(at))
    one, two = ((letters == np.frombuffer(x.encode(), np.uint8)).astype(np.float32) for x in (ones, twos))
    return np.stack([one.T @ one > 0, one.T @ two > 0, two.T @ one > 0, two.T @ two > 0])


def neighbor_joining(d: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, node, length) of the tree of a distance matrix; taxa are 0 to n-1, inner nodes follow; negative lengths become 0.

    Of equally good pairs the first joins.
    """
    n = len(d)
    if n < 3:
        return [(0, 1, float(d[0, 1]))] if n == 2 else []
    d, names, edges, new = d.astype(float).copy(), list(range(n)), [], n
    while len(names) > 3:
        m = len(names)
        r = d.sum(axis=1)
        q = (m - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(np.argmin(q)), m))
        a = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2))
        edges += [(new, names[i], max(0.0, a)), (new, names[j], max(0.0, d[i, j] - a))]
        joined = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k not in (i, j)]
        grown = np.zeros((m - 1, m - 1))
        grown[:-1, :-1] = d[np.ix_(keep, keep)]
        grown[-1, :-1] = grown[:-1, -1] = joined[keep]
        d, names, new = grown, [*(names[k] for k in keep), new], new + 1
    for k in range(3):
        x, y = (z for z in range(3) if z != k)
        edges.append((new, names[k], max(0.0, (d[k, x] + d[k, y] - d[x, y]) / 2)))
    return edges


def root_to_tip(edges: list[tuple[int, int, float]], root: int) -> dict[int, float]:
    """The path length from ``root`` to every node."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, length in edges:
        near.setdefault(a, []).append((b, length))
        near.setdefault(b, []).append((a, length))
    out, todo = {root: 0.0}, [root]
    while todo:
        a = todo.pop()
        for b, length in near.get(a, []):
            if b not in out:
                out[b] = out[a] + length
                todo.append(b)
    return out


def distances(seqs: list[str]) -> np.ndarray:
    """JC69 distances of all pairs; p where saturated, 0 without a common column."""
    x = np.array([list(s) for s in seqs])
    one = np.concatenate([(x == b) for b in N.BASES], axis=1).astype(np.float64)
    valid = np.isin(x, list(N.BASES)).astype(np.float64)
    both, same = valid @ valid.T, one @ one.T
    p = np.where(both > 0, 1 - same / np.where(both > 0, both, 1), 0.0)
    arg = 1 - 4 * p / 3
    return np.where(arg > 0, -0.75 * np.log(np.where(arg > 0, arg, 1.0)), p) + 0.0


def tree_clock(dated: DataFrame, most: int = MOST_TAXA) -> DataFrame:
    """(dataset_id, status, n_dated, mu, intercept, r2, p_value): root-to-tip regression on the neighbour-joining tree.

    The tree holds all records of a dataset, rooted at the earliest dated one; the regression is over all
    dated ones.  p is the share of date shuffles with no smaller slope.  A tree is one task, so datasets of more than
    ``most`` records are not computed and say so in ``status``, as do those with fewer than 3 records or two dates.
    """
    ship_package(dated.sparkSession)
    rows = dated.select("dataset_id", "seq_ord", "seq", N.decimal_year(F.col("collected")).alias("year"))
    sizes = rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.countDistinct("year").alias("dates"))
    status = F.when(F.col("n") > most, f"more than {most} records").when(F.col("n") < 3, "fewer than 3 records").when(F.col("dates") < 2, "fewer than 2 dates")
    judged = sizes.withColumn("status", status)
    skipped = judged.where("status is not null").select("dataset_id", "status", F.lit(None).cast("long").alias("n_dated"), *[F.lit(None).cast("double").alias(c) for c in ("mu", "intercept", "r2", "p_value")])
    fit = rows.join(judged.where("status is null").select("dataset_id"), "dataset_id").groupBy("dataset_id").applyInPandas(_clock, "dataset_id string, status string, n_dated long, mu double, intercept double, r2 double, p_value double")
    return skipped.unionByName(fit)


def _clock(group: pd.DataFrame) -> pd.DataFrame:
    g = group.sort_values("seq_ord").reset_index(drop=True)
    have = np.flatnonzero(g["year"].notna().to_numpy())
    years = g["year"].to_numpy()
    tips = root_to_tip(neighbor_joining(distances(g["seq"].tolist())), int(have[np.argmin(years[have])]))
    x, y = years[have], np.array([tips[i] for i in have.tolist()])

    def slope(x: np.ndarray) -> float:
        c = x - x.mean()
        return float(c @ (y - y.mean()) / (c @ c))

    mu = slope(x)
    spread = float(((y - y.mean()) ** 2).sum())
    r2 = mu * mu * float(((x - x.mean()) ** 2).sum()) / spread if spread > 0 else 1.0
    rng = np.random.default_rng(zlib.crc32(g["dataset_id"].iloc[0].encode()))
    p = (sum(slope(rng.permutation(x)) >= mu - 1e-15 for _ in range(SHUFFLES)) + 1) / (SHUFFLES + 1) if len(x) >= 3 else None
    return pd.DataFrame({"dataset_id": g["dataset_id"].iloc[:1], "status": ["computed"], "n_dated": [len(x)], "mu": [mu], "intercept": [y.mean() - mu * x.mean()], "r2": [r2], "p_value": [p]}).astype({"p_value": "float64"})


def date_shuffles(points: DataFrame, shuffles: int = SHUFFLES, block: int = SHUFFLE_BLOCK) -> DataFrame:
    """(dataset_id, p_value): the share of date shuffles with no smaller slope of d on year; null with fewer than 3 points or two dates.

    Points go to blocks of about ``block`` by a hash that knows neither date nor distance, and dates are shuffled
    within blocks: each such shuffle is as likely as any other if dates do not matter, so the test stays exact, and no
    task holds more than a block of a dataset.  Smaller datasets are one block.
    """
    ship_package(points.sparkSession)
    stats = points.groupBy("dataset_id").agg(F.count("*").alias("n"), F.avg("year").alias("mean_year"), F.avg("d").alias("mean_d"), F.min("year").alias("first"), F.max("year").alias("last"))
    centred = points.join(stats, "dataset_id").select("dataset_id", (F.col("year") - F.col("mean_year")).alias("x"), (F.col("d") - F.col("mean_d")).alias("y"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("n") / block)).alias("block"))

    def shuffled(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table.sort_by([("x", "ascending"), ("y", "ascending")])
        x, y = own.column("x").to_numpy(), own.column("y").to_numpy()
        rng = np.random.default_rng([zlib.crc32(key[0].as_py().encode()), key[1].as_py()])
        sums = [float(x @ y), *(float(rng.permutation(x) @ y) for _ in range(shuffles))]
        return pa.table({"dataset_id": [key[0].as_py()] * len(sums), "nth": pa.array(range(len(sums)), pa.int32()), "xy": sums, "xx": [float(x @ x)] * len(sums)})

    sums = centred.groupBy("dataset_id", "block").applyInArrow(shuffled, "dataset_id string, nth int, xy double, xx double").groupBy("dataset_id", "nth").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"))
    real = sums.where("nth = 0").select("dataset_id", F.col("xy").alias("real"), (F.col("xx") * 1e-15).alias("slack"))
    lower = sums.where("nth > 0").join(real, "dataset_id").groupBy("dataset_id").agg(F.count_if(F.col("xy") >= F.col("real") - F.col("slack")).alias("lower"))
    fit = (F.col("n") >= 3) & (F.col("first") < F.col("last"))
    return stats.join(lower, "dataset_id").select("dataset_id", F.when(fit, (F.col("lower") + 1) / (shuffles + 1)).alias("p_value"))

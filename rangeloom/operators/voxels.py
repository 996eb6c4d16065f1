"""Voxel aggregates: map, downsample, moments, first point, class counts, and what is read from a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions import points as P


def with_voxel(points: DataFrame, size: int) -> DataFrame:
    return points.withColumns({c: P.cell(v, size) for c, v in zip(("i", "j", "k"), "xyz")}).withColumn("key", P.voxel_key(F.col("i"), F.col("j"), F.col("k")))


def aggregate(points: DataFrame, size: int, time: str, cap: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(key, n, sx, sy, sz, srefl, first, last) per voxel; with cap, sums hold the first `cap` points by `order` while n holds all."""
    v = with_voxel(points, size)
    sums = [F.col("x"), F.col("y"), F.col("z"), F.col("refl")]
    if cap is not None:
        place = F.row_number().over(Window.partitionBy("key").orderBy(*order))
        v = v.withColumn("place", place)
        sums = [F.when(F.col("place") <= cap, c) for c in sums]
    return v.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for c, a in zip(sums, ("sx", "sy", "sz", "srefl"))], F.min(time).alias("first"), F.max(time).alias("last")
    )


def visible(voxels: DataFrame, min_count: int, oldest: int | None = None) -> DataFrame:
    """Rows of a map that are shown: enough hits, seen late enough, means instead of sums, reflectivity rounded and at most 255."""
    shown = voxels.where(F.col("n") >= min_count)
    if oldest is not None:
        shown = shown.where(F.col("last") >= oldest)
    mean = lambda c: (F.col(c) / F.col("n")).alias(c[1:])
    return shown.select("key", "n", mean("sx"), mean("sy"), mean("sz"), F.least(F.floor(F.col("srefl") / F.col("n") + 0.5), F.lit(255)).alias("refl"), "first", "last")


def downsample(points: DataFrame, size: int) -> DataFrame:
    """(key, n, x, y, z): the mean of each voxel."""
    return with_voxel(points, size).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def first_per_voxel(points: DataFrame, size: int, order: str) -> DataFrame:
    """The point of each voxel that comes first by `order`, a unique column."""
    v = with_voxel(points, size)
    kept = v.groupBy("key").agg(F.min_by(F.struct(*points.columns), F.col(order)).alias("p"))
    return kept.select("key", "p.*")


def moments(points: DataFrame, size: int) -> DataFrame:
    """(key, n, three sums, six sums of products) about the voxel's centre, in half units so that they are whole numbers."""
    v = with_voxel(points, size)
    r = [(2 * F.col(c) - (2 * F.col(i) + 1) * size) for c, i in zip("xyz", "ijk")]
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    return v.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(r[a]).alias(f"s{'xyz'[a]}") for a in range(3)], *[F.sum(r[a] * r[b]).alias(f"s{'xyz'[a]}{'xyz'[b]}") for a, b in pairs]
    )


def covariance(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted mean, eigenvalues, curvature and planarity of x, y, z per group."""
    w = F.lit(1) if weight is None else weight
    pairs = [(a, b) for a in "xyz" for b in "xyz" if a <= b]
    s = rows.groupBy(*by).agg(F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(f"m{a}") for a in "xyz"], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs])
    c = {a + b: F.col(f"s{a}{b}") / F.col("w") - F.col(f"m{a}") / F.col("w") * F.col(f"m{b}") / F.col("w") for a, b in pairs}
    e = P.eigenvalues(c["xx"], c["xy"], c["xz"], c["yy"], c["yz"], c["zz"])
    out = s.select(*by, F.col("w").alias("n"), *[x.alias(f"e{k + 1}") for k, x in enumerate(e)])
    total = F.col("e1") + F.col("e2") + F.col("e3")
    return out.withColumn("curvature", F.when(total <= 1e-12, F.lit(0.0)).otherwise(F.col("e3") / total)).withColumn("planarity", F.when((F.col("n") < 4) | (F.col("e1") <= 1e-12), F.lit(0.0)).otherwise((F.col("e2") - F.col("e3")) / F.col("e1")))


def transient(miss: Column, n: Column, carve_min: int, ratio: float) -> Column:
    """Seen through at least carve_min times, and more often than ratio times its hits."""
    return (miss >= carve_min) & (miss > ratio * n)


def ghost(miss: Column, n: Column, last: Column, now: Column, carve_min: int, ratio: float, stale: int) -> Column:
    return transient(miss, n, carve_min, ratio) & (now - last >= stale)

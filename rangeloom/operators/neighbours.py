"""Joins by nearness as equi-joins on grid cells: a cell as large as the radius leaves 27 cells to look at.

Offsets are exploded on one side only, so a row is sent 27 times at most however many neighbours it has; rows meet by cell key,
Spark splits a crowded cell's share, and the exact distance filters what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions import points as P
from rangeloom.operators.voxels import with_voxel


def offsets(reach: int = 1, axes: int = 3) -> Column:
    """An array of structs (di, dj, dk) of a cube's cells."""
    r = range(-reach, reach + 1)
    cells = [(a, b, c) for a in r for b in r for c in (r if axes == 3 else (0,))]
    return F.array(*[F.struct(F.lit(a).cast("long").alias("di"), F.lit(b).cast("long").alias("dj"), F.lit(c).cast("long").alias("dk")) for a, b, c in cells])


FACES = ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def faces() -> Column:
    """A cell and its six face neighbours."""
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(c, ("di", "dj", "dk"))]) for c in FACES])


def neighbour_keys(cells: DataFrame, around: Column) -> DataFrame:
    """Each row once a neighbouring cell, whose key is `near`; from a `key` column."""
    i, j, k = P.voxel_cells(F.col("key"))
    return cells.withColumn("o", F.explode(around)).withColumn("near", P.voxel_key(i + F.col("o.di"), j + F.col("o.dj"), k + F.col("o.dk"))).drop("o")


def distance2(a: str = "a", b: str = "b") -> Column:
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def radius_join(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(a, b, d2): every pair of rows at most radius apart, itself included where both sides are one table."""
    a = neighbour_keys(with_voxel(left, radius).select(F.struct(*left.columns).alias("a"), "key"), offsets()).select("a", F.col("near").alias("key"))
    b = with_voxel(right, radius).select(F.struct(*right.columns).alias("b"), "key")
    return a.join(b, "key").select("a", "b", distance2().alias("d2")).where(F.col("d2") <= radius * radius)


def nearest(left: DataFrame, right: DataFrame, id_col: str, reach: int) -> DataFrame:
    """(a, b, d2): for each left row the nearest right row within reach, by distance and then id; rows without one are left out."""
    pairs = radius_join(left, right, reach)
    return pairs.groupBy("a").agg(F.min_by(F.struct("b", "d2"), F.struct("d2", F.col(f"b.{id_col}"))).alias("m")).select("a", "m.b", "m.d2")


def distances(live: DataFrame, prior: DataFrame, id_col: str, reach: int, none: float = 1e3) -> DataFrame:
    """Each live row with its distance from the prior surface; `none` beyond reach."""
    near = nearest(live, prior, id_col, reach).select(F.col(f"a.{id_col}").alias(id_col), F.sqrt(F.col("d2").cast("double")).alias("distance"))
    return live.join(near, id_col, "left").withColumn("distance", F.coalesce("distance", F.lit(none)))


def occupied_neighbours(voxels: DataFrame, around: Column | None = None) -> DataFrame:
    """(key, occupied, weight): how many of the 27 cells around each voxel hold points, and how many points; the cell itself counts."""
    near = neighbour_keys(voxels.select("key"), offsets() if around is None else around)
    other = voxels.select(F.col("key").alias("near"), "n")
    return near.join(other, "near").groupBy("key").agg(F.count(F.lit(1)).alias("occupied"), F.sum("n").alias("weight"))


def settled_near(voxels: DataFrame, settled: Column) -> DataFrame:
    """Voxels that are settled, or of which one of the six face neighbours is: a left semi join."""
    near = neighbour_keys(voxels, faces())
    good = voxels.where(settled).select(F.col("key").alias("near"))
    return voxels.join(near.join(good, "near", "left_semi").select("key").distinct(), "key", "left_semi")


def local_maxima(voxels: DataFrame) -> DataFrame:
    """Voxels with at least as many points as each of their 26 neighbours."""
    near = neighbour_keys(voxels.select("key"), offsets()).join(voxels.select(F.col("key").alias("near"), F.col("n").alias("other")), "near")
    return voxels.join(near.groupBy("key").agg(F.max("other").alias("most")), "key").where(F.col("n") >= F.col("most")).drop("most")

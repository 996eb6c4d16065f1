"""What is shown and kept: visibility rules, subsets, latest poses, frame windows, lines of sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators import rays as R


def alpha(denoise: bool, least: int, hide_ground: bool, hide_moving: bool, hide_still: bool) -> Column:
    """Zero for hidden rows, by their columns neighbours, ground and moving."""
    hidden = F.lit(False)
    for on, rule in ((denoise, F.col("neighbours") < least), (hide_ground, F.col("ground")), (hide_moving, F.col("moving")), (hide_still, ~F.col("moving"))):
        if on:
            hidden = hidden | rule
    return F.when(hidden, 0).otherwise(255)


def draw_subset(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows, the first by key: a repeatable sample. A top-k: each task keeps its own first rows."""
    return rows.orderBy(key).limit(most)


def latest(poses: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last written row a key: what a table of poses shows after its upserts."""
    cols = [c for c in poses.columns if c not in by]
    return poses.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("v")).select(*by, "v.*")


def weighted_frames(rows: DataFrame, by: str, near: Column, least: float, miss_weight: float) -> DataFrame:
    """Rows with a weight: none in frames of which less than `least` is near, miss_weight where `hit` is false, else one."""
    fits = rows.groupBy(by).agg(F.avg(near.cast("double")).alias("fit"))
    return rows.join(fits, by).withColumn("weight", F.when(F.col("fit") < least, F.lit(0.0)).when(~F.col("hit"), F.lit(miss_weight)).otherwise(F.lit(1.0)))


def frame_window(points: DataFrame, frames: DataFrame, frame: int, keep: int) -> DataFrame:
    """Points of the last `keep` microseconds, with their frame's pose; points of unknown frames are left out."""
    now = points.agg(F.max("us").alias("now"))
    recent = points.crossJoin(F.broadcast(now)).where(F.col("us") > F.col("now") - keep).drop("now")
    return recent.withColumn("frame", F.floor(F.col("us") / float(frame))).join(frames, "frame")


def returns(firings: DataFrame, clean: int = 0) -> DataFrame:
    """One row a valid return of firings (id, t, returns: array of structs with valid, x, y, z, tag), in time order; with clean, untagged and farther than it."""
    r = firings.select("id", "t", F.posexplode("returns").alias("ret", "r")).where("r.valid").select("id", "t", "ret", *[F.col(f"r.{c}").alias(c) for c in ("x", "y", "z", "tag")])
    return r.where((F.col("tag") == 0) & (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") > clean**2)) if clean else r


def seen_from(cells: DataFrame, stations: DataFrame, surface: DataFrame, size: float) -> DataFrame:
    """Cells (id, x, y, z: centres) that some station (station, x, y, z) sees: a line without surface cells (i, j, k) but for its first and last two.

    Stations are a stated few and go to the cells; steps are cells of the line, joined with the surface.
    """
    d = [F.col(c) - F.col(f"o{c}") for c in "xyz"]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    pairs = cells.crossJoin(F.broadcast(stations.select("station", *[F.col(c).alias(f"o{c}") for c in "xyz"]))).withColumn("range", n).where("range > 0")
    lines = pairs.select(F.col("id"), "station", F.xxhash64("id", "station").alias("line"), "ox", "oy", "oz", *[(d[k] / F.col("range")).alias(f"d{c}") for k, c in enumerate("xyz")], (F.col("range") - 2 * size).alias("range"))
    steps = R.ray_cells(lines.select(F.col("line").alias("id"), "ox", "oy", "oz", "dx", "dy", "dz", "range"), size).where("step >= 2")
    blocked = steps.join(surface.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi").select(F.col("id").alias("line")).distinct()
    return lines.join(blocked, "line", "left_anti").select("id").distinct()


def consecutive_poor(rows: DataFrame, by: str, order: list[str], poor: Column) -> DataFrame:
    """Rows with the length of the run of poor ones that ends at each."""
    w = Window.partitionBy(by).orderBy(*order)
    g = rows.withColumn("p", poor.cast("int")).withColumn("g", F.sum(1 - F.col("p")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("poor_run", F.sum("p").over(inside)).drop("p", "g")

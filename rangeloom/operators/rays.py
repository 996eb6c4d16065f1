"""Rays through voxels: traversal, free-space carving, visibility counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 4096


def cells_on_ray(origin: np.ndarray, direction: np.ndarray, stop: float, size: float, most: int = MOST_STEPS) -> np.ndarray:
    """Cells that origin + t * direction crosses for t in [0, stop), in order."""
    if stop <= 0:
        return np.zeros((0, 3), np.int64)
    cell = np.floor(origin / size).astype(np.int64)
    crossings = []
    for axis in range(3):
        d = direction[axis]
        if d:
            first = (cell[axis] + (d > 0)) * size
            t0 = (first - origin[axis]) / d
            n = int(min(most, max(0, np.ceil((stop - t0) * abs(d) / size))))
            t = t0 + np.arange(n) * size / abs(d)
            crossings.append(np.stack([t[t < stop], np.full((t < stop).sum(), axis)], 1))
    moves = np.concatenate(crossings) if crossings else np.zeros((0, 2))
    axes = moves[np.lexsort((moves[:, 1], moves[:, 0])), 1].astype(int)[: most - 1]
    steps = np.zeros((len(axes) + 1, 3), np.int64)
    steps[np.arange(1, len(axes) + 1), axes] = np.sign(direction[axes]).astype(np.int64)
    return cell + np.cumsum(steps, 0)


def ray_cells(rays: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """(id, step, i, j, k) of rays (id, ox, oy, oz, dx, dy, dz, range), up to margin before their end; unit directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            for part in range(0, batch.num_rows, 1000):
                ids, cells = [], []
                for r in range(part, min(part + 1000, batch.num_rows)):
                    c = cells_on_ray(np.array([x[r] for x in v[1:4]]), np.array([x[r] for x in v[4:7]]), float(v[7][r]) - margin, size)
                    ids.append(np.full(len(c), v[0][r]))
                    cells.append(np.concatenate([np.arange(len(c))[:, None], c], 1))
                flat = np.concatenate(cells)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64)), *(pa.array(flat[:, k].astype(np.int64)) for k in range(4))], ["id", "step", "i", "j", "k"])

    return rays.select("id", "ox", "oy", "oz", "dx", "dy", "dz", "range").mapInArrow(run, "id long, step long, i long, j long, k long")


def carve(rays: DataFrame, voxels: DataFrame, size: float, every: int = 2, max_range: float = 40.0, margin_cells: float = 3.0) -> DataFrame:
    """(i, j, k, miss) for voxels (i, j, k, x, y, z: their centroid) that rays pass through well before their end.

    One ray in `every`, by id. The margin is three cells or three hundredths of the range, or more where an `incidence` column (the
    cosine at the surface that was hit) says that the ray grazes; a ray pierces a voxel if it passes
    within half a cell of its centroid. Each piercing counts `every`.
    """
    used = rays.where((F.col("id") % every == 0) & F.col("range").between(0.05, max_range))
    slant = 1.5 * size / F.greatest(F.col("incidence"), F.lit(0.05)) if "incidence" in rays.columns else F.lit(0.0)
    used = used.withColumn("range", F.col("range") - F.greatest(F.lit(margin_cells * size), 0.03 * F.col("range"), slant)).where(F.col("range") > size)
    met = ray_cells(used, size).join(voxels, ["i", "j", "k"]).join(used.select("id", "ox", "oy", "oz", "dx", "dy", "dz"), "id")
    along = sum(((F.col(c) - F.col(f"o{c}")) * F.col(f"d{c}") for c in "yz"), (F.col("x") - F.col("ox")) * F.col("dx"))
    met = met.withColumn("along", along)
    off2 = sum(((F.col(c) - F.col(f"o{c}") - F.col("along") * F.col(f"d{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("ox") - F.col("along") * F.col("dx")) ** 2)
    return met.where(off2 < (0.5 * size) ** 2).groupBy("i", "j", "k").agg((F.count(F.lit(1)) * every).alias("miss"))


def visibility(rays: DataFrame, size: float) -> DataFrame:
    """(i, j, k, passes, hits): how many rays cross each cell, once a ray, and how many end in it."""
    passes = ray_cells(rays, size).select("id", "i", "j", "k").distinct().groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("passes"))
    end = [F.floor((F.col(f"o{c}") + F.col("range") * F.col(f"d{c}")) / F.lit(size)).alias(n) for c, n in zip("xyz", "ijk")]
    hits = rays.where("range > 0").select(*end).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("hits"))
    return passes.join(hits, ["i", "j", "k"], "full").fillna(0, ["passes", "hits"])

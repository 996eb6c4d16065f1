"""Maps made of earlier scans: voxel means with normals and planarity, levels, station estimates, visible change bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.functions import points as P
from rangeloom.operators import neighbours as N
from rangeloom.operators import voxels as V


def normals(points: DataFrame, radius: int) -> DataFrame:
    """Each point (id, x, y, z) with its normal and planarity from the points within radius; zero below four.

    Ten sums a point by the grid join and one aggregate; the eigenvectors of the 3x3 matrices are an Arrow map of NumPy.
    """
    near = N.radius_join(points.select("id", "x", "y", "z"), points.select("id", "x", "y", "z"), radius)
    d = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"}
    pairs = [(a, b) for a in "xyz" for b in "xyz" if a <= b]
    sums = near.groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(d[a]).cast("double").alias(f"m{a}") for a in "xyz"], *[F.sum(d[a] * d[b]).cast("double").alias(f"s{a}{b}") for a, b in pairs])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            col = {f: batch.column(k).to_numpy() for k, f in enumerate(batch.schema.names)}
            n = np.maximum(col["n"], 1)
            c = np.empty((batch.num_rows, 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    lo, hi = min(a, b), max(a, b)
                    c[:, i, j] = col[f"s{lo}{hi}"] / n - col[f"m{a}"] / n * col[f"m{b}"] / n
            values, vectors = np.linalg.eigh(c)
            normal = vectors[:, :, 0]
            first = np.take_along_axis(normal, np.argmax(np.abs(normal) > 1e-9, axis=1)[:, None], 1)
            normal = np.where(first < 0, -normal, normal)
            ok = (n >= 4) & (values[:, 2] > 1e-12)
            planarity = np.where(ok, (values[:, 1] - values[:, 0]) / np.maximum(values[:, 2], 1e-12), 0.0)
            normal[~ok] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(normal[:, k]) for k in range(3)), pa.array(planarity)], ["id", "nx", "ny", "nz", "planarity"])

    found = sums.mapInArrow(run, "id long, nx double, ny double, nz double, planarity double")
    return points.join(found, "id")


def build(points: DataFrame, size: int, radius: int) -> DataFrame:
    """(id, n, x, y, z, normal, planarity): the voxel means of points as a map; the id is the voxel's key."""
    means = V.downsample(points, size).select(F.col("key").alias("id"), "n", *[F.rint(c).cast("long").alias(c) for c in "xyz"])
    return normals(means, radius)


def levels(surface: DataFrame, bin_size: int, least: int) -> DataFrame:
    """(level, n): heights at which flat horizontal surface piles up, the fullest bin of its neighbours."""
    flat = surface.where((F.abs("nz") > 0.97) & (F.col("planarity") > 0.5))
    h = flat.groupBy(P.cell("z", bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    near = h.alias("a").join(h.alias("b"), (F.col("b.bin") - F.col("a.bin")).between(-1, 1)).groupBy("a.bin", "a.n").agg(F.max("b.n").alias("most"))
    return near.where((F.col("n") == F.col("most")) & (F.col("n") >= least)).select(((F.col("bin") + 0.5) * bin_size).alias("level"), "n")


def station_candidates(points: DataFrame, cell: int, spacing: int, least: int) -> DataFrame:
    """(cx, cy, density): columns denser than all within `spacing` cells: where a terrestrial scanner stood."""
    c = points.groupBy(P.cell("x", cell).alias("cx"), P.cell("y", cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    kernel = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy"), F.lit(float(np.exp(-(a * a + b * b) / 2))).alias("w")) for a in range(-2, 3) for b in range(-2, 3)])
    spread = c.withColumn("o", F.explode(kernel)).groupBy((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).agg(F.sum(F.col("n") * F.col("o.w")).alias("density"))
    smooth = spread.join(c.where(F.col("n") >= least).select("cx", "cy"), ["cx", "cy"])
    around = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a in range(-spacing, spacing + 1) for b in range(-spacing, spacing + 1)])
    rivals = smooth.withColumn("o", F.explode(around)).groupBy((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).agg(F.max("density").alias("most"))
    return smooth.join(rivals, ["cx", "cy"]).where(F.col("density") >= F.col("most")).select("cx", "cy", "density")

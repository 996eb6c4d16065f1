"""Calibrated points, smooth corrections and fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions import points as P


def scan_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.atan2(y, x), F.atan2(z, x)


def direction(u: Column, v: Column) -> list[Column]:
    """The unit vector with scan angles u and v."""
    n = F.sqrt(1 + F.tan(u) * F.tan(u) + F.tan(v) * F.tan(v))
    return [1 / n, F.tan(u) / n, F.tan(v) / n]


def calibrated(p: list[Column], echo: Column, phase: tuple[Column, Column], harmonics: list[tuple[int, int, float, float]], offsets: tuple[float, ...]) -> list[Column]:
    """A measured point with its range offset by return and its direction bent by harmonics (m, n, cos, sin) of the two phases.

    Directions are bent only where the point is more than 5 cm ahead; later returns share the third offset.
    """
    r = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    u, v = scan_angles(*p)
    du, dv = F.lit(0.0), F.lit(0.0)
    for m, n, a, b in harmonics:
        angle = m * phase[0] + n * phase[1]
        du, dv = du + a * F.cos(angle) - b * F.sin(angle), dv + a * F.sin(angle) + b * F.cos(angle)
    bent, straight = direction(u + du, v + dv), [c / r for c in p]
    reach = r + F.get(F.array(*map(F.lit, offsets)), F.least(echo, F.lit(len(offsets) - 1)))
    ahead = p[0] > 0.05
    return [F.when(ahead, a).otherwise(b) * reach for a, b in zip(bent, straight)]


def spline_at(rows: DataFrame, knots: DataFrame, time: str, dt: float, values: list[str]) -> DataFrame:
    """Each row with the cubic B-spline of knots (k, values) at its time, as s_<value>; the ends repeat. Four equi-joined knots a row.

    Rows need an `id`.
    """
    last = knots.agg(F.max("k").alias("last"))
    at = rows.crossJoin(F.broadcast(last)).withColumn("k0", F.least(F.greatest(F.floor(F.col(time) / F.lit(dt)), F.lit(0)), F.col("last") - 1))
    at = at.withColumn("u", F.least(F.greatest(F.col(time) / F.lit(dt) - F.col("k0"), F.lit(0.0)), F.lit(1.0)))
    weights = F.array(*[F.struct(F.lit(o).alias("o"), w.alias("w")) for o, w in zip(range(-1, 3), P.spline_weights(F.col("u")))])
    four = at.select("id", F.explode(weights).alias("c"), "k0", "last").select("id", F.col("c.w").alias("w"), F.least(F.greatest(F.col("k0") + F.col("c.o"), F.lit(0)), F.col("last")).alias("k"))
    sums = four.join(knots, "k").groupBy("id").agg(*[F.sum(F.col("w") * F.col(v)).alias(f"s_{v}") for v in values])
    return rows.join(sums, "id")


def trilinear(points: DataFrame, cells: DataFrame, size: float, value: str, outside: float) -> DataFrame:
    """(id, value) of points between the eight cell centres around each; `outside` for cells that are not there."""
    parts = {c: P.cell(F.col(c) - size / 2, size) for c in "xyz"}
    base = points.select("id", *[parts[c].alias(f"b{c}") for c in "xyz"], *[((F.col(c) - size / 2) / size - parts[c]).alias(f"f{c}") for c in "xyz"])
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    side = lambda f, o: F.when(F.col(o) == 1, F.col(f)).otherwise(1 - F.col(f))
    eight = base.withColumn("o", F.explode(corners)).select("id", (F.col("bx") + F.col("o.a")).alias("i"), (F.col("by") + F.col("o.b")).alias("j"), (F.col("bz") + F.col("o.c")).alias("k"), (side("fx", "o.a") * side("fy", "o.b") * side("fz", "o.c")).alias("w"))
    return eight.join(cells.select("i", "j", "k", value), ["i", "j", "k"], "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce(value, F.lit(outside))).alias(value))

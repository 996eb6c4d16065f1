"""Deterministic generators: scan patterns, analytic rooms and boxes, hash noise; rows of spark.range, no random state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.session import ship


def hash_unit(*keys: Column) -> Column:
    """A number in [0, 1) from keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / float(1 << 53)


def room_exit(o: tuple[float, float, float], d: list[Column], lo: tuple, hi: tuple) -> Column:
    """How far from o inside a room its wall is."""
    far = [F.when(v > 0, (F.lit(b) - a) / v).when(v < 0, (F.lit(c) - a) / v).otherwise(F.lit(1e9)) for v, a, c, b in zip(d, o, lo, hi)]
    return F.least(*far)


def box_hit(o: tuple[float, float, float], d: list[Column], lo: tuple, hi: tuple) -> Column:
    """How far from o a box's face is; a billion if the ray misses."""
    near, far = [], []
    for v, a, c, b in zip(d, o, lo, hi):
        safe = F.when(F.abs(v) < 1e-12, F.lit(1e-12)).otherwise(v)
        t1, t2 = (F.lit(c) - a) / safe, (F.lit(b) - a) / safe
        near.append(F.least(t1, t2))
        far.append(F.greatest(t1, t2))
    enter, leave = F.greatest(*near), F.least(*far)
    return F.when((enter <= leave) & (enter > 0), enter).otherwise(F.lit(1e9))


def scan(spark: SparkSession, n: int, station: tuple = (0.0, 0.0, 0.0), lo: tuple = (-2.0, -4.0, -1.3), hi: tuple = (14.0, 4.5, 2.6), boxes: tuple = (((4.0, -1.8, -1.3), (5.2, -0.6, -0.2)),), noise: float = 0.0, rates: tuple = (121.64, -77.78)) -> DataFrame:
    """(id, t, dx, dy, dz, range, x, y, z): a two-rate rosette inside a room with boxes; x, y, z from the station, in metres."""
    ship(spark)
    t = F.col("id") * 1e-5
    a, b = 2 * math.pi * rates[0] * t, 2 * math.pi * rates[1] * t
    u, v = 0.17 * (F.cos(a) + F.cos(b)), 0.17 * (F.sin(a) + F.sin(b))
    norm = F.sqrt(1 + F.tan(u) * F.tan(u) + F.tan(v) * F.tan(v))
    d = spark.range(n).select("id", t.alias("t"), (1 / norm).alias("dx"), (F.tan(u) / norm).alias("dy"), (F.tan(v) / norm).alias("dz"))
    dirs = [F.col("dx"), F.col("dy"), F.col("dz")]
    r = F.least(room_exit(station, dirs, lo, hi), *[box_hit(station, dirs, a, b) for a, b in boxes])
    jitter = (hash_unit(F.col("id"), F.lit(7)) - 0.5) * 2 * noise
    out = d.withColumn("range", r + jitter)
    return out.select("*", *[(F.col("range") * F.col(f"d{c}")).alias(c) for c in "xyz"])


def stations(spark: SparkSession, places: list[tuple[float, float, float]], azimuths: int, elevations: int, lo: tuple, hi: tuple, boxes: tuple = ()) -> DataFrame:
    """(station, x, y, z): a terrestrial scan of the room, one ray an azimuth and elevation from each station."""
    out = None
    for k, o in enumerate(places):
        az, el = 2 * math.pi * (F.col("id") % azimuths) / azimuths, math.pi * (F.floor(F.col("id") / float(azimuths)) + 0.5) / elevations - math.pi / 2
        rays = spark.range(azimuths * elevations).select("id", (F.cos(el) * F.cos(az)).alias("dx"), (F.cos(el) * F.sin(az)).alias("dy"), F.sin(el).alias("dz"))
        dirs = [F.col("dx"), F.col("dy"), F.col("dz")]
        r = F.least(room_exit(o, dirs, lo, hi), *[box_hit(o, dirs, a, b) for a, b in boxes], F.lit(1e9))
        one = rays.withColumn("r", r).where("r < 1000").select(F.lit(k).alias("station"), *[(F.lit(p) + F.col("r") * F.col(f"d{c}")).alias(c) for p, c in zip(o, "xyz")])
        out = one if out is None else out.unionByName(one)
    return out

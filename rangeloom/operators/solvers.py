"""Iterative solvers: localisation by staged search, scan-pattern rates, occupancy training, odometry over frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators import neighbours as N
from rangeloom.operators import rays as R
from rangeloom.operators import registration as G


def fit(scan: DataFrame, surface: DataFrame, pose: np.ndarray, radii: tuple[int, ...] = (30, 50, 100)) -> list[float]:
    """Shares of scan points closer to the surface than each radius, under a pose."""
    m = [float(v) for v in pose[:3].ravel()]
    moved = scan.select("id", *[(m[4 * r] * F.col("x") + m[4 * r + 1] * F.col("y") + m[4 * r + 2] * F.col("z") + m[4 * r + 3]).alias("xyz"[r]) for r in range(3)])
    near = N.nearest(moved, surface.select("id", "x", "y", "z"), "id", max(radii))
    got = near.agg(*[F.count_if(F.col("d2") < r * r) for r in radii]).first()
    n = max(1, scan.count())
    return [v / n for v in got]


def pose_of(x: float, y: float, z: float, yaw: float) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = G.exponential(np.array([0.0, 0.0, yaw]))
    out[:3, 3] = x, y, z
    return out


def localise(scan: DataFrame, surface: DataFrame, grid: list[tuple[float, float, float, float]], coarse: int, keep: int = 4, rounds: int = 8) -> list[tuple[np.ndarray, list[float]]]:
    """Poses of a scan in a map, best first, each with its fit: a soft score over a stated grid of (x, y, z, yaw) starts, the best that are
    apart, registration of each, and the share of points that then fit. Unique if the first is clearly better than the second."""
    spark = scan.sparkSession
    hyps = spark.createDataFrame([(k, *map(float, h)) for k, h in enumerate(grid)], "hyp int, x double, y double, z double, yaw double")
    scores = {r.hyp: r.score for r in G.soft_scores(hyps, scan, surface, coarse).collect()}  # one row a start
    rows = [(scores.get(k, 0.0), np.array(h[:3]), h[3]) for k, h in enumerate(grid)]
    out = []
    for k in G.suppressed(rows, coarse, 0.1, keep):
        pose, n = G.icp(scan, surface, pose_of(*grid[k]), coarse, rounds)
        if n >= 6:
            out.append((pose, fit(scan, surface, pose)))
    return sorted(out, key=lambda r: -r[1][-1])


def is_unique(found: list[tuple[np.ndarray, list[float]]], least: float = 0.45, gap: float = 0.15, ratio: float = 0.75, apart: float = 1000.0, turned: float = 15.0) -> bool:
    """Whether the best fit is good and no pose elsewhere comes near it."""
    if not found or found[0][1][-1] < least:
        return False
    for pose, share in found[1:]:
        away, turn = G.pose_difference(found[0][0], pose)
        if away > apart or turn > turned:
            return found[0][1][-1] - share[-1] >= gap and share[-1] <= ratio * found[0][1][-1]
    return True


def pattern_rates(firings: DataFrame, count: int = 2) -> DataFrame:
    """(recording, line, hz, amplitude): the strongest rotation rates of the scan angles u + iv of (recording, t, u, v), evenly timed rows.

    One recording a group, as a spectrum needs its whole signal; a peak is refined by a parabola through its logarithm, its lobe taken out before the next.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, z = rows["t"].to_numpy(), rows["u"].to_numpy() + 1j * rows["v"].to_numpy()
        dt = float(np.median(np.diff(t)))
        grid = np.round((t - t[0]) / dt).astype(int)
        signal = np.zeros(int(grid[-1]) + 1, complex)
        signal[grid] = z
        power = np.abs(np.fft.fft(signal * np.hanning(len(signal)), 4 * len(signal)))
        freq = np.fft.fftfreq(len(power), dt)
        out = []
        for line in range(count):
            k = int(power.argmax())
            a, b, c = np.log(power[[k - 1, k, (k + 1) % len(power)]] + 1e-300)
            shift = 0.5 * (a - c) / (a - 2 * b + c)
            hz = freq[k] + shift * (freq[1] - freq[0])
            out.append((rows["recording"].iloc[0], line, float(hz), float(np.abs(np.mean(z * np.exp(-2j * math.pi * hz * (t - t[0])))))))
            lobe = np.abs(np.arange(len(power)) - k)
            power[np.minimum(lobe, len(power) - lobe) <= 12] = 0
        return pd.DataFrame(out, columns=["recording", "line", "hz", "amplitude"])

    return firings.groupBy("recording").applyInPandas(run, "recording string, line int, hz double, amplitude double")


def occupancy(rays: DataFrame, size: float, rounds: int = 8, rate: float = 1.0, prior: float = 0.05) -> DataFrame:
    """(i, j, k, theta, occupied, passes, hits): a field of logits under which rays are likely to pass what they pass and to end where they end.

    Each round is one aggregate over the ray-cell table: a hit pulls its cell up by its own improbability, a pass pulls it down by the
    cell's opacity, and a prior pulls to unknown. Cells are sparse; the counts are computed once.
    """
    seen = R.visibility(rays, size).withColumn("theta", F.lit(0.0))
    p = 1 / (1 + F.exp(-F.col("theta")))
    free = F.greatest(F.col("passes") - F.col("hits"), F.lit(0))
    for _ in range(rounds):
        pull = F.col("hits") * (1 - p) - free * p - prior * F.col("theta")
        seen = seen.withColumn("theta", F.least(F.greatest(F.col("theta") + rate * pull / (1 + F.col("passes")) * 4, F.lit(-8.0)), F.lit(8.0)))
    return seen.withColumn("occupied", p)


def odometry(frames: list[DataFrame], surface_of, start: np.ndarray, reach: int) -> list[np.ndarray]:  # noqa: ANN001
    """Poses of successive frames: each starts from the last step repeated and is registered to surface_of(frames so far)."""
    poses = [start]
    for k, frame in enumerate(frames[1:], 1):
        step = np.linalg.inv(poses[-2]) @ poses[-1] if k > 1 else np.eye(4)
        pose, n = G.icp(frame, surface_of(k, poses), poses[-1] @ step, reach)
        poses.append(pose if n >= 60 else poses[-1] @ step)
    return poses


def interpolate(times: np.ndarray, poses: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions and unit quaternions (x, y, z, qx, qy, qz, qw) at times, clamped to the ends: shifts linear, turns along the arc."""
    k = np.clip(np.searchsorted(times, at, "right") - 1, 0, len(times) - 2)
    u = np.clip((at - times[k]) / (times[k + 1] - times[k]), 0, 1)
    out = np.empty((len(at), 7))
    out[:, :3] = poses[k, :3] + u[:, None] * (poses[k + 1, :3] - poses[k, :3])
    out[:, 3:] = [G.slerp(poses[i, 3:], poses[i + 1, 3:], s) for i, s in zip(k, u)]
    return out


def adam(gradient, start: np.ndarray, rounds: int, rate: float, final: float | None = None) -> np.ndarray:  # noqa: ANN001
    """Minimises by Adam with a half-cosine rate from rate to final; gradient is a function of the point."""
    x, m, v = start.astype(float).copy(), np.zeros_like(start, float), np.zeros_like(start, float)
    final = rate if final is None else final
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        lr = final + (rate - final) * 0.5 * (1 + math.cos(math.pi * (t - 1) / max(1, rounds - 1)))
        x -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return x

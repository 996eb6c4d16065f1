"""Ordered folds as plain functions, and their batch form a group: frames with late points, smoothed velocity, corrections, session states."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rangeloom.operators.registration import exponential


class FrameAssigner:
    """Frames of points that come in arrival order: a frame closes when a later one is seen; points of the frame just closed join the
    open one, older ones are dropped; a gap of more than max_gap frames starts anew."""

    def __init__(self, length: float = 0.1, max_gap: int = 20):
        self.length, self.max_gap, self.open, self.gaps = length, max_gap, None, 0

    def step(self, t: float) -> int | None:
        k = int(np.floor(max(t, 0.0) / self.length + 1e-9))
        if self.open is None:
            self.open = k
        elif k - self.open > self.max_gap:
            self.open, self.gaps = k, self.gaps + 1
        elif k > self.open:
            self.open = k
        elif k == self.open - 1:
            return self.open
        elif k < self.open:
            return None
        return k


def assign_frames(points: DataFrame, length: float, max_gap: int = 20) -> DataFrame:
    """(source, seq, t, frame) of points (source, seq, t) in order of seq; dropped points have a null frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        f, rows = FrameAssigner(length, max_gap), rows.sort_values("seq")
        return rows.assign(frame=pd.array([f.step(t) for t in rows["t"]], dtype="Int64"))[["source", "seq", "t", "frame"]]

    return points.select("source", "seq", "t").groupBy("source").applyInPandas(run, "source string, seq long, t double, frame long")


def smoothed(steps: np.ndarray, share: float = 0.85, jump: float = 1.5) -> np.ndarray:
    """Exponential average of motions (rows of shift and turn); a shift of `jump` or more resets to rest."""
    out, state = np.zeros_like(steps, float), np.zeros(steps.shape[1])
    for k, s in enumerate(steps):
        state = share * state + (1 - share) * s if np.linalg.norm(s[:3]) < jump else np.zeros_like(state)
        out[k] = state
    return out


def huber_line(x: np.ndarray, y: np.ndarray, width: float, rounds: int = 10) -> tuple[float, float]:
    """(slope, intercept) by iteratively reweighted least squares with Huber weights."""
    w = np.ones_like(x)
    for _ in range(rounds):
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        slope = float((w * (x - mx) * (y - my)).sum() / max((w * (x - mx) ** 2).sum(), 1e-12))
        rest = np.abs(y - my - slope * (x - mx))
        w = np.where(rest <= width, 1.0, width / np.maximum(rest, 1e-12))
    return slope, float(my - slope * mx)


def part_turn(turn: np.ndarray, most: float) -> tuple[np.ndarray, bool]:
    """(a rotation about the axis of `turn` by its angle or `most` radians, whether that is all of it), by quaternion."""
    # The eigenvector of the largest eigenvalue of this matrix is the rotation's quaternion (x, y, z, w).
    k = np.zeros((4, 4))
    k[:3, :3] = turn + turn.T - np.trace(turn) * np.eye(3)
    k[:3, 3] = k[3, :3] = turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]
    k[3, 3] = np.trace(turn)
    x = np.linalg.eigh(k)[1][:, -1]
    x = -x if x[3] < 0 else x
    half = float(np.arctan2(np.linalg.norm(x[:3]), x[3]))
    if 2 * half <= most:
        return turn, True
    return exponential(x[:3] / np.sin(half) * most), False


def step_toward(now: np.ndarray, goal: np.ndarray, pivot: np.ndarray, dt: float, speed: float = 0.05, turn: float = 1.0) -> tuple[np.ndarray, bool]:
    """(pose, reached): 4x4 poses; `now` drawn toward `goal` for `dt` seconds, so that the place `pivot` moves by at most `speed` and the attitude by `turn` degrees a second."""
    at_pivot = np.linalg.solve(now, np.append(pivot, 1.0))  # the same place in the moving frame
    way = (goal @ at_pivot)[:3] - pivot
    room = speed * dt
    arrives = float(way @ way) <= room * room
    part, turned = part_turn(goal[:3, :3] @ now[:3, :3].T, np.radians(turn) * dt)
    out = np.eye(4)
    out[:3, :3] = part @ now[:3, :3]
    out[:3, 3] = pivot + (way if arrives else way * (room / np.sqrt(way @ way))) - out[:3, :3] @ at_pivot[:3]
    return out, arrives and turned


@dataclass
class Session:
    """States of a scan that is held against a map: searching, tracking, lost; fed with fits of single trackings."""

    state: str = "searching"
    poor: int = 0
    min_fit: float = 0.35
    lost_fit: float = 0.3
    lost_after: int = 3

    def step(self, kind: str, fit: float) -> str:
        if kind == "found":
            self.state, self.poor = ("tracking", 0) if fit >= self.min_fit else ("searching", 0)
        elif kind == "track" and self.state == "tracking":
            self.poor = self.poor + 1 if fit < self.lost_fit else 0
            if self.poor >= self.lost_after:
                self.state = "lost"
        elif kind == "reset":
            self.state, self.poor = "searching", 0
        return self.state

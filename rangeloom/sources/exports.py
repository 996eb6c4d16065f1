"""Point files and messages: PLY, LAS 1.4, quantised snapshots; encoders work on Arrow columns, sinks on one file a partition."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ply(table: pa.Table) -> bytes:
    """Little-endian binary PLY of x, y, z (floats), red, green, blue where present, intensity."""
    names = [("x", "<f4", "float"), ("y", "<f4", "float"), ("z", "<f4", "float"), *((c, "u1", "uchar") for c in ("red", "green", "blue") if c in table.column_names), ("intensity", "u1", "uchar")]
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {table.num_rows}", *(f"property {k} {n}" for n, _, k in names), "end_header", ""]
    rows = np.empty(table.num_rows, [(n, t) for n, t, _ in names])
    for n, _, _ in names:
        rows[n] = table[n].to_numpy()
    return "\n".join(head).encode() + rows.tobytes()


LAS_POINT = np.dtype([
    ("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8"),
    ("red", "<u2"), ("green", "<u2"), ("blue", "<u2"),
])


def las(table: pa.Table) -> bytes:
    """LAS 1.4, point format 7, as published: millimetre scale, offsets at the floor of the minimum, eight-bit values times 257, class 2 for ground and 1 for the rest."""
    n = table.num_rows
    xyz = [table[c].to_numpy().astype(float) for c in "xyz"]
    low = [float(np.floor(v.min())) if n else 0.0 for v in xyz]
    rows = np.zeros(n, LAS_POINT)
    for c, v, o in zip("xyz", xyz, low):
        rows[c] = np.round((v - o) / 0.001)
    rows["intensity"] = table["intensity"].to_numpy().astype(np.uint16) * 257
    rows["returns"] = 0x11
    rows["classification"] = np.where(table["ground"].to_numpy(zero_copy_only=False).astype(bool), 2, 1) if "ground" in table.column_names else 1
    if "t" in table.column_names:
        rows["time"] = table["t"].to_numpy()
    for c in ("red", "green", "blue"):
        if c in table.column_names:
            rows[c] = table[c].to_numpy().astype(np.uint16) * 257
    ends = [e for v in xyz for e in ((float(v.max()), float(v.min())) if n else (0.0, 0.0))]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI20s", b"LASF", 0, 16, 0, 0, 0, b"", 1, 4, b"", b"rangeloom", 1, 1, 375, 375, 0, 7, LAS_POINT.itemsize, 0, b"")
    head += struct.pack("<12d", 0.001, 0.001, 0.001, *low, *ends) + struct.pack("<QQIQ15Q", 0, 0, 0, n, n, *[0] * 14)
    return head + rows.tobytes()


#: Fixed values of the snapshot message: magic, then sequence number, count, origin and step; one centimetre steps.
SNAPSHOT_MAGIC, SNAPSHOT_HEAD, STEP, FARTHEST = b"LWC1", struct.Struct("<4sII3ff"), 0.01, 32767


def snapshot_rows(points: DataFrame, origin: tuple[float, float, float], budget: int, order: str) -> DataFrame:
    """(qx, qy, qz, red, green, blue): every stride-th point by `order`, quantised around the snapped origin; hidden and too far ones dropped."""
    n = points.count()
    stride = max(1, -(-n // max(1, budget)))
    from rangeloom.operators.ordered import prefix_offsets

    placed = prefix_offsets(points.withColumn("one", F.lit(1)), order, "one").where(F.col("offset") % stride == 0)
    snapped = [round(o / STEP) * STEP for o in origin]
    q = placed.where("alpha > 0").select(*[F.rint((F.col(c) - F.lit(o)) / F.lit(STEP)).cast("int").alias(f"q{c}") for c, o in zip("xyz", snapped)], "red", "green", "blue")
    return q.where(" AND ".join(f"abs(q{c}) <= {FARTHEST}" for c in "xyz"))


def encode_snapshot(rows: pa.Table, seq: int, origin: tuple[float, float, float]) -> bytes:
    snapped = [round(o / STEP) * STEP for o in origin]
    q = np.stack([rows[f"q{c}"].to_numpy() for c in "xyz"], 1).astype("<i2")
    rgb = np.stack([rows[c].to_numpy() for c in ("red", "green", "blue")], 1).astype(np.uint8)
    return SNAPSHOT_HEAD.pack(SNAPSHOT_MAGIC, seq, len(q), *snapped, STEP) + q.tobytes() + rgb.tobytes()


def decode_snapshot(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(sequence number, points in metres, colours)."""
    magic, seq, n, *rest = SNAPSHOT_HEAD.unpack_from(data)
    if magic != SNAPSHOT_MAGIC:
        raise ValueError(f"not a snapshot: {magic!r}")
    at = SNAPSHOT_HEAD.size
    q = np.frombuffer(data, "<i2", 3 * n, at).reshape(n, 3)
    return seq, np.array(rest[:3]) + q * rest[3], np.frombuffer(data, np.uint8, 3 * n, at + 6 * n).reshape(n, 3)


def snapshot_gap(size: int, most_hz: float = 10.0, bits: float = 40e6) -> float:
    """Seconds until the next snapshot after one of `size` bytes."""
    return max(1 / most_hz, 8 * size / bits)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new one where both have a key."""
    return old.join(new, key, "left_anti").unionByName(new)

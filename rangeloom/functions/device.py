"""Device, address and image expressions: types and rates by code, subnets, dense grids, palettes, turning one axis to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the known device types, those with the fast laser, and the firmware of paired returns of type 1.
DEVICES = (0, 1, 2, 3, 6, 7)
FAST, FAST_NS, SLOW_NS = (2, 3, 7), 4167, 10_000
PAIRED_DEVICE, PAIRED_FIRMWARE = 1, ("3.3.0.1", "3.3.0.6")
#: Colours of return numbers and classes, each channel of 0 to 1; the last is for all others.
PALETTE = ((0.90, 0.90, 0.90), (1.00, 0.25, 0.20), (1.00, 0.60, 0.10), (1.00, 0.95, 0.20), (0.25, 0.70, 1.00), (0.45, 1.00, 0.45), (0.85, 0.35, 1.00))


def known_device(code: Column) -> Column:
    """Whether the code is a known device type; another is carried as it is, with the slow rate."""
    return code.isin(*DEVICES)


def firing_ns(code: Column) -> Column:
    """Nanoseconds from one firing to the next."""
    return F.when(code.isin(*FAST), FAST_NS).otherwise(SLOW_NS).cast("long")


def record_profile(code: Column, firmware: Column) -> Column:
    """1 where two records of a packet are one firing's two returns."""
    return ((code == PAIRED_DEVICE) & firmware.isin(*PAIRED_FIRMWARE)).cast("long")


def ipv4(text: Column) -> Column:
    """The address as a number; null if it is none."""
    part = r"(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    return F.when(text.rlike(rf"^{part}(?:\.{part}){{3}}$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def ipv4_text(address: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def prefix_mask(bits: Column) -> Column:
    return F.lit((1 << 32) - 1).cast("long") - (F.pow(F.lit(2.0), 32 - bits).cast("long") - 1)


def same_subnet(a: Column, b: Column, bits: Column) -> Column:
    return a.bitwiseAND(prefix_mask(bits)) == b.bitwiseAND(prefix_mask(bits))


def reachable(address: Column) -> Column:
    """Whether another machine can reach it: neither unset, this machine's own, nor of the link only."""
    return (address != 0) & (F.shiftright(address, 24) != 127) & (F.shiftright(address, 16) != (169 << 8 | 254))


def host_beside(address: Column) -> Column:
    """The host address that is expected on a sensor's /24: .50, or .51 if that is the sensor."""
    return address - address % 256 + F.when(address % 256 == 50, 51).otherwise(50)


def flat_cell(cell: list[Column], dims: tuple[int, int, int]) -> Column:
    """A cell's place in a dense grid, x fastest; -1 outside."""
    inside = [(c >= 0) & (c < n) for c, n in zip(cell, dims)]
    return F.when(inside[0] & inside[1] & inside[2], (cell[2] * dims[1] + cell[1]) * dims[0] + cell[0]).otherwise(F.lit(-1)).cast("long")


def flat_centre(flat: Column, dims: tuple[int, int, int], origin: tuple, size: float) -> list[Column]:
    """Where the middle of that place's cell is."""
    cell = [flat % dims[0], F.floor(flat / dims[0]) % dims[1], F.floor(flat / (dims[0] * dims[1]))]
    return [o + (c + 0.5) * size for o, c in zip(origin, cell)]


def palette(k: Column) -> list[Column]:
    """Red, green and blue of a small number."""
    row = F.when((k >= 0) & (k < len(PALETTE) - 1), k.cast("int")).otherwise(len(PALETTE) - 1)
    return [F.element_at(F.array(*[F.lit(c[i]) for c in PALETTE]), row + 1) for i in range(3)]


#: Fixed values of the hue walk: the step, the start, and the saturation.
HUE_STEP, HUE_START, SATURATION = 0.6180339887, 0.11, 0.72


def hue(k: Column) -> list[Column]:
    """A colour for each number, far from its neighbours': full brightness, hues a golden step apart.

    A channel is full within one sixth of the circle of its own hue, at its least beyond two, and linear between.
    """
    turn = k * HUE_STEP + HUE_START
    h = (turn - F.floor(turn)) * 6.0
    out = []
    for own in (0.0, 2.0, 4.0):
        away = F.least(F.abs(h - own), 6.0 - F.abs(h - own))
        out.append(1.0 - SATURATION * F.least(F.greatest(away - 1.0, F.lit(0.0)), F.lit(1.0)))
    return out


def turn_onto(v: list[Column], a: list[Column], b: tuple[float, float, float]) -> list[Column]:
    """v turned by the shortest rotation that takes direction a onto the unit vector b; a half turn about x where they are opposite."""
    length = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    u = [c / length for c in a]
    axis = [u[1] * b[2] - u[2] * b[1], u[2] * b[0] - u[0] * b[2], u[0] * b[1] - u[1] * b[0]]
    cosine = u[0] * b[0] + u[1] * b[1] + u[2] * b[2]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    once = cross(axis, v)
    twice = cross(axis, once)
    straight = axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2] < 1e-18
    return [F.when(straight, F.when(cosine > 0, c).otherwise(c if k == 0 else -c)).otherwise(c + o + t / (1.0 + cosine)) for k, (c, o, t) in enumerate(zip(v, once, twice))]


def voxel_weight(n: Column, smallest: Column, tight: Column, size: float, noise: float, miss2: Column, kernel: float) -> list[Column]:
    """(tight, loose) information of a voxel's mean: a well-met voxel that is thin in one direction holds that one, loosely the others; any other all alike and little.

    `smallest` is its least eigenvalue, `tight` how many directions are thin, `miss2` the squared distance of the point; weights fall
    with (1 + miss2 / kernel^2)^-2.
    """
    known = (n >= 5) & (tight <= 1) & (smallest < (0.6 * size) ** 2 / 12)
    alone = 0.05 / (size * size / 4 + noise * noise)
    robust = F.pow(1 + miss2 / (kernel * kernel), F.lit(-2.0))
    strict = F.when(known, 1 / (smallest + noise * noise)).otherwise(F.lit(alone))
    return [robust * strict, robust * F.when(known, 0.05 * strict).otherwise(F.lit(alone))]

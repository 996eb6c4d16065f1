"""Column expressions over points: attribute bits, voxel keys, poses, colours, closed-form eigenvalues."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A voxel key packs three cell numbers of 21 bits, each shifted by half its range.
CELL_BITS = 21
CELL_BIAS = 1 << 20
CELL_MASK = (1 << CELL_BITS) - 1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_attr(refl: Column, tag: Column, ret: Column, dev: Column) -> Column:
    return refl.bitwiseOR(F.shiftleft(tag, 8)).bitwiseOR(F.shiftleft(ret, 16)).bitwiseOR(F.shiftleft(dev, 24))


def unpack_attr(attr: Column) -> dict[str, Column]:
    """refl, tag, ret and dev: eight bits each from the lowest."""
    return {n: F.shiftright(attr, 8 * k).bitwiseAND(F.lit(255)) for k, n in enumerate(("refl", "tag", "ret", "dev"))}


def cell(v: Column | str, size: float) -> Column:
    """The number of the cell that holds v: divided before the floor, never by integers."""
    return F.floor(col(v) / F.lit(float(size)))


def voxel_key(i: Column, j: Column, k: Column) -> Column:
    """One number for a cell; cells 2**20 or more from the origin raise."""
    def part(c: Column) -> Column:
        ok = (c >= -CELL_BIAS) & (c < CELL_BIAS)
        return F.when(ok, c + CELL_BIAS).otherwise(F.raise_error(F.lit("cell outside the voxel key's range")).cast("long"))

    return F.shiftleft(part(i), 2 * CELL_BITS).bitwiseOR(F.shiftleft(part(j), CELL_BITS)).bitwiseOR(part(k))


def voxel_cells(key: Column) -> tuple[Column, Column, Column]:
    at = lambda s: F.shiftright(key, s).bitwiseAND(F.lit(CELL_MASK)) - CELL_BIAS
    return at(2 * CELL_BITS), at(CELL_BITS), at(0)


def range2(x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
    return col(x) * col(x) + col(y) * col(y) + col(z) * col(z)


def raw_filter(min_range: int, max_range: int, min_refl: int, noise_mask: int, ret_mask: int) -> Column:
    """Range bounds inclusive, reflectivity at least, and the bits of tag and return (both modulo four) set in their masks."""
    bit = lambda mask, c: (F.col(c) % 4).isin([k for k in range(4) if mask >> k & 1])
    return range2().between(min_range**2, max_range**2) & (F.col("refl") >= min_refl) & bit(noise_mask, "tag") & bit(ret_mask, "ret")


def crop(lo: tuple, hi: tuple) -> Column:
    """Inside an axis-aligned box, faces included."""
    out = F.lit(True)
    for c, a, b in zip("xyz", lo, hi):
        out = out & F.col(c).between(a, b)
    return out


def transform(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A row-major 4x4 matrix in an array, times a point."""
    at = lambda r, c: F.get(m, F.lit(4 * r + c))
    return [at(r, 0) * x + at(r, 1) * y + at(r, 2) * z + at(r, 3) for r in range(3)]


def mount_matrix(roll: float, pitch: float, yaw: float, x: float, y: float, z: float) -> list[float]:
    """Rz * Ry * Rx from degrees, then a shift; row-major."""
    a, b, c = (math.radians(v) for v in (roll, pitch, yaw))
    ca, sa, cb, sb, cc, sc = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(c), math.sin(c)
    return [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, x, sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, y, -sb, cb * sa, cb * ca, z, 0.0, 0.0, 0.0, 1.0]


def rotate(theta: list[Column], p: list[Column]) -> list[Column]:
    """p turned by a rotation vector; nothing for a zero one."""
    angle = F.sqrt(sum((t * t for t in theta[1:]), theta[0] * theta[0]))
    safe = F.when(angle == 0, F.lit(1.0)).otherwise(angle)
    u = [t / safe for t in theta]
    dot = u[0] * p[0] + u[1] * p[1] + u[2] * p[2]
    cross = [u[1] * p[2] - u[2] * p[1], u[2] * p[0] - u[0] * p[2], u[0] * p[1] - u[1] * p[0]]
    return [F.when(angle == 0, v).otherwise(v * F.cos(angle) + w * F.sin(angle) + k * dot * (1 - F.cos(angle))) for v, w, k in zip(p, cross, u)]


def deskew(p: list[Column], rho: list[Column], theta: list[Column], s: Column) -> list[Column]:
    """A point moved to the middle of its frame: turned by theta * s, shifted by rho * s; s from -1/2 to 1/2 frames."""
    return [a + b * s for a, b in zip(rotate([t * s for t in theta], p), rho)]


#: Coefficients of the published polynomial approximation of the Turbo colour map, lowest power first.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def turbo(v: Column, lo: float, hi: float) -> list[Column]:
    """Red, green and blue from 0 to 255 of v between lo and hi."""
    t = F.least(F.greatest((v - lo) / F.lit(max(hi - lo, 1e-6)), F.lit(0.0)), F.lit(1.0))
    out = []
    for c in TURBO:
        poly = F.lit(c[5])
        for a in c[4::-1]:
            poly = poly * t + F.lit(a)
        out.append(F.floor(F.least(F.greatest(poly, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5))
    return out


def pack_rgba(r: Column, g: Column, b: Column, a: int = 255) -> Column:
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.shiftleft(F.lit(a).cast("long"), 24))


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """The three eigenvalues of a symmetric matrix, largest first, by the trigonometric closed form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off
    p = F.sqrt(p2 / 6)
    safe = F.when(p == 0, F.lit(1.0)).otherwise(p)
    a, d, f = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe
    b, c, e = xy / safe, xz / safe, yz / safe
    half = (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) / 2
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    top = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    flat = p == 0
    return [F.when(flat, q).otherwise(top), F.when(flat, q).otherwise(3 * q - top - low), F.when(flat, q).otherwise(low)]


def geman_mcclure(r2: Column, sigma: float) -> Column:
    return F.lit(sigma**2) * r2 / (r2 + F.lit(sigma**2))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def spline_weights(u: Column) -> list[Column]:
    """The four weights of a uniform cubic B-spline at u of its interval."""
    return [(1 - u) * (1 - u) * (1 - u) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]


def box_distance(lo: tuple, hi: tuple) -> Column:
    """The distance of (x, y, z) from an axis-aligned box, zero inside."""
    d = [F.greatest(F.lit(a) - F.col(c), F.col(c) - F.lit(b), F.lit(0)) for c, a, b in zip("xyz", lo, hi)]
    return F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).cast("double"))


def spherical(depth_mm: Column, zenith: Column, azimuth: Column) -> list[Column]:
    """x, y, z in metres from millimetres and hundredths of a degree."""
    r, t, a = depth_mm / 1000.0, F.radians(zenith / 100.0), F.radians(azimuth / 100.0)
    return [r * F.sin(t) * F.cos(a), r * F.sin(t) * F.sin(a), r * F.cos(t)]

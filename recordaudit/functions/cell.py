"""Unit cells, reflections and optics as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from recordaudit.functions.measured import let


def angle_or_right(angle: Column) -> Column:
    """A missing angle, or one outside 30–150°, is taken as 90°."""
    return F.when(angle.between(30, 150), angle).otherwise(90.0)


def cell_volume(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column) -> Column:
    ca, cb, cg = (F.cos(F.radians(angle_or_right(x))) for x in (al, be, ga))
    return a * b * c * F.sqrt(F.greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, F.lit(0.0)))


def inv_d2(cell: Sequence[Column], h: Column, k: Column, l: Column) -> Column:
    """1/d² of (hkl) from the direct cell (a, b, c, α, β, γ), any system."""
    a, b, c = cell[:3]
    al, be, ga = (F.radians(x) for x in cell[3:])
    ca, cb, cg = F.cos(al), F.cos(be), F.cos(ga)
    sa, sb, sg = F.sin(al), F.sin(be), F.sin(ga)
    w = F.greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, F.lit(1e-12))
    return (
        F.pow(h * sa / a, 2) + F.pow(k * sb / b, 2) + F.pow(l * sg / c, 2)
        + 2 * h * k * (ca * cb - cg) / (a * b) + 2 * k * l * (cb * cg - ca) / (b * c) + 2 * h * l * (cg * ca - cb) / (a * c)
    ) / w


def d_spacing(cell: Sequence[Column], h: Column, k: Column, l: Column) -> Column:
    return let(inv_d2(cell, h, k, l), lambda q: 1 / F.sqrt(F.when(q > 0, q)))


def two_theta(d: Column, lam: Column) -> Column:
    """2θ in degrees; null where d is under λ/2."""
    return F.when(lam / (2 * d) <= 1, 2 * F.degrees(F.asin(lam / (2 * d))))


def metric(cell: Sequence[Column]) -> Column:
    """The metric tensor's six components (g11, g22, g33, g12, g13, g23)."""
    a, b, c = cell[:3]
    ca, cb, cg = (F.cos(F.radians(x)) for x in cell[3:])
    return F.struct((a * a).alias("g11"), (b * b).alias("g22"), (c * c).alias("g33"), (a * b * cg).alias("g12"), (a * c * cb).alias("g13"), (b * c * ca).alias("g23"))


def metric_length(g: Column, x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(F.greatest(
        g["g11"] * x * x + g["g22"] * y * y + g["g33"] * z * z + 2 * (g["g12"] * x * y + g["g13"] * x * z + g["g23"] * y * z), F.lit(0.0)
    ))


def allowed_systems(cell: Sequence[Column]) -> Column:
    """``array<string>`` of the crystal systems a metric permits: axes equal within 0.2 %, angles within 0.05°.

    Downward closed — what is cubic is also tetragonal, orthorhombic …; a missing angle allows all.
    """
    a, b, c, al, be, ga = cell

    def same(x: Column, y: Column) -> Column:
        return F.abs(x - y) <= 0.002 * F.greatest(x, y)

    def near(x: Column, v: float) -> Column:
        return F.abs(x - v) <= 0.05

    missing = al.isNull() | be.isNull() | ga.isNull()
    right = near(al, 90) & near(be, 90) & near(ga, 90)
    two = (near(al, 90) & near(be, 90)) | (near(al, 90) & near(ga, 90)) | (near(be, 90) & near(ga, 90))
    hexagonal = (same(a, b) & near(al, 90) & near(be, 90) & near(ga, 120)) | (same(a, b) & same(b, c) & (F.abs(al - be) <= 0.05) & (F.abs(be - ga) <= 0.05))
    pair = same(a, b) | same(b, c) | same(a, c)
    return F.array_compact(F.array(
        F.lit("triclinic"),
        F.when(missing | two, "monoclinic"),
        F.when(missing | right, "orthorhombic"),
        F.when((missing | right) & pair, "tetragonal"),
        F.when(missing | hexagonal, "hexagonal"),
        F.when((missing | right) & same(a, b) & same(b, c), "cubic"),
    ))


# --- optics -----------------------------------------------------------------------------------


def robustly_biaxial(alpha: Column, beta: Column, gamma: Column) -> Column:
    return (alpha <= beta) & (beta <= gamma) & (gamma - alpha >= 0.008) & (F.least(beta - alpha, gamma - beta) >= 0.004)


def two_vz(alpha: Column, beta: Column, gamma: Column) -> Column:
    """2Vz in degrees from the three indices, where they are well apart; else null."""
    share = (1 / (beta * beta) - 1 / (gamma * gamma)) / (1 / (alpha * alpha) - 1 / (gamma * gamma))
    return F.when(robustly_biaxial(alpha, beta, gamma), 2 * F.degrees(F.acos(F.sqrt(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))))))


def mean_index(a: Column, b: Column, q: Column, sign: Column | None = None) -> Column:
    """(A+B+Q)/3 of a biaxial record, (2ω+ε)/3 of a uniaxial one — null when its sign contradicts the order — and the
    plain mean of A and B without Q."""
    w = F.coalesce(a, b)
    contradicts = F.lit(False) if sign is None else F.coalesce((sign == "+") != (q > w), F.lit(False))
    return (
        F.when(a.isNotNull() & b.isNotNull() & q.isNotNull(), (a + b + q) / 3)
        .when(q.isNotNull() & w.isNotNull(), F.when(~contradicts, (2 * w + q) / 3))
        .when(a.isNotNull() & b.isNotNull(), (a + b) / 2)
    )

"""Neighbour operators: gradients, divergences and the elliptic operator."""

from __future__ import annotations

from fieldloom.functions.expr import Expr, maximum, minimum, safe_div, total, var, where
from fieldloom.plans.relation import Boundary, Plan

CROSS = {"xm": (-1, 0), "xp": (1, 0), "ym": (0, -1), "yp": (0, 1)}
CORNERS = {"mm": (-1, -1), "mp": (-1, 1), "pm": (1, -1), "pp": (1, 1)}


def neighbours(field: Plan, columns: list[str], shape: tuple[int, int], bc: Boundary = "periodic", corners: bool = False, reach: int = 1) -> Plan:
    """``{c}_xm, _xp, _ym, _yp`` (and ``_xm2`` ... up to ``reach``; corners ``_mm`` ...)."""
    offsets = dict(CROSS)
    for k in range(2, reach + 1):
        offsets |= {f"xm{k}": (-k, 0), f"xp{k}": (k, 0), f"ym{k}": (0, -k), f"yp{k}": (0, k)}
    if corners:
        offsets |= CORNERS
    return field.shift(columns, offsets, shape, bc)


def reach_needed(limiter: str, offered: int) -> None:
    """An error if a field's ghost depth is less than a limiter reads."""
    from fieldloom.functions.physics import LIMITERS

    if offered < LIMITERS[limiter][1]:
        raise ValueError(f"{limiter} reads {LIMITERS[limiter][1]} neighbours, the field has {offered}")


def laplacian_of(c: str, dx: float, dy: float) -> Expr:
    """The five-point formula over a field with neighbours."""
    u = var(c)
    x = (var(f"{c}_xp") - u * 2.0 + var(f"{c}_xm")) / (dx * dx)
    y = (var(f"{c}_yp") - u * 2.0 + var(f"{c}_ym")) / (dy * dy)
    return x + y


def laplacian(field: Plan, c: str, shape, dx: float = 1.0, dy: float = 1.0, bc: Boundary = "periodic", out: str = "lap") -> Plan:
    return neighbours(field, [c], shape, bc).select(*field.columns, **{out: laplacian_of(c, dx, dy)})


def gradient(field: Plan, c: str, shape, dx: float = 1.0, dy: float = 1.0, bc: Boundary = "periodic", scale: float = 1.0, divide: bool = False) -> Plan:
    """Centred differences ``grad_x, grad_y``; ``divide``: by 2 dx, else times its inverse, which rounds differently."""
    x = neighbours(field, [c], shape, bc)
    gx, gy = var(f"{c}_xp") - var(f"{c}_xm"), var(f"{c}_yp") - var(f"{c}_ym")
    if divide:
        gx, gy = gx / (2.0 * dx), gy / (2.0 * dy)
    else:
        gx, gy = gx * (scale * (1.0 / (2.0 * dx))), gy * (scale * (1.0 / (2.0 * dy)))
    return x.select(*field.columns, grad_x=gx, grad_y=gy)


def divergence(field: Plan, fx: str, fy: str, shape, dx: float = 1.0, dy: float = 1.0, bc: Boundary = "periodic", sign: float = 1.0, out: str = "div") -> Plan:
    x = field.shift([fx], {"xm": (-1, 0), "xp": (1, 0)}, shape, bc).shift([fy], {"ym": (0, -1), "yp": (0, 1)}, shape, bc)
    value = (var(f"{fx}_xp") - var(f"{fx}_xm")) / (2.0 * dx) + (var(f"{fy}_yp") - var(f"{fy}_ym")) / (2.0 * dy)
    return x.select(*field.columns, **{out: value * sign if sign != 1.0 else value})


def harmonic(a: Expr, b: Expr) -> Expr:
    """The face value of a coefficient."""
    return safe_div(a * b * 2.0, a + b)


def coefficient_operator(
    field: Plan, c: str, shape, dx: float = 1.0, dy: float = 1.0, bc: Boundary = "periodic", eps_x: str | None = None, eps_y: str | None = None, kappa: str | None = None, cross: tuple[str, str] | None = None, out: str = "lap"
) -> Plan:
    """div(eps grad u) - kappa u, harmonic face coefficients; ``cross`` (a_xy, a_yx) adds the nine-point terms."""
    cols = [c] + sorted({e for e in (eps_x, eps_y) if e})
    x = neighbours(field, cols, shape, bc)
    u = var(c)

    def along(eps: str | None, p: str, m: str, h: float) -> Expr:
        up, down = var(f"{c}_{p}") - u, u - var(f"{c}_{m}")
        if eps:
            up, down = harmonic(var(eps), var(f"{eps}_{p}")) * up, harmonic(var(eps), var(f"{eps}_{m}")) * down
        return (up - down) / (h * h)

    value = along(eps_x, "xp", "xm", dx) + along(eps_y, "yp", "ym", dy)
    if cross:
        x = x.shift([c], CORNERS, shape, bc).shift([cross[0]], {"xm": (-1, 0), "xp": (1, 0)}, shape, bc).shift([cross[1]], {"ym": (0, -1), "yp": (0, 1)}, shape, bc)
        xy = var(f"{cross[0]}_xp") * (var(f"{c}_pp") - var(f"{c}_pm")) - var(f"{cross[0]}_xm") * (var(f"{c}_mp") - var(f"{c}_mm"))
        yx = var(f"{cross[1]}_yp") * (var(f"{c}_pp") - var(f"{c}_mp")) - var(f"{cross[1]}_ym") * (var(f"{c}_pm") - var(f"{c}_mm"))
        value = value + (xy + yx) / (4.0 * dx * dy)
    if kappa:
        value = value - var(kappa) * u
    return x.select(*field.columns, **{out: value})


def residual(field: Plan, c: str, rhs: str, shape, dx: float = 1.0, dy: float = 1.0, bc: Boundary = "periodic", mask: str | None = None, out: str = "r") -> Plan:
    """rhs - L(u), zero where the mask is off."""
    value = var(rhs) - laplacian_of(c, dx, dy)
    if mask:
        value = where(var(mask) >= 0.5, value, 0.0)
    return neighbours(field, [c], shape, bc).select(*field.columns, **{out: value})


def gauss_seidel_half(field: Plan, c: str, rhs: str, shape, color: int, dx: float = 1.0, dy: float = 1.0, bc: Boundary = "periodic", kappa: float = 0.0) -> Plan:
    """One colour of a red-black sweep: cells with ``(i + j) % 2 == color``."""
    from fieldloom.plans.relation import raw

    off = (var(f"{c}_xp") + var(f"{c}_xm")) / (dx * dx) + (var(f"{c}_yp") + var(f"{c}_ym")) / (dy * dy)
    new = (off - var(rhs)) / (2.0 / (dx * dx) + 2.0 / (dy * dy) + kappa)
    mine = raw("cast((i + j) % 2 as double)", "((i + j) % 2)::DOUBLE").eq(float(color))
    return neighbours(field, [c], shape, bc).with_(**{c: where(mine, new, var(c))}).select(*field.columns)


def zero_conductor(field: Plan, c: str, mask: str) -> Plan:
    """The potential is zero where the mask is off."""
    return field.with_(**{c: where(var(mask) >= 0.5, var(c), 0.0)})


#: A crossing is no nearer than this part of the way; nearer ones would have unbounded weights.
CUT_LEAST = 1e-3


def cut_distance(here: Expr, there: Expr) -> Expr:
    """Part of the way to a neighbour at which the level set crosses zero (1: it doesn't)."""
    crosses = (here < 0.0) & (there >= 0.0)
    return where(crosses, minimum(maximum(safe_div(here, here - there, 1.0), CUT_LEAST), 1.0), 1.0)


def shortley_weller(u: str, theta: dict[str, Expr], dx: float, dy: float) -> Expr:
    """The five-point formula with shortened arms whose ends are zero on the boundary."""

    def axis(p: str, m: str, h: float) -> Expr:
        a, b = theta[p], theta[m]
        up = where(a < 1.0, 0.0, var(f"{u}_{p}"))
        down = where(b < 1.0, 0.0, var(f"{u}_{m}"))
        return ((up - var(u)) / a - (var(u) - down) / b) * 2.0 / ((a + b) * (h * h))

    return axis("xp", "xm", dx) + axis("yp", "ym", dy)


def weighted(terms: list[tuple[float, str]]) -> Expr:
    """A linear combination of columns, from left to right."""
    return total([var(c) * a for a, c in terms])

"""Moment hierarchies: generated projections of velocity moments M_pq, p + q <= order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb, pi

from fieldloom.functions.expr import Expr, const, smooth_floor, sqrt, total, var

Closure = Callable[[dict[tuple[int, int], Expr]], dict[tuple[int, int], Expr]]


def indices(order: int) -> list[tuple[int, int]]:
    """(p, q), q outer."""
    return [(p, q) for q in range(order + 1) for p in range(order + 1 - q)]


def name(p: int, q: int) -> str:
    return f"m{p}{q}"


def names(order: int) -> list[str]:
    return [name(p, q) for p, q in indices(order)]


def _power(x: Expr, n: int) -> Expr:
    out = const(1)
    for k in range(n):
        out = x if k == 0 else out * x
    return out


def central(order: int, m: dict[tuple[int, int], Expr] | None = None) -> dict[tuple[int, int], Expr]:
    """Central moments per unit density, by the binomial rule."""
    m = m or {k: var(name(*k)) for k in indices(order)}
    rho = m[0, 0]
    u, v = m[1, 0] / rho, m[0, 1] / rho
    out = {}
    for p, q in indices(order):
        terms = [m[a, b] / rho * _power(-u, p - a) * _power(-v, q - b) * float(comb(p, a) * comb(q, b)) for a in range(p + 1) for b in range(q + 1)]
        out[p, q] = total(terms)
    return out


def standardized(c: dict[tuple[int, int], Expr], floor: float = 1e-12) -> dict[tuple[int, int], Expr]:
    sx, sy = sqrt(smooth_floor(c[2, 0], floor)), sqrt(smooth_floor(c[0, 2], floor))
    return {(p, q): e / (_power(sx, p) * _power(sy, q)) for (p, q), e in c.items()}


def gaussian_closure(order: int) -> Closure:
    """Standardized moments of the next order as a Gaussian's: odd ones are zero, even
    ones follow Stein's recurrence from the correlation."""

    def close(s: dict[tuple[int, int], Expr]) -> dict[tuple[int, int], Expr]:
        rho = s[1, 1]

        def moment(p: int, q: int) -> Expr:
            if (p + q) % 2 or p < 0 or q < 0:
                return const(0)
            if (p, q) == (0, 0):
                return const(1)
            if p:
                parts = ([moment(p - 2, q) * float(p - 1)] if p > 1 else []) + ([rho * moment(p - 1, q - 1) * float(q)] if q else [])
            else:
                parts = [moment(0, q - 2) * float(q - 1)]
            return total(parts) if parts else const(0)

        return {(p, order + 1 - p): moment(p, order + 1 - p) for p in range(order + 2)}

    return close


def hyqmom15_closure(kind: str = "levermore") -> Closure:
    """Order four: ``levermore`` is the Gaussian closure of that order; ``custom`` isn't built in."""
    if kind == "levermore":
        return gaussian_closure(4)
    if kind == "custom":
        raise NotImplementedError("pass your own closure")
    raise ValueError(f"unknown closure {kind!r}")


def fluxes(order: int, closure: Closure | None = None, floor: float = 1e-12) -> tuple[dict[str, Expr], dict[str, Expr]]:
    """F_x[M_pq] = M_{p+1,q} and F_y[M_pq] = M_{p,q+1}; the top order is closed and put back."""
    close = closure or gaussian_closure(order)
    m = {k: var(name(*k)) for k in indices(order)}
    c = central(order, m)
    s = standardized(c, floor)
    top = close(s)
    sx, sy = sqrt(smooth_floor(c[2, 0], floor)), sqrt(smooth_floor(c[0, 2], floor))
    full = dict(c) | {(p, q): e * _power(sx, p) * _power(sy, q) for (p, q), e in top.items()}
    rho, u, v = m[0, 0], m[1, 0] / m[0, 0], m[0, 1] / m[0, 0]

    def back(p: int, q: int) -> Expr:
        if (p, q) in m:
            return m[p, q]
        terms = [full[a, b] * _power(u, p - a) * _power(v, q - b) * float(comb(p, a) * comb(q, b)) for a in range(p + 1) for b in range(q + 1)]
        return total(terms) * rho

    return {name(p, q): back(p + 1, q) for p, q in indices(order)}, {name(p, q): back(p, q + 1) for p, q in indices(order)}


def lorentz_sources(order: int, qm: float, ex: Expr, ey: Expr, wc: Expr) -> dict[str, Expr]:
    out = {}
    known = set(indices(order))

    def m(p: int, q: int) -> Expr:
        return var(name(p, q)) if (p, q) in known else const(0)

    for p, q in indices(order):
        terms = []
        if p:
            terms += [ex * m(p - 1, q) * (qm * p), wc * m(p - 1, q + 1) * float(p)]
        if q:
            terms += [ey * m(p, q - 1) * (qm * q), -(wc * m(p + 1, q - 1) * float(q))]
        out[name(p, q)] = total(terms) if terms else const(0)
    return out


def maxwellian(order: int, rho: Expr, u: Expr, v: Expr, t: Expr) -> dict[str, Expr]:
    """Moments of an isotropic Gaussian (order up to four)."""
    if order > 4:
        raise ValueError("Maxwellian moments go up to order four")

    def one(w: Expr, n: int) -> Expr:
        return [const(1), w, w * w + t, w * w * w + w * t * 3.0, w * w * w * w + w * w * t * 6.0 + t * t * 3.0][n]

    return {name(p, q): rho * one(u, p) * one(v, q) for p, q in indices(order)}


def bgk_source(order: int, nu: float) -> dict[str, Expr]:
    """nu (Maxwellian - M), with the density, velocity and mean temperature of M."""
    rho = var(name(0, 0))
    u, v = var(name(1, 0)) / rho, var(name(0, 1)) / rho
    t = ((var(name(2, 0)) + var(name(0, 2))) / rho - u * u - v * v) * 0.5
    return {n: (e - var(n)) * nu for n, e in maxwellian(order, rho, u, v, t).items()}


@dataclass(frozen=True)
class RealizabilityProjection:
    """Floors under the density and the two variances."""

    density: float = 1e-12
    variance: float = 1e-12

    def apply(self) -> dict[str, Expr]:
        rho = smooth_floor(var(name(0, 0)), self.density)
        u, v = var(name(1, 0)) / rho, var(name(0, 1)) / rho
        out = {name(0, 0): rho}
        for n, w in ((name(2, 0), u), (name(0, 2), v)):
            out[n] = (smooth_floor(var(n) / rho - w * w, self.variance) + w * w) * rho
        return out


@dataclass(frozen=True)
class MomentModel:
    """A hierarchy as a transport model: state columns and fluxes by direction."""

    order: int = 2
    closure: Closure | None = None

    @property
    def names(self) -> list[str]:
        return names(self.order)

    def flux(self, u, aux, direction):
        table = fluxes(self.order, self.closure)[direction]
        env = dict(zip(self.names, u))
        return [table[n].substitute(env) for n in self.names]

    def max_speed(self, u, aux, direction):
        """Of the closed system's bulk: |velocity| + sqrt(3 variance)."""
        env = dict(zip(self.names, u))
        w = env[name(1, 0) if direction == 0 else name(0, 1)] / env[name(0, 0)]
        second = env[name(2, 0) if direction == 0 else name(0, 2)] / env[name(0, 0)]
        return abs(w) + sqrt(smooth_floor(second - w * w, 1e-12) * 3.0)


TWO_PI = 2 * pi

"""Cell-wise operators: combinations, masks, conversions and projections."""

from __future__ import annotations

from collections.abc import Callable

from fieldloom.functions.expr import Expr, abs_, maximum, safe_div, total, var, where
from fieldloom.plans.relation import Plan


def saxpy(field: Plan, y: str, a: float, x: str) -> Plan:
    """y += a x."""
    return field.with_(**{y: var(y) + var(x) * a})


def lincomb(field: Plan, out: str, terms: list[tuple[float, str]]) -> Plan:
    return field.with_(**{out: total([var(c) * a for a, c in terms])})


def compare(field: Plan, c: str, op: str, value: float, out: str = "mask") -> Plan:
    """A 0/1 column; ``op``: gt, ge, lt or le."""
    tests: dict[str, Callable[[Expr], Expr]] = {"gt": lambda x: x > value, "ge": lambda x: x >= value, "lt": lambda x: x < value, "le": lambda x: x <= value}
    return field.with_(**{out: where(tests[op](var(c)), 1.0, 0.0)})


def select_where(field: Plan, mask: str, columns: list[tuple[str, str, str]]) -> Plan:
    """For each ``(out, a, b)``: a where the mask is on, else b."""
    return field.with_(**{out: where(var(mask) >= 0.5, var(a), var(b)) for out, a, b in columns})


def to_primitive(field: Plan, model, prefix: str = "p_") -> Plan:
    return field.with_(**{prefix + n: e for n, e in zip(model.names, model.to_primitive([var(c) for c in model.names]))})


def to_conservative(field: Plan, model, prefix: str = "p_", out: str = "c_") -> Plan:
    return field.with_(**{out + n: e for n, e in zip(model.names, model.to_conservative([var(prefix + c) for c in model.names]))})


def project(field: Plan, model, projection: Callable | None = None) -> Plan:
    """U <- project(U), by default a floor under the density."""
    u = [var(c) for c in model.names]
    new = projection(u, {}) if projection else [maximum(u[0], 1e-12), *u[1:]]
    return field.with_(**dict(zip(model.names, new)))


def temperature(field: Plan, model, out: str = "t_e") -> Plan:
    """p / rho of a fluid."""
    u = [var(c) for c in model.names]
    return field.with_(**{out: safe_div(model.pressure(u), u[0])})


def static_aux(field: Plan, **values: Expr | float) -> Plan:
    """Shared fields that don't change, by name."""
    return field.with_(**values)


def wall(geometry, kind: str = "none", radius: float = 0.0) -> Expr | None:
    """Inside a wall: everything, or a circle in the middle (strictly)."""
    if kind == "none":
        return None
    if kind != "circle":
        raise ValueError(f"unknown wall {kind!r}")
    from fieldloom.functions.expr import sqrt

    x = geometry.x() - (geometry.x0 + geometry.x1) / 2
    y = geometry.y() - (geometry.y0 + geometry.y1) / 2
    return sqrt(x * x + y * y) < radius


Level = Callable[[Expr, Expr], Expr]


def disc(cx: float, cy: float, radius2: float) -> Level:
    """A level set: negative inside a disc of that squared radius."""
    return lambda x, y: (x - cx) * (x - cx) + (y - cy) * (y - cy) - radius2


def half_plane(a: float, b: float, c: float) -> Level:
    return lambda x, y: x * a + y * b - c


def disc_level(geometry, cx: float, cy: float, radius2: float) -> Expr:
    return disc(cx, cy, radius2)(geometry.x(), geometry.y())


def half_plane_level(geometry, a: float, b: float, c: float) -> Expr:
    return half_plane(a, b, c)(geometry.x(), geometry.y())


def smallest_relative(a: Expr, b: Expr) -> Expr:
    return abs_(a - b)

"""Reductions: norms, masses, speeds, and checks. All are global."""

from __future__ import annotations

from fieldloom.functions.expr import Expr, abs_, maximum, minimum, sqrt, total, var, where
from fieldloom.plans.relation import Plan, raw


def stats(field: Plan, c: str) -> Plan:
    """Sum, largest, smallest and largest absolute value in one pass."""
    return field.group([], sum=("sum", c), max=("max", c), min=("min", c), norm_inf=("max", abs_(var(c))))


def norm(field: Plan, columns: list[str], kind: str, volume: float = 1.0) -> Plan:
    """L1, L2 or Linf over all components."""
    each = [var(c) for c in columns]
    if kind == "l1":
        return field.group([], s=("sum", total([abs_(x) for x in each]))).select(norm=var("s") * volume)
    if kind == "l2":
        return field.group([], s=("sum", total([x * x for x in each]))).select(norm=sqrt(var("s") * volume))
    worst = abs_(each[0])
    for x in each[1:]:
        worst = maximum(worst, abs_(x))
    return field.group([], norm=("max", worst))


def dot(field: Plan, pairs: list[tuple[str, str]]) -> Plan:
    """Sum of products over components."""
    return field.group([], dot=("sum", total([var(a) * var(b) for a, b in pairs])))


def mass(field: Plan, c: str, weight: Expr | float = 1.0) -> Plan:
    """Bare sum on a Cartesian mesh; pass cell areas (r dr dtheta, dx dy) otherwise."""
    return field.group([], mass=("sum", var(c) * weight))


def integral(field: Plan, c: str, area: float) -> Plan:
    return field.group([], s=("sum", c)).select(integral=var("s") * area)


def speed(model, aux: dict | None = None) -> Expr:
    """The larger of the two directions' speeds."""
    u, a = [var(c) for c in model.names], aux or {}
    return maximum(model.max_speed(u, a, 0), model.max_speed(u, a, 1))


def max_speed(field: Plan, model, aux: dict | None = None) -> Plan:
    return field.group([], w=("max", speed(model, aux))).select(w=maximum(var("w"), 0.0))


def hotspot(field: Plan, model, nx: int, aux: dict | None = None) -> Plan:
    """The cell of the largest speed; ties: the first by ``j * nx + i``."""
    return field.select("i", "j", w=speed(model, aux), place=raw(f"cast(j * {nx} + i as bigint)", f"(j * {nx} + i)::BIGINT")).top([("w", True), ("place", False)], 1).select("i", "j", "w")


def cfl_dt(field: Plan, model, h: float, cfl: float = 0.4, substeps: int = 1, stride: int = 1, frequency: Expr | None = None) -> Plan:
    """The step allowed by the speed (at least 1e-30) and by a source's frequency, and which of them binds."""
    aggs = {"w": ("max", speed(model))}
    if frequency is not None:
        aggs["mu"] = ("max", frequency)
    x = field.group([], **aggs)
    moving = (maximum(var("w"), 1e-30) * stride).__rtruediv__(cfl * h * substeps)
    if frequency is None:
        return x.select("w", dt=moving)
    source = maximum(var("mu"), 1e-30).__rtruediv__(cfl)
    return x.select("w", dt=minimum(moving, source), by_source=where(source < moving, 1.0, 0.0))


def model_check(field: Plan, model) -> Plan:
    """How many cells aren't positive where they must be, and the worst round trip through primitives."""
    u = [var(c) for c in model.names]
    back = model.to_conservative(model.to_primitive(u))
    worst = abs_(back[0] - u[0])
    for a, b in zip(back[1:], u[1:]):
        worst = maximum(worst, abs_(a - b))
    return field.group([], bad_density=("sum", where(u[0] <= 0.0, 1.0, 0.0)), bad_pressure=("sum", where(model.pressure(u) <= 0.0, 1.0, 0.0)), round_trip=("max", worst))


def check_invariant(before: float, after: float, tolerance: float = 1e-10) -> bool:
    return abs(after - before) <= tolerance * max(1.0, abs(before))

"""Time integration: stages of one step as one plan, steps as a loop on the driver.

``rate`` takes a field plan and gives the same columns plus ``r_{component}``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from fieldloom.functions.expr import Expr, total, var
from fieldloom.plans.relation import Plan

Rate = Callable[[Plan], Plan]


def euler(u: Plan, rate: Rate, names: list[str], dt: float) -> Plan:
    """U += dt R."""
    return rate(u).with_(**{c: var(c) + var(f"r_{c}") * dt for c in names}).select(*u.columns)


def _mixed(u: Plan, rate: Rate, names: list[str], dt: float, a: float, b: float) -> Plan:
    """a U0 + b (U + dt R(U)); ``z_{c}`` are the columns of U0."""
    return rate(u).with_(**{c: var(f"z_{c}") * a + (var(c) + var(f"r_{c}") * dt) * b for c in names}).select(*u.columns)


def _with_start(u: Plan, names: list[str]) -> Plan:
    return u.with_(**{f"z_{c}": var(c) for c in names})


def ssprk2(u: Plan, rate: Rate, names: list[str], dt: float) -> Plan:
    x = euler(_with_start(u, names), rate, names, dt)
    return _mixed(x, rate, names, dt, 0.5, 0.5).select(*u.columns)


def ssprk3(u: Plan, rate: Rate, names: list[str], dt: float) -> Plan:
    x = euler(_with_start(u, names), rate, names, dt)
    x = _mixed(x, rate, names, dt, 0.75, 0.25)
    return _mixed(x, rate, names, dt, 1.0 / 3.0, 2.0 / 3.0).select(*u.columns)


@dataclass(frozen=True)
class Tableau:
    """An explicit Runge-Kutta method: strictly lower triangular, weights that sum to one."""

    a: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]

    def __post_init__(self):
        if len(self.a) != len(self.b) or any(len(row) != k for k, row in enumerate(self.a)):
            raise ValueError("row k of the tableau needs k entries")
        if abs(sum(self.b) - 1) > 1e-12:
            raise ValueError("the weights must sum to one")


RK4 = Tableau(((), (0.5,), (0.0, 0.5), (0.0, 0.0, 1.0)), (1 / 6, 1 / 3, 1 / 3, 1 / 6))


def runge_kutta(u: Plan, rate: Rate, names: list[str], dt: float, tableau: Tableau = RK4) -> Plan:
    x = _with_start(u, names)
    for k, row in enumerate(tableau.a):
        terms = [(w, q) for q, w in enumerate(row) if w]
        if terms:
            x = x.with_(**{c: total([var(f"z_{c}"), *[var(f"k{q}_{c}") * (w * dt) for w, q in terms]]) for c in names})
        x = rate(x).rename(**{f"r_{c}": f"k{k}_{c}" for c in names})
    done = {c: total([var(f"z_{c}"), *[var(f"k{k}_{c}") * (b * dt) for k, b in enumerate(tableau.b) if b]]) for c in names}
    return x.with_(**done).select(*u.columns)


#: Adams-Bashforth weights by order, newest first.
ADAMS = {1: (1.0,), 2: (1.5, -0.5), 3: (23.0 / 12.0, -16.0 / 12.0, 5.0 / 12.0)}


def adams_bashforth(u: Plan, rate: Rate, names: list[str], dt: float, order: int, steps: int) -> Plan:
    """Cold start: the first rate fills all places of the history."""
    history: list[str] = []
    x = u
    for n in range(steps):
        x = rate(x).rename(**{f"r_{c}": f"h{n}_{c}" for c in names})
        history = [f"h{n}", *history]
        if n == 0:
            history = [f"h{n}"] * order
        terms = list(zip(ADAMS[order], history))
        x = x.with_(**{c: total([var(c), *[var(f"{h}_{c}") * (w * dt) for w, h in terms]]) for c in names})
        history = history[:order]
    return x.select(*u.columns)


def bdf2_linear(u0: str, u1: str, lam: Expr | float, dt: float) -> Expr:
    """The next value of u' = lam u from the last two: (4 u1 - u0) / (3 - 2 dt lam)."""
    return (var(u1) * 4.0 - var(u0)) / (3.0 - (lam * (2.0 * dt) if isinstance(lam, Expr) else 2.0 * dt * lam))


def backward_euler_linear(c: str, lam: float, dt: float) -> Expr:
    return var(c) / (1.0 - dt * lam)


def lie(u: Plan, transport: Callable[[Plan, float], Plan], source: Callable[[Plan, float], Plan], dt: float) -> Plan:
    return source(transport(u, dt), dt)


def strang(u: Plan, transport: Callable[[Plan, float], Plan], source: Callable[[Plan, float], Plan], dt: float, fields: Callable[[Plan], Plan] | None = None) -> Plan:
    """Half transport, source, half transport; fields are solved again before each stage."""
    again = fields or (lambda x: x)
    return transport(again(source(again(transport(again(u), dt / 2)), dt)), dt / 2)


def imex_euler(u: Plan, rate: Rate, names: list[str], implicit: Callable[[Plan, float], Plan], dt: float) -> Plan:
    """One forward Euler step of transport, then backward Euler of the source."""
    return implicit(euler(u, rate, names, dt), dt)


GAMMA = 1 - 1 / 2**0.5
DELTA = 1 - 1 / (2 * GAMMA)


def ars222(u: Plan, rate: Rate, names: list[str], lam: dict[str, float], dt: float) -> Plan:
    """ARS(2,2,2) with the linear source ``lam`` per component."""
    x = rate(_with_start(u, names)).rename(**{f"r_{c}": f"k0_{c}" for c in names})
    x = x.with_(**{c: (var(f"z_{c}") + var(f"k0_{c}") * (GAMMA * dt)) / (1.0 - GAMMA * dt * lam[c]) for c in names})
    x = x.with_(**{f"s_{c}": var(c) * lam[c] for c in names})
    x = rate(x).rename(**{f"r_{c}": f"k1_{c}" for c in names})
    final = {c: (var(f"z_{c}") + var(f"k0_{c}") * (DELTA * dt) + var(f"k1_{c}") * ((1 - DELTA) * dt) + var(f"s_{c}") * ((1 - GAMMA) * dt)) / (1.0 - GAMMA * dt * lam[c]) for c in names}
    return x.with_(**final).select(*u.columns)


def rotate_velocity(mx: str, my: str, w: Expr | float, theta: float = 1.0) -> dict[str, Expr]:
    """Implicit rotation m' = m + w J m, at weight theta, extrapolated: closed form."""
    from fieldloom.functions.expr import const
    from fieldloom.functions.linalg import lorentz_inverse

    angle = (w if isinstance(w, Expr) else const(w)) * theta
    inv = lorentz_inverse(angle)
    a, b = inv[0][0] * var(mx) + inv[0][1] * var(my), inv[1][0] * var(mx) + inv[1][1] * var(my)
    if theta == 1.0:
        return {mx: a, my: b}
    return {mx: var(mx) + (a - var(mx)) / theta, my: var(my) + (b - var(my)) / theta}


#: Schemes by name: ``(u, rate, names, dt)`` to the next state.
SCHEMES: dict[str, Callable[[Plan, Rate, list[str], float], Plan]] = {"euler": euler, "ssprk2": ssprk2, "ssprk3": ssprk3, "rk4": runge_kutta}


def register_scheme(name: str, step: Callable[[Plan, Rate, list[str], float], Plan]) -> None:
    """A scheme of one's own."""
    if name in SCHEMES:
        raise ValueError(f"{name!r} is taken")
    SCHEMES[name] = step


def advance(name: str, u: Plan, rate: Rate, names: list[str], dt: float) -> Plan:
    """One step of a named scheme; it must give the columns that it got."""
    if name not in SCHEMES:
        raise KeyError(f"no scheme {name!r}; known: {sorted(SCHEMES)}")
    out = SCHEMES[name](u, rate, names, dt)
    if list(out.columns) != list(u.columns):
        raise ValueError(f"{name} gave {out.columns} for {u.columns}")
    return out

"""Coupling of several fields on one mesh: equal-cell joins and projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from fieldloom.functions.expr import Expr, safe_div, total, var
from fieldloom.plans.relation import Plan, concat

Change = dict[str, Expr]


def together(blocks: dict[str, Plan]) -> Plan:
    """One row per cell with each block's components as ``{block}_{component}``."""
    out: Plan | None = None
    for name, block in blocks.items():
        x = block.rename(**{c: f"{name}_{c}" for c in block.columns if c not in ("i", "j")})
        out = x if out is None else out.join(x, ["i", "j"])
    return out


def apply_change(state: Plan, change: Change) -> Plan:
    """Forward Euler: all changes are of the state before."""
    return state.with_(**{c: var(c) + x for c, x in change.items()})


def ionization(state: Plan, electrons: str, ions: str, neutrals: str, k: float, dt: float) -> Plan:
    """One neutral becomes an ion and an electron at the rate k n_e n_g."""
    d = var(electrons) * var(neutrals) * (dt * k)
    return apply_change(state, {electrons: d, ions: d, neutrals: -d})


def collision(state: Plan, a: tuple[str, str, str], b: tuple[str, str, str], k: float, dt: float) -> Plan:
    """Momentum of two fluids (density, mx, my) drawn together; energy untouched."""
    change: Change = {}
    for c in (1, 2):
        f = (safe_div(var(a[c]), var(a[0])) - safe_div(var(b[c]), var(b[0]))) * (dt * k)
        change |= {a[c]: -f, b[c]: f}
    return apply_change(state, change)


def thermal_exchange(state: Plan, model, a: list[str], b: list[str], k: float, dt: float) -> Plan:
    """Energy flows down the difference of p / rho; both blocks need four components."""
    if len(a) != 4 or len(b) != 4:
        raise ValueError("thermal exchange needs density, momentum and energy")
    q = (safe_div(model.pressure([var(c) for c in a]), var(a[0])) - safe_div(model.pressure([var(c) for c in b]), var(b[0]))) * (dt * k)
    return apply_change(state, {a[3]: -q, b[3]: q})


@dataclass
class CoupledSource:
    """Any number of additive terms over the joined state, as expressions.

    ``pair`` adds a term to one component and takes it from another, so that their sum
    is kept; ``conserved`` tells which sums the terms keep.
    """

    terms: list[tuple[str, Expr]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    frequency: Expr | None = None

    def add(self, component: str, rate: Expr) -> CoupledSource:
        self.terms.append((component, rate))
        return self

    def pair(self, gains: str, loses: str, rate: Expr) -> CoupledSource:
        self.terms += [(gains, rate), (loses, -rate)]
        self.pairs.append((gains, loses))
        return self

    def change(self, dt: float) -> Change:
        by: dict[str, list[Expr]] = {}
        for c, rate in self.terms:
            by.setdefault(c, []).append(rate)
        return {c: total(rates) * dt for c, rates in by.items()}

    def step(self, state: Plan, dt: float) -> Plan:
        return apply_change(state, self.change(dt))

    def conserved(self) -> list[tuple[str, str]]:
        """Pairs whose components get no other term."""
        uses: dict[str, int] = {}
        for c, _ in self.terms:
            uses[c] = uses.get(c, 0) + 1
        return [(a, b) for a, b in self.pairs if uses[a] == uses[b] == 1]

    def frequency_bound(self, state: Plan, cfl: float) -> Plan:
        from fieldloom.functions.expr import maximum

        return state.group([], mu=("max", self.frequency)).select(dt=maximum(var("mu"), 1e-30).__rtruediv__(cfl))


def charge_density(blocks: dict[str, tuple[Plan, str, float]]) -> Plan:
    """The elliptic right-hand side: the weighted sum of the blocks' components."""
    parts = [x.select("i", "j", f=var(c) * q) for x, c, q in blocks.values()]
    return concat(parts).group(["i", "j"], f=("sum", "f"))

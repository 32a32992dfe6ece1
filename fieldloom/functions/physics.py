"""Physics bricks: fluxes, sources and right-hand sides as cell-wise expressions.

A state is a list of expressions, one per component, in the order of ``names``. Direction
0 is x, 1 is y. ``aux`` gives the shared fields by name: ``phi, grad_x, grad_y, b_z, t_e``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from fieldloom.functions.expr import Expr, abs_, const, maximum, minimum, safe_div, sqrt, total, var, where

State = list[Expr]
Aux = dict[str, Expr]

AUX = ("phi", "grad_x", "grad_y", "b_z", "t_e")
ROLES = ("Density", "MomentumX", "MomentumY", "MomentumZ", "Energy", "VelocityX", "VelocityY", "VelocityZ", "Pressure", "Temperature", "Scalar", "Custom")


def aux_of(prefix: str = "") -> Aux:
    return {k: var(prefix + k) for k in AUX}


@runtime_checkable
class Transport(Protocol):
    """What a finite-volume rate needs of a model."""

    names: list[str]

    def flux(self, u: State, aux: Aux, direction: int) -> State: ...

    def max_speed(self, u: State, aux: Aux, direction: int) -> Expr: ...


@runtime_checkable
class SignedSpeeds(Protocol):
    def speeds(self, u: State, aux: Aux, direction: int) -> tuple[Expr, Expr]: ...


@runtime_checkable
class Primitives(Protocol):
    def to_primitive(self, u: State) -> State: ...

    def to_conservative(self, p: State) -> State: ...


@runtime_checkable
class SourceFrequency(Protocol):
    def source_frequency(self, u: State, aux: Aux) -> Expr: ...


@runtime_checkable
class Projected(Protocol):
    def project(self, u: State, aux: Aux) -> State: ...


@dataclass(frozen=True)
class Advection:
    """One scalar carried at a constant velocity."""

    ax: float = 1.0
    ay: float = 0.0
    names: list[str] = field(default_factory=lambda: ["u"])
    roles = ["Density"]

    def flux(self, u, aux, direction):
        return [u[0] * (self.ay if direction else self.ax)]

    def max_speed(self, u, aux, direction):
        return const(abs(self.ay if direction else self.ax))

    def speeds(self, u, aux, direction):
        a = const(self.ay if direction else self.ax)
        return a, a


@dataclass(frozen=True)
class ExBVelocity:
    """A density carried by the drift of a potential: v = (-grad_y, grad_x) / B0."""

    b0: float = 1.0
    names: list[str] = field(default_factory=lambda: ["n"])
    roles = ["Density"]

    def velocity(self, aux, direction):
        return aux["grad_x"] / self.b0 if direction else -aux["grad_y"] / self.b0

    def flux(self, u, aux, direction):
        return [u[0] * self.velocity(aux, direction)]

    def max_speed(self, u, aux, direction):
        return abs_(self.velocity(aux, direction))

    def speeds(self, u, aux, direction):
        v = self.velocity(aux, direction)
        return v, v


#: The polar form has the same formulas in the local (radial, azimuthal) basis.
ExBVelocityPolar = ExBVelocity


@dataclass(frozen=True)
class Isothermal:
    """Density and momentum with pressure cs2 * rho."""

    cs2: float = 1.0
    vacuum_floor: float = 1e-12
    names: list[str] = field(default_factory=lambda: ["rho", "mx", "my"])
    roles = ["Density", "MomentumX", "MomentumY"]

    def _normal(self, u, direction):
        return u[1 + direction] / maximum(u[0], self.vacuum_floor)

    def flux(self, u, aux, direction):
        v, p = self._normal(u, direction), u[0] * self.cs2
        out = [u[1 + direction], u[1] * v, u[2] * v]
        out[1 + direction] = out[1 + direction] + p
        return out

    def max_speed(self, u, aux, direction):
        return abs_(self._normal(u, direction)) + self.cs2**0.5

    def speeds(self, u, aux, direction):
        v, c = self._normal(u, direction), self.cs2**0.5
        return v - c, v + c

    def to_primitive(self, u):
        rho = maximum(u[0], self.vacuum_floor)
        return [u[0], u[1] / rho, u[2] / rho]

    def to_conservative(self, p):
        return [p[0], p[0] * p[1], p[0] * p[2]]

    def pressure(self, u: State) -> Expr:
        return u[0] * self.cs2

    def polar_geometric_source(self, u: State, r: Expr) -> State:
        rho = maximum(u[0], self.vacuum_floor)
        vr, vt = u[1] / rho, u[2] / rho
        return [const(0), (u[0] * vt * vt + u[0] * self.cs2) / r, -(u[0] * vr * vt) / r]


@dataclass(frozen=True)
class Euler:
    """Density, momentum and energy of an ideal gas."""

    gamma: float = 1.4
    names: list[str] = field(default_factory=lambda: ["rho", "mx", "my", "e"])
    roles = ["Density", "MomentumX", "MomentumY", "Energy"]

    def pressure(self, u: State) -> Expr:
        return (u[3] - (u[1] * u[1] + u[2] * u[2]) * 0.5 / u[0]) * (self.gamma - 1)

    def sound_speed(self, u: State) -> Expr:
        return sqrt(self.pressure(u) * self.gamma / u[0])

    def flux(self, u, aux, direction):
        v, p = u[1 + direction] / u[0], self.pressure(u)
        out = [u[1 + direction], u[1] * v, u[2] * v, (u[3] + p) * v]
        out[1 + direction] = out[1 + direction] + p
        return out

    def max_speed(self, u, aux, direction):
        return abs_(u[1 + direction] / u[0]) + self.sound_speed(u)

    def speeds(self, u, aux, direction):
        v, c = u[1 + direction] / u[0], self.sound_speed(u)
        return v - c, v + c

    def eigenvalues(self, u: State, direction: int) -> State:
        v, c = u[1 + direction] / u[0], self.sound_speed(u)
        return [v - c, v, v, v + c]

    def to_primitive(self, u):
        return [u[0], u[1] / u[0], u[2] / u[0], self.pressure(u)]

    def to_conservative(self, p):
        return [p[0], p[0] * p[1], p[0] * p[2], p[3] / (self.gamma - 1) + p[0] * (p[1] * p[1] + p[2] * p[2]) * 0.5]


@dataclass(frozen=True)
class NoSource:
    def apply(self, u: State, aux: Aux) -> State:
        return [const(0) for _ in u]


@dataclass(frozen=True)
class PotentialForce:
    """Momentum gains qom * rho * (-grad phi); energy its work."""

    qom: float = 1.0

    def apply(self, u, aux):
        gx, gy = aux["grad_x"], aux["grad_y"]
        out = [const(0), -(u[0] * gx) * self.qom, -(u[0] * gy) * self.qom]
        if len(u) > 3:
            out.append(-(u[1] * gx + u[2] * gy) * self.qom)
        return out


def GravityForce() -> PotentialForce:  # noqa: N802
    return PotentialForce(1.0)


@dataclass(frozen=True)
class MagneticLorentzForce:
    """Rotates the momentum; does no work."""

    qom: float = 1.0

    def apply(self, u, aux):
        out = [const(0), aux["b_z"] * u[2] * self.qom, -(aux["b_z"] * u[1]) * self.qom]
        return out + [const(0)] * (len(u) - 3)

    def source_frequency(self, u, aux):
        return abs_(aux["b_z"] * self.qom)


@dataclass(frozen=True)
class CompositeSource:
    parts: tuple

    def apply(self, u, aux):
        each = [p.apply(u, aux) for p in self.parts]
        return [total([e[k] for e in each]) for k in range(len(u))]


@dataclass(frozen=True)
class ChargeDensity:
    q: float = 1.0

    def rhs(self, u: State) -> Expr:
        return u[0] * self.q


@dataclass(frozen=True)
class BackgroundDensity:
    alpha: float = 1.0
    n0: float = 0.0

    def rhs(self, u):
        return (u[0] - self.n0) * self.alpha


@dataclass(frozen=True)
class GravityCoupling:
    four_pi_g: float = 1.0
    rho0: float = 0.0
    sign: float = 1.0

    def rhs(self, u):
        return (u[0] - self.rho0) * (self.sign * self.four_pi_g)


@dataclass(frozen=True)
class CompositeModel:
    """Transport, source and elliptic right-hand side in one; optional abilities pass through."""

    transport: object
    source: object = field(default_factory=NoSource)
    elliptic: object | None = None
    viscosity: float = 0.0
    projection: Callable[[State, Aux], State] | None = None

    @property
    def names(self) -> list[str]:
        return self.transport.names

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("transport", "source", "elliptic"):
            raise AttributeError(name)
        return getattr(self.transport, name)

    def without_source(self) -> CompositeModel:
        """The transport half of an implicit-explicit step."""
        return CompositeModel(self.transport, NoSource(), self.elliptic, self.viscosity, self.projection)


#: Names of bricks; unknown or missing names are errors, there is no default.
TRANSPORTS = {"exb": ExBVelocity, "isothermal": Isothermal, "compressible": Euler}
SOURCES = {"none": NoSource, "potential": PotentialForce, "gravity": GravityForce, "magnetic": MagneticLorentzForce}
ELLIPTICS = {"charge": ChargeDensity, "background": BackgroundDensity, "gravity": GravityCoupling}


def make_model(transport: str, source: str, elliptic: str, **options) -> CompositeModel:
    for name, known in ((transport, TRANSPORTS), (source, SOURCES), (elliptic, ELLIPTICS)):
        if name not in known:
            raise ValueError(f"unknown brick {name!r}; known: {sorted(known)}")
    return CompositeModel(TRANSPORTS[transport](**options), SOURCES[source](), ELLIPTICS[elliptic]())


def component(names: list[str], roles: list[str], wanted: str) -> int:
    """Place of a component by name or role; an error if there is none."""
    if wanted in names:
        return names.index(wanted)
    if wanted in roles:
        return roles.index(wanted)
    raise KeyError(f"no component or role {wanted!r}")


def minmod(a: Expr, b: Expr) -> Expr:
    """Zero if the signs differ, else the smaller slope (ties: b)."""
    return where(a * b <= 0.0, 0.0, where(abs_(a) < abs_(b), a, b))


def van_leer(a: Expr, b: Expr) -> Expr:
    return where(a * b <= 0.0, 0.0, safe_div(a * b * 2.0, a + b))


def no_slope(a: Expr, b: Expr) -> Expr:
    return const(0)


LIMITERS = {"none": (no_slope, 1), "minmod": (minmod, 2), "vanleer": (van_leer, 2), "weno5": (None, 3)}


def weno5z(a: Expr, b: Expr, c: Expr, d: Expr, e: Expr) -> Expr:
    """Face value between c and d from five cell means, Borges' weights."""
    eps = 1e-40
    q0 = (a * 2.0 - b * 7.0 + c * 11.0) / 6.0
    q1 = (-b + c * 5.0 + d * 2.0) / 6.0
    q2 = (c * 2.0 + d * 5.0 - e) / 6.0

    def square(x: Expr) -> Expr:
        return x * x

    b0 = square(a - b * 2.0 + c) * (13.0 / 12.0) + square(a - b * 4.0 + c * 3.0) * 0.25
    b1 = square(b - c * 2.0 + d) * (13.0 / 12.0) + square(b - d) * 0.25
    b2 = square(c - d * 2.0 + e) * (13.0 / 12.0) + square(c * 3.0 - d * 4.0 + e) * 0.25
    tau = abs_(b0 - b2)
    w0 = (tau / (b0 + eps) * (tau / (b0 + eps)) + 1.0) * 0.1
    w1 = (tau / (b1 + eps) * (tau / (b1 + eps)) + 1.0) * 0.6
    w2 = (tau / (b2 + eps) * (tau / (b2 + eps)) + 1.0) * 0.3
    return (w0 * q0 + w1 * q1 + w2 * q2) / (w0 + w1 + w2)


def rusanov(model, ul: State, al: Aux, ur: State, ar: Aux, direction: int) -> State:
    fl, fr = model.flux(ul, al, direction), model.flux(ur, ar, direction)
    a = maximum(model.max_speed(ul, al, direction), model.max_speed(ur, ar, direction))
    return [(x + y) * 0.5 - a * 0.5 * (r - left) for x, y, left, r in zip(fl, fr, ul, ur)]


def hll_speeds(model, ul: State, al: Aux, ur: State, ar: Aux, direction: int) -> tuple[Expr, Expr]:
    (l0, l1), (r0, r1) = model.speeds(ul, al, direction), model.speeds(ur, ar, direction)
    return minimum(l0, r0), maximum(l1, r1)


def hll_with_speeds(model, ul, al, ur, ar, direction, sl: Expr, sr: Expr) -> State:
    fl, fr = model.flux(ul, al, direction), model.flux(ur, ar, direction)
    out = []
    for x, y, left, r in zip(fl, fr, ul, ur):
        middle = safe_div(sr * x - sl * y + sl * sr * (r - left), sr - sl)
        out.append(where(sl >= 0.0, x, where(sr <= 0.0, y, middle)))
    return out


def hll(model, ul, al, ur, ar, direction) -> State:
    return hll_with_speeds(model, ul, al, ur, ar, direction, *hll_speeds(model, ul, al, ur, ar, direction))


def _places(model, direction: int) -> dict[str, int | None]:
    """Where a model has its density, its momenta along and across a face, and its energy."""
    roles = list(model.roles)
    along, across = ("MomentumY", "MomentumX") if direction else ("MomentumX", "MomentumY")
    found = {k: roles.index(r) if r in roles else None for k, r in (("rho", "Density"), ("n", along), ("t", across), ("e", "Energy"))}
    if found["rho"] is None or found["n"] is None or not hasattr(model, "pressure"):
        raise ValueError("a contact needs a density, a momentum and a pressure")
    return found


def hllc(model, ul, al, ur, ar, direction) -> State:
    """Contact-restoring star states of any fluid: density, momenta and a pressure, an energy or
    none, and further components, which are carried with the fluid."""
    at = _places(model, direction)
    r, n = at["rho"], at["n"]
    sl, sr = hll_speeds(model, ul, al, ur, ar, direction)
    vl, vr, pl, pr = ul[n] / ul[r], ur[n] / ur[r], model.pressure(ul), model.pressure(ur)
    ml, mr = ul[r] * (sl - vl), ur[r] * (sr - vr)
    star = safe_div(pr - pl + ml * vl - mr * vr, ml - mr)
    fl, fr = model.flux(ul, al, direction), model.flux(ur, ar, direction)

    def side(u: State, f: State, s: Expr, v: Expr, p: Expr, m: Expr) -> State:
        rho = safe_div(m, s - star)
        inner = [rho * (x / u[r]) for x in u]
        inner[r], inner[n] = rho, rho * star
        if at["e"] is not None:
            inner[at["e"]] = rho * (u[at["e"]] / u[r] + (star - v) * (star + safe_div(p, m)))
        return [x + s * (a - b) for x, a, b in zip(f, inner, u)]

    left, right = side(ul, fl, sl, vl, pl, ml), side(ur, fr, sr, vr, pr, mr)
    return [where(sl >= 0.0, a, where(sr <= 0.0, b, where(star >= 0.0, x, y))) for a, b, x, y in zip(fl, fr, left, right)]


def roe(model, ul, al, ur, ar, direction, fix: float = 0.1) -> State:
    """Roe's flux: of a gas with an energy by its four waves, of a fluid of constant sound speed by its three."""
    if "Energy" not in model.roles:
        return _roe_isothermal(model, ul, al, ur, ar, direction, fix)
    return _roe_gas(model, ul, al, ur, ar, direction, fix)


def _roe_isothermal(model, ul, al, ur, ar, direction, fix: float) -> State:
    at = _places(model, direction)
    if not hasattr(model, "cs2") or len(model.names) != 3:
        raise ValueError("waves are known for a gas, and for density and momenta at a constant sound speed")
    r, n, t = at["rho"], at["n"], at["t"]
    c = const(model.cs2**0.5)
    wl, wr = sqrt(ul[r]), sqrt(ur[r])
    v, w = ((wl * (ul[k] / ul[r]) + wr * (ur[k] / ur[r])) / (wl + wr) for k in (n, t))
    d = [b - a for a, b in zip(ul, ur)]
    minus = ((v + c) * d[r] - d[n]) / (c * 2.0)
    plus = (d[n] - (v - c) * d[r]) / (c * 2.0)
    shear = d[t] - w * d[r]

    def fixed(x: Expr) -> Expr:
        eps = c * fix
        return where(abs_(x) < eps, (x * x / eps + eps) * 0.5, abs_(x))

    a1, a2, a3 = fixed(v - c) * minus, abs_(v) * shear, fixed(v + c) * plus
    wave: State = [const(0)] * 3
    wave[r], wave[n], wave[t] = a1 + a3, a1 * (v - c) + a3 * (v + c), (a1 + a3) * w + a2
    fl, fr = model.flux(ul, al, direction), model.flux(ur, ar, direction)
    return [(x + y) * 0.5 - q * 0.5 for x, y, q in zip(fl, fr, wave)]


def _roe_gas(model, ul, al, ur, ar, direction, fix: float) -> State:
    """Roe averages, four waves, and Harten's fix of the sound waves."""
    n, t = 1 + direction, 2 - direction
    g1 = model.gamma - 1
    wl, wr = sqrt(ul[0]), sqrt(ur[0])
    hl, hr = (ul[3] + model.pressure(ul)) / ul[0], (ur[3] + model.pressure(ur)) / ur[0]

    def mean(a: Expr, b: Expr) -> Expr:
        return (wl * a + wr * b) / (wl + wr)

    v, w, h = mean(ul[n] / ul[0], ur[n] / ur[0]), mean(ul[t] / ul[0], ur[t] / ur[0]), mean(hl, hr)
    c2 = (h - (v * v + w * w) * 0.5) * g1
    c = sqrt(c2)
    d = [r - left for left, r in zip(ul, ur)]
    shear = d[t] - w * d[0]
    entropy = ((h - v * v) * d[0] + v * d[n] - (d[3] - shear * w)) * g1 / c2
    minus = (d[0] * (v + c) - d[n] - c * entropy) / (c * 2.0)
    plus = d[0] - (minus + entropy)

    def fixed(x: Expr) -> Expr:
        eps = c * fix
        return where(abs_(x) < eps, (x * x / eps + eps) * 0.5, abs_(x))

    a1, a2, a3 = fixed(v - c) * minus, abs_(v) * entropy, fixed(v + c) * plus
    a4 = abs_(v) * shear
    wave: State = [a1 + a2 + a3] * 4
    wave[n] = a1 * (v - c) + a2 * v + a3 * (v + c)
    wave[t] = (a1 + a2 + a3) * w + a4
    wave[3] = a1 * (h - v * c) + a2 * (v * v + w * w) * 0.5 + a3 * (h + v * c) + a4 * w
    fl, fr = model.flux(ul, al, direction), model.flux(ur, ar, direction)
    return [(x + y) * 0.5 - q * 0.5 for x, y, q in zip(fl, fr, wave)]


RIEMANN = {"rusanov": rusanov, "hll": hll, "hllc": hllc, "roe": roe}


def register_riemann(name: str, solver: Callable) -> None:
    """A user's flux: ``(model, ul, al, ur, ar, direction) -> state``."""
    if name in RIEMANN:
        raise ValueError(f"{name!r} is taken")
    RIEMANN[name] = solver

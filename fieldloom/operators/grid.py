"""Index boxes, geometry, and mesh fields made from the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from fieldloom.functions.expr import Expr, var
from fieldloom.plans.relation import Grid, Plan, Table, raw


@dataclass(frozen=True)
class Box:
    """A rectangle of cells with inclusive corners; empty if ``hi < lo``."""

    i0: int
    j0: int
    i1: int
    j1: int

    @classmethod
    def of(cls, nx: int, ny: int) -> Box:
        return cls(0, 0, nx - 1, ny - 1)

    @property
    def shape(self) -> tuple[int, int]:
        return max(0, self.i1 - self.i0 + 1), max(0, self.j1 - self.j0 + 1)

    @property
    def cells(self) -> int:
        return self.shape[0] * self.shape[1]

    def contains(self, i: int, j: int) -> bool:
        return self.i0 <= i <= self.i1 and self.j0 <= j <= self.j1

    def grow(self, n: int) -> Box:
        return Box(self.i0 - n, self.j0 - n, self.i1 + n, self.j1 + n)

    def shift(self, di: int, dj: int) -> Box:
        return Box(self.i0 + di, self.j0 + dj, self.i1 + di, self.j1 + dj)

    def refine(self, r: int) -> Box:
        return Box(self.i0 * r, self.j0 * r, self.i1 * r + r - 1, self.j1 * r + r - 1)

    def coarsen(self, r: int) -> Box:
        return Box(self.i0 // r, self.j0 // r, self.i1 // r, self.j1 // r)

    def intersect(self, o: Box) -> Box:
        return Box(max(self.i0, o.i0), max(self.j0, o.j0), min(self.i1, o.i1), min(self.j1, o.j1))

    def chop(self, size: int) -> list[Box]:
        """Even tiles of at most ``size`` cells a side, row by row."""

        def cuts(lo: int, hi: int) -> list[tuple[int, int]]:
            n = hi - lo + 1
            k = -(-n // size)
            at = [lo + n * q // k for q in range(k + 1)]
            return [(a, b - 1) for a, b in zip(at, at[1:])]

        return [Box(a, c, b, d) for c, d in cuts(self.j0, self.j1) for a, b in cuts(self.i0, self.i1)]


@dataclass(frozen=True)
class Geometry:
    """Cell centres of a rectangle."""

    nx: int
    ny: int
    x0: float = 0.0
    x1: float = 1.0
    y0: float = 0.0
    y1: float = 1.0

    @property
    def dx(self) -> float:
        return (self.x1 - self.x0) / self.nx

    @property
    def dy(self) -> float:
        return (self.y1 - self.y0) / self.ny

    def x(self) -> Expr:
        return (index("i") + 0.5) * self.dx + self.x0

    def y(self) -> Expr:
        return (index("j") + 0.5) * self.dy + self.y0


@dataclass(frozen=True)
class PolarGeometry:
    """A ring: ``i`` along the radius, ``j`` around."""

    nr: int
    nt: int
    r0: float
    r1: float

    @property
    def dr(self) -> float:
        return (self.r1 - self.r0) / self.nr

    @property
    def dt(self) -> float:
        return 6.283185307179586 / self.nt

    def r(self) -> Expr:
        return (index("i") + 0.5) * self.dr + self.r0

    def r_face(self, side: int = 0) -> Expr:
        """Radius of a cell's lower (0) or upper (1) face."""
        return (index("i") + float(side)) * self.dr + self.r0

    def theta(self) -> Expr:
        return (index("j") + 0.5) * self.dt


def index(name: str) -> Expr:
    """An index column as a double."""
    return raw(f"cast({name} as double)", f"{name}::DOUBLE")


def _int(spark: str, other: str | None = None):
    return raw(f"cast({spark} as int)", f"({other or spark})::INTEGER")


def _whole(name: str):
    return raw(f"cast(coalesce({name}, 0) as double)", f"coalesce({name}, 0)::DOUBLE")


def counts(n: int = 32) -> Plan:
    """``u``: lineitems per cell, by order and part."""
    items = Table("lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])
    keyed = items.select(i=_int(f"l_orderkey % {n}"), j=_int(f"l_partkey % {n}"), line=raw("cast(l_linenumber as bigint)", "l_linenumber::BIGINT"), flag=raw("cast(if(l_returnflag = 'R', 1, 0) as bigint)", "(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT"))
    cells = keyed.group(["i", "j"], c=("count", 1.0), m=("sum", "line"), f=("sum", "flag"))
    return Grid(n, n).join(cells, ["i", "j"], "left").select("i", "j", u=_whole("c"), m=_whole("m"), f=_whole("f"))


def density(n: int = 32) -> Plan:
    return counts(n).select("i", "j", "u")


def euler_state(n: int = 32) -> Plan:
    """A gas state: ``rho = 1 + u`` and an energy that keeps the pressure positive."""
    x = counts(n).select("i", "j", rho=var("u") + 1.0, mx=var("m"), my=var("f"))
    return x.with_(e=var("rho") * 10.0 + (var("mx") * var("mx") + var("my") * var("my")))


SPECIES = ("click", "purchase", "view")


def species(n: int = 32, kinds: tuple[str, ...] = SPECIES) -> Plan:
    """``n_a, n_b, n_c``: events per cell and kind, plus one."""
    cols = {f"s{k}": raw(f"cast(if(event_type = '{kind}', 1, 0) as bigint)", f"(CASE WHEN event_type = '{kind}' THEN 1 ELSE 0 END)::BIGINT") for k, kind in enumerate(kinds)}
    keyed = Table("events", ["event_id", "user_id", "event_type"]).select(i=_int(f"user_id % {n}"), j=_int(f"event_id % {n}"), **cols)
    cells = keyed.group(["i", "j"], **{c: ("sum", c) for c in cols})
    return Grid(n, n).join(cells, ["i", "j"], "left").select("i", "j", **{f"n_{'abc'[k]}": _whole(f"s{k}") + 1.0 for k in range(len(kinds))})


def daily(n: int = 32) -> Plan:
    """``step, i, u``: events per day and cell of one line; days from 0."""
    day = raw("cast(floor(unix_timestamp(cast(ts as timestamp)) / 86400D) - 19723 as int)", "(floor(epoch(ts) / 86400) - 19723)::INTEGER")
    keyed = Table("events", ["event_id", "ts"]).select(step=day, i=_int(f"event_id % {n}"))
    return keyed.group(["step", "i"], c=("count", 1.0)).select("step", "i", u=raw("cast(c as double)", "c::DOUBLE"))

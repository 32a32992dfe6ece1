"""Multigrid and preconditioned Krylov methods for operators that vary in space.

``Stencil`` is div(eps grad u) - kappa u + cross terms on one block, as arrays of weights;
its ends are periodic, fixed or flat, a mask or a level set cuts a conductor out. ``VCycle``
solves it by multigrid, ``tensor_bicgstab`` with the cross terms by BiCGStab that a cycle
preconditions. Both are for a block that fits a task; ``BLOCK_CELLS`` is the most they take.

Beyond that ``two_level`` preconditions the Krylov methods over DataFrames: a solve in each
tile and one on a coarse grid of tile means, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.relation import Boundary, Edges, axis_rules

#: Cells of a block that one task solves at most (eight megabytes a field).
BLOCK_CELLS = 1 << 20


class NotConvergedError(RuntimeError):
    """An iteration ended above its tolerance; ``field`` is the last iterate."""

    def __init__(self, what: str, iterations: int, residual: float, field=None):
        super().__init__(f"{what}: residual {residual:.3e} after {iterations} iterations")
        self.iterations, self.residual, self.field = iterations, residual, field


def _ends(rule: Boundary) -> tuple[Boundary, Boundary]:
    return (rule.lo, rule.hi) if isinstance(rule, Edges) else (rule, rule)


def _harmonic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s == 0, 0, 2 * a * b / np.where(s == 0, 1, s))


def _way(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    d = here - there
    return np.where(there < 0, 1.0, np.clip(here / np.where(d == 0, 1, d), 1e-3, 1))


@dataclass
class Stencil:
    """Coefficients of a block; ``weights`` follow from them."""

    shape: tuple[int, int]
    h: tuple[float, float]
    bc: Boundary = "periodic"
    eps_x: np.ndarray | float = 1.0
    eps_y: np.ndarray | float = 1.0
    kappa: np.ndarray | float = 0.0
    a_xy: np.ndarray | float = 0.0
    a_yx: np.ndarray | float = 0.0
    mask: np.ndarray | None = None
    level: np.ndarray | None = None  # cells with one ring of ghosts: (nx + 2, ny + 2)
    weights: dict[str, np.ndarray] = field(init=False, repr=False)

    def __post_init__(self):
        for name in ("eps_x", "eps_y", "kappa", "a_xy", "a_yx"):
            setattr(self, name, np.broadcast_to(np.asarray(getattr(self, name), float), self.shape))
        w = {"c": -np.array(self.kappa), "shift": np.zeros(self.shape)}
        active = self.active
        for axis, (rule, eps, h, m, p) in enumerate(zip(axis_rules(self.bc), (self.eps_x, self.eps_y), self.h, ("xm", "ym"), ("xp", "yp"))):
            up, down = _harmonic(eps, np.roll(eps, -1, axis)), _harmonic(eps, np.roll(eps, 1, axis))
            first, last = [(slice(None),) * axis + (k,) for k in (0, -1)]
            if rule != "periodic":  # a ghost has its cell's coefficient
                up, down = up.copy(), down.copy()
                up[last], down[first] = eps[last], eps[first]
            if self.level is None:
                a, b = down / (h * h), up / (h * h)
            else:
                one = [self.level[1:-1, 1:-1], *(self.level[2 * k : 2 * k + self.shape[0], 1:-1] if axis == 0 else self.level[1:-1, 2 * k : 2 * k + self.shape[1]] for k in (0, 1))]
                ta, tb = _way(one[0], one[1]) * h, _way(one[0], one[2]) * h
                a, b = 2 / (ta * (ta + tb)), 2 / (tb * (ta + tb))
            w["c"] = w["c"] - a - b
            if rule != "periodic":
                a, b = a.copy(), b.copy()
                for side, end, weight in ((first, _ends(rule)[0], a), (last, _ends(rule)[1], b)):
                    if end == "foextrap":
                        w["c"][side] += weight[side]
                    else:
                        w["c"][side] -= weight[side]
                        w["shift"][side] += 2 * end[1] * weight[side]
                    weight[side] = 0
            w[m], w[p] = a, b
        if active is not None:
            for name in ("xm", "xp", "ym", "yp", "shift"):
                w[name] = np.where(active, w[name], 0)
            w["c"] = np.where(active, w["c"], 1)
            for name, axis, by in (("xm", 0, 1), ("xp", 0, -1), ("ym", 1, 1), ("yp", 1, -1)):
                w[name] = np.where(np.roll(active, by, axis), w[name], 0)
        w["c"] = np.where(w["c"] == 0, -1.0, w["c"])
        self.weights = w

    @property
    def active(self) -> np.ndarray | None:
        """Where the field is unknown; elsewhere it is zero."""
        if self.level is not None:
            return self.level[1:-1, 1:-1] < 0
        return None if self.mask is None else np.asarray(self.mask) >= 0.5

    @property
    def floating(self) -> bool:
        """Whether the field is known but for a constant."""
        ends = [e for rule in axis_rules(self.bc) for e in _ends(rule)]
        return self.active is None and not np.any(self.kappa) and all(e in ("periodic", "foextrap") for e in ends)

    def near(self, u: np.ndarray) -> np.ndarray:
        w = self.weights
        return w["xm"] * np.roll(u, 1, 0) + w["xp"] * np.roll(u, -1, 0) + w["ym"] * np.roll(u, 1, 1) + w["yp"] * np.roll(u, -1, 1)

    def apply(self, u: np.ndarray) -> np.ndarray:
        """The five-point part, without the fixed ends' share."""
        return self.near(u) + self.weights["c"] * u

    def full(self, u: np.ndarray) -> np.ndarray:
        """With the cross terms, periodic or copied ends only."""
        out = self.apply(u)
        if not (np.any(self.a_xy) or np.any(self.a_yx)):
            return out
        modes = ["wrap" if r == "periodic" else "edge" for r in axis_rules(self.bc)]

        def ring(a):
            return np.pad(np.pad(a, ((1, 1), (0, 0)), mode=modes[0]), ((0, 0), (1, 1)), mode=modes[1])

        v, xy, yx = ring(u), ring(self.a_xy), ring(self.a_yx)
        first = xy[2:, 1:-1] * (v[2:, 2:] - v[2:, :-2]) - xy[:-2, 1:-1] * (v[:-2, 2:] - v[:-2, :-2])
        other = yx[1:-1, 2:] * (v[2:, 2:] - v[:-2, 2:]) - yx[1:-1, :-2] * (v[2:, :-2] - v[:-2, :-2])
        return out + (first + other) / (4 * self.h[0] * self.h[1])

    def coarser(self) -> Stencil | None:
        """The operator of a grid half as fine, from mean coefficients."""
        nx, ny = self.shape
        if nx % 2 or ny % 2 or min(nx, ny) < 4:
            return None

        def mean(a):
            return np.asarray(a, float).reshape(nx // 2, 2, ny // 2, 2).mean(axis=(1, 3))

        level = None
        if self.level is not None:
            level = np.pad(mean(self.level[1:-1, 1:-1]), 1, mode="edge")
        rules = tuple(Edges(*(e if e == "foextrap" else ("dirichlet", 0.0) for e in _ends(r))) if r != "periodic" else r for r in axis_rules(self.bc))
        mask = None if self.mask is None else mean(np.asarray(self.mask) >= 0.5)
        return Stencil((nx // 2, ny // 2), (self.h[0] * 2, self.h[1] * 2), rules, mean(self.eps_x), mean(self.eps_y), mean(self.kappa), mask=mask, level=level)


@dataclass
class VCycle:
    """Cycles: red-black sweeps, means down, constants up, a dense solve at the bottom."""

    rel: float = 1e-8
    absolute: float = 0.0
    cycles: int = 60
    before: int = 2
    after: int = 2
    strict: bool = True

    def _smooth(self, a: Stencil, u: np.ndarray, f: np.ndarray, sweeps: int) -> None:
        color = np.add.outer(np.arange(a.shape[0]), np.arange(a.shape[1])) % 2
        for _ in range(sweeps):
            for c in (0, 1):
                u[color == c] = ((f - a.near(u)) / a.weights["c"])[color == c]

    def cycle(self, ladder: list[Stencil], u: np.ndarray, f: np.ndarray) -> np.ndarray:
        a = ladder[0]
        if len(ladder) == 1:
            n = u.size
            if n <= 256:
                eye = np.eye(n).reshape(n, *a.shape)
                dense = np.stack([a.apply(e).ravel() for e in eye], axis=1)
                return np.linalg.lstsq(dense, f.ravel(), rcond=None)[0].reshape(a.shape)
            self._smooth(a, u, f, 50)
            return u
        self._smooth(a, u, f, self.before)
        r = f - a.apply(u)
        if a.active is not None:
            r = np.where(a.active, r, 0)
        nx, ny = a.shape
        down = r.reshape(nx // 2, 2, ny // 2, 2).mean(axis=(1, 3))
        if ladder[1].active is not None:
            down = np.where(ladder[1].active, down, 0)
        e = self.cycle(ladder[1:], np.zeros_like(down), down)
        up = np.repeat(np.repeat(e, 2, 0), 2, 1)
        u += up if a.active is None else np.where(a.active, up, 0)
        self._smooth(a, u, f, self.after)
        return u

    @staticmethod
    def ladder(a: Stencil) -> list[Stencil]:
        out = [a]
        while (below := out[-1].coarser()) is not None:
            out.append(below)
        return out

    def solve(self, a: Stencil, f: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """u of the five-point operator; a floating right-hand side and field are made zero-mean."""
        if f.size > BLOCK_CELLS:
            raise ValueError(f"a block of {f.size} cells is above the {BLOCK_CELLS} that one task solves; use a method over DataFrames")
        f = f - a.weights["shift"]
        if a.active is not None:
            f = np.where(a.active, f, 0)
        if a.floating:
            f = f - f.mean()
        ladder, u = self.ladder(a), np.zeros(a.shape) if start is None else start.copy()
        first = now = np.abs(f - a.apply(u)).max()
        for _ in range(self.cycles):
            if now <= max(self.rel * first, self.absolute):
                break
            u = self.cycle(ladder, u, f)
            if a.floating:
                u -= u.mean()
            now = np.abs(f - a.apply(u)).max()
        if self.strict and not now <= max(self.rel * first, self.absolute):
            raise NotConvergedError("multigrid", self.cycles, float(now), u)
        return u

    def robust(self, a: Stencil, f: np.ndarray) -> np.ndarray:
        """Doubles the smoothing, from zero, until it converges; at most 64 sweeps."""
        tried = self
        while True:
            try:
                return replace(tried, strict=True).solve(a, f)
            except NotConvergedError:
                if tried.before >= 64:
                    raise
                tried = replace(tried, before=tried.before * 2, after=tried.after * 2)


def tensor_bicgstab(a: Stencil, f: np.ndarray, tolerance: float = 1e-10, max_iter: int = 200) -> tuple[np.ndarray, int, float]:
    """The full tensor operator, preconditioned by one cycle of its five-point part."""
    if f.size > BLOCK_CELLS:
        raise ValueError(f"a block of {f.size} cells is above the {BLOCK_CELLS} that one task solves; use a method over DataFrames")
    one, ladder = VCycle(), VCycle.ladder(a)
    f = f - a.weights["shift"]
    if a.floating:
        f = f - f.mean()

    def before(r):
        z = one.cycle(ladder, np.zeros_like(r), r)
        return z - z.mean() if a.floating else z

    x, r = np.zeros_like(f), f.copy()
    s0, p, v = r.copy(), np.zeros_like(f), np.zeros_like(f)
    rho = alpha = omega = 1.0
    stop, norm = tolerance * np.linalg.norm(f), np.linalg.norm(f)
    for k in range(max_iter):
        if norm <= stop:
            return x, k, float(norm)
        new = float((s0 * r).sum())
        if new == 0 or omega == 0:  # a breakdown: start anew from here
            s0, p, v, rho, alpha, omega = r.copy(), np.zeros_like(f), np.zeros_like(f), 1.0, 1.0, 1.0
            new = float((s0 * r).sum())
        p = r + (new / rho) * (alpha / omega) * (p - omega * v)
        y = before(p)
        v = a.full(y)
        alpha = new / float((s0 * v).sum())
        s = r - alpha * v
        z = before(s)
        t = a.full(z)
        tt = float((t * t).sum())
        omega = float((t * s).sum()) / tt if tt else 0.0
        x, r, rho = x + alpha * y + omega * z, s - omega * t, new
        norm = float(np.linalg.norm(r))
    raise NotConvergedError("BiCGStab", max_iter, norm, x)


def two_level(shape: tuple[int, int], h: tuple[float, float], bc: Boundary = "periodic", kappa: float = 0.0, tile: int = 32, sign: float = -1.0, gather: int = 1 << 14) -> Callable[[DataFrame, str], DataFrame]:
    """A preconditioner over DataFrames for ``sign`` * (Laplacian - kappa).

    Each tile solves its own cells with zero around it, in the tile's task; the means of the
    tiles are solved on a grid of one cell a tile, at most ``gather`` cells, in one task, and
    sent back to all. An iteration adds one shuffle by tile and one narrow aggregate.
    """
    nx, ny = (-(-n // tile) for n in shape)
    if nx * ny > gather:
        raise ValueError(f"{nx * ny} tiles are more than {gather}; take larger ones")
    rules = axis_rules(bc)
    key = F.expr(f"cast((i div {tile}) * {ny} + (j div {tile}) as int)")
    cycle = VCycle(rel=1e-2, cycles=8, strict=False)

    def ends(axis: int, k: int, n: int) -> Boundary:
        if rules[axis] == "periodic":
            return ("dirichlet", 0.0) if n > 1 else "periodic"
        lo, hi = _ends(rules[axis])
        return Edges(lo if k == 0 and lo == "foextrap" else ("dirichlet", 0.0), hi if k == n - 1 and hi == "foextrap" else ("dirichlet", 0.0))

    def inside(cells):
        import pandas as pd

        t = int(cells["tile"].iloc[0])
        i, j = cells["i"].to_numpy() - t // ny * tile, cells["j"].to_numpy() - t % ny * tile
        size = (min(tile, shape[0] - t // ny * tile), min(tile, shape[1] - t % ny * tile))
        f = np.zeros(size)
        f[i, j] = cells["r"]
        a = Stencil(size, h, (ends(0, t // ny, nx), ends(1, t % ny, ny)), kappa=kappa)
        return pd.DataFrame({"i": cells["i"], "j": cells["j"], "tile": cells["tile"], "z": sign * cycle.solve(a, f)[i, j]})

    def coarse(cells):
        import pandas as pd

        t, f = cells["tile"].to_numpy(), np.zeros((nx, ny))
        f[t // ny, t % ny] = cells["mean"]
        flat = tuple("periodic" if r == "periodic" else Edges(*(e if e == "foextrap" else ("dirichlet", 0.0) for e in _ends(r))) for r in rules)
        a = Stencil((nx, ny), (h[0] * tile, h[1] * tile), flat, kappa=kappa)
        return pd.DataFrame({"tile": t, "low": sign * cycle.solve(a, f)[t // ny, t % ny]})

    def apply(df: DataFrame, c: str) -> DataFrame:
        rows = df.select("i", "j", F.col(c).alias("r"), key.alias("tile"))
        fine = rows.groupBy("tile").applyInPandas(inside, "i int, j int, tile int, z double")
        means = rows.groupBy("tile").agg(F.avg("r").alias("mean"))
        low = means.groupBy(F.lit(0).alias("all")).applyInPandas(lambda x: coarse(x), "tile int, low double")
        return fine.join(F.broadcast(low), "tile").select("i", "j", (F.col("z") + F.col("low")).alias(c))

    return apply

"""Levels of boxes, advanced by subcycling.

Level 0 is the whole domain; a finer level is a set of disjoint boxes, twice as fine, whose
state has a row for each cell inside them. A step of a level fills the ghosts of its boxes
(from the level itself, else from the coarser one, constant in space and linear in time),
computes all faces box by box, and advances. Then its child takes two half steps between the
level's old and new state, is averaged down, and the coarse cells beside it are corrected by
the difference of the fluxes that both levels saw (``reflux``), so that sums are kept.

All of it is one plan; ``cut`` may write each level's state in between. The boxes themselves are
few, and literal; cells are never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.expr import Expr, total, var
from fieldloom.operators import amr, fv
from fieldloom.operators.grid import Box
from fieldloom.plans.relation import Boundary, BoxCells, Plan, axis_rules, raw

DEPTH = {"none": 1, "minmod": 2, "vanleer": 2, "weno5": 3}
#: Weights of the stages' fluxes in a whole step.
EFFECTIVE = {"euler": (1.0,), "ssprk3": (1.0 / 6.0, 1.0 / 6.0, 2.0 / 3.0)}
SIDES = ("lo x", "hi x", "lo y", "hi y")


@dataclass(frozen=True)
class Scheme:
    model: Any
    h: tuple[float, float]
    shape: tuple[int, int]
    bc: Boundary = "periodic"
    limiter: str = "none"
    riemann: str = "rusanov"
    method: str = "euler"
    source: Any = None
    implicit: Callable[[Plan, float], Plan] | None = None
    aux: tuple[str, ...] = ()

    def __post_init__(self):
        if self.method not in EFFECTIVE:
            raise ValueError(f"unknown method {self.method!r}")
        if self.method == "ssprk3" and self.implicit is not None:
            raise ValueError("implicit sources go with Euler steps only")
        if any(r not in ("periodic", "foextrap") for r in axis_rules(self.bc)):
            raise ValueError("levels have periodic or copied edges")

    @property
    def names(self) -> list[str]:
        return list(self.model.names)

    def at(self, level: int) -> Scheme:
        return replace(self, h=(self.h[0] / 2**level, self.h[1] / 2**level), shape=(self.shape[0] << level, self.shape[1] << level))

    def place(self, axis: str, expr: str) -> Expr:
        """An index brought into the domain by the axis's rule."""
        k = "ij".index(axis)
        n, rule = self.shape[k], axis_rules(self.bc)[k]
        if rule == "periodic":
            return raw(f"cast(pmod({expr}, {n}) as int)", f"(((({expr}) % {n}) + {n}) % {n})::INTEGER")
        return raw(f"cast(least(greatest({expr}, 0), {n - 1}) as int)", f"least(greatest({expr}, 0), {n - 1})::INTEGER")


@dataclass
class Level:
    state: Plan
    boxes: list[Box] | None = None  # None: the whole domain


def patches(at: Scheme, state: Plan, boxes: list[Box], coarse: Plan, columns: list[str]) -> Plan:
    """``box_id, i, j, own`` and the columns: the boxes' cells and their ghosts.

    ``coarse`` has the names as of the time that ghosts need; other columns stay null in ghosts.
    """
    cells = BoxCells(boxes, DEPTH[at.limiter]).with_(wi=at.place("i", "i"), wj=at.place("j", "j"))
    cells = cells.with_(ci=raw("cast(wi div 2 as int)", "(wi // 2)::INTEGER"), cj=raw("cast(wj div 2 as int)", "(wj // 2)::INTEGER"))
    mine = state.select(wi="i", wj="j", **{f"m_{c}": var(c) for c in columns})
    below = coarse.select(ci="i", cj="j", **{f"c_{c}": var(c) for c in [*at.names, *at.aux]})
    x = cells.join(mine, ["wi", "wj"], "left").join(below, ["ci", "cj"])
    filled = {c: raw(f"coalesce(m_{c}, c_{c})") for c in at.names}
    return x.select("box_id", "i", "j", "own", **filled, **{a: var(f"c_{a}") for a in at.aux}, **{c: var(f"m_{c}") for c in columns if c not in at.names})


def _faces(at: Scheme, level: int, x: Plan, boxes: list[Box] | None, coarse: Plan | None) -> Plan:
    """The rows of a level with the fluxes through their upper and lower faces."""
    if level == 0:
        return fv.face_fluxes(x, at.model, at.shape, at.limiter, at.riemann, at.bc, aux=list(at.aux))
    columns = [c for c in x.columns if c not in ("i", "j", *at.aux)]
    p = patches(at, x, boxes, coarse, columns)
    p = fv.face_fluxes(p, at.model, at.shape, at.limiter, at.riemann, "none", aux=list(at.aux), within=("box_id",))
    return p.filter(var("own") >= 0.5).drop("box_id", "own")


def _moved(at: Scheme, x: Plan, dt: float) -> dict[str, Expr]:
    """U + dt R."""
    added = at.source.apply([var(c) for c in at.names], {a: var(a) for a in at.aux}) if at.source else None
    out = {}
    for k, c in enumerate(at.names):
        rate = -(var(f"fx_{c}") - var(f"gx_{c}")) / at.h[0] - (var(f"fy_{c}") - var(f"gy_{c}")) / at.h[1]
        out[c] = var(c) + (rate + added[k] if added else rate) * dt
    return out


def advance(at: Scheme, level: int, state: Plan, boxes: list[Box] | None, coarse: Plan | None, dt: float, aux: Plan | None = None) -> Plan:
    """The state after one explicit step, and the fluxes of the whole step (``fx_ .. gy_``)."""
    flux = [f"{s}{a}_{c}" for c in at.names for s in "fg" for a in "xy"]
    x = state
    if level == 0 and at.aux:
        x = x.join(aux.select("i", "j", *at.aux), ["i", "j"])
    if at.method == "euler":
        x = _faces(at, level, x, boxes, coarse)
        return x.with_(**_moved(at, x, dt)).select("i", "j", *at.names, *flux)
    x = x.with_(**{f"z_{c}": var(c) for c in at.names})
    for k, (a, b) in enumerate(((0.0, 1.0), (0.75, 0.25), (1.0 / 3.0, 2.0 / 3.0))):
        y = _faces(at, level, x, boxes, coarse)
        moved = _moved(at, y, dt)
        sums = {f"e_{f}": var(f) * EFFECTIVE["ssprk3"][k] + (var(f"e_{f}") if k else 0.0) for f in flux}
        kept = {a_: var(a_) for a_ in at.aux} if level == 0 else {}
        x = y.select("i", "j", **{c: (var(f"z_{c}") * a + e * b if a else e) for c, e in moved.items()}, **{f"z_{c}": var(f"z_{c}") for c in at.names}, **sums, **kept)
    return x.select("i", "j", *at.names, **{f: var(f"e_{f}") for f in flux})


def interface(at: Scheme, child: list[Box]) -> Plan:
    """``ci, cj, side, i, j``: each face between a covered cell (``ci, cj``) and an uncovered one of level ``at``."""
    covered = BoxCells([b.coarsen(2) for b in child]).select(ci="i", cj="j").distinct()
    x = covered.explode("side", [0, 1, 2, 3])
    di = "CASE side WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END"
    dj = "CASE side WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END"
    x = x.with_(ni=raw(f"ci + {di}"), nj=raw(f"cj + {dj}"))
    inside = " AND ".join(f"n{a} >= 0 AND n{a} < {n}" for a, n, r in zip("ij", at.shape, axis_rules(at.bc)) if r != "periodic")
    x = x.filter(raw(inside)) if inside else x
    x = x.select("ci", "cj", "side", i=at.place("i", "ni"), j=at.place("j", "nj"))
    return x.join(covered.select(i="ci", j="cj"), ["i", "j"], "anti")


def reflux(at: Scheme, child: list[Box], coarse_flux: Plan, fine_fluxes: list[Plan], dt: float) -> Plan:
    """``i, j`` of the uncovered cells beside the child's boxes, and what is added to each component.

    A cell gave or took the coarse flux through the face; it should be the mean of the fine
    fluxes over both substeps. ``fine_fluxes``: one plan for each substep of dt / 2.
    """
    border = interface(at, child)
    width = [dt / at.h[0], dt / at.h[0], dt / at.h[1], dt / at.h[1]]
    mine = {0: ("fx", 1.0), 1: ("gx", -1.0), 2: ("fy", 1.0), 3: ("gy", -1.0)}
    theirs = {0: ("gx", -1.0), 1: ("fx", 1.0), 2: ("gy", -1.0), 3: ("fy", 1.0)}

    def by_side(which: dict[int, tuple[str, float]], scale: float) -> dict[str, Expr]:
        from fieldloom.functions.expr import where

        out = {}
        for c in at.names:
            value: Any = 0.0
            for side in (3, 2, 1, 0):
                name, sign = which[side]
                value = where(raw(f"side = {side}"), var(f"{name}_{c}") * (sign * scale * width[side]), value)
            out[f"d_{c}"] = value
        return out

    parts = border.join(coarse_flux, ["i", "j"]).select("i", "j", **by_side(mine, 1.0))
    face = "(side = 0 AND pi = 0) OR (side = 1 AND pi = 1) OR (side = 2 AND pj = 0) OR (side = 3 AND pj = 1)"
    for plan in fine_fluxes:
        fine = plan.with_(ci=raw("cast(i div 2 as int)", "(i // 2)::INTEGER"), cj=raw("cast(j div 2 as int)", "(j // 2)::INTEGER"), pi=raw("cast(i % 2 as int)", "(i % 2)::INTEGER"), pj=raw("cast(j % 2 as int)", "(j % 2)::INTEGER")).drop("i", "j")
        seen = border.join(fine, ["ci", "cj"]).filter(raw(face))  # two fine faces, two half steps: a quarter each
        parts = parts.union(seen.select("i", "j", **by_side(theirs, 0.25)))
    return parts.group(["i", "j"], **{f"d_{c}": ("sum", f"d_{c}") for c in at.names})


def settle(at: Scheme, new: Plan, child: Plan, child_boxes: list[Box], corrections: Plan) -> Plan:
    """A level after its child's steps: averages where it is covered, corrections beside."""
    down = amr.average_down(child.select("i", "j", *at.names), at.names).rename(**{c: f"a_{c}" for c in at.names})
    x = new.join(down, ["i", "j"], "left").join(corrections, ["i", "j"], "left")
    fixed = {c: raw(f"coalesce(a_{c}, {c} + coalesce(d_{c}, 0D))", f"coalesce(a_{c}, {c} + coalesce(d_{c}, 0::DOUBLE))") for c in at.names}
    return x.select("i", "j", **fixed)


@dataclass
class Hierarchy:
    """All levels, and how they advance together."""

    scheme: Scheme
    levels: list[Level]
    aux: Plan | None = None  # of level 0; finer levels see their parents' values
    cut: Callable[[Plan], Plan] | None = None

    def _cut(self, x: Plan) -> Plan:
        return self.cut(x) if self.cut else x

    def _seen(self, level: int, state: Plan, aux: Plan | None) -> Plan:
        return state.join(aux, ["i", "j"]) if self.scheme.aux else state

    def _aux_of(self, level: int) -> Plan | None:
        out = self.aux
        for _ in range(level if self.scheme.aux else 0):
            out = amr.interpolate(out, list(self.scheme.aux))
        return out

    def _subcycle(self, level: int, dt: float, old: Plan | None, new: Plan | None, part: float) -> Plan:
        """Advance a level and all finer ones by dt; gives the level's fluxes of the step."""
        at, mine = self.scheme.at(level), self.levels[level]
        coarse = None
        if level:
            if part == 0.0:
                coarse = old
            else:
                both = old.join(new.rename(**{c: f"n_{c}" for c in at.names}), ["i", "j"])
                coarse = both.select("i", "j", **{c: amr.in_time(var(c), var(f"n_{c}"), part) for c in at.names})
            coarse = self._seen(level - 1, coarse, self._aux_of(level - 1))
        before = mine.state
        done = self._cut(advance(at, level, before, mine.boxes, coarse, dt, self.aux))
        after, fluxes = done.select("i", "j", *at.names), done.drop(*at.names)
        if at.implicit is not None:
            after = self._cut(at.implicit(after, dt))
        if level + 1 < len(self.levels):
            child = self.levels[level + 1]
            seen = [self._subcycle(level + 1, dt / 2, before, after, k / 2) for k in range(2)]
            corrections = reflux(at, child.boxes, fluxes, seen, dt)
            after = self._cut(settle(at, after, child.state, child.boxes, corrections))
        mine.state = after
        return fluxes

    def step(self, dt: float) -> None:
        self._subcycle(0, dt, None, None, 0.0)

    def sync(self) -> None:
        """Average all levels down."""
        for k in range(len(self.levels) - 2, -1, -1):
            at = self.scheme.at(k)
            down = amr.average_down(self.levels[k + 1].state, at.names).rename(**{c: f"a_{c}" for c in at.names})
            x = self.levels[k].state.join(down, ["i", "j"], "left")
            self.levels[k].state = x.select("i", "j", **{c: raw(f"coalesce(a_{c}, {c})") for c in at.names})

    def regrid(self, level: int, boxes: list[Box]) -> None:
        """New boxes for a finer level: parents' values, but the old ones where there were any."""
        at = self.scheme.at(level)
        bound = Box.of(*at.shape)
        if any(b != b.intersect(bound) or b.i0 % 2 or b.j0 % 2 or not b.i1 % 2 or not b.j1 % 2 for b in boxes):
            raise ValueError("boxes lie inside the domain and cover whole coarse cells")
        if level > 1:
            inside = BoxCells([b.coarsen(2).grow(1) for b in boxes])
            lost = [b for b in boxes if not _nested(b.coarsen(2).grow(1), self.levels[level - 1].boxes, self.scheme.at(level - 1))]
            if lost:
                raise ValueError(f"{lost[0]} isn't nested in the level below, with a cell to spare; {len(inside.found)} boxes")
        parents, names = self.levels[level - 1].state, at.names
        if level < len(self.levels):
            state = amr.regrid(self.levels[level].state, parents, boxes, names).select("i", "j", *names)
            self.levels[level] = Level(self._cut(state), boxes)
            del self.levels[level + 1 :]
        else:
            state = BoxCells(boxes).select("i", "j").join(amr.interpolate(parents.select("i", "j", *names), names), ["i", "j"])
            self.levels.append(Level(self._cut(state), boxes))

    # reports

    def patch_table(self, spark: SparkSession) -> DataFrame:
        """One row a box: level, box, corners, cells."""
        rows = [(k, q, b.i0, b.j0, b.i1, b.j1, b.cells) for k, level in enumerate(self.levels) for q, b in enumerate(level.boxes or [Box.of(*self.scheme.shape)])]
        return spark.createDataFrame(rows, "level int, box_id int, i0 int, j0 int, i1 int, j1 int, cells long")

    def explain_ghosts(self, spark: SparkSession, folder: str, level: int) -> DataFrame:
        """Ghost cells of each box by where they come from: their level, or the coarser one."""
        at = self.scheme.at(level)
        cells = BoxCells(self.levels[level].boxes, DEPTH[at.limiter]).filter(var("own") < 0.5).with_(wi=at.place("i", "i"), wj=at.place("j", "j"))
        own = BoxCells(self.levels[level].boxes).select(wi="i", wj="j", same="own")
        found = cells.join(own, ["wi", "wj"], "left").frame(spark, folder)
        kind = F.when(F.col("same").isNull(), "coarse").otherwise("same level").alias("source")
        return found.select("box_id", kind).groupBy("box_id", "source").agg(F.count(F.lit(1)).alias("cells"))

    def explain_reflux(self, spark: SparkSession, folder: str, level: int) -> DataFrame:
        """Faces of a level towards its child, by the child's side."""
        border = interface(self.scheme.at(level), self.levels[level + 1].boxes).frame(spark, folder)
        side = F.element_at(F.array(*[F.lit(s) for s in SIDES]), F.col("side") + 1).alias("side")
        return border.select(side).groupBy("side").agg(F.count(F.lit(1)).alias("faces"))

    def explain_regrid(self, spark: SparkSession, folder: str, level: int, tagged: Plan) -> DataFrame:
        """Tags and cells of each box of a level; ``tagged``: tags of the level below."""
        cells = BoxCells([b.coarsen(2) for b in self.levels[level].boxes]).frame(spark, folder)
        marks = tagged.select("i", "j").frame(spark, folder).withColumn("tag", F.lit(1))
        return cells.join(marks, ["i", "j"], "left").groupBy("box_id").agg(F.count(F.lit(1)).alias("cells"), F.count("tag").alias("tags"))

    def snapshot(self, spark: SparkSession, folder: str) -> DataFrame:
        """All levels' rows, with the level."""
        frames = [x.state.frame(spark, folder).select(F.lit(k).alias("level"), "i", "j", *self.scheme.names) for k, x in enumerate(self.levels)]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def total(self, c: str) -> Plan:
        """The integral of a component over level 0."""
        return self.levels[0].state.group([], total=("sum", total([var(c) * (self.scheme.h[0] * self.scheme.h[1])])))


def _nested(box: Box, boxes: list[Box] | None, at: Scheme) -> bool:
    """Whether a rectangle lies under some boxes, but for what is beyond the domain."""
    if boxes is None:
        return True
    inside = box.intersect(Box.of(*at.shape))
    return sum(inside.intersect(b).cells for b in boxes) == inside.cells


@dataclass
class Runtime:
    """Steps, regridding by a cadence, and the coarse fields."""

    hierarchy: Hierarchy
    find_boxes: Callable[[Hierarchy, int], list[Box]] | None = None  # boxes of a level, from the one below
    regrid_every: int = 0  # 0: frozen
    fields: Callable[[Plan], Plan] | None = None  # the state of level 0 to its auxiliary columns
    couple: Callable[[Plan, float], Plan] | None = None  # a pointwise source on each level
    speed: Callable[[Plan], float] | None = None
    macro_step: int = 0
    t: float = 0.0
    solves: int = 0
    log: list[str] = field(default_factory=list)

    def solve_fields(self) -> None:
        if self.fields:
            self.hierarchy.aux = self.hierarchy._cut(self.fields(self.hierarchy.levels[0].state))
            self.solves += 1

    def step(self, dt: float) -> None:
        h = self.hierarchy
        if self.find_boxes and self.regrid_every and self.macro_step > 0 and self.macro_step % self.regrid_every == 0:
            for level in range(1, max(2, len(h.levels))):
                boxes = self.find_boxes(h, level)
                if not boxes:
                    del h.levels[level:]
                    break
                h.regrid(level, boxes)
            self.log.append(f"regrid before step {self.macro_step}")
        self.solve_fields()
        h.step(dt)
        if self.couple:
            for level in h.levels:
                level.state = self.couple(level.state, dt)
            h.sync()
        self.macro_step += 1
        self.t += dt

    def step_cfl(self, cfl: float) -> float:
        """Solves the fields first, as the speeds may read them; the step solves them again."""
        self.solve_fields()
        dt = cfl * min(self.hierarchy.scheme.h) / max(self.speed(self.hierarchy.levels[0].state), 1e-30)
        self.step(dt)
        return dt

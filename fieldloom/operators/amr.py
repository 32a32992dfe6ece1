"""Refinement: tags, transfer between levels, coverage, flux correction, and layouts.

A level is a field whose index space is twice as fine as the one below. Floor division
is written out, so that negative indices go the right way.
"""

from __future__ import annotations

from collections.abc import Iterable

from fieldloom.functions.expr import Expr, abs_, maximum, var, where
from fieldloom.operators.grid import Box
from fieldloom.plans.relation import Plan, Rows, raw

RATIO = 2


def coarse_index(axis: str, r: int = RATIO) -> Expr:
    return raw(f"cast(floor({axis} / cast({r} as double)) as int)", f"floor({axis} / {r}.0::DOUBLE)::INTEGER")


def average_down(fine: Plan, columns: list[str], r: int = RATIO) -> Plan:
    """Each coarse cell: the sum of its children times 1 / r^2."""
    x = fine.select(i=coarse_index("i", r), j=coarse_index("j", r), **{c: var(c) for c in columns})
    return x.group(["i", "j"], **{c: ("sum", c) for c in columns}).with_(**{c: var(c) * (1.0 / (r * r)) for c in columns})


def interpolate(coarse: Plan, columns: list[str], r: int = RATIO) -> Plan:
    """Piecewise constant: each child gets its parent's values."""
    x = coarse.explode("di", list(range(r))).explode("dj", list(range(r)))
    return x.select(i=raw(f"i * {r} + di"), j=raw(f"j * {r} + dj"), **{c: var(c) for c in columns})


def interpolate_bilinear(coarse: Plan, c: str, shape, bc="periodic") -> Plan:
    """Children from the four nearest parents, weights 9, 3, 3, 1 sixteenths."""
    offsets = {"xm": (-1, 0), "xp": (1, 0), "ym": (0, -1), "yp": (0, 1), "mm": (-1, -1), "mp": (-1, 1), "pm": (1, -1), "pp": (1, 1)}
    x = coarse.shift([c], offsets, shape, bc).explode("di", [0, 1]).explode("dj", [0, 1])
    right, up = raw("cast(di as double)", "di::DOUBLE").eq(1.0), raw("cast(dj as double)", "dj::DOUBLE").eq(1.0)
    side = where(right, var(f"{c}_xp"), var(f"{c}_xm"))
    above = where(up, var(f"{c}_yp"), var(f"{c}_ym"))
    corner = where(right, where(up, var(f"{c}_pp"), var(f"{c}_pm")), where(up, var(f"{c}_mp"), var(f"{c}_mm")))
    value = (var(c) * 9.0 + side * 3.0 + above * 3.0 + corner) / 16.0
    return x.select(i=raw("i * 2 + di"), j=raw("j * 2 + dj"), **{c: value})


def in_time(old: Expr, new: Expr, part: float) -> Expr:
    """Ghost values between two coarse times."""
    return old * (1.0 - part) + new * part


def tags(field: Plan, test: Expr) -> Plan:
    """The cells where the criterion holds; presence is the tag."""
    return field.filter(test).select("i", "j")


def above(c: str, value: float) -> Expr:
    return var(c) > value


def below(c: str, value: float) -> Expr:
    return var(c) < value


def magnitude_above(c: str, value: float) -> Expr:
    return abs_(var(c)) > value


def gradient_tags(field: Plan, c: str, shape, value: float, bc="periodic") -> Plan:
    """Cells whose largest difference to a neighbour is above a value."""
    from fieldloom.operators.stencil import CROSS

    x = field.shift([c], CROSS, shape, bc)
    worst = abs_(var(f"{c}_xp") - var(c))
    for s in ("xm", "yp", "ym"):
        worst = maximum(worst, abs_(var(f"{c}_{s}") - var(c)))
    return tags(x.with_(jump=worst), var("jump") > value)


def grow(tagged: Plan, n: int, domain: Box) -> Plan:
    """Square dilation by ``n`` cells, clipped to the domain."""
    x = tagged.explode("di", list(range(-n, n + 1))).explode("dj", list(range(-n, n + 1)))
    x = x.select(i=raw("i + di"), j=raw("j + dj"))
    inside = raw(f"i >= {domain.i0} AND i <= {domain.i1} AND j >= {domain.j0} AND j <= {domain.j1}")
    return x.filter(inside).distinct()


def union(a: Plan, b: Plan) -> Plan:
    return a.union(b).distinct()


def signature(tagged: Plan, axis: str) -> Plan:
    """Tags per line of cells."""
    return tagged.group([axis], n=("count", 1.0))


def bounding_box(tagged: Plan) -> Plan:
    return tagged.group([], i0=("min", "i"), j0=("min", "j"), i1=("max", "i"), j1=("max", "j"))


def boxes(found: Iterable[Box]) -> Plan:
    return Rows(["box_id", "i0", "j0", "i1", "j1"], [(k, b.i0, b.j0, b.i1, b.j1) for k, b in enumerate(found)])


def box_cells(found: Iterable[Box]) -> Plan:
    """``i, j, box_id`` of every cell of some boxes: what cells are matched with.

    A box is spread over its own cells once, so that coverage and lookup are equal-cell
    joins, which shuffle by cell and never compare all cells with all boxes.
    """
    from fieldloom.plans.relation import BoxCells

    return BoxCells(list(found)).select("i", "j", "box_id")


def covered(coarse: Plan, fine_boxes: list[Box], r: int = RATIO) -> Plan:
    """Coarse cells under fine boxes."""
    return coarse.join(box_cells([b.coarsen(r) for b in fine_boxes]).select("i", "j").distinct(), ["i", "j"], "semi")


def uncovered(coarse: Plan, fine_boxes: list[Box], r: int = RATIO) -> Plan:
    return coarse.join(box_cells([b.coarsen(r) for b in fine_boxes]).select("i", "j").distinct(), ["i", "j"], "anti")


def inject(coarse: Plan, fine: Plan, columns: list[str], r: int = RATIO) -> Plan:
    """Fine cells take their parent's values; fine cells without a parent keep theirs."""
    parents = interpolate(coarse, columns, r).rename(**{c: f"{c}_parent" for c in columns})
    x = fine.join(parents, ["i", "j"], "left")
    return x.with_(**{c: raw(f"coalesce({c}_parent, {c})") for c in columns}).select(*fine.columns)


def regrid(old_fine: Plan, coarse: Plan, found: list[Box], columns: list[str]) -> Plan:
    """The new fine level: interpolated, but old fine values where there were any."""
    cells = box_cells(found)
    new = cells.join(interpolate(coarse, columns), ["i", "j"])
    old = old_fine.select("i", "j", **{f"{c}_old": var(c) for c in columns})
    x = new.join(old, ["i", "j"], "left")
    return x.with_(**{c: raw(f"coalesce({c}_old, {c})") for c in columns}).select("i", "j", "box_id", *columns)


def reflux(coarse_flux: Plan, fine_flux: Plan, flux: str, dt: float, h: float, substeps: int = 2) -> Plan:
    """Correction of the coarse cells right of a refined region's upper x faces.

    ``coarse_flux``: ``i, j`` of the coarse cell whose upper face lies on the border, and its
    flux; ``fine_flux``: the same of fine cells, each for all substeps together. The
    coarse cell beyond the face gets (mean fine flux - coarse flux) dt / h.
    """
    fine = fine_flux.select(i=coarse_index("i"), j=coarse_index("j"), s=var(flux)).group(["i", "j"], s=("sum", "s"))
    x = coarse_flux.join(fine, ["i", "j"])
    mean = var("s") / float(RATIO * substeps)
    return x.select(i=raw("i + 1"), j=raw("j"), correction=(mean - var(flux)) * (dt / h))


def morton(bits: int = 10) -> Expr:
    """The place on the Z curve: bits of i and j interleaved."""
    spark = " + ".join(f"shiftleft(cast(shiftright(i, {k}) & 1 as bigint), {2 * k}) + shiftleft(cast(shiftright(j, {k}) & 1 as bigint), {2 * k + 1})" for k in range(bits))
    other = " + ".join(f"((((i >> {k}) & 1)::BIGINT) << {2 * k}) + ((((j >> {k}) & 1)::BIGINT) << {2 * k + 1})" for k in range(bits))
    return raw(spark, other)


def sfc_owner(ordered: Plan, weight: str, ranks: int, total_weight: float) -> Plan:
    """Contiguous segments of the Z curve with about equal load; ``ordered`` has ``z`` and ``grp``."""
    x = ordered.running("upto", "sum", weight, ["grp"], ["z"])
    share = f"floor((upto - {weight}) * {ranks}.0 / {total_weight!r})"
    return x.with_(rank=raw(f"cast(least({share}, {ranks - 1}) as int)", f"least({share}, {ranks - 1})::INTEGER"))


def knapsack(weights: list[float], ranks: int) -> list[int]:
    """Heaviest box first, to the least loaded rank (ties: the lowest)."""
    load, owner = [0.0] * ranks, [0] * len(weights)
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        rank = min(range(ranks), key=lambda r: (load[r], r))
        owner[k], load[rank] = rank, load[rank] + weights[k]
    return owner


def imbalance(weights: list[float], owner: list[int], ranks: int) -> float:
    """Largest load over the mean."""
    load = [0.0] * ranks
    for w, r in zip(weights, owner):
        load[r] += w
    mean = sum(load) / ranks
    return max(load) / mean if mean else 1.0


def cluster(tagged: set[tuple[int, int]], efficiency: float = 0.7, min_size: int = 2, max_size: int = 32) -> list[Box]:
    """Berger-Rigoutsos over a bounded set of tags (one region's).

    Shrink to the tags; accept a box that is full enough; else cut at a hole of a
    signature, else at its steepest inflection, else in the middle.
    """
    done: list[Box] = []
    todo = [sorted(tagged)] if tagged else []
    while todo:
        cells = todo.pop()
        box = Box(min(i for i, _ in cells), min(j for _, j in cells), max(i for i, _ in cells), max(j for _, j in cells))
        at = _cut(cells, box, min_size)
        if len(cells) >= efficiency * box.cells or at is None:
            done += box.chop(max_size)
            continue
        axis, place = at
        todo += [part for part in ([c for c in cells if c[axis] <= place], [c for c in cells if c[axis] > place]) if part]
    return sorted(done, key=lambda b: (b.j0, b.i0))


def _cut(cells: list[tuple[int, int]], box: Box, min_size: int) -> tuple[int, int] | None:
    lows = (box.i0, box.j0)
    counts = []
    for axis in (0, 1):
        line = [0] * box.shape[axis]
        for c in cells:
            line[c[axis] - lows[axis]] += 1
        counts.append(line)
    axes = sorted((0, 1), key=lambda a: -box.shape[a])
    able = [a for a in axes if box.shape[a] >= 2 * min_size]
    for a in able:
        line, middle = counts[a], len(counts[a]) / 2
        holes = [k for k, n in enumerate(line) if n == 0]
        if holes:
            k = min(holes, key=lambda k: abs(k - middle))
            return a, lows[a] + k
    best = None
    for a in able:
        line = counts[a]
        second = [line[k + 1] - 2 * line[k] + line[k - 1] for k in range(1, len(line) - 1)]
        for k in range(len(second) - 1):
            place = k + 1
            if second[k] * second[k + 1] < 0 and min_size - 1 <= place <= len(line) - min_size - 1:
                jump = abs(second[k + 1] - second[k])
                if best is None or jump > best[0]:
                    best = (jump, a, lows[a] + place)
    if best:
        return best[1], best[2]
    if able:
        return able[0], lows[able[0]] + len(counts[able[0]]) // 2 - 1
    return None

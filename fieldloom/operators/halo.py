"""Box layouts: ghost cells, and copies between layouts.

A layout deals a grid into equal square boxes. Every cell finds the boxes that need it as a
ghost from its own place alone, so filling ghosts is one explode and one shuffle by box;
there is no join of cells with boxes.
"""

from __future__ import annotations

from fieldloom.functions.expr import var
from fieldloom.plans.relation import Plan, raw


def box_of(size: int, boxes: int) -> Plan | object:
    """The box of a cell in a layout of ``boxes`` x ``boxes`` boxes of ``size`` cells a side."""
    return raw(f"cast((i div {size}) * {boxes} + (j div {size}) as int)", f"((i // {size}) * {boxes} + (j // {size}))::INTEGER")


def with_boxes(field: Plan, size: int, boxes: int) -> Plan:
    return field.with_(box_id=box_of(size, boxes))


def ghosts(field: Plan, columns: list[str], size: int, boxes: int, depth: int = 1) -> Plan:
    """``box_id, i, j`` and the columns of each box's ghost cells, on a periodic grid.

    The indices are the box's own: a ghost beyond the edge of the grid has an index below
    zero or past the end. ``depth`` may be up to the size of a box.
    """
    if depth > size:
        raise ValueError("ghosts reach at most into the next box")
    x = field.explode("di", [-depth, 0, depth]).explode("dj", [-depth, 0, depth])

    def target(axis: str, d: str) -> object:
        return raw(f"cast(floor(cast({axis} + {d} as double) / {size}) as int)", f"floor(({axis} + {d})::DOUBLE / {size})::INTEGER")

    x = x.with_(bi=target("i", "di"), bj=target("j", "dj"))
    x = x.filter(raw(f"bi <> i div {size} OR bj <> j div {size}", f"bi <> i // {size} OR bj <> j // {size}"))
    wrapped = f"pmod(bi, {boxes}) * {boxes} + pmod(bj, {boxes})"
    other = f"(((bi % {boxes}) + {boxes}) % {boxes}) * {boxes} + (((bj % {boxes}) + {boxes}) % {boxes})"
    x = x.select(
        box_id=raw(f"cast({wrapped} as int)", f"({other})::INTEGER"),
        i=raw(f"cast(i - (bi - pmod(bi, {boxes})) * {size} as int)", f"(i - (bi - (((bi % {boxes}) + {boxes}) % {boxes})) * {size})::INTEGER"),
        j=raw(f"cast(j - (bj - pmod(bj, {boxes})) * {size} as int)", f"(j - (bj - (((bj % {boxes}) + {boxes}) % {boxes})) * {size})::INTEGER"),
        **{c: var(c) for c in columns},
    )
    return x.distinct()


def copy_to_layout(source: Plan, columns: list[str], size: int, boxes: int) -> Plan:
    """The same cells under another layout's boxes."""
    return with_boxes(source.select("i", "j", *columns), size, boxes).select("box_id", "i", "j", *columns)

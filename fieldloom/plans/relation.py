"""Relational plans over mesh fields, declared once.

A plan is a tree of nodes. ``frame`` builds it with the DataFrame API, so that Catalyst
sees plain projections, windows, joins and aggregates; ``sql`` prints it as common table
expressions for another SQL engine, with neighbours as self-joins instead of windows.

A field has one row per cell, keyed by ``i`` and ``j`` (0-based), and one double column per
component. Shifts along an axis are ``lag`` and ``lead`` over windows partitioned by the
other axis: one shuffle per axis, however many neighbours, and no task ever holds more
than a line of cells at once. They need a complete grid. A plan knows along which axis its
rows were last moved (``along``); the next shift starts with that axis, where the rows lie
right already, so a chain of stages needs one shuffle a stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.expr import Expr, Var, wrap

Boundary = Any  # "periodic", "foextrap", ("dirichlet", value), Edges of the latter two, or "none" (null outside)


@dataclass(frozen=True)
class Edges:
    """Different rules at the lower and the upper end of an axis."""

    lo: Boundary
    hi: Boundary

    def __post_init__(self):
        if "periodic" in (self.lo, self.hi):
            raise ValueError("an axis is periodic at both ends or at none")


def axis_rules(bc: Boundary) -> tuple[Boundary, Boundary]:
    """The rules of both axes."""
    return bc if isinstance(bc, tuple) and len(bc) == 2 and bc[0] != "dirichlet" else (bc, bc)


def _side(bc: Boundary, by: int) -> Boundary:
    """The rule that a move meets."""
    return (bc.hi if by > 0 else bc.lo) if isinstance(bc, Edges) else bc


def derived_rules(bc: Boundary) -> tuple[Boundary, Boundary]:
    """The rules of auxiliary fields: periodic axes stay so, all other ends copy."""
    return tuple(b if b in ("periodic", "none") else "foextrap" for b in axis_rules(bc))


@dataclass(frozen=True)
class Raw(Expr):
    """An expression given per engine, for what the tree has no node for."""

    spark: str
    other: str

    def column(self) -> Column:
        return F.expr(self.spark)

    def sql(self) -> str:
        return f"({self.other})"

    def evaluate(self, env):
        raise NotImplementedError("no NumPy form")


def raw(spark: str, other: str | None = None) -> Raw:
    return Raw(spark, spark if other is None else other)


def rounded(x: Any, digits: int = 9) -> Expr:
    x = wrap(x)
    return Rounded(x, digits)


@dataclass(frozen=True)
class Rounded(Expr):
    """Rounded, and never minus zero."""

    a: Expr
    digits: int

    def children(self):
        return (self.a,)

    def column(self) -> Column:
        return F.round(self.a.column(), self.digits) + F.lit(0.0)

    def sql(self) -> str:
        return f"(round({self.a.sql()}, {self.digits}) + 0.0::DOUBLE)"

    def evaluate(self, env):
        return self.a.evaluate(env).round(self.digits) + 0.0


@dataclass
class Engine:
    """What a plan is built in: the session and its input folder, or only names of CTEs."""

    spark: SparkSession | None = None
    folder: str = ""
    done: dict[int, Any] = field(default_factory=dict)
    ctes: list[tuple[str, str]] = field(default_factory=list)

    def frame(self, plan: Plan) -> DataFrame:
        if id(plan) not in self.done:
            self.done[id(plan)] = plan._frame(self)
        return self.done[id(plan)]

    def name(self, plan: Plan) -> str:
        if id(plan) not in self.done:
            text = plan._sql(self)
            name = f"t{len(self.ctes)}"
            self.ctes.append((name, text))
            self.done[id(plan)] = name
        return self.done[id(plan)]


class Plan:
    """A relation; methods give new ones."""

    columns: list[str]
    #: The axis along whose lines the rows lie, if known.
    along: str | None = None

    def _frame(self, at: Engine) -> DataFrame:
        raise NotImplementedError

    def _sql(self, at: Engine) -> str:
        raise NotImplementedError

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return Engine(spark, folder).frame(self)

    def sql(self) -> str:
        at = Engine()
        last = at.name(self)
        ctes = ",\n".join(f"{n} AS ({t})" for n, t in at.ctes)
        return f"WITH {ctes}\nSELECT * FROM {last}"

    def select(self, *names: str, **exprs: Any) -> Plan:
        return Project(self, {**{n: Var(n) for n in names}, **{k: wrap(v) for k, v in exprs.items()}})

    def with_(self, **exprs: Any) -> Plan:
        kept = {n: Var(n) for n in self.columns if n not in exprs}
        return Project(self, {**kept, **{k: wrap(v) for k, v in exprs.items()}})

    def drop(self, *names: str) -> Plan:
        return self.select(*[c for c in self.columns if c not in names])

    def rename(self, **names: str) -> Plan:
        return Project(self, {names.get(c, c): Var(c) for c in self.columns})

    def filter(self, test: Expr) -> Plan:
        return Filter(self, test)

    def shift(self, columns: list[str], offsets: dict[str, tuple[int, int]], shape: tuple[int, int], bc: tuple[Boundary, Boundary] | Boundary = "periodic", within: tuple[str, ...] = ()) -> Plan:
        """New columns ``{column}_{suffix}``: the value at the cell moved by an offset; ``within``: among
        rows that agree in these columns only, whose cells may be any rectangles (rule "none")."""
        return Shift(self, columns, offsets, shape, axis_rules(bc), within)

    def join(self, other: Plan, on: list[str], how: str = "inner") -> Plan:
        return Join(self, other, on, how)

    def group(self, keys: list[str], **aggs: tuple[str, Any]) -> Plan:
        return Group(self, keys, {k: (f, wrap(x)) for k, (f, x) in aggs.items()})

    def union(self, other: Plan) -> Plan:
        return Union(self, other)

    def distinct(self) -> Plan:
        return Distinct(self)

    def explode(self, name: str, values: list[int]) -> Plan:
        """Each row once for each value, in a new column."""
        return Explode(self, name, values)

    def top(self, order: list[tuple[str, bool]], n: int) -> Plan:
        """The first ``n`` rows; ``True`` is descending."""
        return Top(self, order, n)

    def running(self, name: str, fn: str, x: Any, by: list[str], order: list[str], back: int | None = None) -> Plan:
        """``fn`` over the rows so far (``back``: the value that many rows ago instead)."""
        return Running(self, name, fn, wrap(x), by, order, back)


class Table(Plan):
    """A table of the input folder."""

    def __init__(self, name: str, columns: list[str]):
        self.table, self.columns = name, columns

    def _frame(self, at):
        return at.spark.read.parquet(f"{at.folder}/{self.table}.parquet").select(*self.columns)

    def _sql(self, at):
        return f"SELECT {', '.join(self.columns)} FROM {self.table}"


class Given(Plan):
    """A DataFrame that exists already; it has no SQL form."""

    def __init__(self, df: DataFrame):
        self.df, self.columns = df, df.columns

    def _frame(self, at):
        return self.df

    def _sql(self, at):
        raise NotImplementedError("a DataFrame has no SQL form")


class Grid(Plan):
    """All cells of a grid."""

    def __init__(self, nx: int, ny: int):
        self.nx, self.ny, self.columns = nx, ny, ["i", "j"]

    def _frame(self, at):
        cells = at.spark.range(self.nx * self.ny)
        return cells.select(F.expr(f"cast(id div {self.ny} as int)").alias("i"), F.expr(f"cast(id % {self.ny} as int)").alias("j"))

    def _sql(self, at):
        return f"SELECT (id // {self.ny})::INTEGER AS i, (id % {self.ny})::INTEGER AS j FROM range({self.nx * self.ny}) r(id)"


class Rows(Plan):
    """Literal rows of numbers; for small tables such as boxes."""

    def __init__(self, columns: list[str], rows: list[tuple], types: list[str] | None = None):
        self.columns, self.rows, self.types = columns, rows, types or ["int"] * len(columns)

    def _frame(self, at):
        schema = ", ".join(f"{c} {t}" for c, t in zip(self.columns, self.types))
        return at.spark.createDataFrame(self.rows, schema)

    def _sql(self, at):
        kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
        lines = " UNION ALL ".join("SELECT " + ", ".join(f"{v!r}::{kinds[t]} AS {c}" for c, t, v in zip(self.columns, self.types, r)) for r in self.rows)
        return lines


class BoxCells(Plan):
    """``box_id, i, j`` of all cells of some boxes, each grown by ``depth``, and ``own``: 1 inside the box
    itself, 0 in its ghosts. A box is one literal row, spread over its cells in parallel."""

    def __init__(self, found: list, depth: int = 0):
        self.found, self.depth, self.columns = list(found), depth, ["box_id", "i", "j", "own"]

    def _frame(self, at):
        rows = [(k, b.i0, b.j0, b.i1, b.j1) for k, b in enumerate(self.found)]
        df = at.spark.createDataFrame(rows, "box_id int, i0 int, j0 int, i1 int, j1 int")
        d = self.depth
        df = df.withColumn("i", F.explode(F.expr(f"sequence(i0 - {d}, i1 + {d})"))).withColumn("j", F.explode(F.expr(f"sequence(j0 - {d}, j1 + {d})")))
        return df.select("box_id", "i", "j", F.expr("if(i >= i0 AND i <= i1 AND j >= j0 AND j <= j1, 1D, 0D)").alias("own"))

    def _sql(self, at):
        d = self.depth
        rows = " UNION ALL ".join(f"SELECT {k} AS box_id, {b.i0} AS i0, {b.j0} AS j0, {b.i1} AS i1, {b.j1} AS j1" for k, b in enumerate(self.found))
        x = f"SELECT *, unnest(range(i0 - {d}, i1 + {d + 1})) AS i FROM ({rows})"
        y = f"SELECT *, unnest(range(j0 - {d}, j1 + {d + 1})) AS j FROM ({x})"
        return f"SELECT box_id::INTEGER AS box_id, i::INTEGER AS i, j::INTEGER AS j, (CASE WHEN i >= i0 AND i <= i1 AND j >= j0 AND j <= j1 THEN 1 ELSE 0 END)::DOUBLE AS own FROM ({y})"


#: Expanded trees up to this size stay in one projection; smaller shared parts are repeated.
ONE_PROJECTION, SHARED_SIZE = 150, 4


def staged(exprs: dict[str, Expr]) -> tuple[list[dict[str, Expr]], dict[str, Expr]]:
    """Shared subtrees as columns of their own, in levels, and what is left.

    An engine sees a tree, so a subtree that is used twice is planned twice, and nested
    sharing grows exponentially. Catalyst keeps projections apart whose costly columns are
    used more than once.
    """
    ids: dict[tuple, int] = {}
    nodes: list[Expr] = []
    kids: list[tuple[int, ...]] = []
    size: list[int] = []
    memo: dict[int, int] = {}

    def number(e: Expr) -> int:
        if id(e) not in memo:
            below = tuple(number(c) for c in e.children())
            marks = tuple(repr(getattr(e, k, None)) for k in ("op", "value", "name", "digits", "spark"))
            key = (type(e).__name__, marks, below)
            if key not in ids:
                ids[key] = len(nodes)
                nodes.append(e)
                kids.append(below)
                size.append(1 + sum(size[k] for k in below))
            memo[id(e)] = ids[key]
        return memo[id(e)]

    roots = {n: number(e) for n, e in exprs.items()}
    if sum(size[r] for r in roots.values()) <= ONE_PROJECTION:
        return [], exprs
    uses = [0] * len(nodes)
    for u in [*roots.values(), *(k for below in kids for k in below)]:
        uses[u] += 1
    shared = {u for u in range(len(nodes)) if uses[u] > 1 and size[u] >= SHARED_SIZE}
    level: list[int] = []
    for u in range(len(nodes)):
        level.append(max((level[k] + (k in shared) for k in kids[u]), default=0))

    def built(u: int, top: bool = False) -> Expr:
        if u in shared and not top:
            return Var(f"_c{u}")
        names = ("test", "a", "b") if len(kids[u]) == 3 else ("a", "b")
        return replace(nodes[u], **{n: built(k) for n, k in zip(names, kids[u])}) if kids[u] else nodes[u]

    stages: dict[int, dict[str, Expr]] = {}
    for u in sorted(shared):
        stages.setdefault(level[u], {})[f"_c{u}"] = built(u, top=True)
    return [stages[k] for k in sorted(stages)], {n: built(u) for n, u in roots.items()}


class Project(Plan):
    def __init__(self, child: Plan, exprs: dict[str, Expr]):
        self.child, self.exprs, self.columns, self.along = child, exprs, list(exprs), child.along

    def _frame(self, at):
        df = at.frame(self.child)
        stages, last = staged(self.exprs)
        for new in stages:
            df = df.select("*", *[e.column().alias(n) for n, e in new.items()])
        return df.select(*[e.column().alias(n) for n, e in last.items()])

    def _sql(self, at):
        name = at.name(self.child)
        stages, last = staged(self.exprs)
        for new in stages:
            at.ctes.append((f"t{len(at.ctes)}", f"SELECT *, {', '.join(f'{e.sql()} AS {n}' for n, e in new.items())} FROM {name}"))
            name = at.ctes[-1][0]
        return f"SELECT {', '.join(f'{e.sql()} AS {n}' for n, e in last.items())} FROM {name}"


class Filter(Plan):
    def __init__(self, child: Plan, test: Expr):
        self.child, self.test, self.columns, self.along = child, test, child.columns, child.along

    def _frame(self, at):
        return at.frame(self.child).where(self.test.column())

    def _sql(self, at):
        return f"SELECT * FROM {at.name(self.child)} WHERE {self.test.sql()}"


def _moved(column: str, by: int, axis: str, n: int, bc: Boundary, within: tuple[str, ...] = ()) -> Column:
    """The column's value ``by`` cells further along an axis."""
    other = "j" if axis == "i" else "i"
    over = W.partitionBy(*within, other).orderBy(axis)
    if by == 0:
        return F.col(column)
    inside = F.lead(column, by).over(over) if by > 0 else F.lag(column, -by).over(over)
    bc = _side(bc, by)
    if bc == "none":
        return inside
    if bc == "periodic":
        return F.coalesce(inside, F.lag(column, n - by).over(over) if by > 0 else F.lead(column, n + by).over(over))
    if bc == "foextrap":
        line = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # found once a line
        edge = F.last(column).over(line) if by > 0 else F.first(column).over(line)
        return F.coalesce(inside, edge)
    _, value = bc
    outside = F.lit(None).cast("double")
    for k in range(abs(by)):  # k cells from the edge; the mirrored cell lies inside
        back = 2 * k + 1 - abs(by)  # cells from here to the mirror, towards the edge if positive
        toward = back if by > 0 else -back
        mirror = F.col(column) if toward == 0 else F.lead(column, toward).over(over) if toward > 0 else F.lag(column, -toward).over(over)
        at_edge = F.col(axis) == (n - 1 - k if by > 0 else k)
        outside = F.when(at_edge, F.lit(2.0 * value) - mirror).otherwise(outside)
    return F.when(F.col(axis) + by >= n if by > 0 else F.col(axis) + by < 0, outside).otherwise(inside)


class Shift(Plan):
    def __init__(self, child, columns, offsets, shape, bc, within=()):
        self.child, self.cols, self.offsets, self.shape, self.bc, self.within = child, columns, offsets, shape, bc, tuple(within)
        if self.within and bc != ("none", "none"):
            raise ValueError("rows within groups have no edges that a rule could fill")
        self.columns = child.columns + [f"{c}_{s}" for s in offsets for c in columns]
        moves = list(offsets.values())
        self.diagonal = any(dx and dy for dx, dy in moves)
        axes = [a for a, k in (("i", 0), ("j", 1)) if any(m[k] for m in moves)]
        if not self.diagonal and child.along in axes:
            axes = [child.along, *[a for a in axes if a != child.along]]
        self.order, self.along = axes, axes[-1] if axes else child.along

    def _frame(self, at):
        df = at.frame(self.child)
        n, rules = dict(zip("ij", self.shape)), dict(zip("ij", self.bc))
        if self.diagonal:
            x_moves = sorted({dx for dx, _ in self.offsets.values() if dx})
            df = df.withColumns({f"_{c}_x{k}": _moved(c, k, "i", n["i"], rules["i"], self.within) for k in x_moves for c in self.cols})
            out = {f"{c}_{s}": _moved(f"_{c}_x{dx}" if dx else c, dy, "j", n["j"], rules["j"], self.within) for s, (dx, dy) in self.offsets.items() for c in self.cols}
            return df.withColumns(out).select(*self.columns)
        for axis in self.order:
            by = {s: m["ij".index(axis)] for s, m in self.offsets.items()}
            df = df.withColumns({f"{c}_{s}": _moved(c, k, axis, n[axis], rules[axis], self.within) for s, k in by.items() if k for c in self.cols})
        still = {f"{c}_{s}": F.col(c) for s, m in self.offsets.items() if m == (0, 0) for c in self.cols}
        return (df.withColumns(still) if still else df).select(*self.columns)

    def _sql(self, at):
        t = at.name(self.child)
        (nx, ny), (bx, by) = self.shape, self.bc

        def index(axis: str, by_: int, n: int, bc: Boundary) -> str:
            x = f"c.{axis} + ({by_})"
            bc = _side(bc, by_)
            if bc == "none":
                return x
            if bc == "periodic":
                return f"((({x}) % {n}) + {n}) % {n}"
            if bc == "foextrap":
                return f"least(greatest({x}, 0), {n - 1})"
            return f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN {2 * n - 1} - ({x}) ELSE {x} END"

        joins, out = [], [f"c.{c}" for c in self.child.columns]
        kind = "LEFT JOIN" if "none" in (bx, by) else "JOIN"
        same = "".join(f" AND s{{k}}.{w} = c.{w}" for w in self.within)
        for k, (suffix, (dx, dy)) in enumerate(self.offsets.items()):
            joins.append(f"{kind} {t} s{k} ON s{k}.i = {index('i', dx, nx, bx)} AND s{k}.j = {index('j', dy, ny, by)}" + same.format(k=k))
            for c in self.cols:
                value = f"s{k}.{c}"
                for axis, by_, n, bc in (("i", dx, nx, bx), ("j", dy, ny, by)):
                    bc = _side(bc, by_)
                    if bc not in ("periodic", "foextrap", "none") and by_:
                        value = f"CASE WHEN c.{axis} + ({by_}) < 0 OR c.{axis} + ({by_}) >= {n} THEN {2.0 * bc[1]!r}::DOUBLE - {value} ELSE {value} END"
                out.append(f"{value} AS {c}_{suffix}")
        return f"SELECT {', '.join(out)} FROM {t} c {' '.join(joins)}"


class Join(Plan):
    def __init__(self, left: Plan, right: Plan, on: list[str], how: str):
        self.left, self.right, self.on, self.how = left, right, on, how
        self.columns = left.columns if how in ("semi", "anti") else left.columns + [c for c in right.columns if c not in on]

    def _frame(self, at):
        how = {"semi": "left_semi", "anti": "left_anti"}.get(self.how, self.how)
        return at.frame(self.left).join(at.frame(self.right), self.on, how).select(*self.columns)

    def _sql(self, at):
        a, b = at.name(self.left), at.name(self.right)
        if self.how in ("semi", "anti"):
            test = " AND ".join(f"a.{k} = b.{k}" for k in self.on)
            return f"SELECT * FROM {a} a WHERE {'NOT ' if self.how == 'anti' else ''}EXISTS (SELECT 1 FROM {b} b WHERE {test})"
        return f"SELECT {', '.join(self.columns)} FROM {a} {self.how} JOIN {b} USING ({', '.join(self.on)})"


_AGGREGATES: dict[str, tuple[Callable, str]] = {
    "sum": (F.sum, "sum({})"),
    "max": (F.max, "max({})"),
    "min": (F.min, "min({})"),
    "avg": (F.avg, "avg({})"),
    "count": (F.count, "count({})"),
    "any": (F.bool_or, "bool_or({})"),
}


class Group(Plan):
    def __init__(self, child: Plan, keys: list[str], aggs: dict[str, tuple[str, Expr]]):
        self.child, self.keys, self.aggs, self.columns = child, keys, aggs, keys + list(aggs)

    def _frame(self, at):
        return at.frame(self.child).groupBy(*self.keys).agg(*[_AGGREGATES[f][0](x.column()).alias(n) for n, (f, x) in self.aggs.items()])

    def _sql(self, at):
        out = self.keys + [f"{_AGGREGATES[f][1].format(x.sql())} AS {n}" for n, (f, x) in self.aggs.items()]
        return f"SELECT {', '.join(out)} FROM {at.name(self.child)}" + (f" GROUP BY {', '.join(self.keys)}" if self.keys else "")


class Union(Plan):
    def __init__(self, a: Plan, b: Plan):
        self.a, self.b, self.columns = a, b, a.columns

    def _frame(self, at):
        return at.frame(self.a).select(*self.columns).union(at.frame(self.b).select(*self.columns))

    def _sql(self, at):
        names = ", ".join(self.columns)
        return f"SELECT {names} FROM {at.name(self.a)} UNION ALL SELECT {names} FROM {at.name(self.b)}"


class Distinct(Plan):
    def __init__(self, child: Plan):
        self.child, self.columns = child, child.columns

    def _frame(self, at):
        return at.frame(self.child).distinct()

    def _sql(self, at):
        return f"SELECT DISTINCT * FROM {at.name(self.child)}"


class Explode(Plan):
    def __init__(self, child: Plan, name: str, values: list[int]):
        self.child, self.new, self.values, self.columns = child, name, values, [*child.columns, name]

    def _frame(self, at):
        return at.frame(self.child).withColumn(self.new, F.explode(F.array(*[F.lit(v) for v in self.values])))

    def _sql(self, at):
        return f"SELECT *, unnest([{', '.join(map(str, self.values))}])::INTEGER AS {self.new} FROM {at.name(self.child)}"


class Top(Plan):
    def __init__(self, child: Plan, order: list[tuple[str, bool]], n: int):
        self.child, self.order, self.n, self.columns = child, order, n, child.columns

    def _frame(self, at):
        return at.frame(self.child).orderBy(*[F.desc(c) if d else F.asc(c) for c, d in self.order]).limit(self.n)

    def _sql(self, at):
        return f"SELECT * FROM {at.name(self.child)} ORDER BY {', '.join(f'{c} DESC' if d else c for c, d in self.order)} LIMIT {self.n}"


class Running(Plan):
    def __init__(self, child, name, fn, x, by, order, back):
        self.child, self.new, self.fn, self.x, self.by, self.order, self.back = child, name, fn, x, by, order, back
        self.columns = [*child.columns, name]

    def _frame(self, at):
        over = W.partitionBy(*self.by).orderBy(*self.order)
        if self.back is not None:
            value = F.lag(self.x.column(), self.back).over(over)
        else:
            value = _AGGREGATES[self.fn][0](self.x.column()).over(over.rowsBetween(W.unboundedPreceding, 0))
        return at.frame(self.child).withColumn(self.new, value)

    def _sql(self, at):
        by = f"PARTITION BY {', '.join(self.by)} " if self.by else ""
        over = f"OVER ({by}ORDER BY {', '.join(self.order)}"
        if self.back is not None:
            value = f"lag({self.x.sql()}, {self.back}) {over})"
        else:
            value = f"{_AGGREGATES[self.fn][1].format(self.x.sql())} {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"SELECT *, {value} AS {self.new} FROM {at.name(self.child)}"


def concat(plans: list[Plan]) -> Plan:
    return reduce(lambda a, b: a.union(b), plans)

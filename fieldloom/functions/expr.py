"""Scalar expressions: one tree, evaluated by Catalyst, NumPy or an SQL engine.

An ``Expr`` is immutable. ``column`` gives a Spark Column, ``sql`` the text for another
SQL engine, ``evaluate`` a NumPy result, ``diff`` the symbolic derivative.
All numbers are doubles. ``div`` guards nothing by itself: use ``safe_div`` where the
denominator can be zero, as ANSI mode raises there and IEEE gives infinities.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Union

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Union[int, float]
Like = Union["Expr", int, float, str]


def wrap(x: Like) -> Expr:
    """Numbers become constants and strings variables."""
    if isinstance(x, Expr):
        return x
    return Var(x) if isinstance(x, str) else Const(float(x))


@dataclass(frozen=True)
class Expr:
    """Base of all nodes."""

    def __add__(self, o: Like) -> Expr:
        return Binary("+", self, wrap(o))

    def __radd__(self, o: Like) -> Expr:
        return Binary("+", wrap(o), self)

    def __sub__(self, o: Like) -> Expr:
        return Binary("-", self, wrap(o))

    def __rsub__(self, o: Like) -> Expr:
        return Binary("-", wrap(o), self)

    def __mul__(self, o: Like) -> Expr:
        return Binary("*", self, wrap(o))

    def __rmul__(self, o: Like) -> Expr:
        return Binary("*", wrap(o), self)

    def __truediv__(self, o: Like) -> Expr:
        return Binary("/", self, wrap(o))

    def __rtruediv__(self, o: Like) -> Expr:
        return Binary("/", wrap(o), self)

    def __pow__(self, o: Like) -> Expr:
        return Binary("^", self, wrap(o))

    def __neg__(self) -> Expr:
        return Unary("neg", self)

    def __pos__(self) -> Expr:
        return self

    def __abs__(self) -> Expr:
        return Unary("abs", self)

    def __lt__(self, o: Like) -> Expr:
        return Compare("<", self, wrap(o))

    def __le__(self, o: Like) -> Expr:
        return Compare("<=", self, wrap(o))

    def __gt__(self, o: Like) -> Expr:
        return Compare(">", self, wrap(o))

    def __ge__(self, o: Like) -> Expr:
        return Compare(">=", self, wrap(o))

    def eq(self, o: Like) -> Expr:
        return Compare("=", self, wrap(o))

    def __and__(self, o: Expr) -> Expr:
        return Logic("AND", self, o)

    def __or__(self, o: Expr) -> Expr:
        return Logic("OR", self, o)

    def children(self) -> tuple[Expr, ...]:
        return ()

    def deps(self) -> set[str]:
        """Names of the variables that it reads."""
        return set().union(*(c.deps() for c in self.children())) if self.children() else set()

    def key(self) -> str:
        """Structural key: equal for equal trees."""
        return self.sql()

    def column(self) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def evaluate(self, env: Mapping[str, np.ndarray | float]):
        raise NotImplementedError

    def substitute(self, env: Mapping[str, Expr]) -> Expr:
        """Variables replaced by expressions."""
        return self


@dataclass(frozen=True)
class Const(Expr):
    value: float

    def column(self) -> Column:
        return F.lit(self.value)

    def sql(self) -> str:
        return f"({self.value!r}::DOUBLE)"

    def evaluate(self, env):
        return self.value


@dataclass(frozen=True)
class Var(Expr):
    """A column: conservative, primitive, auxiliary or parameter."""

    name: str

    def deps(self) -> set[str]:
        return {self.name}

    def column(self) -> Column:
        return F.col(self.name)

    def sql(self) -> str:
        return self.name

    def evaluate(self, env):
        return env[self.name]

    def substitute(self, env):
        return env.get(self.name, self)


_BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
}


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr

    def children(self):
        return (self.a, self.b)

    def column(self) -> Column:
        if self.op == "^":
            return F.pow(self.a.column(), self.b.column())
        if self.op in ("max", "min"):
            return (F.greatest if self.op == "max" else F.least)(self.a.column(), self.b.column())
        return _BINARY[self.op](self.a.column(), self.b.column())

    def sql(self) -> str:
        a, b = self.a.sql(), self.b.sql()
        if self.op == "^":
            return f"pow({a}, {b})"
        if self.op in ("max", "min"):
            return f"{'greatest' if self.op == 'max' else 'least'}({a}, {b})"
        return f"({a} {self.op} {b})"

    def evaluate(self, env):
        a, b = self.a.evaluate(env), self.b.evaluate(env)
        if self.op == "^":
            return np.power(a, b)
        if self.op in ("max", "min"):
            return (np.maximum if self.op == "max" else np.minimum)(a, b)
        with np.errstate(divide="ignore", invalid="ignore"):
            return _BINARY[self.op](np.float64(a) if np.isscalar(a) else a, b)

    def substitute(self, env):
        return Binary(self.op, self.a.substitute(env), self.b.substitute(env))


_UNARY: dict[str, tuple[Callable, str, Callable]] = {
    "neg": (lambda c: -c, "(-{})", np.negative),
    "sqrt": (F.sqrt, "sqrt({})", np.sqrt),
    "abs": (F.abs, "abs({})", np.abs),
    "sign": (F.signum, "sign({})::DOUBLE", np.sign),
    "exp": (F.exp, "exp({})", np.exp),
    "sin": (F.sin, "sin({})", np.sin),
    "cos": (F.cos, "cos({})", np.cos),
    "floor": (lambda c: F.floor(c).cast("double"), "floor({})", np.floor),
}


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    a: Expr

    def children(self):
        return (self.a,)

    def column(self) -> Column:
        return _UNARY[self.op][0](self.a.column())

    def sql(self) -> str:
        return _UNARY[self.op][1].format(self.a.sql())

    def evaluate(self, env):
        with np.errstate(invalid="ignore"):
            return _UNARY[self.op][2](self.a.evaluate(env))

    def substitute(self, env):
        return Unary(self.op, self.a.substitute(env))


_COMPARE: dict[str, Callable] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
}


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    a: Expr
    b: Expr

    def children(self):
        return (self.a, self.b)

    def column(self) -> Column:
        return _COMPARE[self.op](self.a.column(), self.b.column())

    def sql(self) -> str:
        return f"({self.a.sql()} {self.op} {self.b.sql()})"

    def evaluate(self, env):
        return _COMPARE[self.op](self.a.evaluate(env), self.b.evaluate(env))

    def substitute(self, env):
        return Compare(self.op, self.a.substitute(env), self.b.substitute(env))


@dataclass(frozen=True)
class Logic(Expr):
    op: str
    a: Expr
    b: Expr

    def children(self):
        return (self.a, self.b)

    def column(self) -> Column:
        return self.a.column() & self.b.column() if self.op == "AND" else self.a.column() | self.b.column()

    def sql(self) -> str:
        return f"({self.a.sql()} {self.op} {self.b.sql()})"

    def evaluate(self, env):
        return (np.logical_and if self.op == "AND" else np.logical_or)(self.a.evaluate(env), self.b.evaluate(env))

    def substitute(self, env):
        return Logic(self.op, self.a.substitute(env), self.b.substitute(env))


@dataclass(frozen=True)
class Where(Expr):
    """``a`` where the condition holds, else ``b``."""

    test: Expr
    a: Expr
    b: Expr

    def children(self):
        return (self.test, self.a, self.b)

    def column(self) -> Column:
        return F.when(self.test.column(), self.a.column()).otherwise(self.b.column())

    def sql(self) -> str:
        return f"(CASE WHEN {self.test.sql()} THEN {self.a.sql()} ELSE {self.b.sql()} END)"

    def evaluate(self, env):
        return np.where(self.test.evaluate(env), self.a.evaluate(env), self.b.evaluate(env))

    def substitute(self, env):
        return Where(self.test.substitute(env), self.a.substitute(env), self.b.substitute(env))


def const(x: Number) -> Expr:
    return Const(float(x))


def var(name: str) -> Expr:
    return Var(name)


def sqrt(x: Like) -> Expr:
    return Unary("sqrt", wrap(x))


def abs_(x: Like) -> Expr:
    return Unary("abs", wrap(x))


def sign(x: Like) -> Expr:
    return Unary("sign", wrap(x))


def floor(x: Like) -> Expr:
    return Unary("floor", wrap(x))


def exp(x: Like) -> Expr:
    return Unary("exp", wrap(x))


def maximum(a: Like, b: Like) -> Expr:
    return Binary("max", wrap(a), wrap(b))


def minimum(a: Like, b: Like) -> Expr:
    return Binary("min", wrap(a), wrap(b))


def where(test: Expr, a: Like, b: Like) -> Expr:
    return Where(test, wrap(a), wrap(b))


def safe_div(a: Like, b: Like, otherwise: Number = 0.0) -> Expr:
    """a / b, and ``otherwise`` where b is zero."""
    a, b = wrap(a), wrap(b)
    return Where(Compare("=", b, Const(0.0)), Const(float(otherwise)), Binary("/", a, Where(Compare("=", b, Const(0.0)), Const(1.0), b)))


def smooth_floor(x: Like, eps: Number) -> Expr:
    """max(x, eps) without a branch: ((x + eps) + |x - eps|) / 2."""
    x = wrap(x)
    return ((x + eps) + abs_(x - eps)) * 0.5


def total(terms: list[Expr]) -> Expr:
    """Sum from left to right."""
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _is(x: Expr, value: float) -> bool:
    return isinstance(x, Const) and x.value == value


def simplify(x: Expr) -> Expr:
    """Fold constants, and zeros and ones away."""
    if isinstance(x, Binary):
        a, b = simplify(x.a), simplify(x.b)
        if isinstance(a, Const) and isinstance(b, Const) and not (x.op == "/" and b.value == 0):
            return Const(float(Binary(x.op, a, b).evaluate({})))
        if x.op == "+":
            return b if _is(a, 0) else a if _is(b, 0) else Binary("+", a, b)
        if x.op == "-":
            return a if _is(b, 0) else simplify(Unary("neg", b)) if _is(a, 0) else Binary("-", a, b)
        if x.op == "*":
            if _is(a, 0) or _is(b, 0):
                return Const(0.0)
            return b if _is(a, 1) else a if _is(b, 1) else Binary("*", a, b)
        if x.op == "/":
            return Const(0.0) if _is(a, 0) else a if _is(b, 1) else Binary("/", a, b)
        if x.op == "^":
            return Const(1.0) if _is(b, 0) else a if _is(b, 1) else Binary("^", a, b)
        return Binary(x.op, a, b)
    if isinstance(x, Unary):
        a = simplify(x.a)
        if isinstance(a, Const) and not (x.op == "sqrt" and a.value < 0):
            return Const(float(Unary(x.op, a).evaluate({})))
        if x.op == "neg" and isinstance(a, Unary) and a.op == "neg":
            return a.a
        return Unary(x.op, a)
    if isinstance(x, Where):
        return Where(x.test, simplify(x.a), simplify(x.b))
    return x


def diff(x: Expr, name: str, definitions: Mapping[str, Expr] | None = None) -> Expr:
    """Derivative by a variable; ``definitions`` say what other variables stand for."""
    known = definitions or {}

    def d(e: Expr) -> Expr:
        if isinstance(e, Const):
            return Const(0.0)
        if isinstance(e, Var):
            return Const(1.0) if e.name == name else d(known[e.name]) if e.name in known else Const(0.0)
        if isinstance(e, Binary):
            a, b = e.a, e.b
            if e.op in "+-":
                return Binary(e.op, d(a), d(b))
            if e.op == "*":
                return d(a) * b + a * d(b)
            if e.op == "/":
                return (d(a) * b - a * d(b)) / (b * b)
            if e.op == "^":
                if not isinstance(b, Const):
                    raise ValueError("only constant powers have a derivative here")
                return b * Binary("^", a, Const(b.value - 1)) * d(a)
            return Where(Compare(">=" if e.op == "max" else "<=", a, b), d(a), d(b))
        if isinstance(e, Unary):
            inner = d(e.a)
            if e.op == "neg":
                return -inner
            if e.op == "sqrt":
                return inner / (2.0 * e)
            if e.op == "abs":
                return Unary("sign", e.a) * inner
            if e.op == "exp":
                return e * inner
            if e.op == "sin":
                return Unary("cos", e.a) * inner
            if e.op == "cos":
                return -(Unary("sin", e.a) * inner)
            return Const(0.0)
        if isinstance(e, Where):
            return Where(e.test, d(e.a), d(e.b))
        raise TypeError(f"no derivative of {type(e).__name__}")

    return simplify(d(x))


def jacobian(rows: list[Expr], names: list[str]) -> list[list[Expr]]:
    return [[diff(r, n) for n in names] for r in rows]


def count_nodes(x: Expr) -> int:
    return 1 + sum(count_nodes(c) for c in x.children())


def is_finite(value: float) -> bool:
    return math.isfinite(value)

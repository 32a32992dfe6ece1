"""Models as equations, and as registries of typed operators.

``Module`` holds spaces, parameters, auxiliary fields and named operators, each with a kind and
a signature; a program calls them by name. ``Model`` is the board: states, fluxes, sources
and field equations are written down, ``rate`` takes an equation apart, and ``finite_volume``
gives what runs: a model for the finite volumes and a ``library.Block``.

Parameters are nodes of their own: their value is read when a plan is built, so a model is
written once and run with other values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from fieldloom.functions.expr import Expr, abs_, maximum, minimum, total, var, wrap
from fieldloom.functions.expr import sqrt as root
from fieldloom.operators import problems
from fieldloom.plans.library import OPERATOR_KINDS, Block

# nodes


@dataclass
class Parameters:
    """Values by name, which may change between runs."""

    values: dict[str, float] = field(default_factory=dict)

    def set(self, **values: float) -> None:
        if unknown := set(values) - set(self.values):
            raise KeyError(f"unknown parameters {sorted(unknown)}")
        self.values.update({k: float(v) for k, v in values.items()})


class Param(Expr):
    """A parameter in an expression; its name is its key, its value that of now."""

    def __init__(self, name: str, of: Parameters):
        self.name, self.of = name, of

    @property
    def now(self) -> float:
        return self.of.values[self.name]

    @property
    def value(self) -> float:  # what tells two plans apart
        return self.now

    def children(self) -> tuple:
        return ()

    def key(self) -> str:
        return f"param {self.name}"

    def column(self):
        return wrap(self.now).column()

    def sql(self) -> str:
        return wrap(self.now).sql()

    def evaluate(self, env):
        return self.now

    def __repr__(self) -> str:
        return f"Param({self.name!r})"


@dataclass(frozen=True)
class StateRef(Expr):
    """An expression over the left or right state of a face."""

    side: str
    a: Expr

    def __post_init__(self):
        if self.side not in ("l", "r"):
            raise ValueError("a side is l or r")

    def children(self) -> tuple:
        return (self.a,)

    def column(self):
        raise ValueError("a side stands in a flux between two states only")

    sql = column

    def evaluate(self, env):
        raise ValueError("a side stands in a flux between two states only")


def left(e: Expr | str) -> StateRef:
    return StateRef("l", var(e) if isinstance(e, str) else e)


def right(e: Expr | str) -> StateRef:
    return StateRef("r", var(e) if isinstance(e, str) else e)


def rewritten(e: Expr, put: Callable[[Expr], Expr | None]) -> Expr:
    """The tree with nodes put in place of others, from the top; None leaves a node."""
    if (new := put(e)) is not None:
        return new
    kids = {k: v for k, v in vars(e).items() if isinstance(v, Expr)}
    return replace(e, **{k: rewritten(v, put) for k, v in kids.items()}) if kids else e


def between(e: Expr, ul: dict[str, Expr], ur: dict[str, Expr]) -> Expr:
    """Sides resolved to the columns of both states."""

    def put(x: Expr) -> Expr | None:
        if isinstance(x, StateRef):
            known = ul if x.side == "l" else ur
            return rewritten(x.a, lambda y: known.get(y.name) if type(y).__name__ == "Var" else None)
        return None

    return rewritten(e, put)


# equations


@dataclass(frozen=True, eq=False)
class Node:
    """A part of an equation; sums and multiples of nodes are ``Sum``."""

    def __add__(self, other: Node) -> Sum:
        return Sum(((1.0, self),)) + other

    def __sub__(self, other: Node) -> Sum:
        return Sum(((1.0, self),)) - other

    def __neg__(self) -> Sum:
        return Sum(((-1.0, self),))

    def __mul__(self, k: float) -> Sum:
        return Sum(((float(k), self),))

    __rmul__ = __mul__

    def __eq__(self, other: Any):  # an equation, as in ddt(U) == -div(F) + S
        return Equation(self, other)

    __hash__ = object.__hash__


@dataclass(frozen=True, eq=False)
class Sum(Node):
    terms: tuple[tuple[float, Any], ...] = ()

    def __add__(self, other: Any) -> Sum:
        return Sum((*self.terms, *_terms(other)))

    def __sub__(self, other: Any) -> Sum:
        return Sum((*self.terms, *((-k, x) for k, x in _terms(other))))

    def __neg__(self) -> Sum:
        return Sum(tuple((-k, x) for k, x in self.terms))

    def __mul__(self, k: float) -> Sum:
        return Sum(tuple((float(k) * c, x) for c, x in self.terms))

    __rmul__ = __mul__


def _terms(x: Any) -> tuple[tuple[float, Any], ...]:
    return x.terms if isinstance(x, Sum) else ((1.0, x),)


@dataclass(frozen=True, eq=False)
class Equation:
    left: Any
    right: Any


@dataclass(frozen=True, eq=False)
class StateSpace(Node):
    name: str = "U"
    components: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> Expr:
        if name not in self.components:
            raise KeyError(f"{self.name} has no component {name!r}")
        return var(name)


@dataclass(frozen=True, eq=False)
class FieldSpace(Node):
    name: str = "phi"


@dataclass(frozen=True, eq=False)
class Flux(Node):
    name: str = "F"
    on: StateSpace | None = None
    x: tuple[Expr, ...] = ()
    y: tuple[Expr, ...] = ()
    waves: tuple | None = None  # (lo, hi) of each axis


@dataclass(frozen=True, eq=False)
class SourceTerm(Node):
    name: str = "S"
    on: StateSpace | None = None
    value: tuple[Expr, ...] = ()


@dataclass(frozen=True, eq=False)
class Gradient(Node):
    of: FieldSpace | None = None
    scale: Any = 1.0

    @property
    def x(self) -> Expr:
        return var(f"grad_x{_suffix(self.of)}")

    @property
    def y(self) -> Expr:
        return var(f"grad_y{_suffix(self.of)}")


def _suffix(f: FieldSpace | None) -> str:
    return "" if f is None or f.name == "phi" else f"_{f.name}"


@dataclass(frozen=True, eq=False)
class Divergence(Node):
    of: Any = None


@dataclass(frozen=True, eq=False)
class LaplacianNode(Node):
    of: FieldSpace | None = None


@dataclass(frozen=True, eq=False)
class Ddt(Node):
    of: StateSpace | None = None


@dataclass(frozen=True)
class Unknown:
    name: str


@dataclass(frozen=True)
class Integral:
    expr: Expr


def grad(f: FieldSpace, coefficient: Any = 1.0) -> Gradient:
    """``grad(phi).x`` and ``.y`` are expressions; ``coefficient``: a number, or a pair of columns."""
    return Gradient(f, coefficient)


def dx(f: FieldSpace) -> Expr:
    return grad(f).x


def dy(f: FieldSpace) -> Expr:
    return grad(f).y


def laplacian(f: FieldSpace) -> LaplacianNode:
    return LaplacianNode(f)


def div(x: Any) -> Node:
    """Of a gradient the elliptic operator, of a flux its divergence."""
    return LaplacianNode(x.of) if isinstance(x, Gradient) and x.scale == 1.0 else Divergence(x)


def ddt(u: StateSpace) -> Ddt:
    return Ddt(u)


rate = ddt


def unknown(name: str) -> Unknown:
    return Unknown(name)


def integral(e: Expr) -> Integral:
    return Integral(e)


# modules


@dataclass(frozen=True)
class Signature:
    inputs: tuple[str, ...] = ()
    output: str = ""

    def __str__(self) -> str:
        return f"({', '.join(self.inputs)}) -> {self.output}"


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    signature: Signature = Signature()
    body: Callable | None = None
    requires: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()


@dataclass
class Module:
    """Spaces, parameters and operators by name."""

    name: str
    states: dict[str, StateSpace] = field(default_factory=dict)
    fields: dict[str, FieldSpace] = field(default_factory=dict)
    parameters: Parameters = field(default_factory=Parameters)
    aux: dict[str, str] = field(default_factory=dict)
    operators: dict[str, Operator] = field(default_factory=dict)

    def state_space(self, name: str = "U", components: tuple[str, ...] = (), roles: tuple[str, ...] | None = None) -> StateSpace:
        if len(set(components)) != len(components) or not components:
            raise ValueError("a state needs distinct components")
        return self._new(self.states, name, StateSpace(name, tuple(components), tuple(roles or ("Custom",) * len(components))))

    def field_space(self, name: str = "phi") -> FieldSpace:
        return self._new(self.fields, name, FieldSpace(name))

    def param(self, name: str, default: float = 0.0) -> Param:
        self._new(self.parameters.values, name, float(default))
        return Param(name, self.parameters)

    def aux_field(self, name: str, kind: str = "cell_scalar") -> Expr:
        self._new(self.aux, name, kind)
        return var(name)

    @staticmethod
    def _new(known: dict, name: str, value: Any) -> Any:
        if name in known:
            raise ValueError(f"{name!r} is taken")
        known[name] = value
        return value

    def operator(self, name: str | None = None, kind: str = "local_source", inputs: tuple[str, ...] = ("U",), output: str = "U", requires: tuple[str, ...] = (), capabilities: tuple[str, ...] = ()):
        """Registers a function as an operator; also a decorator."""
        if kind not in OPERATOR_KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {OPERATOR_KINDS}")
        spaces = {*self.states, *self.fields, "fields", "scalar"}
        if unknown_ := [s for s in (*inputs, output) if s not in spaces]:
            raise KeyError(f"no spaces {unknown_}")

        def keep(body: Callable) -> Callable:
            own = name or body.__name__
            self._new(self.operators, own, Operator(own, kind, Signature(tuple(inputs), output), body, tuple(requires), tuple(capabilities)))
            return body

        return keep

    def rate_operator(self, name: str, state: str = "U") -> None:
        """The finite-volume rate under a name."""
        self._new(self.operators, name, Operator(name, "grid_operator", Signature((state, "fields"), state)))

    def field_operator(self, name: str, states: tuple[str, ...] = ("U",)) -> None:
        self._new(self.operators, name, Operator(name, "field_operator", Signature(tuple(states), "fields")))

    def program(self):
        """A step program that can call the operators by name."""
        from fieldloom.plans.program import Program

        return Program(operators={o.name: o.kind for o in self.operators.values()})

    # what there is

    def list_operators(self) -> list[str]:
        return sorted(self.operators)

    def signature_of(self, name: str) -> str:
        return str(self.operators[name].signature)

    def requirements_of(self, name: str) -> tuple[str, ...]:
        return self.operators[name].requires

    def capabilities_of(self, name: str) -> tuple[str, ...]:
        return self.operators[name].capabilities

    def hash(self) -> str:
        """Of the declarations; not of parameters' values."""
        text = repr([sorted((n, s.components, s.roles) for n, s in self.states.items()), sorted(self.fields), sorted(self.parameters.values), sorted(self.aux.items()), sorted((o.name, o.kind, str(o.signature)) for o in self.operators.values())])
        return hashlib.sha256(text.encode()).hexdigest()[:16]


# the board


@dataclass
class FluxModel:
    """The transport that the finite volumes take, from a board's flux."""

    names: list[str]
    roles: list[str]
    x: tuple[Expr, ...]
    y: tuple[Expr, ...]
    waves: tuple | None
    definitions: dict[str, Expr]

    def _put(self, e: Expr, u: list[Expr], aux: dict[str, Expr]) -> Expr:
        known = {**dict(zip(self.names, u)), **aux}

        def put(x: Expr) -> Expr | None:
            if type(x).__name__ != "Var":
                return None
            if x.name in known:
                return known[x.name]
            return rewritten(self.definitions[x.name], put) if x.name in self.definitions else None

        return rewritten(e, put)

    def flux(self, u, aux, direction):
        return [self._put(e, u, aux) for e in (self.y if direction else self.x)]

    def speeds(self, u, aux, direction):
        if self.waves is None:
            raise ValueError("the flux has no wave speeds; give waves=((lo, hi), (lo, hi))")
        lo, hi = self.waves[direction]
        return self._put(wrap(lo), u, aux), self._put(wrap(hi), u, aux)

    def max_speed(self, u, aux, direction):
        lo, hi = self.speeds(u, aux, direction)
        return maximum(abs_(lo), abs_(hi))


class Model:
    """The board of one model; what it declares is in ``module``."""

    def __init__(self, name: str):
        self.module = Module(name)
        self.definitions: dict[str, Expr] = {}
        self.fluxes: dict[str, Flux] = {}
        self.sources: dict[str, SourceTerm] = {}
        self.linear: dict[str, tuple[StateSpace, list[list[Any]]]] = {}
        self.field_problems: dict[str, problems.FieldProblem] = {}
        self.rates: dict[str, dict[str, Any]] = {}
        self.invariants: dict[str, Expr] = {}
        self.couplings: dict[str, Callable] = {}
        self.riemann: dict[str, Callable] = {}

    def state(self, name: str = "U", components: tuple[str, ...] = (), roles: tuple[str, ...] | None = None) -> StateSpace:
        return self.module.state_space(name, components, roles)

    species = state

    def primitive(self, name: str, expr: Expr) -> Expr:
        """A name for an expression, used like a component."""
        self.module._new(self.definitions, name, expr)
        return var(name)

    scalar = primitive

    def param(self, name: str, value: float = 0.0) -> Param:
        return self.module.param(name, value)

    def aux(self, name: str) -> Expr:
        return self.module.aux_field(name)

    def field(self, name: str = "phi") -> FieldSpace:
        return self.module.field_space(name)

    def flux(self, name: str, on: StateSpace, x: list[Expr], y: list[Expr], waves: tuple | None = None) -> Flux:
        if len(x) != len(on.components) or len(y) != len(on.components):
            raise ValueError(f"{name}: {on.name} has {len(on.components)} components")
        return self.module._new(self.fluxes, name, Flux(name, on, tuple(map(wrap, x)), tuple(map(wrap, y)), waves))

    def source(self, name: str, on: StateSpace, value: list[Expr]) -> SourceTerm:
        if len(value) != len(on.components):
            raise ValueError(f"{name}: {on.name} has {len(on.components)} components")
        self.module.operators[name] = Operator(name, "local_source", Signature((on.name, "fields"), on.name))
        return self.module._new(self.sources, name, SourceTerm(name, on, tuple(map(wrap, value))))

    def local_linear_operator(self, name: str, on: StateSpace, matrix: list[list[Any]]) -> str:
        if any(len(r) != len(on.components) for r in matrix) or len(matrix) != len(on.components):
            raise ValueError(f"{name}: the matrix isn't square over {on.name}")
        self.module.operators[name] = Operator(name, "local_linear_operator", Signature((on.name,), on.name))
        self.module._new(self.linear, name, (on, matrix))
        return name

    def solve_field(self, name: str, equation: Equation, bc: Any = "periodic") -> problems.FieldProblem:
        """``laplacian(phi) == f``, ``-kappa * phi`` and ``div(grad(phi, (eps_x, eps_y)))`` on the left."""
        terms: list[problems.Term] = []
        for k, x in _terms(equation.left):
            if isinstance(x, LaplacianNode):
                terms.append((k, problems.Laplacian()))
            elif isinstance(x, Divergence) and isinstance(x.of, Gradient):
                if not isinstance(x.of.scale, tuple):
                    raise ValueError("a varying coefficient is a pair of columns")
                terms.append((k, problems.Anisotropic(*x.of.scale)))
            elif isinstance(x, FieldSpace):
                terms.append((k, problems.Reaction(-k)))
            else:
                raise ValueError(f"{type(x).__name__} can't stand on the left of a field equation")
        main = [k for k, t in terms if not isinstance(t, problems.Reaction)]
        if len(main) != 1 or abs(main[0]) != 1.0:
            raise ValueError("a field equation has one second-order term, with a factor of 1 or -1")
        sign = main[0]
        rhs = self._expression(equation.right) * sign
        fixed = tuple(problems.Reaction(t.kappa * sign) if isinstance(t, problems.Reaction) else t for _, t in terms)
        if not isinstance(fixed[0], (problems.Laplacian, problems.Anisotropic)):
            fixed = fixed[::-1]
        self.module.operators[name] = Operator(name, "field_operator", Signature(tuple(self.module.states), "fields"))
        return self.module._new(self.field_problems, name, problems.FieldProblem(fixed, rhs, bc))

    field_problem = solve_field

    def _expression(self, e: Any) -> Expr:
        def put(x: Expr) -> Expr | None:
            return rewritten(self.definitions[x.name], put) if type(x).__name__ == "Var" and x.name in self.definitions else None

        return rewritten(wrap(e), put)

    def rate(self, name: str, equation: Equation) -> dict[str, Any]:
        """``ddt(U) == -div(F) + S1 + S2``: what is transported, and by which names sources are added."""
        if not isinstance(equation.left, Ddt):
            raise ValueError("a rate equation starts with ddt(state)")
        on, flux, sources = equation.left.of, None, []
        for k, x in _terms(equation.right):
            if isinstance(x, Divergence) and isinstance(x.of, Flux) and k == -1.0 and flux is None:
                flux = x.of
            elif isinstance(x, SourceTerm) and k == 1.0:
                sources.append(x.name)
            else:
                raise ValueError("the right-hand side is -div(flux) and sources, each once, with a factor of one")
            if (x.of if isinstance(x, Divergence) else x).on is not on:
                raise ValueError(f"a term isn't one of {on.name}")
        self.module.operators[name] = Operator(name, "grid_operator", Signature((on.name, "fields"), on.name))
        return self.module._new(self.rates, name, {"state": on, "flux": flux, "sources": tuple(sources)})

    def coupled_rate(self, name: str, on: dict[str, StateSpace], values: dict[str, dict[str, Expr]], preserves: tuple[str, ...] = ()) -> str:
        """Rates of several species at once; components are written ``{block}.{component}``.

        ``preserves``: components whose rates over all species must sum to nothing, which is checked.
        """
        from fieldloom.functions.expr import const

        for c in preserves:
            summed = total([self._expression(r[c]) for r in values.values() if c in r] or [const(0.0)])
            for seed in (0.3, 1.7, 2.9):
                env = {n: seed + 0.37 * k for k, n in enumerate(sorted(summed.deps()))}
                if abs(float(summed.evaluate(env))) > 1e-10:
                    raise ValueError(f"{name} doesn't preserve {c}")

        def run(states: dict[str, dict[str, Expr]]) -> dict[str, dict[str, Expr]]:
            known = {f"{b}.{c}": e for b, cs in states.items() for c, e in cs.items()}
            put = lambda x: known.get(x.name) if type(x).__name__ == "Var" else None
            return {b: {c: rewritten(self._expression(e), put) for c, e in r.items()} for b, r in values.items()}

        self.module.operators[name] = Operator(name, "coupled_rate", Signature(tuple(s.name for s in on.values()), "fields"))
        self.module._new(self.couplings, name, run)
        return name

    def riemann_flux(self, name: str, value: list[Expr] | Callable) -> Callable:
        """A flux between two states: expressions of ``left(...)`` and ``right(...)``, the same on both axes, or one per axis."""
        from fieldloom.functions.physics import register_riemann

        def run(model, ul, al, ur, ar, direction):
            if callable(value):
                return value(model, ul, al, ur, ar, direction)
            chosen = value[direction] if value and isinstance(value[0], (list, tuple)) else value
            a, b = {**dict(zip(model.names, ul)), **al}, {**dict(zip(model.names, ur)), **ar}
            return [between(self._expression(e), a, b) for e in chosen]

        register_riemann(name, run)
        self.riemann[name] = run
        return run

    def invariant(self, name: str, over: Integral) -> None:
        """A quantity that a run should keep."""
        self.module._new(self.invariants, name, self._expression(over.expr))

    def finite_volume(self, rate: str, reconstruction: str = "none", riemann: str = "rusanov", bc: Any = "periodic", elliptic: Callable | None = None) -> Block:
        """The block that runs a rate."""
        r = self.rates[rate]
        on, flux = r["state"], r["flux"]
        if flux is None:
            raise ValueError(f"{rate} transports nothing")
        model = FluxModel(list(on.components), list(on.roles), flux.x, flux.y, flux.waves, self.definitions)
        read = {v for e in (*flux.x, *flux.y, *(wrap(w) for pair in flux.waves or () for w in pair)) for v in self._expression(e).deps()}
        read |= {v for s in self.sources.values() if s.on is on for e in s.value for v in self._expression(e).deps()}
        aux = tuple(sorted(v for v in read if v not in on.components))
        known = {*self.module.aux, *(f"{g}{_suffix(f)}" for f in self.module.fields.values() for g in ("grad_x", "grad_y")), *self.module.fields}
        if lost := [a for a in aux if a not in known]:
            raise KeyError(f"unknown names {lost}")
        sources = {s.name: (lambda u, a, s=s: [model._put(e, u, a) for e in s.value]) for s in self.sources.values() if s.on is on}
        linear = {n: (lambda a, m=m: m) for n, (space, m) in self.linear.items() if space is on}
        return Block(model, bc, {"limiter": reconstruction, "riemann": riemann}, sources, linear, None, aux, elliptic)

    def check(self) -> list[str]:
        """What is wrong with the declarations."""
        out = []
        for n, r in self.rates.items():
            if r["flux"] is not None and r["flux"].waves is None:
                out.append(f"{n}: the flux has no wave speeds")
            try:
                if r["flux"] is not None:
                    self.finite_volume(n)
            except KeyError as e:
                out.append(f"{n}: {e.args[0]}")
        return out

    def inspect(self) -> str:
        m = self.module
        lines = [f"model {m.name}", *(f"state {s.name}: {', '.join(s.components)}" for s in m.states.values()), *(f"param {k} = {v}" for k, v in m.parameters.values.items())]
        lines += [f"flux {f.name} of {f.on.name}" for f in self.fluxes.values()] + [f"source {s.name} of {s.on.name}" for s in self.sources.values()]
        lines += [f"field {n}: {p.inspect()}" for n, p in self.field_problems.items()] + [f"rate {n}: {r['state'].name}" for n, r in self.rates.items()]
        return "\n".join(lines)


def hll_bounds(a: Expr, b: Expr) -> tuple[Expr, Expr]:
    """The lower and the higher of two speeds."""
    return minimum(a, b), maximum(a, b)


def sound(gamma: Expr | float, p: Expr, rho: Expr) -> Expr:
    return root(wrap(gamma) * p / rho)

"""Typed step programs: a list of single-assignment values, checked, reduced, and run.

``Program`` records operations; three passes drop dead values, merge equal pure ones, and
drop field solves that nothing has made stale; ``Machine`` runs the rest, scalars as Python
numbers. ``library.Library`` gives every operation its meaning over field plans. What
Catalyst does within one plan isn't done again: the passes work on whole plans and
driver actions.

Bodies of loops, branches and matrix-free operators are programs of their own, made by
``inside()``; they may read any value made before them outside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from typing import Any

#: Operation: type of its value.
TYPES = {
    "state": "state", "solve_fields": "fields", "solve_fields_from_blocks": "fields", "rhs": "rhs", "source": "rhs", "apply": "rhs",
    "linear_combine": "state", "project": "state", "fill_boundary": "state", "where": "state",
    "cell_compare": "mask", "history": "state", "store_history": "none", "reduce": "scalar",
    "scalar_op": "scalar", "compare": "bool", "hmin": "scalar", "max_wave_speed": "scalar", "cfl": "scalar",
    "record_scalar": "none", "scalar_field": "field", "laplacian": "field", "gradient": "vector", "divergence": "field",
    "component": "field", "matrix_free_operator": "operator", "apply_in": "field", "apply_out": "field", "apply_laplacian_coeff": "field",
    "rhs_jacvec": "field", "solve_linear": "field", "solve_local_linear": "state", "solve_local_nonlinear": "state",
    "schur_coeffs": "coefficients", "schur_explicit_flux": "vector", "schur_rhs": "field", "schur_reconstruct": "state", "schur_energy": "state",
    "coupled_rate": "rates", "coupled_rate_out": "rhs", "commit": "none", "while": "none", "if": "none", "range": "none", "scheduled": "any",
}
PURE = {"linear_combine", "cell_compare", "where", "scalar_op", "compare", "laplacian", "gradient", "divergence", "component", "schur_coeffs", "schur_explicit_flux", "schur_rhs", "scalar_field"}
REMOVABLE = PURE | {
    "rhs", "source", "apply", "reduce", "history", "hmin", "max_wave_speed", "cfl", "solve_linear", "solve_local_linear", "solve_local_nonlinear", "coupled_rate",
    "coupled_rate_out", "matrix_free_operator", "apply_laplacian_coeff", "rhs_jacvec", "schur_reconstruct", "schur_energy", "fill_boundary",
}
#: What makes solved fields stale.
BARRIERS = {"project", "fill_boundary", "store_history", "commit", "while", "if", "range", "scheduled"}
#: What a linear combination, a solver or a reduction takes.
FIELDS = ("state", "rhs", "field")
REDUCTIONS = ("norm2", "norm_inf", "sum", "max", "min", "dot")


@dataclass(frozen=True)
class Value:
    id: int
    op: str
    args: tuple
    options: tuple = ()

    @property
    def kind(self) -> str:
        if self.op == "scheduled":
            return dict(self.options)["kind"]
        return TYPES[self.op]

    def bodies(self) -> list[Program]:
        return [x for _, x in self.options if isinstance(x, Program)]

    def inputs(self) -> list[Value]:
        """What it reads, also inside its bodies."""
        out: list[Value] = []
        for a in self.args:
            if isinstance(a, Value):
                out.append(a)
            elif isinstance(a, tuple):
                out += [v for pair in a if isinstance(pair, tuple) for v in pair if isinstance(v, Value)]
        for body in self.bodies():
            own = {v.id for v in body.values}
            out += [a for v in body.values for a in v.inputs() if a.id not in own]
        return out

    def key(self) -> str:
        options = ", ".join(f"{k}={_text(x)}" for k, x in self.options)
        return f"{self.op}({', '.join(_text(a) for a in self.args)}; {options})"


def _text(a: Any) -> str:
    if isinstance(a, Value):
        return f"%{a.id}"
    if isinstance(a, tuple):
        return "[" + ", ".join(_text(x) for x in a) + "]"
    if isinstance(a, Program):
        return "{" + a.dump() + "}"
    if callable(a):
        return getattr(a, "__qualname__", type(a).__name__)
    return repr(a)


@dataclass
class Program:
    """Records operations in order."""

    values: list[Value] = field(default_factory=list)
    ids: Any = field(default_factory=count, repr=False)
    operators: dict[str, str] = field(default_factory=dict, repr=False)

    def inside(self) -> Program:
        """A body, whose values may read those made so far."""
        return Program(ids=self.ids, operators=self.operators)

    def add(self, operation: str, /, *args: Any, **options: Any) -> Value:
        if operation not in TYPES:
            raise ValueError(f"unknown operation {operation!r}")
        v = Value(next(self.ids), operation, args, tuple(sorted(options.items(), key=lambda kv: kv[0])))
        self.values.append(v)
        return v

    # blocks, fields and rates

    def state(self, block: str) -> Value:
        return self.add("state", block)

    def solve_fields(self, *states: Value) -> Value:
        return self.add("solve_fields", *self._typed(states, "state"))

    def solve_fields_from_blocks(self, states: dict[str, Value]) -> Value:
        """The fields of all blocks; these stand in for the named ones' states."""
        self._typed(tuple(states.values()), "state")
        return self.add("solve_fields_from_blocks", tuple(sorted(states.items())))

    def rhs(self, state: Value, flux: bool = True, sources: tuple[str, ...] = (), fields: Value | None = None) -> Value:
        """-div F if ``flux``, and the named sources; nothing else is added."""
        more = self._typed((fields,), "fields") if fields else ()
        return self.add("rhs", *self._typed((state,), "state"), *more, flux=flux, sources=tuple(sources))

    def source(self, name: str, state: Value, fields: Value | None = None) -> Value:
        more = self._typed((fields,), "fields") if fields else ()
        return self.add("source", name, *self._typed((state,), "state"), *more)

    def apply(self, name: str, state: Value) -> Value:
        """L U of a named per-cell linear operator."""
        return self.add("apply", name, *self._typed((state,), *FIELDS))

    def coupled_rate(self, name: str, states: dict[str, Value]) -> Value:
        self._typed(tuple(states.values()), "state")
        return self.add("coupled_rate", name, tuple(sorted(states.items())))

    def coupled_rate_out(self, rates: Value, block: str) -> Value:
        return self.add("coupled_rate_out", *self._typed((rates,), "rates"), block)

    def call(self, operator: str, *args: Any) -> Value:
        """A registered operator by name, as the operation that its kind stands for."""
        if operator not in self.operators:
            raise KeyError(f"no operator {operator!r}; known: {sorted(self.operators)}")
        kind = self.operators[operator]
        if kind == "field_operator":
            return self.solve_fields(*args)
        if kind == "grid_operator":
            return self.rhs(args[0], True, (), *args[1:])
        if kind == "local_source":
            return self.source(operator, *args)
        if kind == "local_linear_operator":
            return self.apply(operator, *args)
        if kind == "projection":
            return self.project(*args)
        if kind == "coupled_rate":
            return self.coupled_rate(operator, *args)
        raise TypeError(f"{operator!r} is a {kind}, which a program can't call")

    # cells

    def linear_combine(self, terms: list[tuple[Any, Value]]) -> Value:
        """Sum of coefficient times value; coefficients are numbers or scalars."""
        for c, v in terms:
            if v.kind not in FIELDS:
                raise TypeError(f"can't combine a {v.kind}")
            if isinstance(c, Value) and c.kind != "scalar":
                raise TypeError(f"a coefficient can't be a {c.kind}")
        return self.add("linear_combine", tuple(terms))

    def project(self, state: Value) -> Value:
        return self.add("project", *self._typed((state,), "state"))

    def fill_boundary(self, state: Value) -> Value:
        """A mark only: a plan reads its ghosts when it needs them."""
        return self.add("fill_boundary", *self._typed((state,), "state"))

    def cell_compare(self, state: Value, op: str, value: float) -> Value:
        return self.add("cell_compare", *self._typed((state,), *FIELDS), op=op, value=value)

    def where(self, mask: Value, a: Value, b: Value) -> Value:
        self._typed((mask,), "mask")
        return self.add("where", mask, *self._typed((a, b), *FIELDS))

    def solve_local_linear(self, name: str, rhs: Value, a: float) -> Value:
        """U of (I - a L) U = rhs in each cell."""
        return self.add("solve_local_linear", name, *self._typed((rhs,), *FIELDS), a=a)

    def solve_local_nonlinear(self, residual: Callable, guess: Value, *others: Value, steps: int = 10, tolerance: float = 1e-10) -> Value:
        """U of residual(U, others...) = 0 in each cell, by Newton's method from the guess."""
        return self.add("solve_local_nonlinear", *self._typed((guess, *others), *FIELDS), residual=residual, steps=steps, tolerance=tolerance)

    # stencils, operators, solves

    def scalar_field(self, value: float = 0.0) -> Value:
        return self.add("scalar_field", value)

    def component(self, state: Value, name: str) -> Value:
        """One column of a state, fields or vector, as a field."""
        return self.add("component", *self._typed((state,), "state", "rhs", "fields", "vector"), name)

    def laplacian(self, x: Value) -> Value:
        return self.add("laplacian", *self._typed((x,), *FIELDS))

    def gradient(self, x: Value) -> Value:
        return self.add("gradient", *self._typed((x,), *FIELDS))

    def divergence(self, x: Value) -> Value:
        return self.add("divergence", *self._typed((x,), "vector"))

    def matrix_free_operator(self, body: Program) -> Value:
        """What ``body`` makes of its ``apply_in()``, given by its ``apply_out(...)``."""
        ops = [v.op for v in body.values]
        if ops.count("apply_in") != 1 or ops.count("apply_out") != 1:
            raise ValueError("the body needs one apply_in and one apply_out")
        return self.add("matrix_free_operator", body=body)

    def apply_in(self) -> Value:
        return self.add("apply_in")

    def apply_out(self, x: Value) -> Value:
        return self.add("apply_out", *self._typed((x,), *FIELDS))

    def apply_laplacian_coeff(self, x: Value, coefficients: Value) -> Value:
        """div(A grad x) with the tensor of ``schur_coeffs``."""
        return self.add("apply_laplacian_coeff", *self._typed((x,), *FIELDS), *self._typed((coefficients,), "coefficients"))

    def rhs_jacvec(self, state: Value, direction: Value, eps: float = 1e-6, fields: Value | None = None) -> Value:
        """J v of the flux's rate at a state, by a difference; only inside an operator's body."""
        if not any(v.op == "apply_in" for v in self.values):
            raise ValueError("rhs_jacvec stands in the body of a matrix-free operator, after its apply_in")
        more = self._typed((fields,), "fields") if fields else ()
        return self.add("rhs_jacvec", *self._typed((state,), *FIELDS), *self._typed((direction,), *FIELDS), *more, eps=eps)

    def solve_linear(self, operator: Value, rhs: Value, method: str = "cg", tolerance: float = 1e-8, max_iter: int = 200, **more: Any) -> Value:
        return self.add("solve_linear", *self._typed((operator,), "operator"), *self._typed((rhs,), *FIELDS), method=method, tolerance=tolerance, max_iter=max_iter, **more)

    def schur_coeffs(self, state: Value, c: float, th_dt: float) -> Value:
        """The tensor I + c rho B^-1, with w = th_dt B_z."""
        return self.add("schur_coeffs", *self._typed((state,), "state"), c=c, th_dt=th_dt)

    def schur_explicit_flux(self, state: Value, th_dt: float) -> Value:
        """B^-1 (mx, my)."""
        return self.add("schur_explicit_flux", *self._typed((state,), "state"), th_dt=th_dt)

    def schur_rhs(self, phi: Value, state: Value, th_dt: float, g: float) -> Value:
        """-Laplacian(phi) - g div(B^-1 m)."""
        return self.add("schur_rhs", *self._typed((phi,), *FIELDS), *self._typed((state,), "state"), th_dt=th_dt, g=g)

    def schur_reconstruct(self, state: Value, phi: Value, th_dt: float) -> Value:
        """v = B^-1 (v - th_dt grad phi); the density stays."""
        return self.add("schur_reconstruct", *self._typed((state,), "state"), *self._typed((phi,), *FIELDS), th_dt=th_dt)

    def schur_energy(self, state: Value, old: Value) -> Value:
        """The old energy and the change of kinetic energy."""
        return self.add("schur_energy", *self._typed((state, old), "state"))

    # scalars, histories, control

    def reduce(self, state: Value, kind: str, other: Value | None = None) -> Value:
        if kind not in REDUCTIONS:
            raise ValueError(f"unknown reduction {kind!r}")
        more = self._typed((other,), *FIELDS) if other else ()
        return self.add("reduce", *self._typed((state,), *FIELDS), *more, kind=kind)

    def scalar_op(self, op: str, a: Value | float, b: Value | float) -> Value:
        return self.add("scalar_op", a, b, op=op)

    def compare(self, op: str, a: Value | float, b: Value | float) -> Value:
        return self.add("compare", a, b, op=op)

    def hmin(self) -> Value:
        return self.add("hmin")

    def max_wave_speed(self, state: Value, fields: Value | None = None) -> Value:
        more = self._typed((fields,), "fields") if fields else ()
        return self.add("max_wave_speed", *self._typed((state,), "state"), *more)

    def cfl(self, state: Value, number: float, fields: Value | None = None) -> Value:
        """number * hmin / the largest speed."""
        more = self._typed((fields,), "fields") if fields else ()
        return self.add("cfl", *self._typed((state,), "state"), *more, number=number)

    def history(self, name: str, lag: int) -> Value:
        return self.add("history", name, lag=lag)

    def store_history(self, name: str, state: Value) -> Value:
        return self.add("store_history", name, state)

    def record_scalar(self, name: str, value: Value) -> Value:
        return self.add("record_scalar", name, *self._typed((value,), "scalar"))

    def scheduled(self, name: str, schedule: Any, body: Program, zero: float | None = None) -> Value:
        """The last value of ``body`` when the schedule is due, else what its policy says."""
        if not body.values:
            raise ValueError("an empty body gives no value")
        return self.add("scheduled", name, schedule=schedule, body=body, kind=body.values[-1].kind, zero=zero)

    def if_(self, test: Value, then: Program, other: Program | None = None) -> Value:
        return self.add("if", *self._typed((test,), "bool"), then=then, other=other)

    def while_(self, test: Program, body: Program, max_iter: int) -> Value:
        """Runs until the test fails; an error if it still holds after ``max_iter`` rounds."""
        return self.add("while", test=test, body=body, max_iter=max_iter)

    def range(self, n: int, body: Program) -> Value:
        return self.add("range", n, body=body)

    def static_range(self, n: int, make: Callable[[Program, int], Any]) -> list[Any]:
        """``make`` n times while recording."""
        return [make(self, k) for k in range(n)]

    def commit(self, block: str, state: Value) -> Value:
        return self.add("commit", block, *self._typed((state,), "state", "rhs", "field"))

    def commit_many(self, states: dict[str, Value]) -> list[Value]:
        return [self.commit(b, v) for b, v in states.items()]

    @staticmethod
    def _typed(values: tuple, *kinds: str) -> tuple:
        for v in values:
            if v.kind not in kinds:
                raise TypeError(f"needs a {' or '.join(kinds)}, got a {v.kind} ({v.op})")
        return values

    def dump(self) -> str:
        return "\n".join(f"%{v.id} = {v.key()}" for v in self.values)

    def hash(self) -> str:
        return hashlib.sha256(renumbered(self).dump().encode()).hexdigest()[:16]

    def validate(self, seen: set[int] | None = None) -> None:
        seen = set(seen or ())
        for v in self.values:
            for a in v.inputs():
                if a.id not in seen:
                    raise ValueError(f"%{v.id} reads %{a.id} before it is made")
            for body in v.bodies():
                body.validate(seen)
            seen.add(v.id)


def renumbered(p: Program) -> Program:
    return _rebuilt(p.values, {}, p.operators)


def _rebuilt(values: list[Value], replaced: dict[int, Value], operators: dict[str, str] | None = None, ids: Any = None, new: dict[int, Value] | None = None) -> Program:
    """The values in order with new numbers; a replaced one's readers read its stand-in."""
    out = Program(ids=ids or count(), operators=operators or {})
    new = {} if new is None else dict(new)

    def of(a: Any) -> Any:
        if isinstance(a, Value):
            while a.id in replaced:
                a = replaced[a.id]
            return new[a.id]
        if isinstance(a, tuple):
            return tuple(of(x) for x in a)
        if isinstance(a, Program):
            return _rebuilt(a.values, replaced, operators, out.ids, new)
        return a

    for v in values:
        args, options = tuple(of(a) for a in v.args), tuple((k, of(x)) for k, x in v.options)
        made = Value(next(out.ids), v.op, args, options)
        out.values.append(made)
        new[v.id] = made
    return out


def drop_dead(p: Program) -> Program:
    """Values that no commit or other effect reads."""
    live: set[int] = set()
    for v in reversed(p.values):
        if v.op not in REMOVABLE or v.id in live:
            live.add(v.id)
            live |= {a.id for a in v.inputs()}
    return _rebuilt([v for v in p.values if v.id in live], {}, p.operators)


def merge_equal(p: Program) -> Program:
    """Pure values with the same operation and inputs are made once."""
    first: dict[str, Value] = {}
    replaced: dict[int, Value] = {}

    def real(v: Value) -> Value:
        while v.id in replaced:
            v = replaced[v.id]
        return v

    def shared(a: Any) -> Any:
        return real(a) if isinstance(a, Value) else tuple(shared(x) for x in a) if isinstance(a, tuple) else a

    for v in p.values:
        if v.op not in PURE:
            continue
        key = Value(0, v.op, shared(v.args), v.options).key()
        if key in first:
            replaced[v.id] = first[key]
        else:
            first[key] = v
    return _rebuilt([v for v in p.values if v.id not in replaced], replaced, p.operators)


def drop_repeated_solves(p: Program) -> Program:
    """A field solve of the same states with no barrier since the last one."""
    last: Value | None = None
    replaced: dict[int, Value] = {}
    for v in p.values:
        if v.op in BARRIERS:
            last = None
        elif v.op in ("solve_fields", "solve_fields_from_blocks"):
            if last is not None and last.op == v.op and last.args == v.args and [a.id for a in last.inputs()] == [a.id for a in v.inputs()]:
                replaced[v.id] = last
            else:
                last = v
    return _rebuilt([v for v in p.values if v.id not in replaced], replaced, p.operators)


def optimize(p: Program) -> Program:
    return drop_dead(drop_repeated_solves(merge_equal(p)))


Handler = Callable[..., Any]


@dataclass
class Machine:
    """Runs programs; ``handlers`` give the meaning of operations over the caller's states.

    A handler ``cut``, if there is one, is given each state that a loop's round or the step
    commits, and gives it back without its past.
    """

    handlers: dict[str, Handler]
    blocks: dict[str, Any]
    histories: dict[str, Any] = field(default_factory=dict)
    records: list[tuple[int, str, float]] = field(default_factory=list)
    step: int = 0
    t: float = 0.0
    depth: int = 4
    cache: Any = None

    def execute(self, p: Program, dt: float = 0.0, last: bool = False) -> dict[str, Any]:
        """One step; all commits take effect together, at its end."""
        p.validate()
        commits: dict[str, Any] = {}
        self._dt, self._last = dt, last
        self._run(p, commits, {})
        self._cut(commits)
        self.blocks.update(commits)
        self.step += 1
        self.t += dt
        return self.blocks

    def _cut(self, commits: dict[str, Any]) -> None:
        if "cut" in self.handlers:
            commits.update({b: self.handlers["cut"](x) for b, x in commits.items()})

    def _run(self, p: Program, commits: dict[str, Any], outer: dict[int, Any]) -> Any:
        from fieldloom.streaming.schedule import Cache, History

        env = dict(outer)

        def get(a: Any) -> Any:
            if isinstance(a, Value):
                return env[a.id]
            if isinstance(a, tuple) and a and isinstance(a[0], tuple):
                return [tuple(get(x) for x in pair) for pair in a]
            return a

        out = None
        for v in p.values:
            args, o = [get(a) for a in v.args], dict(v.options)
            if v.op == "state":
                out = commits.get(args[0], self.blocks[args[0]])
            elif v.op == "commit":
                commits[args[0]] = out = args[1]
            elif v.op == "history":
                out = self.histories[args[0]].lag(o["lag"])
            elif v.op == "store_history":
                kept = self.handlers["cut"](args[1]) if "cut" in self.handlers else args[1]
                self.histories.setdefault(args[0], History(self.depth)).store(kept)
            elif v.op == "record_scalar":
                self.records.append((self.step, args[0], args[1]))
            elif v.op == "scalar_op":
                a, b = args
                out = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b}[o["op"]]()
            elif v.op == "compare":
                a, b = args
                out = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[o["op"]]
            elif v.op == "if":
                branch = o["then"] if args[0] else o["other"]
                out = self._run(branch, commits, env) if branch else None
            elif v.op == "range":
                for _ in range(args[0]):
                    out = self._run(o["body"], commits, env)
                    self._cut(commits)
            elif v.op == "while":
                n = 0
                while self._run(o["test"], commits, env):
                    if n >= o["max_iter"]:
                        raise RuntimeError(f"the loop's test still holds after {n} rounds")
                    out = self._run(o["body"], commits, env)
                    self._cut(commits)
                    n += 1
            elif v.op == "scheduled":
                self.cache = self.cache or Cache()
                zero = self.handlers["scalar_field"](o["zero"]) if o["zero"] is not None and o["kind"] in FIELDS else o["zero"]
                out = self.cache.run(args[0], o["schedule"], self.step, self._dt, lambda dt, body=o["body"]: self._run(body, commits, env), zero, self.t, self._last)
            elif v.op == "matrix_free_operator":
                out = self._operator(o["body"], commits, env)
            elif v.op == "apply_in":
                out = env["in"]
            elif v.op == "apply_out":
                out = args[0]
            elif v.op == "fill_boundary":
                out = self.handlers["fill_boundary"](*args) if "fill_boundary" in self.handlers else args[0]
            elif v.op == "coupled_rate_out":
                out = args[0][args[1]]
            elif v.op in self.handlers:
                out = self.handlers[v.op](*args, **o)
            else:
                raise NotImplementedError(f"no handler for {v.op!r}")
            env[v.id] = out
        return out

    def _operator(self, body: Program, commits: dict[str, Any], env: dict) -> Callable[[Any], Any]:
        place = next(k for k, v in enumerate(body.values) if v.op == "apply_out")
        upto = Program(body.values[: place + 1], body.ids, body.operators)
        return lambda x: self._run(upto, commits, {**env, "in": x})


def report(p: Program) -> dict[str, Any]:
    """Operations by kind, field solves, and the most values alive at once."""
    last_use = {a.id: v.id for v in p.values for a in v.inputs()}
    alive = most = 0
    ends: dict[int, int] = {}
    for v in p.values:
        alive += 1
        most = max(most, alive)
        ends[last_use.get(v.id, v.id)] = ends.get(last_use.get(v.id, v.id), 0) + 1
        alive -= ends.pop(v.id, 0)
    counts: dict[str, int] = {}
    for v in p.values:
        counts[v.op] = counts.get(v.op, 0) + 1
    return {"operations": counts, "solves": counts.get("solve_fields", 0), "most_alive": most, "hash": p.hash()}

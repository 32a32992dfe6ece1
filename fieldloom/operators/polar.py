"""The tensor operator on a ring, and its preconditioned solve over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldloom.functions.expr import Expr, var, where
from fieldloom.operators import elliptic, lines
from fieldloom.operators.grid import PolarGeometry, index
from fieldloom.operators.stencil import CORNERS, CROSS
from fieldloom.plans.relation import Boundary, Given, Plan

#: Columns of the tensor: radial, azimuthal, and the two cross coefficients.
TENSOR = ("a_rr", "a_tt", "a_rt", "a_tr")


def tensor_operator(field: Plan, c: str, geometry: PolarGeometry, bc: Boundary = ("dirichlet", 0.0), cross: bool = True, out: str = "value") -> Plan:
    """div(A grad phi): faces take the mean coefficient of their two cells; ``bc``: the ends of the radius."""
    shape, ends, kept = (geometry.nr, geometry.nt), (bc, "periodic"), ("foextrap", "periodic")
    x = field.shift([c], {**CROSS, **(CORNERS if cross else {})}, shape, ends).shift(list(TENSOR[: 4 if cross else 2]), CROSS, shape, kept)
    r, lo, hi = geometry.r(), geometry.r_face(0), geometry.r_face(1)
    dr, dt = geometry.dr, geometry.dt

    def face(a: str, s: str) -> Expr:
        return (var(a) + var(f"{a}_{s}")) * 0.5

    def p(s: str) -> Expr:
        return var(f"{c}_{s}") if s else var(c)

    radial = (hi * face("a_rr", "xp") * (p("xp") - p("")) - lo * face("a_rr", "xm") * (p("") - p("xm"))) / (r * (dr * dr))
    around = (face("a_tt", "yp") * (p("yp") - p("")) - face("a_tt", "ym") * (p("") - p("ym"))) / (r * r * (dt * dt))
    value = radial + around
    if cross:
        up = (p("yp") + p("pp") - p("ym") - p("pm")) * (0.25 / dt)
        down = (p("mp") + p("yp") - p("mm") - p("ym")) * (0.25 / dt)
        value = value + (face("a_rt", "xp") * up - face("a_rt", "xm") * down) / (r * dr)
        right = (p("xp") + p("pp") - p("xm") - p("mp")) * (0.25 / dr)
        left = (p("pm") + p("xp") - p("mm") - p("xm")) * (0.25 / dr)
        value = value + (face("a_tr", "yp") * right - face("a_tr", "ym") * left) / (r * dt)
    return x.select(*field.columns, **{out: value})


def _weights(tensor: Plan, geometry: PolarGeometry, bc: Boundary) -> Plan:
    """``below, diagonal, above`` along the radius, with the ends' ghosts folded in."""
    shape = (geometry.nr, geometry.nt)
    x = tensor.shift(["a_rr", "a_tt"], CROSS, shape, ("foextrap", "periodic"))
    r, lo, hi = geometry.r(), geometry.r_face(0), geometry.r_face(1)
    down = lo * (var("a_rr") + var("a_rr_xm")) * 0.5 / (r * (geometry.dr**2))
    up = hi * (var("a_rr") + var("a_rr_xp")) * 0.5 / (r * (geometry.dr**2))
    around = ((var("a_tt") + var("a_tt_yp")) * 0.5 + (var("a_tt") + var("a_tt_ym")) * 0.5) / (r * r * (geometry.dt**2))
    sign = -1.0 if bc != "foextrap" else 1.0
    first, last = index("i") < 0.5, index("i") > geometry.nr - 1.5
    diagonal = -(down + up + around) + where(first, down * sign, 0.0) + where(last, up * sign, 0.0)
    return x.select("i", "j", below=where(first, 0.0, down), diagonal=diagonal, above=where(last, 0.0, up))


def preconditioner(kind: str, tensor: DataFrame, geometry: PolarGeometry, bc: Boundary = ("dirichlet", 0.0)) -> elliptic.Operator:
    """``jacobi``: by the diagonal; ``radial_line``: a tridiagonal solve along each radius."""
    spark = tensor.sparkSession
    weights = elliptic._cut(_weights(Given(tensor), geometry, bc).frame(spark, ""))

    def jacobi(df: DataFrame, c: str) -> DataFrame:
        x = df.join(weights.select("i", "j", "diagonal"), ["i", "j"])
        return x.select("i", "j", (-x[c] / x["diagonal"]).alias(c))

    def radial_line(df: DataFrame, c: str) -> DataFrame:
        x = df.select("i", "j", c).join(weights, ["i", "j"])
        x = x.select("i", "j", "below", "diagonal", "above", (-x[c]).alias("f"))
        return lines.tridiagonal(x, "j", "i", geometry.nr, "below", "diagonal", "above", "f", c).select("i", "j", c)

    kinds = {"jacobi": jacobi, "radial_line": radial_line}
    if kind not in kinds:
        raise ValueError(f"unknown preconditioner {kind!r}")
    return kinds[kind]


def tensor_krylov(tensor: DataFrame, rhs: DataFrame, c: str, geometry: PolarGeometry, bc: Boundary = ("dirichlet", 0.0), precondition: str = "radial_line", tolerance: float = 1e-8, max_iter: int = 100) -> elliptic.Solved:
    """BiCGStab on -div(A grad phi) = -f; ends are zero or flat."""
    if bc not in ("foextrap", ("dirichlet", 0.0)):
        raise ValueError("the radius ends in zeros or flat")

    def op(df: DataFrame, x: str) -> DataFrame:
        both = Given(df.select("i", "j", x).join(tensor, ["i", "j"]))
        plan = tensor_operator(both, x, geometry, bc).select("i", "j", **{x: -var("value")})
        return plan.frame(df.sparkSession, "")

    b = rhs.select("i", "j", (-rhs[c]).alias("b"))
    return elliptic.bicgstab(op, b, tolerance, max_iter, preconditioner(precondition, tensor, geometry, bc))

"""Price index formulae as SQL aggregates over matched pairs: p0, pt, q0, qt, and where named the weight w."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unweighted formulae of one elementary cell.
ELEMENTARY = {
    "jevons": "exp(avg(ln(pt / p0)))",
    "dutot": "avg(pt) / avg(p0)",
    "carli": "avg(pt / p0)",
    "harmonic": "count(*) / sum(p0 / pt)",
    "cswd": "sqrt(avg(pt / p0) * count(*) / sum(p0 / pt))",
    "unit_value": "(sum(pt * qt) / nullif(sum(qt), 0)) / nullif(sum(p0 * q0) / nullif(sum(q0), 0), 0)",
    "young": "coalesce(sum(w * pt / p0) / nullif(sum(w), 0), exp(avg(ln(pt / p0))))",
}

_L, _P = "sum(pt * q0) / nullif(sum(p0 * q0), 0)", "sum(pt * qt) / nullif(sum(p0 * qt), 0)"
_GL = "sum(p0 * q0 * ln(pt / p0)) / nullif(sum(p0 * q0), 0)"
_GP = "sum(pt * qt * ln(pt / p0)) / nullif(sum(pt * qt), 0)"

#: Weighted formulae of two periods; all legs are conditional sums, so a missing quantity drops an item from its leg only.
BILATERAL = {
    "laspeyres": _L,
    "paasche": _P,
    "fisher": f"sqrt(({_L}) * ({_P}))",
    "tornqvist": f"exp(0.5 * (({_GL}) + ({_GP})))",
    "walsh": "sum(pt * sqrt(q0 * qt)) / nullif(sum(p0 * sqrt(q0 * qt)), 0)",
    "marshall_edgeworth": "sum(pt * (q0 + qt)) / nullif(sum(p0 * (q0 + qt)), 0)",
    "geometric_laspeyres": f"exp({_GL})",
    "geometric_paasche": f"exp({_GP})",
    "lowe": "sum(pt * qb) / nullif(sum(p0 * qb), 0)",
    "young": "sum(sb * pt / p0) / nullif(sum(sb), 0)",
    "fisher_quantity": "sqrt((sum(p0 * qt) / nullif(sum(p0 * q0), 0)) * (sum(pt * qt) / nullif(sum(pt * q0), 0)))",
    "value_ratio": "sum(pt * qt) / nullif(sum(p0 * q0), 0)",
    "substitution_bias": f"(({_L}) - ({_P})) * 100",
    "price_updating_effect": "(sum(pt * qb) / nullif(sum(p0 * qb), 0) - sum(sb * pt / p0) / nullif(sum(sb), 0)) * 100",
}


def formula(name: str) -> Column:
    """The aggregate of a formula, elementary first."""
    return F.expr(ELEMENTARY.get(name) or BILATERAL[name])

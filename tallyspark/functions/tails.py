"""Distribution tails as lazy Column expressions.

The regularized gamma / beta functions and erfc of Apache Commons Math,
which ships with Spark, are called through ``java_method`` so p-values are
computed JVM-side next to the statistics, without a driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GAMMA = "org.apache.commons.math3.special.Gamma"
_BETA = "org.apache.commons.math3.special.Beta"
_ERF = "org.apache.commons.math3.special.Erf"


def _call(cls: str, method: str, *args: Column) -> Column:
    return F.call_function("java_method", F.lit(cls), F.lit(method),
                           *[a.cast("double") for a in args]).cast("double")


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, Q(dof/2, x/2)."""
    return F.when(x.isNull() | dof.isNull() | (dof <= 0), F.lit(None).cast("double")).otherwise(
        _call(_GAMMA, "regularizedGammaQ", dof / 2.0, F.greatest(x, F.lit(0.0)) / 2.0))


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal, erfc(z / sqrt 2) / 2."""
    return _call(_ERF, "erfc", z / F.lit(2.0 ** 0.5)) / 2.0


def t_sf_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t: I_{dof/(dof+t^2)}(dof/2, 1/2)."""
    x = dof / (dof + t * t)
    return F.when(t.isNull() | dof.isNull() | (dof <= 0), F.lit(None).cast("double")).otherwise(
        _call(_BETA, "regularizedBeta", x, dof / 2.0, F.lit(0.5)))

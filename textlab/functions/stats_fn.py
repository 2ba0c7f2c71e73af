"""normal tail probabilities as column expressions.

Neither Spark nor DuckDB has ``erf``; the complementary error function is
evaluated with the Chebyshev fit published in Numerical Recipes (fractional
error below 1.2e-7 everywhere), written out as one expression so it stays on
the executors and inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.clean import _c

# Coefficients of the Numerical Recipes erfc fit, highest order last.
ERFC_COEFFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(col) -> Column:
    x = F.abs(_c(col))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    # poly now holds c0 + t*(c1 + ...); erfc(x) = t*exp(-x^2 + poly) for x >= 0.
    val = t * F.exp(-x * x + poly)
    return F.when(_c(col) >= 0, val).otherwise(F.lit(2.0) - val)


def normal_two_sided_p(z) -> Column:
    """P(|N(0,1)| >= |z|) = erfc(|z| / sqrt 2)."""
    return erfc(F.abs(_c(z)) / F.lit(2.0 ** 0.5))


def erfc_sql(x: str) -> str:
    """The same fit as SQL text (for oracle queries), for ``x >= 0``."""
    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = repr(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"

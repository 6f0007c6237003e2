"""Column expressions over numbers and vectors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: From here on a double has no fraction.
WHOLE = float(2**52)


def rounded(x: Column, digits: int) -> Column:
    """``x`` times 10 ** digits to the nearest whole number, halves away from zero, and back, as SQL engines round doubles.

    F.round goes by the shortest decimal that stands for ``x``; the two part where the product with 10 ** digits is a half.
    """
    scaled = F.abs(x) * F.lit(float(10**digits))
    whole = F.floor(scaled)
    up = F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(scaled < WHOLE, F.signum(x) * up / F.lit(float(10**digits))).otherwise(x)


@F.pandas_udf(DoubleType())
def ln(x: pd.Series) -> pd.Series:
    """Of numbers above 0, by the C library as in SQL: the JVM's differs in the last bit, which decides ties of a rounding."""
    return x.map(math.log, na_action="ignore")


@F.pandas_udf(DoubleType())
def exp(x: pd.Series) -> pd.Series:
    """By the C library, as ``ln``."""
    return x.map(math.exp, na_action="ignore")


def clamp(confidence: Column, otherwise: float = 0.0) -> Column:
    """Into 0..1; NaN, infinities and nulls become ``otherwise``."""
    finite = ~F.isnan(confidence) & (F.abs(confidence) < F.lit(float("inf")))
    # greatest and least pass over nulls, so the test stands outside
    return F.when(finite, F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(otherwise))


def weakened(old: Column, new: Column, factor: float = 0.4) -> Column:
    """Confidence of a fact once a newer one with confidence ``new`` contradicts it."""
    return F.greatest(F.lit(0.0), clamp(old) * (1 - factor * clamp(new)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity of a column to one given vector, whose norm is taken once; null for a zero vector."""
    norm = math.sqrt(sum(x * x for x in query))
    fixed = F.array(*(F.lit(float(x)) for x in query))
    return F.try_divide(dot(vector, fixed), F.sqrt(dot(vector, vector)) * F.lit(norm))


def noisy_or(strongest: Column, product: Column, damping: float = 0.4, cap: float = 0.95) -> Column:
    """Damped noisy-or of several sources: the strongest counts in full, the others damped.

    ``product`` is the product of 1 - damping * c over all sources, the strongest included; its factor
    is divided out again (it is at least 1 - damping).
    """
    combined = 1 - (1 - strongest) * product / (1 - damping * strongest)
    return F.least(F.greatest(F.lit(cap), strongest), combined)


def percent(part: Column, whole: Column) -> Column:
    """Rounded to a tenth; 100 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(100.0))

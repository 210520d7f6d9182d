"""Rates and distances for evaluation, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import squeeze

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n; (0, 1) for n = 0."""
    p, zz = k / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def zero_error_sample(target: float, z: float = Z) -> int:
    """Sample size at which no error puts the upper Wilson bound at the target."""
    return math.ceil(z * z * (1 - target) / target)


def rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n)


def character_errors(pred: Column, truth: Column) -> Column:
    return F.levenshtein(squeeze(pred), squeeze(truth))


def cer(pred: Column, truth: Column) -> Column:
    """Edit distance by the truth's length; for an empty truth 0 if the prediction is empty too, else 1."""
    p, t = squeeze(pred), squeeze(truth)
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(p, t) / F.char_length(t))


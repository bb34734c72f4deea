"""Element-wise column functions: stable logistic terms, softmax, and the orthant rules of L1 optimisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_exp(m: Column) -> Column:
    """log(1 + e^m) without overflow."""
    return F.when(m > 0, m + F.log1p(F.exp(-m))).otherwise(F.log1p(F.exp(m)))


def sigmoid(m: Column) -> Column:
    return 1 / (1 + F.exp(-m))


def softmax(margins: Column) -> Column:
    """Probabilities of an array of margins. The shift applies only above 0, and an infinite margin takes all."""
    top = F.array_max(margins)
    shift = F.greatest(top, F.lit(0.0))
    powers = F.transform(margins, lambda m: F.exp(m - shift))
    total = F.aggregate(powers, F.lit(0.0), lambda s, p: s + p)
    where = F.array_position(margins, top)
    one_hot = F.transform(margins, lambda m, i: (i + 1 == where).cast("double"))
    return F.when(top == float("inf"), one_hot).otherwise(F.transform(powers, lambda p: p / total))


def logistic_loss(label: Column, margin: Column, weight: Column) -> Column:
    """Weighted loss of one row, where ``margin`` is -(x b + b0)."""
    return weight * F.when(label > 0, log1p_exp(margin)).otherwise(log1p_exp(margin) - margin)


def logistic_multiplier(label: Column, margin: Column, weight: Column) -> Column:
    return weight * (1 / (1 + F.exp(margin)) - label)


def squared_loss(difference: Column, weight: Column) -> Column:
    return weight * difference * difference / 2


def pseudo_gradient(x: Column, g: Column, l1: Column) -> Column:
    """Steepest-descent (sub)gradient of f + l1 |x|."""
    at_zero = F.when(g - l1 > 0, g - l1).when(g + l1 < 0, g + l1).otherwise(0.0)
    return F.when(l1 == 0, g).when(x != 0, g + F.signum(x) * l1).otherwise(at_zero)


def project_direction(d: Column, adjusted: Column) -> Column:
    """Keeps a component that descends along the adjusted gradient."""
    return F.when(d * adjusted < 0, d).otherwise(0.0)


def orthant_step(x: Column, d: Column, adjusted: Column, alpha: Column) -> Column:
    """x + alpha d, with 0 for components that leave the orthant."""
    orthant = F.when(x != 0, F.signum(x)).otherwise(F.signum(-adjusted))
    new = x + alpha * d
    return F.when(F.signum(new) == orthant, new).otherwise(0.0)

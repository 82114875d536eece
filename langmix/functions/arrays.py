"""Array math on logits and sequence pairing, all as native higher-order
functions so they stay inside the JVM."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


FEW_CLASSES = 8   # size of a logit vector up to which its sum is written out


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(fn: Callable[..., Column], **values) -> Column:
    """``fn`` of the named values, each evaluated once a row however often
    ``fn`` and the lambdas in it use it. A lambda that names an expression of
    the whole array has Spark evaluate it again for every element."""
    row = F.array(F.struct(*[_c(v).alias(k) for k, v in values.items()]))
    return F.get(F.transform(row, lambda s: fn(**{k: s[k] for k in values})), F.lit(0))


def softmax(logits) -> Column:
    """Numerically stable softmax over one logit vector."""
    a = _c(logits)
    e = bound(lambda a, m: F.transform(a, lambda x: F.exp(x - m)), a=a, m=F.array_max(a))
    return bound(lambda e: bound(lambda e, s: F.transform(e, lambda x: x / s), e=e, s=F.aggregate(
        e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)), e=e)


def argmax(values) -> Column:
    """0-based index of the first maximum (torch.argmax tie rule)."""
    a = _c(values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def max_prob(logits) -> Column:
    """Probability of the chosen class: its term is exp(0), so the largest of
    the softmax is one by the sum."""
    a = _c(logits)
    m = F.array_max(a)
    # few classes are summed in compiled code, in the same order; a lambda is interpreted for every element
    few = F.lit(0.0)
    for i in range(FEW_CLASSES):
        few = few + F.when(F.size(a) > i, F.exp(F.get(a, F.lit(i)) - m)).otherwise(F.lit(0.0))
    return F.when(m.isNotNull(), F.when(F.size(a) > FEW_CLASSES, max_prob_of_any(a)).otherwise(F.lit(1.0) / few))


def max_prob_of_any(logits) -> Column:
    """:func:`max_prob` for use in a lambda, where nothing is compiled."""
    a = _c(logits)
    s = bound(lambda a, m: F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m)), a=a, m=F.array_max(a))
    return F.when(F.array_max(a).isNotNull(), F.lit(1.0) / s)

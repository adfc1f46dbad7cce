"""Variance percentages and their distribution buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bucket edges in percent. Between -10% and 10% the steps are 2%, outside 10%.
BUCKET_EDGES = [
    -100, -90, -80, -70, -60, -50, -40, -30, -20, -10, -8, -6, -4, -2, 0,
    2, 4, 6, 8, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100,
]

BELOW_ALL = "< -100%"
AT_LOWEST = "equals -100%"
AT_ZERO = "equals 0%"
AT_HIGHEST = "equals 100%"
ABOVE_ALL = "> 100%"


def _between(low: int, high: int) -> str:
    return f"between {low}% and {high}%"


_BETWEEN = [_between(lo, hi) for lo, hi in zip(BUCKET_EDGES, BUCKET_EDGES[1:])]
_UP_TO_ZERO = BUCKET_EDGES.index(0)

# All labels in report order. Zero itself is counted in "between -2% and 0%".
BUCKET_ORDER = [
    BELOW_ALL,
    AT_LOWEST,
    *_BETWEEN[:_UP_TO_ZERO],
    AT_ZERO,
    *_BETWEEN[_UP_TO_ZERO:],
    AT_HIGHEST,
    ABOVE_ALL,
]


def var_pct(variance: Column, base: Column) -> Column:
    """Variance over the size of the base; a zero base gives the sign of the variance."""
    variance, base = variance.cast("double"), base.cast("double")
    return F.when(base == 0, F.signum(variance)).otherwise(F.try_divide(variance, F.abs(base)))


def var_pct_from_to(from_amount: Column, to_amount: Column) -> Column:
    return var_pct(to_amount - from_amount, from_amount)


def var_pct_null_aware(
    from_amount: Column, to_amount: Column, missing_from: str = "one"
) -> Column:
    """Variance where a missing side means "new" or "gone"; the base keeps its sign.

    ``missing_from`` sets the result when only ``from_amount`` is missing:
    ``"one"`` gives 1, ``"neg_to"`` the negated ``to_amount``.
    """
    if missing_from not in ("one", "neg_to"):
        raise ValueError(f"missing_from must be 'one' or 'neg_to', not {missing_from!r}")
    a, b = from_amount.cast("double"), to_amount.cast("double")
    only_to = F.lit(1.0) if missing_from == "one" else -b
    return (
        F.when(a.isNull() & b.isNull(), F.lit(None).cast("double"))
        .when(a.isNull(), only_to)
        .when(b.isNull(), F.lit(-1.0))
        .when(a == 0, F.when(b == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .otherwise(F.try_divide(b - a, a))
    )


def var_bucket(pct: Column) -> Column:
    """Label of the bucket a variance ratio falls in; intervals are closed above."""
    pct = pct.cast("double")
    label = F.when(F.isnan(pct), F.lit(None).cast("string"))
    label = label.when(pct < -1, F.lit(BELOW_ALL)).when(pct == -1, F.lit(AT_LOWEST))
    for high, text in zip(BUCKET_EDGES[1:-1], _BETWEEN):
        label = label.when(pct <= high / 100, F.lit(text))
    label = label.when(pct < 1, F.lit(_BETWEEN[-1]))
    return label.when(pct == 1, F.lit(AT_HIGHEST)).when(pct > 1, F.lit(ABOVE_ALL))


def order_in(labels: list[str], value: Column) -> Column:
    """Place of a label in a given order, from 1; unknown and missing labels come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), value)
    return F.when(place > 0, place.cast("int")).otherwise(F.lit(len(labels) + 1))


def same_text(left: Column, right: Column, strict: bool = False) -> Column:
    """'variance' when exactly one side is missing, else null.

    ``strict=True`` also reports texts that differ in more than case.
    """
    differs = left.isNull() != right.isNull()
    if strict:
        differs = differs | F.coalesce(
            F.lower(left.cast("string")) != F.lower(right.cast("string")), F.lit(False)
        )
    return F.when(differs, F.lit("variance"))

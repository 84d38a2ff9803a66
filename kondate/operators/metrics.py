"""Scalar metrics of a product: energy ratios, distance to a target, protein for the money, eligibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kondate import schema

UNSURE = "要確認"
#: A unit that is one serving.
SERVING = "1(?:包装|食|個|本|袋|商品|パック)"
NAN = float("nan")


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def pfc_ratios(p: str | Column = "p", f: str | Column = "f", carb: str | Column = "c") -> tuple[Column, Column, Column]:
    """Percent of energy from protein, fat and carbohydrate; null if any is unknown or all are 0."""
    parts = (4 * c(p), 9 * c(f), 4 * c(carb))
    total = parts[0] + parts[1] + parts[2]
    return tuple(F.when(total != 0, F.try_divide(x, total) * 100) for x in parts)


def pfc_distance(target: tuple[float, float, float], *names: str | Column) -> Column:
    """Sum of the deviations from the target; infinite without ratios."""
    gaps = [F.abs(r - t) for r, t in zip(pfc_ratios(*names), target, strict=True)]
    return F.coalesce(gaps[0] + gaps[1] + gaps[2], F.lit(float("inf")))


def protein_per_100yen(p: str | Column = "p", price: str | Column = "price", unit: str | Column | None = "unit") -> Column:
    sure = F.lit(True) if unit is None else ~F.contains(F.coalesce(c(unit), F.lit("")), F.lit(UNSURE))
    return F.when((c(p) > 0) & (c(price) > 0) & sure, F.try_divide(100 * c(p), c(price)))


def yen_per_gram_protein() -> Column:
    return F.when(protein_per_100yen().isNotNull(), F.try_divide("price", "p"))


def max_deviation(target: tuple[float, float, float], *names: str | Column) -> Column:
    """The largest deviation of the three ratios, which are null together."""
    return F.greatest(*[F.abs(r - t) for r, t in zip(pfc_ratios(*names), target, strict=True)])


def is_balanced(target: tuple[float, float, float], tolerance: float | Column, *names: str | Column) -> Column:
    tolerance = F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance
    return F.coalesce(max_deviation(target, *names) <= tolerance + 1e-8, F.lit(False))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def eligible() -> Column:
    """All numbers known, energy and price above 0, and a unit that is surely one serving."""
    unit = F.coalesce("unit", F.lit(""))
    known = pfc_ratios()[0].isNotNull() & (F.col("kcal") > 0) & (F.col("price") > 0)
    for name in schema.NUMBERS:
        known = known & finite(F.col(name)) & (F.col(name) >= 0)
    return F.coalesce(known & ~unit.contains(UNSURE) & unit.rlike(SERVING), F.lit(False))

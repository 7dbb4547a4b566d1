"""Vector and statistics functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval in percent, one decimal; 0 and 0 for n = 0."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ends = [F.when(n > 0, F.round(100 * x, 1)).otherwise(0.0) for x in (middle - half, middle + half)]
    return ends[0], ends[1]


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test; the tail is summed in units of 2 ** (power - n), whose power grows with the terms, so
    that neither end of a long row of terms leaves the range of doubles."""
    n = (wins + losses).cast("int")
    least = F.least(wins, losses).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"), F.lit(0.0).alias("power"))
    step, most = 500, F.lit(2.0**500)

    def add(s: Column, i: Column) -> Column:
        unit = F.when(s["term"] > most, F.lit(2.0**-step)).otherwise(1.0)
        power = s["power"] + F.when(s["term"] > most, F.lit(float(step))).otherwise(0.0)
        return F.struct((s["term"] * unit * (n - i) / (i + 1)).alias("term"), ((s["total"] + s["term"]) * unit).alias("total"), power.alias("power"))

    tail = F.aggregate(F.sequence(F.lit(0), least), start, add, lambda s: _scaled(s["total"], s["power"] - n))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)


def _scaled(x: Column, power: Column) -> Column:
    """x * 2 ** power in two steps, as one factor may be out of range where the product isn't."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)

"""Array arithmetic for vectors as Column functions. Components are read as doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import col


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. An expression that a lambda mentions is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalise(v: Column, floor: float = 1e-6) -> Column:
    """v over its length, or over floor where that is larger."""
    return let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x / n))


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def truncate(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


def concat_scaled(a: Column, b: Column, scale_b: float = 1.0) -> Column:
    """Two unit vectors on end, the second weighted."""
    return F.concat(a, scale(b, scale_b))


def mean(vectors: Column) -> Column:
    """The mean of an array of vectors."""
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    sums = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return let(F.size(vectors), lambda n: F.transform(sums, lambda x: x / n))


def gem(vectors: Column, p: float) -> Column:
    """Signed generalised mean of an array of vectors, component by component; p = 1 is the mean."""
    powered = F.transform(vectors, lambda v: F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(p))))
    return F.transform(mean(powered), lambda m: F.signum(m) * F.pow(F.abs(m), F.lit(1.0 / p)))


def rotate(v: Column, angle: Column) -> Column:
    """Consecutive component pairs turned by the angles of an array with one for each pair."""
    n = F.size(v)
    even, odd = (F.transform(F.sequence(F.lit(k), n - 2 + k, F.lit(2)), lambda i: F.get(v, i)) for k in (0, 1))

    def turned(p: Column) -> Column:
        return F.array(p["x"] * F.cos(p["t"]) - p["y"] * F.sin(p["t"]), p["x"] * F.sin(p["t"]) + p["y"] * F.cos(p["t"]))

    return F.flatten(F.transform(F.arrays_zip(even.alias("x"), odd.alias("y"), angle.alias("t")), turned))


def rope_angles(place: Column, pairs: int, most: float, spread: float) -> Column:
    """place times a falling ladder of rates, one for each pair."""
    rates = [most * spread ** (-k / max(pairs - 1, 1)) for k in range(pairs)]
    return F.array(*(place * r for r in rates))


def is_zero(v: Column) -> Column:
    return total(F.transform(v, F.abs)) == 0


def softmax(scores: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(total(e), lambda sum_: F.transform(e, lambda x: x / sum_))

    return let(scores, lambda s: let(array_exp(s), shares))


def array_exp(s: Column) -> Column:
    """exp of each element less the largest."""
    return let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))


def log_sum_exp(s: Column) -> Column:
    return F.array_max(s) + F.log(total(array_exp(s)))


def log_softmax(scores: Column) -> Column:
    return let(scores, lambda s: let(log_sum_exp(s), lambda rest: F.transform(s, lambda x: x - rest)))


def entropy(p: Column, floor: float = 1e-9) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(floor)))))


def soft_targets(x: Column, y: Column, grid: int, temperature: Column | float) -> Column:
    """softmax(-d^2 / temperature) over the centres of a grid's cells, row by row."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda i: -(F.pow(x - (i % grid + 0.5), 2) + F.pow(y - (F.floor(i / grid) + 0.5), 2)) / temperature)
    return softmax(cells)


def sinusoids(v: Column, bands: int) -> Column:
    """sin and cos of v at doubling frequencies."""
    return F.flatten(F.array(*(F.array(F.sin(v * (2.0**k * math.pi)), F.cos(v * (2.0**k * math.pi))) for k in range(bands))))


def cosine_rate(step: Column, steps: int, top: float, low: float = 0.0) -> Column:
    """A rate that falls from top to low along half a cosine."""
    return low + (top - low) * 0.5 * (1 + F.cos(F.least(col(step) / steps, F.lit(1.0)) * math.pi))


def crop_lefts(width: Column, size: int, crops: Column) -> Column:
    """Where crops of a picture begin: the middle for one, else spread from edge to edge (halves go to the even pixel)."""
    free = (width - size).cast("long")
    spread = F.transform(F.sequence(F.lit(0), F.greatest(crops, F.lit(1)) - 1), lambda i: F.bround(i * free / F.greatest(crops - 1, F.lit(1)), 0).cast("long"))
    return F.when(crops == 1, F.array(F.floor(free / 2))).otherwise(spread)


def axial_tables(spark: SparkSession, actions: int, width: int) -> DataFrame:
    """action, pair, c, s: rotations of a square grid of actions for vectors of this width; the first half of the pairs turns with the column, the
    rest with the row, at wavelengths from 2 to twice the side in even ratios."""
    side = math.isqrt(actions)
    if side * side != actions or width % 4:
        raise ValueError("the grid must be square and the width a multiple of 4")
    pairs = width // 4
    a = spark.range(actions).select(F.col("id").alias("action"), F.explode(F.sequence(F.lit(0), F.lit(2 * pairs - 1))).alias("pair"))
    place = F.when(F.col("pair") < pairs, F.col("action") % side).otherwise(F.floor(F.col("action") / side))
    angle = place * (math.pi / F.pow(F.lit(float(side)), F.col("pair") % pairs / float(max(1, pairs - 1))))
    return a.select("action", "pair", F.cos(angle).alias("c"), F.sin(angle).alias("s"))

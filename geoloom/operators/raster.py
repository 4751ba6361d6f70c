"""Rasters of class values as pixel rows (x, y, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes in order, each 23 apart; and the value of pixels that nothing decides.
CLASSES = ("background", "water", "ice", "wood", "grass", "farmland", "landuse", "building", "railway", "road_minor", "road_major", "aeroway")
SPACING, AMBIGUOUS = 23, 255


def legal(v: Column) -> Column:
    return (v % SPACING == 0) & (v >= 0) & (v < SPACING * len(CLASSES))


def snap(v: Column) -> Column:
    """The nearest legal value; the lower of two equally near."""
    k = F.least(F.lit(len(CLASSES) - 1), F.floor((v + (SPACING - 1) // 2) / SPACING))
    return (k * SPACING).cast("int")


def class_name(v: Column) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), (v / SPACING).cast("int"))


def histogram(pixels: DataFrame, patch: int, sub: int, by: tuple[str, ...] = ()) -> DataFrame:
    """patch and cell (numbers row by row within the frame and the patch) with the share of each class."""
    side = patch // sub
    px, py = F.floor(F.col("x") / patch), F.floor(F.col("y") / patch)
    cell = F.floor((F.col("y") % patch) / side) * sub + F.floor((F.col("x") % patch) / side)
    return pixels.groupBy(*by, px.alias("px"), py.alias("py"), cell.alias("cell"), (F.col("v") / SPACING).cast("int").alias("class")).agg((F.count("*") / float(side * side)).alias("share"))


def breakdown(pixels: DataFrame) -> DataFrame:
    """v, class (null if not legal), n, percent."""
    n = pixels.groupBy("v").agg(F.count("*").alias("n"))
    # One row for each of at most 256 values.
    return n.select("v", F.when(legal(F.col("v")), class_name(F.col("v"))).alias("class"), "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def majority(pixels: DataFrame, scale: int, threshold: float | None = None) -> DataFrame:
    """x, y, v of a raster shrunk by scale: each block's most frequent legal value, the first in scan order of those that tie.

    Without any legal value: the snapped mean, or AMBIGUOUS where a threshold is set. With a threshold, a block is AMBIGUOUS too if its winning
    count over its number of distinct legal values is at or under the threshold. (A 2-2 tie gives 2/2 = 1, so no threshold under 1 flags it.)
    """
    x, y = F.floor(F.col("x") / scale).cast("int"), F.floor(F.col("y") / scale).cast("int")
    order = (F.col("y") % scale) * scale + F.col("x") % scale
    p = pixels.select(x.alias("bx"), y.alias("by"), "v", order.alias("o"))
    ok = legal(F.col("v"))
    per = p.where(ok).groupBy("bx", "by", "v").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    best = per.groupBy("bx", "by").agg(F.max(F.struct("n", (-F.col("o")).alias("o"), "v")).alias("m"), F.count("*").alias("kinds"))
    mean = p.groupBy("bx", "by").agg(F.sum("v").alias("s"), F.count("*").alias("total"))
    j = mean.join(best, ["bx", "by"], "left")
    blend = snap(F.floor(F.col("s") / F.col("total") + 0.5)) if threshold is None else F.lit(AMBIGUOUS)
    won = F.col("m.v") if threshold is None else F.when(F.col("m.n") / F.col("kinds") <= threshold, AMBIGUOUS).otherwise(F.col("m.v"))
    return j.select(F.col("bx").alias("x"), F.col("by").alias("y"), F.when(F.col("m").isNull(), blend).otherwise(won).cast("int").alias("v"))


def agreement(a: DataFrame, b: DataFrame, patch: int, sub: int) -> DataFrame:
    """One row: the share of pixels that differ, and the largest difference of a class share."""
    d = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["x", "y"]).agg(F.avg((F.col("va") != F.col("vb")).cast("double")).alias("differ"))
    ha = histogram(a, patch, sub).withColumnRenamed("share", "sa")
    hb = histogram(b, patch, sub).withColumnRenamed("share", "sb")
    most = ha.join(hb, ["px", "py", "cell", "class"], "full").agg(F.max(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0)))).alias("most"))
    return d.crossJoin(F.broadcast(most))


def orientation(pixels: DataFrame, patch: int, roads: tuple[int, ...] = (9, 10)) -> DataFrame:
    """px, py, angle, coherence of road pixels by the structure tensor: differences to the next pixel, summed over a patch.

    Class numbers of roads are an argument; the defaults are the two road classes.
    """
    p = pixels.select("x", "y", F.when((F.col("v") / SPACING).cast("int").isin(*roads), 1.0).otherwise(0.0).alias("r"))
    right = p.select((F.col("x") - 1).alias("x"), "y", F.col("r").alias("rx"))
    down = p.select("x", (F.col("y") - 1).alias("y"), F.col("r").alias("ry"))
    g = p.join(right, ["x", "y"]).join(down, ["x", "y"]).select("x", "y", (F.col("rx") - F.col("r")).alias("gx"), (F.col("ry") - F.col("r")).alias("gy"))
    gx, gy = F.col("gx"), F.col("gy")
    s = g.groupBy(F.floor(F.col("x") / patch).alias("px"), F.floor(F.col("y") / patch).alias("py")).agg(F.sum(gx * gx).alias("xx"), F.sum(gy * gy).alias("yy"), F.sum(gx * gy).alias("xy"))
    xx, yy, xy = F.col("xx"), F.col("yy"), F.col("xy")
    size = F.sqrt(F.pow(xx - yy, 2) + 4 * xy * xy)
    return s.where(xx + yy > 0).select("px", "py", (0.5 * F.atan2(2 * xy, xx - yy)).alias("angle"), (size / (xx + yy)).alias("coherence"))

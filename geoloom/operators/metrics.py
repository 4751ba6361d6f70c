"""Error profiles, hit rates, calibration and resampling over frames of errors in kilometres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import col
from .order import numbered

#: Radii in km of the baseline report (inclusive) and of the standard one (exclusive), and the score's length scale.
BASELINE_KM = (1, 25, 100, 750)
STANDARD_KM = (1, 25, 200, 750, 2500)
SCORE_KM = 1492.7


def report(errors: DataFrame, err: str = "km", by: list[str] | None = None) -> DataFrame:
    """n, median, mean and the shares at or under each baseline radius."""
    e = F.col(err)
    aggs = [F.count("*").alias("n"), F.percentile(e, 0.5).alias("median"), F.avg(e).alias("mean")]
    return errors.groupBy(*(by or [])).agg(*aggs, *(F.avg((e <= r).cast("double")).alias(f"at{r}") for r in BASELINE_KM))


def geoscore(err: Column | str) -> Column:
    return 5000 * F.exp(-col(err) / SCORE_KM)


def standard(errors: DataFrame, err: str = "km", by: list[str] | None = None) -> DataFrame:
    """Shares under each standard radius and the mean score."""
    e = F.col(err)
    return errors.groupBy(*(by or [])).agg(*(F.avg((e < r).cast("double")).alias(f"under{r}") for r in STANDARD_KM), F.avg(geoscore(e)).alias("geoscore"))


def trimmed_means(errors: DataFrame, shares: list[float], err: str = "km") -> DataFrame:
    """The mean of errors at or under each percentile. The percentiles are one row, so they are broadcast."""
    cuts = errors.agg(F.percentile(err, F.array(*map(F.lit, shares))).alias("cuts"))
    return errors.crossJoin(F.broadcast(cuts)).agg(F.array(*(F.avg(F.when(F.col(err) <= F.col("cuts")[i], F.col(err))) for i in range(len(shares)))).alias("means"))


def partition(queries: DataFrame, radius: float) -> DataFrame:
    """queries with class: uncovered, retrieval, ranking or solved at a radius, from near (nearest legal row), any (best of the top k) and top (rank 1)."""
    r = radius
    cls = F.when(F.col("top") < r, "solved").when(F.col("any") < r, "ranking").when(F.col("near") < r, "retrieval").otherwise("coverage")
    return queries.withColumn("class", cls)


def partition_breaks(queries: DataFrame, radius: float) -> DataFrame:
    """Queries in other than one class: a legal hit without coverage."""
    r = radius
    covered, any_, top = (F.coalesce(F.col(c) < r, F.lit(False)) for c in ("near", "any", "top"))
    n = sum((c.cast("int") for c in (~covered, covered & ~any_, any_ & ~top, top)), F.lit(0))
    return queries.withColumn("classes", n).where(F.col("classes") != 1)


def resamples(pairs: DataFrame, reps: int, seed: int, key: str = "id") -> DataFrame:
    """rep, a, b: draws with replacement shared by both arms.

    Rows are numbered in the order of key; draw i of a resample takes the row whose number the md5 of (seed, rep, i) names, so any engine can
    repeat it. Only (rep, number) pairs are shuffled to the rows.
    """
    spark = pairs.sparkSession
    n = pairs.count()
    rows = numbered(pairs, [F.col(key)], "no")
    draws = spark.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("i"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "i")), 1, 12), 16, 10).cast("long") % n
    return draws.select("rep", pick.alias("no")).join(rows.select("no", "a", "b"), "no")


def paired_bootstrap(pairs: DataFrame, reps: int, seed: int = 17, under: float = 25.0, key: str = "id") -> DataFrame:
    """statistic, lo, hi, separated: 95 % intervals of a - b for median, mean and hit rate, from one set of resamples."""
    r = resamples(pairs, reps, seed, key).groupBy("rep").agg(
        (F.percentile("a", 0.5) - F.percentile("b", 0.5)).alias("median"),
        (F.avg("a") - F.avg("b")).alias("mean"),
        (F.avg((F.col("a") < under).cast("double")) - F.avg((F.col("b") < under).cast("double"))).alias("hits"),
    )
    long = r.select(F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in ("median", "mean", "hits")))).alias("s")).select("s.*")
    q = long.groupBy("statistic").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("statistic", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), separated(F.col("q")[0], F.col("q")[1]).alias("separated"))


def separated(lo: Column, hi: Column) -> Column:
    """An interval that lies strictly on one side of zero."""
    return (lo > 0) | (hi < 0)


def confidence_radius(candidates: DataFrame, by: str = "query_id") -> DataFrame:
    """Softmax-weighted RMS km of candidates (lat, lon, score) about their weighted centroid; 0 for one candidate. Sums only, then one join."""
    w = candidates.withColumn("w", F.exp(F.col("score") - F.max("score").over(Window.partitionBy(by))))
    x, y, z = geo.unit("lat", "lon")
    c = w.groupBy(by).agg(*(F.sum(F.col("w") * v).alias(n) for v, n in ((x, "cx"), (y, "cy"), (z, "cz"))), F.sum("w").alias("total"), F.count("*").alias("n"))
    c = c.select(by, "total", "n", geo.unit_lat(F.col("cx"), F.col("cy"), F.col("cz")).alias("clat"), geo.unit_lon(F.col("cx"), F.col("cy")).alias("clon"))
    km = geo.haversine_km("lat", "lon", "clat", "clon")
    out = w.join(c, by).groupBy(by).agg(F.sqrt(F.sum(F.col("w") / F.col("total") * km * km)).alias("radius_km"), F.first("n").alias("n"))
    return out.select(by, F.when(F.col("n") == 1, 0.0).otherwise(F.col("radius_km")).alias("radius_km"))

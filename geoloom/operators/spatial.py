"""Radius and nearest-neighbour joins on the sphere by degree cells, and density groups.

Places fall into cells of equal height; a cell's width grows towards the poles so that a disc never reaches beyond the
neighbouring cells. Every place is sent to the cells a disc around it can touch, which makes the join an equi join, and
the exact distance decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .areas import connected
from .order import cut


def _row(lat: Column, size: float) -> Column:
    return F.floor((lat + 90) / size)


def _columns(row: Column, size: float) -> Column:
    """How many cells a row of cells has: each is at least `size` degrees of arc wide at the row's edge nearer its pole."""
    edge = F.greatest(F.abs(row * size - 90), F.abs((row + 1) * size - 90))
    arc = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(360.0 / size * arc).cast("int"))


def _column(lon: Column, row: Column, size: float) -> Column:
    n = _columns(row, size)
    return F.pmod(F.floor((lon + 180) / 360.0 * n), n)


def within(left: DataFrame, right: DataFrame, km: float, left_id: str = "row_id", right_id: str = "row_id") -> DataFrame:
    """a, b, km of all pairs at most km apart. Both sides have lat and lon; a frame may be joined with itself."""
    size = max(math.degrees(km / geo.EARTH_KM) * 1.0000001, 1e-6)
    r = right.select(F.col(right_id).alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    r = r.withColumn("row", _row(F.col("blat"), size)).withColumn("column", _column(F.col("blon"), F.col("row"), size))
    a = left.select(F.col(left_id).alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    a = a.withColumn("row", F.explode(F.array(*(_row(F.col("alat"), size) + d for d in (-1, 0, 1)))))
    mine = _column(F.col("alon"), F.col("row"), size)
    n = _columns(F.col("row"), size)
    # A row with three cells or fewer is touched as a whole; distinct columns keep a pair from coming twice.
    a = a.withColumn("column", F.explode(F.array_distinct(F.array(*(F.pmod(mine + d, n) for d in (-1, 0, 1))))))
    j = a.join(r, ["row", "column"]).withColumn("km", geo.haversine_km("alat", "alon", "blat", "blon"))
    return j.where(F.col("km") <= km).select("a", "b", "km")


def nearest(queries: DataFrame, bank: DataFrame, exclude: str | None = None, start_km: float = 50.0, grow: float = 8.0) -> DataFrame:
    """query_id, row_id, km: the nearest bank row that isn't of the query's own group; null where there is none.

    Discs grow until a legal row is inside; only queries without one go to the next round, and half the Earth's girth ends it.
    """
    cols = ["row_id", "lat", "lon"] + ([exclude] if exclude else [])
    todo, found, km = queries.select(*cols), None, start_km
    groups_q = queries.select(F.col("row_id").alias("a"), F.col(exclude).alias("ga")) if exclude else None
    groups_b = bank.select(F.col("row_id").alias("b"), F.col(exclude).alias("gb")) if exclude else None
    while True:
        p = within(todo, bank, km)
        if exclude:
            p = p.join(groups_q, "a").join(groups_b, "b").where(~F.col("ga").eqNullSafe(F.col("gb")))
        best = p.groupBy("a").agg(F.min(F.struct("km", "b")).alias("m")).select(F.col("a").alias("query_id"), F.col("m.b").alias("row_id"), F.col("m.km").alias("km"))
        best = cut(best)  # else every round would compute those before it again
        found = best if found is None else found.unionByName(best)
        if km >= math.pi * geo.EARTH_KM:
            break
        todo = cut(todo.join(best.select(F.col("query_id").alias("row_id")), "row_id", "left_anti"))
        if todo.isEmpty():
            break
        km = min(km * grow, math.pi * geo.EARTH_KM + 1)
    return queries.select(F.col("row_id").alias("query_id")).join(found, "query_id", "left")


def density_groups(places: DataFrame, km: float, need: int, seed: int = 17) -> DataFrame:
    """group, row_id, place: dense spots, found one after another; a row is used once.

    Greedy in hashed order: a row whose unused neighbours (itself included) number `need` or more takes the first `need` of them, by id,
    itself first. Rows of different connected areas can't affect each other, so each area is one fold; areas come from the radius join's links.
    """
    links = within(places, places, km).select("a", "b")
    area = connected(links)
    near = links.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    rows = near.join(area, F.col("a") == F.col("node")).select("component", "a", "near", F.md5(F.concat(F.lit(f"{seed}:"), F.col("a").cast("string"))).alias("order"))

    def fold(table):
        import pyarrow as pa

        rows_ = sorted(zip(table.column("order").to_pylist(), table.column("a").to_pylist(), table.column("near").to_pylist(), strict=True))
        used: set[int] = set()
        out = []
        for _, i, near_ in rows_:
            if i in used:
                continue
            free = [i, *(j for j in near_ if j != i and j not in used)]
            if len(free) < need:
                continue
            for place, j in enumerate(free[:need]):
                out.append({"group": i, "row_id": j, "place": place})
                used.add(j)
        return pa.Table.from_pylist(out, schema=pa.schema([("group", pa.int64()), ("row_id", pa.int64()), ("place", pa.int32())]))

    return rows.groupBy("component").applyInArrow(fold, "group long, row_id long, place int")


def density_band(counts: Column, lows: list[int]) -> Column:
    """The band lo <= n < next lo that a count falls in; null below the first."""
    out = F.lit(None).cast("int")
    for lo in lows:
        out = F.when(counts >= lo, F.lit(lo)).otherwise(out)
    return out


def cell_counts(places: DataFrame, degrees: float) -> DataFrame:
    return places.groupBy(geo.degree_cell("lat", "lon", degrees).cast("long").alias("cell")).agg(F.count("*").alias("n"))


def top_child(rows: DataFrame, parent: list[str], child: str) -> DataFrame:
    """parent, child, n: the most frequent child under each parent, the smallest of those that tie."""
    n = rows.groupBy(*parent, child).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*parent).orderBy(F.desc("n"), child)
    return n.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

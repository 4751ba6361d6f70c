"""What retrieved neighbours say about the children of a tile, and beam descent over supplied logits.

Weights that would be learned (temperatures, gates, logits) are arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, vectors

#: The softmax temperature of similarities, its floor, and what keeps a logarithm finite.
TAU, TAU_FLOOR, EPS = 0.07, 1e-3, 0.01


def weights(neighbours: DataFrame, tau: float = TAU, extra: Column | None = None) -> DataFrame:
    """neighbours (query_id, sim, ...) with alpha: softmax of sim over the temperature, plus extra scores."""
    score = F.col("sim") / max(tau, TAU_FLOOR) + (extra if extra is not None else F.lit(0.0))
    by = Window.partitionBy("query_id")
    w = neighbours.withColumn("__s", score).withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(by)))
    return w.withColumn("alpha", F.col("__e") / F.sum("__e").over(by)).drop("__s", "__e")


def child_prior(neighbours: DataFrame, tiles: DataFrame) -> DataFrame:
    """query_id, step, child, mass for tiles (query_id, step, x, y at zoom min(4 step, 12)): each neighbour's alpha goes to the child its
    finest tile (x16, y16) lies in; child -1 takes what lies outside. A neighbour is inside where its address begins with the tile's.
    """
    z = F.least(4 * F.col("step"), F.lit(12))
    j = tiles.join(neighbours, "query_id")

    def shifted(c: str, by: Column) -> Column:
        return F.floor(F.col(c) / F.pow(F.lit(2.0), by)).cast("long")

    inside = (shifted("x16", 16 - z) == F.col("x")) & (shifted("y16", 16 - z) == F.col("y"))
    below = F.greatest(12 - z, F.lit(0))
    child = (shifted("y16", below) % geo.GRID) * geo.GRID + shifted("x16", below) % geo.GRID
    return j.groupBy("query_id", "step", F.when(inside, child).otherwise(F.lit(-1)).cast("long").alias("child")).agg(F.sum("alpha").alias("mass"))


def quality(prior: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Six features of each (query, step): largest cell, inside, outside, entropy of the cells, entropy of the weights, best similarity."""
    cell = F.when(F.col("child") >= 0, F.col("mass"))
    p = prior.withColumn("inside", F.coalesce(F.sum(cell).over(Window.partitionBy("query_id", "step")), F.lit(0.0)))
    share = F.when(F.col("child") >= 0, F.col("mass") / F.greatest("inside", F.lit(1e-9)))
    cells = p.groupBy("query_id", "step").agg(
        F.coalesce(F.max(cell), F.lit(0.0)).alias("largest"), F.first("inside").alias("inside"),
        F.coalesce(F.sum(F.when(F.col("child") < 0, F.col("mass"))), F.lit(0.0)).alias("outside"),
        F.coalesce(-F.sum(share * F.log(F.greatest(share, F.lit(1e-9)))), F.lit(0.0)).alias("cell_entropy"),
    )
    a = neighbours.groupBy("query_id").agg((-F.sum(F.col("alpha") * F.log(F.greatest("alpha", F.lit(1e-9))))).alias("weight_entropy"), F.max("sim").alias("top"))
    return cells.join(a, "query_id")


def bias(prior: DataFrame, gate: float, negative: DataFrame | None = None, negative_gate: float = 0.0, eps: float = EPS) -> DataFrame:
    """query_id, step, child, bias: gate times the log mass, less the negative prior's; children without mass have gate * log(eps)."""
    out = prior
    if negative is not None:
        out = prior.join(negative.withColumnRenamed("mass", "neg"), ["query_id", "step", "child"], "full")
    neg = F.coalesce(F.col("neg"), F.lit(0.0)) if negative is not None else F.lit(0.0)
    value = gate * F.log(F.coalesce("mass", F.lit(0.0)) + eps) - negative_gate * F.log(neg + eps) * (1.0 if negative is not None else 0.0)
    return out.select("query_id", "step", "child", value.alias("bias"))


def merged_sink(base: Column, extra: Column, gate: float) -> Column:
    """A sink logit moved towards the log-sum-exp with further sink keys."""
    return base + gate * (vectors.let(F.concat(F.array(base), extra), vectors.log_sum_exp) - base)


def beam_search(queries: DataFrame, logits: Callable[[Column, Column, Column, Column, int], Column], beams: int = 16, top_m: int = 16, steps: int = geo.STEPS, sink: bool = False, prune: float = 1.0, score_steps: int | None = None) -> DataFrame:
    """query_id, beam, score, path, z, x, y: the beams that survive, the best first.

    logits(query_id, z, x, y, step) gives an array for the children (and the sink last, where there is one). The sink stays in the
    softmax and is never expanded; beams with a sink chance of prune or more only fill up what the others leave. All queries keep
    the same number of beams. Steps from score_steps on add nothing and expand to the best child only. Ties go to the earlier beam, then the lower action.
    A step is one projection and one window over each query's candidates.
    """
    n_act = geo.actions()
    now = queries.select("query_id", F.lit(0).alias("beam"), F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("path"), *(F.lit(0).cast("long").alias(c) for c in "zxy"))
    width = 1
    for t in range(steps):
        counts = score_steps is None or t < score_steps
        m = min(top_m, n_act) if counts else 1
        width = min(width * m, beams)
        lp = now.withColumn("lp", vectors.log_softmax(logits(F.col("query_id"), F.col("z"), F.col("x"), F.col("y"), t)))
        dead = (F.exp(F.get("lp", F.lit(n_act))) >= prune) if sink else F.lit(False)
        ranked = F.slice(
            F.array_sort(F.transform(F.slice("lp", 1, n_act), lambda v, i: F.struct((-v).alias("cost"), i.cast("long").alias("action")))), 1, m
        )
        c = lp.withColumn("dead", dead).withColumn("c", F.explode(ranked))
        c = c.withColumn("total", F.col("score") - F.col("c.cost") * (1.0 if counts else 0.0))
        order = Window.partitionBy("query_id").orderBy("dead", F.desc("total"), "beam", "c.action")
        c = c.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < width)
        x, y = geo.child("x", "y", F.col("c.action"))
        now = c.select("query_id", F.col("place").alias("beam"), F.col("total").alias("score"), F.concat("path", F.array("c.action")).alias("path"), (F.col("z") + geo.bits()).alias("z"), x.alias("x"), y.alias("y"))
    return now


def click(beams: DataFrame, u: Column, v: Column) -> DataFrame:
    """beams with lat and lon: each tile's place at the sigmoid of two scores."""
    s = [1 / (1 + F.exp(-c)) for c in (u, v)]
    return beams.withColumns({"lat": geo.tile_lat("z", "y", s[1]), "lon": geo.tile_lon("z", "x", s[0])})


def siblings(targets: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """row_id, draw, step, action: off-path siblings at steps 1 and 2, never the true one; drawn by md5 of (seed, row, draw)."""
    def number(label: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(label), "row_id", "draw")), 1, 8), 16, 10).cast("long")

    d = targets.select("row_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("step", (1 + number("t") % 2).cast("int"))
    true = targets.where(F.col("step").between(0, 1)).select("row_id", (F.col("step") + 1).cast("int").alias("step"), F.col("action").alias("true"))
    a = number("a") % (geo.actions() - 1)
    return d.join(true, ["row_id", "step"]).select("row_id", "draw", "step", F.when(a >= F.col("true"), a + 1).otherwise(a).alias("action"))


def dropped(neighbours: DataFrame, share: float, seed: int = 17, tau: float = TAU) -> DataFrame:
    """neighbours with alpha when each is hidden with this chance, as training would: softmax over what is left, 0 for the rest.

    A query that would lose all keeps one, drawn and not the best. Draws are md5 of (seed, query, row). A query's neighbours are few.
    """
    def draw(label: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(label), "query_id", "row_id")), 1, 8), 16, 10).cast("long") / float(1 << 32)

    by = Window.partitionBy("query_id")
    d = neighbours.withColumns({"__keep": draw("d") >= share, "__rescue": draw("r")})
    lone = ~F.max("__keep").over(by) & (F.row_number().over(by.orderBy("__rescue", "row_id")) == 1)
    d = d.withColumn("kept", F.col("__keep") | lone).withColumn("__s", F.when(F.col("kept"), F.col("sim") / max(tau, TAU_FLOOR)))
    d = d.withColumn("__e", F.coalesce(F.exp(F.col("__s") - F.max("__s").over(by)), F.lit(0.0)))
    return d.withColumn("alpha", F.col("__e") / F.sum("__e").over(by)).drop("__keep", "__rescue", "__s", "__e")


def gated_bias(prior: DataFrame, gates: DataFrame, shifts: DataFrame | None = None, negative: DataFrame | None = None, eps: float = EPS) -> DataFrame:
    """query_id, step, child, bias with gates of a step's own: cells by `cell`, the outside by `sink`; shifts (query_id, step, cell_shift, sink_shift) move
    both for one query; a negative prior counts with the gate `neg`. A few rows for each step, so gates travel."""
    out = prior.select("query_id", "step", "child", "mass")
    if negative is not None:
        out = out.join(negative.select("query_id", "step", "child", F.col("mass").alias("neg_mass")), ["query_id", "step", "child"], "full")
    out = out.join(F.broadcast(gates), "step")
    if shifts is not None:
        out = out.join(shifts, ["query_id", "step"], "left")
    cell, sink = (F.col(c) + (F.coalesce(f"{c}_shift", F.lit(0.0)) if shifts is not None else F.lit(0.0)) for c in ("cell", "sink"))
    value = F.when(F.col("child") >= 0, cell).otherwise(sink) * F.log(F.coalesce("mass", F.lit(0.0)) + eps)
    if negative is not None:
        value -= F.col("neg") * F.log(F.coalesce("neg_mass", F.lit(0.0)) + eps)
    return out.select("query_id", "step", "child", value.alias("bias"))


def policy_logits(query: Column, keys: Column, width: int) -> Column:
    """A query's scaled products with keys (an array of vectors of that width)."""
    return F.transform(keys, lambda k: vectors.dot(query, k) / float(width) ** 0.5)


def composed(policy: DataFrame, *priors: tuple[DataFrame, Column]) -> DataFrame:
    """query_id, step, child, score: the policy's logit plus every prior's bias, in order; a child that a prior lacks gets its default. The one place where scores are put together."""
    out = policy.select("query_id", "step", "child", F.col("logit").alias("score"))
    for biases, missing in priors:
        b = biases.select("query_id", "step", "child", "bias")
        out = out.join(b, ["query_id", "step", "child"], "left").select("query_id", "step", "child", (F.col("score") + F.coalesce("bias", missing)).alias("score"))
    return out


def with_fallback(wanted: DataFrame, cached: DataFrame, keys: list[str], value: str, live: Column, width: int | None = None) -> DataFrame:
    """wanted with value and live: from the cache where an entry is done (cached has done), else made on the spot. Both have the same width, if one is given."""
    have = cached.where("done").select(*keys, F.col(value).alias("__cached"))
    out = wanted.join(have, keys, "left").withColumn("live", F.col("__cached").isNull()).withColumn(value, F.coalesce("__cached", live)).drop("__cached")
    if width is not None:
        out = out.withColumn(value, F.when(F.size(value) == width, F.col(value)).otherwise(F.raise_error(F.lit(f"an entry is not {width} wide"))))
    return out

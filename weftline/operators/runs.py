"""Curves of training runs: best and final values, throughput, divergence, noise floors, plateaus and scaling fits.

metrics: run_id, line_no (place in the run's log, which a resumed run goes on with), step, and value columns that may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(metrics: DataFrame, value: str = "val_loss") -> DataFrame:
    """One row a run: least value (the earliest of equals) and its step, first, last in file order, mean, and the gaps.

    A drift from a first value of 0 is infinite in percent, and no number where there is no drift.
    """
    v = F.col(value)
    known = metrics.where(v.isNotNull())
    out = known.groupBy("run_id").agg(
        F.min(F.struct(v.alias("v"), "line_no", "step")).alias("_b"),
        F.min_by(v, "line_no").alias("first"),
        F.max_by(v, "line_no").alias("final"),
        F.avg(v).alias("mean"),
        F.count("*").alias("points"),
    )
    best, first, drift = F.col("_b.v"), F.col("first"), F.col("final") - F.col("first")
    percent = F.when(first != 0, 100 * drift / first).otherwise(100 * drift * F.pow(first, F.lit(-1.0)))  # a plain division by 0 is an error
    return out.select("run_id", best.alias("best"), F.col("_b.step").alias("best_step"), "first", "final", "mean", "points", (F.col("final") - best).alias("overfit_gap"), drift.alias("drift"), percent.alias("drift_percent"))


def steady(metrics: DataFrame, value: str = "tok_s", skip: int = 2, least: int = 4) -> DataFrame:
    """Mean of a rate without the first points of a run, which are kept only in runs of few points."""
    w = Window.partitionBy("run_id")
    ranked = metrics.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy("line_no"))).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_n") <= least) | (F.col("_k") > skip)).groupBy("run_id").agg(F.avg(value).alias("steady"), F.count("*").alias("points"))


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def leaderboard(metrics: DataFrame, losses: list[str], value: str = "val_loss") -> DataFrame:
    """Best value of each run, null for a run with any loss that isn't finite; ``winner`` is the least of the rest, by run_id on ties."""
    bad = F.lit(False)
    for c in losses:
        bad = bad | F.coalesce(~is_finite(F.col(c)), F.lit(False))
    each = metrics.groupBy("run_id").agg(F.bool_or(bad).alias("diverged"), F.min(F.when(is_finite(F.col(value)), F.col(value))).alias("best"))
    each = each.withColumn("best", F.when(~F.col("diverged"), F.col("best")))
    top = each.where("best IS NOT NULL").orderBy("best", "run_id").limit(1).select(F.col("run_id").alias("_w"))
    return each.join(F.broadcast(top), each["run_id"] == top["_w"], "left").select("run_id", "diverged", "best", F.col("_w").isNotNull().alias("winner"))  # one row


def noise_floor(bests: DataFrame, group: str, value: str = "best") -> DataFrame:
    """Mean, population deviation and spread over the runs of a group that differ by seed only."""
    return bests.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("spread"), F.count("*").alias("runs"))


def verdict(delta: Column, floor: float = 0.015) -> Column:
    return F.when(F.abs(delta) <= floor, "noise").when(delta < 0, "better").otherwise("worse")


def against(bests: DataFrame, control, value: str = "best") -> DataFrame:
    """Difference to the control run; no rows where there is none, an error where several have its id."""
    base = bests.where(F.col("run_id") == control).agg(F.max(value).alias("control"), F.count("*").alias("_n"))
    base = base.where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"more than one run {control}"))).otherwise(F.col("_n") == 1)).drop("_n")
    return bests.crossJoin(F.broadcast(base)).withColumn("delta", F.col(value) - F.col("control"))  # one row


def plateau(sweep: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """A sweep by doubling stops after the first point that gains less than the tolerance on the best before; which point is the fastest till then.

    sweep: run_id, k (order), rate.
    """
    order = Window.partitionBy("run_id").orderBy("k")
    before = F.max("rate").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flat = sweep.withColumn("_flat", F.coalesce((F.col("rate") < before * (1 + tolerance)).cast("int"), F.lit(0)))
    stopped = F.coalesce(F.sum("_flat").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = flat.withColumn("_stopped", stopped).where("_stopped = 0")
    return kept.groupBy("run_id").agg(F.count("*").alias("tried"), F.max(F.struct(F.col("rate"), (-F.col("k")).alias("_k"))).alias("_m")).select("run_id", "tried", (-F.col("_m._k")).alias("sweet_spot"), F.col("_m.rate").alias("rate"))


def power_law(points: DataFrame, grid: int = 400, top: float = 0.98) -> DataFrame:
    """a, alpha, c and squared error of the best fit of loss = a * n^-alpha + c over a grid of c below the least loss.

    points: n, loss. For each c the logarithms are fitted by the engine's own regression; the grid is a fixed number of rows.
    """
    low = points.agg(F.min("loss").alias("low"))
    cs = points.sparkSession.range(grid).select(F.col("id").alias("k")).crossJoin(F.broadcast(low)).select("k", (F.col("low") * top * F.col("k") / (grid - 1)).alias("c"))
    full = points.crossJoin(F.broadcast(cs)).where("loss > c")  # the grid of 400 rows, by the runs
    fits = full.groupBy("k", "c").agg(F.regr_slope(F.log(F.col("loss") - F.col("c")), F.log("n")).alias("s"), F.regr_intercept(F.log(F.col("loss") - F.col("c")), F.log("n")).alias("i"))
    guess = F.exp("i") * F.pow("n", F.col("s")) + F.col("c")
    errors = points.crossJoin(F.broadcast(fits)).groupBy("k", "c", "s", "i").agg(F.sum(F.pow(guess - F.col("loss"), F.lit(2))).alias("sse"))
    return errors.orderBy("sse", "k").limit(1).select(F.exp("i").alias("a"), (-F.col("s")).alias("alpha"), "c", "sse")


def costs(runs: DataFrame, rate: str = "usd_hour") -> DataFrame:
    """Hours, cost and speed-up to the slowest of the tier. runs: run_id, tier, tokens, tok_s, usd_hour."""
    hours = F.col("tokens") / F.col("tok_s") / 3600
    slow = F.min("tok_s").over(Window.partitionBy("tier"))
    return runs.withColumn("hours", hours).withColumn("usd", hours * F.col(rate)).withColumn("speed_up", F.col("tok_s") / slow)


def usage(metrics: DataFrame, rate: str = "tok_s", memory: str = "mem_gb") -> DataFrame:
    """Mean rate, mean and greatest memory of each run, over the points that have them."""
    return metrics.groupBy("run_id").agg(F.avg(rate).alias("mean_rate"), F.avg(memory).alias("mean_memory"), F.max(memory).alias("peak_memory"))


def expert_loads(loads: DataFrame, by: list[str]) -> DataFrame:
    """by, expert, mean load over layers and points, and the spread between the layers' means. loads: by, load (array of layers, each an array of experts)."""
    each = loads.select(*by, F.posexplode("load").alias("layer", "experts")).select(*by, "layer", F.posexplode("experts").alias("expert", "x"))
    layers = each.groupBy(*by, "layer", "expert").agg(F.avg("x").alias("m"), F.sum("x").alias("s"), F.count("x").alias("n"))
    return layers.groupBy(*by, "expert").agg((F.sum("s") / F.sum("n")).alias("load"), (F.max("m") - F.min("m")).alias("spread"), F.count("*").alias("layers"))

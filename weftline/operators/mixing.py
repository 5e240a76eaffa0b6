"""Draws of training windows from weighted sources, each a function of seed, step and slot only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.session import materialise
from weftline.functions.text import unit_interval


def draws(weights: DataFrame, steps: int, slots: int, seed: int) -> DataFrame:
    """step, slot, source: each slot draws a source by weight. weights: source, weight; a fixed small table.

    Any step can be computed again by itself, whatever was drawn before.
    """
    rows = sorted((r["source"], r["weight"]) for r in weights.where("weight > 0").select("source", "weight").collect())
    if not rows:
        raise ValueError("no source has a positive weight")
    total = sum(w for _, w in rows)
    u = unit_interval(seed, F.col("step"), F.col("slot"))
    pick, run = None, 0.0
    for s, w in rows[:-1]:
        run += w / total
        pick = F.when(u < run, s) if pick is None else pick.when(u < run, s)
    source = F.lit(rows[-1][0]) if pick is None else pick.otherwise(rows[-1][0])
    grid = weights.sparkSession.range(steps * slots).select(F.expr(f"id div {slots}").alias("step"), (F.col("id") % slots).alias("slot"))
    return grid.withColumn("source", source)


def windows(drawn: DataFrame, spans: DataFrame, length: int, seed: int) -> DataFrame:
    """A document with room for the window and a start within it, for each draw.

    spans: source, doc_no (0.. within source, of documents longer than length), doc_id, tokens. Documents are joined by number.
    """
    count = materialise(spans.groupBy("source").agg(F.count("*").alias("docs")), "counts")  # its true size decides how it is joined
    at = drawn.join(count, "source").withColumn("doc_no", F.floor(unit_interval(seed + 1, F.col("step"), F.col("slot")) * F.col("docs")).cast("bigint"))
    start = F.floor(unit_interval(seed + 2, F.col("step"), F.col("slot")) * (F.col("tokens") - length)).cast("bigint")
    return at.join(spans, ["source", "doc_no"]).withColumn("start", start).select("step", "slot", "source", "doc_id", "start")

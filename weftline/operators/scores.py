"""Evaluation over tables of token log-probabilities, choices, generations and preferences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.functions.session import cut, materialise


def bigram_model(tokens: DataFrame) -> DataFrame:
    """Smoothed log-probability of each word after the one before, a small stand-in for a model's output.

    tokens: source, words (array). Returns source, a, b, n (how often), logprob. Pairs are counted where the documents are and shuffled as counts.
    """
    spaced = tokens.select("source", F.explode(F.arrays_zip(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))).alias("p"))
    each = materialise(spaced.groupBy("source", "p.a", "p.b").agg(F.count("*").alias("n")), "pairs")
    both = each.groupBy("a", "b").agg(F.sum("n").alias("ab"))
    one = both.groupBy("a").agg(F.sum("ab").alias("na"))
    size = each.agg(F.countDistinct("b").alias("v"))
    table = both.join(one, "a").crossJoin(F.broadcast(size))  # one row
    return each.join(table.select("a", "b", F.log((F.col("ab") + 1) / (F.col("na") + F.col("v"))).alias("logprob")), ["a", "b"])


def perplexities(logprobs: DataFrame, by: str, size: DataFrame | None = None) -> DataFrame:
    """Tokens, summed loss, perplexity weighted by tokens, and bits a byte where ``size`` (by, bytes) is given. logprobs: by, logprob, n (tokens that have it)."""
    out = logprobs.groupBy(by).agg(F.sum("n").alias("tokens"), (-F.sum(F.col("n") * F.col("logprob"))).alias("nll"))
    out = out.withColumn("perplexity", F.exp(F.col("nll") / F.col("tokens")))
    return out if size is None else out.join(size, by).withColumn("bits_per_byte", F.col("nll") / math.log(2) / F.col("bytes")).drop("bytes")


def mean_of_batches(rows: DataFrame, batch: str, value: str, by: list[str]) -> DataFrame:
    """Mean of batch means, which weighs a short last batch like the others, beside the plain mean."""
    each = rows.groupBy(*by, batch).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return each.groupBy(*by).agg(F.avg("m").alias("mean_of_batches"), (F.sum("s") / F.sum("n")).alias("mean"))


def choose(scored: DataFrame) -> DataFrame:
    """The choice of the greatest mean log-probability, the first of equals. scored: item_id, choice, score; ties by choice."""
    return scored.groupBy("item_id").agg((-F.max(F.struct("score", (-F.col("choice")).alias("k")))["k"]).alias("picked"))


def accuracy(picked: DataFrame, by: str) -> DataFrame:
    """Share of right picks by category and over all. picked: category, correct (boolean)."""
    return picked.rollup(by).agg(F.count("*").alias("items"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.grouping(by).alias("_g")).select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "items", "accuracy")


def stops(generations: DataFrame, end: Column, budget: int, by: list[str] = ()) -> DataFrame:
    """Share of generations that hold the end mark, and the mean length before it (the budget where there is none), by some columns or over all. generations: tokens."""
    at = F.array_position(F.slice("tokens", 1, budget), end)
    return generations.groupBy(*by).agg(F.count("*").alias("n"), F.avg((at > 0).cast("double")).alias("stop_rate"), F.avg(F.when(at > 0, at - 1).otherwise(budget)).alias("mean_length"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Bins by confidence (the last takes 1.0) with mean confidence and accuracy, and each bin's share of the calibration error."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("bigint")
    each = predictions.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # as many rows as bins
    return each.withColumn("error", F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / total)


def preference(pairs: DataFrame, by: str, beta: float = 0.1) -> DataFrame:
    """Loss, reward margin, strict accuracy and drift of preference pairs, with the accuracy that needs no reference model.

    pairs: policy_chosen, policy_rejected, ref_chosen, ref_rejected log-probabilities. Equal rewards count as wrong.
    """
    rc, rr = beta * (F.col("policy_chosen") - F.col("ref_chosen")), beta * (F.col("policy_rejected") - F.col("ref_rejected"))
    z = rc - rr
    loss = F.when(z >= 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z)))
    return pairs.groupBy(by).agg(
        F.count("*").alias("pairs"), F.avg(loss).alias("loss"), F.avg(z).alias("margin"), F.avg((rc > rr).cast("double")).alias("accuracy"),
        F.avg(F.col("policy_chosen") - F.col("ref_chosen")).alias("kl_chosen"), F.avg(F.col("policy_rejected") - F.col("ref_rejected")).alias("kl_rejected"),
        F.avg((F.col("policy_chosen") > F.col("policy_rejected")).cast("double")).alias("preferred"), F.avg(F.col("policy_chosen") - F.col("policy_rejected")).alias("gap"),
    )


def _grams(tokens: Column, n: int) -> Column:
    """The windows of n as structs, put together from n shifted slices."""
    full = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return F.explode(F.arrays_zip(*(F.slice(tokens, k + 1, full).alias(f"_{k}") for k in range(n)))).alias("_gram")


def _tokens_before(rows: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    """``_before``: the last n - 1 tokens of the rows before, and ``_tail``: those up to and with the row. rows: _tail, never empty."""
    last = lambda c: F.slice(c, F.greatest(F.size(c) - n + 2, F.lit(1)), n - 1)
    before = last(F.concat(*(F.coalesce(F.lag("_tail", k).over(w), F.slice("_tail", 1, 0)) for k in range(n - 1, 0, -1))))
    return rows.withColumn("_before", before).withColumn("_tail", last(F.concat("_before", "_tail")))


def _crossing_grams(samples: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """by, _gram of the n-grams that begin in one sample and end in a later one.

    Only the first and last n - 1 tokens of a sample are moved. They are sorted in ranges, each handing its last tokens on to the next, so no
    task sorts a whole group.
    """
    tokens = F.col("tokens")
    ends = samples.where(F.size(tokens) > 0).select(by, order, F.slice(tokens, 1, n - 1).alias("_head"), F.slice(tokens, F.greatest(F.size(tokens) - n + 2, F.lit(1)), n - 1).alias("_tail"))
    at = F.col(order).asc_nulls_last()
    ranges = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(cut(ends).repartitionByRange(ranges, F.col(by), at).withColumn("_range", F.spark_partition_id()))  # sorting reads its rows twice
    w = Window.partitionBy(by, "_range").orderBy(at)
    own = _tokens_before(placed, w, n).withColumn("_ends", F.lead(F.lit(True)).over(w).isNull())
    handed = _tokens_before(own.where("_ends").select(by, "_range", "_tail"), Window.partitionBy(by).orderBy("_range"), n)  # groups x ranges rows
    handed = handed.select(F.col(by).alias("_by"), F.col("_range").alias("_in"), F.col("_before").alias("_handed"))
    both = own.join(handed, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_in")))
    lead = F.concat("_handed", "_before")
    return both.select(by, F.slice(lead, F.greatest(F.size(lead) - n + 2, F.lit(1)), n - 1).alias("_lead"), "_head").select(by, _grams(F.concat("_lead", "_head"), n))


def diversity_of_groups(samples: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Different n-grams over n-grams of each group's samples laid end to end; 0 for fewer than n tokens.

    samples: by, order, tokens. The n-grams within a sample are counted where it lies, so neither a group nor a sample is ever moved.
    """
    grams = samples.select(by, _grams(F.col("tokens"), n))
    if n > 1:
        grams = grams.unionByName(_crossing_grams(samples, by, order, n))
    each = grams.groupBy(by, *(F.col(f"_gram._{k}").alias(f"_{k}") for k in range(n))).agg(F.count("*").alias("k"))
    each = each.groupBy(by).agg(F.count("*").alias("distinct"), F.sum("k").alias("total"))
    none = samples.select(by).distinct().select(by, F.lit(0).cast("bigint").alias("distinct"), F.lit(0).cast("bigint").alias("total"))
    sums = each.unionByName(none).groupBy(by).agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total"))
    return sums.select(by, F.when(F.col("total") > 0, F.col("distinct") / F.col("total")).otherwise(0.0).alias(f"distinct_{n}"))


def softmax_top(scores: DataFrame, k: int, row: str = "vec_id") -> DataFrame:
    """The k most probable positions of each row with their probability among all and among themselves. scores: row, position, score."""
    w = Window.partitionBy(row)
    p = scores.withColumn("p", F.exp(F.col("score") - F.max("score").over(w))).withColumn("p", F.col("p") / F.sum("p").over(w))
    top = p.withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "position"))).where(F.col("rank") <= k)
    return top.withColumn("gate", F.col("p") / F.sum("p").over(w))


def nucleus(scores: DataFrame, share: float, row: str = "vec_id") -> DataFrame:
    """The most probable positions up to and with the one whose running sum reaches the share."""
    w = Window.partitionBy(row)
    p = scores.withColumn("p", F.exp(F.col("score") - F.max("score").over(w))).withColumn("p", F.col("p") / F.sum("p").over(w))
    run = F.sum("p").over(w.orderBy(F.desc("p"), "position").rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("before", F.coalesce(run, F.lit(0.0))).where(F.col("before") <= share).drop("before")


def log_softmax_at(logits: Column, place: Column) -> Column:
    """Logarithm of the softmax of an array at a place (from 0)."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.element_at(logits, (place + 1).cast("int")) - top - F.log(total)

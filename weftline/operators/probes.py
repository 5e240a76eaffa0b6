"""Items that probe a model, and what is read off its scores of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.session import materialise
from weftline.functions.text import order_key
from weftline.operators.corpus import running_before


def _draw(seed: int, *ids: Column) -> Column:
    return F.conv(F.substring(order_key(seed, *ids), 1, 13), 16, 10).cast("bigint")


def with_distractors(entries: DataFrame, seed: int, n: int = 3) -> DataFrame:
    """item_id, choice (0 to n), definition, gold: each entry's own definition among n others, in a seeded order.

    entries: item_id, definition. The different definitions stand on a ring in the order of a hash; an entry takes those at n different steps from its
    own, so no definition meets all others and each comes by an equal join. With fewer than n others all of them are taken.
    """
    ring = entries.where(F.col("definition").isNotNull()).select("definition").distinct().withColumn("_key", order_key(seed, F.col("definition"))).withColumn("_all", F.lit(0))
    ring = materialise(running_before(ring, F.lit(1), ["_key", "definition"], ["_all"], "at").select("definition", "at"), "ring")
    size = ring.count()
    others = max(size - 1, 1)
    start = F.pmod(_draw(seed + 1, F.col("item_id")), F.lit(others))
    step = F.pmod(_draw(seed + 2, F.col("item_id")), F.lit(max(1, (size - 2) // n))) + 1
    own = entries.join(ring, "definition").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(min(n, size - 1)))).alias("k"), "at", start.alias("start"), step.alias("step"))
    place = F.when(F.col("k") == 0, F.col("at")).otherwise(F.pmod(F.col("at") + 1 + F.pmod(F.col("start") + (F.col("k") - 1) * F.col("step"), F.lit(others)), F.lit(max(size, 1))))
    picked = own.select("item_id", "k", place.alias("at")).join(ring, "at")
    listed = picked.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(order_key(seed + 3, F.col("item_id"), F.col("k")).alias("key"), "k", "definition"))).alias("choices"))
    return listed.select("item_id", F.posexplode("choices").alias("choice", "c")).select("item_id", "choice", "c.definition", (F.col("c.k") == 0).alias("gold"))


def continuation(encode: Callable[[Column], Column], prompt: Column, rest: Column) -> tuple[Column, Column]:
    """Tokens of the prompt, and of prompt and rest together those after as many; encoding the rest on its own could part it otherwise at the seam."""
    head, full = encode(prompt), encode(F.concat(prompt, rest))
    return head, F.slice(full, F.size(head) + 1, F.greatest(F.size(full) - F.size(head), F.lit(0)))


def greedy_match(steps: DataFrame) -> DataFrame:
    """item_id, exact: whether at each place the most probable token is the wanted one. steps: item_id, best, wanted."""
    return steps.groupBy("item_id").agg(F.bool_and(F.coalesce(F.col("best") == F.col("wanted"), F.lit(False))).alias("exact"))


def sequence_logprobs(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Sum and number of the log-probabilities of the tokens that count. tokens: by, logprob, target (null: doesn't count)."""
    counts = F.col("target").isNotNull()
    return tokens.groupBy(*by).agg(F.coalesce(F.sum(F.when(counts, F.col("logprob"))), F.lit(0.0)).alias("logprob"), F.sum(counts.cast("bigint")).alias("tokens"))


def documents_at(offsets: DataFrame, spans: DataFrame, width: int = 4096) -> DataFrame:
    """The document whose span holds a place. offsets: at; spans: doc_id, start, end (without overlap), both in tokens of the whole.

    A span stands in each stretch of ``width`` tokens that it touches, so a place meets the few spans of its stretch by an equal join.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    touched = spans.where("end > start").withColumn("_cell", F.explode(F.sequence(cell("start"), F.floor((F.col("end") - 1) / width))))
    return offsets.withColumn("_cell", cell("at")).join(touched, "_cell").where("start <= at AND at < end").drop("_cell")


def loss_by_length(rows: DataFrame) -> DataFrame:
    """Perplexity for each length of context, and its ratio to the shortest. rows: seq_len, loss, tokens."""
    each = rows.groupBy("seq_len").agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("loss"))
    least = each.agg(F.min_by("loss", "seq_len").alias("_least"))
    return each.crossJoin(F.broadcast(least)).select("seq_len", F.exp("loss").alias("perplexity"), F.exp(F.col("loss") - F.col("_least")).alias("ratio"))  # one row

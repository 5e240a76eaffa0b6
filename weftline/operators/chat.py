"""Conversations to text and to token rows with a loss mask, training batches, and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import order_key, strip, words
from weftline.operators.corpus import batches

# Marks of the chat template.
USER, ASSISTANT, END = "<|user|>", "<|assistant|>", "<|endoftext|>"


def _turns(messages: DataFrame) -> DataFrame:
    """Turns of known roles in order, by conversation; others are left out and counted."""
    known = F.col("role").isin("user", "assistant")
    return messages.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(known, F.struct("turn", "role", "text")))).alias("turns"), F.sum((~known).cast("bigint")).alias("dropped_turns")
    )


def role_problems(messages: DataFrame, known: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The messages with ``problem``: why a turn can't be rendered (no role, an unknown role, no text), null for a sound one."""
    role = F.col("role")
    problem = F.when(role.isNull(), "missing role").when(~role.isin(*known), F.concat(F.lit("unknown role '"), role, F.lit("'"))).when(F.col("text").isNull(), "missing text")
    return messages.withColumn("problem", problem)


def render(messages: DataFrame, generation_prompt: bool = False) -> DataFrame:
    """conv_id, chat, dropped_turns. With ``generation_prompt`` a conversation ending on a user's turn ends with the assistant's mark."""
    t = _turns(messages)
    one = lambda m: F.when(m["role"] == "user", F.concat(F.lit(USER), m["text"])).otherwise(F.concat(F.lit(ASSISTANT), m["text"], F.lit(END)))
    chat = F.array_join(F.transform("turns", one), "")
    if generation_prompt:
        chat = F.concat(chat, F.when(F.try_element_at("turns", F.lit(-1))["role"] == "user", ASSISTANT).otherwise(""))
    return t.select("conv_id", chat.alias("chat"), "dropped_turns")


def masked(messages: DataFrame, tokens=words, supervise_end: bool = True, generation_prompt: bool = False) -> DataFrame:
    """conv_id, tokens and mask (1: to be learned): the assistant's words and end mark count, everything else is context."""
    t = _turns(messages)

    def piece(m: Column, mask: bool) -> Column:
        ids = tokens(F.coalesce(m["text"], F.lit("")))
        if mask:
            own = F.transform(ids, lambda _: F.when(m["role"] == "assistant", 1).otherwise(0))
            return F.when(m["role"] == "user", F.concat(F.array(F.lit(0)), own)).otherwise(F.concat(F.array(F.lit(0)), own, F.array(F.lit(int(supervise_end)))))
        return F.when(m["role"] == "user", F.concat(F.array(F.lit(USER)), ids)).otherwise(F.concat(F.array(F.lit(ASSISTANT)), ids, F.array(F.lit(END))))

    ids, mask = F.flatten(F.transform("turns", lambda m: piece(m, False))), F.flatten(F.transform("turns", lambda m: piece(m, True)))
    if generation_prompt:
        ends = F.try_element_at("turns", F.lit(-1))["role"] == "user"
        ids, mask = F.when(ends, F.array_append(ids, F.lit(ASSISTANT))).otherwise(ids), F.when(ends, F.array_append(mask, F.lit(0))).otherwise(mask)
    return t.select("conv_id", ids.alias("tokens"), mask.alias("mask"))


def truncated(examples: DataFrame, longest: int) -> DataFrame:
    """Cut to the longest length, then drop examples with nothing left to learn."""
    cut = examples.withColumn("tokens", F.slice("tokens", 1, longest)).withColumn("mask", F.slice("mask", 1, longest))
    return cut.where(F.aggregate("mask", F.lit(0), lambda a, x: a + x) > 0)


def collated(examples: DataFrame, batch: list[str], pad: str = END) -> DataFrame:
    """Inputs and targets of each example, padded to the longest of its batch; a target not to be learned is null.

    examples: the batch columns, tokens, mask. The batch's length is an aggregate of numbers; the tokens stay where they are in the shuffle.
    """
    longest = examples.groupBy(*batch).agg((F.max(F.size("tokens")) - 1).alias("width"))
    return padded(examples.join(longest, batch), pad)


def padded(full: DataFrame, pad: str = END) -> DataFrame:
    """Inputs and targets of examples that have their batch's width."""
    n = F.size("tokens")
    x = F.concat(F.slice("tokens", 1, n - 1), F.array_repeat(F.lit(pad), F.col("width") - n + 1))
    target = F.zip_with(F.slice("tokens", 2, n - 1), F.slice("mask", 2, n - 1), lambda t, m: F.when(m == 1, t))
    y = F.concat(target, F.array_repeat(F.lit(None).cast("string"), F.col("width") - n + 1))
    return full.withColumn("x", x).withColumn("y", y).withColumn("width", F.col("width").cast("bigint"))


def pairs_from_rows(rows: DataFrame) -> DataFrame:
    """Two turns, user and assistant, of each generated row; rows of one seed make one conversation in the order of arrival."""
    order = Window.partitionBy("seed_id").orderBy("ingested_at", "row_id")
    numbered = rows.where(F.col("seed_id").isNotNull()).withColumn("k", F.row_number().over(order) - 1)
    turn = lambda i, role, c: F.struct((F.col("k") * 2 + i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text"))
    return numbered.select(F.col("seed_id").alias("conv_id"), F.explode(F.array(turn(0, "user", "instruction"), turn(1, "assistant", "response"))).alias("m")).select("conv_id", "m.*")


def history(messages: DataFrame) -> DataFrame:
    """Each turn with the texts of all turns up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("so_far", F.collect_list(F.struct("role", "text")).over(w))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples of instruction, chosen and rejected, and counts of what found no partner or was identical.

    chosen: seed_id, line_no, instruction, response, word; the last line of a seed counts. rejected: row_id, seed_id, response, style.
    """
    last = chosen.groupBy("seed_id").agg(F.max_by(F.struct("instruction", "response", "word"), "line_no").alias("c")).select("seed_id", "c.*")
    last = last.withColumnRenamed("response", "chosen")
    j = rejected.withColumn("rejected", strip(F.col("response"))).drop("response").join(last, "seed_id", "left")
    same = F.lower("rejected") == F.lower(strip(F.col("chosen")))
    state = F.when(F.col("chosen").isNull(), "unmatched").when(F.col("rejected").isNull(), "no_response").when(same, "identical").otherwise("kept")
    j = j.withColumn("state", state)
    kept = j.where("state = 'kept'").select("row_id", "instruction", "chosen", "rejected", "word", F.coalesce("style", F.lit("?")).alias("failure_mode"))
    return kept, j.groupBy("state").agg(F.count("*").alias("n"))


def element_percentile(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """The element at floor(n * share) of the sorted values, and the largest; no interpolation.

    Equal values are counted together first, so the running count goes over distinct values only.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(value))
    ranked = counts.withColumn("end", run).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    picks = [F.min(F.when(F.col("end") > F.floor(F.col("total") * s), F.col(value))).alias(f"p{int(s * 100)}") for s in shares]
    return ranked.agg(*picks, F.max(value).alias("largest"))


def shuffled_batches(rows: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """Reproducible order of an epoch in batches of ``size``."""
    keyed = rows.withColumn("_key", order_key(seed + epoch, F.col(key))).withColumn("_all", F.lit(0))
    return batches(keyed, ["_key", key], ["_all"], size).drop("_key", "_all")


def collated_shuffle(examples: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """Examples by ``key`` in shuffled batches, collated. Only keys and lengths go through order and widths, tokens stay with their key."""
    b = shuffled_batches(examples.select(key, F.size("tokens").alias("_n")), key, seed, epoch, size)
    b = b.join(b.groupBy("batch_no").agg((F.max("_n") - 1).alias("width")), "batch_no").select(key, "batch_no", "width")
    return padded(examples.join(b, key))


def preference_batches(kept: DataFrame, longest: int, seed: int, epoch: int, size: int) -> DataFrame:
    """Pairs in shuffled batches, both sides encoded, cut and padded on their own. kept: row_id, instruction, chosen, rejected.

    Returns row_id, batch_no and width, x and y of either side; a pair one of whose sides has nothing to learn is dropped.
    """

    def side(c: str) -> DataFrame:
        turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("instruction").alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col(c).alias("text")))
        m = kept.select(F.col("row_id").alias("conv_id"), F.explode(turns).alias("m")).select("conv_id", "m.*")
        return truncated(masked(m), longest).select(F.col("conv_id").alias("row_id"), F.col("tokens").alias(f"tokens_{c}"), F.col("mask").alias(f"mask_{c}"))

    both = side("chosen").join(side("rejected"), "row_id")
    b = shuffled_batches(both.select("row_id", F.size("tokens_chosen").alias("_c"), F.size("tokens_rejected").alias("_r")), "row_id", seed, epoch, size)
    widths = b.groupBy("batch_no").agg((F.max("_c") - 1).alias("width_chosen"), (F.max("_r") - 1).alias("width_rejected"))
    full = both.join(b.join(widths, "batch_no").select("row_id", "batch_no", "width_chosen", "width_rejected"), "row_id")
    for c in ("chosen", "rejected"):
        full = padded(full.withColumnsRenamed({f"tokens_{c}": "tokens", f"mask_{c}": "mask", f"width_{c}": "width"}))
        full = full.withColumnsRenamed({"x": f"x_{c}", "y": f"y_{c}", "width": f"width_{c}"}).drop("tokens", "mask")
    return full

"""Cleaning, paragraph dedup, budgets, offsets, hold-out splits and statistics of a corpus of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.session import cut, ship


def clean(documents: DataFrame, newline: str = "unify") -> DataFrame:
    """Column ``text`` in normal form C, with blanks collapsed and ends cut.

    ``newline="preserve"`` leaves carriage returns alone, so texts with CRLF keep all their blank lines.
    """
    ship(documents.sparkSession)
    text = F.col("text") if newline == "preserve" else X.unify_newlines(F.col("text"))
    return documents.withColumn("text", X.strip(X.collapse_blanks(X.nfc(text))))


def paragraphs(documents: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """doc_id, pos, paragraph (trimmed) of every paragraph that is not blank."""
    parts = documents.select("doc_id", F.posexplode(F.split("text", delimiter)).alias("pos", "paragraph"))
    return parts.withColumn("paragraph", X.strip(F.col("paragraph"))).where("paragraph <> ''")


def dedup_paragraphs(documents: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """Paragraphs with ``kept``: the first of those that are equal within the document, ignoring case.

    The window is keyed by document and a hash of the paragraph, so the shuffle key has a fixed size.
    """
    key = Window.partitionBy("doc_id", F.xxhash64(F.lower("paragraph")), F.lower("paragraph")).orderBy("pos")
    return paragraphs(documents, delimiter).withColumn("kept", F.row_number().over(key) == 1)


def rebuild(deduped: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """doc_id, the text of the kept paragraphs in order, and how many were kept and dropped."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("pos", "paragraph"))))
    return deduped.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["paragraph"]), delimiter).alias("text"),
        F.sum(F.col("kept").cast("bigint")).alias("kept"),
        F.sum((~F.col("kept")).cast("bigint")).alias("dropped"),
    )


def running_before(df: DataFrame, value: Column, order: list[str], partition: list[str], alias: str, ranges: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of ``order`` within ``partition``, without one task for a whole partition.

    Rows are range-partitioned by all keys, into as many ranges as the session shuffles into unless told otherwise; each range's sum per partition
    is a few rows, whose own running sum is joined back. Rows are moved and written whole, so pass only the columns needed.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *partition, *order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    placed = cut(placed)
    sums = placed.groupBy(*partition, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_range", *partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = placed.withColumn("_own", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    joined = keyed.join(base, [*partition, "_range"])  # sources x ranges rows: small, and AQE may broadcast it
    return joined.withColumn(alias, (F.col("_base") + F.col("_own")).cast("bigint")).drop("_base", "_own", "_value", "_range")


def byte_budget(documents: DataFrame, budget: int, separator: int = 2) -> DataFrame:
    """Documents in the order of doc_id whose bytes before them (with separators) are below the budget. Only ids and sizes are moved and summed up."""
    sized = documents.select("doc_id", (F.octet_length("text") + separator).alias("_size"), F.lit(0).alias("_all"))
    total = running_before(sized, F.col("_size"), ["doc_id"], ["_all"], "bytes_before")
    return documents.join(total.where(F.col("bytes_before") < budget).select("doc_id", "bytes_before"), "doc_id")


def source_name(source: Column) -> Column:
    return F.lower(F.trim(source))


def stats_by_source(documents: DataFrame) -> DataFrame:
    """Documents, characters, words and estimated tokens by source, with a TOTAL row."""
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    sized = documents.select(source_name(F.col("source")).alias("source"), chars.alias("chars"), X.n_words(F.col("text")).alias("words"))
    out = sized.rollup("source").agg(
        F.grouping("source").alias("_total"), F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("words").alias("words")
    )
    name = F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("source"))
    return out.select(name.alias("source"), "documents", "chars", "words", F.expr("chars div 4").alias("est_tokens"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Types that were built anew replace their old rows, other types keep theirs."""
    return old.join(new.select("type").distinct(), "type", "left_anti").unionByName(new, allowMissingColumns=True)


def holdout_by_word(entries: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The leaking split: entries are drawn, but a side holds all entries of its words, so a word can be on both.

    entries: entry_id, word. Returns them with ``side``.
    """
    held = int(entries.count() * fraction)
    keyed = entries.select("entry_id", "word", X.order_key(seed, F.col("entry_id")).alias("_key"), F.lit(0).alias("_all"))
    ranked = running_before(keyed, F.lit(1), ["_key", "entry_id"], ["_all"], "_rank")
    name = F.when(F.col("_rank") < held, "val").otherwise("train")
    sides = ranked.groupBy("word").agg(F.collect_set(name).alias("_sides"))  # two names at most
    return entries.join(sides, "word").withColumn("side", F.explode("_sides")).drop("_sides")


def holdout_by_key(entries: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A word's entries go to one side together, by a hash of the word; no shuffle at all."""
    held = X.unit_interval(seed, F.col("word")) < fraction
    return entries.withColumn("side", F.when(held, "val").otherwise("train"))


def seeded_cut(rows: DataFrame, keys: list[str], percent: int, seed: int) -> DataFrame:
    """Shuffle by hash, then the first percent (rounded half to even) is train.

    The rank comes from a two-step running count, so no single task sorts all rows.
    """
    n = rows.count()
    cut_at = int(rows.sparkSession.range(1).select(F.bround(F.lit(n * percent / 100))).first()[0])
    keyed = rows.withColumn("_key", X.order_key(seed, *(F.col(k) for k in keys))).withColumn("_all", F.lit(0))
    ranked = running_before(keyed, F.lit(1), ["_key", *keys], ["_all"], "_rank")
    return ranked.withColumn("side", F.when(F.col("_rank") < cut_at, "train").otherwise("val")).drop("_key", "_all", "_rank")


def batches(rows: DataFrame, order: list[str], partition: list[str], size: int) -> DataFrame:
    """Number rows from 0 within a partition and put them into batches of ``size``, the last may be short."""
    at = running_before(rows, F.lit(1), order, partition, "row_no")
    return at.withColumn("batch_no", F.floor(F.col("row_no") / size).cast("bigint"))

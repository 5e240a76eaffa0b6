"""Replies that arrive as files, taken in once each; logs that grow; dedup across batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import materialise, python_stage
from weftline.operators.factory import dedup_valid, parse_replies, validated
from weftline.sources.files import METRICS

BUCKETS = 64


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id (the file's name) and reply of each file of a drop folder, as a stream; the checkpoint remembers the files taken."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("batch_id"), F.col("value").alias("reply"))


def ingest(stream: DataFrame, specs: DataFrame, task: str, out: str, checkpoint: str, available_now: bool = True):
    """Parse, validate and dedup each micro-batch against all before it, and append valid rows, invalid rows and a ledger row a batch.

    Rows are written in folders named by the micro-batch, overwritten on a retry, so a failed micro-batch leaves nothing twice. A batch_id that the
    ledger has is left out, even when its file comes again under a new checkpoint. What is known are signatures in folders by a hash, of which a micro-batch
    reads those its own signatures fall into.
    """
    spark = stream.sparkSession

    def known(part: str, schema: str, epoch: int) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{part}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, epoch BIGINT, bucket INT").parquet(f"{out}/{part}").where(F.col("epoch") != epoch)

    def take(batch: DataFrame, epoch: int) -> None:
        done = known("ledger", "batch_id STRING", epoch)
        fresh = batch.join(done.select("batch_id").distinct(), "batch_id", "left_anti")
        parsed = parse_replies(fresh)
        get = lambda p, t="string": F.try_variant_get("value", f"$.{p}", t)
        rows = parsed.where("ok").select(
            F.concat_ws("#", "batch_id", F.col("pos").cast("string")).alias("row_id"), "batch_id", F.lit(task).alias("task"), get("seed_id").alias("seed_id"), get("instruction").alias("instruction"),
            get("response").alias("response"), F.struct(get("meta.word").alias("word"), get("meta.style").alias("style")).alias("meta"), F.struct("batch_id", "pos").alias("ingested_at"),
        )
        fields = materialise(validated(rows, specs).withColumn("bucket", F.pmod(F.xxhash64("task", "signature"), F.lit(BUCKETS)).cast("int")), "checked")
        touched = [r["bucket"] for r in fields.where("reason_code IS NULL").select("bucket").distinct().collect()]  # as many as buckets at most
        seen = known("signatures", "task STRING, signature STRING", epoch)
        seen = seen.where(F.col("bucket").isin(touched)) if "bucket" in seen.columns else seen
        checked = materialise(dedup_valid(fields.drop("bucket"), seen).drop("ingested_at"), "deduped")
        write = lambda df, part: df.write.mode("overwrite").parquet(f"{out}/{part}/epoch={epoch}")
        write(checked.where("reason_code IS NULL"), "valid")
        write(checked.where("reason_code IS NOT NULL"), "invalid")
        slim = checked.where("reason_code IS NULL").select("task", "signature", F.pmod(F.xxhash64("task", "signature"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        slim.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/signatures/epoch={epoch}")
        n = checked.groupBy("batch_id").agg(F.sum(F.col("reason_code").isNull().cast("bigint")).alias("valid"), F.sum(F.col("reason_code").isNotNull().cast("bigint")).alias("invalid"))
        ledger = fresh.select("batch_id").distinct().join(n, "batch_id", "left")
        write(ledger.select("batch_id", F.lit(task).alias("task"), F.coalesce(F.col("valid").cast("string"), F.lit("0")).alias("valid"), F.coalesce(F.col("invalid").cast("string"), F.lit("all")).alias("invalid"), F.lit("ingested").alias("status")), "ledger")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of growing logs as a stream."""
    return spark.readStream.schema(METRICS).option("allowNonNumericNumbers", True).json(folder)


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key; with a time column the state is given up after the delay."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def generate(prompts: DataFrame, backend, schema: str = "batch_id string, ok boolean, reply string, detail string") -> DataFrame:
    """Replies of a backend (a function of a prompt) to prompts (batch_id, prompt), where the prompts are; one that fails leaves its error and not the others."""

    def run(batches):
        for pdf in batches:
            out = []
            for batch_id, prompt in zip(pdf["batch_id"], pdf["prompt"], strict=True):
                try:
                    out.append((batch_id, True, backend(prompt), None))
                except Exception as e:
                    out.append((batch_id, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["batch_id", "ok", "reply", "detail"])

    return python_stage(prompts.select("batch_id", "prompt"), run, schema)


def mock_backend(prompt: str) -> str:
    """A reply in the right form for each listed item of a prompt, without any model; for tests and dry runs."""
    items = re.findall(r"^\[([^\]]+)\] (.*?):", prompt, re.MULTILINE)
    style = re.search(r"^Style: (.*)$", prompt, re.MULTILINE)
    return json.dumps([{"seed_id": i, "instruction": f"What does '{w}' mean?", "response": f"The word {w} is one of the listed items.", "meta": {"word": w, "style": style.group(1) if style else "neutral"}} for i, w in items])


BACKENDS = {"mock": mock_backend}


def backend_of(name: str):
    """A backend by name; further ones are put into ``BACKENDS``. One that isn't known is an error."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]

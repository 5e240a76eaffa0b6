"""Readers and writers of the corpus and experiment files, with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import materialise

METRICS = "run_id STRING, step BIGINT, tokens_seen BIGINT, epoch BIGINT, train_loss DOUBLE, val_loss DOUBLE, lr DOUBLE, grad_norm DOUBLE, tokens_per_sec DOUBLE, tok_s DOUBLE, mem_gb DOUBLE, elapsed_s DOUBLE, pretrain_val_loss DOUBLE, pretrain_val_ppl DOUBLE, forgetting_delta DOUBLE, train_reward_accuracy DOUBLE, train_reward_margin DOUBLE, val_reward_accuracy DOUBLE, val_reward_margin DOUBLE, val_kl_chosen DOUBLE, val_kl_rejected DOUBLE, moe_aux_loss DOUBLE, mtp_loss DOUBLE, expert_load ARRAY<ARRAY<DOUBLE>>"
REGISTRY = "run_id STRING, date DATE, phase INT, tier STRING, params_M DOUBLE, baseline_run STRING, variable_changed STRING, tokens_trained_M DOUBLE, final_val_loss DOUBLE, final_ppl DOUBLE, wall_hours DOUBLE, wandb_url STRING, verdict STRING"
LEDGER = "batch_id STRING, task STRING, style STRING, backend STRING, n_seeds STRING, status STRING, created STRING, received STRING, ingested STRING, valid STRING, invalid STRING"
GENERATED = "seed_id STRING, instruction STRING, response STRING, meta STRUCT<word: STRING, style: STRING>"


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, name (without ending), text of whole files; bytes that are no UTF-8 become the replacement character."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("value").alias("text"))


def records(text: DataFrame) -> DataFrame:
    """path, pos, text of the records of whole files that blank lines part; a line of blanks only counts as blank."""
    parts = F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"\n(?:[^\S\n]*\n)+")
    out = text.select("path", F.posexplode(parts).alias("pos", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    return out.where("text <> ''")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, NaN and infinities are read as numbers."""
    return spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Logs of runs with run_id from the folder's name and line_no, the line's place in its file.

    A file is one run's log and is read whole, so a line keeps its place; unknown fields are left out, missing ones are null.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    row = F.from_json("line", METRICS, {"allowNonNumericNumbers": "true"})
    run = F.element_at(F.split("path", "/"), -2)
    full = lines.select(run.alias("run"), "line_no", row.alias("r")).select("run", "line_no", "r.*")
    return full.withColumn("run_id", F.coalesce("run_id", "run")).drop("run")


def table_csv(spark: SparkSession, path: str, schema: str, null: str = "-") -> DataFrame:
    """CSV with a header, a mark for null, and ``True``/``False`` as booleans."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null).csv(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    return table_csv(spark, path, REGISTRY)


def long_to_wide(long: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A table of (key, name, value) as one column a name."""
    return long.groupBy(key).pivot(name, names).agg(F.first(value, ignorenulls=True))


def task_specs(spark: SparkSession, path: str) -> DataFrame:
    """Task files in YAML as rows (read by the driver: configuration, a few files)."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading YAML needs PyYAML") from e
    from weftline.operators.factory import Task

    rows = []
    for f in sorted(os.listdir(path)):
        if f.endswith((".yaml", ".yml")):
            with open(os.path.join(path, f), encoding="utf-8") as h:
                t = Task.from_dict(yaml.safe_load(h))
            rows.append((t.name, t.target_count, t.seeds_per_prompt, list(t.style_axes), t.dedup_key, t.seed_term_field, t.quality.__dict__))
    quality = "min_response_chars INT, max_response_chars INT, min_instruction_chars INT, max_instruction_chars INT, require_lang STRING, forbid_refusals BOOLEAN, require_seed_term_in_response BOOLEAN".replace(" INT", ": INT").replace(" STRING", ": STRING").replace(" BOOLEAN", ": BOOLEAN")
    return spark.createDataFrame(rows, f"name STRING, target_count INT, seeds_per_prompt INT, style_axes ARRAY<STRING>, dedup_key STRING, seed_term_field STRING, quality STRUCT<{quality}>")


def write_texts(documents: DataFrame, path: str) -> None:
    """Texts as text files in folders by split and category, a blank line after each text. documents: split, category, text."""
    documents.select("split", "category", "text").where("text IS NOT NULL").write.mode("overwrite").partitionBy("split", "category").option("lineSep", "\n\n").text(path)


def split_of(flag: Column, held: list[str]) -> Column:
    """``val`` for the books named as held out, else ``train``; spelling apart from case and blanks counts."""
    return F.when(F.lower(F.trim(flag)).isin([h.strip().lower() for h in held]), "val").otherwise("train")


def ordered_texts(spark: SparkSession, root: str, split: str, folders: list[str], last: list[str] = ()) -> DataFrame:
    """path, name, text and place of a split's files: those of the folders by name, then single files. Train lies at the root, another split in a folder of its name.

    What isn't there is left out.
    """
    base = root if split == "train" else f"{root.rstrip('/')}/{split}"
    out = None
    for k, (part, pattern) in enumerate([*((f, "*.txt") for f in folders), *((".", n) for n in last)]):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{part}" if part != "." else base)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            continue
        found = texts(spark, at.toString(), pattern).withColumn("place", F.struct(F.lit(k).alias("group"), "name"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "path string, name string, text string, place struct<group: int, name: string>") if out is None else out


def write_split(rows: DataFrame, path: str) -> None:
    """JSON lines in one folder a side."""
    rows.write.mode("overwrite").partitionBy("side").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def append_registry(spark: SparkSession, runs: DataFrame, path: str, null: str = "-") -> int:
    """Add runs to a registry in CSV whose run_id isn't in it yet; the number added. runs: the registry's columns or some of them."""
    columns = [x.split(" ")[0] for x in REGISTRY.split(", ")]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = runs.select(*((F.col(c) if c in runs.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ") for x in REGISTRY.split(", ")))).dropDuplicates(["run_id"])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(registry(spark, path).select("run_id"), "run_id", "left_anti").select(columns)
    fresh = materialise(fresh, "runs")
    n = fresh.count()
    if n:
        fresh.coalesce(1).write.mode("append").option("header", True).option("nullValue", null).csv(path)
    return n


def write_ledger(state: DataFrame, path: str) -> None:
    """The ledger as one CSV file sorted by batch; it has one row a batch, so one task writes it."""
    state.orderBy("batch_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token rows (source, doc_id, ids) by source, in place of what was there; the tokens of a document stay together."""
    tokens.write.mode("overwrite").partitionBy("source").parquet(path)


def append_tokens(spark: SparkSession, tokens: DataFrame, path: str) -> int:
    """Add the documents that the token table doesn't have yet; the number added. Only ids of the old rows are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        tokens = tokens.join(spark.read.parquet(path).select("doc_id"), "doc_id", "left_anti")
    tokens = materialise(tokens, "tokens")
    n = tokens.count()
    if n:
        tokens.write.mode("append").partitionBy("source").parquet(path)
    return n


def verify_slices(tokens: DataFrame, texts: DataFrame, decode: Callable[[Column], Column], length: int) -> DataFrame:
    """doc_id and same: whether the first ``length`` ids of a document, decoded, are what its text begins with."""
    got = decode(F.slice("ids", 1, length))
    return tokens.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", F.startswith(F.col("text"), got).alias("same"))


def token_slice(tokens: DataFrame, doc_id: int, start: int, length: int) -> DataFrame:
    """Random access: a slice of one document's ids; the filter is pushed to the scan."""
    return tokens.where(F.col("doc_id") == doc_id).select(F.slice("ids", start + 1, length).alias("ids"))


def file_sizes(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, bytes and name of files, from their metadata only; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("name"))


def archive_list(files: DataFrame, fork_points: DataFrame) -> DataFrame:
    """Checkpoints to keep: every ``best``, and ``latest`` of the runs that others start from. fork_points: run."""
    runs = files.withColumn("run", F.element_at(F.split("path", "/"), -2))
    best = runs.where(F.col("name").startswith("best"))
    return best.unionByName(runs.where(F.col("name").startswith("latest")).join(fork_points.select("run").distinct(), "run", "left_semi").select(best.columns))

"""Repeated rows of new batches against all history, by a growing segment index for a bounded edit distance.

A row's dedup fields are compared apart from their writing. Two things make it a case: an earlier row of its task with the
same fields (any response), or one whose word, in its field or as quoted in another field, differs by a single slip while the
rest agrees and the response is the same but for ``max_words`` words.

The index lies in one folder and outlives the session; it has four tables, bucketed by their first column:

* ``entries``: each distinct entry (known by a 64-bit hash) with word and response, read for the candidates that are verified;
* ``keys``: the undivided fields as one segment, with the earliest arrival;
* ``postings``: the two segments of each entry's word, stored by side and segment length. With one slip allowed, two segments are
  enough: one stays whole (one or two characters in the middle belong to neither, so a swap of neighbours is covered), and a word
  of length n is probed with the prefixes and suffixes that words of n-1, n and n+1 have;
* ``counts``: how many entries each segment has, by batch.

``compact`` merges what many batches left. ``prepare`` stages a batch in these tables under a name of its own, ``check`` probes, ``append`` commits the staged batch by one
line in ``manifest``. A batch that was staged and never committed is not seen by others, and appending the same batch again (by its
content, or by the id given) changes nothing. The batch is shuffled into the buckets of the index and joined with the
tables there: history is not shuffled, and not sorted unless the batch is too large to be held in memory; only its columns needed are scanned.

No posting list grows beyond ``hot`` entries: once a segment has more, its further entries are stored under the segment together
with a key of the response, and are probed by such keys. Responses of up to 10 words have as keys what is left when any
``max_words`` or fewer words are left out; longer ones (9 words or more, so any two that may agree have keys of one kind) are dealt out
to ``2 * max_words + 2`` zones by the words' hashes, of which at least two stay whole; each two zones make a key. So nothing is lost.

Nulls: a row lacking task or one of its fields is never a case and enters no table; a null or blank response can only be a
case by equal fields. Ties in arrival are broken by ``row_id``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.session import materialise, python_stage, remove_folder, shared_dir, ship, table
from weftline.llm.writing import one_slip, squash, word_distance, words

_WORD = "\x01"


@dataclass(frozen=True)
class HistoryRules:
    """``max_words``: words of a response that may differ beside a slip; ``hot``: most entries a segment lists by itself.

    ``buckets`` of the tables; a folder keeps the rules it was made with. Up to ``listed`` candidates are looked up by name, so that only their buckets are read.
    Up to ``held`` rows a bucket, the batch's side of a join is held in memory; a larger one is joined by sorting, which spills.
    """

    max_words: int = 2
    hot: int = 64
    buckets: int = 12
    listed: int = 1000
    held: int = 400_000

    @property
    def zones(self) -> int:
        return 2 * self.max_words + 2


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def hide_word(text: str, word: str) -> str:
    """Squashed text with the squashed word, or a stretch one slip away from it, as a mark."""
    if word in text:
        return text.replace(word, _WORD)
    n = len(word)
    for m in (n, n + 1, n - 1):
        if m < 3:
            continue
        for i in range(len(text) - m + 1):
            part = text[i : i + m]
            if (part[0] == word[0] or part[-1] == word[-1]) and one_slip(part, word):
                return text[:i] + _WORD + text[i + m :]
    return text


def response_words(response: str | None, word: str, parts: int) -> list[str]:
    """Words of the response with the entry's own word (``parts`` words, or one slip away) as a mark."""
    ws, n = words(response), len(word)
    out = [_WORD if -2 < len(x) - n < 2 and one_slip(x, word) else x for x in ws]
    for k in (parts, parts + 1):
        if k < 2 or _WORD in out:
            continue
        merged, i = [], 0
        while i < len(ws):
            part = "".join(ws[i : i + k])
            hit = -2 < len(part) - n < 2 and one_slip(part, word)
            merged.append(_WORD if hit else ws[i])
            i += k if hit else 1
        out = merged
    return out


def segments(near: int, word: str) -> tuple[list[int], int]:
    """Numbers of the prefixes and suffixes that words of up to one slip share with this one, and where its own two start."""
    n = len(word)
    sizes = sorted({max(1, (m - 1) // 2) for m in (n - 1, n, n + 1)})
    out = [_number(f"{near}{side}{part}") for k in sizes for side, part in (("<", word[:k]), (">", word[n - k :]))]
    return out, 2 * sizes.index(max(1, (n - 1) // 2))


_SHORT, _LONG = 10, 9


def reply_zones(reply: list[str], zones: int) -> int:
    """The words' hashes summed up by zone, each zone in an equal share of 60 bits."""
    width, sums = 60 // zones, [0] * zones
    for w in reply:
        b = zlib.crc32(w.encode())
        sums[b % zones] += b // zones
    return sum((x & ((1 << width) - 1)) << (width * z) for z, x in enumerate(sums))


def reply_keys(reply: list[str], zones: int, max_words: int) -> list[int]:
    """Two responses within ``max_words`` changed, lost or added words have a key in common."""
    keys: set[int] = set()
    if len(reply) <= _LONG - 1 + max_words:
        for k in range(min(max_words, len(reply)) + 1):
            keys.update(_number("-" + " ".join(kept)) for kept in combinations(reply, len(reply) - k))
    if len(reply) >= _LONG:
        parts: list[list[str]] = [[] for _ in range(zones)]
        for w in sorted(reply):
            parts[zlib.crc32(w.encode()) % zones].append(w)
        keys.update(_number(f"{i},{j} {' '.join(parts[i])}|{' '.join(parts[j])}") for i, j in combinations(range(zones), 2))
    return sorted(keys)


def _normal(zones: int):
    columns = ["row_id", "arrived", "key", "mark", "entry", "word", "reply", "probes", "own", "zones"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row_id, ts, task, word, rest, response in zip(pdf["row_id"], pdf["arrived"], pdf["task"], pdf["word"], pdf["rest"], pdf["response"], strict=True):
                w = squash(word)
                fields = [squash(x) for x in rest]
                if not w or not all(fields):
                    continue
                same = hashlib.md5("\n".join((task, w, *fields)).encode()).digest()
                near = _number("\n".join((task, *(hide_word(f, w) for f in fields))))
                reply = response_words(response, w, len(words(word)))
                text = " ".join(reply)
                probes, own = segments(near, w)
                key, mark = int.from_bytes(same[:8], "big", signed=True), int.from_bytes(same[8:], "big", signed=True)
                rows.append((row_id, ts, key, mark, _number(f"{near}\n{w}\n{text}") if reply else None, w, text, probes, own, reply_zones(reply, zones)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"entry": "Int64"})

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _spread(zones: int, max_words: int):
    """Segments of hot lists together with each key of the response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = {r: np.array(reply_keys(r.split(" "), zones, max_words), np.int64).view(np.uint64) for r in pdf["reply"].unique()}
            own = pdf["key"].to_numpy(np.int64).view(np.uint64)
            out = pdf.drop(columns=["reply", "key"])
            out["keys"] = [_mix(keys[r] ^ _mix(k)).view(np.int64) for k, r in zip(own, pdf["reply"], strict=True)]
            yield out

    return run


def normal_rows(rows: DataFrame, specs: DataFrame, zones: int = 6) -> DataFrame:
    """Rows with comparable forms of their dedup fields; rows lacking one are left out.

    specs: name, dedup_key, seed_term_field. A path without a dot means a column, or else a field of ``meta``.
    """
    columns: dict[str, Column] = {}
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StringType):
            columns[f.name] = F.col(f.name)
    meta = rows.schema["meta"].dataType
    for f in meta.fields if isinstance(meta, T.StructType) else ():
        columns[f"meta.{f.name}"] = F.col("meta")[f.name]
        columns.setdefault(f.name, columns[f"meta.{f.name}"])
    known = F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))))
    specs = specs.select(F.col("name").alias("task"), F.split(F.trim("dedup_key"), r"\s*\+\s*").alias("paths"), F.col("seed_term_field").alias("term"))
    full = rows.join(specs, "task")
    is_word = lambda p: F.element_at(F.split(p, r"\."), -1) == F.col("term")
    value = lambda p: F.try_element_at(known, p)
    out = full.select(
        "row_id",
        F.unix_micros("ingested_at").alias("arrived"),
        "task",
        F.element_at(F.transform(F.filter("paths", is_word), value), 1).alias("word"),
        F.transform(F.filter("paths", lambda p: ~is_word(p)), value).alias("rest"),
        "response",
    )
    out = out.where(F.col("word").isNotNull() & F.col("arrived").isNotNull() & ~F.exists("rest", lambda x: x.isNull()))
    return python_stage(out, _normal(zones), "row_id bigint, arrived bigint, key bigint, mark bigint, entry bigint, word string, reply string, probes array<bigint>, own int, zones bigint")


def _verify(max_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [
                one_slip(a, b) and word_distance(ra.split(" "), rb.split(" "), max_words) <= max_words
                for a, b, ra, rb in zip(pdf["word"], pdf["word_s"], pdf["reply"], pdf["reply_s"], strict=True)
            ]
            yield pdf.loc[ok, ["entry_p", "a0", "r0"]]

    return run


@dataclass(frozen=True)
class Batch:
    """A staged batch: its name in the index's tables, its id, its number of rows, these in slim form (row_id, arrived, key, mark, entry), and which of the segments it probes are hot."""

    stage: str
    id: str
    size: int
    rows: DataFrame
    hot: DataFrame | None = None


class HistoryIndex:
    """The index of everything accepted so far, in a folder: ``prepare`` a batch, ``check`` it, ``append`` it.

    A folder that holds an index is opened again with all it has, whichever session made it. Several sessions may read it; one appends at a time.
    """

    TABLES = {
        "entries": "entry bigint, a0 bigint, r0 bigint, last bigint, several boolean, word string, reply string, probes array<bigint>, own int, zones bigint",
        "keys": "key bigint, mark bigint, a0 bigint, r0 bigint, several boolean",
        "postings": "key bigint, entry bigint, a0 bigint, r0 bigint, zones bigint",
        "counts": "key bigint, n bigint",
    }

    def __init__(self, spark: SparkSession, rules: HistoryRules = HistoryRules(), folder: str | None = None):
        ship(spark)
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark).rstrip('/')}/weftline/index-{uuid.uuid4().hex}").rstrip("/")
        self.rules = HistoryRules(**json.loads(self._lines("rules", json.dumps(asdict(rules)))[0]))
        self.name = "weftline_" + uuid.uuid4().hex[:12]
        for part, schema in self.TABLES.items():
            key, at = schema.split(" ")[0], spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
            spark.sql(
                f"CREATE TABLE {self.name}_{part} ({schema}, stage string) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (stage) "
                f"CLUSTERED BY ({key}) INTO {self.rules.buckets} BUCKETS LOCATION '{self.folder}/{part}'"
            )
        self.refresh()

    def refresh(self) -> None:
        """See what others have appended since."""
        for part in self.TABLES:
            self.spark.sql(f"ALTER TABLE {self.name}_{part} RECOVER PARTITIONS")
        lines = [json.loads(x) for x in sorted(self._lines("manifest"))]
        merged = {old: x["merged"] for x in lines if "merged" in x for old in x["of"]}
        self.committed: dict[str, str] = {}
        for done in lines:
            if "batch" in done:
                stage = done["stage"]
                while stage in merged:
                    stage = merged[stage]
                self.committed.setdefault(done["batch"], stage)

    def close(self) -> None:
        """Take the tables' names out of the session; the folder stays."""
        for part in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def _lines(self, name: str, first: str | None = None) -> list[str]:
        """Lines of a small text file set in the folder; ``first`` is written where there is none."""
        spark, path = self.spark, f"{self.folder}/{name}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            if first is None:
                return []
            self._line(name, first)
        return [r["value"] for r in spark.read.text(path).collect()]  # a line a batch

    def _line(self, name: str, line: str) -> None:
        """Add a line as a file of its own, there as a whole or not at all."""
        hadoop, file = self.spark._jvm.org.apache.hadoop.fs, uuid.uuid4().hex
        fs = hadoop.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        hidden, final = (hadoop.Path(f"{self.folder}/{name}/{x}") for x in (f"_{file}", f"{file}.txt"))
        out = fs.create(hidden)
        out.write(bytearray(line.encode() + b"\n"))
        out.close()
        if not fs.rename(hidden, final):
            raise OSError(f"cannot write {final}")

    def _part(self, part: str, stages: list[str]) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}").where(F.col("stage").isin(stages)).drop("stage")

    def _history(self, part: str, batch: Batch) -> DataFrame:
        """The table with what is committed and what the batch staged."""
        return self._part(part, sorted({*self.committed.values(), batch.stage}))

    def _stage(self, part: str, df: DataFrame, stage: str, placed: bool = False) -> DataFrame:
        key = self.TABLES[part].split(" ")[0]
        columns = [x.split(" ")[0] for x in self.TABLES[part].split(", ")]
        df = df if placed else df.repartition(self.rules.buckets, key)
        df.select(*columns, F.lit(stage).alias("stage")).write.insertInto(f"{self.name}_{part}")
        return self._part(part, [stage])

    def _probing(self, df: DataFrame, key: str, rows: int) -> DataFrame:
        """The batch's side of a join with a table of the index: moved to the buckets there, and held in memory unless it may have too many rows."""
        moved = df.repartition(self.rules.buckets, key)
        return moved.hint("shuffle_hash") if rows <= self.rules.held * self.rules.buckets else moved.hint("merge")

    def prepare(self, rows: DataFrame, specs: DataFrame, batch_id: str | None = None) -> Batch:
        """Bring the batch's rows into comparable form and stage them. Without an id the batch is known by its content."""
        rules, stage = self.rules, uuid.uuid4().hex
        full = materialise(normal_rows(rows, specs, rules.zones), "rows")
        n, total = full.agg(F.count("*"), F.sum(F.xxhash64("row_id", "arrived", "key", "mark", "entry").cast("decimal(38,0)"))).first()
        batch_id = f"{n}-{total or 0}" if batch_id is None else batch_id
        order, size = F.struct("arrived", "row_id"), rules.buckets
        own = full.where(F.col("entry").isNotNull()).repartition(size, "entry").groupBy("entry")
        own = own.agg(F.min(order).alias("f"), F.max(order).alias("l"), F.first(F.struct("word", "reply", "probes", "own", "zones")).alias("x"))
        own = own.select("entry", F.col("f.arrived").alias("a0"), F.col("f.row_id").alias("r0"), F.col("l.arrived").alias("last"), (F.col("f.row_id") != F.col("l.row_id")).alias("several"), "x.*")
        entries = self._stage("entries", own, stage, placed=True)
        keys = full.groupBy("key", "mark").agg(F.min(order).alias("f"), (F.count("*") > 1).alias("several"))
        self._stage("keys", keys.select("key", "mark", F.col("f.arrived").alias("a0"), F.col("f.row_id").alias("r0"), "several"), stage)
        stored = entries.select(F.explode(F.slice("probes", F.col("own") + 1, F.lit(2))).alias("key"), "entry", "a0", "r0", "zones", "reply")
        self._stage("counts", stored.groupBy("key").agg(F.count("*").alias("n")), stage)
        batch = Batch(stage, batch_id, n, full.select("row_id", "arrived", "key", "mark", "entry"))
        hot = self._hot(batch, entries.select(F.explode("probes").alias("key")).distinct())
        if hot is None:
            self._stage("postings", stored, stage)
        else:
            spread = python_stage(stored.join(hot, "key", "left_semi"), _spread(rules.zones, rules.max_words), "entry bigint, a0 bigint, r0 bigint, zones bigint, keys array<bigint>")
            self._stage("postings", stored.drop("reply").join(hot, "key", "left_anti").unionByName(spread.withColumn("key", F.explode("keys")).drop("keys")), stage)
        return replace(batch, hot=hot)

    def _hot(self, batch: Batch, keys: DataFrame) -> DataFrame | None:
        """Those of the segments that have more than ``hot`` entries by now; None where there are none."""
        if not self.rules.hot:
            return keys
        probe = self._probing(keys.withColumnRenamed("key", "k"), "k", 6 * batch.size)
        known = self._history("counts", batch).join(probe, F.col("key") == F.col("k")).groupBy("key").agg(F.sum("n").alias("n"))
        hot = materialise(known.where(F.col("n") > self.rules.hot).select("key"), "hot")
        return None if hot.isEmpty() else hot

    def first_arrivals(self, batch: Batch) -> DataFrame:
        """key, mark and the earliest arrival (a0, r0) of those fields of the batch that stand in several rows, in history or the batch."""
        mine = self._part("keys", [batch.stage]).select(F.col("key").alias("k"), F.col("mark").alias("m"), "several")
        every = self._history("keys", batch).drop("several").join(self._probing(mine, "k", batch.size), (F.col("key") == F.col("k")) & (F.col("mark").bitwiseXOR(F.col("m")) == 0))  # joined by the bucket's column alone
        first = every.groupBy("key", "mark").agg(F.min(F.struct("a0", "r0")).alias("f"), F.count("*").alias("n"), F.bool_or("several").alias("several"))
        return first.where("several OR n > 1").select("key", "mark", "f.a0", "f.r0")

    def candidates(self, batch: Batch) -> DataFrame:
        """entry_p of the batch and entry of the index, with its first arrival, that share a segment and may be within the limits."""
        rules = self.rules
        own = self._part("entries", [batch.stage])
        probes = own.select(F.explode("probes").alias("k"), F.col("entry").alias("entry_p"), "last", F.col("zones").alias("zones_p"), "reply")
        every = probes.drop("reply")
        if batch.hot is not None:
            spread = python_stage(
                probes.withColumnRenamed("k", "key").join(batch.hot, "key", "left_semi"), _spread(rules.zones, rules.max_words), "entry_p bigint, last bigint, zones_p bigint, keys array<bigint>"
            )
            every = every.unionByName(spread.select(F.explode("keys").alias("k"), "entry_p", "last", "zones_p"))
        most = 6 * batch.size * (1 if batch.hot is None else 16)
        width = 60 // rules.zones
        zone = lambda c, z: F.shiftright(F.col(c), z * width).bitwiseAND(F.lit((1 << width) - 1))
        equal = sum(((zone("zones", z) == zone("zones_p", z)).cast("int") for z in range(rules.zones)), F.lit(0))
        fits = (F.col("key") == F.col("k")) & (F.col("entry") != F.col("entry_p")) & (F.col("a0") <= F.col("last")) & (equal >= rules.zones - 2 * rules.max_words)
        return self._history("postings", batch).join(self._probing(every, "k", most), fits).select("entry_p", "entry", "a0", "r0").distinct()

    def stored_texts(self, batch: Batch, pairs: DataFrame) -> DataFrame:
        """The candidates with word and response of the index's entry. A few candidates are named to the scan, which then reads their buckets only."""
        texts = self._history("entries", batch).select("entry", F.col("word").alias("word_s"), F.col("reply").alias("reply_s"))
        if self.rules.listed and len(few := pairs.select("entry").distinct().take(self.rules.listed + 1)) <= self.rules.listed:
            texts = texts.where(F.col("entry").isin([r["entry"] for r in few]))
        moved = self._probing(pairs.withColumnRenamed("entry", "e"), "e", pairs.count())
        return texts.join(moved, F.col("entry") == F.col("e")).drop("e")

    def check(self, batch: Batch) -> DataFrame:
        """row_id of every row of the prepared batch that repeats an earlier row, of history or of the batch itself."""
        pairs = materialise(self.candidates(batch), "pairs")
        own = self._part("entries", [batch.stage])
        near = self.stored_texts(batch, pairs)
        mine = own.select(F.col("entry").alias("e"), "word", "reply")
        near = mine.join(self._probing(near, "entry_p", 4 * pairs.count()), F.col("e") == F.col("entry_p")).select("entry_p", "word", "reply", "word_s", "reply_s", "a0", "r0")
        near = python_stage(near, _verify(self.rules.max_words), "entry_p bigint, a0 bigint, r0 bigint").unionByName(own.where("several").select(F.col("entry").alias("entry_p"), "a0", "r0"))
        near = near.groupBy(F.col("entry_p").alias("entry")).agg(F.min(F.struct("a0", "r0")).alias("n"))
        same = self.first_arrivals(batch).select("key", "mark", F.struct("a0", "r0").alias("s"))
        earlier = lambda c: F.coalesce((F.col("arrived") > F.col(f"{c}.a0")) | ((F.col("arrived") == F.col(f"{c}.a0")) & (F.col("row_id") > F.col(f"{c}.r0"))), F.lit(False))
        rows = batch.rows.join(same, ["key", "mark"], "left").where(F.col("entry").isNotNull() | earlier("s"))
        return rows.join(near, "entry", "left").where(earlier("s") | earlier("n")).select("row_id")

    def append(self, batch: Batch) -> bool:
        """Commit the prepared batch; False where the index has a batch of this id already."""
        self.refresh()
        if batch.id in self.committed:
            return False
        self._line("manifest", json.dumps({"batch": batch.id, "stage": batch.stage}))
        self.committed[batch.id] = batch.stage
        return True

    def compact(self) -> bool:
        """Merge all committed parts of the tables into one, bucket by bucket; False where there is nothing to merge.

        Worth while whenever the parts have become many, as each leaves a file a bucket. The merged part counts from one line in the manifest
        on; then the old ones are deleted, so nobody else should be checking against them meanwhile.
        """
        self.refresh()
        old = sorted(set(self.committed.values()))
        if len(old) < 2:
            return False
        stage, order = uuid.uuid4().hex, F.min(F.struct("a0", "r0")).alias("f")
        self._stage("entries", self._part("entries", old).dropDuplicates(["entry"]), stage, placed=True)
        keys = self._part("keys", old).groupBy("key", "mark").agg(order, F.bool_or("several").alias("several"))
        self._stage("keys", keys.select("key", "mark", "f.a0", "f.r0", "several"), stage, placed=True)
        postings = self._part("postings", old).groupBy("key", "entry").agg(order, F.first("zones").alias("zones"))
        self._stage("postings", postings.select("key", "entry", "f.a0", "f.r0", "zones"), stage, placed=True)
        self._stage("counts", self._part("counts", old).groupBy("key").agg(F.sum("n").alias("n")), stage, placed=True)
        self._line("manifest", json.dumps({"merged": stage, "of": old}))
        for x in old:
            self._drop(x)
        self.refresh()
        return True

    def _drop(self, stage: str) -> None:
        for part in self.TABLES:
            self.spark.sql(f"ALTER TABLE {self.name}_{part} DROP IF EXISTS PARTITION (stage = '{stage}')")
            remove_folder(self.spark, f"{self.folder}/{part}/stage={stage}")

    def discard(self, batch: Batch) -> None:
        """Delete what a batch staged that is not to be appended."""
        if batch.stage not in self.committed.values():
            self._drop(batch.stage)


def repeated_rows(rows: DataFrame, specs: DataFrame, slices: int = 4, rules: HistoryRules = HistoryRules()) -> DataFrame:
    """Feed all rows through an index of their own in arrival order, in ``slices`` batches; row_id of every repeated row."""
    index = HistoryIndex(rows.sparkSession, rules)
    at = [k / slices for k in range(1, slices)]
    micros = F.unix_micros("ingested_at")
    cuts = rows.agg(F.percentile_approx(micros, at, 1000)).first()[0] if at else []
    found = None
    bounds = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = rows if lo is None else rows.where(micros > lo)
        batch = index.prepare(part if hi is None else part.where(micros <= hi), specs)
        cases = materialise(index.check(batch), "repeated")
        index.append(batch)
        found = cases if found is None else found.unionByName(cases)
    index.close()
    remove_folder(index.spark, index.folder)
    return found


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "generated_rows").select("row_id", "task", "instruction", "response", "meta", "ingested_at")
    return repeated_rows(rows, table(spark, sf_dir, "task_spec"))

"""Byte-level pair encoding over a table of distinct chunks: training, encoding, decoding and its statistics.

A chunk is held as text of its token ids, each followed by a semicolon (``104;105;``). Replacing ``104;105;`` by the new id is
then exactly a merge from left to right without overlap, and it stays in the JVM.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import cut, materialise, python_stage
from weftline.operators.corpus import running_before

# Fixed value: the splitting pattern of the common byte-level vocabularies.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokenized(text: Column, mode: str = "gpt2") -> Column:
    """Chunks no merge may cross: the whole text (``none``), parts between spaces (``whitespace``), or the common pattern (``gpt2``)."""
    if mode == "none":
        return F.filter(F.array(text), lambda t: t != "")
    if mode == "whitespace":
        return F.filter(F.split(text, " "), lambda t: t != "")
    if mode == "gpt2":
        return F.regexp_extract_all(text, F.lit("(?U)" + GPT2), F.lit(0))
    raise ValueError(f"unknown mode {mode!r}")


def byte_ids(chunk: Column) -> Column:
    """The bytes of a chunk as ids with semicolons."""
    digits = F.hex(F.encode(chunk, "UTF-8"))
    pairs = F.filter(F.regexp_extract_all(digits, F.lit("[0-9A-F]{2}"), F.lit(0)), lambda x: x != "")
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.conv(x, 16, 10), F.lit(";"))), "")


def chunks(documents: DataFrame, mode: str = "gpt2") -> DataFrame:
    """Distinct chunks with how often they occur and where first (doc_id, place), and their byte ids."""
    each = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(pretokenized(F.col("text"), mode)).alias("pos", "chunk"))
    table = each.groupBy("chunk").agg(F.count("*").alias("freq"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return table.withColumn("ids", byte_ids(F.col("chunk")))


def _list(ids: Column) -> Column:
    return F.filter(F.split(ids, ";"), lambda x: x != "")


def pair_counts(table: DataFrame) -> DataFrame:
    """Neighbouring pairs with their number (overlaps count) and first place. Counts are summed where the chunks are before they are shuffled."""
    ids = _list(F.col("ids"))
    n = F.size(ids)
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: i < n), lambda i: F.struct(F.element_at(ids, i).alias("a"), F.element_at(ids, i + 1).alias("b"), i.alias("i")))
    each = table.select("freq", "first", F.explode(pairs).alias("p"))
    return each.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"), F.min(F.struct("first", "p.i")).alias("first"))


def train(table: DataFrame, merges: int, first_id: int = 256, min_frequency: int = 1, cut_every: int = 20, in_one_task: int = 16 << 20) -> list[tuple[int, int, int, int, int]]:
    """Merges in order as (rank, left, right, new id, number); ties go to the pair that occurs first. Stops early without pairs.

    Distinct chunks of up to ``in_one_task`` bytes together are trained by one task that keeps its pair counts.
    Larger tables take one small job for several merges; about every ``cut_every`` merges the table is written to the checkpoint folder, so the plan doesn't grow.
    """
    if (table.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0) <= in_one_task:
        rows = table.select("chunk", "freq", "first.doc_id", "first.pos").repartition(1).sortWithinPartitions("doc_id", "pos")
        run = _trainer(merges, first_id, min_frequency)
        return sorted(tuple(r) for r in python_stage(rows, run, "rank int, left int, right int, new_id int, n bigint").collect())
    out: list[tuple[int, int, int, int, int]] = []
    work, since = cut(table.select("freq", "first", "ids")), 0
    while len(out) < merges:
        top = pair_counts(work).where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "first").limit(min(64, merges - len(out))).collect()
        if not top:
            break
        for a, b, n in _apart([(int(r["a"]), int(r["b"]), int(r["n"])) for r in top]):
            new = first_id + len(out)
            out.append((len(out), a, b, new, n))
            work, since = work.withColumn("ids", merged(F.col("ids"), a, b, new)), since + 1
        if since >= cut_every:
            work, since = cut(work), 0
    return out


def _apart(top: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The first pairs that one count settles: as many as no earlier merge among them touches.

    A merge of (a, b) takes occurrences from pairs ending in a or beginning with b only. Every pair it makes stands for one of those, so
    while these rank lower than the pair in question it can't come before that one. A pair of equal halves may make more, it ends the list.
    """
    out: list[tuple[int, int, int]] = []
    for a, b, n in top:
        if any(b == x or a == y for x, y, _ in out):
            break
        out.append((a, b, n))
        if a == b:
            break
    return out


def _trainer(merges: int, first_id: int, min_frequency: int):
    """Trains on all chunks in the order of their first place. Counts change only where a merge happens; a heap gives the next pair.

    A pair's count only falls and its first place only moves back, so an outdated entry of the heap is never too low; it is renewed when it comes up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seqs: list[list[int]] = []
        freq: list[int] = []
        for pdf in batches:
            seqs += [list(c.encode("utf-8")) for c in pdf["chunk"]]
            freq += [int(f) for f in pdf["freq"]]
        width = {i: 1 for i in range(256)}
        count: dict[tuple[int, int], int] = {}
        where: dict[tuple[int, int], array] = {}
        start: dict[tuple[int, int], int] = {}  # chunks before this one don't hold the pair any more

        def add(i: int, pairs) -> None:
            for p in pairs:
                count[p] = count.get(p, 0) + freq[i]
                at = where.setdefault(p, array("I"))
                if not at or at[-1] != i:
                    at.append(i)

        def entry(p: tuple[int, int]) -> tuple:
            at, k = where[p], start.get(p, 0)
            while True:
                s, place = seqs[at[k]], 0
                for x, y in zip(s, s[1:]):
                    if (x, y) == p:
                        start[p] = k
                        return (-count[p], at[k], place, p)
                    place += width[x]
                k += 1

        for i, s in enumerate(seqs):
            add(i, zip(s, s[1:]))
        heap = [entry(p) for p in count]
        heapify(heap)
        out = []
        while heap and len(out) < merges:
            n, _, _, p = heappop(heap)
            if count.get(p, 0) != -n:
                if count.get(p, 0) >= min_frequency:
                    heappush(heap, entry(p))
                continue
            if -n < min_frequency:
                break
            (a, b), new = p, first_id + len(out)
            width[new] = width[a] + width[b]
            out.append((len(out), a, b, new, -n))
            made = set()
            for i in where[p][start.get(p, 0) :]:
                s, t, j = seqs[i], [], 0
                while j < len(s):
                    hit = s[j] == a and j + 1 < len(s) and s[j + 1] == b
                    t.append(new if hit else s[j])
                    j += 2 if hit else 1
                if len(t) == len(s):
                    continue
                for q in zip(s, s[1:]):
                    count[q] -= freq[i]
                seqs[i] = t
                fresh = []
                for q in zip(t, t[1:]):
                    if new in q:
                        fresh.append(q)
                    else:
                        count[q] += freq[i]
                add(i, fresh)
                made.update(fresh)
            for q in (count, where, start):
                q.pop(p, None)
            for q in made:
                heappush(heap, entry(q))
        yield pd.DataFrame(out, columns=["rank", "left", "right", "new_id", "n"])

    return run


def merged(ids: Column, a: int, b: int, new: int) -> Column:
    """All occurrences of a pair merged from left to right. A leading semicolon keeps ``4;5;`` from matching inside ``14;5;``."""
    return F.substring(F.replace(F.replace(F.concat(F.lit(";"), F.replace(ids, F.lit(";"), F.lit(";;"))), F.lit(f";{a};;{b};"), F.lit(f";{new};")), F.lit(";;"), F.lit(";")), 2, 1 << 30)


def _encoder(merges: list[tuple[int, int, int, int, int]]):
    ranks = {(a, b): (rank, new) for rank, a, b, new, _ in merges}

    def encode(ids: list[int]) -> list[int]:
        while len(ids) > 1:
            best = min(((ranks[p][0], p) for p in zip(ids, ids[1:]) if p in ranks), default=None)
            if best is None:
                break
            (a, b), new, out, i = best[1], ranks[best[1]][1], [], 0
            while i < len(ids):
                hit = i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b
                out.append(new if hit else ids[i])
                i += 2 if hit else 1
            ids = out
        return ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ids=[encode(list(c.encode("utf-8"))) for c in pdf["chunk"]])

    return run


def encode_chunks(table: DataFrame, merges: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """chunk, freq, ids (array): each distinct chunk is encoded once, whatever its number."""
    return python_stage(table.select("chunk", "freq"), _encoder(merges), "chunk string, freq bigint, ids array<int>")


def encode_documents(documents: DataFrame, merges: list[tuple[int, int, int, int, int]], mode: str = "gpt2", end_id: int | None = None) -> DataFrame:
    """doc_id, ids of each document, with the end mark after it. Chunks are encoded where the documents are; nothing is shuffled."""
    encode = _encoder(merges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for pdf in batches:
            new = sorted({c for cs in pdf["chunks"] for c in cs if c not in seen})
            if len(seen) > 200_000:
                seen.clear()
                new = sorted({c for cs in pdf["chunks"] for c in cs})
            for part in encode(iter([pd.DataFrame({"chunk": new})])):
                seen.update(zip(part["chunk"], part["ids"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [[i for c in cs for i in seen[c]] + ([] if end_id is None else [end_id]) for cs in pdf["chunks"]]})

    return python_stage(documents.where(F.col("text").isNotNull()).select("doc_id", pretokenized(F.col("text"), mode).alias("chunks")), run, "doc_id bigint, ids array<int>")


def encode_with_starts(documents: DataFrame, merges: list[tuple[int, int, int, int, int]], end_id: int, mode: str = "gpt2") -> DataFrame:
    """doc_id, ids with the end mark behind, and start, the place of the document's first token when all follow each other by doc_id."""
    ids = materialise(encode_documents(documents, merges, mode, end_id), "ids")
    starts = running_before(ids.select("doc_id", F.size("ids").alias("n"), F.lit(0).alias("_all")), F.col("n"), ["doc_id"], ["_all"], "start")
    return ids.join(starts.select("doc_id", "start"), "doc_id")


def save_tokenizer(spark: SparkSession, merges: list[tuple[int, int, int, int, int]], folder: str, reserved: tuple[str, ...] = ()) -> None:
    """One JSON document: the merges in order, the tokens' bytes in hexadecimal by id, and the reserved marks, whose ids follow the last token's."""
    tokens = vocabulary(merges)
    body = {"merges": [list(m) for m in merges], "vocabulary": {str(i): b.hex() for i, b in tokens.items()}, "reserved": {t: max(tokens) + 1 + k for k, t in enumerate(reserved)}}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def load_tokenizer(spark: SparkSession, folder: str) -> tuple[list[tuple[int, int, int, int, int]], dict[str, int]]:
    """Merges and reserved marks of a saved tokenizer; one whose vocabulary isn't that of its merges is an error."""
    body = json.loads(spark.read.text(folder, wholetext=True).first()["value"])
    merges = [tuple(m) for m in body["merges"]]
    if {int(i): bytes.fromhex(b) for i, b in body["vocabulary"].items()} != vocabulary(merges):
        raise ValueError("the saved vocabulary doesn't belong to the merges")
    return merges, body["reserved"]


def pieces(ids: Column, merges: list[tuple[int, int, int, int, int]], reserved: dict[str, int] | None = None) -> Column:
    """What each token looks like: its text, a blank shown as a middle dot; bytes that are no text as the replacement character, ids that aren't known as null."""
    shown = {i: b.decode("utf-8", "replace").replace(" ", "·") for i, b in vocabulary(merges).items()} | {i: t for t, i in (reserved or {}).items()}
    table = F.create_map(*(x for i, t in shown.items() for x in (F.lit(i), F.lit(t))))
    return F.transform(ids, lambda i: F.try_element_at(table, i))


def vocabulary(merges: list[tuple[int, int, int, int, int]]) -> dict[int, bytes]:
    out = {i: bytes([i]) for i in range(256)}
    for _, a, b, new, _ in merges:
        out[new] = out[a] + out[b]
    return out


def decode(ids: Column, merges: list[tuple[int, int, int, int, int]]) -> Column:
    """Text of token ids; bytes that are no text become the replacement character, unknown ids (marks) nothing."""
    table = F.create_map(*(x for i, b in vocabulary(merges).items() for x in (F.lit(i), F.lit(b.hex()))))
    digits = F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.lit(""))), "")
    return F.unhex(digits).cast("string")


def compression(table: DataFrame, merges: list[tuple[int, int, int, int, int]], points: list[int]) -> DataFrame:
    """Tokens and bytes a token with only the first k merges, for each k.

    Merges take place in the order of their ranks, so the lengths for all k come from encoding a chunk once.
    """
    inside = {i: [] for i in range(256)}  # ranks of the merges that a token is made of
    for k, a, b, new, _ in merges:
        inside[new] = [*inside[a], *inside[b], k]
    encode = _encoder(merges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in encode(batches):
            sums = {k: [0, 0] for k in points}
            for chunk, freq, ids in zip(pdf["chunk"], pdf["freq"], pdf["ids"]):
                n, ranks = len(chunk.encode("utf-8")), sorted(r for i in ids for r in inside[i])
                for k in points:
                    sums[k][0] += int(freq) * (n - bisect_left(ranks, k))
                    sums[k][1] += int(freq) * n
            yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["merges", "tokens", "bytes"])

    out = python_stage(table.select("chunk", "freq"), run, "merges int, tokens bigint, bytes bigint").groupBy("merges").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    return out.withColumn("bytes_per_token", F.col("bytes") / F.col("tokens"))


def crossing(merges: list[tuple[int, int, int, int, int]]) -> int:
    """Merges whose text has a blank inside, which a splitting pattern would have ruled out."""
    return sum(b" " in v.strip(b" ") for i, v in vocabulary(merges).items() if i >= 256)

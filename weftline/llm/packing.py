"""Documents packed into windows of fixed capacity along a space-filling curve.

A document's tokens are hashed to pseudorandom vectors, summed and scaled to ``dims`` numbers; their Hilbert key puts documents of
like content near each other. Documents are range-sorted by the key and packed along the curve: of every ``near``
neighbours the largest first, each into the open window with the least space that still takes it. Windows that have space left
stay open for the neighbours that follow, ``keep`` of them at most. A text is cut only if it is longer than a window: it fills whole windows, and
its rest is packed like a document. All window sizes are packed in one pass over (doc_id, tokens, key); texts are never shuffled.

A task holds ``near`` documents and ``keep`` windows whatever the size of the input; a range of one key that is very frequent (exact copies)
is spread by a second sort column. Documents with null or empty text have no tokens and are in no window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import materialise, python_stage, table
from weftline.llm.tokens import TOKENIZERS, encoding, ship_tokenizer

DIMS, BITS = 4, 10


@dataclass(frozen=True)
class PackRules:
    near: int = 4096
    keep: int = 256
    tokenizer: str = TOKENIZERS


def projection(size: int = 50_300) -> np.ndarray:
    """A pseudorandom vector for each token; rarer tokens, which have higher numbers, weigh more."""
    x = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    unit = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5
    return unit * np.sqrt(12) * (np.log(2 + np.arange(size)) / np.log(size))[:, None]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below 2 to the bits (Skilling's transform, all rows at once)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[:, n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _measure(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, vectors = encoding(folder).encode_ordinary, projection()
        for pdf in batches:
            sizes, sums = np.zeros(len(pdf), np.int64), np.zeros((len(pdf), DIMS))
            for i, text in enumerate(pdf["text"]):
                ids = encode(text)
                if ids:
                    sizes[i] = len(ids)
                    sums[i] = vectors[ids].sum(axis=0) / np.sqrt(len(ids))
            grid = ((np.tanh(sums / 4) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": sizes, "key": hilbert_keys(grid)})

    return run


def measured(documents: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    """doc_id, tokens and Hilbert key of every text that has tokens."""
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    ship_tokenizer(documents.sparkSession, rules.tokenizer)
    return materialise(python_stage(texts, _measure(rules.tokenizer), "doc_id bigint, tokens bigint, key bigint").where("tokens > 0"), "sizes")


class Packer:
    """Windows of one capacity that are open, found by the space they have left."""

    def __init__(self, capacity: int, keep: int):
        self.capacity, self.keep = capacity, keep
        self.open: list[list[list[tuple[int, int, int, int]]]] = [[] for _ in range(capacity + 1)]
        self.free, self.count = 0, 0  # bit s: some open window has s left

    def _put(self, window: list, left: int) -> None:
        self.open[left].append(window)
        self.free |= 1 << left
        self.count += 1

    def _take(self, left: int) -> list:
        window = self.open[left].pop()
        self.count -= 1
        if not self.open[left]:
            self.free &= ~(1 << left)
        return window

    def add(self, doc: int, piece: int, start: int, size: int) -> list | None:
        """Put an item into the tightest open window; returns the window if that fills it."""
        fits = self.free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            window = self._take(left)
        else:
            left, window = self.capacity, []
        window.append((doc, piece, start, size))
        if left == size:
            return window
        self._put(window, left - size)
        return None

    def close(self, down_to: int) -> Iterator[list]:
        """Close the fullest windows until no more than so many are open."""
        while self.count > down_to:
            yield self._take((self.free & -self.free).bit_length() - 1)


def _pack(sizes: list[tuple[str, int]], rules: PackRules):
    columns = ["window_name", "window_id", "position", "doc_id", "piece", "start_token", "tokens", "filled", "seq_len"]

    def rows(name: str, capacity: int, windows: Iterator[list] | list[list]) -> list[tuple]:
        out = []
        for w in windows:
            filled = sum(x[3] for x in w)
            out += [(name, f"{w[0][0]}.{w[0][1]}", k, doc, piece, start, size, filled, capacity) for k, (doc, piece, start, size) in enumerate(w)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers = [(name, cap, Packer(cap, rules.keep)) for name, cap in sizes]
        for pdf in _chunks(batches, rules.near):
            docs, tokens = pdf["doc_id"].tolist(), pdf["tokens"].tolist()
            out: list[tuple] = []
            for name, cap, packer in packers:
                items, full = [], []
                for doc, n in zip(docs, tokens, strict=True):
                    whole = n // cap
                    full += [[(doc, k, k * cap, cap)] for k in range(whole)]
                    if n % cap:
                        items.append((n % cap, doc, whole))
                items.sort(key=lambda x: -x[0])
                full += [w for size, doc, piece in items if (w := packer.add(doc, piece, piece * cap, size)) is not None]
                out += rows(name, cap, full)
                out += rows(name, cap, packer.close(rules.keep))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([r for name, cap, packer in packers for r in rows(name, cap, packer.close(0))], columns=columns)

    return run


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        for lo in range(0, len(pdf), size):
            held.append(pdf.iloc[lo : lo + size])
            n += len(held[-1])
            if n >= size:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def packed(sized: DataFrame, windows: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    """One row per item: its window, place, document, piece, first token, tokens, and the window's fill.

    sized: doc_id, tokens, key. windows: window_name, seq_len, a fixed small table. A window is named after its first item.
    """
    sizes = [(r["window_name"], int(r["seq_len"])) for r in windows.where("seq_len > 0").select("window_name", "seq_len").distinct().orderBy("window_name").collect()]
    ordered = sized.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return python_stage(
        ordered, _pack(sizes, rules), "window_name string, window_id string, position int, doc_id bigint, piece int, start_token bigint, tokens bigint, filled bigint, seq_len int"
    )


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "window_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window size: windows, tokens, mean fill, and how many texts were cut."""
    items = p6_packed(spark, sf_dir)
    return items.groupBy("window_name", "seq_len").agg(
        F.sum(F.when(F.col("position") == 0, 1).otherwise(0)).alias("windows"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.sum(F.when(F.col("position") == 0, F.col("seq_len")).otherwise(0))), 6).alias("mean_fill"),
        F.sum(F.when((F.col("piece") == 1), 1).otherwise(0)).alias("cut_texts"),
    )

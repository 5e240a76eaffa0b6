"""The same or nearly the same entries in several splits, found by segmented similarity-hash codes.

Every distinct entry (headword and text without their manner of writing) gets a fingerprint of ten blocks:
two blocks of 32 bits over the character bigrams of the two ends of the headword, and eight blocks of 16 bits,
block z over those words of the text whose hash falls to z. Each block is a similarity hash of its own features
(majority of the signs of the features' hashes), so a change touches the blocks it falls into and no other.

Two texts are the same if at most ``max_words`` words and no more than a third of them differ. A changed word touches
two text blocks at most, so of eight at least ``8 - 2 * max_words`` are equal: that is the radius, counted in whole blocks, and it drops no
pair within the limit. One slip of spelling leaves an end of the headword as it was (the ends leave one or two characters in
the middle out, so a swap is covered). A pair is a candidate when a headword block and a text block with words in it agree.
Blocks without words are no keys. Two texts whose untouched blocks are all empty both have empty blocks; such texts also get
the headword block with each of their first ``max_words + 1`` words (longest first): of two texts that differ in no more than ``max_words``
words one of these is the same. So every pair within the limit is a candidate. A key under which more than ``hot`` pairs would meet
is replaced by keys of two text blocks (or two words), which any pair within the limit shares too. Candidates are verified by spelling and word distance.

Nulls: an entry without headword or text is no case. Exact copies are one class until the last join, so a group of
copies costs one fingerprint. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import materialise, python_stage, table
from weftline.llm.writing import one_slip, plain_words, squash, word_distance

ZONES = 8
_POS = re.compile(r"\s*\([^()]*\)\s*$")


@dataclass(frozen=True)
class CrossSplit:
    """Parameters: ``max_words`` changed words (3 at most, as there are eight text blocks), ``hot`` pairs under one key from which longer keys are used."""

    max_words: int = 3
    hot: int = 10_000

    def __post_init__(self):
        if not 0 <= 2 * self.max_words <= ZONES - 2:
            raise ValueError(f"max_words must be 0 to {(ZONES - 2) // 2}")

    def allowed(self, words: int) -> int:
        """Words that may differ where the shorter text has so many."""
        return min(self.max_words, words // 3)


@lru_cache(maxsize=200_000)
def _bits(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")


def majority_blocks(owner: np.ndarray, features: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """Similarity hash of each owner 0..blocks-1 over its features: bit i is set where more than half of them have it.

    Counts by one sorted segment sum over all owners of the batch; an owner without features gets 0.
    """
    order = np.argsort(owner, kind="stable")
    owner, features = owner[order], features[order]
    bits = np.unpackbits(features.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 8], axis=1, bitorder="little")
    out = np.zeros((blocks, width), dtype=np.uint8)
    if len(owner):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[starts, len(owner)])
        out[owner[starts]] = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > size[:, None]
    packed = np.packbits(out, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, 8 - width // 8))).reshape(-1).view("<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_blocks(texts: list[list[str]]) -> np.ndarray:
    """A row of eight 16-bit blocks for each text."""
    f = np.array([_bits(w) for ws in texts for w in ws], dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts]) * ZONES + (f & np.uint64(ZONES - 1)).astype(np.int64)
    return majority_blocks(owner, f >> np.uint64(8), len(texts) * ZONES, 16).reshape(-1, ZONES)


def head_blocks(heads: list[str], sizes: list[int]) -> np.ndarray:
    """The 32-bit blocks of the first and of the last ``sizes`` characters."""
    f, owner = [], []
    for i, (head, k) in enumerate(zip(heads, sizes, strict=True)):
        for side, part in ((0, head[:k]), (1, head[len(head) - k :])):
            grams = [_bits(f"{j}{part[j : j + 2]}") for j in range(max(1, k - 1))]
            f += grams
            owner += [2 * i + side] * len(grams)
    return majority_blocks(np.array(owner, dtype=np.int64), np.array(f, dtype=np.uint64), 2 * len(heads), 32).reshape(-1, 2)


def _normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        heads = [squash(_POS.sub("", t)) if t else "" for t in pdf["term"]]
        texts = [" ".join(plain_words(t)) for t in pdf["text"]]
        out = pd.DataFrame({"seed_key": pdf["seed_key"], "slug": pdf["slug"], "split": pdf["split"], "head": heads, "words": texts})
        yield out[(out["head"] != "") & (out["words"] != "")]


def least_words(ws: list[str], n: int) -> list[int]:
    """Hashes of the first n words in one order of all words (longest first); a repeated word counts each time."""
    seen: dict[str, int] = {}
    out = []
    for w in ws:
        seen[w] = seen.get(w, 0) + 1
        out.append((-len(w), _bits(f"{w} {seen[w]}")))
    return [x for _, x in sorted(out)[:n]]


def text_keys(ws: list[str], blocks: np.ndarray, max_words: int, size: int) -> set[int]:
    """Keys of ``size`` (1 or 2) text blocks, and of as many words where blocks are empty. Two texts within ``max_words`` share one of each size."""
    filled = {_bits(w) & (ZONES - 1) for w in ws}
    values = [int(blocks[z]) if z in filled else -1 for z in range(ZONES)]
    keys = {hash((size, c)) for c in combinations(enumerate(values), size) if any(v >= 0 for _, v in c)}
    if len(filled) <= ZONES - size:
        first = least_words(ws, max_words + size)
        keys |= {hash((-size, c)) for c in combinations(sorted(first), min(size, len(ws)))}  # a single word can only meet itself
    return keys


def _fingerprints(max_words: int, size: int):
    """The codes of each class, its headword blocks (the stored side under its own length, the probing side under each length one slip away) and its text keys of ``size`` parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts = [ws.split(" ") for ws in pdf["words"]]
            blocks = text_blocks(texts)
            at, heads, sizes = [], [], []
            for i, (held, head) in enumerate(zip(pdf["held"], pdf["head"], strict=True)):
                n = len(head)
                for k in sorted({max(1, (m - 1) // 2) for m in ((n - 1, n, n + 1) if held else (n,))}):
                    if k <= n:
                        at.append(i)
                        heads.append(head)
                        sizes.append(k)
            ends, k = head_blocks(heads, sizes), np.array(sizes, dtype=np.uint64)
            side = np.arange(2, dtype=np.uint64)[None, :]
            ends = _mix(ends + (k[:, None] << np.uint64(34)) + (side << np.uint64(33)))
            two = (blocks.reshape(-1, 2, 4) << (np.uint64(16) * np.arange(4, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
            first = np.searchsorted(np.array(at), np.arange(len(pdf) + 1))
            yield pd.DataFrame({
                "cid": pdf["cid"].values, "held": pdf["held"].values, "lo": two[:, 0], "hi": two[:, 1],
                "heads": [ends[i:j].reshape(-1).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)],
                "texts": [np.array(sorted(text_keys(ws, blocks[i], max_words, size)), dtype=np.int64) for i, ws in enumerate(texts)],
            })

    return run


def _verify(params: CrossSplit):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for ha, wa, hb, wb in zip(pdf["head_t"], pdf["words_t"], pdf["head_h"], pdf["words_h"], strict=True):
                a, b = wa.split(" "), wb.split(" ")
                most = params.allowed(min(len(a), len(b)))
                ok.append(one_slip(ha, hb) and word_distance(a, b, most) <= most)
            yield pdf.loc[ok, ["cid_t", "cid_h"]]

    return run


def current_files(manifest: DataFrame) -> DataFrame:
    """One row per file: of several builds the latest ``built_at`` counts; split in lower case, null is train."""
    return manifest.groupBy("slug").agg(F.max_by(F.struct("split"), F.struct("built_at", "split")).alias("m")).select("slug", F.coalesce(F.lower(F.trim("m.split")), F.lit("train")).alias("split"))


def _classes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries in comparable form, and the distinct ones of them on either side."""
    base = python_stage(entries.select("seed_key", "term", "text", "slug", "split"), _normal, "seed_key bigint, slug string, split string, head string, words string")
    base = base.withColumn("held", F.col("split") != "train").withColumn("cid", F.md5(F.concat_ws("\n", "head", "words")))
    base = materialise(base, "entries")
    return base, base.groupBy("cid", "held").agg(F.first("head").alias("head"), F.first("words").alias("words"))


def same_classes(classes: DataFrame, params: CrossSplit) -> DataFrame:
    """cid_t, cid_h of a class of train entries and one of held-out entries that are the same entry."""
    def coded(part: DataFrame, size: int) -> DataFrame:
        return python_stage(part, _fingerprints(params.max_words, size), "cid string, held boolean, lo bigint, hi bigint, heads array<bigint>, texts array<bigint>")

    def sides(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
        every = codes.select("held", "cid", "lo", "hi", "texts", F.explode("heads").alias("head")).select("held", "cid", "lo", "hi", "head", F.explode("texts").alias("text"))
        every = every.select("held", "cid", "lo", "hi", F.xxhash64("head", "text").alias("key"))
        pick = lambda held, s: every.where(held).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "lo", "hi")))
        return pick(~F.col("held"), "t"), pick(F.col("held"), "h")

    zones = [f"(shiftright(lo_t ^ lo_h, {16 * z}) & 65535) = 0" for z in range(4)] + [f"(shiftright(hi_t ^ hi_h, {16 * z}) & 65535) = 0" for z in range(4)]
    near = F.expr(" + ".join(f"cast({z} AS int)" for z in zones)) >= ZONES - 2 * params.max_words
    train, held = sides(materialise(coded(classes, 1), "codes"))
    counts = [side.groupBy("key").agg(F.count("*").alias(c)) for side, c in ((train, "t"), (held, "h"))]
    hot = materialise(counts[0].join(counts[1], "key").where(F.col("t") * F.col("h") > params.hot).select("key"), "hot")
    if hot.isEmpty():
        found = train.join(held, "key")
    else:  # the pairs of other keys come by those; the pairs of hot keys also agree in some longer key
        cold = lambda side: side.join(hot, "key", "left_anti")
        owner = lambda side, c, held: side.join(hot, "key", "left_semi").select(F.col(c).alias("cid"), F.lit(held).alias("held"))
        owners = owner(train, "cid_t", False).unionByName(owner(held, "cid_h", True)).distinct()
        longer = sides(materialise(coded(classes.join(owners, ["cid", "held"], "left_semi"), 2), "longer"))
        found = cold(train).join(cold(held), "key").unionByName(longer[0].join(longer[1], "key"))
    found = found.where(near).select("cid_t", "cid_h").distinct()
    side = lambda held, s: classes.where(held).select(*(F.col(c).alias(f"{c}_{s}") for c in ("cid", "head", "words")))
    return python_stage(found.join(side(~F.col("held"), "t"), "cid_t").join(side(F.col("held"), "h"), "cid_h"), _verify(params), "cid_t string, cid_h string")


def overlaps(entries: DataFrame, params: CrossSplit = CrossSplit()) -> DataFrame:
    """Pairs of an entry in train and one in another split that are the same entry.

    entries: seed_key, term, text, slug, split. Returns seed_key_t, slug_t, seed_key_h, slug_h, split_h.
    """
    base, classes = _classes(entries)
    same = same_classes(classes, params)
    members = lambda held, s: base.where(held).select(*(F.col(c).alias(f"{c}_{s}") for c in ("cid", "seed_key", "slug", "split")))
    pairs = same.join(members(~F.col("held"), "t"), "cid_t").join(members(F.col("held"), "h"), "cid_h")
    return pairs.select("seed_key_t", "slug_t", "seed_key_h", "slug_h", "split_h")


def overlap_counts(entries: DataFrame, params: CrossSplit = CrossSplit()) -> DataFrame:
    """split_h, slug_h, slug_t with how many pairs they have and how many entries of either file take part.

    Counted by the sizes of the classes in each file; copies are never expanded into pairs.
    """
    base, classes = _classes(entries)
    same = materialise(same_classes(classes, params), "same")
    sizes = base.groupBy("held", "cid", "slug", "split").agg(F.count("*").alias("n"))
    part = lambda held, s: sizes.where(held).select(*(F.col(c).alias(f"{c}_{s}") for c in ("cid", "slug", "split", "n")))
    full = materialise(same.join(part(~F.col("held"), "t"), "cid_t").join(part(F.col("held"), "h"), "cid_h"), "files")
    by = ["split_h", "slug_h", "slug_t"]
    held = full.groupBy(*by, "cid_h").agg(F.sum("n_t").alias("n_t"), F.first("n_h").alias("n_h"))
    held = held.groupBy(*by).agg(F.sum(F.col("n_t") * F.col("n_h")).alias("pairs"), F.sum("n_h").alias("held_entries"))
    train = full.groupBy(*by, "cid_t").agg(F.first("n_t").alias("n_t")).groupBy(*by).agg(F.sum("n_t").alias("train_entries"))
    key = lambda df: df.withColumnsRenamed({c: f"{c}_" for c in by})
    return held.join(key(train), [held[c].eqNullSafe(F.col(f"{c}_")) for c in by]).select(*by, "pairs", "held_entries", "train_entries")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "seeds").where(F.col("seed_kind") == "dictionary").select("seed_key", "term", "text", "slug")
    return seeds.join(current_files(table(spark, sf_dir, "manifest")), "slug", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps(_entries(spark, sf_dir))
    return pairs.select(F.least("seed_key_t", "seed_key_h").alias("seed_key_a"), F.greatest("seed_key_t", "seed_key_h").alias("seed_key_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and pair of files: how many pairs, and how many held-out and training entries they hold."""
    return overlap_counts(_entries(spark, sf_dir))

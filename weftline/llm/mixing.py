"""Sources mixed to target shares of all tokens, by blocks drawn through pseudorandom index permutations.

Each source's documents, in a hash order, are laid end to end and cut into blocks of ``block`` tokens. Where document boundaries are
respected, a block holds the whole documents that begin in it; elsewhere it may hold parts. The size of the mixture is the
largest at which every source reaches its share without repeating anything more often than allowed (or ``total``).
A source's slots are its whole rounds over all blocks and one partial round, cut where its tokens reach the target, so shares
are right to within a block. Each output shard draws how many of its slots each source gets from the multinomial distribution of the sources' slots, by a
generator of its own (seed and number of the shard). The draws miss the totals by their noise; the last shards are corrected until every
source has its slots exactly (``shares`` gives the shares as drawn beside the actual ones). A slot's number within its source, over all
shards, goes through the source's own permutation to a block's index, and the blocks are joined by that index.

Any shard can be drawn again by itself: what comes before it are sums over ``groups`` ranges of shards, which is all that the driver keeps of the
draws, with the corrected shards (of the order of the square root of all slots).

Offsets are prefix sums in two steps (sums of ``parts`` hash ranges by source, then within a range), so no task sees a whole
source. Only those sums and one number a source reach the driver. Sources are compared without case and blanks around; one
without weight or documents takes no part, and shares are those of the rest. Null and empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.session import materialise, python_stage, table
from weftline.llm.tokens import TOKENIZERS, encoding, ship_tokenizer


@dataclass(frozen=True)
class MixRules:
    """``block`` tokens, ``shard`` slots; ``parts`` hash ranges a source (by default as the session shuffles, 256 at least); ``groups`` ranges of shards."""

    block: int = 512
    shard: int = 256
    parts: int | None = None
    groups: int = 1024
    seed: int = 11
    total: int | None = None
    tokenizer: str = TOKENIZERS


def permute(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 (Feistel network over the next even number of bits, walked until it is in range)."""
    half = max(1, (max(2, int(size)) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & (2**64 - 1))
            x = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (x >> np.uint64(31))) & mask
        out[todo] = (left << np.uint64(half)) | right
        todo &= out >= np.uint64(size)
    return out.astype(np.int64)


def _sizes(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(folder).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encode(t)) for t in pdf["text"]]})

    return run


def _positions(blocks: dict[str, int], seeds: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            place = np.zeros(len(pdf), np.int64)
            for s in pdf["source"].unique():
                on = (pdf["source"] == s).to_numpy()
                place[on] = permute(pdf["block"].to_numpy()[on], blocks[s], seeds[s])
            yield pdf.assign(place=place)

    return run


class Draws:
    """How many slots of each shard each source gets: multinomial draws, corrected in the last shards to the sources' ``slots``."""

    def __init__(self, slots: list[int], shard: int, seed: int):
        self.slots, self.shard, self.seed = np.array(slots, np.int64), shard, seed
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // shard)
        self.weights = self.slots / max(1, self.total)
        self.corrected: dict[int, np.ndarray] = {}

    def drawn(self, k: int) -> np.ndarray:
        size = min(self.shard, self.total - k * self.shard)
        return np.random.default_rng([self.seed, k]).multinomial(size, self.weights)

    def counts(self, k: int) -> np.ndarray:
        return self.corrected[k] if k in self.corrected else self.drawn(k)

    def correct(self, drawn: np.ndarray) -> None:
        """Given what was drawn over all shards, move slots from sources with too many to those with too few, from the last shard backwards."""
        over = drawn - self.slots
        k = self.shards
        while over.any():
            k -= 1
            own = self.drawn(k)
            take = np.minimum(own, np.maximum(over, 0))
            moved, give = int(take.sum()), np.zeros_like(own)
            for s in np.flatnonzero(over < 0):
                give[s] = min(moved - int(give.sum()), -over[s])
            self.corrected[k] = own - take + give
            over = over - take + give


def _drawn(draws: Draws, per: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["id"]:
                n = sum((draws.drawn(k) for k in range(g * per, min((g + 1) * per, draws.shards))), np.zeros_like(draws.slots))
                yield pd.DataFrame({"group": g, "k": range(len(n)), "n": n})

    return run


def _slots(plan: list[dict], rules: MixRules, draws: Draws, per: int, before: dict[int, np.ndarray]):
    names = np.array([p["source"] for p in plan], dtype=object)
    blocks = np.array([p["blocks"] for p in plan])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["id"]:
                base = before[g].copy()
                for k in range(g * per, min((g + 1) * per, draws.shards)):
                    counts = draws.counts(k)
                    which = np.repeat(np.arange(len(plan)), counts)
                    nth = base[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                    base += counts
                    slot = np.random.default_rng([rules.seed, k, 1]).permutation(len(which))
                    yield pd.DataFrame({"shard": k, "slot": slot, "source": names[which], "round": nth // blocks[which], "place": nth % blocks[which]})

    return run


class Mixture:
    """The plan of a mixture (a few numbers a source) and its blocks; ``slots``, ``documents`` and ``shares`` give the results."""

    def __init__(self, documents: DataFrame, weights: DataFrame, rules: MixRules = MixRules()):
        self.spark, self.rules = documents.sparkSession, rules
        self.parts = rules.parts or max(256, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = F.lower(F.trim(F.col("source"))).alias("source")
        wanted = {r["source"]: r for r in weights.select(name, "weight", "max_repeats", "respect_doc_boundaries").where("weight > 0 and max_repeats > 0 and source is not null").collect()}
        texts = documents.select("doc_id", name, "text").where(F.length("text") > 0).where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
        ship_tokenizer(self.spark, rules.tokenizer)
        self.sized = materialise(python_stage(texts, _sizes(rules.tokenizer), "doc_id bigint, source string, tokens bigint").where("tokens > 0"), "sizes")
        ranged = self.sized.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int"))
        sums = ranged.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
        totals: dict[str, int] = {}
        before = []
        for r in sums.orderBy("source", "part").collect():  # at most sources x parts rows
            before.append((r["source"], r["part"], totals.get(r["source"], 0)))
            totals[r["source"]] = totals.get(r["source"], 0) + r["n"]
        self.wanted = {s: wanted[s] for s in sorted(totals)}
        weight = sum(r["weight"] for r in self.wanted.values())
        self.target = {s: r["weight"] / weight for s, r in self.wanted.items()}
        self.tokens, self.all_wanted = totals, wanted
        most = min((self.wanted[s]["max_repeats"] * totals[s] / self.target[s] for s in self.wanted), default=0)
        self.size = int(most if rules.total is None else min(most, rules.total))
        self.count = {s: -(-totals[s] // rules.block) for s in self.wanted}
        self.seeds = {s: rules.seed + 1 + k for k, s in enumerate(self.wanted)}
        self.pieces = self._pieces(ranged, before)
        self.plan = self._plan()
        self.draws, self.per, self.before, self.drawn = self._draw()

    def _pieces(self, ranged: DataFrame, before: list[tuple]) -> DataFrame:
        """doc_id, source, block, tokens of each document's part in each block."""
        b = self.rules.block
        start = self.spark.createDataFrame(before or [("", 0, 0)], "source string, part int, base bigint")
        cuts = self.spark.createDataFrame([(s, bool(r["respect_doc_boundaries"])) for s, r in self.wanted.items()] or [("", True)], "source string, whole boolean")
        order = Window.partitionBy("source", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
        at = ranged.withColumn("own", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(start, ["source", "part"]).join(cuts, "source")
        at = at.withColumn("lo", F.col("base") + F.col("own")).withColumn("hi", F.col("base") + F.col("own") + F.col("tokens"))
        first = F.floor(F.col("lo") / b)
        last = F.when(F.col("whole"), first).otherwise(F.floor((F.col("hi") - 1) / b))
        at = at.withColumn("block", F.explode(F.sequence(first, last)))
        part = F.least("hi", (F.col("block") + 1) * b) - F.greatest("lo", F.col("block") * b)
        pieces = at.select("doc_id", "source", "block", F.when(F.col("whole"), F.col("tokens")).otherwise(part).alias("tokens"))
        placed = python_stage(pieces, _positions(self.count, self.seeds), "doc_id bigint, source string, block bigint, tokens bigint, place bigint")
        return materialise(placed, "pieces")

    def _plan(self) -> list[dict]:
        """For each source: whole rounds, and how many places of the next round bring its tokens to the target."""
        parts = self.parts
        rest = {s: int(self.size * self.target[s]) % self.tokens[s] for s in self.wanted}
        rounds = {s: int(self.size * self.target[s]) // self.tokens[s] for s in self.wanted}
        if not self.wanted:
            return []
        count = F.create_map(*(x for s, n in self.count.items() for x in (F.lit(s), F.lit(n))))
        ranged = self.pieces.withColumn("range", F.floor(F.col("place") * parts / count[F.col("source")]).cast("int"))
        sums: dict[str, list[tuple[int, int]]] = {s: [] for s in self.wanted}
        for r in ranged.groupBy("source", "range").agg(F.sum("tokens").alias("n")).orderBy("source", "range").collect():
            sums[r["source"]].append((r["range"], r["n"]))
        inside = {}
        for s, ns in sums.items():
            got = 0
            for k, n in ns:
                if got + n > rest[s]:
                    inside[s] = (k, rest[s] - got)
                    break
                got += n
        edge = F.lit(False)
        for s, (k, _) in inside.items():
            edge = edge | ((F.col("source") == s) & (F.col("range") == k))
        left = F.create_map(*(x for s, (_, n) in inside.items() for x in (F.lit(s), F.lit(n)))) if inside else F.create_map(F.lit(""), F.lit(0))
        blocks = ranged.where(edge).groupBy("source", "place").agg(F.sum("tokens").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("place"))
        over = blocks.withColumn("run", run - F.col("n") / 2).where(F.col("run") > left[F.col("source")]).groupBy("source").agg(F.min("place").alias("cut"))
        cut = {r["source"]: r["cut"] for r in over.collect()}
        out = []
        for s in self.wanted:
            k = inside.get(s, (0, 0))[0]
            places = cut.get(s, -(-(k + 1) * self.count[s] // parts)) if s in inside else 0
            out.append({"source": s, "blocks": self.count[s], "rounds": rounds[s], "slots": rounds[s] * self.count[s] + places})
        return out

    def _draw(self) -> tuple[Draws, int, dict[int, np.ndarray], np.ndarray]:
        """The draws, shards a group, each source's slots before each group, and what was drawn before it was corrected."""
        draws = Draws([p["slots"] for p in self.plan], self.rules.shard, self.rules.seed)
        per = max(1, -(-draws.shards // self.rules.groups))
        groups = -(-draws.shards // per)
        if not groups:
            return draws, per, {}, draws.slots
        sums = np.zeros((groups, len(self.plan)), np.int64)
        for r in python_stage(self.spark.range(groups), _drawn(draws, per), "group bigint, k int, n bigint").collect():  # at most groups x sources rows
            sums[r["group"], r["k"]] = r["n"]
        drawn = sums.sum(axis=0)
        draws.correct(drawn)
        for k, counts in draws.corrected.items():
            sums[k // per] += counts - draws.drawn(k)
        before = np.cumsum(sums, axis=0) - sums
        return draws, per, dict(enumerate(before)), drawn

    def slots(self) -> DataFrame:
        """The mixture in order: shard, slot, source, round, block, and the documents (or parts of them) in it."""
        if not self.draws.total:
            return self.pieces.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("slot"), "source", F.lit(0).cast("bigint").alias("round"), "block", "doc_id", "tokens")
        run = _slots(self.plan, self.rules, self.draws, self.per, self.before)
        placed = python_stage(self.spark.range(len(self.before)), run, "shard bigint, slot bigint, source string, round bigint, place bigint")
        return placed.join(self.pieces, ["source", "place"]).select("shard", "slot", "source", "round", "block", "doc_id", "tokens")

    def documents(self) -> DataFrame:
        """The chosen documents: how often each is used (the most any of its tokens is) and its tokens in the mixture."""
        each = self.slots().groupBy("source", "doc_id", "block").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
        return each.groupBy("doc_id", "source").agg(F.max("uses").alias("uses"), F.sum("tokens").alias("tokens"))

    def shares(self) -> DataFrame:
        """For each source that has a weight: target share, share of the slots as drawn, actual share of the tokens, tokens in the mixture and at hand, the most uses of a document."""
        used = self.documents().groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
        drawn = {p["source"]: float(n) / max(1, self.draws.total) for p, n in zip(self.plan, self.drawn, strict=True)}
        rows = [(s, float(self.target.get(s, 0.0)), drawn.get(s, 0.0), int(r["max_repeats"]), self.tokens.get(s, 0)) for s, r in sorted(self.all_wanted.items())]
        want = self.spark.createDataFrame(rows, "source string, target_share double, drawn_share double, max_repeats int, available_tokens bigint")
        full = want.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
        return full.select(
            "source", "target_share", "drawn_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "tokens", "available_tokens",
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
        )


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).documents()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).slots()

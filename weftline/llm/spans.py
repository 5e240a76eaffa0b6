"""Long stretches that stand word for word in several documents, by prefix-partitioned sparse suffix trees.

Which suffixes: of every ``min_chars - gram + 1`` successive positions, the one whose ``gram`` characters hash least is an anchor.
The choice depends on those characters only, so two texts with ``min_chars`` in common share an anchor inside the common
stretch; the suffixes at the anchors are all that is needed, about one in seventy.

Partitioning: suffixes are grouped by their first ``gram`` characters. What a prefix's suffixes have in all is aggregated before the shuffle. A
prefix found in one document only is dropped, and for pairs so is a prefix whose suffixes all continue the same text from the
anchor before (the repeat is then not left-maximal there; the anchor before reports it). Each prefix of up to ``group`` suffixes is a subtree: sorted
suffixes, their longest common prefixes, and the internal nodes from them. At a node of depth d two suffixes of different
children form a case if they agree in ``min_chars - d`` characters before the anchor too.

A prefix with more suffixes holds boilerplate. Its suffixes are first collapsed into contexts (all characters around the anchor that matter);
the documents of a context are a class. Each context gives its ``min_chars`` long windows around the anchor as keys, and the
documents of a key are a class: exactly what a node of the subtree tells, found by hashing. So no large prefix is sorted in one
task, and a stretch that n documents have costs n rows, not n * n.

``shared_links`` gives pairs between representatives, classes and exact copies; ``shared_pairs`` expands them, block by block, for who needs
each pair. Exact copies met by one task become one document and are put back at the end. Documents with null text or fewer than
``min_chars`` characters have no cases; a stretch repeated within one document only is none. Documents are told apart by ``doc_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.session import materialise, python_stage, table

_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class SpanRules:
    """``min_chars``: least length of a shared stretch; ``gram``: characters an anchor is chosen by; ``group``: most suffixes of a subtree."""

    min_chars: int = 200
    gram: int = 64
    group: int = 2000

    @property
    def window(self) -> int:
        return self.min_chars - self.gram + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _slide(values: np.ndarray, w: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best over each window of w values, by running values from both ends of blocks of w."""
    n = len(values)
    full = np.concatenate([values, np.full(-n % w, pad, values.dtype)]).reshape(-1, w)
    ahead = best.accumulate(full, axis=1).reshape(-1)
    back = best.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes of the gram there, and hashes of the text since the anchor before (0 for the first)."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(chars)
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[:n], dtype=np.uint64)])
        grams = _mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
        least = _slide(grams, window, np.minimum, np.iinfo(np.uint64).max)
        m = len(grams)
        reach = _slide(np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]), window, np.maximum, 0)[:m]
        at = np.flatnonzero(reach == grams)
        between = _mix((prefix[at[1:]] - prefix[at[:-1]]) * inverse[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))
    return at, grams[at], np.concatenate([np.zeros(1, np.uint64), between | np.uint64(1)])


def _anchors(rules: SpanRules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for pdf in batches:
            out: list[tuple] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                if digest in seen:
                    out.append((doc, [int(_mix(np.array([doc & (2**64 - 1)], np.uint64)).view(np.int64)[0])], [-1], [seen[digest]]))
                    continue
                seen[digest] = doc
                at, grams, before = anchors(text, rules.gram, rules.window)
                out.append((doc, grams.view(np.int64), at, before.view(np.int64)))
            size = [len(x[2]) for x in out]
            flat = [np.concatenate([np.asarray(x[k], np.int64) for x in out]) if out else np.zeros(0, np.int64) for k in (1, 2, 3)]
            yield pd.DataFrame({"doc_id": np.repeat(np.array([x[0] for x in out], np.int64), size), "prefix": flat[0], "at": flat[1].astype(np.int32), "before": flat[2]})

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def nodes(rights: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Internal nodes of the tree over sorted suffixes: depth, and the ranges of the children. Deeper nodes are within their parent's children."""
    lcp = np.array([0, *(_common(a, b) for a, b in zip(rights, rights[1:]))])
    todo = [(0, len(rights))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        inner = lcp[lo + 1 : hi]
        depth = int(inner.min())
        cuts = [lo, *(np.flatnonzero(inner == depth) + lo + 1).tolist(), hi]
        children = list(zip(cuts, cuts[1:]))
        yield depth, children
        todo += [c for c in children if c[1] - c[0] > 1]


def _tails(lefts: list[str], members: range, need: int) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in members:
        if len(lefts[i]) >= need:
            out.setdefault(lefts[i][len(lefts[i]) - need :] if need else "", []).append(i)
    return out


def tree_pairs(docs: list[int], rights: list[str], lefts: list[str], before: list[int], min_chars: int) -> set[tuple[int, int]]:
    """Pairs of different documents with a stretch of min_chars around these anchors; suffixes must be sorted."""
    found: set[tuple[int, int]] = set()
    for depth, children in nodes(rights):
        child = {i: c for c, (lo, hi) in enumerate(children) for i in range(lo, hi)}
        for bucket in _tails(lefts, range(children[0][0], children[-1][1]), max(0, min_chars - depth)).values():
            groups: dict[int, list[int]] = {}
            for i in bucket:
                groups.setdefault(child[i], []).append(i)
            if len(groups) < 2:
                continue
            earlier: list[int] = []
            for own in groups.values():
                for i in own:
                    for j in earlier:
                        a, b = docs[i], docs[j]
                        if a != b and (before[i] != before[j] or before[i] == 0):
                            found.add((a, b) if a < b else (b, a))
                earlier += own
    return found


def tree_cover(docs: list[int], rights: list[str], lefts: list[str], min_chars: int) -> list[tuple[int, int]]:
    """For each suffix the most characters before and after its anchor that stand in another document as one stretch of min_chars; (0, 0) if none."""
    best = [(0, 0)] * len(docs)
    for depth, children in nodes(rights):
        for bucket in _tails(lefts, range(children[0][0], children[-1][1]), max(0, min_chars - depth)).values():
            if len({docs[i] for i in bucket}) < 2:
                continue
            back = sorted((lefts[i][::-1], i) for i in bucket)
            for step in (1, -1):
                for k in range(len(back)):
                    j = k + step
                    while 0 <= j < len(back) and docs[back[j][1]] == docs[back[k][1]]:
                        j += step
                    if 0 <= j < len(back):
                        i = back[k][1]
                        left, right = best[i]
                        best[i] = (max(left, _common(back[k][0], back[j][0])), max(right, depth))
    return best


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, list]]:
    """Whole groups, as lists by column, out of batches sorted by unit; holds no more than one group and one batch."""
    carry: dict[str, list] = {}
    for pdf in batches:
        now = {c: carry.get(c, []) + pdf[c].tolist() for c in pdf.columns}
        units = now["unit"]
        cuts = [0, *(i for i in range(1, len(units)) if units[i] != units[i - 1])]
        for lo, hi in zip(cuts, cuts[1:]):
            yield {c: v[lo:hi] for c, v in now.items()}
        carry = {c: v[cuts[-1] :] for c, v in now.items()}
    if carry and carry["unit"]:
        yield carry


def _subtrees(rules: SpanRules, cover: bool) -> Callable:
    columns = ["id", "lo", "hi"] if cover else ["a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for g in _groups(batches):
            order = sorted(range(len(g["id"])), key=g["right"].__getitem__)
            ids, docs, rights, lefts, mark = ([g[c][i] for i in order] for c in ("id", "own", "right", "left", "mark"))
            if cover:
                rows += [(ids[i], mark[i] - x, mark[i] + y) for i, (x, y) in enumerate(tree_cover(docs, rights, lefts, rules.min_chars)) if y]
            else:
                rows += tree_pairs(ids, rights, lefts, mark, rules.min_chars)
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def _trees(suffixes: DataFrame, rules: SpanRules, cover: bool) -> DataFrame:
    """suffixes: unit, id (given back), own (what tells documents apart), right, left, mark (place for cover, else the hash since the anchor before)."""
    schema = "id bigint, lo bigint, hi bigint" if cover else "a bigint, b bigint"
    return python_stage(suffixes.select("unit", "id", "own", "right", "left", "mark").repartition("unit").sortWithinPartitions("unit"), _subtrees(rules, cover), schema)


def _suffixes(documents: DataFrame, rules: SpanRules, maximal: bool) -> tuple[DataFrame, DataFrame]:
    """Suffixes whose prefix several documents have, with n, the number of these, and the exact copies (doc_id, of)."""
    long = documents.select("doc_id", "text").where(F.length("text") >= rules.min_chars)
    found = materialise(python_stage(long, _anchors(rules), "doc_id bigint, prefix bigint, at int, before bigint"), "anchors")
    placed = found.where("at >= 0")
    shared = placed.groupBy("prefix").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("prefix")
    placed = materialise(placed.join(shared, "prefix"), "shared")
    sizes = placed.groupBy("prefix").agg(F.min("before").alias("b0"), F.max("before").alias("b1"), F.count("*").alias("n"))
    if maximal:
        sizes = sizes.where("b0 <> b1 OR b0 = 0")
    placed = placed.join(sizes.select("prefix", "n"), "prefix")
    copies = found.where("at < 0").select("doc_id", F.col("before").alias("of"))
    wide = rules.min_chars
    text = placed.join(long, "doc_id")
    right = F.substring("text", F.col("at") + 1, F.lit(wide))
    left = F.substring("text", F.greatest(F.col("at") + 1 - wide, F.lit(1)), F.least(F.col("at"), F.lit(wide)))
    return materialise(text.select("doc_id", "prefix", "at", "before", "n", right.alias("right"), left.alias("left")), "suffixes"), copies


@dataclass(frozen=True)
class _Contexts:
    """The large prefixes by context: members (ctx, doc_id, at); contexts (ctx, prefix, right, left, least and greatest document d0 and d1, several)."""

    members: DataFrame
    contexts: DataFrame


def _contexts(suffixes: DataFrame, rules: SpanRules, left: int) -> _Contexts | None:
    large = suffixes.where(F.col("n") > rules.group)
    if large.isEmpty():
        return None
    large = large.withColumn("left", F.when(F.length("left") > left, F.substring("left", -left, left)).otherwise(F.col("left")) if left else F.lit(""))
    large = large.withColumn("ctx", F.xxhash64("prefix", F.length("left"), "left", "right"))
    each = large.groupBy("ctx").agg(F.first("prefix").alias("prefix"), F.first("right").alias("right"), F.first("left").alias("left"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    return _Contexts(large.select("ctx", "doc_id", "at"), materialise(each, "contexts").withColumn("several", F.col("d0") < F.col("d1")))


def _windows(contexts: DataFrame, rules: SpanRules) -> DataFrame:
    """ctx and key (a hash of the characters) of each window of min_chars that holds the context's anchor whole, and depth, how much of it is right of the anchor's start."""
    n = rules.min_chars
    depths = F.filter(F.sequence(F.lit(rules.gram), F.lit(n)), lambda d: (d <= F.length("right")) & (F.lit(n) - d <= F.length("left")))
    each = contexts.withColumn("depth", F.explode(depths))
    window = F.concat(F.expr(f"right(left, {n} - depth)"), F.expr("left(right, depth)"))
    return each.select("ctx", "d0", "d1", F.xxhash64("prefix", "depth", window).alias("key"), "depth")


@dataclass(frozen=True)
class Links:
    """Who shares a stretch, without expanding groups: ``pairs`` (a, b) of documents; ``classes`` (cls, doc_id) all of whose documents share one stretch; ``copies`` (doc_id, of), where a copy shares all that ``of`` shares."""

    pairs: DataFrame
    classes: DataFrame
    copies: DataFrame


def _distinct_classes(members: DataFrame) -> DataFrame:
    """Of the classes (cls, doc_id) with the same documents one, and none of a single document. Members of a class are summed up where they are before the shuffle."""
    members = materialise(members.distinct(), "members")
    signs = members.groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.min("doc_id").alias("d0"))
    kept = signs.where("n > 1").groupBy("n", "s", "d0").agg(F.min("cls").alias("cls"))
    return members.join(kept.select("cls"), "cls", "left_semi")


def shared_links(documents: DataFrame, rules: SpanRules = SpanRules()) -> Links:
    """All documents with a stretch of ``min_chars`` in common, as pairs, classes and copies."""
    suffixes, copies = _suffixes(documents, rules, maximal=True)
    small = suffixes.where(F.col("n") <= rules.group).select(F.col("prefix").alias("unit"), F.col("doc_id").alias("id"), F.col("doc_id").alias("own"), "right", "left", F.col("before").alias("mark"))
    pairs = materialise(_trees(small, rules, False).distinct(), "pairs")
    large = _contexts(suffixes, rules, rules.min_chars - rules.gram)
    if large is None:
        return Links(pairs, documents.sparkSession.createDataFrame([], "cls bigint, doc_id bigint"), copies)
    whole = large.contexts.where(F.col("several") & (F.length("left") + F.length("right") >= rules.min_chars)).select(F.col("ctx").alias("cls"), "ctx")
    keys = materialise(_windows(large.contexts, rules).select("ctx", F.col("key").alias("cls"), "d0", "d1"), "windows")
    met = keys.groupBy("cls").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.count("*").alias("n")).where("d0 < d1 AND n > 1").select("cls")
    classes = whole.unionByName(keys.join(met, "cls", "left_semi").select("cls", "ctx"))
    members = classes.join(large.members.select("ctx", "doc_id").distinct(), "ctx").select("cls", "doc_id")
    return Links(pairs, materialise(_distinct_classes(members), "classes"), copies)


def expanded(members: DataFrame, block: int = 2000) -> DataFrame:
    """a < b of every two documents of a class (cls, doc_id). A class is cut into blocks of about ``block``; each two blocks meet in a group of their own."""
    sizes = members.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = members.join(sizes, "cls").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low = placed.where("own <= other").select("cls", F.col("own").alias("lo"), F.col("other").alias("hi"), F.col("doc_id").alias("x"))
    high = placed.where("own >= other").select("cls", F.col("other").alias("lo"), F.col("own").alias("hi"), F.col("doc_id").alias("y"))
    met = low.join(high, ["cls", "lo", "hi"]).where("(lo < hi AND x <> y) OR x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared_pairs(documents: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """doc_id_a < doc_id_b of all documents with a stretch of ``min_chars`` in common."""
    links = shared_links(documents, rules)
    pairs = links.pairs.unionByName(expanded(links.classes))
    members = links.copies.select(F.col("of").alias("rep"), "doc_id").unionByName(links.copies.select(F.col("of").alias("rep"), F.col("of").alias("doc_id")).distinct())
    for c in ("a", "b"):
        pairs = pairs.join(members.toDF(c, "copy"), c, "left").withColumn(c, F.coalesce("copy", c)).drop("copy")
    both = pairs.unionByName(expanded(members.toDF("cls", "doc_id")))
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def _covered(documents: DataFrame, rules: SpanRules) -> tuple[DataFrame, DataFrame]:
    """doc_id, lo, hi of stretches around anchors that another document has too, which together cover all shared stretches; and the exact copies."""
    suffixes, copies = _suffixes(documents, rules, maximal=False)
    small = suffixes.where(F.col("n") <= rules.group).select(F.col("prefix").alias("unit"), F.col("doc_id").alias("id"), F.col("doc_id").alias("own"), "right", "left", F.col("at").cast("bigint").alias("mark"))
    spans = _trees(small, rules, True).withColumnRenamed("id", "doc_id")
    large = _contexts(suffixes, rules, rules.min_chars)
    if large is not None:
        n = rules.min_chars
        whole = large.contexts.where(F.col("several") & (F.length("left") + F.length("right") >= n)).select("ctx", (-F.length("left")).cast("bigint").alias("lo"), F.length("right").cast("bigint").alias("hi"))
        keys = materialise(_windows(large.contexts, rules), "windows")
        met = keys.groupBy("key").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1")).where("d0 < d1").select("key")
        far = keys.where(F.col("d0") == F.col("d1")).join(met, "key", "left_semi").groupBy("ctx").agg((F.min("depth") - n).cast("bigint").alias("lo"), F.max("depth").cast("bigint").alias("hi"))
        rel = whole.unionByName(far)  # all windows of a context hold its anchor, so their union has no gap
        spans = spans.unionByName(rel.join(large.members, "ctx").select("doc_id", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))
    return spans, copies


def shared_stretches(documents: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """doc_id, start, length of each longest run of characters all of which lie in a stretch of ``min_chars`` that another document has too; an exact copy is one run."""
    spans, copies = _covered(documents, rules)
    whole = copies.select("doc_id").unionByName(copies.select(F.col("of").alias("doc_id"))).distinct()
    order = Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    runs = spans.join(whole, "doc_id", "left_anti").withColumn("new", F.coalesce((F.col("lo") > F.max("hi").over(order)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("end")).select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"))
    copied = documents.select("doc_id", F.length("text").cast("bigint").alias("length")).join(whole, "doc_id", "left_semi")
    return runs.unionByName(copied.select("doc_id", F.lit(0).cast("bigint").alias("start"), "length"))


def shared_share(documents: DataFrame, rules: SpanRules = SpanRules()) -> DataFrame:
    """doc_id, n_chars, and shared_chars: how many characters lie in a stretch of ``min_chars`` that another document has too."""
    total = shared_stretches(documents, rules).groupBy("doc_id").agg(F.sum("length").alias("shared"))
    out = documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars")).join(total, "doc_id", "left")
    return out.select("doc_id", "n_chars", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_chars"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_stretches(table(spark, sf_dir, "documents"))

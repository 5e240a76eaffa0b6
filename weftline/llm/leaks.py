"""Test items that stand in training documents, found by a generalised suffix automaton over words.

All strings of the test items (prompt and choices) go into one suffix automaton; its transitions are words without
their writing. Each document is streamed through it once. After each word the automaton knows the longest run of words,
ending here, that stands in some item; the state of the run's last ``exact`` words knows all strings that hold them. A run of
at least ``exact`` words is a leak. A run of at least ``(near - 1) // 2 + 1`` words is the seed of a near leak: ``near`` item words
with one changed, left out or added must hold such a run, so seeds miss none; each is extended across one edit and measured.

The automaton is bounded: items beyond ``shard_words`` words are cut into several automata, each run over the documents, so none grows with the
test set. The driver reads the items (test sets, not corpora: their words must fit into its memory). The documents are read and never shuffled: leaks are
cut out of a text in the pass that finds them.

Null and blank texts have no leaks; items without words match nothing; repeated rows give repeated documents' leaks once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import python_stage, table
from weftline.llm.writing import fold

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_GLUE = "'’­​-‏⁠﻿̀-ͯ"
_PIECE = re.compile(rf"[^\W_]+(?:(?:[{_GLUE}]|[-‐‑¬­][ \t]*\r?\n\s*)+[^\W_]+)*")
_JOIN = re.compile(r"[-‐‑¬­][ \t]*\r?\n\s*|['’]")


@dataclass(frozen=True)
class LeakLimits:
    """``exact`` words in a row, or ``near`` with one edit; a text losing more than ``coverage`` of its words is dropped whole."""

    exact: int = 8
    near: int = 12
    coverage: float = 0.5
    shard_words: int = 500_000


def _blank_tags(text: str) -> str:
    return _TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text


def _word(piece: str) -> str:
    return fold(_JOIN.sub("", piece))


def item_words(text: str | None) -> list[str]:
    return [_word(p) for p in _PIECE.findall(_blank_tags(text))] if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; ``holders(v, k)`` are the strings that hold the last k words of a run at v."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        for n, s in enumerate(strings):
            last = 0
            for c in s:
                last = self._add(last, c, own)
                own[last].add(n)
        for v in sorted(range(1, len(own)), key=self.length.__getitem__, reverse=True):
            own[self.link[v]] |= own[v]
        self.own = [frozenset(x) for x in own]
        self._top: dict[int, list[int]] = {}

    def _add(self, last: int, c: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[last] + 1 == length[q] else self._clone(last, q, c, own)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        own.append(set())
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c, own)
        return cur

    def _clone(self, p: int, q: int, c: int, own: list[set[int]]) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        own.append(set())
        self.link[q] = k
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def holders(self, v: int, k: int) -> frozenset[int]:
        """Strings that hold the last k words of a run of at least k words that ended in state v."""
        if k not in self._top:
            top = list(range(len(self.link)))
            for u in sorted(range(1, len(top)), key=self.length.__getitem__):
                if self.length[self.link[u]] >= k:
                    top[u] = top[self.link[u]]
            self._top[k] = top
        return self.own[self._top[k][v]]

    def run(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run after each word."""
        v = n = 0
        nxt, link, length = self.next, self.link, self.length
        for c in ids:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            else:
                v = n = 0
            yield v, n


def _stretch(s: list[int], d: list[int], p: int, i: int, step: int) -> int:
    """How far s from p and d from i agree, in the direction of step."""
    n = 0
    while 0 <= p < len(s) and 0 <= i < len(d) and s[p] == d[i]:
        p, i, n = p + step, i + step, n + 1
    return n


def near_span(s: list[int], d: list[int], p: int, i: int) -> tuple[int, int, int]:
    """Around equal words s[p] and d[i]: the most item words covered by one run with one edit, and the span of d it takes."""
    right, left = _stretch(s, d, p, i, 1), _stretch(s, d, p - 1, i - 1, -1)
    best = (0, i, i)
    for ds, dd, gain in ((1, 1, 1), (1, 0, 1), (0, 1, 0)):  # changed, left out, added
        r = _stretch(s, d, p + right + ds, i + right + dd, 1)
        if r:
            best = max(best, (left + right + gain + r, i - left, i + right + dd + r))
        r = _stretch(s, d, p - left - 1 - ds, i - left - 1 - dd, -1)
        if r:
            best = max(best, (left + right + gain + r, i - left - dd - r, i + right))
    return best


class LeakScanner:
    """Streams texts through the automaton of a bounded set of strings, each with the number of its item."""

    def __init__(self, strings: list[tuple[int, list[str]]], limits: LeakLimits):
        self.limits = limits
        self.ids: dict[str, int] = {}
        self.items = [item for item, _ in strings]
        self.strings = [[self.ids.setdefault(w, len(self.ids) + 1) for w in ws] for _, ws in strings]
        self.automaton = SuffixAutomaton(self.strings)
        self.seed = (limits.near - 1) // 2 + 1
        self._seen: dict[str, int] = {}

    def _id(self, piece: str) -> int:
        got = self.ids.get(_word(piece), 0)
        if len(self._seen) > 300_000:
            self._seen.clear()
        self._seen[piece] = got
        return got

    def words(self, text: str) -> list[int]:
        seen = self._seen.get
        return [w if (w := seen(p)) is not None else self._id(p) for p in _PIECE.findall(_blank_tags(text).lower())]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """Number of the text, item and span of words for each leak; spans of one item may overlap."""
        docs = [self.words(t) if t else [] for t in texts]
        flat = np.fromiter((w for d in docs for w in (*d, 0)), dtype=np.int64)
        first = np.r_[0, np.cumsum([len(d) + 1 for d in docs])]
        known = np.flatnonzero(np.diff(np.r_[0, (flat > 0).astype(np.int8), 0]))
        starts, ends = known[::2], known[1::2]
        long = ends - starts >= min(self.limits.exact, self.seed)
        for a, b in zip(starts[long], ends[long], strict=True):
            n = int(np.searchsorted(first, a, side="right")) - 1
            yield from ((n, *x) for x in self._stretch_leaks(docs[n], int(a - first[n]), int(b - first[n])))

    def _stretch_leaks(self, d: list[int], a: int, b: int) -> Iterator[tuple[int, int, int]]:
        exact, seed, auto = self.limits.exact, self.seed, self.automaton
        found: dict[int, list[int]] = {}
        seeds: dict[int, set[int]] = {}
        for i, (v, n) in enumerate(auto.run(d[a:b]), a):
            if n >= exact:
                for s in auto.holders(v, exact):
                    span = found.setdefault(self.items[s], [i + 1 - exact, i + 1])
                    if span[1] >= i + 1 - exact:
                        span[1] = i + 1
                    else:
                        yield self.items[s], *span
                        found[self.items[s]] = [i + 1 - exact, i + 1]
            if n >= seed:
                for s in auto.holders(v, seed):
                    seeds.setdefault(s, set()).add(i)
        for item, span in found.items():
            yield item, *span
        for s, ends in seeds.items():
            word = self.strings[s]
            for i in ends:
                gram = d[i + 1 - seed : i + 1]
                for p in range(seed - 1, len(word)):
                    if word[p + 1 - seed : p + 1] == gram:
                        if p >= seed and i >= a + seed and word[p - seed] == d[i - seed]:  # the same run, measured where it begins
                            continue
                        n, x, y = near_span(word, d, p, i)
                        if n >= self.limits.near:
                            yield self.items[s], x, y


_SCANNERS: dict[object, LeakScanner] = {}


def _scanner(key: str, strings, limits: LeakLimits) -> LeakScanner:
    """One automaton a worker process, kept between its tasks."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = LeakScanner(strings.value, limits)
    return _SCANNERS[key]


def _shards(items: DataFrame, limits: LeakLimits) -> list[list[tuple[int, list[str]]]]:
    """The items' words in parts of bounded size; at least one part."""
    shards: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for row in items.where(F.col("text").isNotNull()).select("item_id", "text").distinct().toLocalIterator():
        ws = item_words(row["text"])
        if size + len(ws) > limits.shard_words and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append((row["item_id"], ws))
        size += len(ws)
    return shards


def leak_spans(documents: DataFrame, items: DataFrame, limits: LeakLimits = LeakLimits()) -> DataFrame:
    """Every leaked stretch: doc_id, item_id, first word, word after the last (words counted from 0).

    documents: doc_id, text. items: item_id, text (one row per string). The documents are read once for each shard of items.
    """
    out = None
    for shard in _shards(items, limits):
        strings = documents.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pd.DataFrame], strings=strings, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            scanner = _scanner(key, strings, limits)
            for pdf in batches:
                ids = pdf["doc_id"].tolist()
                rows = {(ids[n], item, x, y) for n, item, x, y in scanner.scan(pdf["text"].tolist())}
                yield pd.DataFrame(sorted(rows), columns=["doc_id", "item_id", "first_word", "end_word"])

        part = python_stage(documents.select("doc_id", "text").where(F.col("text").isNotNull()), run, "doc_id bigint, item_id bigint, first_word bigint, end_word bigint")
        out = part if out is None else out.unionByName(part)
    return out


def without_spans(text: str, spans: list[tuple[int, int]], coverage: float) -> tuple[int, int, bool, str | None]:
    """Words removed, words before, whether the text goes as a whole, and what is left of it."""
    at = [m.span() for m in _PIECE.finditer(_blank_tags(text))]
    kept, end, lost, seen = [], 0, 0, 0
    for x, y in sorted(spans):
        a, b = at[x][0], at[y - 1][1]
        lost, seen = lost + max(0, y - max(x, seen)), max(seen, y)
        if a > end:
            kept.append(text[end:a])
        elif not kept:
            kept.append("")
        end = max(end, b)
    kept.append(text[end:])
    share = lost / len(at)
    return lost, len(at), share > coverage, None if share > coverage else " ".join(k.strip(" ") for k in kept if k.strip(" "))


def remove_leaks(documents: DataFrame, items: DataFrame, limits: LeakLimits = LeakLimits()) -> DataFrame:
    """All documents without their leaked stretches: doc_id, removed_words, dropped, text.

    Found and cut in one pass without a shuffle. A text of which leaks cover more than ``coverage`` becomes null and ``dropped`` true; a
    text without leaks stays as it is. With several shards of items the passes follow each other in one stage, the spans going along with the text.
    """
    spark, shards = documents.sparkSession, _shards(items, limits)
    current = documents.select("doc_id", "text", F.array().cast("array<bigint>").alias("spans"))
    for k, shard in enumerate(shards):
        strings, last = spark.sparkContext.broadcast(shard), k == len(shards) - 1

        def run(batches: Iterator[pd.DataFrame], strings=strings, key=uuid.uuid4().hex, last=last) -> Iterator[pd.DataFrame]:
            scanner = _scanner(key, strings, limits)
            for pdf in batches:
                spans = [list(x) for x in pdf["spans"]]
                for n, _, x, y in scanner.scan(pdf["text"].tolist()):
                    spans[n] += (x, y)
                if not last:
                    yield pdf.assign(spans=spans)
                    continue
                rows = []
                for doc, text, flat in zip(pdf["doc_id"], pdf["text"], spans, strict=True):
                    if flat:
                        lost, _, gone, left = without_spans(text, [(int(x), int(y)) for x, y in zip(flat[::2], flat[1::2], strict=True)], limits.coverage)
                        rows.append((doc, lost, gone, left))
                    else:
                        rows.append((doc, 0, False, text))
                yield pd.DataFrame(rows, columns=["doc_id", "removed_words", "dropped", "text"])

        current = python_stage(current, run, "doc_id bigint, removed_words bigint, dropped boolean, text string" if last else "doc_id bigint, text string, spans array<bigint>")
    return current


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "domain_probes")
    return p.select("item_id", F.explode(F.concat(F.array("prompt"), F.coalesce("choices", F.array().cast("array<string>")))).alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(table(spark, sf_dir, "documents"), _items(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(table(spark, sf_dir, "documents"), _items(spark, sf_dir))

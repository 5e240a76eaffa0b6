"""Repair of text from scanned pages by a noisy channel: character confusions times corpus n-grams, decoded by Viterbi.

Lines are told apart first: page numbers (a number or small roman numeral alone, decorated or not) and running headers (a line all
of whose words are in capitals or begin with one, with or without number). They leave the text, and a line ending in a
hyphen is continued by the next line that is left.

The language model counts words and word pairs of all texts, exactly, by a shuffle. What the decoders need of it goes into two-row sketches: the
words that occur three times or more (no other can be what was meant) and the pairs that occur twice or more. A sketch has eight cells for each of
these between a least and a greatest size, so what is broadcast is bounded; beyond 2 to the ``most`` / 8 such words cells begin to be
shared. The reducers hand over dense packed blocks of it, never its cells one by one.

The channel begins with the confusions known from print and adds those that the texts show: words that equal a word ``excess`` times as
frequent but for one or two characters are aligned with it, and a substitution that explains enough different words (and a share of all of them that
no substitution by chance has) joins the inventory. All word types are aligned, and the probabilities are estimated from all of them
by a few rounds of expectation and maximisation: how often each confusion explains an odd word as a common one, against how often it could have
happened.

Each line is decoded over candidate words: the word itself, and words that become it by one or two confusions. An observed
word that is no more frequent than the channel predicts for its candidates is taken for their misreading, else its own count
speaks for it; the pair counts decide between candidates. A broken word is joined unless the corpus rather writes it with its hyphen.

Null and blank texts give no rows; texts are independent, so repeated rows give the same repairs. Texts are not shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import materialise, python_stage, table

# The right characters and what they are read as.
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("in", "m"), ("m", "in"), ("ni", "m"), ("nn", "m"), ("m", "nn"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("ii", "u"), ("w", "vv"), ("vv", "w"),
    ("h", "b"), ("b", "h"), ("h", "li"), ("li", "h"), ("n", "ri"), ("ri", "n"), ("e", "c"), ("c", "e"), ("c", "o"), ("o", "c"), ("n", "u"), ("u", "n"), ("a", "o"), ("o", "a"),
    ("f", "t"), ("t", "f"), ("i", "l"), ("l", "i"), ("i", "j"), ("j", "i"), ("v", "y"), ("y", "v"), ("g", "q"), ("q", "g"), ("s", "f"), ("f", "s"), ("tt", "u"), ("fi", "h"), ("k", "lc"),
    ("i", "!"), ("l", "!"), ("l", "|"), ("i", "|"), ("o", "0"), ("l", "1"), ("i", "1"), ("t", "†"), ("s", "ſ"), ("f", "ſ"), ("b", "6"), ("g", "9"), ("q", "9"), ("s", "5"), ("z", "2"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("e", "3"), ("a", "4"), ("t", "7"), ("b", "8"), ("g", "8"), ("g", "q"), ("e", "€"), ("s", "$"), ("a", "@"), ("t", "+"), ("c", "("), ("o", "°"),
]
CONFUSIONS = list(dict.fromkeys(CONFUSIONS))

_HYPHEN = "-‐‑¬­"
_ODD = "†ſ!|€$@+°("
_CORE = re.compile(rf"[\w{re.escape(_ODD)}](?:[\w{re.escape(_ODD)}'’{re.escape(_HYPHEN)}]*[\w†ſ|€$@+°])?")
_NUMBER = re.compile(r"^\W*(?:(?:p|pp|pg|page|seite|fol)\b\.?\s*)?[\dlIOoS]*\d[\dlIOoS]*\W*$", re.IGNORECASE)
_ROMAN = re.compile(r"^\W*(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\W*$")
_EDGE_NUMBER = re.compile(r"^\W*\d+\b\s*|\s*\b\d+\W*$")
_CHAPTER = re.compile(r"^\W*(?:chap(?:ter)?|book|part|sec(?:t(?:ion)?)?)\.?\s+[ivxlcdm\d]+\b[\s.\])}:—-]*", re.IGNORECASE)
_SMALL = frozenset("a an and at by for from in of on or the to with de la le du des et der die das und".split())


@dataclass(frozen=True)
class ScanRules:
    """Least and greatest sizes of the sketches as powers of two, rounds of estimation with the probability they start from and the least one of those that occur, and how far a count must exceed the expected misreadings.

    A confusion is learnt if it explains ``support`` word types and the share ``evident`` of all explained.
    """

    words: int = 22
    pairs: int = 21
    most: int = 23
    support: int = 5
    evident: float = 0.005
    rounds: int = 3
    start: float = 0.02
    least: float = 0.004
    excess: float = 12.0
    weight: float = 0.7


def is_page_number(line: str) -> bool:
    return bool(_NUMBER.match(line) or _ROMAN.match(line)) and len(line.strip()) <= 14


def is_header(line: str) -> bool:
    """A line all of whose words are capitals or begin with one, apart from a number at an end and a chapter mark before it."""
    first = line.split(None, 2)
    if len(first) < 2 or first[0].islower() or (first[1].islower() and first[1] not in _SMALL):
        return False
    text = _CHAPTER.sub("", line.strip())
    text = _EDGE_NUMBER.sub("", text).strip().rstrip(".")
    if len(text) > 70 or re.search(r"[,;:?\"“”]", text):
        return False
    ws = [w for w in text.split() if any(c.isalpha() for c in w)]
    if not 2 <= len(ws) <= 12:
        return False
    letters = [c for w in ws for c in w if c.isalpha()]
    if sum(c.isupper() for c in letters) >= 0.7 * len(letters):
        return True
    return all(w[0].isupper() or w[0].isdigit() or (k and w in _SMALL) for k, w in enumerate(ws)) and sum(w[0].isupper() for w in ws) >= 2 and line.strip()[-1] not in "!"


@dataclass
class Page:
    """Lines, their kinds (None blank, '' text), and the lower-case words of each line.

    A word broken at a line's end stands whole at the end of the line of its first half; ``broken`` has its halves and the
    line of the second, which begins with the word after it.
    """

    lines: list[str]
    kinds: list[str | None]
    cores: list[list[str]]
    broken: dict[int, tuple[str, str, int]]


def read_page(text: str) -> Page:
    lines = [x.rstrip("\r") for x in text.split("\n")]
    kinds: list[str | None] = []
    for x in lines:
        bare = x.strip()
        kinds.append(None if not bare else "page_number" if len(bare) <= 14 and is_page_number(bare) else "header" if is_header(x) else "")
    cores = [_CORE.findall(x.lower()) if k == "" else [] for x, k in zip(lines, kinds)]
    broken: dict[int, tuple[str, str, int]] = {}
    before = -1
    for i, k in enumerate(kinds):
        if k != "":
            continue
        if before >= 0:
            ends = lines[before].rstrip()
            if ends[-1] in _HYPHEN and cores[before] and cores[i] and ends[:-1].lower().endswith(cores[before][-1]) and lines[i].lstrip().lower().startswith(cores[i][0]):
                a, b = cores[before][-1], cores[i].pop(0)
                broken[before] = (a, b, i)
                cores[before][-1] = a + b
        before = i
    return Page(lines, kinds, cores, broken)


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Sketch:
    """Counts of words and pairs, never too low, by two cells each."""

    def __init__(self, rules: ScanRules, bits: tuple[int, int], total: int):
        self.rules, self.total = rules, max(1, total)
        self.masks = tuple((1 << b) - 1 for b in bits)
        self.rows = [np.zeros(1 << bits[r // 2], np.int32) for r in range(4)]

    def _least(self, kind: int, text: str) -> int:
        h, mask = _key(text), self.masks[kind]
        return int(min(self.rows[2 * kind][h & mask], self.rows[2 * kind + 1][h >> 32 & mask]))

    def word(self, w: str) -> int:
        return self._least(0, w)

    def pair(self, a: str, b: str) -> int:
        return self._least(1, f"{a} {b}")


def _is_number(core: str) -> bool:
    return core.isdigit()


def _counts(rules: ScanRules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        pairs: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            rows = [(0 if w.replace("-", "").isalpha() else 2, _key(w), w, n) for w, n in words.items() if not _is_number(w)]
            rows += [(1, _key(p), None, n) for p, n in pairs.items()]
            words.clear()
            pairs.clear()
            got = pd.DataFrame(rows, columns=["kind", "key", "word", "n"])
            return got.assign(key=got["key"].to_numpy(np.uint64).view(np.int64))

        for pdf in batches:
            for text in pdf["text"]:
                page = read_page(text)
                for i, cores in enumerate(page.cores):
                    whole = cores[:-1] if i in page.broken else cores
                    words.update(whole)
                    pairs.update(map(" ".join, zip(whole, whole[1:])))
            if len(words) + len(pairs) > 400_000:
                yield out()
        yield out()

    return run


class Channel:
    """The confusions with their probabilities, and the candidates of an observed word."""

    def __init__(self, confusions: list[tuple[str, str]], probability: list[float]):
        self.probability = probability
        self.by_seen: dict[str, list[tuple[str, int]]] = {}
        for k, (right, seen) in enumerate(confusions):
            if probability[k] > 1e-7:
                self.by_seen.setdefault(seen, []).append((right, k))
        self.widths = sorted({len(s) for s in self.by_seen})

    def _once(self, w: str, start: int = 0) -> Iterator[tuple[str, int, int]]:
        for i in range(start, len(w)):
            for n in self.widths:
                for right, k in self.by_seen.get(w[i : i + n], ()) if i + n <= len(w) else ():
                    yield w[:i] + right + w[i + n :], k, i + len(right)

    def candidates(self, w: str, known) -> list[tuple[str, float, tuple[int, ...]]]:
        """Known words that are read as w by one confusion, or else by two, or three where characters are no letters."""
        p = self.probability
        level = [(x, p[k], (k,), at) for x, k, at in self._once(w)]
        for edits in (1, 2, 3):
            found: dict[str, tuple[float, tuple[int, ...]]] = {}
            for x, q, ks, _ in level:
                if x != w and q > found.get(x, (0.0, ()))[0] and x.replace("-", "").isalpha() and known(x):
                    found[x] = (q, ks)
            if found:
                return [(x, q, ks) for x, (q, ks) in found.items()]
            if edits == 2:
                level = [y for y in level if not y[0].isalpha()]
            if edits < 3:
                level = [(y, q * p[k], (*ks, k), to) for x, q, ks, at in level for y, k, to in self._once(x, at)]
        return []


def _known(sketch: Sketch):
    cache: dict[str, bool] = {}

    def known(w: str) -> bool:
        got = cache.get(w)
        if got is None:
            if len(cache) > 500_000:
                cache.clear()
            got = cache[w] = sketch.word(w) >= 3
        return got

    return known


def _explain(sketch: Sketch, channel: Channel, w: str, n: int, known) -> list[tuple[str, float, tuple[int, ...]]]:
    """Candidates of an observed word if its count is no more than they would give by misreading, else none."""
    if len(w) < 2:
        return []
    found = [(x, sketch.word(x) * q, ks) for x, q, ks in channel.candidates(w, known)]
    found = [x for x in found if sketch.word(x[0]) > n + 1]
    expected = sum(x[1] for x in found)
    return found if found and (n <= sketch.rules.excess * expected + 2 or not w.replace("-", "").isalpha()) else []


def _estimate(model, confusions: list[tuple[str, str]], probability: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch: Sketch = model.value
        channel, known = Channel(confusions, probability), _known(sketch)
        hits, chances = np.zeros(len(confusions)), np.zeros(len(confusions))
        for pdf in batches:
            for w, n in zip(pdf["word"], pdf["n"], strict=True):
                found = _explain(sketch, channel, w, n, known)
                total = sum(x[1] for x in found)
                for _, q, ks in found:
                    for k in ks:
                        hits[k] += n * q / total
                if not found and n >= 3:
                    for k, (right, _) in enumerate(confusions):
                        if c := w.count(right):
                            chances[k] += n * c
        yield pd.DataFrame({"k": range(len(confusions)), "hits": hits, "chances": chances})

    return run


class Decoder:
    """Viterbi over candidate words of a line."""

    def __init__(self, sketch: Sketch, channel: Channel):
        self.sketch, self.channel, self.known = sketch, channel, _known(sketch)
        self._choices: dict[str, list[tuple[str, float]]] = {}
        self._plain: set[str] = set()

    def choices(self, w: str) -> list[tuple[str, float]]:
        """What w may be, with the log probability of reading w: itself alone where nothing else explains it."""
        got = self._choices.get(w)
        if got is None:
            if len(self._choices) > 200_000:
                self._choices.clear()
            if _is_number(w):
                got = [(w, 0.0)]
            else:
                found = _explain(self.sketch, self.channel, w, self.sketch.word(w), self.known)
                got = [(x, math.log(self.channel_probability(q, x))) for x, q, _ in found] or [(w, 0.0)]
            self._choices[w] = got
        return got

    def channel_probability(self, expected: float, x: str) -> float:
        return max(1e-12, expected / max(1, self.sketch.word(x)))

    def _language(self, a: str | None, b: str) -> float:
        s = self.sketch
        alone = (s.word(b) + 0.5) / s.total
        if a is None:
            return math.log(alone)
        m = s.rules.weight
        return math.log(m * s.pair(a, b) / max(1, s.word(a)) + (1 - m) * alone)

    def decode(self, cores: list[str]) -> list[str]:
        """The most probable words of a line; where no word has a choice nothing is computed."""
        options = [self.choices(c) for c in cores]
        if all(len(o) == 1 for o in options):
            return [o[0][0] for o in options]
        best = [(self._language(None, x) + q, [x]) for x, q in options[0]]
        for o in options[1:]:
            if len(o) == 1 and len(best) == 1:
                best = [(0.0, [*best[0][1], o[0][0]])]
                continue
            step = []
            for x, q in o:
                score, path = max((s + self._language(p[-1], x), p) for s, p in best)
                step.append((score + q, [*path, x]))
            best = step
        return max(best)[1]

    def strength(self, w: str) -> float:
        """Count of the most common word that w may be, weighed by the channel."""
        return max((self.sketch.word(x) * (1.0 if x == w else 0.3) for x, _ in self.choices(w)), default=0.0)

    def is_broken(self, halves: tuple[str, str]) -> bool:
        """Whether two halves at a line's end are one word written without a hyphen."""
        a, b = halves
        whole, compound = self.strength(a + b), self.strength(f"{a}-{b}")
        if compound > whole:
            return False
        if whole >= 2:
            return True
        return not (self.strength(a) >= 5 and self.strength(b) >= 5)

    def repair(self, page: Page) -> list[tuple[int, int, str, bool]]:
        """Line, number of the word in it, right form, and whether it was broken, of each word that is misread or broken."""
        out = []
        plain = self._plain
        for i, cores in enumerate(page.cores):
            halves = page.broken.get(i)
            whole = False
            if halves:
                whole = self.is_broken(halves[:2])
                if not whole:
                    cores[-1] = f"{halves[0]}-{halves[1]}"
            if not plain.issuperset(cores):
                odd = False
                for c in cores:
                    got = self.choices(c)
                    if len(got) == 1 and got[0][0] == c:
                        plain.add(c)
                    else:
                        odd = True
                if odd:
                    out += [(i, k, w, False) for k, (c, w) in enumerate(zip(cores, self.decode(cores), strict=True)) if w != c and not (whole and k == len(cores) - 1)]
            if whole:
                right = self.decode(cores)[-1] if cores[-1] not in plain else cores[-1]
                out.append((i, len(cores) - 1, right, True))
        if len(plain) > 300_000:
            plain.clear()
        return out


def _cased(seen: str, right: str) -> str:
    if len(seen) > 2 and seen.isupper():
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


def page_text(page: Page, repaired: list[tuple[int, int, str, bool]]) -> str:
    """Continuous paragraphs: without headers and numbers, broken words joined, misread words put right."""
    lines = list(page.lines)
    right = {(i, k): w for i, k, w, _ in repaired}
    for i in sorted({i for i, _ in right} | set(page.broken), reverse=True):
        x, own = lines[i], page.lines[i]
        skipped = any(h[2] == i for h in page.broken.values())
        spots = [m.span() for m in _CORE.finditer(own)][skipped:]
        for k in range(len(spots) - 1, -1, -1):
            a, b = spots[k]
            if k == len(page.cores[i]) - 1 and i in page.broken:
                j = page.broken[i][2]
                head, _, tail = lines[j].lstrip().partition(" ")
                word = right.get((i, k), page.cores[i][k])
                second = _CORE.search(page.lines[j]).group()
                lines[j], x = tail, x[:a] + _cased(own[a:b], word) + head[len(second) :]
            elif (i, k) in right:
                x = x[:a] + _cased(own[a:b], right[i, k]) + x[b:]
        lines[i] = x
    paragraphs: list[list[str]] = [[]]
    page_break = False
    for i, kind in enumerate(page.kinds):
        if kind is None:
            if not page_break and paragraphs[-1]:
                near = [k for k in page.kinds[i : i + 3] if k is not None][:1]
                if near and near[0] in ("header", "page_number"):
                    page_break = True
                    continue
                paragraphs.append([])
            continue
        if kind:
            page_break = True
            continue
        if page_break and paragraphs[-1] and re.search(r"[.!?][\"”’')]*$", paragraphs[-1][-1]):
            paragraphs.append([])
        page_break = False
        if lines[i].strip():
            paragraphs[-1].append(re.sub(r"\s+", " ", lines[i]).strip())
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


_DECODERS: dict[int, Decoder] = {}


def _decoder(model: ScanModel) -> Decoder:
    key = hash((tuple(model.confusions), tuple(model.probability)))
    if key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[key] = Decoder(model.sketch.value, Channel(model.confusions, model.probability))
    return _DECODERS[key]


@dataclass(frozen=True)
class ScanModel:
    """The trained channel and language model: a broadcast sketch of bounded size, the confusions and their probabilities."""

    sketch: object
    confusions: list[tuple[str, str]]
    probability: list[float]


_BLOCK = 16


def _dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed counts of each block of cells; all cells of a block are in one task."""
    blocks: dict[tuple[int, int], np.ndarray] = {}
    for pdf in batches:
        for (r, b), g in pdf.groupby(["r", "block"]):
            cells = blocks.setdefault((r, b), np.zeros(1 << _BLOCK, np.int64))
            np.add.at(cells, g["slot"].to_numpy() & ((1 << _BLOCK) - 1), g["n"].to_numpy())
    rows = [(r, b, zlib.compress(np.minimum(c, np.iinfo(np.int32).max).astype("<i4").tobytes(), 1)) for (r, b), c in blocks.items()]
    yield pd.DataFrame(rows, columns=["r", "block", "cells"])


def _sketch(counts: DataFrame, rules: ScanRules) -> Sketch:
    useful = counts.where("(kind = 0 AND n >= 3) OR (kind = 1 AND n >= 2)").select("kind", "key", "n")
    size = {r["kind"]: (r["useful"], r["total"]) for r in counts.groupBy("kind").agg(F.count_if(F.expr("n >= IF(kind = 1, 2, 3)")).alias("useful"), F.sum("n").alias("total")).collect()}
    wanted = {k: (8 * size.get(k, (0, 0))[0]).bit_length() for k in (0, 1)}
    bits = tuple(max(low, min(wanted[k], rules.most)) for k, low in ((0, rules.words), (1, rules.pairs)))
    sketch = Sketch(rules, bits, size.get(0, (0, 0))[1])
    mask = F.when(F.col("kind") == 0, (1 << bits[0]) - 1).otherwise((1 << bits[1]) - 1).cast("bigint")
    two = F.array(*(F.struct((F.col("kind") * 2 + r).cast("int").alias("r"), F.shiftrightunsigned("key", 32 * r).bitwiseAND(mask).alias("slot")) for r in (0, 1)))
    cells = useful.select(F.explode(two).alias("c"), "n").select("c.*", F.shiftright("c.slot", _BLOCK).cast("int").alias("block"), "n")
    for row in python_stage(cells.repartition("r", "block"), _dense, "r int, block int, cells binary").toLocalIterator():  # blocks of fixed size, as many as the sketch has
        got = np.frombuffer(zlib.decompress(row["cells"]), "<i4")
        at = row["block"] << _BLOCK
        part = sketch.rows[row["r"]][at : at + len(got)]
        part[:] = got[: len(part)]
    return sketch


def learnt_confusions(types: DataFrame, rules: ScanRules) -> list[tuple[str, str]]:
    """Substitutions (right, seen) of one or two characters by which words turn into much more frequent ones, where they explain enough of all words.

    types: word, n. A word and its frequent one meet by what is left and right of the place that differs; hashes stand for both, so long words are not moved.
    """
    long = types.where(F.length("word") >= 4)
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k")))
    places = F.flatten(F.array(at(1), at(2)))

    def parts(df: DataFrame, name: str) -> DataFrame:
        each = df.select("word", F.col("n").alias(f"n_{name}"), F.explode(places).alias("p")).select("*", "p.*")
        w = F.col("word")
        return each.select(F.xxhash64("word").alias(f"word_{name}"), f"n_{name}", F.xxhash64(F.col("i"), w.substr(F.lit(1), F.col("i") - 1), w.substr(F.col("i") + F.col("k"), F.length(w))).alias("key"), w.substr(F.col("i"), F.col("k")).alias(name))

    common = long.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= rules.excess))  # no other is so much more frequent than any
    met = parts(common, "right").drop("word_right").join(parts(long, "seen"), "key").where(F.col("n_right") >= rules.excess * F.col("n_seen"))
    r, s = F.col("right"), F.col("seen")
    ends = (F.substring(r, 1, 1) == F.substring(s, 1, 1)) | (F.substring(r, -1, 1) == F.substring(s, -1, 1))
    met = met.where((F.length(r) + F.length(s) < 4) & ~ends).groupBy("word_seen").agg(F.collect_set(F.struct("right", "seen")).alias("ways"))
    each = materialise(met.select(F.explode("ways").alias("w"), (1 / F.size("ways")).alias("n")).groupBy("w.right", "w.seen").agg(F.sum("n").alias("n")), "ways")
    total = each.agg(F.sum("n")).first()[0] or 0.0
    rows = each.where(F.col("n") >= max(rules.support, rules.evident * total)).collect()  # at most 1 / evident rows
    return sorted((x["right"], x["seen"]) for x in rows)


def train(texts: DataFrame, rules: ScanRules = ScanRules()) -> ScanModel:
    """Count all texts (column ``text``), learn the confusions and estimate the channel."""
    spark = texts.sparkSession
    counts = python_stage(texts.where(F.col("text").isNotNull()).select("text"), _counts(rules), "kind int, key bigint, word string, n bigint")
    counts = materialise(counts.groupBy("kind", "key", "word").agg(F.sum("n").alias("n")), "counts")
    model = spark.sparkContext.broadcast(_sketch(counts, rules))
    types = counts.where("kind <> 1").select("word", "n")
    known = set(CONFUSIONS)
    learnt = [x for x in learnt_confusions(types, rules) if x not in known]
    confusions = CONFUSIONS + learnt
    probability = [rules.start] * len(confusions)
    for _ in range(rules.rounds):
        got = python_stage(types, _estimate(model, confusions, probability), "k int, hits double, chances double").groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("chances").alias("chances")).collect()
        for r in got:
            seen = r["hits"] / (r["chances"] + 50)  # short and common words are hardly misread, so what happens at all is given a least rate
            probability[r["k"]] = min(0.05, max(rules.least, seen)) if r["hits"] >= 3 else min(seen, rules.least)
    return ScanModel(model, confusions, probability)


def _cases(model: ScanModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(model)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["seed_key"], pdf["text"], strict=True):
                page = read_page(text)
                rows += [(key, i, kind, "") for i, kind in enumerate(page.kinds) if kind]
                for i, k, word, broken in decoder.repair(page):
                    if broken:
                        rows.append((key, i, "hyphen", word))
                    if word != page.cores[i][k]:
                        rows.append((key, i, "misread", word))
            yield pd.DataFrame(rows, columns=["seed_key", "line_no", "kind", "word"]).drop_duplicates()

    return run


def _texts(model: ScanModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(model)
        for pdf in batches:
            pages = [read_page(t) for t in pdf["text"]]
            yield pd.DataFrame({"seed_key": pdf["seed_key"], "text": [page_text(p, decoder.repair(p)) for p in pages]})

    return run


def scan_cases(texts: DataFrame, model: ScanModel) -> DataFrame:
    """seed_key, line_no, kind, word of every fault."""
    return python_stage(texts.where(F.col("text").isNotNull()).select("seed_key", "text"), _cases(model), "seed_key bigint, line_no int, kind string, word string")


def repaired_texts(texts: DataFrame, model: ScanModel) -> DataFrame:
    """seed_key and the text as continuous paragraphs."""
    return python_stage(texts.where(F.col("text").isNotNull()).select("seed_key", "text"), _texts(model), "seed_key bigint, text string")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seeds").where(F.col("seed_kind") == "book_chunks").select("seed_key", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return scan_cases(chunks, train(chunks))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return repaired_texts(chunks, train(chunks))

"""Broken instruction and response pairs, by a conditional random field over the clauses of the response.

Each clause of a response is tagged as answer, refusal, echo, foreign or unfinished by a linear-chain conditional random field;
the share of the words under each tag decides the defect of the pair. The field is fitted here, on a bounded sample of rows
(``sample`` rows, taken in the order of a hash of their id). Nobody labelled them, so the labels are made: rules that are
sure but far from complete tag the sample's clauses, and known defects are put into copies of its sound rows (cut off
inside a clause, the instruction given back with small changes, responses in a language the task doesn't ask for, refusals
in common wordings). The field generalises over them by words, word pairs, opening words, quoting, overlap with the
instruction, language scores, and how the clause ends. Which language a clause is in is told by character trigrams: their model is
trained on the sample's clauses whose function words leave no doubt, so it also knows clauses without any function word. Every
row is then tagged over its whole text.

``empty`` needs no model: null, blank (also only invisible characters or punctuation), a placeholder, or shorter when trimmed than the task's least
number of characters. At most one defect a row, in the order empty, copy, refusal, language, truncated.

Nulls: a null instruction has no echo; a task without settings has no least length, language or ban on refusals. Rows are
judged one by one, so repeated rows get the same answer; the rows are not shuffled.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.session import python_stage, table
from weftline.llm.writing import fold, squash, words

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

# Common function words by language, for the language scores.
STOP_WORDS = {
    "en": "the a an of and to in is that which who was with for it on as at by from this be are or not you what when he his her would i we my",
    "de": "der die das und ist nicht ein eine den dem des mit zu von sich auf im war wie für aber als weil denn nur man es so sie ich",
    "fr": "le la les et est une un des du de que qui dans pour mais pas ne plus il elle était en au sur ce par je",
    "es": "el la los las y es una un de que en por para pero no se con era al del lo su ya como más yo",
    "it": "il lo la gli le e è una un di che in per ma non si con era al del della come più io",
    "nl": "de het een en is niet van dat die in op te met voor maar aan er was zijn als ik",
    "pt": "o a os as e é uma um de que em por para mas não se com era ao do da como mais eu",
}
# Responses that only hold a place, without punctuation and case.
PLACEHOLDERS = frozenset("na none null nil nan todo tbd tba empty blank noanswer noresponse noanswergiven missing placeholder undefined notapplicable answer response xxx".split())
# Common wordings of refusals, {w} standing for the subject.
REFUSALS = {
    "en": (
        "I'm sorry, but I can't help with that.", "I'm sorry, but I cannot assist with this request about {w}.", "I am unable to provide information on {w}.",
        "I cannot provide a definition of {w} at this time.", "I can't answer this question.", "As an AI language model, I cannot discuss {w}.",
        "As a language model, I am unable to give an opinion on {w}.", "I must decline to explain {w}, since it goes against my guidelines.",
        "Unfortunately, I am not able to help with that.", "Unfortunately that is not something I am able to assist with.",
        "My apologies, however I won't be able to respond to this question.", "I apologize, but I can't fulfill this request.",
        "It would not be appropriate for me to answer this. Please consult an expert on {w}.", "Sorry, no. I would rather not write about {w} today.",
        "I won't write about {w}.", "I do not feel comfortable answering that.", "I have to refuse this request.", "We regret that we cannot answer questions about {w}.",
        "I'm afraid I can't do that.", "I prefer not to answer questions about {w}.", "This request is against my policy, so I will not answer it.",
    ),
    "de": (
        "Es tut mir leid, aber dabei kann ich leider nicht helfen.", "Leider bin ich nicht in der Lage, etwas über {w} zu sagen.", "Leider kann ich diese Frage nicht beantworten.",
        "Entschuldigung, aber ich darf dazu keine Auskunft geben.", "Als Sprachmodell kann ich dazu keine Meinung äußern.", "Ich möchte über {w} lieber nichts schreiben.",
        "Ich muss es ablehnen, {w} zu erklären.", "Dazu kann ich nichts sagen.", "Das wäre nicht angemessen, bitte fragen Sie eine Fachperson.",
    ),
    "fr": ("Je suis désolé, mais je ne peux pas vous aider.", "Désolé, je ne peux pas répondre à cette question.", "Je ne suis pas en mesure de parler de {w}.", "En tant que modèle de langage, je ne peux pas donner d'avis."),
    "es": ("Lo siento, pero no puedo ayudar con eso.", "No puedo responder a esta pregunta.", "Lamentablemente no soy capaz de hablar de {w}.", "Como modelo de lenguaje, no puedo opinar."),
}

_SURE_REFUSAL = re.compile(
    r"^(i'?m sorry,? but i|i (cannot|can'?t|won'?t|must decline|am unable|am not able|do not feel|have to refuse)|as an? (ai|language) |my apologies|i apologi[sz]e|unfortunately,? (i|that is not something i)|sorry, no|it would not be appropriate for me|leider (bin|kann) ich|es tut mir leid, aber)",
    re.IGNORECASE,
)
_CLAUSE = re.compile(r"(?<=[.!?])[\"”’»)\]*_]*\s+|\n+")
_STOPPED = re.compile(r"[.!?…。][\"”“’'»)\]*_]*$")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
_QUOTE = re.compile(r"[\"“„«]([^\"”“»]*)[\"”“»]")
_STOP_SETS = {k: frozenset(fold(v).split()) for k, v in STOP_WORDS.items()}


@dataclass(frozen=True)
class PairRules:
    """``sample``: rows the field is fitted on; ``copy``, ``most``: shares of the words that make an echo, a refusal or a foreign response."""

    sample: int = 4000
    rounds: int = 150
    copy: float = 0.8
    most: float = 0.5
    seed: int = 7


def trimmed(text: str | None) -> str:
    """Without blanks and invisible characters at the ends."""
    if not text:
        return ""
    if text.isascii():
        return text.strip()
    lo, hi = 0, len(text)
    out = lambda c: c.isspace() or unicodedata.category(c) in ("Cf", "Cc", "Zs")
    while lo < hi and out(text[lo]):
        lo += 1
    while hi > lo and out(text[hi - 1]):
        hi -= 1
    return text[lo:hi]


def is_empty(text: str | None, least: int) -> bool:
    t = trimmed(text)
    if len(t) < least:
        return True
    s = squash(t) if len(t) < 40 else "x"
    return not s or s in PLACEHOLDERS


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(text) if c and not c.isspace()] or [text]


def language_scores(ws: list[str]) -> dict[str, int]:
    return {k: sum(w in v for w in ws) for k, v in _STOP_SETS.items()}


class Languages:
    """Which language a clause is in, by the log-probabilities of its character trigrams; trigrams share ``BINS`` bins."""

    BINS = 1 << 15

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    @classmethod
    def fit(cls, texts: list[str]) -> Languages:
        """Trained on the clauses that have two function words more of one language than of any other."""
        by: dict[str, list[str]] = {}
        for text in texts:
            for c in clauses(text):
                top = sorted(language_scores(words(c)).items(), key=lambda x: -x[1])
                if top[0][1] >= top[1][1] + 2:
                    by.setdefault(top[0][0], []).append(c)
        names = sorted(k for k, v in by.items() if len(v) >= 10)
        counts = np.full((cls.BINS, len(names)), 0.1)
        for k, name in enumerate(names):
            bins, _ = cls._bins(by[name])
            counts[:, k] += np.bincount(bins, minlength=cls.BINS)
        return cls(names, np.log(counts / counts.sum(0)).astype(np.float32))

    @classmethod
    def _bins(cls, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bins of all trigrams of all texts, and where each text's begin."""
        padded = [f"  {t.lower()} " for t in texts]
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars[(chars < 65) | ((chars > 90) & (chars < 97))] = 32  # digits and punctuation tell no language
        ends = np.cumsum([len(p) for p in padded])
        at = np.ones(len(chars), bool)
        at[ends - 1] = at[ends - 2] = False  # no trigram across two texts
        x = chars[:-2] * np.uint64(0x9E3779B1) ^ chars[1:-1] * np.uint64(0x85EBCA77) ^ chars[2:] * np.uint64(0xC2B2AE3D)
        bins = ((x ^ (x >> np.uint64(15))) % np.uint64(cls.BINS)).astype(np.int64)[at[:-2]]
        return bins, np.concatenate([[0], np.cumsum([len(p) - 2 for p in padded])[:-1]]).astype(np.int64)

    def marks(self, texts: list[str], wants: list[str | None]) -> list[str | None]:
        """For each clause whether it is in the wanted language and how sure that is; null where nothing can be said."""
        if not texts or len(self.names) < 2:
            return [None] * len(texts)
        bins, starts = self._bins(texts)
        score = np.add.reduceat(self.table[bins], starts, axis=0)
        best, top = score.argmax(1), np.sort(score, axis=1)
        column = {n: k for k, n in enumerate(self.names)}
        out: list[str | None] = []
        for i, want in enumerate(wants):
            k = column.get(want)
            if k is None:
                out.append(None)
            elif best[i] == k:
                out.append(f"gram:own:{min(6, int((top[i, -1] - top[i, -2]) / 4))}")
            else:
                out.append(f"gram:other:{min(6, int((top[i, -1] - score[i, k]) / 4))}")
        return out


def features(text: str, instruction: list[str], want: str | None, marks: list[str | None] | None = None) -> tuple[list[list[str]], list[int]]:
    """Feature names of each clause, and its number of words; marks: a language feature for each clause."""
    parts = clauses(text)
    out, size = [], []
    asked = set(instruction)
    for i, clause in enumerate(parts):
        plain = _QUOTE.sub(" ", clause)
        ws = words(plain)
        every = ws if len(plain) == len(clause) else words(clause)
        f = ["u:" + w for w in ws]
        f += ["b:" + a + " " + b for a, b in zip(ws, ws[1:])]
        if len(every) > len(ws):
            f.append("quotes")
        f.append("first:" + " ".join(every[:1]))
        f.append("first:" + " ".join(every[:2]))
        if every:
            shared = sum(w in asked for w in every) / len(every)
            f.append(f"asked:{int(shared * 5)}")
            if len(asked) > 2 and shared > 0.75:
                f.append(f"echo:{int(4 * min(1.25, len(every) / len(instruction)))}")
        scores = language_scores(every)
        best = max(scores.values(), default=0)
        if want and best:
            own = scores.get(want, 0)
            f.append(f"lang:{'own' if own == best else 'other'}:{min(4, abs(best - own))}:{min(3, best)}")
        else:
            f.append("lang:any" if not want else "lang:none")
        tail = clause.rstrip()
        stop, bullet, last = bool(_STOPPED.search(tail)), bool(_BULLET.match(clause)), i == len(parts) - 1
        if last:
            f.append(f"end:{stop}:{bullet}")
            f.append("end:" + (every[-1] if every else "") + f":{stop}")
            if not stop:
                f.append("end:" + (tail[-1] if tail and not tail[-1].isalnum() else "x"))
                f.append("open" if tail.count("(") > tail.count(")") or tail.count('"') % 2 else "closed")
        f.append(f"len:{min(8, len(every) // 4)}:{last}")
        if marks and marks[i]:
            f.append(marks[i])
        out.append(f)
        size.append(max(1, len(every)))
    return out, size


class ClauseField:
    """Linear-chain conditional random field: weights by feature and tag, and by neighbouring tags."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.vocabulary, self.weights, self.moves = vocabulary, weights, moves

    def _flat(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all clauses' features, and where each clause's start; each clause has the bias 0 first."""
        get = self.vocabulary.get
        ids: list[int] = []
        starts = []
        for row in rows:
            for f in row:
                starts.append(len(ids))
                ids.append(0)
                ids += [k for x in f if (k := get(x)) is not None]
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def _padded(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        full = np.zeros((len(sizes), int(sizes.max()), len(TAGS)))
        full[row, col] = scores
        return full, row, col

    def tag(self, rows: list[list[list[str]]]) -> list[np.ndarray]:
        """The best sequence of tags for each row (Viterbi)."""
        if not rows:
            return []
        ids, starts = self._flat(rows)
        sizes = np.array([len(r) for r in rows])
        score = np.add.reduceat(self.weights[ids], starts, axis=0)
        out: list[np.ndarray] = []
        for block in np.array_split(np.argsort(sizes, kind="stable"), max(1, len(rows) // 512)):  # rows of like length together
            out += self._viterbi(score, sizes, starts, block)
        back = np.empty(len(rows), dtype=object)
        for i, tags in out:
            back[i] = tags
        return list(back)

    def _viterbi(self, score, sizes, starts, block):
        first = np.cumsum(sizes) - sizes
        pick = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in block])
        full, _, _ = self._padded(score[pick], sizes[block])
        n, t, k = full.shape
        best, trace = full[:, 0], np.zeros((n, t, k), np.int8)
        live = sizes[block]
        for j in range(1, t):
            step = best[:, :, None] + self.moves[None]
            trace[:, j] = step.argmax(1)
            now = step.max(1) + full[:, j]
            on = (j < live)[:, None]
            trace[:, j] = np.where(on, trace[:, j], np.arange(k))
            best = np.where(on, now, best)
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = best.argmax(1)
        for j in range(t - 1, 0, -1):
            tags[:, j - 1] = trace[np.arange(n), j, tags[:, j]]
        return [(i, tags[r, : live[r]]) for r, i in enumerate(block)]

    @classmethod
    def fit(cls, rows: list[list[list[str]]], tags: list[list[int]], rounds: int) -> ClauseField:
        """Adam on the penalised log-likelihood, all rows at once (the sample is bounded)."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))  # long rows first, so each place in the chain concerns the first so many
        rows, tags = [rows[i] for i in order], [tags[i] for i in order]
        seen = Counter(x for r in rows for f in r for x in set(f))
        vocabulary = {x: i for i, x in enumerate((x for x, n in sorted(seen.items()) if n >= 3), 1)}
        k = len(TAGS)
        field = cls(vocabulary, np.zeros((len(vocabulary) + 1, k)), np.zeros((k, k)))
        ids, starts = field._flat(rows)
        sizes = np.array([len(r) for r in rows])
        gold = np.array([t for r in tags for t in r])
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
        moments = [np.zeros_like(x) for x in (field.weights, field.weights, field.moves, field.moves)]
        hot = np.eye(k)[gold]
        for step in range(1, rounds + 1):
            score = np.add.reduceat(field.weights[ids], starts, axis=0)
            full, row, col = field._padded(score, sizes)
            n, t, _ = full.shape
            reach = [int((sizes > j).sum()) for j in range(t)]
            ahead = np.zeros_like(full)
            ahead[:, 0] = full[:, 0]
            for j in range(1, t):
                x = ahead[: reach[j], j - 1, :, None] + field.moves[None]
                m = x.max(1)
                ahead[: reach[j], j] = m + np.log(np.exp(x - m[:, None]).sum(1)) + full[: reach[j], j]
            total = ahead[np.arange(n), sizes - 1]
            m = total.max(1)
            z = m + np.log(np.exp(total - m[:, None]).sum(1))
            back = np.zeros_like(full)
            pairs = np.zeros((k, k))
            for j in range(t - 2, -1, -1):
                r = reach[j + 1]
                x = field.moves[None] + (full[:r, j + 1] + back[:r, j + 1])[:, None]
                m = x.max(2)
                back[:r, j] = m + np.log(np.exp(x - m[:, :, None]).sum(2))
                pairs += np.exp(ahead[:r, j, :, None] + x - z[:r, None, None]).sum(0)
            marginal = np.exp(ahead + back - z[:, None, None])[row, col]
            wrong = marginal - hot
            grad = np.stack([np.bincount(ids, wrong[owner, c], len(field.weights)) for c in range(k)], axis=1) + 0.1 * field.weights
            inside = col[1:] > 0
            taken = np.zeros((k, k))
            np.add.at(taken, (gold[:-1][inside], gold[1:][inside]), 1)
            for x, g, a, b in ((field.weights, grad, *moments[:2]), (field.moves, pairs - taken + 0.1 * field.moves, *moments[2:])):
                a *= 0.9
                a += 0.1 * g
                b *= 0.98
                b += 0.02 * g * g
                x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-8)
        for x, i in vocabulary.items():  # a tag that the observation rules out: a clause with its final stop isn't unfinished
            if x.startswith("end:True:"):
                field.weights[i, UNFINISHED] = -1e3
        return field


def _sure_tags(text: str, instruction: list[str], want: str | None) -> list[int]:
    """Tags by rules that are sure; everything else passes for an answer."""
    out = []
    asked = set(instruction)
    parts = clauses(text)
    for i, c in enumerate(parts):
        ws = words(c)
        scores = language_scores(ws)
        if _SURE_REFUSAL.match(trimmed(c).replace("’", "'")):
            out.append(REFUSAL)
        elif len(asked) > 2 and ws and sum(w in asked for w in ws) >= 0.85 * len(ws) and len(ws) >= 0.7 * len(instruction):
            out.append(ECHO)
        elif want and max(scores.values()) >= scores.get(want, 0) + 2:
            out.append(FOREIGN)
        elif i == len(parts) - 1 and not _STOPPED.search(trimmed(c)) and not _BULLET.match(c):
            out.append(UNFINISHED)
        else:
            out.append(ANSWER)
    if out[0] == REFUSAL:  # what follows goes on with it: reasons, a wish, somebody to ask
        out = [REFUSAL] * len(out)
    return out


def _echoes(instruction: str, rng: random.Random) -> str:
    ws = instruction.split()
    k = rng.randrange(8)
    if k == 0:
        return instruction.upper()
    if k == 1:
        return f'"{instruction}"'
    if k == 2:
        return f"{rng.choice(['Q.', 'Question:', 'Instruction:', 'You asked:'])} {instruction}"
    if k == 3:
        return f"{instruction} {instruction}"
    if k == 4 and len(ws) > 4:
        del ws[rng.randrange(len(ws))]
        return " ".join(ws)
    if k == 5:
        return instruction.rstrip("?.! ")
    return instruction + rng.choice(["", "\n", " "])


def make_examples(rows: list[dict], seed: int, languages: Languages | None = None, refusals: dict[str, tuple[str, ...]] = REFUSALS) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Feature rows and tags out of the sample: its own clauses under sure tags, and copies with a defect put in."""
    rng = random.Random(seed)
    xs, ys = [], []

    def add(text: str, instruction: list[str], want: str | None, tags: list[int]) -> None:
        f, _ = features(text, instruction, want, languages and languages.marks(parts := clauses(text), [want] * len(parts)))
        if len(f) == len(tags):
            xs.append(f)
            ys.append(tags)

    langs = {r["want"] for r in rows if r["want"]}
    for r in rows:
        text, want = trimmed(r["response"]), r["want"]
        ask = words(r["instruction"])
        if is_empty(text, 1):
            continue
        tags = _sure_tags(text, ask, want)
        add(text, ask, want, tags)
        if any(tags):
            continue
        cut = [m.end() for m in re.finditer(r"\w", text[:-1])]
        if len(text) > 30:
            at = rng.choice(cut) if rng.random() < 0.4 else rng.choice([m.start() for m in re.finditer(r"\s", text)] or cut)
            short = text[:at].rstrip()
            if len(short) > 15 and not _STOPPED.search(short) and not _BULLET.match("\n" + short.split("\n")[-1]) and len(words(clauses(short)[-1])):
                add(short, ask, want, [ANSWER] * (len(clauses(short)) - 1) + [UNFINISHED])
        if r["instruction"] and rng.random() < 0.3:
            e = trimmed(_echoes(r["instruction"], rng))
            add(e, ask, want, [ECHO] * len(clauses(e)))
        if rng.random() < 0.4:
            own = want or "en"
            t = rng.choice(refusals.get(own if rng.random() < 0.8 else "en", refusals["en"])).replace("{w}", r["word"] or "this")
            t = t.upper() if rng.random() < 0.1 else t
            add(t, ask, want, [REFUSAL] * len(clauses(t)))
            if rng.random() < 0.3:
                t = rng.choice(["Is there anything else you need?", "Kindly ask somebody else.", "Please consult an expert.", "I would rather not write about it today."])
                r2 = rng.choice(["", "", "Hmm. ", "Well. "]) + rng.choice(refusals["en"]).replace("{w}", r["word"] or "this") + " " + t
                add(r2, ask, want, [REFUSAL] * len(clauses(r2)))
        scores = language_scores(words(text))
        spoken = max(scores, key=scores.__getitem__)
        for other in langs - {spoken}:
            if scores[spoken] >= scores.get(other, 0) + 3 and rng.random() < (1.0 if spoken != "en" else 0.2):
                add(text, ask, other, [FOREIGN] * len(tags))
    return xs, ys


def defect_of(tags: np.ndarray, size: list[int], forbid: bool, rules: PairRules) -> str | None:
    """The pair's defect by how much of the words each tag covers."""
    share = np.bincount(tags, size, len(TAGS)) / sum(size)
    if share[ECHO] >= rules.copy:
        return "copy"
    if share[REFUSAL] >= rules.most:
        return "refusal" if forbid else None
    if share[FOREIGN] >= rules.most:
        return "language"
    return "truncated" if tags[-1] == UNFINISHED else None


def _judge(fitted, rules: PairRules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, languages = fitted.value
        for pdf in batches:
            rows, defects, todo = [], {}, []
            texts: list[tuple[str, list[str], str | None]] = []
            for row_id, ask, text, least, want, forbid in zip(pdf["row_id"], pdf["instruction"], pdf["response"], pdf["least"], pdf["want"], pdf["forbid"], strict=True):
                if is_empty(text, int(least)):
                    defects[row_id] = "empty"
                    continue
                texts.append((trimmed(text), words(ask), want))
                todo.append((row_id, forbid))
            parts = [clauses(t) for t, _, _ in texts]
            marks = languages.marks([c for p in parts for c in p], [want for p, (_, _, want) in zip(parts, texts, strict=True) for _ in p])
            at, sizes = 0, []
            for p, (text, ask, want) in zip(parts, texts, strict=True):
                f, size = features(text, ask, want, marks[at : at + len(p)])
                at += len(p)
                rows.append(f)
                sizes.append(size)
            for (row_id, forbid), size, tags in zip(todo, sizes, model.tag(rows), strict=True):
                if (d := defect_of(tags, size, bool(forbid), rules)) is not None:
                    defects[row_id] = d
            yield pd.DataFrame({"row_id": list(defects), "defect": list(defects.values())}, columns=["row_id", "defect"]).astype({"row_id": "int64", "defect": "object"})

    return run


def broken_pairs(rows: DataFrame, specs: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    """row_id and defect of every broken pair. rows: row_id, task, instruction, response, meta.word; specs: name, quality."""
    spec = specs.select(
        F.col("name").alias("task"), F.coalesce("quality.min_response_chars", F.lit(0)).alias("least"), F.lower(F.col("quality.require_lang")).alias("want"), F.coalesce("quality.forbid_refusals", F.lit(False)).alias("forbid")
    )
    full = rows.join(spec, "task", "left").select(
        "row_id", "instruction", "response", F.col("meta.word").alias("word"), F.coalesce("least", F.lit(0)).alias("least"), "want", F.coalesce("forbid", F.lit(False)).alias("forbid")
    )
    answered = full.where(F.col("response").isNotNull())
    key = F.pmod(F.xxhash64("row_id"), F.lit(1 << 40))
    share = min(1.0, 4 * rules.sample / max(1, answered.count()))  # so that what the tasks send to the driver doesn't grow with them
    sample = answered.where(key < int(share * (1 << 40))).orderBy(key, "row_id").limit(rules.sample).collect()
    languages = Languages.fit([trimmed(r["response"]) for r in sample])
    xs, ys = make_examples([r.asDict() for r in sample], rules.seed, languages)
    field = ClauseField.fit(xs, ys, rules.rounds) if xs else ClauseField({}, np.zeros((1, len(TAGS))), np.zeros((len(TAGS),) * 2))
    fitted = rows.sparkSession.sparkContext.broadcast((field, languages))
    return python_stage(full, _judge(fitted, rules), "row_id bigint, defect string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "generated_rows").select("row_id", "task", "instruction", "response", "meta")
    return broken_pairs(rows, table(spark, sf_dir, "task_spec"))

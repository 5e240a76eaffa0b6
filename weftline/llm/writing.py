"""Normal forms that ignore how a text is written: case, accents, spacing, quoting, markup, invisible characters."""

from __future__ import annotations

import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_NOTE = re.compile(r"\[[^\[\]]*\]|\([^()]*\)")
_WORD = re.compile(r"[^\W_]+")
_LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}


def fold(text: str) -> str:
    """Lower case without accents and invisible characters; compatibility forms resolved."""
    if text.isascii():
        return text.lower()
    out = []
    for c in unicodedata.normalize("NFKD", text.casefold()):
        kind = unicodedata.category(c)
        if kind == "Mn" or kind == "Cf":
            continue
        out.append(_LATIN.get(c, c))
    return "".join(out)


def words(text: str | None) -> list[str]:
    """Letters and digits in runs, folded; apostrophes do not split a word."""
    if not text:
        return []
    return _WORD.findall(fold(text).replace("'", "").replace("’", ""))


def squash(text: str | None) -> str:
    """Only the folded letters and digits."""
    return "".join(_WORD.findall(fold(text))) if text else ""


def plain_words(text: str | None) -> list[str]:
    """Words without markup and notes in brackets; an ampersand counts as ``and``."""
    if not text:
        return []
    return words(_NOTE.sub(" ", _TAG.sub("", text)).replace("&amp;", " and ").replace("&", " and "))


def one_slip(a: str, b: str) -> bool:
    """Equal, or apart by one inserted, lost, changed or swapped character."""
    if a == b:
        return True
    m, n = len(a), len(b)
    if abs(m - n) > 1:
        return False
    if m > n:
        a, b, m, n = b, a, n, m
    i = 0
    while i < m and a[i] == b[i]:
        i += 1
    if m == n:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < m and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def word_distance(a: list[str], b: list[str], limit: int) -> int:
    """Levenshtein distance over words, or ``limit + 1`` as soon as it is larger."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    far = limit + 1
    row = [j if j <= limit else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):  # only the band of 2 * limit + 1 cells can stay within the limit
        lo, hi = max(1, i - limit), min(len(b), i + limit)
        left, row[lo - 1], best = row[lo - 1], i if lo == 1 and i <= limit else far, far
        best = row[lo - 1]
        for j in range(lo, hi + 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != b[j - 1]), far)
            best = min(best, row[j])
        if hi < len(b):
            row[hi + 1] = far
        if best > limit:
            return far
    return min(row[len(b)], far)

"""Text expressions over columns; all but ``nfc`` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[^\s\p{Z}]+"
BLANK_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
# The banners around the text of public e-books.
START_BANNER = r"(?is)^.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
END_BANNER = r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; nulls stay null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def collapse_blanks(text: Column) -> Column:
    """Runs of spaces and tabs to one space, three and more line breaks to two."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    """Unicode blanks off both ends."""
    return F.regexp_replace(text, BLANK_ENDS, "")


def strip_banners(text: Column) -> Column:
    """Cut through the first start banner and from the first end banner on; without a banner the text stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, START_BANNER, ""), END_BANNER, ""), r"^\n+|\n+$", "")


def words(text: Column) -> Column:
    """Runs of characters that are no Unicode blank."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("bigint")


def letters_words(text: Column) -> Column:
    """Lower-case words of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))


def strip_tags(text: Column) -> Column:
    """Tags and tags left open (``<name/``) to a space, blanks collapsed, ends cut."""
    out = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"<[a-zA-Z]+/", " ")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def one_block(text: Column) -> Column:
    """Blank lines inside a text collapsed, so a blank line can only part two texts."""
    return strip(F.regexp_replace(text, r"\n\s*\n+", "\n"))


def sentences(text: Column, least: int = 8) -> Column:
    """Sentences of at least so many words; a sentence ends after . ! or ? and blanks."""
    flat = F.split(F.regexp_replace(text, r"\n", " "), r"(?<=[.!?])[\s\p{Z}]+")
    return F.filter(F.transform(flat, strip), lambda s: F.size(words(s)) >= least)


def is_real_word(word: Column) -> Column:
    """At least three characters, the first a letter, and at most one of them no letter."""
    letters = F.length(F.regexp_replace(word, r"\P{L}", ""))
    return (F.length(word) >= 3) & F.substring(word, 1, 1).rlike(r"^\p{L}") & (letters >= F.greatest(F.lit(3), F.length(word) - 1))


def stable_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(key), 1, 8))


def order_key(seed: int, *ids: Column) -> Column:
    """A reproducible shuffle: order by this."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def unit_interval(seed: int, *ids: Column) -> Column:
    """A reproducible number in [0, 1) from the first 13 hex digits of the order key."""
    return F.conv(F.substring(order_key(seed, *ids), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding windows of n; empty for fewer tokens."""
    full = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n))
    return F.filter(full, lambda g: F.size(g) == n)


def distinct_share(tokens: Column, n: int) -> Column:
    """Different n-grams over n-grams, 0 where there are none."""
    grams = ngrams(tokens, n)
    return F.when(F.size(grams) > 0, F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)

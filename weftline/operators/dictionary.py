"""Entries out of dictionary markup, and prose out of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_real_word, stable_id, strip, strip_tags


def _field(block: Column, tag: str) -> Column:
    return strip_tags(F.regexp_extract(block, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def parse_entries(markup: DataFrame) -> DataFrame:
    """page_id, pos (of the block), word, part_of_speech, definitions of each usable entry.

    markup: page_id, html. A block without ``ent``, headword or definition is no entry; an empty ``ent`` falls back to ``hw``.
    """
    blocks = markup.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))).alias("pos", "block"))
    blocks = blocks.where(F.col("block").rlike(r"(?s)<ent>.*?</ent>"))
    ent = _field(F.col("block"), "ent")
    word = strip(F.regexp_replace(F.when(ent != "", ent).otherwise(_field(F.col("block"), "hw")), "[`*]", ""))
    defs = F.filter(F.transform(F.regexp_extract_all("block", F.lit(r"(?s)<def>(.*?)</def>"), F.lit(1)), strip_tags), lambda d: d != "")
    return blocks.select("page_id", "pos", word.alias("word"), _field(F.col("block"), "pos").alias("part_of_speech"), defs.alias("definitions")).where((F.col("word") != "") & (F.size("definitions") > 0))


def prose(word: Column, part_of_speech: Column, definitions: Column) -> Column:
    """``**word** (part): first; second``; the brackets only where there is a part of speech."""
    part = F.when(F.coalesce(part_of_speech, F.lit("")) != "", F.concat(F.lit(" ("), part_of_speech, F.lit(")"))).otherwise("")
    return F.concat(F.lit("**"), word, F.lit("**"), part, F.lit(": "), F.array_join(definitions, "; "))


def dictionary_seeds(entries: DataFrame, real_words: bool = True, least: int = 5) -> DataFrame:
    """Seeds of entries with a usable definition: id from the word and definition, term, text.

    entries: word, part_of_speech, definition.
    """
    ok = (F.coalesce("word", F.lit("")) != "") & (F.length(F.coalesce("definition", F.lit(""))) >= least)
    if real_words:
        ok = ok & is_real_word(F.col("word"))
    term = F.when(F.coalesce("part_of_speech", F.lit("")) != "", F.concat("word", F.lit(" ("), "part_of_speech", F.lit(")"))).otherwise(F.col("word"))
    return entries.where(ok).select(stable_id("dict", F.concat_ws(":", "word", "definition")).alias("id"), term.alias("term"), F.col("definition").alias("text"), "word")

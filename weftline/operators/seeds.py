"""Seeds for generation out of dictionaries, books and finished pairs, and their choice by kind."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.session import python_stage
from weftline.functions.text import stable_id, strip
from weftline.operators.dictionary import dictionary_seeds

# Fixed value: the text of a seed made of a finished pair.
PAIR_TEXT = ("Instruction: ", "\nGood answer (do NOT reuse this — write a WORSE one): ")
_BLANK_LINE = re.compile(r"\n\s*\n")


def pack(paragraphs: list[str], target: int) -> Iterator[str]:
    """Paragraphs joined by blank lines until a passage has ``target`` characters; the last may be shorter."""
    run: list[str] = []
    size = 0
    for p in paragraphs:
        size += len(p) + (2 if run else 0)
        run.append(p)
        if size >= target:
            yield "\n\n".join(run)
            run, size = [], 0
    if run:
        yield "\n\n".join(run)


def _passages(target: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(book, k, p) for book, text in zip(pdf["book"], pdf["text"], strict=True) for k, p in enumerate(pack([x for x in map(str.strip, _BLANK_LINE.split(text)) if x], target))]
            yield pd.DataFrame(rows, columns=["book", "chunk_no", "passage"])

    return run


def book_passages(books: DataFrame, target: int = 1200) -> DataFrame:
    """book, chunk_no (from 0), passage. books: book (string), text.

    Where a passage ends depends on where the one before ended, which no window function can say; each book is walked through once, where it is.
    Null and blank texts have no passages; a book that comes twice gives its passages twice.
    """
    return python_stage(books.where(F.col("text").isNotNull()).select(F.col("book").cast("string").alias("book"), "text"), _passages(target), "book string, chunk_no bigint, passage string")


def book_chunk_seeds(books: DataFrame, target: int = 1200) -> DataFrame:
    """id (from the book and the passage's first 64 characters), term (the book), text (the passage)."""
    key = F.concat("book", F.lit(":"), F.substring("passage", 1, 64))
    return book_passages(books, target).select(stable_id("book", key).alias("id"), F.col("book").alias("term"), F.col("passage").alias("text"))


def pair_seeds(rows: DataFrame) -> DataFrame:
    """id (from word and instruction), term (the word), text, and chosen, the good answer. rows: instruction, response, word; rows lacking one are left out."""
    full = rows.select(*(strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("instruction", "response", "word"))).where("instruction <> '' AND response <> '' AND word <> ''")
    text = F.concat(F.lit(PAIR_TEXT[0]), "instruction", F.lit(PAIR_TEXT[1]), "response")
    return full.select(stable_id("dpo", F.concat_ws(":", "word", "instruction")).alias("id"), F.col("word").alias("term"), text.alias("text"), F.col("response").alias("chosen"))


KINDS = {"dictionary": dictionary_seeds, "book_chunks": book_chunk_seeds, "sft_pairs": pair_seeds}


def seeds_of(kind: str, source: DataFrame, **options) -> DataFrame:
    """Seeds of a source by kind; a kind that isn't known is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of seeds {kind!r}; known are {', '.join(sorted(KINDS))}")
    return KINDS[kind](source, **options)

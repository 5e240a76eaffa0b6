"""Sizes of texts in tokens of a public byte-level tokenizer, read from a folder given as a parameter."""

from __future__ import annotations

import base64
import os

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from weftline.operators.tokenizer import GPT2

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
_LOADED: dict[str, object] = {}


def ship_tokenizer(spark: SparkSession, folder: str = TOKENIZERS) -> None:
    """Send the vocabulary's file to all executors; nothing is expected to lie on their machines."""
    spark.sparkContext.addFile(os.path.join(folder, VOCABULARY))


def encoding(folder: str = TOKENIZERS):
    """The tokenizer, loaded once a process; special tokens' strings are ordinary text."""
    if folder not in _LOADED:
        import tiktoken

        path = os.path.join(folder, VOCABULARY)
        if not os.path.exists(path):  # on an executor: the copy that Spark sent along
            path = SparkFiles.get(VOCABULARY)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[folder] = tiktoken.Encoding("weftline", pat_str=GPT2, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder]

"""Every query of the core by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import analysis, corpus, factory, probes

MODULES = (corpus, factory, analysis, probes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}

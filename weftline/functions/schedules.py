"""Closed formulas over columns: learning-rate schedules, cache, memory and compute sizes, and token costs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decay(progress: Column, floor: float) -> Column:
    return F.lit(floor) + F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * progress)) * (1 - floor)


def multiplier(step: Column, schedule: str, warmup: int, most: int, floor: float = 0.1, decay_share: float = 0.2) -> Column:
    """Share of the peak rate at a step: linear warm-up, then cosine, constant, or stable with a linear decay at the end."""
    up = F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup))))
    if schedule == "constant":
        return up.otherwise(1.0)
    if schedule == "cosine":
        return up.when(step >= most, floor).otherwise(_decay((step - warmup) / F.lit(float(max(1, most - warmup))), floor))
    if schedule == "wsd":
        start = most * (1 - decay_share)
        return up.when(step < start, 1.0).when(step >= most, floor).otherwise(1.0 - (step - start) / F.lit(float(max(1, most - start))) * (1 - floor))
    raise ValueError(f"unknown schedule {schedule!r}")


def finetune_multiplier(step: Column, warmup: int, total: int, floor: float = 0.1) -> Column:
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    after = _decay(progress, floor)
    return after if warmup <= 0 else F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(after)


def cache_bytes(attention: Column, kv_heads: Column, head_dim: Column, latent: Column, rope_dim: Column, width: int = 2) -> Column:
    """Bytes of key-value cache a token and layer."""
    return F.when(attention == "mla", (latent + rope_dim) * width).otherwise(2 * kv_heads * head_dim * width)


def flops_per_token(params: Column, vocab: Column, d_model: Column, layers: Column, seq_len: Column) -> Column:
    """Six for each parameter that computes, and the attention's own share of the context."""
    return 6 * (params + vocab * d_model) + 12 * layers * d_model * seq_len


def optimizer_bytes(trainable: Column, width: int = 4) -> Column:
    """Gradient and two moments."""
    return 3 * trainable * width


def usage_cost(hit: Column, prompt: Column, out: Column, prices: tuple[float, float, float], miss: Column | None = None) -> Column:
    """Cost of a call; tokens that missed the cache are the rest of the prompt where they aren't given."""
    missed = prompt - hit if miss is None else F.coalesce(miss, prompt - hit)
    return (hit * prices[0] + missed * prices[1] + out * prices[2]) / 1e6


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def bits(nll: Column) -> Column:
    return nll / F.lit(math.log(2))

"""Token prices by tier, and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import token_cost


def price_tier(tiers: Sequence[dict], prompt: Column) -> Column:
    """struct of the first tier whose max_input_tokens is null or not below the prompt, else of the last.

    tiers: rows in order with max_input_tokens, input_per_1m, cached_input_per_1m, output_per_1m. A price list is a
    short constant, so it becomes one expression and no join.
    """
    rate = lambda t: F.struct(*(F.lit(float(t[k])).alias(k) for k in ("input_per_1m", "cached_input_per_1m", "output_per_1m")))
    out = None
    for t in tiers:
        fits = F.lit(True) if t["max_input_tokens"] is None else prompt <= t["max_input_tokens"]
        out = F.when(fits, rate(t)) if out is None else out.when(fits, rate(t))
    return out.otherwise(rate(tiers[-1]))


def with_cost(usage: DataFrame, tiers: Sequence[dict], discount: float = 1.0) -> DataFrame:
    """usage (prompt_token_count, cached_content_token_count, candidates_token_count) with cost_usd."""
    t = F.col("_tier")
    cost = token_cost(F.col("prompt_token_count"), F.coalesce("cached_content_token_count", F.lit(0)), F.col("candidates_token_count"), t["input_per_1m"], t["cached_input_per_1m"], t["output_per_1m"], discount)
    return usage.withColumn("_tier", price_tier(tiers, F.col("prompt_token_count"))).withColumn("cost_usd", cost).drop("_tier")


def totals(usage: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = ("prompt_token_count", "cached_content_token_count", "candidates_token_count", "cost_usd")
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols))

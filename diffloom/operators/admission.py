"""Admission of requests: token budgets, request caps, question batches, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from diffloom.operators.fold import folded


def admitted(requests: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """(key, order.., cost, admitted): greedy in order within each key; a rejected request spends nothing.

    A fold, since later smaller requests may still fit. A null cost counts as 0.
    """
    rows = requests.select(key, *order, F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias(cost))

    def step(spent: int, c: int):
        fits = spent + c <= budget
        return (spent + c if fits else spent), fits

    return folded(rows, [key], order, [cost], 0, step, "admitted", "boolean")


def batches(questions: DataFrame, key: str, order: str, tokens: str, shared: int, total: int = 60_000, single: int = 30_000) -> DataFrame:
    """(key, order, tokens, batch): greedy batches per key under a total and a largest size; the first always fits.

    ``shared`` tokens (state and shared questions) count in every batch. A question above ``single`` gets a batch of
    its own.
    """
    rows = questions.select(key, order, F.col(tokens).cast("long").alias(tokens))

    def step(state: tuple, t: int):
        batch, held, top = state
        if held > 0 and (shared + held + t > total or shared + max(top, t) > single):
            batch, held, top = batch + 1, 0, 0
        return (batch, held + t, max(top, t)), batch

    return folded(rows, [key], [order], [tokens], (0, 0, 0), step, "batch", "int")


def capped(requests: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """``requests`` with ``within``: whether they are among the first ``limit`` of their key."""
    w = Window.partitionBy(key).orderBy(*order)
    return requests.withColumn("within", F.row_number().over(w) <= limit)


def rates(requests: DataFrame, at: str, window_s: int, *keys: str) -> DataFrame:
    """``requests`` with ``recent``: how many of their key came within the ``window_s`` seconds up to them.

    Times are compared in whole microseconds. A key's rows are parted by buckets of the window's width, each with the
    rows of the bucket before it, so a frequent key is spread over as many tasks as it has buckets.
    """
    width = window_s * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    own = F.floor(F.col("_us") / width)
    both = requests.withColumn("_us", micros).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-width, 0)
    return both.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("_bucket") == own).drop("_us", "_bucket")


def token_bucket(requests: DataFrame, at: str, tokens: str, rate: int, *keys: str) -> DataFrame:
    """``requests`` with ``admitted``: whether they fit the ``rate`` tokens of their key's second (a fixed window).

    In order of time and tokens; a request above the rate is admitted where it is the first of its second.
    """
    rows = requests.withColumn("_second", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000))

    def step(spent: int, t: int):
        fits = spent == 0 or spent + t <= rate
        return (spent + t if fits else spent), fits

    return folded(rows, [*keys, "_second"], [at, tokens], [tokens], 0, step, "admitted", "boolean").drop("_second")

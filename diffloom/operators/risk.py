"""Roll-ups of probabilities: noisy-OR, maps of maxima, counters, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diffloom.functions.scalars import round_to, severity_rank


def snapped_complement(p: Column) -> Column:
    """1 - p held within 0 and 1 and snapped to 6 places, so that products don't depend on the order of the factors."""
    return F.floor(F.round((F.lit(1.0) - F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))) * 1e6, 3) + 0.5) / 1e6


def noisy_or(df: DataFrame, *keys: str, p: str = "p", also: tuple[Column, ...] = ()) -> DataFrame:
    """(keys.., risk, n, also..): one minus the product of (1 - p) per key, rounded to 6 places.

    A map-side product: rows combine before the shuffle, however many a key has. ``also`` are more aggregates.
    """
    return df.groupBy(*keys).agg(round_to(F.lit(1.0) - F.product(snapped_complement(F.col(p)))).alias("risk"), F.count(F.lit(1)).alias("n"), *also)


def maxima(df: DataFrame, *keys: str, name: str, value: str) -> DataFrame:
    """(keys.., values): per key a map from ``name`` to the largest ``value``, entries sorted by name."""
    per = df.groupBy(*keys, name).agg(F.max(value).alias("_v"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_v")))).alias("values"))


def unit_risks(df: DataFrame, *keys: str, name: str, value: str) -> DataFrame:
    """(keys.., unit_risk, dimensions): per unit the largest value of its dimensions (0 without any), and their map."""
    per = maxima(df, *keys, name=name, value=value)
    return per.select(*keys, round_to(F.coalesce(F.array_max(F.map_values("values")), F.lit(0.0))).alias("unit_risk"), F.col("values").alias("dimensions"))


def file_risks(units: DataFrame, *keys: str) -> DataFrame:
    """(keys.., risk, units, priority, deep_review) from units (keys.., unit_risk, priority, reported).

    ``deep_review``: a risk of 0.8 or more where nothing is reported, or where a unit's priority is 2.5 or more.
    """
    per = noisy_or(units, *keys, p="unit_risk", also=(F.max("priority").alias("priority"), F.max(F.col("reported").cast("int")).alias("_r")))
    deep = (F.col("risk") >= 0.8) & ((F.col("_r") == 0) | (F.col("priority") >= 2.5))
    return per.select(*keys, "risk", F.col("n").alias("units"), "priority", deep.alias("deep_review"))


def severity_counts(found: DataFrame, *keys: str) -> DataFrame:
    """(keys.., critical, high, medium, low): counts with zeros."""
    return found.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")))


def verdicts(found: DataFrame, *keys: str, fail_on: str = "high", minimum: float = 0.8) -> DataFrame:
    """(keys.., decision, blocking): request_changes, comment or approve, from how many findings pass the gate.

    A row with a true ``injection``, if there is such a column, leads to a comment at least.
    """
    rank = {"low": 0, "medium": 1, "high": 2, "critical": 3}[fail_on]
    reported = F.col("band") == "report"
    blocking = F.count_if(reported & (severity_rank(F.col("severity")) >= rank) & (F.col("p_eff") >= minimum))
    spoken = F.count_if(F.col("injection")) if "injection" in found.columns else F.lit(0)
    decision = F.when(blocking > 0, "request_changes").when((F.count_if(reported) > 0) | (spoken > 0), "comment").otherwise("approve")
    return found.groupBy(*keys).agg(decision.alias("decision"), blocking.alias("blocking"))

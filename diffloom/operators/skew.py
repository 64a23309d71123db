"""Join of a large fact table with a dictionary of unique keys when some keys hold a large share of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Salts of a hot key, and the share of all facts from which a key counts as hot. At most 1/HOT_SHARE keys can
#: reach that share, so the table of hot keys has a proven bound and may be broadcast.
SALTS = 64
HOT_SHARE = 1 / 500


#: Rows up to which a table may be sent to every task.
SMALL = 20_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Keys of ``counts`` (key, n) that hold at least HOT_SHARE of ``total`` rows: at most 1/HOT_SHARE of them."""
    return counts.where(F.col(n) >= F.lit(max(1.0, total * HOT_SHARE))).select(key)


def dictionary_join(facts: DataFrame, dictionary: DataFrame, key: str, spread: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``facts`` joined with ``dictionary`` (unique ``key``); hot keys are spread over SALTS tasks by column ``spread``.

    Null keys match nothing (they stay with nulls under ``how="left"``). Only hot keys' dictionary rows are repeated.
    """
    h = hot.select(F.col(key).alias("_hot_key"))
    salted = (
        facts.join(F.broadcast(h), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        .drop("_hot_key")
    )
    d = dictionary.join(F.broadcast(h), F.col(key) == F.col("_hot_key"), "left")
    d = d.withColumn("_salt", F.explode(F.when(F.col("_hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot_key")
    return salted.join(d, [key, "_salt"], how).drop("_salt")

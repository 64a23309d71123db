"""Filling containers of fixed capacity with items of varying size.

The sizes of all items are counted (at most ``capacity`` distinct sizes, whatever the data), a plan is made on the
counts alone, and items take their places by rank within their size. The plan completes containers with a single, a
pair or a triple of sizes that fills the gap exactly, taken as often as the counts allow; what is left is best-fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from diffloom.session import staged

CAPACITY = 2048


class _Sizes:
    """Available sizes with counts, and bit sets that find complements: bit s of ``have`` says that size s is left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = dict(counts)
        self.capacity = capacity
        self.have = sum(1 << s for s in counts)
        self.mirror = sum(1 << (capacity - s) for s in counts)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            self.have ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)

    def largest(self, limit: int, used: dict[int, int]) -> int:
        """The largest size up to ``limit`` that isn't used up by ``used``; 0 if there is none."""
        bits = self.have & ((1 << (limit + 1)) - 1)
        while bits:
            s = bits.bit_length() - 1
            if self.n[s] > used.get(s, 0):
                return s
            bits ^= 1 << s
        return 0

    def _free(self, used: dict[int, int], *sizes: int) -> bool:
        return all(self.n.get(s, 0) >= used.get(s, 0) + sizes.count(s) for s in set(sizes))

    def pair(self, gap: int, used: dict[int, int], with_: tuple = ()) -> tuple | None:
        """Sizes (a, b) with a + b = gap that are still free, the largest a first."""
        bits = self.have & (self.mirror >> (self.capacity - gap)) & ((1 << gap) - 1)
        while bits:
            a = bits.bit_length() - 1
            if a < gap - a:
                return None
            if self._free(used, a, gap - a, *with_):
                return (a, gap - a, *with_)
            bits ^= 1 << a
        return None

    def exact(self, gap: int, used: dict[int, int]) -> tuple | None:
        """One, two or three free sizes that sum up to ``gap``."""
        if self.n.get(gap, 0) > used.get(gap, 0):
            return (gap,)
        top = self.have.bit_length() - 1
        if 2 * top >= gap and (found := self.pair(gap, used)):
            return found
        if 3 * top >= gap:
            bits = self.have & ((1 << gap) - 1)
            while bits:
                a = bits.bit_length() - 1
                if 3 * a < gap:
                    return None
                if self._free(used, a) and (found := self.pair(gap - a, used, (a,))):
                    return found
                bits ^= 1 << a
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns [(copies, {size: times})] that use up ``counts`` (size up to ``capacity`` -> number of items).

    A pattern is taken as often as its scarcest size allows, so the number of patterns depends on the number of
    distinct sizes, not of items.
    """
    sizes, patterns = _Sizes({s: n for s, n in counts.items() if n}, capacity), []
    while sizes.have:
        used: dict[int, int] = {}
        gap = capacity
        while gap:
            if used and (found := sizes.exact(gap, used)):
                for s in found:
                    used[s] = used.get(s, 0) + 1
                break
            s = sizes.largest(gap, used)
            if not s:
                break
            used[s] = used.get(s, 0) + 1
            gap -= s
        copies = min(sizes.n[s] // m for s, m in used.items())
        for s, m in used.items():
            sizes.take(s, copies * m)
        patterns.append((copies, used))
    return patterns


def _places(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """The plan as segments sorted by (size, first rank): which ranks of a size go to which containers."""
    rows, taken, base = [], {}, 0
    for copies, used in patterns:
        for s, m in used.items():
            start = taken.get(s, 0)
            rows.append((s, start, m, base))
            taken[s] = start + copies * m
        base += copies
    rows.sort()
    a = np.array(rows or [(0, 0, 1, 0)], dtype=np.int64)
    return (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (.., size) with ``piece`` and ``size``: an item above ``capacity`` gives full pieces and a rest."""
    whole = F.floor((F.col("size") - 1) / capacity).cast("int")
    cut = items.where(F.col("size") > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), whole)))
    return cut.withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int"))


def numbered(cut: DataFrame, capacity: int) -> DataFrame:
    """``cut`` with its partition and the rank of each row among the rows of its size in that partition."""

    def run(batches):
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            size = b.column("size").to_numpy()
            by_size = np.argsort(size, kind="stable")
            found, first, n = np.unique(size[by_size], return_index=True, return_counts=True)
            rank = np.empty(len(size), np.int64)
            rank[by_size] = np.arange(len(size)) - np.repeat(first, n) + np.repeat(seen[found], n)
            seen[found] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part), pa.int32()), pa.array(rank)], names=[*b.schema.names, "_part", "_rank"])

    return cut.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())]))


def pack(items: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(container, key, piece, size) from ``items`` (row_id, key, size).

    Items without size (null, 0 or less) are left out; an item above ``capacity`` is cut into full pieces and a rest;
    repeated rows are items of their own. Empty input gives an empty result. Only the counts of the at most
    ``capacity`` distinct sizes reach the driver. Ranks within a size are counted in each partition and moved by the
    counts of the partitions before it, so a size that most items have is not gathered anywhere.
    """
    spark = items.sparkSession
    cut = staged(numbered(pieces(items.select(key, "size"), capacity), capacity), "sizes")
    per_part = cut.groupBy("size", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["size"]: r["n"] for r in per_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        keys, start, times, base = places.value
        at = np.searchsorted(keys, (size.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1
        return pd.Series(base[at] + (rank.to_numpy(np.int64) - start[at]) // times[at])

    ranked = cut.join(offsets.drop("n"), ["size", "_part"])
    return ranked.select(container("size", F.col("_rank") + F.col("_before")).alias("container"), key, "piece", "size")

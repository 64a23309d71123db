"""Splitting oversized review units at natural boundaries by agglomerative merging.

Every line starts as a segment of its own. The boundaries between neighbours lie in a heap by strength, and the
weakest is merged first while the merged segment, with the lines it repeats from before it, stays within the limit.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_ADDED = 120
OVERLAP = 5
_OPENS = re.compile(r"\s*(?:def|class|func|fn|pub|public|private|protected|internal|export|function|interface|struct|enum|impl|type|async|static|namespace|module|@|#\[)")
_CLOSES = re.compile(r"\s*[\])}]+[;,)]*\s*$")


def strengths(lines: list[str]) -> list[float]:
    """How natural a cut before each line is: blank lines, closed blocks, new definitions and shallow indent count."""
    out, indent = [], [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    for i in range(1, len(lines)):
        before, here = lines[i - 1], lines[i]
        shallow = indent[i] if indent[i] >= 0 else indent[i - 1]
        s = max(0.0, 6 - max(shallow, 0) / 2)
        if not before.strip():
            s += 8
        elif _CLOSES.match(before):
            s += 5
        if _OPENS.match(here):
            s += 5
        if not here.strip() or _CLOSES.match(here):
            s -= 4
        out.append(s)
    return out


def segments(lines: list[str], added: list[int], limit: int = MAX_ADDED, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans [a, b) of ``lines`` that cover all of them; ``added`` has the number of added lines in each line (0 or 1).

    The added lines of a span and of the ``overlap`` lines before it never exceed ``limit``.
    """
    n = len(lines)
    total = [0]
    for x in added:
        total.append(total[-1] + x)
    end = list(range(1, n + 1))  # of the segment that starts here
    start = list(range(n))  # of the segment that ends before i + 1
    alive = [True] * n
    heap = [(s, i) for i, s in enumerate(strengths(lines), 1)]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)  # merge the segment that starts at i into the one before it
        a, b = start[i - 1], end[i]
        if total[b] - total[max(0, a - overlap)] <= limit:
            alive[i] = False
            end[a] = b
            start[b - 1] = a
    return [(i, end[i]) for i in range(n) if alive[i]]


def added_count(added: Column, start: Column, end: Column) -> Column:
    """Different added line numbers from ``start`` to ``end``; 0 for a null list."""
    return F.coalesce(F.size(F.array_distinct(F.filter(added, lambda x: (x >= start) & (x <= end)))), F.lit(0))


def split_units(units: DataFrame, limit: int = MAX_ADDED, overlap: int = OVERLAP, with_lines: bool = True) -> DataFrame:
    """(unit_id, piece, start_line, end_line, added_lines, source_lines): the pieces of units above ``limit``.

    Every piece but the first repeats the ``overlap`` lines before it; its ``start_line`` is that of the first repeated
    line. Units sent again count once (the earliest row by ingested_at, if there is such a column); null line lists, null added
    lists and line numbers outside the unit count as none; lines that are missing from ``source_lines`` are blank. If
    merging would leave a short rest it stays a piece of its own. Units at or below the limit are not in the result.
    """

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("unit_id", "piece", "start_line", "end_line", "added_lines", "source_lines")}
            for uid, lo, hi, nums, lines in zip(*(c.to_pylist() for c in b.columns)):
                have = {x - lo for x in nums if x is not None and lo <= x <= hi}
                text = [x or "" for x in lines or ()][: hi - lo + 1]
                text += [""] * (hi - lo + 1 - len(text))
                added = [int(i in have) for i in range(len(text))]
                for k, (p, q) in enumerate(segments(text, added, limit, overlap)):
                    p = max(0, p - overlap) if k else p
                    for name, x in zip(out, (uid, k, lo + p, lo + q - 1, sum(added[p:q]), text[p:q] if with_lines else None)):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("unit_id", pa.int64()), ("piece", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("added_lines", pa.int32()), ("source_lines", pa.list_(pa.string()))])
    large = units.where(added_count(F.col("added_line_numbers"), F.col("start_line"), F.col("end_line")) > limit)
    when = F.col("ingested_at") if "ingested_at" in units.columns else F.lit(0)
    unit = F.struct("start_line", "end_line", "added_line_numbers", "source_lines")
    large = large.groupBy(F.col("unit_id").cast("long").alias("unit_id")).agg(F.min_by(unit, F.struct(when, F.xxhash64(unit))).alias("u")).select("unit_id", "u.*")
    return large.mapInArrow(run, "unit_id bigint, piece int, start_line int, end_line int, added_lines int, source_lines array<string>")

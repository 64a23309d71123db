"""Review units: windows over long runs of added lines, capped merging, scopes, imports, snippets, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffloom.operators.fold import folded

MAX_ADDED = 120
OVERLAP = 5
MERGE_GAP = 6
SCOPE_REACH = 60
# How a line that opens a scope begins, by language.
SIGNATURES = {
    "python": r"^\s*(?:async\s+)?def\s+\w+|^\s*class\s+\w+",
    "go": r"^\s*func\s+(?:\([^)]+\)\s*)?\w+|^\s*type\s+\w+",
    "rust": r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+\w+|^\s*(?:pub\s+)?(?:struct|enum|impl)\b",
}
BRACED = r"^\s*(?:export\s+)?(?:default\s+)?(?:public|private|protected|internal|static|sealed|abstract|final|async|\s)*(?:class|interface|enum|struct|function)\b|^\s*(?:[\w<>\[\],.?]+\s+)+\w+\s*\([^;]*\)\s*\{?\s*$"

# How an import line begins, or what it holds.
IMPORT = r"^(?:import|from|package|using|use) |require\("


def window_spans(n: Column, limit: int = MAX_ADDED, overlap: int = OVERLAP) -> Column:
    """Array of (chunk, first, last), 1-based, that cover ``n`` lines in chunks of up to ``limit`` sharing ``overlap``.

    The closed form of the sliding split: one chunk for n <= limit, else ceil((n - overlap) / (limit - overlap)).
    """
    step = limit - overlap
    chunks = F.when(n <= limit, F.lit(1)).otherwise(F.ceil((n - overlap) / F.lit(step)).cast("int"))
    spans = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.struct(k.alias("chunk"), (k * step + 1).alias("first"), F.least(k * step + limit, n).cast("int").alias("last")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<chunk:int,first:int,last:int>>"))


def added_runs(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, run_start, run_end, added): consecutive added line numbers of each file; repeats and nulls count as none.

    Islands by value minus rank: one shuffle on (key, line).
    """
    lines = files.select(key, F.explode(F.array_distinct("added_line_numbers")).alias("line")).where("line IS NOT NULL").distinct()
    island = F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return lines.withColumn("_island", island).groupBy(key, "_island").agg(F.min("line").alias("run_start"), F.max("line").alias("run_end"), F.count(F.lit(1)).cast("int").alias("added")).drop("_island")


def merged_units(runs: DataFrame, key: str = "file_id", gap: int = MERGE_GAP, limit: int = MAX_ADDED, scope: str | None = None) -> DataFrame:
    """(key, unit_no, start_line, end_line, added): neighbouring runs merged while the gap, the cap and the scope allow.

    Runs are of one scope if both have none or the same; that of a merged unit is the scope of its first run. The cap
    makes the result depend on the order, so each file's runs are folded in line order, one state at a time.
    """
    rows = runs.select(key, "run_start", "run_end", "added", (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("_scope"))

    def step(state: tuple, start: int, end: int, n: int, at: str | None):
        unit, last, held, where = state
        if last is not None and 0 <= start - last <= gap and held + n <= limit and at == where:
            return (unit, end, held + n, where), unit
        unit = unit + 1 if last is not None else 0
        return (unit, end, n, at), unit

    per = folded(rows, [key], ["run_start"], ["run_start", "run_end", "added", "_scope"], (0, None, 0, None), step, "unit_no", "int")
    return per.groupBy(key, "unit_no").agg(F.min("run_start").alias("start_line"), F.max("run_end").alias("end_line"), F.sum("added").cast("int").alias("added"))


def _blank(x: Column) -> Column:
    return F.trim(x) == ""


def _wide(x: Column) -> Column:
    return F.length(F.regexp_extract(x, r"^(\s*)", 1))


def enclosing_scope(lines: Column, at: Column, language: Column) -> Column:
    """The 1-based number of the line that encloses line ``at``, or null.

    The nearest of the SCOPE_REACH lines before it that is indented less and looks like the head of a scope.
    """
    signature = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNATURES.items() for x in kv)), language), F.lit(BRACED))
    own = F.coalesce(F.get(lines, at - 1), F.lit(""))
    first = F.greatest(at - SCOPE_REACH, F.lit(1))
    before = F.transform(F.slice(lines, first, F.greatest(at - first, F.lit(0))), lambda x, i: F.struct((first + i).alias("n"), F.coalesce(x, F.lit("")).alias("x")))
    return F.try_element_at(F.filter(before, lambda s: ~_blank(s["x"]) & (_wide(s["x"]) < _wide(own)) & F.regexp(s["x"], signature)), F.lit(-1))["n"]


def with_scope(units: DataFrame) -> DataFrame:
    """``units`` (language_id, source_lines, ..) with ``scope_line``: the line that encloses the unit's last line.

    The nearest earlier line within SCOPE_REACH lines that is indented less and looks like the head of a scope, as a
    1-based place in the unit; null if there is none.
    """
    lines = F.filter(F.transform("source_lines", lambda x, i: F.struct(i.alias("i"), F.coalesce(x, F.lit("")).alias("x"))), lambda s: ~_blank(s["x"]))
    signature = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNATURES.items() for x in kv)), F.col("language_id")), F.lit(BRACED))
    df = units.withColumn("_l", lines).withColumn("_sig", signature).withColumn("_o", F.try_element_at("_l", F.lit(-1)))
    heads = F.filter("_l", lambda s: (s["i"] < F.col("_o.i")) & (s["i"] >= F.col("_o.i") - SCOPE_REACH) & (_wide(s["x"]) < _wide(F.col("_o.x"))) & F.regexp(s["x"], F.col("_sig")))
    return df.withColumn("scope_line", F.try_element_at(heads, F.lit(-1))["i"] + 1).drop("_l", "_sig", "_o")


def imports(lines: DataFrame, key: str, limit: int = 40) -> DataFrame:
    """(key, line_no, line): the first ``limit`` import lines of each text, trimmed."""
    hit = F.trim("line").rlike(IMPORT)
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.where(hit).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select(key, "line_no", F.trim("line").alias("line"))


def snippets(lines: DataFrame, key: str, before: int = 2, after: int = 1) -> DataFrame:
    """``lines`` with ``snippet``: each line with its neighbours, joined by line ends."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("snippet", F.array_join(F.collect_list("line").over(w), "\n"))


def suppressed(lines: DataFrame, key: str, tag: str = "review-ignore") -> DataFrame:
    """``lines`` with ``suppresses``: the rule id that a marker on this or the line before names, '*' for all, or null."""
    mark = lambda c: F.when(F.contains(c, F.lit(tag)), F.coalesce(F.nullif(F.regexp_extract(c, rf"{tag}\s+(\S+)", 1), F.lit("")), F.lit("*")))
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("suppresses", F.coalesce(mark(F.col("line")), mark(F.lag("line").over(w))))


def blocks(df: DataFrame, key: str, text: str, tags: tuple[str, ...]) -> DataFrame:
    """(key, tag, start_line, end_line): the first block of each tag in a marked-up text, without the tags' own lines."""
    out = None
    for tag in tags:
        inner = F.regexp_extract(text, rf"(?is)^(.*?<{tag}[^>]*>)(.*?)</{tag}>", 1)
        body = F.regexp_extract(text, rf"(?is)^(.*?<{tag}[^>]*>)(.*?)</{tag}>", 2)
        newlines = lambda c: F.length(c) - F.length(F.translate(c, "\n", ""))
        one = df.where(F.col(text).rlike(rf"(?is)<{tag}[^>]*>.*?</{tag}>")).select(key, F.lit(tag).alias("tag"), (newlines(inner) + 1).alias("start_line"), (newlines(inner) + newlines(body) + 1).alias("end_line"))
        out = one if out is None else out.unionByName(one)
    return out

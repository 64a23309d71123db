"""Sinks: logs, canonical JSON, Markdown, session logs, cache tables, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diffloom.functions.scalars import severity_rank

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}


def sarif_logs(alerts: DataFrame, *keys: str) -> DataFrame:
    """(keys.., value): one log as JSON text per group of ``keys``, results in order of path, line, rule and message.

    A group becomes one document, so its size must be bounded by the choice of keys.
    """
    at = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(at).alias("locations"))
    row = F.struct("path", "line", "rule_id", "message", result.alias("r"))
    per = alerts.groupBy(*keys, "tool").agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("results"),
        F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id"), F.col("help_uri").alias("helpUri")))).alias("rules"),
    )
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    log = per.groupBy(*keys).agg(F.array_sort(F.collect_list(run.cast(_RUN))).alias("runs"))
    return log.select(*keys, F.to_json(F.struct(F.lit("2.1.0").alias("version"), "runs")).alias("value"))


_RUN = (
    "struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,helpUri:string>>>>,"
    "results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>"
)


def level(severity):
    """The log level of a severity: error, warning or note."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), severity), F.lit("note"))


def finding_logs(found: DataFrame, *keys: str, tool: str = "diffloom", bands: tuple[str, ...] = ("report",)) -> DataFrame:
    """(keys.., value): findings of the given bands as logs; uncertain ones are notes whatever their severity."""
    rows = found.where(F.col("band").isin(*bands))
    rows = rows.withColumns({"level": F.when(F.col("band") == "uncertain", "note").otherwise(level(F.col("severity"))), "tool": F.lit(tool), "line": F.col("line_no"), "message": F.col("rule_id"), "help_uri": F.lit(None).cast("string")})
    return sarif_logs(rows, *keys)


def record_answers(answers: DataFrame, folder: str) -> None:
    """Append recorded answers as JSON lines, one file a task; ``reports.first_answers`` keeps the first of each key."""
    answers.write.mode("append").json(folder)


def canonical_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys.., json): the other columns of each row as JSON with keys in alphabetical order, nulls kept."""
    names = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


def markdown(found: DataFrame, key: str) -> DataFrame:
    """(key, text): one Markdown summary per key: reported findings from critical to low with their counts, then uncertain ones."""
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit("` "), F.col("rule_id"))
    row = F.struct((-severity_rank(F.col("severity"))).alias("s"), (-F.col("p_eff")).alias("p"), "path", "line_no", "rule_id", line.alias("line"))
    of = lambda b: F.collect_list(F.when(F.col("band") == b, row))
    counts = [F.count_if((F.col("band") == "report") & (F.col("severity") == s)).alias(s) for s in LEVELS]
    per = found.where(F.col("band").isin("report", "uncertain")).groupBy(key).agg(of("report").alias("r"), of("uncertain").alias("u"), *counts)
    lines = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["line"]), "\n")
    some = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in LEVELS]
    head = F.concat(F.lit("## "), F.size("r").cast("string"), F.lit(" findings"), F.when(F.size("r") > 0, F.concat(F.lit(" ("), F.concat_ws(", ", *some), F.lit(")"))).otherwise(F.lit("")))
    uncertain = F.when(F.size("u") > 0, F.concat(F.lit("\n\n### Uncertain\n\n"), lines("u"))).otherwise(F.lit(""))
    return per.select(key, F.concat(head, F.lit("\n\n"), lines("r"), uncertain).alias("text"))


def write_session_log(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines, without state and questions."""
    events.drop("state", "questions").write.mode("append").json(folder)


def write_cache(answers: DataFrame, folder: str) -> None:
    """Append answers partitioned by the first two characters of their key, with the time they were stored."""
    answers.withColumn("stored_at", F.current_timestamp()).withColumn("key_prefix", F.substring("key", 1, 2)).write.mode("append").partitionBy("key_prefix").parquet(folder)


def spans(requests: DataFrame, trace: str) -> DataFrame:
    """One span per request: ids by hash, no source text."""
    return requests.select(F.lit(trace).alias("trace_id"), F.substring(F.md5(F.concat_ws("|", F.lit(trace), "unit_id", "pass")), 1, 16).alias("span_id"), "unit_id", "pass", "model", "latency_ms", "input_tokens", "output_tokens")

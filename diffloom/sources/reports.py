"""Readers of static-analysis logs, rule packs, evaluation sets, session logs, cassettes and caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SARIF = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,helpUri:string>>>>,"
    "results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
)
ANSWERS = "key string, model string, answers string, input_tokens bigint, output_tokens bigint"
EVENTS = "type string, unit_id string, path string, pass int, model string, input_tokens bigint, output_tokens bigint, latency_ms bigint, cached boolean"


def sarif_alerts(logs: DataFrame, text: str = "value") -> DataFrame:
    """Alerts (tool, rule_id, level, path, line, message, help_uri) of logs held as JSON text, one log a row.

    Only the first location counts; rows without path, line or rule are left out; a text that doesn't parse gives none.
    """
    run = logs.select(F.from_json(text, SARIF).alias("log")).select(F.explode("log.runs").alias("run"))
    flat = run.select(F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    at = F.get("r.locations", 0)["physicalLocation"]
    out = flat.select(
        F.coalesce("tool", F.lit("unknown")).alias("tool"),
        F.col("r.ruleId").alias("rule_id"),
        F.coalesce("r.level", F.lit("warning")).alias("level"),
        F.translate(at["artifactLocation"]["uri"], "\\", "/").alias("path"),
        at["region"]["startLine"].alias("line"),
        F.coalesce("r.message.text", F.lit("")).alias("message"),
        F.get(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), 0)["helpUri"].alias("help_uri"),
    )
    return out.where("path IS NOT NULL AND line IS NOT NULL AND rule_id IS NOT NULL")


def rule_pack(spark: SparkSession, path: str) -> list[dict]:
    """Rules of a JSON pack ({"rules": [..]}): a small table by nature, read on the driver to become expressions."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["rules"]


def eval_labels(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, rule_id, positive): one row per label; a label without ``positive`` counts as negative."""
    return cases.select(key, F.explode("labels").alias("l")).select(key, "l.rule_id", F.coalesce("l.positive", F.lit(False)).alias("positive"))


def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all session logs (JSON lines) in a folder, with their file; blank lines are skipped."""
    return spark.read.schema(EVENTS).json(folder).withColumn("file", F.input_file_name())


def first_answers(entries: DataFrame, *order: str) -> DataFrame:
    """Recorded answers with one row per key: the first in the given order wins."""
    w = Window.partitionBy("key").orderBy(*order)
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def eval_cases(texts: DataFrame, text: str = "value") -> DataFrame:
    """(shape, name, case_id, language, path, source, labels) of evaluation sets held as JSON text, one set a row.

    Three shapes: ``cases`` with sources and labels, ``samples`` with hunks and one judgement each, and an array of
    projects, whose comments are only counted (a row per project, ``case_id`` and ``source`` null). Other texts give none.
    """
    label = "array<struct<rule_id:string,positive:boolean>>"
    wide = "name string, cases array<struct<id:string,path:string,source:string,labels:array<struct<ruleId:string,positive:boolean>>>>, samples array<struct<id:string,project_main_language:string,path:string,hunk:string,judge:struct<ruleId:string,positive:boolean>>>"
    both = texts.select(F.from_json(text, wide).alias("s"), F.from_json(text, "array<struct<project_main_language:string,comments:array<struct<note:string>>>>").alias("p"))
    cases = both.select(F.lit("cases").alias("shape"), "s.name", F.explode("s.cases").alias("c")).select(
        "shape", "name", F.col("c.id").alias("case_id"), F.lit(None).cast("string").alias("language"), "c.path", "c.source",
        F.transform("c.labels", lambda x: F.struct(x["ruleId"].alias("rule_id"), F.coalesce(x["positive"], F.lit(False)).alias("positive"))).cast(label).alias("labels"),
    )
    samples = both.select(F.lit("samples").alias("shape"), "s.name", F.explode("s.samples").alias("c")).select(
        "shape", "name", F.col("c.id").alias("case_id"), F.col("c.project_main_language").alias("language"), "c.path", F.col("c.hunk").alias("source"),
        F.array(F.struct(F.col("c.judge.ruleId").alias("rule_id"), F.coalesce("c.judge.positive", F.lit(False)).alias("positive"))).cast(label).alias("labels"),
    )
    projects = both.where("s.cases IS NULL AND s.samples IS NULL").select(F.explode("p").alias("c")).where("c.comments IS NOT NULL")
    counted = projects.select(F.lit("projects").alias("shape"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("case_id"), F.col("c.project_main_language").alias("language"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("source"), F.array_repeat(F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("boolean").alias("positive")), F.size("c.comments")).alias("labels"))
    return cases.unionByName(samples).unionByName(counted)


def looked_up(requests: DataFrame, cache: DataFrame, key: str = "request_key") -> DataFrame:
    """``requests`` with the columns of the newest row of ``cache`` (key, stored_at, ..) with their key, or nulls."""
    newest = cache.groupBy(F.col("key").alias(key)).agg(F.max_by(F.struct(*(c for c in cache.columns if c != "key")), "stored_at").alias("_c"))
    return requests.join(newest, key, "left").select(*requests.columns, "_c.*")


def cacheable(model):
    """Whether answers of a model may be cached: only those of a pinned version x.y.z."""
    return F.coalesce(model.rlike(r"\d+\.\d+\.\d+$"), F.lit(False))


def cache_size(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes): how many files a cache folder holds, and their size."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def cached_answers(cache: DataFrame, now: str, ttl_s: int) -> DataFrame:
    """Rows of a cache table (key, stored_at, ..) that aren't older than ``ttl_s`` seconds."""
    return cache.where(F.col("stored_at") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.lit(ttl_s)))

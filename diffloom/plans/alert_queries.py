"""Queries over static-analysis records: loading, joins with changed lines and units, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.functions import scalars as S
from diffloom.operators import alerts, badrows, gate
from diffloom.plans.registry import query, r6
from diffloom.session import spread_table, staged, table


_FIELD = """'(?:"(?:[^"]|"")*"|[^"' || d || '\\r\\n]*)'"""
_PARSED_SQL = rf"""
    f AS (SELECT feed, n_columns, column_names, delimiter, CASE WHEN delimiter = chr(9) THEN '\t' ELSE '\' || delimiter END AS d FROM alert_feeds),
    r AS (SELECT raw_id, repo, f.*, regexp_replace(raw_line, '\r$', '') AS body FROM static_alert_lines LEFT JOIN f USING (feed)),
    p AS (SELECT *, regexp_matches(body, '^' || {_FIELD} || '(?:' || d || {_FIELD} || ')*$') AS sound, regexp_extract_all(delimiter || body, d || '(' || replace({_FIELD}, '\r\n', '') || ')', 1) AS w FROM r),
    u AS (SELECT * EXCLUDE (w), list_transform(w, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM p),
    c AS (SELECT raw_id, repo, feed, sound, len(v) = n_columns AS whole, len(v) < n_columns AS short, body, {", ".join(f"v[list_position(column_names, '{c}')] AS {c}" for c in ("tool", "rule_id", "path", "line", "message", "help_uri", "run_no"))},
        list_contains(column_names, 'level') AS leveled, v[list_position(column_names, 'level')] AS level FROM u),
    k AS (SELECT *, coalesce(sound AND whole AND regexp_matches(line, '^ *[0-9]+ *$') AND try_cast(trim(line) AS HUGEINT) BETWEEN 1 AND 2147483647
        AND regexp_matches(path, '[^\s\v\x85\p{{Z}}]') AND NOT regexp_matches(path, '[\p{{Cc}}\x{{FFFD}}]') AND rule_id <> '' AND NOT regexp_matches(rule_id, '[\s\v\x85\p{{Z}}\p{{Cc}}]')
        AND (NOT leveled OR lower(trim(level)) IN ('error', 'warning', 'note', 'none') OR NOT regexp_matches(level, '[^\s\v\x85\p{{Z}}]')), false) AS valid FROM c),
    g AS (SELECT raw_id, repo, feed, tool, rule_id, nullif(lower(trim(level)), '') AS level, replace(path, chr(92), '/') AS path, trim(line)::INT AS line, message, help_uri, run_no FROM k WHERE valid)
"""
_BAD_SQL = f"WITH {_PARSED_SQL} SELECT DISTINCT raw_id FROM k WHERE NOT valid"


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    """Valid alerts with their repository."""
    raw = spread_table(spark, d, "static_alert_lines")
    return badrows.load_alerts(raw.where("repo IS NOT NULL"), table(spark, d, "alert_feeds"), keep=("repo",))


def _added(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "changed_files")
    return files.select("repo", S.slashed(F.col("path")).alias("path"), F.explode("added_line_numbers").alias("line")).where("repo IS NOT NULL")


@query("p2_found", _BAD_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of static-analysis exports that aren't valid."""
    return badrows.bad_records(spread_table(spark, d, "static_alert_lines"), table(spark, d, "alert_feeds")).select("raw_id")


@query(
    "p2_reasons",
    rf"""
    WITH {_PARSED_SQL}, s AS (SELECT *, CASE WHEN body IS NULL THEN 'no record' WHEN feed IS NULL THEN 'unknown feed' WHEN NOT sound THEN 'broken quoting' WHEN short THEN 'too few fields' WHEN NOT whole THEN 'too many fields' END AS form FROM k),
    b AS (SELECT raw_id, form,
        CASE WHEN NOT regexp_matches(line, '^ *[0-9]+ *$') THEN 'line is not a whole number' WHEN coalesce(try_cast(trim(line) AS HUGEINT), 0) NOT BETWEEN 1 AND 2147483647 THEN 'line is out of range' END AS line_bad,
        CASE WHEN NOT regexp_matches(path, '[^\s\v\x85\p{{Z}}]') THEN 'path is blank' WHEN regexp_matches(path, '[\p{{Cc}}\x{{FFFD}}]') THEN 'path has control or replacement characters' END AS path_bad,
        CASE WHEN rule_id = '' THEN 'rule_id is empty' WHEN regexp_matches(rule_id, '[\s\v\x85\p{{Z}}\p{{Cc}}]') THEN 'rule_id has white space or control characters' END AS rule_bad,
        CASE WHEN leveled AND lower(trim(level)) NOT IN ('error', 'warning', 'note', 'none') AND regexp_matches(level, '[^\s\v\x85\p{{Z}}]') THEN 'level is unknown' END AS level_bad FROM s),
    o AS (SELECT DISTINCT raw_id, CASE WHEN form IS NOT NULL THEN [form] ELSE list_sort(list_filter([line_bad, path_bad, rule_bad, level_bad], lambda x: x IS NOT NULL)) END AS why FROM b)
    SELECT raw_id, array_to_string(why, '; ') AS reasons FROM o WHERE len(why) > 0
    """,
)
def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same records with every reason."""
    bad = badrows.bad_records(spread_table(spark, d, "static_alert_lines"), table(spark, d, "alert_feeds"))
    return bad.select("raw_id", F.array_join("reasons", "; ").alias("reasons"))


@query("p2_alerts", f"WITH {_PARSED_SQL} SELECT * EXCLUDE (repo) FROM g")
def p2_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The valid records as typed alerts."""
    return badrows.load_alerts(spread_table(spark, d, "static_alert_lines"), table(spark, d, "alert_feeds"))


@query(
    "alert_semi",
    f"WITH {_PARSED_SQL}, a AS (SELECT DISTINCT repo, replace(path, chr(92), '/') AS path, unnest(added_line_numbers) AS line FROM changed_files) SELECT raw_id, repo, path, line, rule_id FROM g SEMI JOIN a USING (repo, path, line)",
)
def alert_semi(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on added lines."""
    return alerts.alerts_on_lines(_alerts(spark, d), _added(spark, d)).select("raw_id", "repo", "path", "line", "rule_id")


@query(
    "alert_unit_range",
    f"""
    WITH {_PARSED_SQL}, s AS (SELECT DISTINCT repo, replace(path, chr(92), '/') AS path, unit_id, start_line, end_line FROM review_units)
    SELECT raw_id, any_value(g.repo) AS repo, any_value(g.path) AS path, any_value(line) AS line, arg_min(unit_id, {{'s': start_line, 'u': unit_id}}) AS unit_id
    FROM g LEFT JOIN s ON s.repo = g.repo AND s.path = g.path AND line BETWEEN start_line AND end_line WHERE g.repo IS NOT NULL GROUP BY raw_id
    """,
)
def alert_unit_range(spark: SparkSession, d: str) -> DataFrame:
    """Each alert with the first review unit that holds its line."""
    units = table(spark, d, "review_units").select("repo", S.slashed(F.col("path")).alias("path"), "unit_id", "start_line", "end_line").distinct()
    return alerts.alert_units(staged(_alerts(spark, d), "alerts"), units).select("raw_id", "repo", "path", "line", "unit_id")


@query(
    "alert_keep",
    f"""
    WITH {_PARSED_SQL}, x AS (SELECT *, {r6("CASE WHEN regexp_matches(lower(message), 'placeholder|example|todo') THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END * CASE WHEN level IN ('note', 'none') THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END")} AS p FROM g WHERE repo IS NOT NULL)
    SELECT raw_id, rule_id, CASE WHEN level = 'error' THEN 'high' WHEN level IN ('note', 'none') THEN 'low' ELSE 'medium' END AS severity, p, CASE WHEN p >= 0.75 THEN 'keep' ELSE 'drop' END AS decision FROM x
    """,
)
def alert_keep(spark: SparkSession, d: str) -> DataFrame:
    """Alerts kept when real * matters reaches the report threshold, with a severity from their level.

    The mock judges messages with placeholders as unreal; notes matter less.
    """
    a = _alerts(spark, d)
    real = F.when(F.lower("message").rlike("placeholder|example|todo"), F.lit(0.1)).otherwise(F.lit(0.9))
    matters = F.when(F.col("level").isin("note", "none"), F.lit(0.5)).otherwise(F.lit(0.95))
    severity = F.when(F.col("level") == "error", "high").when(F.col("level").isin("note", "none"), "low").otherwise("medium")
    p = S.round_to(real * matters)
    return a.select("raw_id", "rule_id", severity.alias("severity"), p.alias("p"), F.when(p >= 0.75, "keep").otherwise("drop").alias("decision"))


@query(
    "catalog_counts",
    "SELECT dataset_name, lower(language_id) AS language, count(*) AS cases, sum(len(labels)) AS labels FROM eval_cases GROUP BY ALL",
)
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cases and labels per set and language."""
    return table(spark, d, "eval_cases").groupBy("dataset_name", F.lower("language_id").alias("language")).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("labels")).alias("labels"))


@query(
    "replay_first_wins",
    """
    WITH k AS (SELECT sha256(raw_line) AS key, raw_id, feed FROM static_alert_lines)
    SELECT key, raw_id, feed FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY raw_id) = 1
    """,
)
def replay_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """One recorded row per key, the first wins."""
    rows = table(spark, d, "static_alert_lines").select(F.sha2("raw_line", 256).alias("key"), "raw_id", "feed")
    best = rows.groupBy("key").agg(F.min(F.struct("raw_id", "feed")).alias("f"))
    return best.select("key", "f.raw_id", "f.feed")


@query(
    "cache_split",
    """
    WITH k AS (SELECT raw_id, sha256('{"feed":"' || feed || '","raw_id":' || (raw_id // 3)::VARCHAR || '}') AS request_key FROM static_alert_lines),
    c AS (SELECT DISTINCT sha256('{"feed":"' || feed || '","raw_id":' || raw_id::VARCHAR || '}') AS request_key FROM static_alert_lines WHERE run_at < TIMESTAMP '2026-01-01')
    SELECT raw_id, request_key, request_key IN (SELECT request_key FROM c) AS hit FROM k
    """,
)
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Requests by canonical key, split into cache hits and misses."""
    rows = table(spark, d, "static_alert_lines")
    requests = rows.select("raw_id", alerts.request_key(F.col("feed"), F.floor(F.col("raw_id") / 3).alias("raw_id")).alias("request_key"))
    cache = rows.where("run_at < TIMESTAMP_NTZ'2026-01-01'").select(alerts.request_key(F.col("feed"), F.col("raw_id")).alias("request_key"))
    return alerts.cache_split(requests, cache, "raw_id")


@query("sarif_roundtrip", f"WITH {_PARSED_SQL} SELECT coalesce(tool, 'unknown') AS tool, rule_id, coalesce(level, 'warning') AS level, path, line, coalesce(message, '') AS message FROM g WHERE repo IS NOT NULL")
def sarif_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Alerts written as one log per repository and run, and read back."""
    from diffloom.sources.reports import sarif_alerts
    from diffloom.sources.sinks import sarif_logs

    a = _alerts(spark, d).withColumn("part", F.pmod(F.xxhash64("raw_id"), F.lit(64)))
    return sarif_alerts(sarif_logs(a, "repo", "part")).drop("help_uri")


@query(
    "related_tests",
    """
    WITH f AS (SELECT file_id, repo, lower(split_part(string_split(replace(path, chr(92), '/'), '/')[-1], '.', 1)) AS stem FROM changed_files),
    w AS (SELECT DISTINCT file_id, repo, unnest(string_split_regex(stem, '[^a-z]+')) AS w FROM f),
    t AS (SELECT * FROM f WHERE stem LIKE 'test_%' OR stem LIKE '%test')
    SELECT repo, w AS word, count(DISTINCT w.file_id) AS files, count(DISTINCT t.file_id) AS tests
    FROM w LEFT JOIN (SELECT DISTINCT file_id, repo, unnest(string_split_regex(stem, '[^a-z]+')) AS w FROM t) t USING (repo, w)
    WHERE length(w) > 3 GROUP BY ALL
    """,
)
def related_tests(spark: SparkSession, d: str) -> DataFrame:
    """Files and tests of a repository that share a word of their names, by word instead of by pair."""
    f = table(spark, d, "changed_files").select("file_id", "repo", F.lower(S.stem(F.col("path"))).alias("stem"))
    words = f.select("file_id", "repo", "stem", F.explode(F.array_distinct(F.split("stem", "[^a-z]+"))).alias("word")).where(F.length("word") > 3)
    test = F.col("stem").rlike("^test_|test$") | F.col("stem").startswith("test") & (F.length("stem") > 4) & F.col("stem").rlike("^test.")
    return words.groupBy("repo", "word").agg(F.countDistinct("file_id").alias("files"), F.countDistinct(F.when(test, F.col("file_id"))).alias("tests"))


@query(
    "related_pairs",
    r"""
    WITH p AS (SELECT file_id, repo, replace(path, chr(92), '/') AS path FROM changed_files),
    f AS (SELECT *, string_split(path, '/')[-1] AS base, regexp_replace(string_split(path, '/')[-1], '\.[^.]+$', '') AS stem FROM p),
    t AS (SELECT DISTINCT repo, path, base FROM f WHERE regexp_matches(path, '(?i)(\.test\.ts|_test\.go|(^|/)test_[^/]*\.py)$|(^|/)(src/test|tests)/'))
    SELECT DISTINCT file_id, t.path AS test FROM f JOIN t ON f.repo = t.repo AND contains(t.base, f.stem) AND f.path <> t.path
    """,
)
def related_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each changed file with the changed tests of its repository whose base name contains its whole stem."""
    path = S.slashed(F.col("path"))
    f = table(spark, d, "changed_files").select("file_id", "repo", path.alias("path"), S.basename(F.col("path")).alias("base"))
    f = f.withColumn("stem", F.regexp_replace("base", r"\.[^.]+$", ""))
    tests = f.where(gate.matches_globs(F.col("path"), gate.glob_lists(table(spark, d, "gate_options")).get("test_globs", [])))
    return alerts.related(f, tests)

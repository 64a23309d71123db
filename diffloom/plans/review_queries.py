"""Queries over units and findings beside the rules: hunks, places, slots, payloads, look-ups, unions and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.functions import hunks, scalars as S
from diffloom.operators import gate, risk, rules, units as U
from diffloom.operators.rules import PACK, PROFILES
from diffloom.operators.skew import small
from diffloom.plans import alert_queries, line_queries, rule_queries
from diffloom.plans.line_queries import _FILE_LINES
from diffloom.plans.registry import SQL, query, r6
from diffloom.plans.rule_queries import _FINDINGS, _MATCHES, _QUESTIONS, _added_sql, _q
from diffloom.session import spread_table, table
from diffloom.sources.text import source_lines

_UNITS = "u AS (SELECT DISTINCT unit_id, file_id, repo, path, language_id, plugin_id, start_line, end_line, source_lines, added_line_numbers FROM review_units)"


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Units once, however often they were sent."""
    return table(spark, d, "review_units").dropDuplicates(["unit_id"])


def _hunk(df: DataFrame) -> DataFrame:
    """``df`` with ``hunk``: the unit's lines as hunk text."""
    no = lambda i: F.col("start_line") + i
    line = lambda x, i: F.struct(F.when(F.array_contains("added_line_numbers", no(i)), "added").otherwise("context").alias("kind"), no(i).alias("no"), F.coalesce(x, F.lit("")).alias("text"))
    return df.withColumn("hunk", hunks.hunk_text(F.transform("source_lines", line)))


_HUNKS = f"""{_UNITS}, hk AS (SELECT unit_id, array_to_string(list_transform(source_lines, lambda x, i: 'L' || (start_line + i - 1)::VARCHAR || CASE WHEN coalesce(list_contains(added_line_numbers, start_line + i - 1), false) THEN ' + ' ELSE '   ' END || coalesce(x, '')), chr(10)) AS hunk FROM u WHERE source_lines IS NOT NULL)"""


@query("hunk_text", f"WITH {_HUNKS} SELECT unit_id, hunk FROM hk")
def hunk_text(spark: SparkSession, d: str) -> DataFrame:
    """each unit's lines as numbered text."""
    return _hunk(_units(spark, d).where("source_lines IS NOT NULL")).select("unit_id", "hunk")


@query(
    "hunk_parsed",
    f"""
    WITH {_HUNKS}, s AS (SELECT unit_id, unnest(string_split(hunk, chr(10))) AS x FROM hk)
    SELECT unit_id, regexp_extract(x, '^L(\\d+)', 1)::INT AS no, regexp_replace(x, '^L\\d+ \\+ ', '') AS text FROM s WHERE regexp_matches(x, '^L\\d+ \\+ ')
    """,
)
def hunk_parsed(spark: SparkSession, d: str) -> DataFrame:
    """the added lines read back from that text."""
    return hunk_text(spark, d).select("unit_id", F.explode(hunks.hunk_lines(F.col("hunk"))).alias("l")).where("l.kind = 'added'").select("unit_id", "l.no", "l.text")


@query("added_text", f"WITH {_added_sql(rules.MARKER)} SELECT unit_id, array_to_string(list('L' || line_no::VARCHAR || ' + ' || coalesce(line, '') ORDER BY line_no), chr(10)) AS hunk FROM l GROUP BY unit_id")
def added_text(spark: SparkSession, d: str) -> DataFrame:
    """only the added lines of each unit as numbered text."""
    p = rules.prepared(_units(spark, d), "unit_id").where("n_added > 0")
    line = lambda a: F.struct(F.lit("added").alias("kind"), a["line_no"].alias("no"), F.coalesce(a["line"], F.lit("")).alias("text"))
    return p.select("unit_id", hunks.hunk_text(F.transform("added", line)).alias("hunk"))


@query(
    "locations",
    f"""
    WITH {_MATCHES}, a AS (SELECT unit_id, rule_id, list_sort(list_distinct(list(line_no))) AS anchors, max(p_eff) AS p FROM m GROUP BY ALL),
    w AS (SELECT *, CASE WHEN len(anchors) % 2 = 0 THEN [] ELSE anchors END AS kept, anchors[-1] AS chosen, CASE WHEN p >= 0.8::DOUBLE THEN 0.9 ELSE 0.3 END AS sure FROM a),
    j AS (SELECT w.*, n.numbers, n.start_line FROM w JOIN (SELECT DISTINCT unit_id, numbers, start_line FROM n) n USING (unit_id))
    SELECT unit_id, rule_id, greatest(CASE WHEN len(kept) > 0 THEN CASE WHEN sure >= 0.5 AND list_contains(kept, chosen) THEN chosen ELSE kept[1] END WHEN sure >= 0.5 AND list_contains(numbers, chosen) THEN chosen ELSE coalesce(numbers[1], start_line) END, 1)::INT AS line,
        CASE WHEN len(kept) > 0 THEN 'trigger' WHEN sure >= 0.5 AND list_contains(numbers, chosen) THEN 'choice' ELSE 'unit' END AS placed_by FROM j
    """,
)
def locations(spark: SparkSession, d: str) -> DataFrame:
    """the line of each rule of a unit from its anchors and a chosen line.

    The choice is the last hit; it is sure where the probability is high, and every second rule has no anchors, so that
    all ways of placing occur.
    """
    per = rule_queries.matches(spark, d).groupBy("unit_id", "rule_id").agg(F.array_sort(F.collect_set("line_no")).alias("all_"), F.max("p_eff").alias("p"))
    per = per.withColumn("kept", F.when(F.size("all_") % 2 == 1, F.col("all_")).otherwise(F.array().cast("array<int>")))
    own = rules.prepared(_units(spark, d), "unit_id", "start_line").select("unit_id", "start_line", F.transform("added", lambda a: a["line_no"]).alias("numbers"))
    choice, sure = F.concat(F.lit("L"), F.element_at("all_", -1).cast("string")), F.when(F.col("p") >= 0.8, 0.9).otherwise(0.3)
    at = hunks.location(F.col("kept"), F.col("numbers"), F.col("start_line"), choice, sure)
    return per.join(own, "unit_id").select("unit_id", "rule_id", at.alias("at")).select("unit_id", "rule_id", F.col("at.line").alias("line"), F.col("at.by").alias("placed_by"))


_LIMIT = r"limit(?:: \w+)? = (\d+)"


@query("slots", f"WITH {_added_sql(rules.MARKER)}, h AS (SELECT unit_id, min(line_no) AS line_no FROM l WHERE regexp_matches(line, '{_LIMIT}') GROUP BY unit_id) SELECT h.unit_id, regexp_extract(line, '{_LIMIT}', 1) AS value FROM h JOIN l USING (unit_id, line_no)")
def slots(spark: SparkSession, d: str) -> DataFrame:
    """the number that the first hit of the rule on limits stands for, by a group of its pattern."""
    lines = rules.added_lines(rules.prepared(_units(spark, d), "unit_id"), "unit_id").where(F.col("line").rlike(_LIMIT))
    return lines.groupBy("unit_id").agg(F.min_by("line", "line_no").alias("line")).select("unit_id", hunks.slot_value("regex:1", F.col("line"), _LIMIT).alias("value"))


@query(
    "location_questions",
    f"""
    WITH {_MATCHES}, q AS (SELECT unit_id, rule_id FROM m GROUP BY ALL HAVING count(*) > 1 AND max(p_eff) >= {PROFILES["balanced"][1]}::DOUBLE)
    SELECT unit_id, 'loc.' || rule_id AS q_key, array_to_string(list_concat(list_transform(numbers[:254], lambda x: 'L' || x::VARCHAR), ['none']), ',') AS choices FROM q JOIN (SELECT DISTINCT unit_id, numbers FROM n) n USING (unit_id)
    """,
)
def location_questions(spark: SparkSession, d: str) -> DataFrame:
    """For each rule that needs a location, the question for it with the first 254 added lines as choices."""
    asked = rule_queries.needs_location(spark, d).select("unit_id", "rule_id")
    own = rules.prepared(_units(spark, d), "unit_id").select("unit_id", F.transform("added", lambda a: F.concat(F.lit("L"), a["line_no"].cast("string"))).alias("l"))
    return asked.join(own, "unit_id").select("unit_id", F.concat(F.lit("loc."), "rule_id").alias("q_key"), F.array_join(F.concat(F.slice("l", 1, 254), F.array(F.lit("none"))), ",").alias("choices"))


_ANSWERS = "a AS (SELECT unit_id, 'r.' || rule_id AS q_key, max(p_eff) AS p FROM m WHERE unit_id % 3 <> 0 GROUP BY ALL)"


@query("answer_lookup", f"WITH {_QUESTIONS}, {_ANSWERS} SELECT unit_id, q_key, p FROM q LEFT JOIN a USING (unit_id, q_key)")
def answer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its recorded answer, or null where there is none (two units of three have answers)."""
    recorded = rule_queries.matches(spark, d).where(F.col("unit_id") % 3 != 0).groupBy("unit_id", F.concat(F.lit("r."), "rule_id").alias("q_key")).agg(F.max("p_eff").alias("p"))
    return rule_queries.questions(spark, d).select("unit_id", "q_key").join(recorded, ["unit_id", "q_key"], "left")


@query(
    "interval_hits",
    f"""
    WITH {_UNITS}, f AS (SELECT file_id, added_line_numbers AS a FROM changed_files)
    SELECT unit_id, len(list_filter(a, lambda x: x BETWEEN start_line AND end_line)) > 0 AS touched, len(list_distinct(list_intersect(list_filter(added_line_numbers, lambda x: x IS NOT NULL), a))) AS shared
    FROM u JOIN f USING (file_id) WHERE a IS NOT NULL AND added_line_numbers IS NOT NULL
    """,
)
def interval_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file's added lines touch the span of each of its units, and how many lines both have added."""
    f = table(spark, d, "changed_files").select("file_id", F.col("added_line_numbers").alias("_a"))
    both = _units(spark, d).join(f, "file_id").where("_a IS NOT NULL AND added_line_numbers IS NOT NULL")
    touched = F.exists("_a", lambda x: x.between(F.col("start_line"), F.col("end_line")))
    return both.select("unit_id", F.coalesce(touched, F.lit(False)).alias("touched"), F.size(F.array_intersect(F.array_compact("added_line_numbers"), "_a")).alias("shared"))


@query(
    "language_owner",
    """
    WITH c AS (SELECT lower(language_id) AS language, plugin_id, count(DISTINCT unit_id) AS n FROM review_units WHERE language_id IS NOT NULL AND plugin_id IS NOT NULL GROUP BY ALL),
    o AS (SELECT language, plugin_id FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, plugin_id) = 1)
    SELECT plugin_id, count(*) AS files FROM changed_files f LEFT JOIN o ON o.language = lower(f.language_id) GROUP BY ALL
    """,
)
def language_owner(spark: SparkSession, d: str) -> DataFrame:
    """Changed files per owner of their language; the owner is the plugin with most units of it, then by name."""
    seen = _units(spark, d).where("language_id IS NOT NULL AND plugin_id IS NOT NULL").groupBy(F.lower("language_id").alias("language"), "plugin_id").agg(F.count(F.lit(1)).alias("n"))
    owners = seen.groupBy("language").agg(F.min_by("plugin_id", F.struct(-F.col("n"), "plugin_id")).alias("plugin_id"))
    files = table(spark, d, "changed_files").select(F.lower("language_id").alias("language"))
    return files.join(small(owners), "language", "left").groupBy("plugin_id").agg(F.count(F.lit(1)).alias("files"))


@query("deep_units", f"WITH {_UNITS}, r AS ({SQL['file_risk']}) SELECT unit_id FROM u WHERE EXISTS (SELECT 1 FROM r WHERE r.repo = u.repo AND r.path = u.path AND risk >= 0.5)")
def deep_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of files whose risk is 0.5 or more."""
    deep = rule_queries.file_risk(spark, d).where("risk >= 0.5").select("repo", "path")
    return _units(spark, d).select("unit_id", "repo", "path").join(deep, ["repo", "path"], "left_semi").select("unit_id")


_TOP = 100


@query("skipped_top", f"WITH g AS ({SQL['file_gate']}), s AS (SELECT f.path, g.file_id, g.reason FROM g JOIN changed_files f USING (file_id) WHERE g.reason IS NOT NULL ORDER BY path NULLS FIRST, file_id LIMIT {_TOP}) SELECT path, file_id, reason FROM s")
def skipped_top(spark: SparkSession, d: str) -> DataFrame:
    """O3: the first hundred skipped files by path and id, with the reason."""
    g = gate.gated(table(spark, d, "changed_files"), table(spark, d, "gate_options"))
    return g.where("decision = 'skip'").orderBy("path", "file_id").limit(_TOP).select("path", "file_id", "reason")


@query("risk_top", f"WITH r AS ({SQL['file_risk']}) SELECT repo, path, risk FROM r ORDER BY path, repo LIMIT {_TOP}")
def risk_top(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred file risks by path."""
    return rule_queries.file_risk(spark, d).orderBy("path", "repo").limit(_TOP).select("repo", "path", "risk")


@query(
    "all_findings",
    f"""
    WITH {_FINDINGS}, al AS ({SQL['alert_keep']}), i AS (SELECT DISTINCT unit_id, repo, path FROM review_units WHERE regexp_matches(array_to_string(source_lines, chr(10)), '(?i){"|".join(f"(?:{p})" for p in S.INJECTIONS)}'))
    SELECT kind, severity, count(*) AS findings FROM (
        SELECT 'rule' AS kind, severity FROM g WHERE band = 'report' UNION ALL SELECT 'alert', severity FROM al WHERE decision = 'keep' UNION ALL SELECT 'injection', 'medium' FROM i) GROUP BY ALL
    """,
)
def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of rules, of kept alerts and of units that talk to the reviewer, united and counted."""
    by_rule = rule_queries.found(spark, d).where("band = 'report'").select(F.lit("rule").alias("kind"), "severity")
    by_alert = alert_queries.alert_keep(spark, d).where("decision = 'keep'").select(F.lit("alert").alias("kind"), "severity")
    text = F.array_join("source_lines", "\n")
    spoken = _units(spark, d).where(S.injection_probability(text) >= 0.7).select(F.lit("injection").alias("kind"), F.lit("medium").alias("severity"))
    return by_rule.unionByName(by_alert).unionByName(spoken).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "label_filter",
    "WITH f AS (SELECT case_id, list_filter(labels, lambda x: starts_with(x.rule_id, 's') OR starts_with(x.rule_id, 't')) AS l FROM eval_cases) SELECT case_id, len(l) AS labels FROM f WHERE len(l) > 0",
)
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    """Cases with the labels whose rule begins with one of two prefixes; cases left without labels are dropped."""
    kept = F.filter("labels", lambda x: x["rule_id"].startswith("s") | x["rule_id"].startswith("t"))
    return table(spark, d, "eval_cases").select("case_id", F.size(kept).alias("labels")).where("labels > 0")


@query(
    "payload",
    f"""
    WITH {_HUNKS}, i AS (SELECT unit_id, list(trim(x) ORDER BY n) AS imports FROM (SELECT unit_id, unnest(source_lines) AS x, generate_subscripts(source_lines, 1) AS n FROM u WHERE lower(language_id) IN ('python', 'go')) WHERE regexp_matches(trim(x), '{U.IMPORT}') GROUP BY unit_id)
    SELECT unit_id, md5(hunk) AS hunk, array_to_string(imports[:40], chr(10)) AS imports FROM hk LEFT JOIN i USING (unit_id)
    """.replace(r"require\(", r"require\("),
)
def payload(spark: SparkSession, d: str) -> DataFrame:
    """What would be sent for each unit: its hunk (as a digest), and imports only for languages whose rules ask for them."""
    df = _hunk(_units(spark, d).where("source_lines IS NOT NULL"))
    found = F.slice(F.filter(F.transform("source_lines", lambda x: F.trim(x)), lambda x: x.rlike(U.IMPORT)), 1, 40)
    imports = F.when(F.lower("language_id").isin("python", "go") & (F.size(found) > 0), F.array_join(found, "\n"))
    return df.select("unit_id", F.md5("hunk").alias("hunk"), imports.alias("imports"))


_REDACT_SQL = "line"
for _a, _b in (('"', "chr(34)"), ("'", "chr(39)")):
    _names, _stand = r"\b(password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\b(\s*[:=]\s*)", S.STAND_INS
    _quote = _a.replace("'", "''")
    _REDACT_SQL = f"replace(regexp_replace(regexp_replace({_REDACT_SQL}, '(?i){_names}{_quote}({_stand}|[^''\"]*(?:example|\\[REDACTED:)[^''\"]*){_quote}', '\\1\\2' || chr(1) || '\\3' || chr(1), 'g'), '(?i){_names}{_quote}[^''\"]{{8,}}{_quote}', '\\1\\2{_quote}[REDACTED:secret]{_quote}', 'g'), chr(1), {_b})"


@query("redact_assigned", f"WITH {line_queries._UNIT_LINES} SELECT unit_id, line_no::INT AS line_no, x AS line FROM (SELECT *, {_REDACT_SQL} AS x FROM l) WHERE x <> line")
def redact_assigned(spark: SparkSession, d: str) -> DataFrame:
    """the lines on which a quoted value of a secret-named variable is redacted."""
    lines = line_queries.unit_lines(spark, d).withColumn("new", S.redact_assignments(F.col("line")))
    return lines.where("new <> line").select("unit_id", "line_no", F.col("new").alias("line"))


@query("fenced_json", "SELECT event_id, CASE WHEN json_valid(props) THEN (json_extract(props, '$.k'))::BIGINT END AS k FROM events")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """a value of each event's JSON, of which every second one is put into a code fence first."""
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", S.fenced_json(fence, "k bigint").getField("k").alias("k"))


@query("text_tools", r"SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:79] || '…' ELSE text END AS short, regexp_matches(text, regexp_replace(text[1:20], '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS found FROM documents")
def text_tools(spark: SparkSession, d: str) -> DataFrame:
    """each text cut to 80 characters, and whether its escaped beginning finds itself."""
    head = S.escaped(F.substring("text", 1, 20))
    return table(spark, d, "documents").select("doc_id", S.truncated(F.col("text"), 80).alias("short"), F.regexp(F.col("text"), head).alias("found"))


@query(
    "logistic_probability",
    f"WITH {_MATCHES} SELECT unit_id, rule_id, line_no, {r6('1 / (1 + exp(-(-2.0 + 4.0 * p_eff + -1.5 * CASE WHEN p_eff < 0.5 THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END)))')} AS p FROM m",
)
def logistic_probability(spark: SparkSession, d: str) -> DataFrame:
    """A1: the logistic form of a hit's probability, with one guard that speaks against unlikely hits."""
    guard = F.array(F.struct(F.when(F.col("p_eff") < 0.5, 0.9).otherwise(0.05).alias("p")))
    return rule_queries.matches(spark, d).select("unit_id", "rule_id", "line_no", S.fused(F.col("p_eff"), guard, -2.0, 4.0, -1.5).alias("p"))


_UNIT_RISK = f"""{_MATCHES}, dm AS (SELECT unit_id, repo, path, category, max(p_eff) AS v, max(sev) AS sev FROM m GROUP BY ALL),
    ur AS (SELECT unit_id, repo, path, {r6("max(v)")} AS unit_risk, max(sev)::DOUBLE AS priority, max(v) >= 0.75::DOUBLE AS reported FROM dm GROUP BY ALL)"""


@query("unit_risk", f"WITH {_UNIT_RISK} SELECT unit_id, unit_risk FROM ur")
def unit_risk(spark: SparkSession, d: str) -> DataFrame:
    """A3: the largest probability over the dimensions of each unit."""
    return risk.unit_risks(rule_queries.matches(spark, d), "unit_id", name="category", value="p_eff").select("unit_id", "unit_risk")


@query(
    "file_priority",
    f"""
    WITH {_UNIT_RISK}, fr AS (SELECT repo, path, {r6("1 - product(floor(round((1 - unit_risk) * 1e6, 3) + 0.5) / 1e6)")} AS risk, count(*) AS units, max(priority) AS priority, bool_or(reported) AS r FROM ur GROUP BY ALL)
    SELECT repo, path, risk, units, priority, risk >= 0.8 AND (NOT r OR priority >= 2.5) AS deep_review FROM fr
    """,
)
def file_priority(spark: SparkSession, d: str) -> DataFrame:
    """A2: noisy-OR of the units of each file, and which files need a closer look by risk and priority."""
    m = rule_queries.matches(spark, d)
    per = m.groupBy("unit_id", "repo", "path").agg(S.round_to(F.max("p_eff")).alias("unit_risk"), F.max(S.severity_rank(F.col("severity"))).cast("double").alias("priority"), (F.max("p_eff") >= 0.75).alias("reported"))
    return risk.file_risks(per, "repo", "path")


@query(
    "run_scope",
    rf"""
    WITH {_FILE_LINES}, a AS ({SQL["added_runs"]}), c AS (SELECT file_id, lower(language_id) AS language FROM changed_files),
    o AS (SELECT a.file_id, a.run_start, language, length(regexp_extract(coalesce(f.line, ''), '^(\s*)', 1)) AS w FROM a JOIN c USING (file_id) LEFT JOIN f ON f.file_id = a.file_id AND f.line_no = a.run_start)
    SELECT o.file_id, o.run_start, max(b.line_no)::INT AS scope_line FROM o LEFT JOIN f b ON b.file_id = o.file_id AND b.line_no < o.run_start AND b.line_no >= o.run_start - {U.SCOPE_REACH} AND trim(b.line) <> ''
        AND length(regexp_extract(b.line, '^(\s*)', 1)) < o.w AND CASE language {" ".join(f"WHEN '{k}' THEN regexp_matches(b.line, '{v}')" for k, v in U.SIGNATURES.items())} ELSE regexp_matches(b.line, '{U.BRACED}') END
    GROUP BY ALL
    """,
)
def run_scope(spark: SparkSession, d: str) -> DataFrame:
    """The line that encloses the start of each run of added lines."""
    f = table(spark, d, "changed_files").select("file_id", F.lower("language_id").alias("language"), F.coalesce(source_lines(F.col("content")), F.array().cast("array<string>")).alias("lines"))
    runs = U.added_runs(table(spark, d, "changed_files")).join(f, "file_id")
    return runs.select("file_id", "run_start", U.enclosing_scope(F.col("lines"), F.col("run_start"), F.col("language")).alias("scope_line"))


@query(
    "unit_merge_scoped",
    f"""
    WITH RECURSIVE z AS ({SQL["run_scope"]}), a AS ({SQL["added_runs"]}),
    o AS (SELECT a.*, coalesce(scope_line, 0) AS sc, row_number() OVER (PARTITION BY a.file_id ORDER BY a.run_start) AS n FROM a JOIN z USING (file_id, run_start)),
    m AS (SELECT file_id, n, run_start AS s, run_end AS e, added AS k, sc, 0 AS unit_no FROM o WHERE n = 1
        UNION ALL SELECT o.file_id, o.n, CASE WHEN j THEN m.s ELSE o.run_start END, o.run_end, CASE WHEN j THEN m.k + o.added ELSE o.added END, CASE WHEN j THEN m.sc ELSE o.sc END, CASE WHEN j THEN m.unit_no ELSE m.unit_no + 1 END
        FROM m JOIN o ON o.file_id = m.file_id AND o.n = m.n + 1, LATERAL (SELECT o.run_start - m.e <= 6 AND m.k + o.added <= 120 AND o.sc = m.sc AS j))
    SELECT file_id, unit_no::INT AS unit_no, min(s) AS start_line, max(e) AS end_line, max(k)::INT AS added FROM m GROUP BY file_id, unit_no
    """,
)
def unit_merge_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Runs merged over gaps of up to six lines, up to 120 added lines, only within one enclosing scope."""
    runs = U.added_runs(table(spark, d, "changed_files")).join(run_scope(spark, d), ["file_id", "run_start"])
    return U.merged_units(runs, scope="scope_line")

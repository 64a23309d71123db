"""Queries that match rules against lines and roll the results up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.functions import scalars as S
from diffloom.operators import admission, alerts, risk, rules
from diffloom.functions.scalars import HIT
from diffloom.operators.rules import ALWAYS, NO_HIT, PACK, PROFILES
from diffloom.plans.registry import query, r6
from diffloom.session import spread_table, staged, table
from diffloom.sources import sinks


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _applies_sql(r: rules.Rule) -> str:
    """Where a rule applies, as SQL over units or lines."""
    where = "true"
    if r.languages:
        where += f" AND lower(language_id) IN ({', '.join(map(_q, r.languages))})"
    if r.frameworks:
        where += f" AND list_has_any(frameworks, [{', '.join(map(_q, r.frameworks))}])"
    if r.min_added:
        where += f" AND n_added >= {r.min_added}"
    if r.paths:
        cores = [p.replace("**/", "").replace("/**", "") for p in r.paths]
        where += " AND (" + " OR ".join(f"contains('/' || lower(replace(path, chr(92), '/')), {_q('/' + c + '/')})" for c in cores) + ")"
    return where


def _added_sql(tag: str) -> str:
    """Added lines ``l`` of the units ``u``, with the rule ids that markers turn off."""
    mark = lambda c: f"CASE WHEN contains({c}, '{tag}') THEN coalesce(nullif(regexp_extract({c}, '{tag}\\s+(\\S+)', 1), ''), '*') ELSE '' END"
    return f"""
    u AS (SELECT DISTINCT unit_id, file_id, repo, path, language_id, frameworks, start_line, source_lines,
        list_sort(list_distinct(list_filter(added_line_numbers, lambda n: n >= start_line AND n < start_line + len(source_lines)))) AS numbers FROM review_units WHERE source_lines IS NOT NULL AND start_line IS NOT NULL),
    n AS (SELECT *, coalesce(len(numbers), 0) AS n_added FROM u),
    e AS (SELECT unit_id, repo, path, language_id, frameworks, n_added, unnest(numbers) AS line_no, start_line, source_lines FROM n),
    el AS (SELECT * EXCLUDE (start_line, source_lines), source_lines[line_no - start_line + 1] AS line, CASE WHEN line_no > start_line THEN source_lines[line_no - start_line] END AS before FROM e),
    l AS (SELECT *, coalesce({mark('line')}, '') AS off_here, coalesce({mark('before')}, '') AS off_before FROM el)
    """


def _rule_sql(r: rules.Rule, off: str = "NOT") -> str:
    """One rule as SQL over the lines ``l``."""
    where = f"regexp_matches(line, {_q(r.pattern)}) AND {_applies_sql(r)} AND {off} (off_here IN ('*', {_q(r.id)}) OR off_before IN ('*', {_q(r.id)}))"
    guard = f"CASE WHEN regexp_matches(line, {_q(r.guard)}) THEN 0.9::DOUBLE ELSE 0.05::DOUBLE END" if r.guard else "0::DOUBLE"
    rank = S.SEVERITIES.index(r.severity)
    return f"SELECT unit_id, repo, path, line_no::INT AS line_no, {_q(r.id)} AS rule_id, {_q(r.category)} AS category, {_q(r.severity)} AS severity, {rank} AS sev, {r6(f'0.9::DOUBLE * pow(1 - {guard}, {r.guard_weight})')} AS p_eff FROM l WHERE {where}"


_MATCHES = f"{_added_sql(rules.MARKER)}, m AS ({' UNION ALL '.join(map(_rule_sql, PACK))})"


def _band_sql(profile: str, p: str = "p_eff") -> str:
    report, uncertain = PROFILES[profile]
    return f"CASE WHEN {p} >= {report}::DOUBLE THEN 'report' WHEN {p} >= {uncertain}::DOUBLE THEN 'uncertain' ELSE 'drop' END"


_FINDINGS = f"""{_MATCHES},
    k AS (SELECT repo, path, line_no, category, rule_id, max(severity) AS severity, max(sev) AS sev, max(p_eff) AS p_eff FROM m WHERE p_eff >= {PROFILES['balanced'][1]}::DOUBLE GROUP BY ALL),
    w AS (SELECT *, row_number() OVER o AS n, list(rule_id) OVER (PARTITION BY repo, path, line_no, category ORDER BY {r6('p_eff * (sev + 1)')} DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids
          FROM k WINDOW o AS (PARTITION BY repo, path, line_no, category ORDER BY {r6('p_eff * (sev + 1)')} DESC, rule_id)),
    g AS (SELECT repo, path, line_no, category, rule_id, severity, sev, p_eff, {_band_sql('balanced')} AS band, array_to_string(ids[2:], ',') AS related FROM w WHERE n = 1)
"""


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Every rule hit on every added line, once: units sent again repeat their hits, which are far fewer than lines."""
    units = rules.prepared(spread_table(spark, d, "review_units"), "unit_id", "repo")
    return rules.rule_matches(rules.added_lines(units, "unit_id", "repo"), "unit_id", "repo", "path").dropDuplicates(["unit_id", "line_no", "rule_id"])


def found(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all units, one per (repo, path, line, category)."""
    units = rules.prepared(spread_table(spark, d, "review_units"), "repo")
    return rules.findings(rules.rule_matches(rules.added_lines(units, "repo"), "repo", "path"), "repo", "path")


@query("rule_match", f"WITH {_MATCHES} SELECT unit_id, line_no, rule_id, category, severity, p_eff FROM m")
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    """All hits of the pack on added lines with their guarded probability."""
    return matches(spark, d).select("unit_id", "line_no", "rule_id", "category", "severity", "p_eff")


#: A marker that occurs in the tables, to have something to turn off.
_TAG = "limit"


@query(
    "rule_suppressed",
    f"WITH {_added_sql(_TAG)}, m AS ({' UNION ALL '.join(_rule_sql(r, '') for r in PACK + rules.WIDE_PACK[1:2])}) SELECT unit_id, line_no, rule_id FROM m",
)
def rule_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Hits that a marker on their line or the line before turns off."""
    units = rules.prepared(spread_table(spark, d, "review_units"), "unit_id", marker=_TAG)
    hits = rules.rule_matches(rules.added_lines(units, "unit_id"), "unit_id", rules=PACK + rules.WIDE_PACK, marked=True)
    return hits.where(F.col("rule_id") != rules.WIDE_PACK[0].id).select("unit_id", "line_no", "rule_id").distinct()


def _pool_sql(r: rules.Rule) -> str:
    begin = f"strpos(pool, regexp_extract(pool, {_q(r.pattern)}))"
    place = f"len(string_split(left(pool, {begin} - 1), chr(10)))"
    return f"SELECT unit_id, numbers[{place}]::INT AS line_no, {_q(r.id)} AS rule_id FROM p WHERE regexp_matches(pool, {_q(r.pattern)}) AND {_applies_sql(r)} AND len(list_filter(texts, lambda t: regexp_matches(t, {_q(r.pattern)}))) = 0"


@query(
    "rule_added",
    f"""
    WITH {_added_sql(rules.MARKER)}, m AS ({_rule_sql(rules.WIDE_PACK[0])} UNION ALL {_rule_sql(rules.WIDE_PACK[1])}),
    t AS (SELECT unit_id, any_value(path) AS path, any_value(language_id) AS language_id, any_value(frameworks) AS frameworks, any_value(n_added) AS n_added, list(line_no ORDER BY line_no) AS numbers, list(coalesce(line, '') ORDER BY line_no) AS texts FROM l GROUP BY unit_id),
    p AS (SELECT *, array_to_string(texts, chr(10)) AS pool FROM t)
    SELECT unit_id, line_no, rule_id FROM m UNION ALL {_pool_sql(rules.WIDE_PACK[0])}
    """,
)
def rule_added(spark: SparkSession, d: str) -> DataFrame:
    """Hits on added lines by frameworks, and over line ends where no single line hits."""
    units = rules.prepared(spread_table(spark, d, "review_units"), "unit_id")
    hits = rules.rule_matches(rules.added_lines(units, "unit_id"), "unit_id", rules=rules.WIDE_PACK)
    return hits.unionByName(rules.pool_matches(units, "unit_id", rules=rules.WIDE_PACK)).select("unit_id", "line_no", "rule_id").distinct()


def _unit_rule_sql(r: rules.Rule) -> str:
    p = f"{HIT if r.trigger == 'removed' else ALWAYS}::DOUBLE"
    p = p if not r.anti and not r.hint else f"CASE {f'WHEN regexp_matches(pool, {_q(r.anti)}) THEN {NO_HIT}::DOUBLE ' if r.anti else ''}{f'WHEN regexp_matches(pool, {_q(r.hint)}) THEN {HIT}::DOUBLE ' if r.hint else ''}ELSE {p} END"
    low = r.thresholds or PROFILES["balanced"]
    return f"SELECT unit_id, {_q(r.id)} AS rule_id, {p} AS p, CASE WHEN {p} >= {low[0]}::DOUBLE THEN 'report' WHEN {p} >= {low[1]}::DOUBLE THEN 'uncertain' ELSE 'drop' END AS band FROM p WHERE {_applies_sql(r)}{' AND deleted > 0' if r.trigger == 'removed' else ''}"


_UNIT_RULES = f"""{_added_sql(rules.MARKER)},
    t AS (SELECT unit_id, array_to_string(list(coalesce(line, '') ORDER BY line_no), chr(10)) AS pool FROM l GROUP BY unit_id),
    f AS (SELECT file_id, max(deleted_count) AS deleted FROM changed_files GROUP BY file_id),
    p AS (SELECT n.*, coalesce(pool, '') AS pool, coalesce(deleted, 0) AS deleted FROM n LEFT JOIN t USING (unit_id) LEFT JOIN f USING (file_id)),
    o AS ({' UNION ALL '.join(_unit_rule_sql(r) for r in rules.WIDE_PACK if r.trigger != 'regex')})
"""


def _unit_rules(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, rule_id, p, band): the rules of units without a pattern."""
    deleted = table(spark, d, "changed_files").groupBy("file_id").agg(F.max("deleted_count").alias("deleted"))
    units = rules.prepared(spread_table(spark, d, "review_units"), "unit_id", "file_id").join(deleted, "file_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    hits = rules.unit_triggers(units, "unit_id", rules=rules.WIDE_PACK).select("unit_id", "rule_id", "p").distinct()
    return hits.withColumn("band", rules.rule_band(F.col("p"), F.col("rule_id"), rules.WIDE_PACK))


@query("rule_removed", f"WITH {_UNIT_RULES} SELECT unit_id, rule_id, p, band FROM o WHERE rule_id LIKE 'removed.%'")
def rule_removed(spark: SparkSession, d: str) -> DataFrame:
    """Rules on units of files with deleted lines, with bands by their own thresholds."""
    return _unit_rules(spark, d).where("rule_id LIKE 'removed.%'")


@query("rule_always", f"WITH {_UNIT_RULES} SELECT unit_id, rule_id, p, band FROM o WHERE rule_id LIKE 'review.%'")
def rule_always(spark: SparkSession, d: str) -> DataFrame:
    """Rules that always apply to units of enough added lines, with hints."""
    return _unit_rules(spark, d).where("rule_id LIKE 'review.%'")


_PRIORITIES = ", ".join(f"({_q(r.id)}, {float(r.urgency)})" for r in PACK + rules.WIDE_PACK)


@query(
    "topk_priority",
    f"""
    WITH {_UNIT_RULES}, m AS ({' UNION ALL '.join(_rule_sql(r) for r in PACK + rules.WIDE_PACK[1:2])}), a AS (SELECT DISTINCT unit_id, rule_id FROM m UNION SELECT unit_id, rule_id FROM o),
    k AS (SELECT unit_id, rule_id, row_number() OVER w AS rank, greatest(count(*) OVER (PARTITION BY unit_id) - 2, 0) AS truncated FROM a JOIN (VALUES {_PRIORITIES}) y(rule_id, priority) USING (rule_id) WINDOW w AS (PARTITION BY unit_id ORDER BY priority DESC, rule_id))
    SELECT unit_id, rule_id, rank::INT AS rank, truncated::BIGINT AS truncated FROM k WHERE rank <= 2
    """,
)
def topk_priority(spark: SparkSession, d: str) -> DataFrame:
    """The two most urgent rules of each unit by explicit priority, else severity."""
    units = rules.prepared(spread_table(spark, d, "review_units"), "unit_id")
    all_rules = PACK + rules.WIDE_PACK
    hits = rules.rule_matches(rules.added_lines(units, "unit_id"), "unit_id", rules=all_rules).where(F.col("rule_id") != rules.WIDE_PACK[0].id)
    return rules.urgent_rules(hits.select("unit_id", "rule_id").unionByName(_unit_rules(spark, d).select("unit_id", "rule_id")), "unit_id", all_rules, 2)


@query("rule_counts", f"WITH {_MATCHES} SELECT rule_id, count(*) AS hits, count(DISTINCT unit_id) AS units, count(DISTINCT repo) AS repos FROM m GROUP BY ALL")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits, units and repositories per rule."""
    return matches(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("unit_id").alias("units"), F.countDistinct("repo").alias("repos"))


@query(
    "topk_rules",
    f"""
    WITH {_MATCHES}, r AS (SELECT unit_id, rule_id, max(sev) AS sev FROM m GROUP BY ALL),
    k AS (SELECT unit_id, rule_id, row_number() OVER (PARTITION BY unit_id ORDER BY sev DESC, rule_id) AS rank, greatest(count(*) OVER (PARTITION BY unit_id) - 3, 0) AS truncated FROM r)
    SELECT unit_id, rule_id, rank::INT AS rank, truncated::BIGINT AS truncated FROM k WHERE rank <= 3
    """,
)
def topk_rules(spark: SparkSession, d: str) -> DataFrame:
    """The three most urgent rules of each unit and how many more there were."""
    return rules.top_rules(matches(spark, d), "unit_id", 3)


@query("findings", f"WITH {_FINDINGS} SELECT repo, path, line_no, category, rule_id, severity, p_eff, band, related FROM g")
def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    """The best finding per line and category with the rules it beat."""
    return found(spark, d).select("repo", "path", "line_no", "category", "rule_id", "severity", "p_eff", "band", "related")


@query(
    "findings_top",
    f"""
    WITH {_FINDINGS}, t AS (SELECT * FROM g ORDER BY sev DESC, p_eff DESC, path, line_no, rule_id, category, repo LIMIT 100)
    SELECT row_number() OVER (ORDER BY sev DESC, p_eff DESC, path, line_no, rule_id, category, repo)::INT AS place, repo, path, line_no, rule_id FROM t
    """,
)
def findings_top(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2: the first hundred findings in report order."""
    return rules.ordered(found(spark, d), "repo", "path", limit=100).select("place", "repo", "path", "line_no", "rule_id")


@query(
    "banding",
    " UNION ALL ".join(f"SELECT '{p}' AS profile, {_band_sql(p)} AS band, count(*) AS hits FROM m GROUP BY ALL" for p in PROFILES).join((f"WITH {_MATCHES} ", "")),
)
def banding(spark: SparkSession, d: str) -> DataFrame:
    """Hits per profile and band, from one pass over the hits."""
    bands = F.array(*(F.struct(F.lit(p).alias("profile"), rules.band(F.col("p_eff"), p).alias("band")) for p in PROFILES))
    return matches(spark, d).select(F.explode(bands).alias("b")).groupBy("b.profile", "b.band").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "file_risk",
    f"""
    WITH {_FINDINGS}, x AS (SELECT repo, path, floor(round((1 - p_eff) * 1e6, 3) + 0.5) / 1e6 AS c, band FROM g)
    SELECT repo, path, {r6('1 - product(c)')} AS risk, count(*) AS findings, {r6('1 - product(c)')} >= 0.8 AND count(*) FILTER (band = 'report') = 0 AS deep_review FROM x GROUP BY repo, path
    """,
)
def file_risk(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3: noisy-OR risk per file, and which need a closer look although nothing is reported."""
    both = risk.noisy_or(found(spark, d), "repo", "path", p="p_eff", also=(F.count_if(F.col("band") == "report").alias("_r"),))
    return both.select("repo", "path", "risk", F.col("n").alias("findings"), ((F.col("risk") >= 0.8) & (F.col("_r") == 0)).alias("deep_review"))


@query("dimension_max", f"WITH {_FINDINGS} SELECT repo, path, category, max(p_eff) AS p FROM g GROUP BY ALL")
def dimension_max(spark: SparkSession, d: str) -> DataFrame:
    """A4: the largest probability per file and category, by way of a map."""
    m = risk.maxima(found(spark, d), "repo", "path", name="category", value="p_eff")
    return m.select("repo", "path", F.explode("values").alias("category", "p"))


@query("severity_counts", f"WITH {_FINDINGS} SELECT repo, {', '.join(f'count(*) FILTER (severity = {_q(s)}) AS {s}' for s in reversed(S.SEVERITIES))} FROM g WHERE band = 'report' GROUP BY repo")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reported findings per repository and severity, with zeros."""
    return risk.severity_counts(found(spark, d).where("band = 'report'"), "repo")


@query(
    "verdict",
    f"""
    WITH {_FINDINGS}, v AS (SELECT repo, count(*) FILTER (band = 'report' AND sev >= 2 AND p_eff >= 0.8::DOUBLE) AS blocking, count(*) FILTER (band = 'report') AS reported FROM g GROUP BY repo)
    SELECT repo, CASE WHEN blocking > 0 THEN 'request_changes' WHEN reported > 0 THEN 'comment' ELSE 'approve' END AS decision, blocking FROM v
    """,
)
def verdict(spark: SparkSession, d: str) -> DataFrame:
    """What the findings of each repository amount to."""
    return risk.verdicts(found(spark, d), "repo")


@query(
    "publish_plan",
    f"""
    WITH {_FINDINGS}, f AS (SELECT coalesce(repo, '') AS repo, sha1(rule_id || '|' || path || '|' || line_no::VARCHAR) AS fingerprint, min({{'path': path, 'line_no': line_no}}) AS a FROM g WHERE band = 'report' GROUP BY ALL),
    kn AS (SELECT DISTINCT coalesce(repo, '') AS repo, sha1(rule_id || '|' || path || '|' || line_no::VARCHAR) AS fingerprint FROM m WHERE ascii(substr(sha1(path), 1, 1)) < 56),
    al AS (SELECT DISTINCT coalesce(repo, '') AS repo, replace(path, chr(92), '/') AS path, unnest(added_line_numbers) AS line_no FROM review_units)
    SELECT coalesce(f.repo, kn.repo) AS repo, coalesce(f.fingerprint, kn.fingerprint) AS fingerprint, CASE WHEN f.fingerprint IS NULL THEN 'resolved' WHEN kn.fingerprint IS NOT NULL THEN 'duplicate' WHEN al.path IS NOT NULL THEN 'inline' ELSE 'folded' END AS action
    FROM f FULL JOIN kn ON f.fingerprint = kn.fingerprint AND f.repo = kn.repo LEFT JOIN al ON al.repo = f.repo AND al.path = f.a.path AND al.line_no = f.a.line_no
    """,
)
def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each finding of a repository, given what earlier runs (by path) have published.

    The hits are staged once and serve both the current findings and the published ones.
    """
    hits = staged(matches(spark, d), "hits")
    fp = S.fingerprint(F.col("rule_id"), F.col("path"), F.col("line_no").cast("string"))
    known = hits.where(F.ascii(F.substring(F.sha1("path"), 1, 1)) < 56).select("repo", fp.alias("fingerprint"))
    lines = table(spark, d, "review_units").select("repo", S.slashed(F.col("path")).alias("path"), F.explode("added_line_numbers").alias("line_no"))
    return alerts.publish_plan(rules.findings(hits, "repo", "path").where("band = 'report'"), known, lines)


@query(
    "drift",
    f"""
    WITH {_MATCHES}, b AS (SELECT unit_id, rule_id, max(p_eff) AS p, min(p_eff) AS q FROM m GROUP BY ALL)
    SELECT count(*) AS pairs, count(*) FILTER ({_band_sql('balanced', 'p')} <> {_band_sql('balanced', 'q')}) AS changed, {r6(f"count(*) FILTER ({_band_sql('balanced', 'p')} <> {_band_sql('balanced', 'q')}) / count(*)::DOUBLE")} AS rate,
        count(*) FILTER ({_band_sql('balanced', 'p')} <> {_band_sql('balanced', 'q')}) / count(*)::DOUBLE <= 0.05 AS ok FROM b
    """,
)
def drift(spark: SparkSession, d: str) -> DataFrame:
    """How many (unit, rule) bands differ between the best and the worst hit, as two runs."""
    runs = staged(matches(spark, d).groupBy("unit_id", "rule_id").agg(F.max("p_eff").alias("p"), F.min("p_eff").alias("q")), "runs")
    before = runs.select("unit_id", "rule_id", rules.band(F.col("p")).alias("band"))
    after = runs.select("unit_id", "rule_id", rules.band(F.col("q")).alias("band"))
    return alerts.band_drift(before, after, "unit_id", "rule_id").withColumn("rate", S.round_to(F.col("rate")))


_QUESTIONS = f"""{_MATCHES}, q AS (
    SELECT DISTINCT unit_id, 'r.' || rule_id AS q_key, 'probability' AS kind FROM m UNION SELECT DISTINCT unit_id, 's.' || rule_id, 'score' FROM m
    UNION SELECT DISTINCT unit_id, 'g.' || rule_id, 'probability' FROM m WHERE rule_id IN ({', '.join(_q(r.id) for r in PACK if r.guard)})
    UNION ALL SELECT unit_id, q, 'score' FROM (SELECT DISTINCT unit_id FROM m) x, (VALUES {', '.join(f"('d.{c}')" for c in sorted({r.category for r in PACK}))}) c(q))"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, q_key, kind): what would be asked about each unit with a hit."""
    guarded = [r.id for r in PACK if r.guard]
    shared = [F.struct(F.lit(f"d.{c}").alias("q_key"), F.lit("score").alias("kind")) for c in sorted({r.category for r in PACK})]
    per = matches(spark, d).groupBy("unit_id").agg(F.collect_set("rule_id").alias("ids"))
    ask = lambda p, kind, ids: F.transform(ids, lambda x: F.struct(F.concat(F.lit(p), x).alias("q_key"), F.lit(kind).alias("kind")))
    all_ = F.concat(ask("r.", "probability", F.col("ids")), ask("s.", "score", F.col("ids")), ask("g.", "probability", F.filter("ids", lambda x: x.isin(*guarded))), F.array(*shared))
    return per.select("unit_id", F.explode(all_).alias("q")).select("unit_id", "q.*")


@query("question_table", f"WITH {_QUESTIONS} SELECT unit_id, q_key, kind FROM q")
def question_table(spark: SparkSession, d: str) -> DataFrame:
    """The questions of each unit: shared, per rule, per guard, per severity."""
    return questions(spark, d)


@query(
    "question_batches",
    f"""
    WITH RECURSIVE {_QUESTIONS}, t AS (SELECT unit_id, q_key, greatest(1, ceil(octet_length(encode(q_key || ' ' || kind)) / 3.5))::BIGINT AS tokens, row_number() OVER (PARTITION BY unit_id ORDER BY q_key) AS n FROM q),
    b AS (SELECT unit_id, q_key, tokens, n, 0 AS batch, tokens AS total, tokens AS top FROM t WHERE n = 1
        UNION ALL SELECT t.unit_id, t.q_key, t.tokens, t.n, CASE WHEN 10 + total + t.tokens > 60 OR 10 + greatest(top, t.tokens) > 40 THEN batch + 1 ELSE batch END,
            CASE WHEN 10 + total + t.tokens > 60 OR 10 + greatest(top, t.tokens) > 40 THEN 0 ELSE total END + t.tokens, CASE WHEN 10 + total + t.tokens > 60 OR 10 + greatest(top, t.tokens) > 40 THEN t.tokens ELSE greatest(top, t.tokens) END
        FROM b JOIN t ON t.unit_id = b.unit_id AND t.n = b.n + 1)
    SELECT unit_id, q_key, tokens, batch::INT AS batch FROM b
    """,
)
def question_batches(spark: SparkSession, d: str) -> DataFrame:
    """The questions of each unit in batches of at most 60 estimated tokens."""
    q = questions(spark, d).withColumn("tokens", S.token_estimate(F.concat_ws(" ", "q_key", "kind")))
    return admission.batches(q, "unit_id", "q_key", "tokens", shared=10, total=60, single=40)


@query(
    "request_cap",
    f"WITH {_QUESTIONS} SELECT unit_id, q_key, row_number() OVER (PARTITION BY unit_id ORDER BY q_key) <= 8 AS within FROM q",
)
def request_cap(spark: SparkSession, d: str) -> DataFrame:
    """Which questions of a unit stay within a cap of eight."""
    return admission.capped(questions(spark, d).select("unit_id", "q_key"), "unit_id", ["q_key"], 8)


@query(
    "needs_location",
    f"WITH {_MATCHES} SELECT unit_id, rule_id, count(*) AS hits, min(line_no) AS first_line, {r6('max(p_eff)')} AS p FROM m GROUP BY ALL HAVING count(*) > 1 AND max(p_eff) >= {PROFILES['balanced'][1]}::DOUBLE",
)
def needs_location(spark: SparkSession, d: str) -> DataFrame:
    """Rules with more than one possible line in a unit and a probability worth a second question."""
    per = matches(spark, d).groupBy("unit_id", "rule_id").agg(F.count(F.lit(1)).alias("hits"), F.min("line_no").alias("first_line"), S.round_to(F.max("p_eff")).alias("p"))
    return per.where((F.col("hits") > 1) & (F.col("p") >= PROFILES["balanced"][1]))


@query(
    "messages",
    f"WITH {_FINDINGS} SELECT repo, path, line_no, category, rule_id || ' at ' || path || ':' || line_no::VARCHAR || CASE WHEN related <> '' THEN ' (also ' || related || ')' ELSE '' END AS message FROM g",
)
def messages(spark: SparkSession, d: str) -> DataFrame:
    """each finding's message from a template."""
    t = "{{rule}} at {{path}}:{{line}}{{#if related}} (also {{related}}){{/if}}"
    values = {"rule": F.col("rule_id"), "path": F.col("path"), "line": F.col("line_no"), "related": F.col("related")}
    return found(spark, d).select("repo", "path", "line_no", "category", S.rendered(t, values).alias("message"))


@query(
    "report_markdown",
    f"""
    WITH {_FINDINGS}, r AS (SELECT *, concat_ws(':', repo, path) AS file, '- **' || severity || '** `' || path || ':' || line_no::VARCHAR || '` ' || rule_id AS row FROM g WHERE band IN ('report', 'uncertain')),
    s AS (SELECT file, count(*) FILTER (band = 'report') AS n, {', '.join(f"count(*) FILTER (band = 'report' AND severity = '{x}') AS {x}" for x in reversed(S.SEVERITIES))},
        coalesce(string_agg(row, chr(10) ORDER BY sev DESC, p_eff DESC, path, line_no, rule_id, row) FILTER (band = 'report'), '') AS rl, string_agg(row, chr(10) ORDER BY sev DESC, p_eff DESC, path, line_no, rule_id, row) FILTER (band = 'uncertain') AS ul FROM r GROUP BY file)
    SELECT file, '## ' || n::VARCHAR || ' findings' || CASE WHEN n > 0 THEN ' (' || concat_ws(', ', {', '.join(f"CASE WHEN {x} > 0 THEN {x}::VARCHAR || ' {x}' END" for x in reversed(S.SEVERITIES))}) || ')' ELSE '' END || chr(10) || chr(10) || rl || CASE WHEN ul IS NOT NULL THEN chr(10) || chr(10) || '### Uncertain' || chr(10) || chr(10) || ul ELSE '' END AS text FROM s
    """,
)
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """K3: a Markdown summary of the findings of each file, reported ones first."""
    f = found(spark, d).withColumn("file", F.concat_ws(":", "repo", "path"))
    return sinks.markdown(f, "file")


@query(
    "report_json",
    f"WITH {_FINDINGS} SELECT sha1(rule_id || '|' || path || '|' || line_no::VARCHAR) AS fingerprint, repo, category, json_object('band', band, 'line_no', line_no, 'p_eff', p_eff, 'path', path, 'related', related, 'rule_id', rule_id, 'severity', severity)::VARCHAR AS json FROM g",
)
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """K1: findings as canonical JSON."""
    return sinks.canonical_json(found(spark, d), "fingerprint", "repo", "category")

"""Queries that score labelled cases and measure the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.functions import scalars as S
from diffloom.operators import evals
from diffloom.plans.registry import query, r6
from diffloom.session import staged, table
from diffloom.sources.reports import eval_labels

#: Words of a rule's id that are in the source make the mock more certain: .15 a word above a floor of .3.
_FLOOR, _STEP = 0.3, 0.15

_SCORED = f"""
    l AS (SELECT case_id, lower(language_id) AS language, repo, source, unnest(labels, recursive := true) FROM eval_cases),
    s AS (SELECT case_id, language, repo, rule_id, coalesce(positive, false) AS positive,
        {r6(f'least(0.95, {_FLOOR}::DOUBLE + {_STEP}::DOUBLE * len(list_filter(string_split_regex(rule_id, chr(91) || chr(46) || chr(45) || chr(93)), lambda w: length(w) > 1 AND contains(lower(source), w))) + (ascii(substr(sha1(source), 1, 1)) % 4) * 0.05::DOUBLE)')} AS p_eff FROM l),
    p AS (SELECT case_id, language, repo, rule_id, positive, max(p_eff) AS p_eff FROM s GROUP BY ALL)
"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, language, repo, rule_id, positive, p_eff): every label with a deterministic score."""
    cases = table(spark, d, "eval_cases")
    labels = cases.select("case_id", F.lower("language_id").alias("language"), "repo", "source", F.explode("labels").alias("l"))
    words = F.filter(F.split("l.rule_id", "[.-]"), lambda w: (F.length(w) > 1) & F.contains(F.lower("source"), w))
    salt = (F.ascii(F.substring(F.sha1("source"), 1, 1)) % 4) * F.lit(0.05)
    p = S.round_to(F.least(F.lit(0.95), F.lit(_FLOOR) + F.lit(_STEP) * F.size(words) + salt))
    rows = labels.select("case_id", "language", "repo", "l.rule_id", F.coalesce("l.positive", F.lit(False)).alias("positive"), p.alias("p_eff"))
    return rows.groupBy("case_id", "language", "repo", "rule_id", "positive").agg(F.max("p_eff").alias("p_eff"))


def _conf_sql(t: str = "0.55::DOUBLE") -> str:
    tp, fp, fn, tn = (f"count(*) FILTER ({c})" for c in (f"p_eff >= {t} AND positive", f"p_eff >= {t} AND NOT positive", f"p_eff < {t} AND positive", f"p_eff < {t} AND NOT positive"))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"
    return f"{tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn, {r6(ratio(tp, f'({tp} + {fp})'))} AS precision, {r6(ratio(tp, f'({tp} + {fn})'))} AS recall, {r6(ratio(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})'))} AS f1, {r6(ratio(fp, f'({fp} + {tn})'))} AS fpr"


@query("eval_labels", "SELECT case_id, unnest(labels, recursive := true) FROM eval_cases")
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per label."""
    return eval_labels(table(spark, d, "eval_cases"))


@query(
    "label_left",
    """
    WITH l AS (SELECT case_id, repo, replace(path, chr(92), '/') AS path, unnest(labels, recursive := true) FROM eval_cases),
    t AS (SELECT repo, replace(path, chr(92), '/') AS path, count(*)::DOUBLE / 100 AS p FROM changed_files GROUP BY ALL)
    SELECT case_id, rule_id, positive, coalesce(p, 0::DOUBLE) AS p_eff FROM l LEFT JOIN t USING (repo, path)
    """,
)
def label_left(spark: SparkSession, d: str) -> DataFrame:
    """Every label with the best score of its file, 0 where there is none."""
    path = S.slashed(F.col("path")).alias("path")
    labels = table(spark, d, "eval_cases").select("case_id", "repo", path, F.explode("labels").alias("l")).select("case_id", "repo", "path", "l.rule_id", "l.positive")
    scores = table(spark, d, "changed_files").groupBy("repo", path).agg((F.count(F.lit(1)) / 100).alias("p_eff"))
    return evals.pairs(labels, scores, "repo", "path").select("case_id", "rule_id", "positive", "p_eff")


@query(
    "unlabelled",
    """
    SELECT f.repo, count(*) AS files FROM changed_files f
    WHERE NOT EXISTS (SELECT 1 FROM eval_cases e WHERE e.repo = f.repo AND e.language_id = f.language_id AND len(e.labels) > 0) GROUP BY f.repo
    """,
)
def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository whose language has no labelled case there."""
    labelled = table(spark, d, "eval_cases").where(F.size("labels") > 0).select("repo", "language_id")
    return evals.unlabelled(table(spark, d, "changed_files"), labelled, "repo", "language_id").groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


@query("pairs", f"WITH {_SCORED} SELECT case_id, rule_id, positive, p_eff FROM p")
def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """A10: the best score per case and rule."""
    return scored(spark, d).select("case_id", "rule_id", "positive", "p_eff")


@query("confusion", f"WITH {_SCORED} SELECT language, rule_id, {_conf_sql()} FROM p GROUP BY GROUPING SETS ((), (language), (rule_id))")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion overall, by language and by rule in one pass."""
    return evals.grouped_confusion(scored(spark, d), 0.55, "language", "rule_id")


_BINS = f"""{_SCORED},
    b AS (SELECT range AS bin, range * 0.2::DOUBLE AS lo, CASE WHEN range < 4 THEN (range + 1) * 0.2::DOUBLE ELSE 1.0::DOUBLE END AS hi FROM range(5)),
    r AS (SELECT b.bin::INT AS bin, count(p.p_eff) AS n, {r6('coalesce(avg(p.p_eff), (lo + hi) / 2)')} AS mean_p, {r6('coalesce(avg(p.positive::INT), 0)')} AS rate
        FROM b LEFT JOIN p ON p.p_eff >= lo AND (p.p_eff < hi OR b.bin = 4) GROUP BY b.bin, lo, hi)"""


@query("reliability", f"WITH {_BINS} SELECT * FROM r")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    """Mean score and rate of positives in five bins."""
    return evals.reliability(scored(spark, d))


@query("calibration_error", f"WITH {_BINS} SELECT {r6('sum(n * abs(rate - mean_p)) / sum(n)')} AS ece FROM r")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """The expected calibration error."""
    return evals.calibration_error(evals.reliability(scored(spark, d)))


_GRID = f"{_SCORED}, t AS (SELECT range / 100::DOUBLE AS threshold FROM range(50, 96, 5)), g AS (SELECT threshold, {_conf_sql('threshold')} FROM t, p GROUP BY threshold)"


@query("threshold_grid", f"WITH {_GRID} SELECT threshold, tp, fp, fn, tn, precision, recall, f1 FROM g")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Confusion at each threshold of the grid."""
    return evals.threshold_grid(scored(spark, d))


@query(
    "threshold_proposals",
    f"""
    WITH {_GRID}, b AS (SELECT threshold FROM g ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1),
    c AS (SELECT threshold FROM g WHERE precision >= 0.9 ORDER BY precision DESC, recall DESC, threshold DESC LIMIT 1),
    a AS (SELECT threshold FROM g WHERE precision >= 0.5 ORDER BY recall DESC, f1 DESC, threshold LIMIT 1)
    SELECT 'balanced' AS profile, (SELECT threshold FROM b) AS threshold UNION ALL SELECT 'chill', coalesce((SELECT threshold FROM c), (SELECT threshold FROM b)) UNION ALL SELECT 'assertive', coalesce((SELECT threshold FROM a), (SELECT threshold FROM b))
    """,
)
def threshold_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The threshold each profile would choose."""
    return evals.proposals(evals.threshold_grid(scored(spark, d)))


def _fusion_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scores with a guard: sources that look like tests speak against a finding."""
    cases = table(spark, d, "eval_cases").select("case_id", (F.length("source") % 10 / 10.0).alias("guard"))
    return scored(spark, d).join(cases, "case_id").select("positive", F.col("p_eff").alias("main"), "guard")


@query("logistic_fit")
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Bias and weights of main and guard probability by 25 Newton steps."""
    bias, main, guard = evals.logistic_fit(staged(_fusion_rows(spark, d), "fusion"), "main", "guard", "positive")
    return spark.createDataFrame([(bias, main, guard)], "bias double, main double, guard double").select(*(S.round_to(F.col(c)).alias(c) for c in ("bias", "main", "guard")))


@query("fusion_study")
def fusion_study(spark: SparkSession, d: str) -> DataFrame:
    """The product rule against the fitted one, by F1 and calibration error, and whether to adopt the fitted one."""
    rows = staged(_fusion_rows(spark, d), "fusion")
    w = evals.logistic_fit(rows, "main", "guard", "positive")
    product = rows.withColumn("p_eff", S.round_to(F.col("main") * (1 - F.col("guard"))))
    fitted = rows.withColumn("p_eff", S.round_to(S.sigmoid(F.lit(w[0]) + F.lit(w[1]) * F.col("main") + F.lit(w[2]) * F.col("guard"))))
    (f, e), (g, h) = (evals.summary(x, 0.5) for x in (product, fitted))
    adopt = evals.adopted((f, e), (g, h))
    return spark.createDataFrame([("product", f, e, False), ("fitted", g, h, adopt)], "method string, f1 double, ece double, adopt boolean")

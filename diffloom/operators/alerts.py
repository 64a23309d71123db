"""Alerts against changed lines: semi joins on lines, range joins to units, publication plans, drift, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffloom.operators.skew import dictionary_join, hot_keys

#: Lines per bucket of the range join; a span is repeated once per bucket it touches.
BUCKET = 256
#: Letters of a stem by which it meets the names that may contain it.
GRAM = 8


def alerts_on_lines(alerts: DataFrame, added: DataFrame, context: int = 0) -> DataFrame:
    """Alerts whose (repo, path, line) is among the added lines, or up to ``context`` lines from one."""
    near = added.select("repo", "path", F.explode(F.sequence(F.greatest(F.col("line") - context, F.lit(1)), F.col("line") + context)).alias("line")) if context else added.select("repo", "path", "line")
    return alerts.join(near.distinct(), ["repo", "path", "line"], "left_semi")


def alert_units(alerts: DataFrame, units: DataFrame, key: str = "raw_id") -> DataFrame:
    """``alerts`` with the first unit (by start and id) of the same repo and path whose span holds the line, or null.

    An equi join on (repo, path, bucket of lines) and a range condition: a span meets only the alerts of its buckets.
    """
    spans = units.select("repo", "path", "unit_id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("_bucket"))
    a = alerts.withColumn("_bucket", F.floor(F.col("line") / BUCKET))
    both = a.join(spans, ["repo", "path", "_bucket"], "left").withColumn("_in", F.col("line").between(F.col("start_line"), F.col("end_line")))
    first = F.min(F.when(F.col("_in"), F.struct("start_line", "unit_id")))
    hit = both.groupBy(key).agg(first.alias("_f")).select(key, F.col("_f.unit_id").alias("unit_id"))
    return alerts.join(hit, key, "left")


def publish_plan(current: DataFrame, known: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, fingerprint, action): resolved, duplicate, inline or folded, from current findings and known fingerprints.

    All three tables have a repository; ``lines`` (repo, path, line_no) are the lines that can carry a comment. A null
    repository is one of its own.
    """
    repo = F.coalesce("repo", F.lit("")).alias("repo")
    k = known.select(repo, "fingerprint").distinct().withColumn("_known", F.lit(True))
    c = current.groupBy(repo, "fingerprint").agg(F.min(F.struct("path", "line_no")).alias("_at"))
    both = c.join(k, ["repo", "fingerprint"], "full")
    at = lines.select(repo, "path", "line_no").distinct().withColumn("_line", F.lit(True))
    placed = both.select("repo", "fingerprint", F.col("_at").isNotNull().alias("_current"), "_known", F.col("_at.path").alias("path"), F.col("_at.line_no").alias("line_no")).join(at, ["repo", "path", "line_no"], "left")
    action = F.when(~F.col("_current"), "resolved").when(F.col("_known"), "duplicate").when(F.col("_line"), "inline").otherwise("folded")
    return placed.select("repo", "fingerprint", action.alias("action"))


def band_drift(before: DataFrame, after: DataFrame, *keys: str, order: str | None = None, model: str | None = None) -> DataFrame:
    """(pairs, changed, rate, ok): how many keys change their band between two runs; ok up to one in twenty.

    Of several rows of ``after`` with one key the last by ``order`` counts. Runs of more than one ``model`` can't be
    compared: no pairs, rate 1, not ok.
    """
    last = after.groupBy(*keys).agg(F.max_by("band", order or F.lit(0)).alias("_a"))
    both = before.select(*keys, F.col("band").alias("_b")).join(last, list(keys))
    changed = F.count_if(F.col("_a") != F.col("_b"))
    n = F.count(F.lit(1))
    out = both.agg(n.alias("pairs"), changed.alias("changed"))
    if model:
        models = before.select(model).unionByName(after.select(model)).agg((F.countDistinct(model) == 1).alias("_one"))
    else:
        models = before.sparkSession.range(1).select(F.lit(True).alias("_one"))
    out = out.withColumn("_k", F.lit(0)).join(models.withColumn("_k", F.lit(0)), "_k")  # one row each
    rate = F.when(~F.col("_one"), F.lit(1.0)).when(F.col("pairs") > 0, F.col("changed") / F.col("pairs")).otherwise(F.lit(0.0))
    none = lambda c: F.when(F.col("_one"), F.col(c)).otherwise(F.lit(0)).alias(c)
    return out.select(none("pairs"), none("changed"), rate.alias("rate"), (rate <= 0.05).alias("ok"))


def cache_split(requests: DataFrame, cache: DataFrame, spread: str, key: str = "request_key") -> DataFrame:
    """``requests`` with ``hit``: whether their key is in the cache; frequent keys are spread by column ``spread``."""
    counted = requests.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counted, key, "n", requests.count())
    present = cache.select(key).distinct().withColumn("hit", F.lit(True))
    return dictionary_join(requests, present, key, spread, hot, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def request_key(*parts: Column) -> Column:
    """SHA-256 of the parts as canonical JSON (keys in order, nulls kept)."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def related(files: DataFrame, tests: DataFrame, group: str = "repo") -> DataFrame:
    """(file_id, test): tests (group, path, base) of a file's group whose base name contains the file's whole stem.

    ``files`` are (file_id, group, path, stem); a file isn't its own test, letter case counts, and an empty stem is in
    every name. The first GRAM letters of each stem meet all such pieces of the base names by equality, and the pairs
    are then held to the whole stem; stems and base names are each joined once, however many files bear them.
    """
    stems = files.select(group, "stem").distinct().withColumn("_gram", F.substring("stem", 1, GRAM))
    names = tests.select(group, "base").distinct()
    pieces = names.select(group, "base", F.explode(F.sequence(F.lit(1), F.length("base"))).alias("_at")).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(GRAM))))
    pieces = pieces.select(group, "base", F.expr("substring(base, _at, _n)").alias("_gram")).distinct()
    held = stems.join(pieces, [group, "_gram"]).where(F.col("base").contains(F.col("stem"))).select(group, "stem", "base")
    of = files.select("file_id", group, "path", "stem").join(held, [group, "stem"])
    return of.join(tests.select(group, "base", F.col("path").alias("test")).distinct(), [group, "base"]).where("path <> test").select("file_id", "test").distinct()


def first_per_key(df: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

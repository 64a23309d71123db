"""Delimited records that fail to parse: load the valid ones, set the rest aside with reasons.

Structure (quoting, field count) is checked per record with one regular expression per layout. Values are checked
per distinct value: the fields of all structurally sound records are unpivoted to (column, value), and each distinct
pair is cast and checked once. The invalid pairs, with reasons, are the dictionary that is joined back; the valid ones
carry the cast value to the loaded records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diffloom.operators.skew import HOT_SHARE, dictionary_join, small
from diffloom.session import staged

CHECKED = ("line", "path", "rule_id", "level")
MAX_LINE = 2147483647
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def _layouts(feeds: DataFrame) -> DataFrame:
    """Feeds with the patterns of a whole record and of one field. A delimiter is one character that isn't a quote."""
    d = F.concat(F.lit("\\"), F.col("delimiter"))
    d = F.when(F.col("delimiter").rlike(r"^[A-Za-z0-9\t ]$"), F.col("delimiter")).otherwise(d)
    field = F.concat(F.lit(f"(?:{_QUOTED}|[^\""), d, F.lit("\\r\\n]*+)"))
    loose = F.concat(F.lit(f"({_QUOTED}|[^\""), d, F.lit("]*+)"))
    return feeds.select(
        F.col("feed").alias("_feed"),
        "n_columns",
        "column_names",
        "delimiter",
        F.concat(F.lit("^"), field, F.lit("(?:"), d, field, F.lit(r")*+\z")).alias("_sound"),
        F.concat(d, loose).alias("_field"),
    )


def _unquote(v: Column) -> Column:
    return F.when(v.startswith('"'), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)


def _parsed(lines: DataFrame, feeds: DataFrame, key: str, keep: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """(key, keep.., feed, reason, fields): the structural check, done once and staged.

    ``reason`` is null for sound records; ``fields`` maps the columns of the layout (or those in ``only``) to values.
    """
    df = lines.select(key, *keep, "feed", "raw_line").join(small(_layouts(feeds)), F.col("feed") == F.col("_feed"), "left")
    df = df.withColumn("_body", F.regexp_replace("raw_line", r"\r\z", ""))
    values = F.when(F.expr("_body rlike _sound"), F.expr("regexp_extract_all(concat(delimiter, _body), _field, 1)"))
    df = df.withColumn("_values", F.explode(F.array(values)))  # one row a row; keeps the patterns from being run again for each use below
    reason = (
        F.when(F.col("raw_line").isNull(), "no record")
        .when(F.col("n_columns").isNull(), "unknown feed")
        .when(F.col("_values").isNull(), "broken quoting")
        .when(F.size("_values") < F.col("n_columns"), "too few fields")
        .when(F.size("_values") > F.col("n_columns"), "too many fields")
    )
    df = df.withColumn("reason", reason)
    fields = F.map_from_arrays(F.col("column_names"), F.transform("_values", _unquote))
    if only:
        fields = F.map_filter(fields, lambda k, _: k.isin(*only))
    return staged(df.select(key, *keep, "feed", "reason", F.when(F.col("reason").isNull(), fields).alias("fields")), "records")


def checked_values(pairs: DataFrame) -> DataFrame:
    """(column, value, n, reason, number): each distinct (column, value) with how often it occurs, checked once.

    ``reason`` is null for valid values; ``number`` is the cast value of a valid line.
    """
    v, c = F.col("value"), F.col("column")
    number = F.expr("try_cast(regexp_extract(value, '^ *0*([0-9]{1,10}) *$', 1) as bigint)")
    line_bad = F.when(~v.rlike(r"\A *[0-9]+ *\z"), "line is not a whole number").when(number.isNull() | (number < 1) | (number > MAX_LINE), "line is out of range")
    path_bad = F.when(v.rlike(r"(?U)\A\s*\z"), "path is blank").when(v.rlike(_CONTROL) | v.contains("�"), "path has control or replacement characters")
    rule_bad = F.when(v == "", "rule_id is empty").when(v.rlike(r"(?U)\s") | v.rlike(_CONTROL), "rule_id has white space or control characters")
    level_bad = F.when(~F.lower(F.regexp_replace(v, r"\A +| +\z", "")).isin("error", "warning", "note", "none") & ~v.rlike(r"(?U)\A\s*\z"), "level is unknown")
    reason = F.when(c == "line", line_bad).when(c == "path", path_bad).when(c == "rule_id", rule_bad).when(c == "level", level_bad)
    distinct = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return distinct.withColumn("reason", reason).withColumn("number", F.when((c == "line") & F.col("reason").isNull(), number.cast("int")))


def _pairs(parsed: DataFrame, *keep: str) -> DataFrame:
    """(keep.., column, value) of the checked columns of all sound records."""
    sound = parsed.where(F.col("reason").isNull())
    return sound.select(*keep, F.explode(F.map_filter("fields", lambda k, _: k.isin(*CHECKED))).alias("column", "value"))


def _checked(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values of parsed records, checked and staged, and those of them that hold a large share of all.

    At most 1 / HOT_SHARE values can hold that share.
    """
    values = staged(checked_values(_pairs(parsed)), "values")
    many = max(1.0, (values.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    return values, values.where(F.col("n") >= many)


def _bad(parsed: DataFrame, key: str, values: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, reasons) of parsed records.

    Frequent valid values leave the pairs before these are shuffled; frequent invalid ones are spread over many tasks.
    """
    pair = F.concat_ws("\u0000", "column", "value").alias("_pair")
    broken = parsed.where(F.col("reason").isNotNull()).select(key, "reason")
    open_ = _pairs(parsed, key).select(key, pair).join(F.broadcast(frequent.where("reason IS NULL").select(pair)), "_pair", "left_anti")
    bad = values.where("reason IS NOT NULL").select(pair, "reason")
    found = dictionary_join(open_, bad, "_pair", key, frequent.where("reason IS NOT NULL").select(pair)).select(key, "reason")
    return broken.unionByName(found).groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def bad_records(lines: DataFrame, feeds: DataFrame, key: str = "raw_id") -> DataFrame:
    """(key, reasons): every record that isn't valid, once, with its sorted reasons.

    Null records and unknown feeds are invalid. Each key counts once, however often its row is repeated. Records with
    more than one bad value list every reason. Empty input gives an empty result; extra columns are ignored.
    """
    parsed = _parsed(lines, feeds, key, only=CHECKED)
    return _bad(parsed, key, *_checked(parsed))


def load_alerts(lines: DataFrame, feeds: DataFrame, key: str = "raw_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The valid records as typed alerts: key, keep.., feed, tool, rule_id, level, path, line, message, help_uri, run_no.

    Paths get forward slashes; a blank level is null; columns a feed lacks are null. ``line`` is taken from the checked
    values, each of which is cast once.
    """
    parsed = _parsed(lines, feeds, key, keep)
    values, frequent = _checked(parsed)
    good = parsed.where(F.col("reason").isNull()).join(_bad(parsed, key, values, frequent).select(key), key, "left_anti")
    f = lambda name: F.try_element_at("fields", F.lit(name))
    level = F.lower(F.trim(f("level")))
    text = good.select(
        key,
        *keep,
        "feed",
        f("tool").alias("tool"),
        f("rule_id").alias("rule_id"),
        F.when(level != "", level).alias("level"),
        F.translate(f("path"), "\\", "/").alias("path"),
        f("line").alias("_line"),
        f("message").alias("message"),
        f("help_uri").alias("help_uri"),
        f("run_no").alias("run_no"),
    )
    lines_of = lambda df: df.where("column = 'line'").select(F.col("value").alias("_line"), F.col("number").alias("line"))
    typed = dictionary_join(text, lines_of(values), "_line", key, lines_of(frequent).select("_line"), "left")
    return typed.select(key, *keep, "feed", "tool", "rule_id", "level", "path", "line", "message", "help_uri", "run_no")

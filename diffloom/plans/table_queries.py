"""Queries that run the same operators over the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.functions import scalars as S
from diffloom.operators import admission, alerts, risk, rules
from diffloom.operators.rules import PROFILES
from diffloom.plans.registry import query, r6
from diffloom.session import table


@query("guarded_probability", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {r6('(1 - l_discount) * pow(1 - l_tax, 1)')} AS p_eff FROM lineitem")
def guarded_probability(spark: SparkSession, d: str) -> DataFrame:
    """A1: one probability guarded by another, per row."""
    guards = F.array(F.struct(F.col("l_tax").alias("p"), F.lit(1.0).alias("weight")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", S.guarded(1 - F.col("l_discount"), guards).alias("p_eff"))


@query(
    "order_risk",
    f"""
    WITH x AS (SELECT l_orderkey, floor(round((1 - l_discount) * 1e6, 3) + 0.5) / 1e6 AS c FROM lineitem)
    SELECT l_orderkey, {r6('1 - product(c)')} AS risk, count(*) AS n FROM x GROUP BY l_orderkey
    """,
)
def order_risk(spark: SparkSession, d: str) -> DataFrame:
    """A2: noisy-OR per order."""
    return risk.noisy_or(table(spark, d, "lineitem"), "l_orderkey", p="l_discount")


@query(
    "quantity_severity",
    "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 25 THEN 'medium' WHEN l_quantity < 40 THEN 'high' ELSE 'critical' END AS severity, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
)
def quantity_severity(spark: SparkSession, d: str) -> DataFrame:
    """A score mapped to a severity."""
    q = F.col("l_quantity")
    rank = (q >= 10).cast("int") + (q >= 25).cast("int") + (q >= 40).cast("int")
    return table(spark, d, "lineitem").groupBy(S.severity_name(rank).alias("severity"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "best_line",
    """
    SELECT l_orderkey, l_returnflag, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) = 1
    """,
)
def best_line(spark: SparkSession, d: str) -> DataFrame:
    """The best row per key with a total order."""
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_shipdate")]
    return alerts.first_per_key(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", order=order).select("l_orderkey", "l_returnflag", "l_partkey", "l_extendedprice")


_USER_MAX = "SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL"


@query("user_maxima", _USER_MAX)
def user_maxima(spark: SparkSession, d: str) -> DataFrame:
    """A4: per user the largest value of each event type."""
    m = risk.maxima(table(spark, d, "events"), "user_id", name="event_type", value="value")
    return m.select("user_id", F.explode("values").alias("event_type", "value"))


@query("cost_rollup", f"SELECT event_type, count(*) AS requests, sum(json_extract(props, '$.k')::BIGINT) AS tokens, {r6('sum(json_extract(props, chr(36) || chr(46) || chr(107))::BIGINT) * 0.042::DOUBLE / 1e6')} AS cost FROM events GROUP BY ALL")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Requests, tokens and cost per type."""
    tokens = F.sum(F.get_json_object("props", "$.k").cast("long"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), tokens.alias("tokens"), S.round_to(tokens * F.lit(0.042) / F.lit(1e6)).alias("cost"))


@query(
    "compare_rate",
    "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events",
)
def compare_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events of the same type in the hour up to each event."""
    return admission.rates(table(spark, d, "events"), "ts", 3600, "event_type").select("event_id", "recent")


@query("bucket_rate", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def bucket_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and whole hour."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "budget_admit",
    """
    WITH RECURSIVE e AS (SELECT user_id, event_id, json_extract(props, '$.k')::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, tokens, n, tokens <= 1000 AS admitted, CASE WHEN tokens <= 1000 THEN tokens ELSE 0 END AS spent FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_id, e.tokens, e.n, r.spent + e.tokens <= 1000, r.spent + CASE WHEN r.spent + e.tokens <= 1000 THEN e.tokens ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, event_id, tokens, admitted FROM r
    """,
)
def budget_admit(spark: SparkSession, d: str) -> DataFrame:
    """Greedy admission of each user's events under a token budget."""
    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return admission.admitted(e, "user_id", ["event_id"], "tokens", 1000)


@query(
    "order_bands",
    " UNION ALL ".join(f"SELECT '{n}' AS profile, CASE WHEN p >= {a}::DOUBLE THEN 'report' WHEN p >= {b}::DOUBLE THEN 'uncertain' ELSE 'drop' END AS band, count(*) AS n FROM (SELECT {r6('(1 - 5 * l_discount) * (1 - l_tax)')} AS p FROM lineitem) GROUP BY ALL" for n, (a, b) in PROFILES.items()),
)
def order_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands per profile over the order lines."""
    p = S.round_to((1 - 5 * F.col("l_discount")) * (1 - F.col("l_tax")))
    rows = table(spark, d, "lineitem").select(p.alias("p"))
    bands = F.array(*(F.struct(F.lit(n).alias("profile"), rules.band(F.col("p"), n).alias("band")) for n in PROFILES))
    return rows.select(F.explode(bands).alias("b")).groupBy("b.profile", "b.band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "late_orders",
    "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 30 DAY) GROUP BY ALL",
)
def late_orders(spark: SparkSession, d: str) -> DataFrame:
    """J3 over the order tables: a semi join with a range condition."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    late = o.join(li, (o.o_orderkey == li.l_orderkey) & (li.l_shipdate > o.o_orderdate + F.expr("INTERVAL 30 DAY")), "left_semi")
    return late.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "user_sessions",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
    s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, s
    """,
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with gaps under six hours, by session windows."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    return s.drop("session_window")

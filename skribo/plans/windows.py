"""Operators over ordered rows, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.plans.base import query
from skribo.plans.texts import key_sql


@query("wn_lookahead", "SELECT conv_id, turn, concat_ws('|', nullif(lead(role, 1) OVER w, ''), nullif(lead(role, 2) OVER w, ''), nullif(lead(role, 3) OVER w, ''), nullif(lead(role, 4) OVER w, '')) AS next_titles FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lookahead(t):
    ahead = F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 4))
    return t("conversations").select("conv_id", "turn", F.array_join(F.filter(ahead, lambda x: x != ""), "|").alias("next_titles"))


@query("wn_slug_dedupe", f"SELECT p_partkey AS id, s || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM (SELECT p_partkey, replace({key_sql('p_type')}, ' ', '-') || '-' || p_size AS s FROM part))")
def slug_dedupe(t):
    rows = t("part").select("p_partkey", F.concat_ws("-", X.slug(F.col("p_type")), F.col("p_size").cast("string")).alias("s"))
    k = F.row_number().over(Window.partitionBy("s").orderBy("p_partkey"))
    return rows.withColumn("k", k).select(F.col("p_partkey").alias("id"), F.concat("s", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("slug"))


_SESSIONS = "SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events"


def sessions(events):
    """Each user's runs: a signup starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("session", F.sum((F.col("event_type") == "signup").cast("long")).over(w))


@query("wn_fill_context", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS context FROM events")
def fill_context(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("context"))


@query("so_chrono", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(year(o_orderdate), 9999), o_orderpriority, o_orderkey) AS place FROM orders")
def chrono(t):
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce(F.year("o_orderdate"), F.lit(9999)), "o_orderpriority", "o_orderkey")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("place"))


@query("so_topk", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations) WHERE k <= 3")
def topk(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    return t("conversations").withColumn("k", F.row_number().over(w)).where("k <= 3").select("conv_id", "turn")


@query("so_caves", "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, lower(name)")
def caves(t):
    return t("part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("name"))


@query("pf_page", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 12 OFFSET 24")
def page(t):
    """The third page of twelve: a report of fixed length."""
    return t("orders").select(F.col("o_orderkey").alias("id")).orderBy("id").offset(24).limit(12)

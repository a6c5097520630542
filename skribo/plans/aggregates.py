"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.operators.numbering import numbered
from skribo.plans.base import query
from skribo.plans.texts import key_sql


@query("ag_issue_pdf", "SELECT o_custkey AS pdf, count(*) AS n, min(year(o_orderdate))::BIGINT AS first_year, max(year(o_orderdate))::BIGINT AS last_year, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders WHERE o_custkey > 0 GROUP BY 1")
def issue_pdf(t):
    year = F.year("o_orderdate").cast("long")
    return t("orders").where("o_custkey > 0").groupBy(F.col("o_custkey").alias("pdf")).agg(F.count("*").alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("ag_manifest", """SELECT unnest(['articles', 'customers', 'first_year', 'last_year', 'open']) AS key, unnest([count(*), count(DISTINCT o_custkey), min(year(o_orderdate)), max(year(o_orderdate)), count(*) FILTER (WHERE o_orderstatus = 'O')])::BIGINT AS value FROM orders""")
def manifest(t):
    totals = t("orders").agg(F.count("*").alias("articles"), F.countDistinct("o_custkey").alias("customers"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return totals.unpivot([], totals.columns, "key", "value")


@query("ag_shard_stats", "SELECT source AS journal, lang AS year, count(*) AS chunks, count(DISTINCT doc_id) AS articles, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def shard_stats(t):
    rows = t("documents").select(F.col("source").alias("journal"), F.col("lang").alias("year"), "doc_id", F.octet_length("text").cast("long").alias("b"), F.length("text").cast("long").alias("c"))
    j, y = F.col("journal"), F.col("year")
    return rows.groupingSets([[j, y], [j], []], j, y).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("articles"), F.sum("b").alias("bytes"), F.sum("c").alias("chars"))


@query("ag_reconcile_report", "SELECT count(*) AS input, count(DISTINCT (conv_id, role)) AS kept, count(*) - count(DISTINCT (conv_id, role)) AS removed FROM conversations")
def reconcile_report(t):
    return t("conversations").agg(F.count("*").alias("input"), F.countDistinct("conv_id", "role").alias("kept"), (F.count("*") - F.countDistinct("conv_id", "role")).alias("removed"))


@query("ag_page_map", "SELECT l_suppkey AS printed, min(l_orderkey) AS physical FROM lineitem GROUP BY 1")
def page_map(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("printed")).agg(F.min("l_orderkey").alias("physical"))


@query("ag_mode_offset", "SELECT supp, off FROM (SELECT supp, off, row_number() OVER (PARTITION BY supp ORDER BY n DESC, first) AS k FROM (SELECT l_suppkey AS supp, l_partkey % 7 AS off, count(*) AS n, min((l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1, 2)) WHERE k = 1")
def mode_offset(t):
    """The most frequent offset, the first seen of ties: an aggregate of an aggregate."""
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("supp"), (F.col("l_partkey") % 7).alias("off")).agg((-F.count("*")).alias("n"), F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    return counts.groupBy("supp").agg(F.min(F.struct("n", "first", "off")).alias("m")).select("supp", F.col("m.off").alias("off"))


@query("ag_group_pdf", "SELECT c_custkey AS pdf, count(o_orderkey) AS n, min(o_orderkey) AS first_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def group_pdf(t):
    groups = t("orders").groupBy(F.col("o_custkey").alias("pdf")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))
    rest = t("customer").join(groups, F.col("c_custkey") == F.col("pdf"), "left_anti").select(F.col("c_custkey").alias("pdf"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first_id"))
    known = groups.join(t("customer"), F.col("c_custkey") == F.col("pdf"), "left_semi")
    return known.unionByName(rest)


@query("ag_years_chart", "SELECT y::BIGINT AS year, count(o_orderkey) AS n FROM (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) - 1 FROM orders), (SELECT max(year(o_orderdate)) + 1 FROM orders))) AS y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY 1")
def years_chart(t):
    counts = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    every = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("year"))
    return every.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


@query("ag_top_authors", "SELECT o_custkey AS author, count(*) AS n FROM orders WHERE o_custkey % 10 > 0 GROUP BY 1 ORDER BY n DESC, author LIMIT 12")
def top_authors(t):
    return t("orders").where("o_custkey % 10 > 0").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(12)


@query("ag_portal_stats", "SELECT count(*) AS articles, min(year(o_orderdate))::BIGINT AS first_year, max(year(o_orderdate))::BIGINT AS last_year, count(*) FILTER (WHERE o_orderstatus = 'F') AS maps, count(DISTINCT o_custkey) AS authors FROM orders")
def portal_stats(t):
    year = F.year("o_orderdate").cast("long")
    return t("orders").agg(F.count("*").alias("articles"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(F.col("o_orderstatus") == "F").alias("maps"), F.countDistinct("o_custkey").alias("authors"))


@query("ag_aliases", f"SELECT p_brand AS number, name, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS place FROM (SELECT p_brand, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS first FROM part GROUP BY p_brand, {key_sql('p_name')})")
def aliases(t):
    """The names of each number, a row each, the first spelling of a folded name, in the order in which they come."""
    return distinct_in_order(t("part"), "p_brand", "p_name", "p_partkey").select(F.col("p_brand").alias("number"), F.col("p_name").alias("name"), "place")


@query("st_unique", f"SELECT p_brand AS grp, kept, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS place FROM (SELECT p_brand, arg_min(p_type, p_partkey) AS kept, min(p_partkey) AS first FROM part GROUP BY p_brand, {key_sql('p_type')})")
def unique(t):
    return distinct_in_order(t("part"), "p_brand", "p_type", "p_partkey").select(F.col("p_brand").alias("grp"), F.col("p_type").alias("kept"), "place")


def distinct_in_order(rows, by: str, value: str, order: str, key=X.normalize_key):
    """by, value, place (from 1): the first spelling of each folded value of a group, in order. What is numbered are distinct values, however many rows a group has."""
    first = rows.groupBy(by, key(F.col(value)).alias("_key")).agg(F.min(F.struct(order, value)).alias("m")).select(by, F.col(f"m.{value}").alias(value), F.col(f"m.{order}").alias("_order"))
    return numbered(first, ["_order"], "place", (by,)).select(by, value, "place")


@query(
    "ag_status_counts",
    """WITH e AS (SELECT *, 2000 + event_id % 5 AS year, CASE WHEN event_id % 7 = 0 THEN 'kongres' ELSE (event_id % 4 + 9)::VARCHAR END AS issue FROM events), g AS (SELECT DISTINCT year, issue FROM e WHERE event_type = 'error')
    SELECT 'status' AS kind, event_type AS value, NULL::BIGINT AS year, count(*) AS n, NULL::BIGINT AS place FROM e GROUP BY 2 UNION ALL SELECT 'issue', issue, year, NULL, row_number() OVER (ORDER BY year DESC, regexp_full_match(issue, '\\d+') DESC, try_cast(issue AS BIGINT) DESC, issue DESC) FROM g""",
)
def status_counts(t):
    """How many items have each status; and the issues with failed ones, the latest first, numbered issues before others."""
    issue = F.when(F.col("event_id") % 7 == 0, "kongres").otherwise((F.col("event_id") % 4 + 9).cast("string"))
    e = t("events").select("event_type", (2000 + F.col("event_id") % 5).alias("year"), issue.alias("issue"))
    counts = e.groupBy(F.lit("status").alias("kind"), F.col("event_type").alias("value"), F.lit(None).cast("long").alias("year")).agg(F.count("*").alias("n")).withColumn("place", F.lit(None).cast("long"))
    groups = e.where("event_type = 'error'").select("year", "issue").distinct()
    return counts.unionByName(latest_first(groups, "year", "issue").select(F.lit("issue").alias("kind"), F.col("issue").alias("value"), "year", F.lit(None).cast("long").alias("n"), "place"))


def latest_first(groups, year: str, issue: str):
    """groups with place: by year, then issues that are numbers, then the others, the greatest first."""
    number = F.col(issue).rlike(r"^\d+$")
    return numbered(groups.withColumn("_n", F.col(issue).try_cast("long")).withColumn("_is", number), [F.desc(year), F.desc("_is"), F.desc("_n"), F.desc(issue)], "place").drop("_n", "_is")


@query(
    "ag_metrics",
    """WITH r AS (SELECT regexp_matches(lower(text), 'stupid|idiot|trash') AS p, toxic = 1 AS g, length(text) / 1000.0::DOUBLE AS s, doc_id % 20 = 0 AS e FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE NOT p AND g) AS fn, count(*) FILTER (WHERE NOT p AND NOT g) AS tn, count(*) FILTER (WHERE e) AS parse_errors, round(sum(s), 3) AS latency_total, round(avg(s), 3) AS latency_avg, round(quantile_cont(s, 0.5), 3) AS latency_median FROM r)
    SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision_, tp / nullif(tp + fn, 0)::DOUBLE AS recall, (tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS accuracy FROM c""",
)
def metrics(t):
    """A word rule held against the labels, with what it cost."""
    rows = t("documents").join(t("labels"), "doc_id").select(F.lower("text").rlike("stupid|idiot|trash").alias("p"), (F.col("toxic") == 1).alias("g"), (F.length("text") / 1000.0).alias("s"), (F.col("doc_id") % 20 == 0).alias("e"))
    return confusion(rows, F.col("p"), F.col("g"), F.col("s"), F.col("e"))


def confusion(rows, predicted, true, seconds, failed):
    """tp, fp, fn, tn, parse_errors, latency_total, latency_avg, latency_median, precision_, recall, accuracy; ratios are null without a denominator, latencies without any."""
    c = rows.agg(
        F.count_if(predicted & true).alias("tp"),
        F.count_if(predicted & ~true).alias("fp"),
        F.count_if(~predicted & true).alias("fn"),
        F.count_if(~predicted & ~true).alias("tn"),
        F.count_if(failed).alias("parse_errors"),
        F.round(F.sum(seconds), 3).alias("latency_total"),
        F.round(F.avg(seconds), 3).alias("latency_avg"),
        F.round(F.percentile(seconds, 0.5), 3).alias("latency_median"),
    )
    ratio = lambda a, b, name: F.try_divide(F.expr(a).cast("double"), F.expr(b)).alias(name)
    return c.select("*", ratio("tp", "tp + fp", "precision_"), ratio("tp", "tp + fn", "recall"), ratio("tp + tn", "tp + fp + fn + tn", "accuracy"))

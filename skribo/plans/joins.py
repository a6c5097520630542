"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.plans.base import query
from skribo.plans.texts import key_sql


@query("jn_fulltext", """SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'rated' END AS state
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def fulltext(t):
    last = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit("rated").alias("state"))
    return t("documents").select("doc_id", "lang").join(last, "doc_id", "left").select("doc_id", "lang", F.col("quality").cast("long").alias("quality"), F.coalesce("state", F.lit("missing")).alias("state"))


@query("jn_entity_timeline", "SELECT p_brand AS entity, l_returnflag AS relation, o_orderkey AS article, year(o_orderdate)::BIGINT AS year FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey")
def entity_timeline(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("p_brand").alias("entity"), F.col("l_returnflag").alias("relation"), F.col("o_orderkey").alias("article"), F.year("o_orderdate").cast("long").alias("year"))


@query("jn_semi_entity", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_type), 'st') AND p_size = 7)")
def semi_entity(t):
    hits = t("lineitem").join(t("part").where(F.lower("p_type").contains("st") & (F.col("p_size") == 7)), F.col("l_partkey") == F.col("p_partkey"))
    return t("orders").join(hits, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("id"))


@query("jn_anti_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def anti_resume(t):
    return t("documents").join(t("labels").where("quality = 1"), "doc_id", "left_anti").select("doc_id")


_SPANS = "SELECT l_orderkey AS issue, l_linenumber AS article, min(l_partkey % 40) AS first, min(l_partkey % 40) + min(l_quantity)::BIGINT % 9 AS last FROM lineitem GROUP BY 1, 2"


def spans(lineitem):
    """Page ranges of articles within issues."""
    rows = lineitem.groupBy(F.col("l_orderkey").alias("issue"), F.col("l_linenumber").alias("article"))
    return rows.agg(F.min(F.col("l_partkey") % 40).alias("first"), (F.min(F.col("l_partkey") % 40) + F.min("l_quantity").cast("long") % 9).alias("last"))


@query("jn_range_page", f"SELECT s.issue, p.page::BIGINT AS page, s.article::BIGINT AS article FROM ({_SPANS}) s, (SELECT o_orderkey AS issue, o_custkey % 40 AS page FROM orders) p WHERE s.issue = p.issue AND p.page BETWEEN s.first AND s.last")
def range_page(t):
    """The issue is an equality, so the range is a filter on a hash or merge join."""
    pages = t("orders").select(F.col("o_orderkey").alias("issue"), (F.col("o_custkey") % 40).alias("page"))
    return spans(t("lineitem")).join(pages, "issue").where(F.col("page").between(F.col("first"), F.col("last"))).select("issue", F.col("page").cast("long").alias("page"), F.col("article").cast("long").alias("article"))


@query("jn_asof_map", """WITH m AS (SELECT l_orderkey AS issue, l_linenumber * 3 AS printed, min(l_partkey % 50) AS physical FROM lineitem GROUP BY 1, 2), p AS (SELECT o_orderkey AS issue, (o_custkey % 25)::BIGINT AS page FROM orders)
    SELECT issue, page, coalesce((SELECT arg_max(physical + page - printed, printed) FROM m WHERE m.issue = p.issue AND printed <= page), (SELECT CASE WHEN count(*) > 0 THEN greatest(1, arg_min(physical - (printed - page), printed)) END FROM m WHERE m.issue = p.issue AND printed > page), greatest(1, page + 2))::BIGINT AS physical FROM p""")
def asof_map(t):
    """The nearest mapped page below, else above, carried on; else a fixed offset."""
    m = t("lineitem").groupBy(F.col("l_orderkey").alias("issue"), (F.col("l_linenumber") * 3).alias("printed")).agg(F.min(F.col("l_partkey") % 50).alias("physical"))
    p = t("orders").select(F.col("o_orderkey").alias("issue"), (F.col("o_custkey") % 25).cast("long").alias("page"))
    carried = F.col("physical") + F.col("page") - F.col("printed")
    near = p.join(m, "issue", "left").groupBy("issue", "page").agg(
        F.max_by(F.when(F.col("printed") <= F.col("page"), carried), F.when(F.col("printed") <= F.col("page"), F.col("printed"))).alias("below"),
        F.min_by(F.when(F.col("printed") > F.col("page"), carried), F.when(F.col("printed") > F.col("page"), F.col("printed"))).alias("above"),
    )
    found = F.coalesce("below", F.when(F.col("above").isNotNull(), F.greatest(F.lit(1), F.col("above"))), F.greatest(F.lit(1), F.col("page") + 2))
    return near.select("issue", "page", found.cast("long").alias("physical"))


@query("jn_url_map", """SELECT o_orderkey AS id, coalesce(e.s_name, f.s_name, 'none') AS url, CASE WHEN e.s_name IS NOT NULL THEN 'key' WHEN f.s_name IS NOT NULL THEN 'digits' ELSE 'none' END AS via FROM orders
    LEFT JOIN supplier e ON e.s_suppkey = o_custkey LEFT JOIN (SELECT s_suppkey % 10 AS d, min(s_name) AS s_name FROM supplier WHERE s_suppkey % 10 < 7 GROUP BY 1) f ON f.d = o_custkey % 10""")
def url_map(t):
    s = t("supplier")
    exact = s.select(F.col("s_suppkey").alias("o_custkey"), F.col("s_name").alias("exact"))
    digits = s.where("s_suppkey % 10 < 7").groupBy((F.col("s_suppkey") % 10).alias("d")).agg(F.min("s_name").alias("loose"))
    rows = t("orders").join(exact, "o_custkey", "left").join(digits, F.col("o_custkey") % 10 == F.col("d"), "left")
    via = F.when(F.col("exact").isNotNull(), "key").when(F.col("loose").isNotNull(), "digits").otherwise("none")
    return rows.select(F.col("o_orderkey").alias("id"), F.coalesce("exact", "loose", F.lit("none")).alias("url"), via.alias("via"))


@query("jn_alias", f"SELECT DISTINCT p_name AS name, coalesce(c, p_name) AS canonical FROM part LEFT JOIN (SELECT {key_sql('p_name')} AS k, max(p_brand) AS c FROM part WHERE p_size > 25 GROUP BY 1) ON {key_sql('p_name')} = k")
def alias(t):
    p = t("part").select("p_name", "p_brand", "p_size", X.normalize_key(F.col("p_name")).alias("k"))
    known = p.where("p_size > 25").groupBy("k").agg(F.max("p_brand").alias("c"))
    return p.join(known, "k", "left").select(F.col("p_name").alias("name"), F.coalesce("c", "p_name").alias("canonical")).distinct()


@query("jn_unique_lookup", "SELECT p_name AS name, min(p_brand) AS brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_lookup(t):
    sets = t("part").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("b"))
    return sets.where(F.size("b") == 1).select("name", F.element_at("b", 1).alias("brand"))


@query("jn_best_candidates", """SELECT l_orderkey AS key, l_linenumber::BIGINT AS best, (n - 1) AS alternatives FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_tax, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE k = 1""")
def best_candidates(t):
    """The best source of each key and how many others there are, as one aggregate."""
    groups = t("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min(F.struct("l_discount", "l_tax", "l_linenumber")).alias("m"), (F.count("*") - 1).alias("alternatives"))
    return groups.select("key", F.col("m.l_linenumber").cast("long").alias("best"), "alternatives")


@query("jn_hits_apply", """SELECT o_orderkey AS id, CASE WHEN n IS NOT NULL THEN 0.99 ELSE 0.0 END::DOUBLE AS score, coalesce(pages, '') AS pages FROM orders LEFT JOIN
    (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS pages FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def hits_apply(t):
    hits = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("pages"))
    rows = t("orders").where("o_orderstatus <> 'P'").join(hits, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("pages").isNotNull(), 0.99).otherwise(0.0).alias("score"), F.coalesce("pages", F.lit("")).alias("pages"))

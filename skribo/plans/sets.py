"""Set operations, filters and table maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.plans.base import query
from skribo.plans.texts import key_sql


@query("st_hits_union", "SELECT doc_id, min(place)::BIGINT AS place FROM (SELECT doc_id, 0 AS place FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(text, 'stupid')) GROUP BY 1")
def hits_union(t):
    first = t("labels").where("toxic = 1").select("doc_id", F.lit(0).cast("long").alias("place"))
    second = t("documents").where(F.col("text").contains("stupid")).select("doc_id", F.lit(1).cast("long").alias("place"))
    return first.unionByName(second).groupBy("doc_id").agg(F.min("place").alias("place"))


_TOKENS = "list_distinct(string_split({}, ' '))"


@query("st_diff", "SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')")
def diff(t):
    d, l = t("documents"), t("labels")  # noqa: E741
    missing = d.join(l, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("side"))
    return missing.unionByName(l.join(d.where("lang = 'en'"), "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("side")))


@query("pf_scope", "SELECT doc_id FROM documents WHERE coalesce(source, 'src0') = 'src0' AND lang = 'en' AND n_chars >= 300")
def scope(t):
    return t("documents").where((F.coalesce("source", F.lit("src0")) == "src0") & (F.col("lang") == "en") & (F.col("n_chars") >= 300)).select("doc_id")


@query("pf_select_manifest", "SELECT o_custkey AS key, min(o_orderkey) AS first_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def select_manifest(t):
    done = t("customer").where("c_mktsegment = 'BUILDING'")
    return t("orders").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("first_id"))


@query("pf_pattern_gate", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)/(en|de)/') AND regexp_matches(url, '[0-9]{2}') AND NOT regexp_matches(url, 'utm_|#')")
def pattern_gate(t):
    url = F.col("url")
    return t("pages").where(url.rlike("(?i)/(en|de)/") & url.rlike("[0-9]{2}") & ~url.rlike("utm_|#")).select("page_id")


@query("pf_status", "SELECT doc_id, CASE WHEN text IS NULL THEN 'no_text' WHEN length(text) < 50 THEN 'short' WHEN contains(text, '@') THEN 'personal' ELSE 'ok' END AS problem FROM documents")
def status(t):
    problem = F.when(F.col("text").isNull(), "no_text").when(F.length("text") < 50, "short").when(F.col("text").contains("@"), "personal").otherwise("ok")
    return t("documents").select("doc_id", problem.alias("problem"))


@query("pf_project_public", "SELECT p_partkey AS id, trim(p_name) AS name, trim(p_brand) AS brand FROM part")
def project_public(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.trim("p_name").alias("name"), F.trim("p_brand").alias("brand"))


@query("pf_outer_matter", "SELECT issue, article::BIGINT AS article, (first <= 2 OR first >= 38) AND (last <= 2 OR last >= 38) AND last - first <= 1 AS outer_matter FROM (SELECT l_orderkey AS issue, l_linenumber AS article, min(l_partkey % 40) AS first, min(l_partkey % 40) + min(l_quantity)::BIGINT % 3 AS last FROM lineitem GROUP BY 1, 2)")
def outer_matter(t):
    """Every page of the range is one of the first or last ones."""
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("issue"), F.col("l_linenumber").alias("article")).agg(F.min(F.col("l_partkey") % 40).alias("first"), (F.min(F.col("l_partkey") % 40) + F.min("l_quantity").cast("long") % 3).alias("last"))
    every = F.forall(F.sequence("first", "last"), lambda p: (p <= 2) | (p >= 38)) & (F.col("last") - F.col("first") <= 1)
    return rows.select("issue", F.col("article").cast("long").alias("article"), every.alias("outer_matter"))


@query("dm_upsert_entity", f"SELECT {key_sql('p_brand')} AS key, arg_max(p_brand, p_partkey) AS name, arg_max(p_type, p_partkey) FILTER (WHERE p_size > 25) AS link, count(*) AS n FROM part GROUP BY 1")
def upsert_entity(t):
    """The latest spelling and the latest link that there is."""
    rows = t("part").withColumn("key", X.normalize_key(F.col("p_brand")))
    linked = F.col("p_size") > 25
    return rows.groupBy("key").agg(F.max_by("p_brand", "p_partkey").alias("name"), F.max_by(F.when(linked, F.col("p_type")), F.when(linked, F.col("p_partkey"))).alias("link"), F.count("*").alias("n"))


@query("dm_link", "SELECT l_orderkey AS article, l_suppkey AS entity, l_returnflag AS relation, min(l_linenumber)::BIGINT AS first FROM lineitem GROUP BY 1, 2, 3")
def link(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("relation")).agg(F.min("l_linenumber").cast("long").alias("first"))


@query("dm_tags", "SELECT doc_id, concat_ws(',', lang, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '@') THEN 'mail' END) AS tags FROM documents")
def tags(t):
    """Managed tags go, those of the features found come; the others stay."""
    managed = F.array(F.lit("table"), F.lit("mail"))
    old = F.array("lang", F.lit("table"))
    new = F.array_compact(F.array(F.when(F.col("text").contains("|"), "table"), F.when(F.col("text").contains("@"), "mail")))
    return t("documents").select("doc_id", F.array_join(F.array_union(F.array_except(old, managed), new), ",").alias("tags"))

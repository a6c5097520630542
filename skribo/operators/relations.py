"""The relations of an export: articles with journals, dimensions, bridges, maps and metadata; their keys and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.functions.text import normalize_key
from skribo.operators.numbering import numbered

#: The lists of an article that become dimensions: relation and bridge, by the list's name.
DIMENSIONS = {"authors": ("authors", "article_authors"), "caves": ("caves", "article_caves"), "tags": ("tags", "article_tags"), "groups": ("groups", "article_groups")}
#: Keys, and references to the keys of others, of the twelve relations.
KEYS = {
    "journals": ["id"],
    "articles": ["id"],
    "authors": ["id"],
    "article_authors": ["article_id", "author_id"],
    "caves": ["id"],
    "article_caves": ["article_id", "cave_id"],
    "tags": ["id"],
    "article_tags": ["article_id", "tag_id"],
    "groups": ["id"],
    "article_groups": ["article_id", "group_id"],
    "map_plans": ["article_id"],
    "export_metadata": ["key"],
}
REFERENCES = [("articles", "journal_id", "journals")] + [(b, "article_id", "articles") for _, b in DIMENSIONS.values()] + [(b, f"{d[:-1]}_id", d) for d, b in DIMENSIONS.values()] + [("map_plans", "article_id", "articles")]


def dimension(articles: DataFrame, key: str, values: Column, name: str, fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """id, name, normalized_name of every distinct value, numbered in the order in which they are first seen (by key, then place), the first spelling kept; and the bridge
    article_id, <name>_id, position (from 0, of the first of a value).

    Blank values are none; an article without any has the fallback, if it is given. Equal folded names are one value.
    """
    some = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v) != "")
    if fallback:
        some = F.when(F.size(some) == 0, F.array(F.lit(fallback))).otherwise(some)
    rows = articles.select(F.col(key).alias("article_id"), F.posexplode(some).alias("position", "value")).select("article_id", F.col("position").cast("long").alias("position"), F.trim("value").alias("value"), normalize_key(F.col("value")).alias("normalized_name"))
    first = rows.groupBy("normalized_name").agg(F.min(F.struct("article_id", "position", "value")).alias("m"))
    known = numbered(first.select("normalized_name", F.col("m.article_id").alias("a"), F.col("m.position").alias("p"), F.col("m.value").alias("name")), ["a", "p", "normalized_name"], "id").select("id", "name", "normalized_name")
    bridge = rows.join(known.select("id", "normalized_name"), "normalized_name").groupBy("article_id", F.col("id").alias(f"{name}_id")).agg(F.min("position").alias("position"))
    return known, bridge


def exported(articles: DataFrame, journal: str, default: tuple[str, str], offset: int = 2) -> dict[str, DataFrame]:
    """The twelve relations. articles: id, journal_id, title, year, volume, issue, pages, abstract, pdf_url, has_map_plan, authors, caves, tags, groups.

    default: the journal of articles without one, and who wrote what nobody signed. A page is the first of pages and the offset, and links have it.
    """
    rows = articles.withColumn("journal_id", F.coalesce(F.nullif(F.trim(journal), F.lit("")), F.lit(default[0])))
    out: dict[str, DataFrame] = {}
    out["journals"] = rows.groupBy(F.col("journal_id").alias("id")).agg(F.min("id").alias("_first")).select("id", F.col("id").alias("title"), F.col("id").alias("short_title"), F.lit(offset).alias("pdf_page_offset"))
    page = F.regexp_extract("pages", r"^\s*(\d+)", 1).try_cast("long") + offset
    link = F.when((F.col("pdf_url") != "") & page.isNotNull(), F.concat_ws("#page=", "pdf_url", page.cast("string")))
    strings = [F.col(c) for c in ("title", "year", "volume", "issue", "pages", "abstract", "pdf_url")]
    out["articles"] = rows.select("id", "journal_id", *strings, page.alias("pdf_page"), F.coalesce(link, F.nullif("pdf_url", F.lit("")), F.lit("")).alias("pdf_link"), F.col("has_map_plan").cast("int").alias("has_map_plan"))
    for values, (name, bridge) in DIMENSIONS.items():
        out[name], out[bridge] = dimension(rows, "id", F.col(values), name[:-1], default[1] if values == "authors" else None)
    out["map_plans"] = rows.where("has_map_plan").select(F.col("id").alias("article_id"), F.array(page).alias("pages"))
    return out


def with_metadata(relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """relations with export_metadata: the number of rows of each of them."""
    counts = [r.agg(F.lit(f"{n}_count").alias("key"), F.count("*").cast("string").alias("value")) for n, r in relations.items()]
    return relations | {"export_metadata": reduce(DataFrame.unionByName, counts)}


def checked(relations: dict[str, DataFrame]) -> DataFrame:
    """rule, n, bad: for each key its rows and those that repeat one, for each reference its rows and those that point nowhere."""
    parts = []
    for name, key in KEYS.items():
        if name in relations:
            groups = relations[name].groupBy(*key).agg(F.count("*").alias("k"))
            parts.append(groups.agg(F.lit(f"key {name}").alias("rule"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("bad")))
    for name, column, other in REFERENCES:
        if name in relations and other in relations:
            target = relations[other].select(F.col(KEYS[other][0]).alias("_key"))
            joined = relations[name].select(F.col(column).alias("_c")).join(target, F.col("_c") == F.col("_key"), "left")
            parts.append(joined.agg(F.lit(f"{name}.{column} -> {other}").alias("rule"), F.count("_c").alias("n"), F.count_if(F.col("_c").isNotNull() & F.col("_key").isNull()).alias("bad")))
    return reduce(DataFrame.unionByName, parts)


def registered(relations: dict[str, DataFrame], prefix: str = "") -> None:
    """Makes the relations and the view entity_timeline of them known to SQL."""
    for name, rows in relations.items():
        rows.createOrReplaceTempView(prefix + name)
    spark = relations["articles"].sparkSession
    parts = [f"SELECT '{d}' AS type, e.name, a.id AS article_id, a.year, a.title FROM {prefix}{d} e JOIN {prefix}{b} l ON l.{d[:-1]}_id = e.id JOIN {prefix}articles a ON a.id = l.article_id" for d, b in DIMENSIONS.values()]
    spark.sql(" UNION ALL ".join(parts)).createOrReplaceTempView(f"{prefix}entity_timeline")

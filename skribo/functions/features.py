"""Which features an article has: maps, photographs, tables, bibliographies, measurements, coordinates, sections.

Evidence of a page is a sum of signs for maps and the highest sign for the others; guards hold a map's score down. An article's score
is the highest of its pages and of what describes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.functions.text import fold_text

#: The score from which a feature is present, and from which a map is a candidate; from HIGH on it is sure.
THRESHOLDS = {"map_plan": 0.85, "photo": 0.55, "table": 0.55, "bibliography": 0.55, "measurement_data": 0.50, "coordinates": 0.50, "cross_section": 0.55}
CANDIDATE, HIGH = 0.38, 0.85
#: Patterns of the signs in folded text.
SIGNS = {
    "scale": r"(?:(?:mierka|m)\s*[:.]?\s*)?1\s*[:/]\s*\d{2,5}\b",
    "plan_word": r"\b(?:mapa|mapy|mapovy|plan|podorys|nacrt|situacia|topografia|topograficky)\b",
    "specific_plan": r"\b(?:plan|podorys|mapa)\s+(?:jaskyn|priepast|chodieb|systemu|lokality)|\bjaskynny\s+plan|\bmapovy\s+nacrt",
    "survey": r"\b(?:meral|merali|zameral|zamerali|zameranie|mapoval|mapovali|kreslil|kreslili|kresba|zostavil|digitalizoval)\b",
    "geometry": r"\b(?:polygon|polygonovy|polygonom|meracsky\s+bod|azimut|stanovisko|traverz|legenda)\b",
    "dimensions": r"\b(?:dlzka|hlbka|prevysenie|nadmorska\s+vyska|rozmery|denivelacia)\b",
    "section": r"\b(?:rez|profil|priecny\s+rez|pozdlzny\s+rez)\b",
    "cave": r"\b(?:jaskyn|priepast|chodba|sifon|komin|dolina|kras)\b",
    "drawing": r"\b(?:mapa|mapy|mapovy|podorys|nacrt|situacia|topografia)\b",
    "plan_of_work": r"\bplan\s+(?:prace|cinnosti|akcii|akcie|zasadnutia|vystavby|rozvoja|podujati|vyletu)\b",
    "photo": r"\b(?:obr\.|obrazok|obrazky|foto|fotograf|snimka|snimky)\b",
    "table_word": r"\b(?:tab\.|tabulka|tabulky|tabulkou)\b",
    "bibliography": r"\b(?:lit\.|literatura|pouzita\s+literatura|zoznam\s+literatury|bibliografia)\b",
    "heights": r"\b(?:m\s*n\.\s*m\.|m\.n\.m\.|nadmorska\s+vyska|azimut|sklon)\b",
    "coordinates": r"\b(?:gps|wgs|jtsk|s-jtsk|suradnic)\b|\b[xy]\s*[:=]\s*-?\d{5,7}(?:[,.]\d+)?|\b\d{1,2}\s*[°º]\s*\d{1,2}\s*['’´]\s*\d{1,2}(?:[,.]\d+)?|\b[NS]\s*\d{1,2}(?:[,.]\d+)?\s+[EW]\s*\d{1,3}(?:[,.]\d+)?",
}
#: Patterns in the folded extras, and in extras, title and abstract together.
OF_EXTRAS = {
    "plates": r"\b\d*\s*pl\.\s*j\.",
    "maps": r"\b\d*\s*(?:mapa|mapy|mapiek)\b|\b\d*\s*pl[aá]n(?:ov|y)?\b|\bpodorys\b",
    "pictures": r"\b\d*\s*obr\.|\bfoto|\bfotograf|\bsnimk|\bobraz",
    "told_tables": r"\btab\.|\btabulka|\btabulky",
    "cited": r"\blit\.|\bliteratura|\bbibliograf",
}
OF_WORDS = {"map_word": r"\bmapa\b|\bmapy\b|\bplan\s+jaskyn|\bplan\s+priepast|\bpodorys\b", "section": r"\bprofil\b|\brez\b", "map_context": r"\bmierka\b|\bplan\b|\bpodorys\b|\bmapa\b"}
#: What each sign adds to a map's score on a page, as conditions over the signs; the scores of other features; the scores of what describes an article.
MAP_SIGNS = (
    (0.55, "specific_plan"),
    (0.42, "scale"),
    (0.26, "plan_word and not plan_of_work and not specific_plan"),
    (0.18, "survey"),
    (0.18, "geometry"),
    (0.10, "dimensions and (plan_word or scale or geometry or survey)"),
    (0.18, "section and (cave or scale)"),
)
MAP_GUARDS = (
    (0.25, "plan_of_work and not (scale or specific_plan or geometry or survey)"),
    (0.62, "not (scale and (specific_plan or geometry or survey or section or drawing)) and not (specific_plan and (survey or geometry or section))"),
    (0.68, "scale and drawing and not (specific_plan or survey or section or geometry)"),
)
PAGE_SIGNS = {
    "photo": ((0.66, "photo"),),
    "table": ((0.70, "table_word"), (0.62, "rows")),
    "bibliography": ((0.72, "bibliography"),),
    "measurement_data": ((0.58, "dimensions"), (0.62, "heights"), (0.62, "coordinates")),
    "coordinates": ((0.72, "coordinates"),),
    "cross_section": ((0.68, "section and (cave or scale)"),),
}
DESCRIBED = {
    "map_plan": ((0.98, "plates"), (0.92, "maps"), (0.52, "map_word and not plan_of_work"), (0.50, "section and map_context")),
    "photo": ((0.85, "pictures"),),
    "table": ((0.82, "told_tables"),),
    "bibliography": ((0.80, "cited"),),
    "cross_section": ((0.60, "section"),),
}
#: Cells of a table's row, those of them with digits, and rows of a table.
CELLS, NUMBERS, ROWS = 3, 2, 3


def has_table_rows(text: Column) -> Column:
    """Whether enough lines have cells, set apart by wide gaps or tabs, that hold numbers."""
    lines = F.transform(F.split(text, "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85  ]"), lambda x: F.filter(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s{2,}|\t+"), lambda c: c != ""))
    rows = F.filter(lines, lambda cells: (F.size(cells) >= CELLS) & (F.size(F.filter(cells, lambda c: c.rlike(r"\d"))) >= NUMBERS))
    return F.size(rows) >= ROWS


def _highest(rules: tuple) -> Column:
    """Of the weights whose condition over sign columns holds, the highest."""
    found = [F.when(F.expr(rule), weight).otherwise(0.0) for weight, rule in rules]
    return F.greatest(*found) if len(found) > 1 else found[0]


def page_scores(pages: DataFrame, text: str) -> DataFrame:
    """pages with a column for the score of each feature. An empty page has none."""
    rows = pages.withColumn("_whole", F.coalesce(F.col(text), F.lit(""))).withColumn("_folded", fold_text(F.col("_whole")))
    rows = rows.select(*pages.columns, F.struct(*[F.col("_folded").rlike(p).alias(n) for n, p in SIGNS.items()], has_table_rows(F.col("_whole")).alias("rows")).alias("_signs")).select(*pages.columns, "_signs.*")
    total = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(F.expr(rule), weight).otherwise(0.0) for weight, rule in MAP_SIGNS]))
    for most, rule in MAP_GUARDS:
        total = F.when(F.expr(rule), F.least(total, F.lit(most))).otherwise(total)
    return rows.select(*pages.columns, total.alias("map_plan_score"), *[_highest(rules).alias(f"{name}_score") for name, rules in PAGE_SIGNS.items()])


def described_scores(articles: DataFrame, key: str, title: str, abstract: str, extras: str) -> DataFrame:
    """key and the score of each feature by an article's title, abstract and extras (an array)."""
    listed = F.array_join(F.coalesce(F.col(extras), F.array().cast("array<string>")), " ")
    title, abstract = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(abstract), F.lit(""))
    rows = articles.select(key, fold_text(listed).alias("_extras"), fold_text(title).alias("_title"), fold_text(F.concat_ws(" ", listed, title, abstract)).alias("_all"))
    signs = [F.col("_extras").rlike(p).alias(n) for n, p in OF_EXTRAS.items()] + [F.col("_all").rlike(p).alias(n) for n, p in OF_WORDS.items()] + [F.col("_title").rlike(SIGNS["plan_of_work"]).alias("plan_of_work")]
    return rows.select(key, *signs).select(key, *[(_highest(DESCRIBED[name]) if name in DESCRIBED else F.lit(0.0)).alias(f"{name}_score") for name in THRESHOLDS])


def detected(articles: DataFrame, key: str, title: str, abstract: str, extras: str, text: str) -> DataFrame:
    """key, feature, score, present, confidence, pages: a row for each article and feature.

    Pages are parted by form feeds and numbered from 1; a map's pages are those whose own score makes it present, of others those with any
    sign. Null texts have no pages.
    """
    scores = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_score").alias("score")) for n in THRESHOLDS])).alias("f")
    of_article = described_scores(articles, key, title, abstract, extras).select(key, F.lit(None).cast("long").alias("page"), scores)
    parts = articles.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f")).alias("at", "part")).where(~F.col("part").rlike(r"\A\s*\z"))
    of_pages = page_scores(parts.select(key, (F.col("at") + 1).cast("long").alias("page"), "part"), "part").select(key, "page", scores)
    rows = of_article.unionByName(of_pages).select(key, "page", "f.feature", "f.score")
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair]), F.col("feature"))
    score, is_map = F.col("score"), F.col("feature") == "map_plan"
    shown = F.when(is_map, score >= THRESHOLDS["map_plan"]).otherwise(score > 0)
    best = rows.groupBy(key, "feature").agg(F.round(F.max("score"), 3).alias("score"), F.array_sort(F.collect_set(F.when(shown, F.col("page")))).alias("pages"))
    sure = F.when(score >= HIGH, "high").when(score >= limit, "medium").when(is_map & (score >= CANDIDATE), "candidate").when(score > 0, "low").otherwise("none")
    return best.select(key, "feature", "score", (score >= limit).alias("present"), sure.alias("confidence"), "pages")

"""The relational store: article rows, dimensions with bridges, media, keys and references, timelines, registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.functions import articles as A
from skribo.functions import text as X
from skribo.operators import relations as R
from skribo.plans.articles import _WHO, ARTICLES, JOURNAL, JSONLD, _entities_sql, articles, entity_rows, joined_sql, jsonld_of, unique_sql, visual_sql, _VISUAL
from skribo.plans.base import query
from skribo.plans.texts import key_sql
from skribo.sources import files

NOBODY = A.NOBODY


def export_of(t):
    return R.exported(articles(t), "journal_id", (JOURNAL, NOBODY))


def _dimension_sql(values: str) -> tuple[str, str]:
    """The rows of a dimension's values, and the dimension."""
    some = f"list_filter({values}, lambda v: trim(v) <> '')"
    if values == "authors":
        some = f"CASE WHEN len({some}) = 0 THEN ['{NOBODY}'] ELSE {some} END"
    rows = f"SELECT id AS article_id, k - 1 AS position, trim(v[k]) AS value, {key_sql('v[k]')} AS nn FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS k FROM (SELECT id, {some} AS v FROM a))"
    known = f"SELECT row_number() OVER (ORDER BY m.a, m.p, nn) AS id, m.v AS name, nn FROM (SELECT nn, min({{'a': article_id, 'p': position, 'v': value}}) AS m FROM ({rows}) GROUP BY 1)"
    return rows, known


@query(
    "dm_lookup",
    f"WITH a AS ({ARTICLES}) " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, r.article_id, d.id, any_value(d.name) AS name, min(position) AS position FROM ({_dimension_sql(n)[0]}) r JOIN ({_dimension_sql(n)[1]}) d ON r.nn = d.nn GROUP BY 1, 2, 3" for n in R.DIMENSIONS),
)
def lookup(t):
    """Four dimensions with surrogate ids in the order in which names are first seen, and their bridges."""
    out, made = None, export_of(t)
    for values, (name, bridge) in R.DIMENSIONS.items():
        rows = made[bridge].join(made[name].select("id", "name"), F.col(f"{name[:-1]}_id") == F.col("id")).select(F.lit(values).alias("dimension"), "article_id", "id", "name", "position")
        out = rows if out is None else out.unionByName(rows)
    return out


def _counts_sql() -> dict[str, str]:
    counts = {"journals": "SELECT count(DISTINCT coalesce(nullif(trim(journal_id), ''), 'src0')) FROM a", "articles": "SELECT count(*) FROM a", "map_plans": "SELECT count(*) FROM a WHERE has_map_plan"}
    for values, (name, bridge) in R.DIMENSIONS.items():
        rows, _ = _dimension_sql(values)
        counts[name] = f"SELECT count(DISTINCT nn) FROM ({rows})"
        counts[bridge] = f"SELECT count(DISTINCT (article_id, nn)) FROM ({rows})"
    return counts | {"export_metadata": "SELECT 11"}


@query("io_sqlite", f"WITH a AS ({ARTICLES}) " + " UNION ALL ".join(f"SELECT '{n}' AS relation, ({s})::BIGINT AS n" for n, s in _counts_sql().items()))
def export(t):
    """All twelve relations written, a table each, and counted from there."""
    made = R.with_metadata(export_of(t))
    spark = t("documents").sparkSession
    path = files.scratch(spark)
    files.write_relations(made, path)
    out = None
    for name in made:
        row = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def _rules_sql() -> str:
    c = _counts_sql()
    rules = [f"SELECT 'key {n}' AS rule, ({c[n]})::BIGINT AS n, 0::BIGINT AS bad" for n in R.KEYS if n != "export_metadata"]
    rules += [f"SELECT '{n}.{column} -> {other}', ({c[n]})::BIGINT, 0::BIGINT" for n, column, other in R.REFERENCES]
    return f"WITH a AS ({ARTICLES}) " + " UNION ALL ".join(rules)


@query("dm_schema", _rules_sql())
def schema(t):
    """Keys are unique and references point somewhere, in all relations of the export."""
    return R.checked(export_of(t))


_PAGE = "try_cast(nullif(regexp_extract(pages, '^\\s*(\\d+)', 1), '') AS BIGINT)"
_LAST = f"greatest({_PAGE}, coalesce(try_cast(nullif(regexp_extract(pages, '^\\s*\\d+\\s*-\\s*(\\d+)', 1), '') AS BIGINT), {_PAGE}))"


@query(
    "dm_media",
    f"WITH a AS ({ARTICLES}) SELECT id AS article_id, sha256(id || '|pdf_page_range|' || pdf_url || '|' || coalesce(({_PAGE} + 2)::VARCHAR, '') || '|' || coalesce(({_LAST} + 2)::VARCHAR, '')) AS asset_id, 'pdf_page_range' AS kind, pdf_url || CASE WHEN {_PAGE} IS NULL THEN '' ELSE '#page=' || ({_PAGE} + 2) END AS url, {_PAGE} + 2 AS page_start, {_LAST} + 2 AS page_end, has_map_plan AS visual FROM a WHERE pdf_url <> ''",
)
def media(t):
    """One asset for each article with a file: the range of its pages there, under an id of what it is."""
    first, last = X.page_bounds(F.col("pages"))
    return media_assets(articles(t), first + 2, last + 2)


def media_assets(rows, first, last):
    """article_id, asset_id, kind, url, page_start, page_end, visual of articles with id, pdf_url and has_map_plan; first and last: columns, null if unknown."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    asset = F.sha2(F.concat_ws("|", text(F.col("id")), F.lit("pdf_page_range"), "pdf_url", text(first), text(last)), 256)
    url = F.when(first.isNull(), F.col("pdf_url")).otherwise(F.concat_ws("#page=", "pdf_url", text(first)))
    return rows.where("pdf_url <> ''").select(F.col("id").alias("article_id"), asset.alias("asset_id"), F.lit("pdf_page_range").alias("kind"), url.alias("url"), first.alias("page_start"), last.alias("page_end"), F.col("has_map_plan").alias("visual"))


def _row_sql() -> dict[str, str]:
    """The columns of an article's row in DuckDB."""
    listed = lambda *names: f"to_json({unique_sql('(' + ' || '.join(names) + ')')})::VARCHAR"
    visual = visual_sql("h")
    return {
        "id": "id",
        "journal_id": f"coalesce(journal_id, '{JOURNAL}')",
        "journal_title": f"coalesce(journal_id, '{JOURNAL}')",
        "journal_short_title": f"coalesce(journal_id, '{JOURNAL}')",
        "title": "title",
        "authors_json": "to_json(authors)::VARCHAR",
        "authors_text": _WHO,
        "year": "year",
        "volume": "volume",
        "issue": "issue",
        "pages": "pages",
        "page_start": _PAGE,
        "page_end": _LAST,
        "pdf_page_start": f"{_PAGE} + 2",
        "pdf_page_end": f"{_LAST} + 2",
        "pdf_page_offset": "0",
        "pdf_url": "pdf_url",
        "pdf_cache": "CASE WHEN pdf_url <> '' THEN left(sha1(pdf_url), 10) ELSE '' END",
        "abstract": "CASE WHEN summary <> '' THEN summary ELSE abstract END",
        "summary": "summary",
        "bibliographic_note": "''",
        "text_chars": "length(text)",
        "word_count": "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))",
        "fulltext_status": "CASE WHEN id % 4 = 0 THEN 'ok+title_trimmed' ELSE 'ok' END",
        "text_trim_json": "'{\"trimmed\":' || (id % 4 = 0) || '}'",
        "has_visual_material": f"CASE WHEN len({visual}) > 0 OR has_map_plan OR contains(lower({joined_sql('extras', ' ')}), 'map') THEN 1 ELSE 0 END",
        "visual_terms_json": f"to_json({visual})::VARCHAR",
        "caves_json": listed("caves", "locations"),
        "tags_json": listed("tags", "keywords"),
        "groups_json": listed("groups"),
        "wikidata_json": "'[]'",
        "keywords_json": listed("keywords"),
        "locations_json": listed("locations"),
        "people_json": listed("people"),
        "themes_json": listed("keywords", "tags"),
        "citation_iso690": "replace(concat_ws(', ', who || '. ' || trim(title) || '.', journal || ', ' || year, CASE WHEN volume <> '' THEN 'roc. ' || volume END, 'c. ' || issue, CASE WHEN p <> '' THEN 's. ' || p END, CASE WHEN pdf_url <> '' THEN 'Online: ' || pdf_url END), '.,', '.')",
        "citation_apa": "who || '. (' || year || '). ' || trim(title) || '. ' || journal || ', ' || issue || CASE WHEN p <> '' THEN ', ' || p ELSE '' END || '.'",
        "citation_mla": "concat_ws(', ', who || '. \"' || trim(title) || '.\"', journal, 'no. ' || issue, year::VARCHAR, CASE WHEN p <> '' THEN 'pp. ' || p END) || '.'",
        "jsonld_json": JSONLD,
        "fulltext_extracted_at": "'2026-01-01T00:00:00+00:00'",
        "knowledge_generated_at": "CASE WHEN summary <> '' THEN '2026-01-02T00:00:00+00:00' END",
        "updated_at": "'2026-01-03T00:00:00+00:00'",
    }


@query("dm_article_row", f"WITH a AS ({ARTICLES}), b AS (SELECT *, {_WHO} AS who, coalesce(journal_id, '{JOURNAL}') AS journal, replace(trim(pages), '-', ' - ') AS p, {_VISUAL} AS h FROM a) SELECT {', '.join(f'{c} AS {n}' for n, c in _row_sql().items())} FROM b")
def article_row(t):
    """All 42 columns of the store's article relation, derived from the article, its text and what is known of it."""
    rows, c = articles(t), F.col
    first, last = X.page_bounds(c("pages"))
    journal = F.coalesce("journal_id", F.lit(JOURNAL))
    cited = A.citations(c("authors"), c("title"), journal, c("year"), c("volume"), c("issue"), c("pages"), c("pdf_url"))
    listed = lambda *names: F.to_json(X.unique(F.concat(*[c(n) for n in names])))
    visual = A.visual_terms(c("title"), c("abstract"), c("extras"), c("summary"), c("text"))
    rows = rows.withColumn("visual", visual)
    cut = c("id") % 4 == 0
    seen = (F.size("visual") > 0) | c("has_map_plan") | F.lower(F.array_join("extras", " ")).contains("map")
    made = {
        "id": c("id"),
        "journal_id": journal,
        "journal_title": journal,
        "journal_short_title": journal,
        "title": c("title"),
        "authors_json": F.to_json("authors"),
        "authors_text": A.authors_label(c("authors")),
        "year": c("year"),
        "volume": c("volume"),
        "issue": c("issue"),
        "pages": c("pages"),
        "page_start": first,
        "page_end": last,
        "pdf_page_start": first + 2,
        "pdf_page_end": last + 2,
        "pdf_page_offset": F.lit(0),
        "pdf_url": c("pdf_url"),
        "pdf_cache": F.when(c("pdf_url") != "", F.substring(F.sha1("pdf_url"), 1, 10)).otherwise(""),
        "abstract": F.when(c("summary") != "", c("summary")).otherwise(c("abstract")),
        "summary": c("summary"),
        "bibliographic_note": F.lit(""),
        "text_chars": F.length("text"),
        "word_count": F.size(X.runs(c("text"), underscore=True)),
        "fulltext_status": F.when(cut, "ok+title_trimmed").otherwise("ok"),
        "text_trim_json": F.to_json(F.struct(cut.alias("trimmed"))),
        "has_visual_material": seen.cast("int"),
        "visual_terms_json": F.to_json("visual"),
        "caves_json": listed("caves", "locations"),
        "tags_json": listed("tags", "keywords"),
        "groups_json": listed("groups"),
        "wikidata_json": F.lit("[]"),
        "keywords_json": listed("keywords"),
        "locations_json": listed("locations"),
        "people_json": listed("people"),
        "themes_json": listed("keywords", "tags"),
        "citation_iso690": cited["iso690"],
        "citation_apa": cited["apa"],
        "citation_mla": cited["mla"],
        "jsonld_json": jsonld_of(),
        "fulltext_extracted_at": F.lit("2026-01-01T00:00:00+00:00"),
        "knowledge_generated_at": F.when(c("summary") != "", "2026-01-02T00:00:00+00:00"),
        "updated_at": F.lit("2026-01-03T00:00:00+00:00"),
    }
    return rows.select(*[x.alias(n) for n, x in made.items()])


@query(
    "dm_changes",
    f"""WITH a AS ({ARTICLES}), n AS (SELECT *, CASE WHEN volume = '' THEN 'vol ' || year ELSE volume END AS nv, trim(title) AS nt, CASE WHEN pages = '' THEN 's. n.' ELSE pages END AS np FROM a)
    SELECT id, 'volume' AS field, volume AS old, nv AS new, 'year' AS source, 'missing volume' AS reason FROM n WHERE nv <> volume UNION ALL SELECT id, 'title', title, nt, 'title', 'blanks at its ends' FROM n WHERE nt <> title UNION ALL SELECT id, 'pages', pages, np, 'rule', 'missing pages' FROM n WHERE np <> pages""",
)
def changes(t):
    """Every field that a repair changes, with what says so and why."""
    new = {
        "volume": (F.when(F.col("volume") == "", F.concat(F.lit("vol "), F.col("year").cast("string"))).otherwise(F.col("volume")), "year", "missing volume"),
        "title": (F.trim("title"), "title", "blanks at its ends"),
        "pages": (F.when(F.col("pages") == "", "s. n.").otherwise(F.col("pages")), "rule", "missing pages"),
    }
    return change_log(articles(t), "id", new)


def change_log(rows, key: str, new: dict):
    """key, field, old, new, source, reason: a row for each field whose new value (a column, with its source and reason) differs; nulls are equal."""
    one = [F.when(~F.col(f).eqNullSafe(c), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), c.cast("string").alias("new"), F.lit(source).alias("source"), F.lit(reason).alias("reason"))) for f, (c, source, reason) in new.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*one))).alias("c")).select(key, "c.*")


_TIMELINES = "SELECT DISTINCT e.type, {key} AS k, e.id, a.year FROM (" + _entities_sql() + ") e JOIN a ON a.id = e.id WHERE e.type IN ('cave', 'group', 'location', 'person')"


@query(
    "ag_timeline",
    f"""WITH a AS ({ARTICLES}), r AS ({_TIMELINES.format(key=key_sql('e.name'))}), g AS (SELECT type, k, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2 OR type IN ('cave', 'group'))
    SELECT r.type, r.k AS name, n, r.year, r.id AS article, CASE WHEN summary <> '' THEN summary ELSE abstract END AS summary FROM r JOIN g ON r.type = g.type AND r.k = g.k JOIN a ON a.id = r.id""",
)
def timeline(t):
    """Entities with their articles, a row each, in all caves and groups and in places and persons of two articles or more."""
    rows = articles(t)
    kept = entity_rows(rows).where(F.col("type").isin("cave", "group", "location", "person")).select("type", X.normalize_key(F.col("name")).alias("name"), "id").distinct()
    groups = kept.groupBy("type", "name").agg(F.count("*").alias("n")).where((F.col("n") >= 2) | F.col("type").isin("cave", "group"))
    told = rows.select("id", "year", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("abstract")).alias("summary"))
    return kept.join(groups, ["type", "name"]).join(told, "id").select("type", "name", "n", "year", F.col("id").alias("article"), "summary")


_CLEANED = "trim(regexp_replace(regexp_replace({}, '[\\p{{So}}\\p{{Sk}}\\x{{FE0F}}]', '', 'g'), '\\s+', ' ', 'g'), ' ,;')"
REGISTERS = {"names": ("authors", "people"), "localities": ("locations",), "subjects": ("tags", "keywords"), "caves": ("caves",)}


@query(
    "ag_registers",
    f"WITH a AS ({ARTICLES}), r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS register, id, unnest(list_distinct(list_transform({' || '.join(of)}, lambda x: {_CLEANED.format('x')}))) AS term FROM a" for n, of in REGISTERS.items())
    + "), s AS (SELECT DISTINCT register, term, id FROM r WHERE term <> ''), g AS (SELECT register, term, count(*) AS n FROM s GROUP BY 1, 2) SELECT s.register, s.term, n, s.id AS article FROM s JOIN g ON s.register = g.register AND s.term = g.term",
)
def registers(t):
    """Four registers of terms with their articles, a row each."""
    terms = {n: F.concat(*[F.col(c) for c in of]) for n, of in REGISTERS.items()}
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("register"), c.alias("terms")) for n, c in terms.items()])).alias("r")
    cleaned = F.btrim(F.regexp_replace(F.regexp_replace("term", r"[\p{So}\p{Sk}\x{FE0F}]", ""), r"\s+", " "), F.lit(" ,;"))
    rows = articles(t).select("id", one).select("id", "r.register", F.explode("r.terms").alias("term")).select("register", cleaned.alias("term"), F.col("id").alias("article")).where("term <> ''").distinct()
    return rows.join(rows.groupBy("register", "term").agg(F.count("*").alias("n")), ["register", "term"]).select("register", "term", "n", "article")


_CARDS = "SELECT id, year, authors, has_map_plan, journal_id, unnest(caves) AS name FROM a"


@query(
    "ag_cave_index",
    f"""WITH a AS ({ARTICLES}), c AS (SELECT {key_sql('name')} AS card, * FROM ({_CARDS})), k AS (SELECT * FROM c WHERE card <> ''), w AS (SELECT card, count(DISTINCT {key_sql('x')}) AS authors FROM (SELECT card, unnest(authors) AS x FROM k) WHERE {key_sql('x')} NOT IN ('anonymus', 'redakcia', '') GROUP BY 1),
    m AS (SELECT card, arg_min(journal_id, (-n, journal_id)) AS area FROM (SELECT card, journal_id, count(DISTINCT id) AS n FROM k WHERE journal_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT card, string_agg(name, ';' ORDER BY name) AS aliases FROM (SELECT DISTINCT card, trim(name) AS name FROM k) GROUP BY 1)
    SELECT k.card, count(DISTINCT id) AS articles, count(DISTINCT id) FILTER (WHERE has_map_plan) AS maps, min(year) AS first_year, max(year) AS last_year, coalesce(any_value(w.authors), 0) AS authors, any_value(area) AS area, any_value(aliases) AS aliases FROM k LEFT JOIN w ON k.card = w.card LEFT JOIN m ON k.card = m.card JOIN l ON k.card = l.card GROUP BY 1""",
)
def cave_index(t):
    """A card for each cave: its articles, maps, years, authors, most common area and sorted spellings."""
    rows = articles(t).select("id", "year", "authors", "has_map_plan", "journal_id", F.explode("caves").alias("name")).withColumn("card", X.normalize_key(F.col("name"))).where("card <> ''")
    author = X.normalize_key(F.col("x"))
    who = rows.select("card", F.explode("authors").alias("x")).select("card", author.alias("x")).where(~F.col("x").isin("anonymus", "redakcia", "")).groupBy("card").agg(F.countDistinct("x").alias("authors"))
    area = rows.where("journal_id IS NOT NULL").groupBy("card", "journal_id").agg((-F.countDistinct("id")).alias("n")).groupBy("card").agg(F.min(F.struct("n", "journal_id")).alias("m")).select("card", F.col("m.journal_id").alias("area"))
    names = rows.groupBy("card").agg(F.array_join(F.array_sort(F.collect_set(F.trim("name"))), ";").alias("aliases"))
    cards = rows.groupBy("card").agg(F.countDistinct("id").alias("articles"), F.countDistinct(F.when(F.col("has_map_plan"), F.col("id"))).alias("maps"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return cards.join(who, "card", "left").join(area, "card", "left").join(names, "card").withColumn("authors", F.coalesce("authors", F.lit(0)))

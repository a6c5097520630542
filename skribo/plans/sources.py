"""Sources and sinks on pages, articles and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.operators import chunks
from skribo.operators import harvest as H
from skribo.plans.articles import ARTICLES, JOURNAL, articles, joined_sql
from skribo.plans.base import query
from skribo.plans.texts import _CHUNKS
from skribo.sources import files

_A = '<a href="([^"]*)">([^<]*)</a>'
_UNESCAPED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_HOST = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
LINKS = f"""SELECT page_id, url, k - 1 AS place, CASE WHEN h[k] LIKE '/%' THEN {_HOST} || h[k] ELSE h[k] END AS href, trim(regexp_replace({_UNESCAPED.format('x[k]')}, '\\s+', ' ', 'g')) AS text
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (SELECT page_id, url, regexp_extract_all(html, '{_A}', 1) AS h, regexp_extract_all(html, '{_A}', 2) AS x FROM pages))"""


@query("io_html_links", f"SELECT page_id, place, href, text FROM ({LINKS})")
def html_links(t):
    """Anchors with their resolved addresses and texts."""
    return H.links(t("pages"), "page_id", "url", "html")


_NEXT = "SELECT p.url, q.url AS href, 'issue ' || q.page_id AS text FROM pages p JOIN pages q ON q.page_id = p.page_id + 1 WHERE p.page_id % 3 > 0 UNION ALL SELECT url, url || '/gone', 'issue gone' FROM pages WHERE page_id % 10 = 0"
_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_OK = "regexp_matches(href || ' ' || text, '(?i)issue|/the') AND NOT regexp_matches(href || ' ' || text, '(?i)#top')"


@query(
    "io_discover",
    f"""WITH s AS (SELECT page_id AS source_id, CASE WHEN page_id % 20 = 7 THEN url || '/lost' ELSE url END AS url, CASE WHEN page_id % 2 = 0 THEN 'direct' ELSE 'detail' END AS mode FROM pages), l AS (SELECT url, href, text FROM ({LINKS}) UNION ALL {_NEXT}),
    p AS (SELECT url, {_BARE} AS t FROM pages), f AS (SELECT source_id, mode, href, text FROM s JOIN l ON s.url = l.url WHERE {_OK}), d AS (SELECT DISTINCT source_id, mode, href AS detail_url FROM f WHERE mode = 'detail')
    SELECT source_id, mode, NULL AS href, NULL AS text, NULL::BIGINT AS context, NULL AS detail_url, 'no page ' || url AS error FROM s WHERE url NOT IN (SELECT url FROM pages) UNION ALL SELECT source_id, mode, href, text, 0, '', NULL FROM f WHERE mode = 'direct'
    UNION ALL SELECT source_id, mode, NULL, NULL, NULL, detail_url, 'no page ' || detail_url FROM d WHERE detail_url NOT IN (SELECT url FROM pages)
    UNION ALL SELECT source_id, mode, l.href, l.text, length(left(p.t, 8000)), detail_url, NULL FROM d JOIN p ON p.url = detail_url JOIN l ON l.url = detail_url WHERE {_OK.replace('href', 'l.href').replace('text', 'l.text')}""",
)
def discover(t):
    """Every page a source, every other one by its detail pages; some pages are missing."""
    pages, i = t("pages"), F.col("page_id")
    sources = pages.select(i.alias("source_id"), F.when(i % 20 == 7, F.concat("url", F.lit("/lost"))).otherwise(F.col("url")).alias("url"), F.when(i % 2 == 0, "direct").otherwise("detail").alias("mode"))
    after = pages.select((i - 1).alias("page_id"), F.col("url").alias("href"), F.concat(F.lit("issue "), i.cast("string")).alias("text"))
    following = pages.where("page_id % 3 > 0").join(after, "page_id").select("url", "href", "text")
    gone = pages.where("page_id % 10 = 0").select("url", F.concat("url", F.lit("/gone")).alias("href"), F.lit("issue gone").alias("text"))
    found = H.links(pages, "page_id", "url", "html").join(pages.select("page_id", "url"), "page_id").select("url", "href", "text").unionByName(following).unionByName(gone)
    rows = H.discovered(sources, pages.select("url", "html"), found, H.gated(F.col("href"), F.col("text"), include=("issue", "/the"), exclude=("#top",)))
    return rows.withColumn("context", F.length("context").cast("long"))


_MD = "'[Issue ' || (id % 4 + 1) || CASE WHEN id % 3 = 0 THEN '/' || (id % 4 + 2) ELSE '' END || ' of ' || (1970 + id % 30) || CASE WHEN id % 17 = 0 THEN ' kongres' WHEN id % 19 = 0 THEN ' Bibliografia' ELSE '' END || '](https://x.example/f/' || id || CASE WHEN id % 23 = 0 THEN '.html' ELSE '.pdf' END || ')'"
_KEYED = """SELECT id, url, CASE WHEN contains(lower(t), 'bibliografia') THEN NULL ELSE y || '_' || CASE WHEN contains(lower(t), 'kongres') THEN 'kongres' WHEN len(n) IN (1, 2) THEN array_to_string(n, '-') ELSE '1' END END AS key
    FROM (SELECT id, url, t, regexp_extract(t, '\\b(19\\d\\d|20\\d\\d)\\b', 1) AS y, regexp_extract_all(regexp_replace(t, '\\b(19\\d\\d|20\\d\\d)\\b', '', 'g'), '\\d+') AS n FROM (SELECT id, regexp_extract(md, '\\[([^\\]]+)\\]', 1) AS t, regexp_extract(md, '\\((https?://[^)]+\\.pdf)\\)', 1) AS url FROM m)) WHERE url <> ''"""
_DIGITS = "array_to_string(list_sort(list_distinct(regexp_extract_all({}, '\\d+'))), ',')"


@query(
    "io_url_map",
    f"""WITH a AS ({ARTICLES}), m AS (SELECT id, {_MD} AS md FROM a), k AS ({_KEYED}), u AS (SELECT key, arg_max(url, id) AS url FROM k WHERE key IS NOT NULL GROUP BY 1),
    d AS (SELECT split_part(key, '_', 1) AS y, {_DIGITS.format("split_part(key, '_', 2)")} AS d, arg_min(url, key) AS url FROM u GROUP BY 1, 2), q AS (SELECT id, year, CASE WHEN id % 5 = 0 THEN (id % 4 + 2) || '+' || (id % 4 + 1) ELSE issue END AS i FROM a)
    SELECT q.id, coalesce(u.url, d.url) AS mapped_url, CASE WHEN u.url IS NOT NULL THEN 'key' WHEN d.url IS NOT NULL THEN 'digits' END AS via FROM q LEFT JOIN u ON u.key = year || '_' || i LEFT JOIN d ON d.d <> '' AND d.y = year::VARCHAR AND d.d = {_DIGITS.format('i')}""",
)
def url_map(t):
    """Issues' addresses from markdown links, by year and issue, else by the issue's numbers."""
    i, rows = F.col("id"), articles(t)
    tail = F.when(i % 17 == 0, " kongres").when(i % 19 == 0, " Bibliografia").otherwise("")
    md = F.concat(F.lit("[Issue "), (i % 4 + 1).cast("string"), F.when(i % 3 == 0, F.concat(F.lit("/"), (i % 4 + 2).cast("string"))).otherwise(""), F.lit(" of "), (1970 + i % 30).cast("string"), tail, F.lit("](https://x.example/f/"), i.cast("string"), F.when(i % 23 == 0, ".html").otherwise(".pdf"), F.lit(")"))
    linked = rows.select("id", F.explode(H.markdown_links(md)).alias("l")).select(F.col("id").alias("place"), H.issue_key(F.col("l.text"), ("bibliografia",)).alias("key"), "l.url")
    issue = F.when(i % 5 == 0, F.concat_ws("+", (i % 4 + 2).cast("string"), (i % 4 + 1).cast("string"))).otherwise(F.col("issue"))
    return H.with_urls(rows.select("id", "year", issue.alias("issue")), H.url_map(linked), "year", "issue").select("id", "mapped_url", "via")


FILES = ("some_journal_12_1975.pdf", "45_2007_1.pdf", "acs_3_s1.pdf?x=1", "get?filename=52_2014_2.pdf", "Zborn%C3%ADk.pdf", "kras-48-1_2.pdf", "book.pdf")
TOLD = ("", "Kras 48 / 1_2 / 2010", "Some Journal 39 suppl. 2 2001", "Kras 50 supplementum", "nothing told")
RULES = [
    {"field": "file", "pattern": r"^(?:some_journal_)?(\d{1,2})_(\d{4})(?:_([12]|supl_?1))?$", "groups": {"volume": 1, "year": 2, "issue": 3}, "type": "issue"},
    {"field": "blob", "pattern": r"(?i)kras\s+(\d{2})\s*[-_/ ]\s*(1\s*[_/]\s*2|[12])\s*[-_/ ]\s*(20\d{2}|19\d{2})", "groups": {"volume": 1, "issue": 2, "year": 3}, "type": "issue", "but": r"^acs_"},
    {"field": "blob", "pattern": r"(?i)kras\s+(\d{2})\s*(supplementum|suppl\.?)", "groups": {"volume": 1, "issue": 2}, "type": "issue", "but": r"^acs_"},
    {"field": "blob", "pattern": r"(?i)some journal\s+(\d{1,2})(?:\s+suppl\.?\s*(\d+))?\s+(\d{4})", "groups": {"volume": 1, "issue": 2, "year": 3}, "type": "article_pdf"},
]
_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _identity_sql() -> str:
    parts = []
    for r in RULES:
        of = lambda n, r=r: f"regexp_extract({r['field']}, '{r['pattern']}', {r['groups'][n]})" if n in r["groups"] else "''"
        year = f"try_cast(nullif({of('year')}, '') AS BIGINT)"
        year = f"coalesce({year}, CASE WHEN try_cast(nullif({of('volume')}, '') AS BIGINT) >= 42 THEN try_cast(nullif({of('volume')}, '') AS BIGINT) + 1962 END)"
        issue = f"regexp_replace(regexp_replace(lower({of('issue')}), '[\\s_/]+', '-', 'g'), '^suppl(?:ementum|\\.)?$', 'suppl')"
        hit = f"regexp_matches({r['field']}, '{r['pattern']}') AND {year} IS NOT NULL" + (f" AND NOT regexp_matches(file, '{r['but']}')" if "but" in r else "")
        key = f"concat_ws('_', nullif({of('volume')}, ''), {year}::VARCHAR, nullif({issue}, ''))"
        parts.append(f"WHEN {hit} THEN {{'volume': {of('volume')}, 'year': {year}, 'issue': {issue}, 'key': {key}, 'type': '{r['type']}'}}")
    name = "url_decode(CASE WHEN regexp_extract(u, '[?&]filename=([^&#]*)', 1) <> '' THEN regexp_extract(u, '[?&]filename=([^&#]*)', 1) ELSE regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END)"
    file = f"regexp_replace(regexp_extract({name}, '([^/]*)$', 1), '\\.[^.]*$', '')"
    return f"""WITH p AS (SELECT page_id, {_HOST} || '/d/' || {_LIST(FILES)}[1 + page_id % {len(FILES)}] AS u, {_LIST(TOLD)}[1 + page_id % {len(TOLD)}] AS told FROM pages), f AS (SELECT *, lower({file}) AS file, trim(regexp_replace(told || ' ' || {file} || ' ' || u, '\\s+', ' ', 'g')) AS blob FROM p),
    i AS (SELECT page_id, file, CASE {' '.join(parts)} END AS i FROM f) SELECT page_id, file, i.volume AS volume, i.year AS year, i.issue AS issue, i.key AS issue_key, i.type AS type FROM i"""


@query("sc_identity", _identity_sql())
def identity(t):
    """Volume, year, issue and kind of what addresses and texts name, by the first of four rules."""
    i = F.col("page_id")
    some = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    url = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/d/"), some(FILES))
    rows = t("pages").select("page_id", url.alias("u"), some(TOLD).alias("told")).withColumn("name", H.file_name(F.col("u")))
    blob = F.trim(F.regexp_replace(F.concat_ws(" ", "told", "name", "u"), r"\s+", " "))
    rows = rows.select("page_id", F.lower("name").alias("file"), blob.alias("blob"))
    later = lambda volume: F.when(volume.try_cast("long") >= 42, volume.try_cast("long") + 1962)
    found = rows.withColumn("i", H.identity(RULES, {"file": F.col("file"), "blob": F.col("blob")}, later))
    return found.select("page_id", "file", "i.volume", "i.year", "i.issue", F.col("i.key").alias("issue_key"), "i.type")


_ANSWER = "CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here: {\"k\": 7, \"in\": {\"a\": {\"b\": 1}}} and so on' WHEN 2 THEN 'no object' WHEN 3 THEN '{\"k\": ' || '}' WHEN 4 THEN props ELSE 'first {\"k\": 1} then {\"k\": 2}' END"
_FENCED = f"trim(regexp_replace(trim({_ANSWER}), '(?is)^```(?:json)?\\s*|\\s*```$', '', 'g'))"


@query(
    "io_llm_json",
    f"""WITH a AS (SELECT event_id, regexp_extract({_FENCED}, '(?s)\\{{.*\\}}') AS o FROM events) SELECT event_id, CASE WHEN json_valid(o) THEN o END AS object, CASE WHEN json_valid(o) THEN try_cast(json_extract_string(o, '$.k') AS BIGINT) END AS k, CASE WHEN o = '' THEN 'no_json_object' WHEN NOT json_valid(o) THEN 'invalid_json' END AS parse_error FROM a""",
)
def llm_json(t):
    """The object in a model's answer, or why there is none."""
    i = F.col("event_id") % 6
    answer = F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 1, 'Here: {"k": 7, "in": {"a": {"b": 1}}} and so on').when(i == 2, "no object").when(i == 3, '{"k": }').when(i == 4, F.col("props")).otherwise('first {"k": 1} then {"k": 2}')
    found, error = H.json_object(answer)
    return t("events").select("event_id", found.alias("object"), F.get_json_object(found, "$.k").try_cast("long").alias("k"), error.alias("parse_error"))


_CREATOR = "CASE WHEN contains(x, ',') THEN '{\"creatorType\":\"author\",\"firstName\":' || to_json(trim(substr(x, length(split_part(x, ',', 1)) + 2)))::VARCHAR || ',\"lastName\":' || to_json(trim(split_part(x, ',', 1)))::VARCHAR || '}' ELSE '{\"creatorType\":\"author\",\"name\":' || to_json(trim(x))::VARCHAR || '}' END"
_J = lambda c: f"to_json({c}::VARCHAR)::VARCHAR"
_ITEM = (
    "'{\"itemType\":\"journalArticle\",\"title\":' || " + _J("title") + " || ',\"creators\":[' || " + joined_sql(f"list_transform(authors, lambda x: {_CREATOR})", ",") + " || '],\"publicationTitle\":\"Journal\",\"volume\":' || " + _J("volume") + " || ',\"issue\":' || " + _J("issue") + " || ',\"pages\":' || " + _J("pages") + " || ',\"date\":' || " + _J("year")
    + " || ',\"abstractNote\":' || " + _J("abstract") + " || ',\"url\":' || " + _J("pdf_url") + " || ',\"extra\":' || " + _J("('ID: ' || id || chr(10) || 'Volume: ' || volume || chr(10) || 'Issue: ' || issue || chr(10) || 'Pages: ' || pages || CASE WHEN len(extras) > 0 THEN chr(10) || 'Extras: ' || array_to_string(extras, ', ') ELSE '' END)")
    + " || ',\"tags\":[{\"tag\":\"tag\"},{\"tag\":\"year_' || year || '\"}' || CASE WHEN volume <> '' THEN ',{\"tag\":\"volume_' || volume || '\"}' ELSE '' END || ',{\"tag\":\"issue_' || issue || '\"}]}'"
)


@query("io_zotero", f"WITH a AS ({ARTICLES}) SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS batch, {_ITEM} AS item FROM a WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def zotero(t):
    """What is not uploaded yet, as records in batches of fifty."""
    done = t("labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return H.upload_items(articles(t), done, "Journal", "tag")


_ONE = "regexp_replace({}, '\\s+', ' ', 'g')"
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "io_render",
    f"""WITH a AS ({ARTICLES}), r AS (SELECT coalesce(journal_id, '{JOURNAL}') AS journal, row_number() OVER (PARTITION BY coalesce(journal_id, '{JOURNAL}') ORDER BY year, id) AS place, {_ONE.format('title')} AS h, {_ONE.format('text')} AS b FROM a)
    SELECT journal, place, place || '. ' || h || ': ' || b AS text, place || '. **' || h || '** ' || b AS markdown, '<li><strong>' || {_ESC.format('h')} || '</strong> ' || {_ESC.format('b')} || '</li>' AS html FROM r""",
)
def render(t):
    """A report's lines in three forms, numbered in each journal; write_report makes files of them."""
    rows = articles(t).withColumn("journal", F.coalesce("journal_id", F.lit(JOURNAL)))
    return H.report(rows, "journal", ["year", "id"], F.col("title"), F.col("text"))


_SHARDED = _CHUNKS + f", s AS (SELECT d.source AS journal, 1970 + c.doc_id % 55 AS year, c.doc_id AS a, c.text AS t FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)"


def shards_of(t) -> str:
    """Writes the chunks of all documents into shards by journal and year, {id, a, t} in each line, and gives the folder."""
    docs = t("documents")
    path = files.scratch(docs.sparkSession)
    rows = chunks.chunk(docs).join(docs.select("doc_id", "source"), "doc_id")
    rows = rows.select(F.col("source").alias("journal"), (1970 + F.col("doc_id") % 55).alias("year"), chunks.chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("text")).alias("id"), F.col("doc_id").alias("a"), F.col("text").alias("t"))
    files.write_shards(rows.where("trim(id) <> ''"), path, "journal", "year")
    return path


def read_shards(spark, path: str):
    return spark.read.schema("id string, a long, t string, journal string, year long").json(path)


@query("io_shards", _SHARDED + " SELECT journal, year, count(*) AS chunks, count(DISTINCT a) AS articles, sum(strlen(t))::BIGINT AS bytes, sum(length(t))::BIGINT AS chars FROM s GROUP BY GROUPING SETS ((journal, year), (journal), ())")
def shards(t):
    """Shards written and read back for their manifest: for each shard, each journal and all of them."""
    rows = read_shards(t("documents").sparkSession, shards_of(t)).select("journal", "year", "a", F.octet_length("t").cast("long").alias("b"), F.length("t").cast("long").alias("c"))
    j, y = F.col("journal"), F.col("year")
    return rows.groupingSets([[j, y], [j], []], j, y).agg(F.count("*").alias("chunks"), F.countDistinct("a").alias("articles"), F.sum("b").alias("bytes"), F.sum("c").alias("chars"))


@query("se_shard_prune", _SHARDED + " SELECT journal, year, count(*) AS chunks FROM s WHERE journal = 'src1' AND year BETWEEN 1975 AND 2000 GROUP BY 1, 2")
def shard_prune(t):
    """Chunks of a journal and some years: only the folders of their shards are read."""
    rows = read_shards(t("documents").sparkSession, shards_of(t))
    return rows.where("journal = 'src1' AND year BETWEEN 1975 AND 2000").groupBy("journal", "year").agg(F.count("*").alias("chunks"))

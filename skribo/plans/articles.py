"""Queries over articles: a relation made of the documents that has the lists and strings of a bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.functions import articles as A
from skribo.functions import features as P
from skribo.functions import text as X
from skribo.operators import ranking
from skribo.operators.numbering import numbered
from skribo.plans.base import index_of, query
from skribo.plans.texts import _FOLD, WIDE_PREFIXES, _bm25_sql, documents_index, key_sql

#: Stand-ins for what the documents lack, by their ids: texts of pages, of models' answers, and titles.
PHRASES = (
    "",
    "Mapa jaskyne, mierka 1:500, zameral a kreslil autor.",
    "Plán jaskyne a legenda. Dĺžka 120 m, hĺbka 30 m.",
    "Plán práce a akcií na budúci rok.",
    "Foto: vchod. Tab. 1",
    "Použitá literatúra\nrez jaskyňou, 1 : 250",
    "Nadmorská výška 512 m n. m., azimut 40, sklon 12",
    "48° 31' 20 GPS; x = 123456",
    "rok  12  13\nrok  14  15\nrok  16  17",
    "profil v mierke 1:1000",
)
ANSWERS = ("", "Thinking... a lot ...done thinking. Anotácia: ", "Abstrakt: ", "- Anotacia - ", "Thinking... ", '"')
JOURNAL = "src0"

ARTICLES = """SELECT d.doc_id AS id, CASE WHEN d.doc_id % 5 > 0 THEN d.source END AS journal_id, coalesce(array_to_string(w[1:6], ' '), '') AS title,
    CASE WHEN d.doc_id % 7 = 0 THEN []::VARCHAR[] ELSE list_filter([w[7] || ', ' || left(w[8], 1) || '.', w[9]], lambda x: x IS NOT NULL) END AS authors,
    1970 + d.doc_id % 55 AS year, CASE WHEN d.doc_id % 4 > 0 THEN (d.doc_id % 31)::VARCHAR || '.' ELSE '' END AS volume, (d.doc_id % 6 + 1)::VARCHAR AS issue,
    CASE WHEN d.doc_id % 6 = 0 THEN '' WHEN d.doc_id % 6 = 1 THEN (d.doc_id % 80 + 1)::VARCHAR ELSE (d.doc_id % 80 + 1)::VARCHAR || '-' || (d.doc_id % 80 + 1 + d.doc_id % 9)::VARCHAR END AS pages,
    coalesce(array_to_string(w[20:45], ' '), '') AS abstract, CASE WHEN d.doc_id % 9 > 0 THEN 'https://x.example/' || d.source || '/' || (d.doc_id % 40) || '.pdf' ELSE '' END AS pdf_url,
    list_filter([CASE WHEN d.doc_id % 3 = 0 THEN (d.doc_id % 12) || ' obr.' END, CASE WHEN d.doc_id % 8 = 0 THEN 'mapa' END, CASE WHEN d.doc_id % 10 = 1 THEN 'lit.' END], lambda x: x IS NOT NULL) AS extras,
    w[10:11] AS caves, [d.lang, d.source] AS tags, w[12:12] AS groups, CASE WHEN l.doc_id IS NOT NULL THEN w[13:15] ELSE []::VARCHAR[] END AS keywords, w[16:17] AS locations, w[18:18] AS people,
    CASE WHEN l.doc_id IS NOT NULL THEN coalesce(array_to_string(w[13:19], ' '), '') ELSE '' END AS summary, coalesce(l.toxic = 1, false) AS has_map_plan, d.text
    FROM (SELECT *, string_split(text, ' ') AS w FROM documents) d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id"""


def articles(t) -> DataFrame:
    """What ARTICLES says, of every document."""
    known = t("labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"), F.lit(True).alias("known"))
    d = t("documents").select("doc_id", "source", "lang", "text", F.split("text", " ").alias("w")).join(known, "doc_id", "left")
    i, w, empty = F.col("doc_id"), F.col("w"), F.array().cast("array<string>")
    words = lambda a, b: F.slice(w, a, b - a + 1)
    number = lambda c: c.cast("string")
    return d.select(
        i.alias("id"),
        F.when(i % 5 > 0, F.col("source")).alias("journal_id"),
        F.array_join(words(1, 6), " ").alias("title"),
        F.when(i % 7 == 0, empty).otherwise(F.array_compact(F.array(F.concat(F.get(w, F.lit(6)), F.lit(", "), F.substring(F.get(w, F.lit(7)), 1, 1), F.lit(".")), F.get(w, F.lit(8))))).alias("authors"),
        (1970 + i % 55).alias("year"),
        F.when(i % 4 > 0, F.concat(number(i % 31), F.lit("."))).otherwise("").alias("volume"),
        number(i % 6 + 1).alias("issue"),
        F.when(i % 6 == 0, "").when(i % 6 == 1, number(i % 80 + 1)).otherwise(F.concat_ws("-", number(i % 80 + 1), number(i % 80 + 1 + i % 9))).alias("pages"),
        F.array_join(words(20, 45), " ").alias("abstract"),
        F.when(i % 9 > 0, F.concat(F.lit("https://x.example/"), "source", F.lit("/"), number(i % 40), F.lit(".pdf"))).otherwise("").alias("pdf_url"),
        F.array_compact(F.array(F.when(i % 3 == 0, F.concat(number(i % 12), F.lit(" obr."))), F.when(i % 8 == 0, "mapa"), F.when(i % 10 == 1, "lit."))).alias("extras"),
        words(10, 11).alias("caves"),
        F.array("lang", "source").alias("tags"),
        words(12, 12).alias("groups"),
        F.when(F.col("known"), words(13, 15)).otherwise(empty).alias("keywords"),
        words(16, 17).alias("locations"),
        words(18, 18).alias("people"),
        F.when(F.col("known"), F.array_join(words(13, 19), " ")).otherwise("").alias("summary"),
        F.coalesce("toxic", F.lit(False)).alias("has_map_plan"),
        "text",
    )


def unique_sql(values: str) -> str:
    """X.unique in DuckDB."""
    some = f"list_filter({values}, lambda z: trim(z) <> '')"
    return f"list_transform(list_filter({some}, lambda x, i: NOT list_contains(list_transform({some}[1:i - 1], lambda y: {key_sql('y')}), {key_sql('x')})), lambda v: trim(v))"


def joined_sql(values: str, by: str = ",") -> str:
    return f"coalesce(array_to_string({values}, '{by}'), '')"


_JOURNAL = f"coalesce(journal_id, '{JOURNAL}')"
_WHO = f"CASE WHEN len({unique_sql('authors')}) > 0 THEN array_to_string({unique_sql('authors')}, ', ') ELSE 'Anonymus' END"


@query(
    "sc_citation",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT *, {_WHO} AS who, trim(title) AS what, {_JOURNAL} AS journal, replace(trim(pages), '-', ' - ') AS p, try_cast(nullif(regexp_extract(pages, '^\\s*(\\d+)', 1), '') AS BIGINT) AS f,
      try_cast(nullif(regexp_extract(pages, '^\\s*\\d+\\s*-\\s*(\\d+)', 1), '') AS BIGINT) AS l FROM a)
    SELECT id, replace(concat_ws(', ', who || '. ' || what || '.', journal || ', ' || year, CASE WHEN volume <> '' THEN 'roc. ' || volume END, 'c. ' || issue, CASE WHEN p <> '' THEN 's. ' || p END, CASE WHEN pdf_url <> '' THEN 'Online: ' || pdf_url END), '.,', '.') AS iso690,
      who || '. (' || year || '). ' || what || '. ' || journal || ', ' || issue || CASE WHEN p <> '' THEN ', ' || p ELSE '' END || '.' AS apa,
      concat_ws(', ', who || '. "' || what || '."', journal, 'no. ' || issue, year::VARCHAR, CASE WHEN p <> '' THEN 'pp. ' || p END) || '.' AS mla,
      '@article{{a' || id || chr(44) || chr(10) || '  author = {{' || {joined_sql('authors', ' and ')} || '}},' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  journal = {{' || journal || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10)
        || '  volume = {{' || CASE WHEN volume <> '' THEN volume ELSE 'I' END || '}},' || chr(10) || '  number = {{' || issue || '}},' || chr(10) || '  pages = {{' || pages || '}},' || chr(10) || '  url = {{' || pdf_url || '}}' || chr(10) || '}}' AS bibtex,
      'TY  - JOUR' || chr(10) || 'T1  - ' || title || {joined_sql("list_transform(authors, lambda x: chr(10) || 'AU  - ' || x)", '')} || chr(10) || 'JO  - ' || journal || chr(10) || 'PY  - ' || year || chr(10) || 'VL  - ' || CASE WHEN volume <> '' THEN volume ELSE 'I' END
        || chr(10) || 'IS  - ' || issue || chr(10) || 'SP  - ' || coalesce(f::VARCHAR, '') || chr(10) || 'EP  - ' || coalesce(greatest(f, coalesce(l, f))::VARCHAR, '') || chr(10) || 'UR  - ' || pdf_url || chr(10) || 'ER  - ' AS ris FROM b""",
)
def citation(t):
    journal = F.coalesce("journal_id", F.lit(JOURNAL))
    fields = [F.col("authors"), F.col("title"), journal, *[F.col(c) for c in ("year", "volume", "issue", "pages", "pdf_url")]]
    made = A.citations(*fields) | A.exchange_formats(F.concat(F.lit("a"), F.col("id").cast("string")), *fields)
    return articles(t).select("id", *[c.alias(n) for n, c in made.items()])


_LISTS = {"caves": "caves", "groups": "groups", "tags": "tags", "n_keywords": "keywords", "k_keywords": "keywords", "n_locations": "locations", "authors": "authors", "k_people": "people", "k_caves": "locations"}


def entity_rows(rows: DataFrame) -> DataFrame:
    """id, type, place (from 0), name: the entities of articles, a row each."""
    lists = A.entities({n: F.col(c) for n, c in _LISTS.items()})
    one = F.explode(F.array(*[F.struct(F.lit(kind).alias("type"), names.alias("names")) for kind, names in lists.items()])).alias("e")
    return rows.select("id", one).select("id", "e.type", F.posexplode("e.names").alias("place", "name")).select("id", "type", F.col("place").cast("long").alias("place"), "name")


def _entities_sql() -> str:
    parts = []
    for kind, names in A.ENTITY_LISTS.items():
        every = " || ".join(_LISTS[n] if n in _LISTS else "[]::VARCHAR[]" for n in names)
        parts.append(f"SELECT id, '{kind}' AS type, {unique_sql(f'({every})')} AS names FROM a")
    return f"SELECT id, type, k - 1 AS place, names[k] AS name FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM ({' UNION ALL '.join(parts)}))"


@query("sc_entities", f"WITH a AS ({ARTICLES}) {_entities_sql()}")
def entities(t):
    """Six types of names, each merged of several lists, the first spelling of a folded name in order."""
    return entity_rows(articles(t))


def _things(values: str, kind: str) -> str:
    return f"""'[' || array_to_string(list_transform({values}, lambda n: '{{"@type":"{kind}","name":' || to_json(n)::VARCHAR || '}}'), ',') || ']'"""


_KEYS, _ABOUT = unique_sql("(tags || caves || groups || keywords)"), unique_sql("(caves || locations || tags || keywords)")
JSONLD = (
    """'{"@context":"https://schema.org","@type":"ScholarlyArticle","identifier":' || to_json("""
    + _JOURNAL
    + """ || '-' || id)::VARCHAR || CASE WHEN title <> '' THEN ',"name":' || to_json(title)::VARCHAR || ',"headline":' || to_json(title)::VARCHAR ELSE '' END
    || CASE WHEN len(authors) > 0 THEN ',"author":' || """
    + _things("authors", "Person")
    + """ ELSE '' END || ',"datePublished":"' || year || '","isPartOf":{"@type":"Periodical","name":' || to_json("""
    + _JOURNAL
    + """)::VARCHAR || '}' || CASE WHEN pages <> '' THEN ',"pagination":' || to_json(pages)::VARCHAR ELSE '' END
    || CASE WHEN pdf_url <> '' THEN ',"url":' || to_json(pdf_url)::VARCHAR ELSE '' END || CASE WHEN abstract <> '' THEN ',"abstract":' || to_json(abstract)::VARCHAR ELSE '' END
    || CASE WHEN len("""
    + _KEYS
    + """) > 0 THEN ',"keywords":' || to_json("""
    + _KEYS
    + """)::VARCHAR ELSE '' END || CASE WHEN len("""
    + _ABOUT
    + """) > 0 THEN ',"about":' || """
    + _things(_ABOUT, "Thing")
    + """ ELSE '' END || '}'"""
)


def jsonld_of(c=F.col):
    journal = F.coalesce("journal_id", F.lit(JOURNAL))
    lists = lambda *names: F.concat(*[c(n) for n in names])
    return A.jsonld(F.concat_ws("-", journal, c("id").cast("string")), c("title"), c("authors"), c("year"), journal, c("pages"), c("pdf_url"), c("abstract"), lists("tags", "caves", "groups", "keywords"), lists("caves", "locations", "tags", "keywords"))


@query("sc_jsonld", f"WITH a AS ({ARTICLES}) SELECT id, {JSONLD} AS jsonld FROM a")
def jsonld(t):
    return articles(t).select("id", jsonld_of().alias("jsonld"))


_VISUAL = "lower(title || chr(10) || abstract || chr(10) || " + joined_sql("extras", " ") + " || chr(10) || summary || chr(10) || left(text, 12000))"
TAGS = {"license": "licen[cs]e", "mail": "[a-z0-9.]+@[a-z0-9.]+", "number": "[0-9]{3,}", "table": " [|] "}


def visual_sql(of: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({of}, '{A.visual_pattern(t)}') THEN '{t}' END" for t in A.VISUAL_TERMS) + "], lambda x: x IS NOT NULL)"


@query(
    "sc_visual",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT id, lower(text) AS low, {_VISUAL} AS h FROM a) SELECT id, {joined_sql(visual_sql('h'), ' ')} AS terms,
    coalesce(nullif(concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p in TAGS.items())}), ''), 'other') AS tags FROM b""",
)
def visual(t):
    """Nineteen beginnings of words, and tags of a taxonomy with a default one."""
    terms = A.visual_terms(F.col("title"), F.col("abstract"), F.col("extras"), F.col("summary"), F.col("text"))
    return articles(t).select("id", F.array_join(terms, " ").alias("terms"), F.array_join(A.tagged(F.lower("text"), TAGS, "other"), ",").alias("tags"))


_LIST = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_PAGED = f"text || chr(10) || {_LIST(PHRASES)}[1 + id % {len(PHRASES)}] || chr(12) || {_LIST(PHRASES)}[1 + id // 7 % {len(PHRASES)}] || chr(10) || {_LIST(PHRASES)}[1 + id // 3 % {len(PHRASES)}]"


def paged(rows: DataFrame) -> DataFrame:
    """Articles with two pages: the text with one of PHRASES, and two more of them."""
    some = lambda k: F.get(F.array(*[F.lit(p) for p in PHRASES]), (k % len(PHRASES)).cast("int"))
    i = F.col("id")
    return rows.withColumn("text", F.concat("text", F.lit("\n"), some(i), F.lit("\f"), some(F.floor(i / 7)), F.lit("\n"), some(F.floor(i / 3))))


def fold_text_sql(column: str) -> str:
    joined = f"regexp_replace({column}, '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({_FOLD.format(joined)}, '\\s+', ' ', 'g'))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _highest_sql(rules) -> str:
    return "greatest(0.0, " + ", ".join(f"CASE WHEN {rule} THEN {weight} ELSE 0.0 END" for weight, rule in rules) + ")"


def _features_sql() -> str:
    signs = ", ".join(f"regexp_matches(folded, '{_quoted(p)}') AS {n}" for n, p in P.SIGNS.items())
    cells = "list_transform(string_split_regex(part, '\\r\\n|[\\n\\r]'), lambda l: list_filter(string_split_regex(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '\\s{2,}|\\t+'), lambda c: c <> ''))"
    rows = f"len(list_filter({cells}, lambda l: len(l) >= {P.CELLS} AND len(list_filter(l, lambda c: regexp_matches(c, '\\d'))) >= {P.NUMBERS})) >= {P.ROWS} AS rows"
    total = "least(1.0, " + " + ".join(f"CASE WHEN {rule} THEN {weight} ELSE 0.0 END" for weight, rule in P.MAP_SIGNS) + ")"
    for most, rule in P.MAP_GUARDS:
        total = f"CASE WHEN {rule} THEN least({total}, {most}) ELSE {total} END"
    of_page = [("map_plan", total), *[(n, _highest_sql(r)) for n, r in P.PAGE_SIGNS.items()]]
    described = ", ".join(f"regexp_matches(fe, '{_quoted(p)}') AS {n}" for n, p in P.OF_EXTRAS.items()) + ", " + ", ".join(f"regexp_matches(fa, '{_quoted(p)}') AS {n}" for n, p in P.OF_WORDS.items()) + f", regexp_matches(ft, '{_quoted(P.SIGNS['plan_of_work'])}') AS plan_of_work"
    listed = joined_sql("extras", " ")
    scored = lambda of, rel, page: " UNION ALL ".join(f"SELECT id, {page} AS page, '{n}' AS feature, ({s})::DOUBLE AS score FROM {rel}" for n, s in of)
    limit = "CASE feature " + " ".join(f"WHEN '{n}' THEN {x}" for n, x in P.THRESHOLDS.items()) + " END"
    return f"""WITH a AS ({ARTICLES}), parts AS (SELECT id, p[k] AS part, k AS page FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT id, string_split({_PAGED}, chr(12)) AS p FROM a))),
    pages AS (SELECT id, page, {signs}, {rows} FROM (SELECT id, page, part, {fold_text_sql('part')} AS folded FROM parts WHERE NOT regexp_full_match(part, '\\s*'))),
    described AS (SELECT id, {described} FROM (SELECT id, {fold_text_sql(listed)} AS fe, {fold_text_sql('title')} AS ft, {fold_text_sql(f"{listed} || ' ' || title || ' ' || abstract")} AS fa FROM a)),
    scores AS ({scored(of_page, 'pages', 'page')} UNION ALL {scored([(n, _highest_sql(P.DESCRIBED.get(n, ()) or ((0.0, 'false'),))) for n in P.THRESHOLDS], 'described', 'NULL::BIGINT')}),
    best AS (SELECT id, feature, round(max(score), 3) AS score, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE page IS NOT NULL AND CASE WHEN feature = 'map_plan' THEN score >= 0.85 ELSE score > 0 END) AS pages FROM scores GROUP BY 1, 2),
    features AS (SELECT id, feature, score, score >= {limit} AS present, CASE WHEN score >= {P.HIGH} THEN 'high' WHEN score >= {limit} THEN 'medium' WHEN feature = 'map_plan' AND score >= {P.CANDIDATE} THEN 'candidate' WHEN score > 0 THEN 'low' ELSE 'none' END AS confidence, coalesce(pages, '') AS pages FROM best)"""


def features(t) -> DataFrame:
    return P.detected(paged(articles(t)), "id", "title", "abstract", "extras", "text")


@query("sc_feature_score", _features_sql() + " SELECT * FROM features")
def feature_score(t):
    return features(t).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("ag_feature_counts", _features_sql() + " SELECT feature, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE confidence = 'candidate') AS candidates, count(*) AS n FROM features GROUP BY 1")
def feature_counts(t):
    """How many articles have each feature, and how many are candidates."""
    return features(t).groupBy("feature").agg(F.count_if("present").alias("present"), F.count_if(F.col("confidence") == "candidate").alias("candidates"), F.count("*").alias("n"))


_SUSPECT = "CASE id % 11 WHEN 0 THEN title || ', s. 12' WHEN 1 THEN title || chr(10) || abstract WHEN 2 THEN abstract || ' ' || abstract WHEN 3 THEN abstract || ' ' || abstract || ', s. 7 - 9' ELSE title END"


@query(
    "pf_suspicion",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT id, authors, pages, {_SUSPECT} AS t FROM a) SELECT id, concat_ws(',', CASE WHEN trim(pages) = '' THEN 'missing_pages' END, CASE WHEN length(t) > 220 AND (trim(pages) = '' OR regexp_matches(t, ',\\s*s\\.\\s*\\d+')) THEN 'long_title' END,
    CASE WHEN regexp_matches(t, ',\\s*s\\.\\s*\\d+') THEN 'embedded_pages_in_title' END, CASE WHEN contains(t, chr(10)) THEN 'multiline_title' END) AS reasons, len(list_filter(authors, lambda x: trim({_FOLD.format('x')}) NOT IN ('', 'anonymus'))) = 0 AS anonymous FROM b""",
)
def suspicion(t):
    i, twice = F.col("id") % 11, F.concat_ws(" ", "abstract", "abstract")
    title = F.when(i == 0, F.concat("title", F.lit(", s. 12"))).when(i == 1, F.concat_ws("\n", "title", "abstract")).when(i == 2, twice).when(i == 3, F.concat(twice, F.lit(", s. 7 - 9"))).otherwise(F.col("title"))
    return articles(t).select("id", F.array_join(A.suspicions(title, F.col("pages")), ",").alias("reasons"), A.anonymous(F.col("authors")).alias("anonymous"))


_RAW = "list_filter([CASE WHEN id % 4 = 0 THEN 'J.' END, title, CASE WHEN id % 2 = 0 THEN 'Š.' END, CASE WHEN id % 3 = 0 THEN ' a kol.' END, CASE WHEN len(authors) > 0 THEN authors[1] END, CASE WHEN id % 5 = 0 THEN 'Eds.' END], lambda x: x IS NOT NULL)"
_BELONGS = "(regexp_matches(x, '^[A-ZÁÄČĎÉÍĽĹŇÓÔŔŠŤÚÝŽ]\\.$') OR lower(x) IN ('a kol.', 'a spol.', 'coll.', 'eds.', 'ed.'))"


@query(
    "sc_authors",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT id, authors, list_transform({_RAW}, lambda y: trim(y)) AS r FROM a), c AS (SELECT id, authors, r, list_transform(r, lambda x, i: CASE WHEN i > 1 AND {_BELONGS} THEN 0 ELSE 1 END) AS s FROM b)
    SELECT id, {joined_sql("list_transform(range(1, list_sum(s)::BIGINT + 1), lambda g: array_to_string(list_filter(r, lambda x, i: list_sum(s[1:i]) = g), ', '))", ';')} AS cleaned,
    {joined_sql("list_transform(authors, lambda x: CASE WHEN trim(substr(x, length(split_part(x, ',', 1)) + 2)) <> '' THEN trim(substr(x, length(split_part(x, ',', 1)) + 2)) || ' ' || trim(split_part(x, ',', 1)) ELSE trim(x) END)", ';')} AS register_names FROM c""",
)
def authors(t):
    """Initials and suffixes back at the author before, and names as a register has them."""
    i = F.col("id")
    first = F.get("authors", F.lit(0))
    raw = F.array_compact(F.array(F.when(i % 4 == 0, "J."), F.col("title"), F.when(i % 2 == 0, "Š."), F.when(i % 3 == 0, " a kol."), first, F.when(i % 5 == 0, "Eds.")))
    return articles(t).select("id", F.array_join(A.clean_authors(raw), ";").alias("cleaned"), F.array_join(F.transform("authors", A.register_name), ";").alias("register_names"))


_SPACED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(
    "sc_abstract",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT id, {_SPACED.format(f"{_LIST(ANSWERS)}[1 + id % {len(ANSWERS)}] || text")} AS x FROM a),
    c AS (SELECT id, {_SPACED.format("regexp_replace(x, '(?i)^.*?\\.\\.\\.\\s*done\\s+thinking\\.?', '')")} AS x FROM b),
    d AS (SELECT id, {_SPACED.format("regexp_replace(x, '(?i)^(?:.*?[^\\p{L}\\p{N}_])?anot[áa]cia\\s*:\\s*', '')")} AS x FROM c),
    e AS (SELECT id, regexp_replace(regexp_replace(x, '(?is)^thinking\\.\\.\\..*', ''), '^[`''"\\s]+|[`''"\\s]+$', '', 'g') AS x FROM d),
    f AS (SELECT id, {_SPACED.format("regexp_replace(x, '(?i)^(?:[-*]\\s*)?(?:anot[áa]cia|bibliografick[áa] anot[áa]cia|abstrakt)\\s*[:\\-]\\s*', '')")} AS x FROM e),
    g AS (SELECT id, x, {_SPACED.format("coalesce(array_to_string(list_filter(string_split(regexp_replace(x, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')[1:2], ' '), '')")} AS k FROM f)
    SELECT id, CASE WHEN length(x) < 25 THEN '' WHEN length(k) <= 420 THEN k ELSE regexp_replace(regexp_replace(left(k, 420), ' [^ ]*$', ''), '[ ,;:]+$', '') || '.' END AS abstract FROM g""",
)
def abstract(t):
    """What a model might answer, made an abstract: its thinking and labels off, two sentences, cut after a word."""
    answer = F.concat(F.get(F.array(*[F.lit(x) for x in ANSWERS]), (F.col("id") % len(ANSWERS)).cast("int")), "text")
    return articles(t).select("id", A.normalized_abstract(answer).alias("abstract"))


_FOOTED = "text || CASE id % 5 WHEN 0 THEN chr(10) || '- ' || (id % 300) || ' -' WHEN 1 THEN chr(10) || chr(10) || ' ' || (id % 300) || ' ' || chr(10) || 'end' WHEN 2 THEN chr(10) || 'XYZ ' || (id % 300) || ' Journal' ELSE '' END"
FOOTER = r"(?i)\bXYZ\s+(\d{1,4})\s+Journal\b"


@query(
    "sc_page_number",
    f"""WITH a AS ({ARTICLES}), l AS (SELECT id, list_filter(list_transform(string_split_regex({_FOOTED}, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM a)
    SELECT id, list_filter(list_transform(list_reverse(l[greatest(1, len(l) - 13):]) || l[1:8], lambda x: coalesce(nullif(regexp_extract(x, '{FOOTER}', 1), ''), nullif(regexp_extract(x, '^-+\\s*(\\d{{1,4}})\\s*-+$', 1), ''), nullif(regexp_extract(x, '^(\\d{{1,4}})$', 1), ''))), lambda y: y IS NOT NULL)[1]::BIGINT AS number FROM l""",
)
def page_number(t):
    """The printed number of a page: of the last lines the last one that is a number, else of the first lines the first one."""
    i = F.col("id")
    number = (i % 300).cast("string")
    ends = F.when(i % 5 == 0, F.concat(F.lit("\n- "), number, F.lit(" -"))).when(i % 5 == 1, F.concat(F.lit("\n\n "), number, F.lit(" \nend"))).when(i % 5 == 2, F.concat(F.lit("\nXYZ "), number, F.lit(" Journal"))).otherwise("")
    return articles(t).select("id", A.printed_page_number(F.concat("text", ends), FOOTER).alias("number"))


_ROMAN = "CASE year " + " ".join(f"WHEN {y} THEN '{r}.'" for y, r in zip(range(1970, 2025), (t + o for t in ("", "X", "XX", "XXX", "XL", "L") for o in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX") if t + o), strict=False)) + " END"
_TOLD = "CASE WHEN id % 8 = 0 THEN 'Ročník XLIV a ďalej' ELSE text END"


@query(
    "sc_volume",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT *, upper(regexp_extract({_TOLD}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])ro[čc]n[íi]k\\s+([ivxlcdm]{{1,12}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)) AS told FROM a),
    c AS (SELECT id, year, volume, CASE WHEN trim(volume) NOT IN ('', '-', 'None') THEN volume WHEN id % 12 = 4 THEN NULL ELSE coalesce(CASE WHEN told <> '' THEN told || '.' END, {_ROMAN}) END AS filled, {_ROMAN} AS by_year FROM b)
    SELECT id, year, volume, filled, by_year, year - 1969 AS value FROM c""",
)
def volume(t):
    """Missing volumes from the text or the year, but for special issues; and Roman numerals both ways."""
    told = F.when(F.col("id") % 8 == 0, "Ročník XLIV a ďalej").otherwise(F.col("text"))
    by_year = F.concat(X.roman(F.col("year") - A.YEAR_ZERO), F.lit("."))
    filled = A.filled_volume(F.col("volume"), F.col("year"), told, F.col("id") % 12 == 4)
    return articles(t).select("id", "year", "volume", filled.alias("filled"), by_year.alias("by_year"), A.roman_value(by_year).alias("value"))


#: What a hit among an article's entities counts, and one in its fields.
ENTITY_HIT, FIELD_HIT = -20.0, -5.0
#: The fields that a term is looked for in.
METADATA = ("title", "abstract", "summary", "caves", "keywords", "tags", "groups", "locations", "people", "themes", "authors")


def query_terms(spark, question: str, generic: tuple[str, ...] = ()) -> list[str]:
    """The folded question itself and its tokens of more than one letter, without generic ones unless there are no others."""
    whole = spark.range(1).select(X.normalize_key(F.lit(question)).alias("k")).first()["k"]
    tokens = [w for w in whole.split(" ") if len(w) > 1]
    terms = [w for w in tokens if w not in generic] or tokens
    return list(dict.fromkeys([whole, *terms])) if whole else terms


def metadata_scores(rows: DataFrame, names: DataFrame, fields: dict[str, Column], terms: list[str]) -> DataFrame:
    """id, score: the least of ENTITY_HIT where a folded name of an article's entities holds a term, and FIELD_HIT where a field, in lower case, does.

    rows: id and what the fields need; names: id, name.
    """
    some = lambda c: F.exists(F.array(*[F.lit(w) for w in terms]), lambda w: F.contains(c, w))
    entity = names.where(some(X.normalize_key(F.col("name")))).select("id", F.lit(ENTITY_HIT).alias("score"))
    low = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in fields.values()])
    field = rows.where(F.exists(low, some)).select("id", F.lit(FIELD_HIT).alias("score"))
    return entity.unionByName(field).groupBy("id").agg(F.min("score").alias("score"))


TERMS_OF, GENERIC = "The tione ment of", ("the", "of")


def _metadata_fields() -> dict[str, Column]:
    strings = {"title", "abstract", "summary"}
    return {n: F.col(n) if n in strings else A.authors_label(F.col(n)) if n == "authors" else F.to_json(F.col("tags" if n == "themes" else n)) for n in METADATA}


_TERM_LIST = "['the tione ment of', 'tione', 'ment']"
_HOLDS = "len(list_filter(" + _TERM_LIST + ", lambda w: contains({}, w))) > 0"
_FIELDS_SQL = [n if n in ("title", "abstract", "summary") else _WHO if n == "authors" else f"to_json({'tags' if n == 'themes' else n})::VARCHAR" for n in METADATA]
_METADATA_SQL = f"""WITH a AS ({ARTICLES}), e AS ({_entities_sql()}), hits AS (SELECT id, {ENTITY_HIT} AS score FROM e WHERE {_HOLDS.format(key_sql('name'))} UNION ALL SELECT id, {FIELD_HIT} FROM a WHERE {' OR '.join(_HOLDS.format(f'lower({f})') for f in _FIELDS_SQL)})"""


def metadata_of(t) -> DataFrame:
    rows = articles(t)
    return metadata_scores(rows, entity_rows(rows).select("id", "name"), _metadata_fields(), query_terms(t("documents").sparkSession, TERMS_OF, GENERIC))


@query("se_metadata", _METADATA_SQL + " SELECT id, min(score)::DOUBLE AS score FROM hits GROUP BY 1")
def metadata(t):
    return metadata_of(t)


@query("st_score_union", _METADATA_SQL + f" SELECT id, round(min(score), 9)::DOUBLE AS score FROM (SELECT * FROM hits UNION ALL SELECT doc_id, score FROM ({_bm25_sql(WIDE_PREFIXES, 'all')})) GROUP BY 1")
def score_union(t):
    """The best of what the full text and the metadata score."""
    index = documents_index(t)
    text = ranking.bm25(index, WIDE_PREFIXES, "all").select(F.col("doc_id").alias("id"), "score")
    return metadata_of(t).unionByName(text).groupBy("id").agg(F.round(F.min("score"), 9).alias("score"))


#: The fields of the browser's search and their boosts.
MINI_FIELDS = ("title", "authors", "abstract", "year", "volume", "issue", "tags", "caves", "groups")
BOOSTS = {"title": 4, "caves": 3, "authors": 2, "tags": 2, "groups": 2, "abstract": 1}
MINI_WORDS = ["this", "mentt", "src1"]


def mini_index(t) -> ranking.Index:
    return index_of("articles", [t("documents"), t("labels")], lambda: (articles(t), "id", {n: F.col(n) for n in MINI_FIELDS}))


def _mini_sql() -> str:
    value = lambda n: f"{n}::VARCHAR" if n in ("year", "volume", "issue", "title", "abstract") else joined_sql(n, " ")
    fields = " UNION ALL ".join(f"SELECT id, '{n}' AS field, list_filter(regexp_split_to_array({_FOLD.format(value(n))}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM a" for n in MINI_FIELDS)
    most = {w: min(6, int(0.1 * len(w) + 0.5)) for w in MINI_WORDS}
    weight = " + ".join(
        f"coalesce(CASE WHEN token = '{w}' THEN 1.0::DOUBLE WHEN starts_with(token, '{w}') THEN 0.375 * length(token)::DOUBLE / (length(token) + 0.3 * (length(token) - {len(w)})) WHEN levenshtein(token, '{w}') <= {most[w]} THEN 0.45 * length(token)::DOUBLE / (length(token) + levenshtein(token, '{w}')) END, 0.0)"
        for w in MINI_WORDS
    )
    boost = "CASE field " + " ".join(f"WHEN '{n}' THEN {b}.0" for n, b in BOOSTS.items()) + " ELSE 1.0 END"
    return f"""WITH a AS ({ARTICLES}), f AS ({fields}), p AS (SELECT id, field, len(list_distinct(t)) AS n, unnest(t) AS token FROM f), q AS (SELECT id, field, n, token, count(*)::DOUBLE AS tf FROM p GROUP BY 1, 2, 3, 4),
    m AS (SELECT field, sum(len(list_distinct(t)))::DOUBLE / count(*) AS mean, count(*)::DOUBLE AS docs FROM f GROUP BY 1), h AS (SELECT field, token, count(*)::DOUBLE AS having_, {weight} AS w FROM q GROUP BY 1, 2)
    SELECT id, round(sum(w * {boost} * ln(1 + (docs - having_ + 0.5) / (having_ + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * n / mean)))), 6) AS score FROM q JOIN h USING (field, token) JOIN m USING (field) WHERE w > 0 GROUP BY 1"""


@query("se_mini", _mini_sql())
def mini(t):
    """The browser's search: any word, in nine fields with boosts, by prefix and nearly."""
    return ranking.fielded(mini_index(t), MINI_WORDS, BOOSTS).select("id", F.round("score", 6).alias("score"))


@query("pf_web_filter", _mini_sql().replace(" SELECT id, round(", ", z AS (SELECT id, round(", 1) + f") SELECT y.id, row_number() OVER (ORDER BY has_map_plan DESC, year DESC, y.id DESC) AS place FROM a y WHERE (y.id IN (SELECT id FROM z) OR y.id IN (SELECT doc_id FROM ({_bm25_sql(WIDE_PREFIXES, 'all')}))) AND year BETWEEN 1975 AND 2015 AND {_JOURNAL} IN ('src0', 'src1', 'src2', 'src3')")
def web_filter(t):
    """Hits of the fields and of the full text, of some journals and years, in the order in which a page shows them: relevance decides membership alone."""
    hits = ranking.fielded(mini_index(t), MINI_WORDS, BOOSTS).select("id").unionByName(ranking.bm25(documents_index(t), WIDE_PREFIXES, "all").select(F.col("doc_id").alias("id")))
    return shown(articles(t), hits, years=(1975, 2015), journals=("src0", "src1", "src2", "src3"))


def shown(rows: DataFrame, hits: DataFrame, years: tuple[int, int], journals: tuple[str, ...] = (), maps_only: bool = False) -> DataFrame:
    """id, place: the articles of hits within years and journals (all if there are none), those with maps first, then the latest, then the highest ids."""
    kept = rows.where(F.col("year").between(*years))
    if journals:
        kept = kept.where(F.coalesce("journal_id", F.lit(JOURNAL)).isin(*journals))
    if maps_only:
        kept = kept.where("has_map_plan")
    kept = kept.join(hits, "id", "left_semi").select("id", "has_map_plan", "year")
    return numbered(kept, [F.desc("has_map_plan"), F.desc("year"), F.desc("id")], "place").select("id", "place")

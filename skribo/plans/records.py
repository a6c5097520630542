"""Records parsed from running text, bounds of articles, detection rules, names and their inflections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.functions import detection as D
from skribo.functions import text as X
from skribo.operators import bounds, records
from skribo.plans.articles import ARTICLES, articles
from skribo.plans.audits import BAD_WORDS
from skribo.plans.base import query
from skribo.plans.texts import key_sql

_STRIP = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"
#: An issue is three documents; an article's title is the first eight words of its own.
_FOLDED = "list_transform(string_split(t, ''), lambda c: replace(lower(strip_accents(c)), 'ß', 'ss'))"
_LETTERS = "regexp_replace(replace(lower(strip_accents({})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_PLACE = "CASE WHEN length({n}) >= 4 AND strpos(substr(s, {k} + 1), {n}) > 0 THEN p[{k} + strpos(substr(s, {k} + 1), {n})] END"


@query(
    "sc_trim_bounds",
    rf"""WITH i AS (SELECT doc_id // 3 AS issue, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1),
    f AS (SELECT issue, t, {_FOLDED} AS x FROM i),
    g AS (SELECT issue, t, list_filter(list_transform(range(1, len(x) + 1), lambda k: struct_pack(p := k - 1, c := x[k])), lambda e: regexp_matches(e.c, '[\p{{L}}\p{{N}}]')) AS y FROM f),
    h AS (SELECT issue, t, array_to_string(list_transform(y, lambda e: e.c), '') AS s, flatten(list_transform(y, lambda e: list_transform(range(length(e.c)), lambda z: e.p))) AS p FROM g),
    a AS (SELECT doc_id, doc_id // 3 AS issue, array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 8), ' ') AS title FROM documents),
    b AS (SELECT a.*, t, s, p, {_LETTERS.format('title')} AS n FROM a JOIN h USING (issue)),
    c AS (SELECT *, {_PLACE.format(n='n', k='0')} AS found FROM b),
    d AS (SELECT *, CASE WHEN found < length(t) * 0.85 THEN found ELSE 0 END AS st FROM c),
    e AS (SELECT *, len(list_filter(p, lambda v: v < st + greatest(80, length(title)))) AS k FROM d),
    o AS (SELECT e.doc_id, min({_PLACE.format(n='o.n', k='e.k').replace('substr(s', 'substr(e.s').replace('p[', 'e.p[')}) FILTER (WHERE {_PLACE.format(n='o.n', k='e.k').replace('substr(s', 'substr(e.s').replace('p[', 'e.p[')} > e.st + 120) AS en FROM e LEFT JOIN b o ON o.issue = e.issue AND o.doc_id > e.doc_id GROUP BY 1),
    q AS (SELECT doc_id, t, st, least(length(t), en) AS en, {_STRIP.format('substr(t, st + 1, least(length(t), en) - st)')} AS cut FROM e JOIN o USING (doc_id))
    SELECT doc_id, CASE WHEN length(cut) >= 80 THEN st ELSE 0 END::BIGINT AS start_char, CASE WHEN length(cut) >= 80 THEN en ELSE length(t) END::BIGINT AS end_char, length(cut) >= 80 AND (st > 0 OR en < length(t)) AS was_cut, sha1(CASE WHEN length(cut) >= 80 THEN cut ELSE t END) AS sha1 FROM q""",
)
def trim_bounds(t):
    words = F.array_remove(F.split("text", r"\s+"), "")
    docs = t("documents").select(F.floor(F.col("doc_id") / 3).alias("issue"), "doc_id", "text", F.array_join(F.slice(words, 1, 8), " ").alias("title"))
    issues = docs.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title", "text"))).alias("a"))
    whole = issues.select(F.array_join("a.text", "\n").alias("text"), "a", F.explode("a").alias("own"))
    later = F.transform(F.filter("a", lambda x: x["doc_id"] > F.col("own.doc_id")), lambda x: x["title"])
    rows = whole.select("own.doc_id", "text", F.col("own.title").alias("title"), later.alias("next"))
    return bounds.trimmed(rows, "text", "title", "next").select("doc_id", "start_char", "end_char", "was_cut", F.sha1("trimmed").alias("sha1"))


_LINES = ["Mapa jaskyne, mierka 1:500", "Foto: vchod a plan", "Plán práce na rok", "Zameral a kreslil, legenda", "Dĺžka jaskyne", "Obr. 1. Pôdorys"]
_TEXT_SQL = f"[{', '.join(repr(x) for x in _LINES)}][doc_id % 6 + 1] || chr(10) || text"
_F = f"trim(regexp_replace({{}}, '\\s+', ' ', 'g'))".format("replace(lower(strip_accents(regexp_replace(t, '([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])', '\\1\\2', 'g'))), 'ß', 'ss')")


@query(
    "sc_text_map",
    rf"""WITH a AS (SELECT doc_id, {_TEXT_SQL} AS t FROM documents),
    b AS (SELECT doc_id, {_F} AS f, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) BETWEEN 3 AND 140 AND NOT regexp_matches(x, '^\d+$')) AS l FROM a),
    c AS (SELECT doc_id, f, len(list_filter(l, lambda x: regexp_matches(strip_accents(lower(x)), '\bfoto(grafia)?\b|foto\s*:'))) > 0 AS photo,
      len(list_filter(l, lambda x: NOT regexp_matches(strip_accents(lower(x)), '\bfoto(grafia)?\b|foto\s*:') AND regexp_matches(x, '(^|[.!?:;,]\s+|\s\s+)(Mapa|Mapka|Pôdorys|Podorys|[Pp]l[áa]n|[Rr]ez|[Pp]rierez|[Nn]áčrt|[Nn]acrt|[Pp]rofil)($|[^\p{{L}}\p{{N}}_])'))) > 0 AS cap FROM b),
    d AS (SELECT doc_id, f, photo, cap, CASE WHEN cap THEN 4.0 WHEN regexp_matches(f, '\bmap(a|ka)\b') THEN 1.6 ELSE 0 END
      + CASE WHEN regexp_matches(f, '\bpodorys\b|\bplan\b|\brozvinuty rez\b|\bprierez\b|\bprofil\b|\brez na rovinu\b') THEN 1.4 ELSE 0 END
      + CASE WHEN regexp_matches(f, '\bmierka\b|\bmeritko\b|\b1\s*[:/]\s*\d{{2,5}}\b') THEN 0.8 ELSE 0 END
      + CASE WHEN regexp_matches(f, '\bzamerali?\b|\bkreslili?\b|\bzamerane\b|\bdokumentovali\b') THEN 0.7 ELSE 0 END
      + CASE WHEN regexp_matches(f, '\blegenda\b|\bpolygon\b|\bmeracsk') THEN 0.7 ELSE 0 END
      + CASE WHEN regexp_matches(f, '\bdlzka\b|\bhlbka\b|\bprevysenie\b') AND regexp_matches(f, '\bjaskyn|\bpriepast|\blokalit') THEN 0.5 ELSE 0 END AS s FROM c)
    SELECT doc_id, round(CASE WHEN regexp_matches(f, '\bplan\s+(prace|cinnosti|akcii|akcie|zasadnutia|vystavby|rozvoja|podujati|vyletu)\b') THEN least(CASE WHEN photo AND NOT cap THEN least(s, 1.6) ELSE s END, 0.8) WHEN photo AND NOT cap THEN least(s, 1.6) ELSE s END::DOUBLE, 3)::DOUBLE AS score FROM d""",
)
def text_map(t):
    """Every document below one of six lines."""
    line = F.element_at(F.array(*[F.lit(x) for x in _LINES]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t("documents").select("doc_id", D.map_score(F.concat(line, F.lit("\n"), "text")).alias("score"))


_BAD = "|".join(BAD_WORDS)
_COUNT = "len(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)), lambda x: x IN (" + ", ".join(f"'{w}'" for w in BAD_WORDS) + "))))"
_WORDS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'))"


_T = lambda of, least: f"list_filter(regexp_split_to_array(lower({of}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= {least})"
_IN = lambda words: f"len(list_filter({words}, lambda w: contains(array_to_string({_T('r', 1)}, ' '), w)))"
_HELD = f"""({_IN(f"({_T('title', 5)})[1:8]")} + 3 * {_IN(f"flatten(list_transform(authors, lambda s: {_T("split_part(s, ',', 1)", 4)}))")} + {_IN(f"({_T('abstract', 6)})[1:12]")})"""


@query(
    "sc_reocr",
    f"""WITH a AS (SELECT doc_id, text AS o, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '{_BAD}', 'word', 'g') WHEN 1 THEN substr(text, 1, length(text) // 2) ELSE '' END AS r FROM documents),
    b AS (SELECT *, {_COUNT.format('o')} AS ob, {_COUNT.format('r')} AS rb, {_WORDS.format('o')} AS ow, {_WORDS.format('r')} AS rw FROM a)
    SELECT doc_id, CASE WHEN trim(o) = '' THEN 'empty_text' WHEN length(o) < 300 THEN 'too_short_to_judge' WHEN doc_id % 2 = 0 AND ob >= 2 THEN 'font_unicode_map_missing_and_bad_tokens' WHEN ob >= 4 THEN 'bad_tokens' ELSE 'quality_ok' END AS layer,
    CASE WHEN trim(r) = '' THEN 'ocr_empty' WHEN trim(o) <> '' AND length(r) < greatest(200, floor(length(o) * 0.55)) AND rb < ob AND ow > 0 AND rw >= greatest(50, floor(ow * 0.8)) THEN 'fewer_bad_tokens_with_comparable_words'
      WHEN trim(o) <> '' AND length(r) < greatest(200, floor(length(o) * 0.55)) THEN 'ocr_too_short' WHEN rb < ob THEN 'fewer_bad_tokens' WHEN trim(o) = '' THEN 'original_empty' ELSE 'not_better' END AS verdict, {_HELD} AS article_score FROM b JOIN ({ARTICLES}) y ON y.id = doc_id""",
)
def reocr(t):
    """Whether texts are to be read again, whether the second reading is taken (it has the bad words mended, or is half the text, or is empty), and how much of its article it holds."""
    new = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", _BAD, "word")).when(F.col("doc_id") % 3 == 1, F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))).otherwise("")

    def counted(c: str):
        w = X.runs(F.col(c), underscore=True)
        return F.size(F.array_distinct(F.filter(F.transform(w, F.lower), lambda x: x.isin(*BAD_WORDS)))).alias(f"{c}_bad"), F.size(w).alias(f"{c}_words")

    rows = t("documents").select("doc_id", F.col("text").alias("old"), new.alias("new")).select("*", *counted("old"), *counted("new"))
    layer = D.needs_ocr(F.col("old"), F.col("old_bad"), F.col("doc_id") % 2 == 0)
    verdict = D.ocr_verdict(F.col("old"), F.col("new"), F.col("old_bad"), F.col("new_bad"), F.col("old_words"), F.col("new_words"))
    known = articles(t).select(F.col("id").alias("doc_id"), "title", "authors", "abstract")
    score = D.article_score(F.col("new"), F.col("title"), F.col("authors"), F.col("abstract"))
    return rows.join(known, "doc_id").select("doc_id", layer.alias("layer"), verdict.alias("verdict"), score.alias("article_score"))


_EXTRAS = ["", "3 obr.", "2 tab., res.", "12 pl. j., lit., map."]


@query("sc_title_extras", f"SELECT p_partkey, p_name AS title, [{', '.join(repr(x) for x in _EXTRAS)}][p_size % 4 + 1] AS extras FROM part")
def title_extras(t):
    """Extras are put behind each name and peeled off."""
    extras = F.element_at(F.array(*[F.lit(x) for x in _EXTRAS]), F.col("p_size") % 4 + 1)
    title, found = D.title_extras(F.when(extras == "", F.col("p_name")).otherwise(F.concat_ws(", ", "p_name", extras)))
    return t("part").select("p_partkey", title.alias("title"), F.array_join(found, ", ").alias("extras"))


_PATTERN = r"""'\b' || array_to_string(list_transform(string_split(k, ' '), lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') OR length(w) <= 3 THEN w WHEN length(w) <= 5 THEN w || '[a-z0-9]*' ELSE left(w, length(w) - 1) || '[a-z0-9]*' END), ' +') || '\b'"""


@query("sc_inflect", rf"""WITH p AS (SELECT item_id, {_PATTERN} AS pattern FROM (SELECT item_id, {key_sql("array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ')")} AS k FROM benchmark)), d AS MATERIALIZED (SELECT doc_id, {key_sql('text')} AS k FROM documents)
    SELECT item_id, doc_id FROM p JOIN d ON regexp_matches(k, pattern)""")
def inflect(t):
    """Documents that mention the first three words of an item, with any endings: what the longest word begins with blocks, the pattern verifies."""
    phrase = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    longest = F.array_max(F.transform(F.split(X.normalize_key(phrase), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = t("benchmark").select("item_id", D.inflected(phrase).alias("pattern"), F.substring(longest, 1, 4).alias("begins"))
    docs = t("documents").select("doc_id", X.normalize_key(F.col("text")).alias("key"))
    begins = F.explode(F.array_distinct(F.transform(F.split("key", " "), lambda w: F.substring(w, 1, 4)))).alias("begins")
    pairs = docs.select("doc_id", begins).join(items, "begins").select("item_id", "doc_id", "pattern")
    return pairs.join(docs, "doc_id").where(F.expr("key rlike pattern")).select("item_id", "doc_id")


_AREAS = (("South", ("lom[0-4]\\b", "juzn")), ("North", ("lom", "severn")))


@query("sc_cave_infer", """SELECT p_partkey, name, CASE WHEN regexp_matches('lom' || p_size, 'lom[0-4]\\b') THEN 'South' ELSE 'North' END AS area, CASE WHEN p_partkey % 4 = 0 THEN 'registered' WHEN p_partkey % 4 = 1 THEN 'explicit' ELSE 'inferred' END AS via FROM (SELECT p_partkey, p_size, unnest(CASE WHEN p_partkey % 4 = 0 THEN ['Registered ' || p_partkey, 'Special'] WHEN p_partkey % 4 = 1 THEN ['Named ' || p_size]
    ELSE ['Jaskyňa Wolf' || p_partkey || ' mala', 'Priepasť Wolf' || p_partkey || ' hlboka', 'Lom' || p_size || ' diera'] END) AS name FROM part)""")
def cave_infer(t):
    """Names of places by priority: registered ones (with special ones), else those that are told, else those that a text names; and their area by the first rule that its text answers."""
    i, n = F.col("p_partkey"), F.concat(F.lit("Wolf"), F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("v jaskyni "), n, F.lit(" mala; tam. priepasť "), n, F.lit(" hlboka v lese. "), F.lit("Lom"), F.col("p_size").cast("string"), F.lit(" diera."))
    number, none = i.cast("string"), F.array().cast("array<string>")
    registered = F.when(i % 4 == 0, F.array(F.concat(F.lit("Registered "), number))).otherwise(none)
    told = F.when(i % 4 == 1, F.array(F.concat(F.lit("Named "), F.col("p_size").cast("string")), F.lit("x"))).otherwise(none)
    found = D.names_by_priority(registered, told, D.inferred_names(text), F.array(F.lit("Special")))
    parts = t("part")  # few bytes, but much to do for each row
    rows = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism, "p_partkey").select("p_partkey", found.alias("found"), D.area_of(text, _AREAS).alias("area"))
    return rows.select("p_partkey", F.explode("found.names").alias("name"), "area", "found.via")


@query("io_prose_parse", "SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, 'Novák, J.; Kováč, P.' AS authors, 'Order ' || o_orderkey AS title, '3-5' AS pages, '2 obr.; res.' AS extras, year(o_orderdate) AS year, 'V.' AS volume, month(o_orderdate)::VARCHAR AS issue, o_orderpriority || ' note' AS abstract FROM orders")
def prose_parse(t):
    """A bibliography made of each customer's orders, and parsed."""
    orders = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate", "o_orderpriority"))).alias("o"))

    def entry(x, k):
        head = F.format_string("Ročník %s (V.)\nČíslo %s\n%s. Novák, J., Kováč, P.: Order", F.year(x["o_orderdate"]), F.month(x["o_orderdate"]), k + 1)
        return F.concat(head, F.lit("\n"), x["o_orderkey"].cast("string"), F.lit(", 2 obr., res., s. 3 – 5\n77\n"), x["o_orderpriority"], F.lit(" note"))

    return records.parsed(orders.select(F.col("o_custkey").alias("file"), F.array_join(F.transform("o", entry), "\n").alias("text")), "file", "text", records.bibliography, records.BIBLIOGRAPHY)


@query("io_register_parse", """SELECT s_suppkey // 50 AS file, '7.' || s_suppkey AS cave_number, CASE WHEN s_suppkey % 150 = 69 THEN '1' WHEN s_suppkey % 3 = 0 THEN '7.' || s_suppkey ELSE s_suppkey::VARCHAR END AS registry_number, '7' AS list_number, s_name AS official_name, n_name || ';second' AS aliases, s_name || ';' || n_name || ';second' || CASE WHEN s_suppkey % 2 = 0 THEN ';Other ' || s_suppkey || ' a' ELSE '' END AS names,
    CASE WHEN s_suppkey % 50 < 20 THEN 'Vrch' ELSE 'Iný' END AS celok, CASE WHEN s_suppkey % 50 < 20 THEN 'Strana' ELSE '' END AS podcelok, '' AS "cast" FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def register_parse(t):
    """A register of fifty suppliers a file, in two regions, with a register of names beside it, and parsed."""
    rows, i = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey")
    told = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(", r. č.\n"), i.cast("string")))
    line = F.concat(F.when(i % 50 == 20, "r. č. 1\nIný\n").otherwise(""), F.format_string("7. %s. %s (%s,\nsecond)\n - k. ú. Obec%s", "s_suppkey", "s_name", "n_name", told))
    made = rows.groupBy(F.floor(i / 50).alias("file")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))).alias("x"))
    other = rows.where("s_suppkey % 2 = 0").select(F.floor(i / 50).alias("file"), F.format_string("Other  %s a   7.%s.\nno number", "s_suppkey", "s_suppkey").alias("text"))
    found = records.register(made.select("file", F.concat(F.lit("Vrch, Strana\n"), F.array_join("x.l", "\n")).alias("text")), "file", "text", records.name_register(other, "file", "text"))
    return found.withColumns({c: F.array_join(c, ";") for c in ("aliases", "names")})


@query("wn_next_match", "SELECT conv_id, 'Role, ' || upper(left(role, 1)) || '.' AS authors, 'Napísal ' || upper(left(role, 1)) || '. Role' AS line, turn AS place, CASE WHEN count(*) OVER (PARTITION BY conv_id) <= 4 THEN 0.92 ELSE 0.84 END::DOUBLE AS confidence FROM conversations QUALIFY turn = 0")
def next_match(t):
    """A signature is put in the place of each conversation's first turn's text, and found."""
    line = F.when(F.col("turn") == 0, F.concat(F.lit("Napísal "), F.upper(F.substring("role", 1, 1)), F.lit(". Role"))).otherwise(F.concat(F.lit("1: "), "text"))
    made = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return records.signatures(made.select("conv_id", F.col("x.l").alias("lines"), F.transform("x", lambda x: F.lit(0.0)).alias("heights")), "conv_id", "lines", "heights")


_PAGE = "row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id)"


@query("sc_toc", f"""WITH p AS (SELECT doc_id // 50 AS issue, {_PAGE} AS page, doc_id % 50 = 7 AND doc_id // 50 % 2 = 0 AS hit FROM documents)
    SELECT issue, page FROM p WHERE issue % 2 = 1 AND page <= 4 UNION ALL SELECT q.issue, q.page FROM p JOIN p q ON q.issue = p.issue AND abs(q.page - p.page) <= 1 WHERE p.hit""")
def toc(t):
    """Fifty documents an issue; every other issue has a contents page."""
    marked = F.when((F.col("doc_id") % 50 == 7) & (F.floor(F.col("doc_id") / 50) % 2 == 0), F.concat(F.lit("O B S A H\n"), "text")).otherwise(F.col("text"))
    docs = t("documents").select(F.floor(F.col("doc_id") / 50).alias("issue"), (F.col("doc_id") % 50 + 1).alias("page"), marked.alias("text"))
    return records.contents_pages(docs, "issue", "page", "text")

"""Text functions, quality rules, chunks and search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.operators import chunks, ranking
from skribo.plans.base import index_of, query

#: DuckDB's form of folding.
_FOLD = "replace(lower(strip_accents({})), 'ß', 'ss')"


def key_sql(column: str) -> str:
    return f"trim(regexp_replace({_FOLD.format(column)}, '[^a-z0-9]+', ' ', 'g'))"


@query("sc_normalize_key", f"SELECT doc_id, {key_sql('text')} AS key FROM documents")
def normalize_key(t):
    return t("documents").select("doc_id", X.normalize_key(F.col("text")).alias("key"))


@query("sc_fold_text", f"SELECT doc_id, trim(regexp_replace({_FOLD.format(chr(114) + 'egexp_replace(text, $$([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])$$, $$\\1\\2$$, $$g$$)')}, '\\s+', ' ', 'g')) AS folded FROM documents")
def fold_text(t):
    return t("documents").select("doc_id", X.fold_text(F.col("text")).alias("folded"))


@query("sc_slug", f"SELECT page_id, coalesce(nullif(replace({key_sql('url')}, ' ', '-'), ''), 'x') AS slug, left(sha1(url), 10) AS cache_key FROM pages")
def slug(t):
    return t("pages").select("page_id", X.slug(F.col("url")).alias("slug"), F.substring(F.sha1("url"), 1, 10).alias("cache_key"))


@query(
    "sc_clean_fulltext",
    r"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, chr(12), chr(10)), '(?m)^\s*-+\s*\d{1,4}\s*-+\s*$', '', 'g') t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') t FROM a)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '\A\s+|\s+\z', '', 'g') AS cleaned FROM b""",
)
def clean_fulltext(t):
    return t("documents").select("doc_id", X.clean_fulltext(F.col("text")).alias("cleaned"))


@query(
    "sc_cleanup_hidden",
    r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '\r\n|\r|\f', chr(10), 'g') t FROM documents),
    b AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', ' ', 'g'), '\p{Cf}', '', 'g') t FROM a),
    c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), ' {3,}', ' ', 'g') t FROM b)
    SELECT doc_id, t AS cleaned, (length(text) - length(t))::BIGINT AS n_removed, t <> text AS changed FROM c""",
)
def cleanup_hidden(t):
    cleaned = X.cleanup_hidden(F.col("text"))
    return t("documents").select("doc_id", "text", cleaned.alias("cleaned")).select("doc_id", "cleaned", (F.length("text") - F.length("cleaned")).cast("long").alias("n_removed"), (F.col("cleaned") != F.col("text")).alias("changed"))


_CHUNKS = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS t FROM documents),
    w AS (SELECT doc_id, t, length(t) AS n, 0::BIGINT AS a, least(3200, length(t))::BIGINT AS e FROM d WHERE t <> ''
          UNION ALL
          SELECT doc_id, t, n, b, least(b + 3200, n) FROM (SELECT doc_id, t, n, cut - CASE WHEN cut - 350 > a THEN 350 ELSE 0 END AS b FROM (SELECT *, {cut} AS cut FROM w) WHERE cut < n)),
    c AS (SELECT doc_id, t, a, {cut} AS b FROM w),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS ordinal, a AS start_char, b AS end_char, regexp_replace(substr(t, a + 1, b - a), '\\A\\s+|\\s+\\z', '', 'g') AS text, length(t) AS n FROM c)"""
_LAST = "CASE WHEN position(reverse('{0}') IN reverse(substr(t, a + 1, e - a))) > 0 THEN e - a - position(reverse('{0}') IN reverse(substr(t, a + 1, e - a))) - length('{0}') + 1 ELSE -1 END"
_CUT = "CASE WHEN e < n AND greatest(" + ", ".join(_LAST.format(m) for m in ("\n\n", ". ", "\n", "; ")) + ") > 1440 THEN a + greatest(" + ", ".join(_LAST.format(m) for m in ("\n\n", ". ", "\n", "; ")) + ") + 1 ELSE e END"
_CHUNKS = _CHUNKS.replace("{cut}", _CUT)


@query("sc_chunk", _CHUNKS + " SELECT doc_id, ordinal, start_char, end_char, text, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::BIGINT AS word_count FROM chunks")
def chunk(t):
    return chunks.chunk(t("documents"))


@query("sc_chunk_page", _CHUNKS + " SELECT doc_id, ordinal, greatest(1, least(1 + n // 3000, 1 + floor((start_char + end_char) / 2 / n * (1 + n // 3000))))::BIGINT AS page FROM chunks")
def chunk_page(t):
    """Pages are taken to have 3,000 characters."""
    docs = t("documents")
    lengths = docs.select("doc_id", F.length(F.regexp_replace("text", r"\A\s+|\s+\z", "")).alias("n"))
    rows = chunks.chunk(docs).join(lengths, "doc_id")
    last = (F.lit(1) + F.floor(F.col("n") / 3000)).cast("long")
    return rows.select("doc_id", "ordinal", chunks.chunk_page(F.lit(1).cast("long"), last, F.col("start_char"), F.col("end_char"), F.col("n")).cast("long").alias("page"))


@query("sc_chunk_id", _CHUNKS + " SELECT doc_id, ordinal, printf('a%06d-c%03d-%s', doc_id, ordinal, left(sha1(text), 12)) AS chunk_id FROM chunks")
def chunk_id(t):
    return chunks.chunk(t("documents")).select("doc_id", "ordinal", chunks.chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("text")).alias("chunk_id"))


def _bm25_sql(prefixes: list[str], mode: str, source: str = "documents", key: str = "doc_id") -> str:
    tokens = f"list_filter(regexp_split_to_array({_FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    counts = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{p}')))::DOUBLE AS f{k}" for k, p in enumerate(prefixes))
    every, some = (by.join(f"f{k} > 0" for k in range(len(prefixes))) for by in (" AND ", " OR "))
    totals = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS d{k}" for k in range(len(prefixes)))
    score = " + ".join(f"greatest(ln((docs - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(len(prefixes)))
    found = {"any": some, "all": every, "first_all": f"CASE WHEN whole > 0 THEN {every} ELSE {some} END"}[mode]
    return f"""SELECT {key}, -({score}) AS score FROM (SELECT {key}, len(t) AS n, {counts} FROM (SELECT {key}, {tokens} AS t FROM {source})) c,
        (SELECT count(*) AS docs, avg(n) AS mean, {totals}, count(*) FILTER (WHERE {every}) AS whole FROM (SELECT len(t) AS n, {counts} FROM (SELECT {tokens} AS t FROM {source}))) WHERE {found}"""


#: Questions that the search operators answer on the test tables, with their prefixes; no document has all of the first one's.
QUESTION, PREFIXES = "Thisa fromy Mêntation", ["this", "from", "mentation"]
WIDE, WIDE_PREFIXES = "thisa fromy", ["this", "from"]


def documents_index(t) -> ranking.Index:
    return index_of("documents", [t("documents")], lambda: (t("documents"), "doc_id", {"text": F.col("text")}))


@query("se_tokenize", f"SELECT doc_id, list_aggregate(list_transform(list_filter(string_split({key_sql('text')}, ' '), lambda x: length(x) > 1)[1:5], lambda x: x), 'string_agg', ' ') AS tokens FROM documents WHERE length({key_sql('text')}) > 1 AND len(list_filter(string_split({key_sql('text')}, ' '), lambda x: length(x) > 1)) > 0")
def tokenize(t):
    found = F.slice(F.filter(F.split(X.normalize_key(F.col("text")), " "), lambda x: F.length(x) > 1), 1, 5)
    return t("documents").select("doc_id", F.array_join(found, " ").alias("tokens")).where("tokens <> ''")


@query("se_bm25", f"SELECT doc_id, round(score, 9) AS score FROM ({_bm25_sql(PREFIXES, 'first_all')}) ORDER BY score, doc_id LIMIT 10")
def bm25(t):
    """The ten best documents for a question: those with all of its words, or with any where none has all."""
    index = documents_index(t)
    found = ranking.bm25(index, ranking.query_prefixes(index.postings.sparkSession, QUESTION), "first_all")
    return found.orderBy("score", "doc_id").limit(10).select("doc_id", F.round("score", 9).alias("score"))


@query("jn_fts", f"SELECT s.doc_id, lang, source, round(score, 9) AS score FROM ({_bm25_sql(WIDE_PREFIXES, 'all')}) s JOIN documents d USING (doc_id)")
def fts(t):
    """Scored hits with their articles."""
    index = documents_index(t)
    found = ranking.bm25(index, ranking.query_prefixes(index.postings.sparkSession, WIDE), "all")
    return found.join(t("documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", F.round("score", 9).alias("score"))


_TURNS = _bm25_sql(WIDE_PREFIXES, "first_all", "(SELECT conv_id * 1000 + turn AS tid, text FROM conversations)", "tid")


@query("ag_min_score", f"SELECT tid // 1000 AS conv_id, round(min(score), 9) AS best, count(*) AS n FROM ({_TURNS}) GROUP BY 1")
def min_score(t):
    """The best score of each conversation's turns."""
    turns = lambda: t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tid"), "text")
    index = index_of("turns", [t("conversations")], lambda: (turns(), "tid", {"text": F.col("text")}))
    scored = ranking.bm25(index, WIDE_PREFIXES, "first_all")
    return scored.groupBy(F.floor(F.col("tid") / 1000).cast("long").alias("conv_id")).agg(F.round(F.min("score"), 9).alias("best"), F.count("*").alias("n"))


@query("sc_pages", r"""SELECT o_orderkey AS id, pages, try_cast(nullif(regexp_extract(pages, '^\s*(\d+)', 1), '') AS BIGINT) AS first_page,
    greatest(try_cast(nullif(regexp_extract(pages, '^\s*(\d+)', 1), '') AS BIGINT), coalesce(try_cast(nullif(regexp_extract(pages, '^\s*\d+\s*-\s*(\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(pages, '^\s*(\d+)', 1), '') AS BIGINT))) AS last_page
    FROM (SELECT o_orderkey, (o_custkey % 90)::VARCHAR || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-' || (o_custkey % 97)::VARCHAR ELSE ' s.' END AS pages FROM orders)""")
def pages(t):
    first, last = X.page_bounds(F.col("pages"))
    return page_strings(t("orders")).select("id", "pages", first.alias("first_page"), last.alias("last_page"))


def page_strings(orders):
    """Page ranges made of an order's numbers."""
    tail = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), (F.col("o_custkey") % 97).cast("string"))).otherwise(" s.")
    return orders.select(F.col("o_orderkey").alias("id"), F.concat((F.col("o_custkey") % 90).cast("string"), tail).alias("pages"), "o_custkey", "o_orderstatus")


_IMPORTED = "CASE WHEN o_orderstatus = 'F' AND o_custkey % 7 > 0 THEN o_custkey % 7 END"


@query("so_natural", "SELECT DISTINCT p_type || ' ' || p_size AS label, lower(regexp_extract(p_type || ' ' || p_size, '^\\D*')) || lpad(p_size::VARCHAR, 12, '0') AS sort_key FROM part")
def natural(t):
    label = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    return t("part").select(label.alias("label")).distinct().select("label", X.natural_key(F.col("label")).alias("sort_key"))


@query("sc_register_term", "SELECT DISTINCT p_name AS term, trim(regexp_replace(regexp_replace(p_name, '[\\p{So}\\p{Sk}\\x{FE0F}]', '', 'g'), '\\s+', ' ', 'g'), ' ,;') AS cleaned FROM part")
def register_term(t):
    cleaned = F.btrim(F.regexp_replace(F.regexp_replace("p_name", r"[\p{So}\p{Sk}\x{FE0F}]", ""), r"\s+", " "), F.lit(" ,;"))
    return t("part").select(F.col("p_name").alias("term"), cleaned.alias("cleaned")).distinct()

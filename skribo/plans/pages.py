"""Pages, filters of texts, chunks put together and snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.functions import pages as P
from skribo.functions import sets as S
from skribo.functions import text as X
from skribo.operators import bounds, chunks
from skribo.plans.audits import AUDITED, audited
from skribo.plans.base import query
from skribo.plans.texts import _CHUNKS, _FOLD, key_sql

_POS = "CASE WHEN {0} > 0 THEN {0} END"
_I, _P, _O = "CASE WHEN o_orderstatus = 'F' AND o_custkey % 7 > 0 THEN o_custkey % 7 END", _POS.format("(o_custkey % 90)"), "coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 - 1 END, 2)"


@query(
    "sc_page_resolution",
    f"""SELECT o_orderkey AS id, coalesce({_I}, {_P} + {_O}, o_orderkey % 50)::BIGINT AS research, (coalesce({_I}, {_P}) + {_O})::BIGINT AS public, ({_P} + 2)::BIGINT AS bibliography, (coalesce({_I}, {_P}, 1) + {_O})::BIGINT AS "index",
    least(greatest(coalesce({_I}, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 80 END, {_P} + {_O}), 1), 60)::BIGINT AS extraction, (coalesce({_I}, {_P}, 1) + {_O})::BIGINT AS web FROM orders""",
)
def page_resolution(t):
    """The six rules by which reports find a physical page."""
    o, i, c = t("orders"), F.col("o_orderkey"), F.col("o_custkey")
    found = P.resolved(F.when(F.col("o_orderstatus") == "F", c % 7), c % 90, i % 50, F.when(i % 3 > 0, i % 3 - 1), F.when(i % 11 == 0, c % 80), F.lit(60))
    return o.select(i.alias("id"), *[x.cast("long").alias(n) for n, x in found.items()])


def _candidates_sql() -> str:
    first, last, count = "f", "greatest(coalesce(l, f), f)", "n"
    wanted = f"""CASE WHEN f IS NOT NULL AND f = {last} THEN [f - 1, f, f + 1, f + 2] WHEN {first} IS NOT NULL THEN [f, f + ({last} - f) // 2, {last}]
        WHEN s = 'page_out_of_range' AND {count} IS NOT NULL THEN [greatest(1, n - 2), greatest(1, n - 1), n] WHEN n IS NOT NULL THEN [1, greatest(1, (n + 1) // 2), n] ELSE [] END"""
    distinct = lambda l: f"list_filter({l}, lambda x, i: NOT list_contains(({l})[1:i - 1], x))"
    inside = lambda l: f"list_filter({l}, lambda x: x >= 1 AND (n IS NULL OR x <= n))"
    return f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 40 + 1 END AS f, CASE WHEN doc_id % 3 > 0 THEN doc_id % 40 + 1 + doc_id % 6 END AS l, CASE WHEN doc_id % 8 = 0 THEN 'page_out_of_range' ELSE 'ok' END AS s, CASE WHEN doc_id % 12 <> 4 THEN doc_id % 43 + 1 END AS n FROM documents),
    b AS (SELECT *, {inside(wanted)} AS w FROM a), c AS (SELECT *, ({distinct('w')})[1:3] AS k FROM b), d AS (SELECT *, {inside("flatten(list_transform([1, 2, 3, 4, 5], lambda d: [k[-1] + d, k[-1] - d]))")} AS m FROM c), e AS (SELECT *, k || m AS z FROM d)
    SELECT doc_id, coalesce(array_to_string(CASE WHEN len(k) = 0 THEN [] ELSE ({distinct('z')})[1:3] END, ','), '') AS pages,
      CASE WHEN f IS NULL OR l IS NULL OR doc_id % 5 = 0 THEN 0 ELSE greatest(0, least(f + 4, coalesce(n, f + 4)) - f) END AS probes FROM e"""


@query("pf_candidate_pages", _candidates_sql())
def candidate_pages(t):
    """Up to three pages worth a look, and how many shifted ranges an empty text is tried with."""
    i = F.col("doc_id")
    first, last = F.when(i % 4 > 0, i % 40 + 1), F.when(i % 3 > 0, i % 40 + 1 + i % 6)
    count = F.when(i % 12 != 4, i % 43 + 1)
    found = P.candidate_pages(first, last, F.when(i % 8 == 0, "page_out_of_range").otherwise("ok"), count)
    tried = P.probes(first, last, i % 5 == 0, count)
    return t("documents").select("doc_id", F.array_join(F.transform(found, lambda p: p.cast("string")), ",").alias("pages"), F.size(tried).cast("long").alias("probes"))


@query("pf_substr_filter", f"SELECT doc_id, issue_score AS score FROM ({AUDITED}) WHERE contains({_FOLD.format('text')}, 'en') AND list_contains(codes, 'very_short_text') AND list_contains(severities, 'high') ORDER BY issue_score DESC, doc_id LIMIT 8")
def substr_filter(t):
    """The first eight records whose folded text holds a string, of a severity and with a code."""
    return substring_filter(audited(t), "text", "en", "high", "very_short_text").orderBy(F.desc("issue_score"), "doc_id").limit(8).select("doc_id", F.col("issue_score").alias("score"))


def substring_filter(rows, text: str, part: str, severity: str | None = None, code: str | None = None, state=None):
    """rows whose folded text holds the folded part, and that have an issue of the severity, one with the code, and the state (a condition), as far as they are given."""
    kept = rows.where(F.contains(X.fold(F.coalesce(F.col(text), F.lit(""))), X.fold(F.lit(part))))
    if severity:
        kept = kept.where(F.array_contains("issues.severity", severity))
    if code:
        kept = kept.where(F.array_contains("issues.code", code))
    return kept if state is None else kept.where(state)


_SET = "list_distinct(string_split({}, ' '))"


@query(
    "st_token_sets",
    f"""SELECT page_id, len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE AS jaccard, CASE WHEN contains(ka, kb) OR contains(kb, ka) THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END AS dice, len(list_intersect(a, b)) / len(a)::DOUBLE AS containment
    FROM (SELECT *, {_SET.format('ka')} AS a, {_SET.format('kb')} AS b FROM (SELECT page_id, {key_sql('url')} AS ka, {key_sql("CASE WHEN page_id % 9 = 0 THEN 'the ' || url || ' of' ELSE html END")} AS kb FROM pages))""",
)
def token_sets(t):
    """Likeness of addresses and whole pages by their words."""
    other = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("the "), "url", F.lit(" of"))).otherwise(F.col("html"))
    rows = t("pages").select("page_id", X.normalize_key(F.col("url")).alias("a"), X.normalize_key(other).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("page_id", S.jaccard(a, b).alias("jaccard"), S.dice(a, b).alias("dice"), S.containment(a, b).alias("containment"))


@query(
    "se_reassemble",
    _CHUNKS
    + """, l AS (SELECT doc_id, list({'t': text, 'a': start_char, 'e': end_char} ORDER BY ordinal) AS l FROM chunks GROUP BY 1)
    SELECT doc_id, list_reduce(l, lambda x, y: {'t': CASE WHEN x.e > y.a THEN x.t || substr(y.t, x.e - y.a + 1) WHEN x.e < y.a THEN x.t || chr(10) || chr(10) || y.t ELSE x.t || y.t END, 'a': y.a, 'e': y.e}).t AS text FROM l""",
)
def reassemble(t):
    return chunks.reassemble(chunks.chunk(t("documents")))


_HIT = "(regexp_matches(f, '^(thi|stat)'))"
_TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_PLAIN = "replace(lower(strip_accents(regexp_replace(w, '[^\\p{L}\\p{N}]+', '', 'g'))), 'ß', 'ss')"


@query(
    "se_snippet",
    f"""WITH a AS (SELECT doc_id, {_TOKENS} AS t FROM documents), h AS (SELECT doc_id, t, list_transform(t, lambda w: CASE WHEN starts_with({_PLAIN}, 'thi') OR starts_with({_PLAIN}, 'stat') THEN 1 ELSE 0 END) AS h FROM a), k AS (SELECT * FROM h WHERE list_sum(h) > 0),
    s AS (SELECT *, list_transform(range(1, greatest(1, len(t) - 23) + 1), lambda i: list_sum(h[i:i + 23])) AS s FROM k), b AS (SELECT *, list_position(s, list_max(s)) AS q FROM s),
    c AS (SELECT *, least(q - 1 + list_position(h[q:], 1), greatest(1, len(t) - 23)) AS p FROM b)
    SELECT doc_id, CASE WHEN p > 1 THEN '...' ELSE '' END || array_to_string(list_transform(range(p, least(p + 23, len(t)) + 1), lambda i: CASE WHEN h[i] = 1 THEN '[' || t[i] || ']' ELSE t[i] END), ' ') || CASE WHEN p + 23 < len(t) THEN '...' ELSE '' END AS snippet FROM c""",
)
def snippet(t):
    """Around the words of a question, of every document that has any."""
    rows = t("documents").select("doc_id", bounds.snippet(F.col("text"), ["thi", "stat"]).alias("snippet"))
    return rows.where("snippet IS NOT NULL")

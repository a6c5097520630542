"""The audit of texts, on documents that have been given statuses, sources, years and some damage by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.operators import audit as Q
from skribo.plans.base import query

#: Words that stand for those of a damaged text layer in the test tables.
BAD_WORDS = ("idiot", "moron", "scum", "stupid", "trash")
_BAD = ", ".join(f"'{w}'" for w in BAD_WORDS)
_DAMAGE = {19: "chr(65533) || chr(65533) || chr(65533)", 23: "repeat(chr(65533), 6)", 29: "chr(57344) || chr(3)", 31: "repeat(chr(8203), 30)", 37: "chr(888)", 41: "repeat('a-' || chr(10) || ' b-' || chr(10), 60)", 43: "repeat('x' || chr(9) || '  ', 510)"}
RECORDS = (
    "SELECT doc_id - (doc_id % 40 = 1)::INT AS id, doc_id, lang, 1970 + doc_id % 55 AS year, CASE WHEN doc_id % 13 = 0 THEN 'page_out_of_range' WHEN doc_id % 17 = 0 THEN '' ELSE 'ok' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'tesseract_ocr' WHEN doc_id % 3 = 1 THEN '' ELSE 'pdftotext' END AS text_source, "
    "CASE WHEN doc_id % 47 = 0 THEN ' ' ELSE text || " + " || ".join(f"CASE WHEN doc_id % {k} = 0 THEN {d} ELSE '' END" for k, d in _DAMAGE.items()) + " END AS text, doc_id % 3 + 1 AS pages FROM documents"
)


def records(t) -> DataFrame:
    i = F.col("doc_id")
    replaced = "�"
    damage = {19: replaced * 3, 23: replaced * 6, 29: "\x03", 31: "​" * 30, 37: "͸", 41: "a-\n b-\n" * 60, 43: "x\t  " * 510}
    text = F.concat("text", *[F.when(i % k == 0, d).otherwise("") for k, d in damage.items()])
    return t("documents").select(
        (i - (i % 40 == 1).cast("int")).alias("id"),
        "doc_id",
        "lang",
        (1970 + i % 55).alias("year"),
        F.when(i % 13 == 0, "page_out_of_range").when(i % 17 == 0, "").otherwise("ok").alias("status"),
        F.when(i % 3 == 0, "tesseract_ocr").when(i % 3 == 1, "").otherwise("pdftotext").alias("text_source"),
        F.when(i % 47 == 0, " ").otherwise(text).alias("text"),
        (i % 3 + 1).alias("n_pages"),
    )


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))::BIGINT"


_W = "[\\p{L}\\p{N}_]"
_PARTS = "string_split_regex(text, '-[ \\t]*\\n[ \\t]*')"
#: chr(888) is the one unassigned character of the records; RE2 has no class for them.
HIDDEN = {
    "control_chars": _count("[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F-\\x{9F}]"),
    "format_chars": _count("\\p{Cf}"),
    "private_use_chars": _count("\\p{Co}"),
    "other_hidden_chars": _count("\\x{0378}"),
    "replacement_chars": _count("\\x{FFFD}"),
    "hyphen_linebreaks": f"len(list_filter({_PARTS}, lambda x, i: i > 1 AND regexp_matches(x, '^{_W}') AND regexp_matches({_PARTS}[i - 1], '{_W}$')))::BIGINT",
    "multispace_runs": _count("[ \\t]{3,}"),
}


@query("sc_hidden_counts", f"SELECT doc_id, {', '.join(f'{c} AS {n}' for n, c in HIDDEN.items())} FROM ({RECORDS})")
def hidden_counts(t):
    return records(t).select("doc_id", *[c.alias(n) for n, c in X.hidden_counts(F.col("text")).items()])


SIGNALS = f"""SELECT *, length(text) AS chars, len(tokens) AS words, {_count('[áäčďéíĺľňóôŕšťúýžÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ]')} AS diacritics, len(bad) AS bad_tokens, array_to_string(bad, ',') AS bad_examples FROM (SELECT *,
    list_filter(list_filter(tokens, lambda x: lower(x) IN ({_BAD})), lambda x, i: list_position(list_transform(list_filter(tokens, lambda z: lower(z) IN ({_BAD})), lambda y: lower(y)), lower(x)) = i) AS bad FROM (SELECT *, regexp_extract_all(text, '{_W}+') AS tokens FROM ({RECORDS})))"""


def signals(t) -> DataFrame:
    return Q.signals(records(t), "text", F.col("n_pages"), BAD_WORDS)


@query("sc_text_metrics", f"SELECT doc_id, chars, words, diacritics, bad_tokens, coalesce(bad_examples, '') AS bad_examples, round(chars / pages, 6) AS chars_per_page, round(words / pages, 6) AS words_per_page FROM ({SIGNALS})")
def text_metrics(t):
    per = [F.round(F.col(c) / F.col("pages"), 6).alias(f"{c}_per_page") for c in ("chars", "words")]
    return signals(t).select("doc_id", "chars", "words", "diacritics", "bad_tokens", F.array_join("bad_examples", ",").alias("bad_examples"), *per)


_FULL = "regexp_replace(text, '\\s+', '', 'g') <> ''"
_RULES = [
    ("empty_text", "high", f"NOT ({_FULL})"),
    ("non_ok_status", "high", f"{_FULL} AND status NOT IN ('', 'ok')"),
    ("very_short_text", "high", f"{_FULL} AND (chars < 300 OR words < 30)"),
    ("low_text_density", "medium", f"{_FULL} AND chars / pages < 600 AND words / pages < 80"),
    ("residual_bad_diacritic_tokens", "medium", "bad_tokens >= 2"),
    ("replacement_characters", "high", "replacement_chars >= 5"),
    ("replacement_characters", "medium", "replacement_chars BETWEEN 1 AND 4"),
    ("control_characters", "medium", "control_chars > 0"),
    ("private_use_characters", "medium", "private_use_chars > 0"),
    ("other_hidden_characters", "medium", "other_hidden_chars > 0"),
    ("cleanup_format_characters", "low", "format_chars >= 25"),
    ("cleanup_hyphen_linebreaks", "low", "hyphen_linebreaks >= 100"),
    ("cleanup_multispace_layout", "low", "multispace_runs >= 500"),
]
AUDITED = f"""SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in _RULES)}], lambda x: x IS NOT NULL) AS codes, list_filter([{', '.join(f"CASE WHEN {c} THEN '{s}' END" for _, s, c in _RULES)}], lambda x: x IS NOT NULL) AS severities,
    ({' + '.join(f"CASE WHEN {c} THEN {Q.WEIGHTS.get(n, Q.SEVERITIES[s])} ELSE 0 END" for n, s, c in _RULES)})::BIGINT AS issue_score FROM (SELECT *, {', '.join(f'{c} AS {n}' for n, c in HIDDEN.items())} FROM ({SIGNALS}))"""


def audited(t) -> DataFrame:
    return Q.audited(records(t), "text", F.col("status"), F.col("n_pages"), BAD_WORDS)


@query("sc_classify", f"SELECT doc_id, array_to_string(codes, ',') AS codes, array_to_string(severities, ',') AS severities, issue_score AS score FROM ({AUDITED}) WHERE len(codes) > 0")
def classify(t):
    rows = audited(t).where(F.size("issues") > 0)
    return rows.select("doc_id", F.array_join("issues.code", ",").alias("codes"), F.array_join("issues.severity", ",").alias("severities"), F.col("issue_score").alias("score"))


_NORM = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"
GROUPS = f"SELECT sha1(n) AS hash, count(*) AS n, max(length(n)) AS chars, count(DISTINCT (lang, pages)) = 1 AS same_place FROM (SELECT *, {_NORM} AS n FROM ({RECORDS})) WHERE length(n) >= 500 GROUP BY 1 HAVING count(*) >= 2"


def duplicates(t) -> tuple[DataFrame, DataFrame]:
    return Q.duplicates(records(t), "doc_id", "text", ["lang", "n_pages"])


@query("ag_dup_groups", f"SELECT g.hash, n, chars, same_place, doc_id FROM ({GROUPS}) g JOIN (SELECT doc_id, sha1({_NORM}) AS hash FROM ({RECORDS}) WHERE length({_NORM}) >= 500) m ON g.hash = m.hash")
def dup_groups(t):
    """Exact duplicates after folding white space and case, of 500 characters at least: a row for each member, with what its group has."""
    groups, members = duplicates(t)
    return members.join(groups, "hash").select("hash", "n", "chars", "same_place", "doc_id")


@query(
    "ag_audit_summary",
    f"""WITH a AS ({AUDITED}), g AS ({GROUPS}), r AS (SELECT id, count(*) AS n FROM a GROUP BY 1 HAVING count(*) > 1) SELECT dimension, value, count(*) AS n FROM (
    SELECT 'records' AS dimension, '' AS value FROM a UNION ALL SELECT 'status', status FROM a UNION ALL SELECT 'text_source', coalesce(nullif(text_source, ''), 'pdftotext') FROM a UNION ALL SELECT CASE WHEN {_FULL} THEN 'with_text' ELSE 'without_text' END, '' FROM a
    UNION ALL SELECT 'with_issues', '' FROM a WHERE len(codes) > 0 UNION ALL SELECT 'issue', unnest(codes) FROM a UNION ALL SELECT 'severity', unnest(severities) FROM a UNION ALL SELECT 'bad_tokens', '>=' || k FROM a, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE bad_tokens >= k) GROUP BY 1, 2
    UNION ALL SELECT 'repeated_ids', '', count(*) FROM r UNION ALL SELECT 'records_of_repeated_ids', '', coalesce(sum(n), 0)::BIGINT FROM r
    UNION ALL SELECT 'duplicate_groups', '', count(*) FROM g UNION ALL SELECT 'duplicate_records', '', coalesce(sum(n), 0)::BIGINT FROM g UNION ALL SELECT 'duplicate_groups_same_pages', '', count(*) FILTER (WHERE same_place) FROM g""",
)
def audit_summary(t):
    return Q.summary(audited(t), "id", "text", F.col("status"), F.col("text_source"), duplicates(t)[0])


_REVIEW = [k for k, (n, _, _) in enumerate(_RULES) if n not in Q.AUTO_FIXABLE]
_PRIMARY = "list_max([" + ", ".join(f"CASE WHEN {c} THEN {{'weight': {Q.SEVERITIES[s]}, 'code': '{n}', 'severity': '{s}'}} END" for n, s, c in (_RULES[k] for k in _REVIEW)) + "])"
_CODES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in (_RULES[k] for k in _REVIEW)) + "], lambda x: x IS NOT NULL)"
QUEUED = f"""SELECT a.*, {_CODES} AS review, {_PRIMARY} AS prime, CASE WHEN len(codes) = 0 THEN 'none' WHEN a.doc_id % 53 < 3 THEN 'ignored' WHEN len({_CODES}) = 0 THEN 'auto' WHEN d.doc_id IS NOT NULL THEN 'resolved' ELSE 'active' END AS state
    FROM ({AUDITED}) a LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) d ON a.doc_id = d.doc_id"""


def queued(t) -> DataFrame:
    return Q.queue(audited(t), "doc_id", t("labels").where("quality = 1"), F.col("doc_id") % 53 < 3)


@query(
    "ag_queue_summary",
    f"""WITH q AS ({QUEUED}), o AS (SELECT count(*) FILTER (WHERE state = 'active') AS active_incidents, count(*) FILTER (WHERE state = 'active' AND prime.severity = 'high') AS high, count(*) FILTER (WHERE state = 'active' AND prime.severity = 'medium') AS medium,
    count(*) FILTER (WHERE state = 'active' AND prime.severity = 'low') AS low, min(year) FILTER (WHERE state = 'active') AS first_year, max(year) FILTER (WHERE state = 'active') AS last_year, count(*) FILTER (WHERE state = 'ignored') AS ignored_outer_matter,
    count(*) FILTER (WHERE state = 'auto') AS auto_fixable_records_excluded, count(*) FILTER (WHERE state = 'resolved') AS review_decisions_applied FROM q)
    SELECT name, n FROM (UNPIVOT o ON COLUMNS(*) INTO NAME name VALUE n) UNION ALL SELECT 'issue:' || code, count(*) FROM (SELECT unnest(review) AS code FROM q WHERE state = 'active') GROUP BY 1""",
)
def queue_summary(t):
    return Q.queue_summary(queued(t), "year")


@query("so_incidents", f"SELECT doc_id, prime.code AS primary_code, prime.weight::BIGINT AS severity, issue_score AS score, row_number() OVER (ORDER BY issue_score DESC, prime.weight DESC, year, doc_id) AS place FROM ({QUEUED}) WHERE state = 'active' ORDER BY place LIMIT 100")
def incidents(t):
    """The hundred most urgent incidents: a report of fixed length."""
    rows = queued(t).where("state = 'active'").select("doc_id", F.col("primary.code").alias("primary_code"), F.col("primary.weight").cast("long").alias("severity"), F.col("issue_score").alias("score"), "year")
    order = [F.desc("score"), F.desc("severity"), "year", "doc_id"]
    return rows.orderBy(*order).limit(100).select("*", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place")).drop("year")

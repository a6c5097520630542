"""Ordered rows: page ranges, best records, article dedupe, numbering, logs of runs, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skribo.operators import audit as Q
from skribo.operators import runs as R
from skribo.operators.numbering import numbered
from skribo.plans.articles import ARTICLES, JOURNAL, articles
from skribo.plans.audits import BAD_WORDS, SIGNALS, records
from skribo.plans.base import query
from skribo.plans.texts import key_sql


@query(
    "wn_infer_end",
    """WITH a AS (SELECT l_orderkey AS issue, l_linenumber AS pos, CASE WHEN min(l_partkey) % 11 > 0 THEN min(l_partkey % 60) END AS start, CASE WHEN min(l_suppkey) % 9 = 0 THEN min(l_partkey % 60) + 3 END AS given FROM lineitem GROUP BY 1, 2)
    SELECT a.issue, a.pos::BIGINT AS pos, a.start, coalesce(given, (SELECT arg_min(b.start, b.pos) FROM a b WHERE b.issue = a.issue AND b.pos > a.pos AND b.start > a.start) - 1, a.start) AS last_page FROM a""",
)
def infer_end(t):
    """One less than the first greater start that follows in the list, not than the least one."""
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("issue"), F.col("l_linenumber").alias("pos")).agg(
        F.when(F.min("l_partkey") % 11 > 0, F.min(F.col("l_partkey") % 60)).alias("start"), F.when(F.min("l_suppkey") % 9 == 0, F.min(F.col("l_partkey") % 60) + 3).alias("given")
    )
    return R.infer_ends(a, ["issue"], "pos", "start", "given").select("issue", F.col("pos").cast("long").alias("pos"), "start", "last_page")


@query(
    "wn_best_record",
    f"""SELECT id, line FROM (SELECT doc_id // 4 AS id, doc_id AS line, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' AND status = 'ok' THEN 5 WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN 3 WHEN status = 'ok' THEN 2 ELSE 0 END DESC,
    text_source = 'tesseract_ocr' DESC, bad_tokens, words DESC, length(text) DESC, doc_id % 5 DESC, doc_id) AS k FROM ({SIGNALS})) WHERE k = 1""",
)
def best_record(t):
    """The best of four records of each article, by seven parts of a rank."""
    rows = Q.signals(records(t), "text", F.col("n_pages"), BAD_WORDS).withColumn("id", F.floor(F.col("doc_id") / 4)).withColumn("stated", F.col("doc_id") % 5)
    rows = rows.select("id", "doc_id", "text", "status", "text_source", "bad_tokens", "words", "stated")
    return R.best_record(rows, "id", "text", "status", "text_source", "bad_tokens", "words", "stated", "doc_id").select("id", F.col("doc_id").alias("line"))


_FLAWED = ("nove vydanie",)


@query(
    "wn_dedupe_timeline",
    f"""WITH a AS ({ARTICLES}), b AS (SELECT *, length(title) % 7 AS y, CASE WHEN id % 4 = 0 THEN 'Nové vydanie' ELSE issue END AS i, split_part(pages, '-', 2) AS p FROM a)
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY y, {key_sql('title')}, list_transform(authors, lambda x: {key_sql('x')})[2:2], length(p) > 1 ORDER BY id % 4 > 0 DESC, pdf_url <> '' DESC, length(trim(abstract)) DESC, id DESC) AS k FROM b) WHERE k = 1""",
)
def dedupe_timeline(t):
    """Articles that repeat others in journal, year, folded title, authors and pages leave one."""
    rows = articles(t)
    long = F.length(F.split_part("pages", F.lit("-"), F.lit(2))) > 1
    rows = rows.select("id", F.lit(None).cast("string").alias("journal"), (F.length("title") % 7).alias("y"), "title", F.slice("authors", 2, 1).alias("authors"), long.cast("string").alias("p"), F.when(F.col("id") % 4 == 0, "Nové vydanie").otherwise(F.col("issue")).alias("i"), "pdf_url", "abstract")
    return R.distinct_articles(rows, "journal", "y", "title", "authors", "p", "i", "pdf_url", "abstract", "id", JOURNAL, _FLAWED).select("id")


_ISSUE = "CASE WHEN id % 13 = 0 THEN 'kongres' WHEN id % 7 = 0 THEN issue || '-' || (id % 3) ELSE issue END"


@query("wn_number", f"WITH a AS ({ARTICLES}) SELECT id, row_number() OVER (ORDER BY j <> '{JOURNAL}', j, year, volume, coalesce(try_cast(nullif(regexp_extract(i, '^(\\d+)', 1), '') AS BIGINT), 999), i, id) AS number, row_number() OVER (PARTITION BY j ORDER BY year, volume, coalesce(try_cast(nullif(regexp_extract(i, '^(\\d+)', 1), '') AS BIGINT), 999), i, id) AS in_journal FROM (SELECT *, coalesce(journal_id, '{JOURNAL}') AS j, {_ISSUE} AS i FROM a)")
def number(t):
    """The order of an export, numbered through and anew in each journal: the default journal first, then year, volume, issue as a number and as text."""
    i = F.col("id")
    issue = F.when(i % 13 == 0, "kongres").when(i % 7 == 0, F.concat_ws("-", "issue", (i % 3).cast("string"))).otherwise(F.col("issue"))
    rows = articles(t).select("id", F.coalesce("journal_id", F.lit(JOURNAL)).alias("j"), "year", "volume", issue.alias("i")).withColumn("n", F.coalesce(F.regexp_extract("i", r"^(\d+)", 1).try_cast("long"), F.lit(999)))
    order = ["year", "volume", "n", "i", "id"]
    every = numbered(rows.withColumn("other", F.col("j") != JOURNAL), ["other", "j", *order], "number")
    return numbered(every, order, "in_journal", ("j",)).select("id", "number", "in_journal")


@query("so_maps", "SELECT id, row_number() OVER (ORDER BY year, id) AS place FROM (SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'F')")
def maps(t):
    """Articles with maps, numbered through by year and id."""
    rows = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return numbered(rows, ["year", "id"], "place").select("id", "place")


@query("st_merge_replace", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_custkey % 20 <> 3 UNION ALL SELECT (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 20 <> 3) + row_number() OVER (ORDER BY o_orderkey), 'new' FROM orders WHERE o_custkey % 20 = 3")
def merge_replace(t):
    """Rows of the imported keys go, the new ones follow with fresh ids."""
    o = t("orders")
    kept = o.where("o_custkey % 20 <> 3").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    top = kept.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(o.where("o_custkey % 20 = 3").select("o_orderkey"), ["o_orderkey"], "n").join(F.broadcast(top))  # a single row
    return kept.unionByName(new.select((F.col("top") + F.col("n")).alias("id"), F.lit("new").alias("state")))


#: What the events of a user's log stand for.
EVENTS = {"run": "signup", "begin": "view", "end": "purchase", "skip": "error"}
_LOG = "SELECT *, event_id % 2 AS issue FROM events"
_STATS = f"""WITH e AS ({_LOG}), s AS (SELECT * FROM (SELECT *, coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM e) WHERE after = 0),
    b AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id, issue ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM s),
    d AS (SELECT user_id, epoch_us(ts) - epoch_us(begun) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM b WHERE event_type = 'purchase' AND ts >= begun),
    m AS (SELECT user_id, count(*) AS finished, count(*) FILTER (WHERE k <= 12) AS sample_count, sum(us) FILTER (WHERE k <= 12) / (count(*) FILTER (WHERE k <= 12))::DOUBLE / 1000000 AS avg_seconds FROM d GROUP BY 1),
    r AS (SELECT s.user_id, coalesce(any_value(finished), 0) AS finished, count(*) FILTER (WHERE event_type = 'error') AS skipped, coalesce(any_value(sample_count), 0) AS sample_count, any_value(avg_seconds) AS avg_seconds FROM s LEFT JOIN m ON s.user_id = m.user_id GROUP BY 1)"""


def stats(t):
    log = t("events").withColumn("issue", F.col("event_id") % 2)
    return R.runtime_stats(log, "user_id", "event_type", "issue", "ts", ["ts", "event_id"], EVENTS)


@query("wn_session", _STATS + " SELECT user_id, finished, skipped, sample_count, round(avg_seconds, 3) AS avg_seconds FROM r")
def session(t):
    """The last run of each log: what it finished and skipped, and the mean of its last twelve durations."""
    return stats(t).withColumn("avg_seconds", F.round("avg_seconds", 3))


@query(
    "wn_eta",
    _STATS + """ SELECT user_id, round(page, 3) AS page_eta, round(CASE WHEN avg_seconds IS NULL THEN NULL WHEN user_id % 4 <= 0 THEN 0.0 WHEN page IS NULL THEN (user_id % 4) * (avg_seconds + 5.0) ELSE page + greatest(user_id % 4 - 1, 0) * (avg_seconds + 5.0) END, 3) AS overall_eta
    FROM (SELECT *, CASE WHEN finished > 0 AND finished < 6 AND skipped > 0 THEN (skipped * 60)::DOUBLE / finished * (6 - finished) END AS page FROM r)""",
)
def eta(t):
    """Time left of the current issue by its pages, and of all issues by the mean and the pause."""
    page = R.page_eta(F.col("skipped") * 60, F.col("finished"), F.lit(6))
    left = F.col("user_id") % 4
    rows = stats(t).withColumn("page", page)
    return rows.select("user_id", F.round("page", 3).alias("page_eta"), F.round(R.overall_eta(left, F.col("page"), F.col("avg_seconds"), F.lit(5.0)), 3).alias("overall_eta"))


_STATE = "CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' ELSE event_type END"


@query(
    "wn_current",
    f"""WITH i AS (SELECT user_id, event_id, ts, {_STATE} AS status FROM events), c AS (SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE status = 'running') AS current FROM i GROUP BY 1)
    SELECT i.user_id, event_id, current, CASE WHEN i.user_id % 2 = 0 AND status = 'running' THEN 'interrupted' ELSE status END AS status, CASE WHEN i.user_id % 2 = 0 AND status = 'running' THEN 'runner_restarted_after_stale_running_state' END AS interrupt_reason FROM i JOIN c ON i.user_id = c.user_id""",
)
def current(t):
    """The running item of each state, and what a new run makes of items that still run."""
    state = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type"))
    items = t("events").select("user_id", "event_id", "ts", state.alias("status"))
    known = R.current_item(items, "user_id", "event_id", "status", "ts")
    marked = R.interrupted(items, "status", F.when(F.col("user_id") % 2 == 0, "running").otherwise("done"))
    return marked.join(known, "user_id").select("user_id", "event_id", "current", "status", "interrupt_reason")


MARKER = "\n\n[...]"
_TRIMMED = "regexp_replace(regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_BUDGET = f"""SELECT *, least(length(x), left_) AS used, CASE WHEN length(x) <= left_ THEN x WHEN left_ > 0 THEN regexp_replace(left(x, left_), '\\s+\\z', '') || chr(10) || chr(10) || '[...]' ELSE '' END AS shown
    FROM (SELECT *, greatest(0, 600 - coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_ FROM (SELECT *, {_TRIMMED} AS x FROM conversations))"""


def budget_of(t):
    return R.budgeted(t("conversations"), ["conv_id"], ["turn"], "text", 600, MARKER)


@query("wn_budget", f"SELECT conv_id, turn, used::BIGINT AS used, shown FROM ({_BUDGET})")
def budget(t):
    """Each conversation's turns within a budget of 600 characters, the cut one marked."""
    return budget_of(t).select("conv_id", "turn", "used", "shown")


@query("se_brief", f"SELECT conv_id, string_agg(shown, chr(10) ORDER BY turn) AS brief FROM ({_BUDGET}) WHERE used > 0 GROUP BY 1")
def brief(t):
    rows = budget_of(t).where("used > 0")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shown"))), lambda x: x["shown"]), "\n").alias("brief"))

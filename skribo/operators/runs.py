"""Logs of runs, page ranges, records of the same thing, budgets: operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skribo.functions.text import normalize_key

#: Durations that a mean is taken of.
RECENT = 12


def infer_ends(rows: DataFrame, by: list[str], order: str, start: str, end: str) -> DataFrame:
    """rows with last_page: the end that is given, else one less than the next start in the list that is greater, else the start.

    Null starts are skipped. A list (a value of by) is folded once, from its last row to its first, keeping the starts that may still be
    the next greater one of a row before: those that no later row hides.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.struct(*rows.columns).alias("row"))))
    kind = f"array<struct<row:{rows.select(F.struct(*rows.columns).alias('r')).schema['r'].dataType.simpleString()},last_page:bigint>>"
    empty = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast(kind).alias("done"))

    def add(acc: Column, x: Column) -> Column:
        # open holds starts, the nearest last; those not above this one can't be the next greater one of what comes before it either
        above = F.filter(acc["open"], lambda s: x["s"].isNull() | (s > x["s"]))
        last = F.coalesce(x["e"], F.when(x["s"].isNotNull(), F.get(above, F.size(above) - 1) - 1), x["s"])
        opened = F.when(x["s"].isNull(), acc["open"]).otherwise(F.concat(above, F.array(x["s"])))
        return F.struct(opened.alias("open"), F.concat(acc["done"], F.array(F.struct(x["row"].alias("row"), last.alias("last_page")))).alias("done"))

    folded = rows.groupBy(*by).agg(F.aggregate(F.reverse(listed), empty, add, lambda acc: acc["done"]).alias("d"))
    return folded.select(F.explode("d").alias("d")).select("d.row.*", "d.last_page")


def best_record(records: DataFrame, key: str, text: str, status: str, source: str, bad: str, words: str, stated: str, line: str) -> DataFrame:
    """The record of each key with the highest rank: text with an ok status before text, an ok status alone, an empty text; then OCR before others, fewer bad
    words, more words, a longer text, a higher stated length, the earlier line. Records without a key are left out."""
    full = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "") != ""
    told = F.coalesce(F.col(status), F.lit(""))
    level = F.when(full & (told == "ok"), 5).when(full, 3).when(told == "ok", 2).when(told == "empty_text", 1).otherwise(0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rank = F.struct(level.alias("a"), (F.coalesce(F.col(source), F.lit("")) == "tesseract_ocr").alias("b"), (-zero(bad)).alias("c"), zero(words).alias("d"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("e"), zero(stated).alias("f"), (-zero(line)).alias("g"), F.struct(*records.columns).alias("row"))
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank).alias("m")).select("m.row.*")


def distinct_articles(articles: DataFrame, journal: str, year: str, title: str, authors: str, pages: str, issue: str, url: str, abstract: str, key: str, default: str, flawed: tuple[str, ...] = ()) -> DataFrame:
    """One article of each journal, year and folded title, authors and pages: one whose issue does not read as flawed, with a link, the longest abstract, the highest key."""
    folded = F.struct(
        F.coalesce(F.col(journal), F.lit(default)).alias("a"),
        F.coalesce(F.col(year), F.lit(0)).alias("b"),
        normalize_key(F.col(title)).alias("c"),
        F.transform(F.coalesce(F.col(authors), F.array().cast("array<string>")), lambda x: normalize_key(x)).alias("d"),
        normalize_key(F.col(pages)).alias("e"),
    )
    number = normalize_key(F.col(issue))
    clean = F.lit(True)
    for phrase in flawed:
        clean = clean & ~F.contains(number, F.lit(phrase))
    score = F.struct(clean.alias("a"), (F.coalesce(F.col(url), F.lit("")) != "").alias("b"), F.length(F.trim(F.coalesce(F.col(abstract), F.lit("")))).alias("c"), F.coalesce(F.col(key), F.lit(0)).alias("d"), F.struct(*articles.columns).alias("row"))
    return articles.groupBy(folded.alias("_key")).agg(F.max(score).alias("m")).select("m.row.*")


def last_run(events: DataFrame, by: str, event: str, order: list[str], started: str) -> DataFrame:
    """The events of each log from its last event named started on; all of a log without one."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum((F.col(event) == started).cast("long")).over(w), F.lit(0))
    return events.withColumn("_after", after).where("_after = 0").drop("_after")


def runtime_stats(events: DataFrame, by: str, event: str, issue: str, at: str, order: list[str], names: dict[str, str]) -> DataFrame:
    """by, finished, skipped, sample_count, avg_seconds of each log's last run; names says what its events are called: run, begin, end, skip.

    An end is paired with the latest begin of its issue before it (which a second end may be paired with too); an end without one, or before it in
    time, does not count. The mean is of the last RECENT durations, null without any.
    """
    scope = last_run(events, by, event, order, names["run"])
    w = Window.partitionBy(by, issue).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col(event) == names["begin"], F.col(at)), ignorenulls=True).over(w)
    ended = scope.withColumn("_begun", begun).where((F.col(event) == names["end"]) & F.col(issue).isNotNull() & (F.col(at) >= F.col("_begun")))
    micros = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_begun").cast("timestamp"))
    lengths = ended.select(by, micros.alias("_us"), F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])).alias("_k"))
    recent = F.col("_k") <= RECENT
    means = lengths.groupBy(by).agg(F.count("*").alias("finished"), F.count_if(recent).alias("sample_count"), (F.sum(F.when(recent, F.col("_us"))) / F.count_if(recent) / 1_000_000).alias("avg_seconds"))
    skips = scope.groupBy(by).agg(F.count_if(F.col(event) == names["skip"]).alias("skipped"))
    rows = skips.join(means, by, "left")
    return rows.select(by, F.coalesce("finished", F.lit(0)).alias("finished"), "skipped", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), "avg_seconds")


def page_eta(elapsed: Column, page: Column, pages: Column) -> Column:
    """Seconds that the pages left will take at the pace so far; null before the first page, after the last one, and without time gone by."""
    ok = (page > 0) & (pages > 0) & (page < pages) & (elapsed > 0)
    return F.when(ok, elapsed.cast("double") / page * (pages - page))


def overall_eta(left: Column, current: Column, mean: Column, cooldown: Column) -> Column:
    """Seconds until all issues are done: the current one's, and the mean with the pause for each other one; null without a mean, 0 if none is left."""
    each = mean + F.greatest(cooldown, F.lit(0.0))
    return F.when(mean.isNull(), F.lit(None).cast("double")).when(left <= 0, 0.0).when(current.isNull(), left * each).otherwise(current + F.greatest(left - 1, F.lit(0)) * each)


def current_item(items: DataFrame, by: str, key: str, status: str, updated: str) -> DataFrame:
    """by, current: the running item of each state that was updated last, the last key of equals; null where none runs."""
    running = F.col(status) == "running"
    return items.groupBy(by).agg(F.max_by(F.when(running, F.col(key)), F.when(running, F.struct(updated, key))).alias("current"))


def interrupted(items: DataFrame, status: str, run_status: Column) -> DataFrame:
    """items with status interrupted and a reason in place of running, where a new run finds the state still running; others as they are, without a reason."""
    stale = (run_status == "running") & (F.col(status) == "running")
    reason = F.when(stale, "runner_restarted_after_stale_running_state")
    return items.withColumn("interrupt_reason", reason).withColumn(status, F.when(stale, "interrupted").otherwise(F.col(status)))


def budgeted(rows: DataFrame, by: list[str], order: list[str], text: str, budget: int, marker: str) -> DataFrame:
    """rows with used and shown: texts in order, each group's until its budget of characters is gone.

    Line ends in a row are two at most. A text that fits is shown whole; the first one that doesn't is cut, its end trimmed and the marker put after it; the ones after it
    are not shown. used is how much of the budget a text takes: its length, or what is left of the budget.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\A\s+|\s+\z", ""), r"\n{3,}", "\n\n")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_t", clean)
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(F.length("_t")).over(w), F.lit(0))).cast("int")
    rows = rows.withColumn("_left", left)
    cut = F.concat(F.regexp_replace(F.substr("_t", F.lit(1), F.col("_left")), r"\s+\z", ""), F.lit(marker))
    shown = F.when(F.length("_t") <= F.col("_left"), F.col("_t")).when(F.col("_left") > 0, cut).otherwise("")
    return rows.withColumn("used", F.least(F.length("_t"), F.col("_left")).cast("long")).withColumn("shown", shown).drop("_t", "_left")

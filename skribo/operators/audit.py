"""Quality audit of extracted texts: signals, issues, summaries, duplicates and the queue for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.functions.text import hidden_counts, runs

#: Limits of the rules, the weight of each severity and each code; a code without a weight has its severity's.
LIMITS = {"chars": 300, "words": 30, "chars_per_page": 600, "words_per_page": 80, "bad": 2, "hyphens": 100, "blanks": 500, "format": 25, "replaced_much": 5}
SEVERITIES = {"high": 100, "medium": 50, "low": 10}
WEIGHTS = {
    "empty_text": 300,
    "very_short_text": 250,
    "low_text_density": 100,
    "replacement_characters": 220,
    "control_characters": 180,
    "private_use_characters": 160,
    "other_hidden_characters": 160,
    "residual_bad_diacritic_tokens": 120,
    "cleanup_format_characters": 30,
    "cleanup_hyphen_linebreaks": 20,
    "cleanup_multispace_layout": 10,
}
#: Codes that a program mends by itself, texts that duplicates are looked for in, letters with accents, examples of bad words.
AUTO_FIXABLE = ("control_characters", "cleanup_format_characters", "cleanup_hyphen_linebreaks", "cleanup_multispace_layout")
DUPLICATE_LEAST, ACCENTED, EXAMPLES = 500, "áäčďéíĺľňóôŕšťúýžÁÄČĎÉÍĹĽŇÓÔŔŠŤÚÝŽ", 12


def signals(records: DataFrame, text: str, pages: Column, bad_words: tuple[str, ...]) -> DataFrame:
    """records with chars, words, pages, diacritics, bad_tokens, bad_examples and the counts of hidden characters and layout marks.

    Bad words count once each, whatever their case; the examples are their first spellings in order. Null is an empty text, fewer pages than one are one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = records.select(*records.columns, runs(whole, underscore=True).alias("_tokens"), F.greatest(F.lit(1), F.coalesce(pages, F.lit(1))).alias("pages"))
    bad = F.filter("_tokens", lambda x: F.lower(x).isin(*bad_words))
    first = F.filter(bad, lambda x, i: F.array_position(F.transform(bad, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    marks = hidden_counts(F.col(text))
    rows = rows.select("*", first.alias("_bad"), *[c.alias(n) for n, c in marks.items()])
    accents = F.regexp_count(whole, F.lit(f"[{ACCENTED}]")).cast("long")
    return rows.select(
        *records.columns, "pages", F.length(whole).cast("long").alias("chars"), F.size("_tokens").cast("long").alias("words"), accents.alias("diacritics"), F.size("_bad").cast("long").alias("bad_tokens"), F.slice("_bad", 1, EXAMPLES).alias("bad_examples"), *marks
    )


def issues(text: Column, status: Column) -> Column:
    """Over the columns of signals: the code and severity of every rule that a text breaks, in the order of the rules."""
    full, c = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") != "", F.col
    told = F.coalesce(status, F.lit(""))
    rules = [
        ("empty_text", "high", ~full),
        ("non_ok_status", "high", full & ~told.isin("", "ok")),
        ("very_short_text", "high", full & ((c("chars") < LIMITS["chars"]) | (c("words") < LIMITS["words"]))),
        ("low_text_density", "medium", full & (c("chars") / c("pages") < LIMITS["chars_per_page"]) & (c("words") / c("pages") < LIMITS["words_per_page"])),
        ("residual_bad_diacritic_tokens", "medium", c("bad_tokens") >= LIMITS["bad"]),
        ("replacement_characters", "high", c("replacement_chars") >= LIMITS["replaced_much"]),
        ("replacement_characters", "medium", c("replacement_chars").between(1, LIMITS["replaced_much"] - 1)),
        ("control_characters", "medium", c("control_chars") > 0),
        ("private_use_characters", "medium", c("private_use_chars") > 0),
        ("other_hidden_characters", "medium", c("other_hidden_chars") > 0),
        ("cleanup_format_characters", "low", c("format_chars") >= LIMITS["format"]),
        ("cleanup_hyphen_linebreaks", "low", c("hyphen_linebreaks") >= LIMITS["hyphens"]),
        ("cleanup_multispace_layout", "low", c("multispace_runs") >= LIMITS["blanks"]),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, broken in rules]))


def _in(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def severity_weight(severity: Column) -> Column:
    return F.coalesce(_in(SEVERITIES, severity), F.lit(0))


def issue_score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.coalesce(_in(WEIGHTS, x["code"]), severity_weight(x["severity"]))).cast("long")


def audited(records: DataFrame, text: str, status: Column, pages: Column, bad_words: tuple[str, ...]) -> DataFrame:
    """records with signals, issues and issue_score."""
    rows = signals(records, text, pages, bad_words).withColumn("issues", issues(F.col(text), status))
    return rows.withColumn("issue_score", issue_score(F.col("issues")))


def duplicates(records: DataFrame, key: str, text: str, place: list[str], least: int = DUPLICATE_LEAST) -> tuple[DataFrame, DataFrame]:
    """Groups of texts equal but for white space and case, of least characters or more: hash, n, chars, same_place of each, and hash, key of their members.

    A group is as large as it is: its members are rows. same_place: the columns in place have one value (null is one too) in all of the group.
    """
    norm = F.replace(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))), F.lit("ß"), F.lit("ss"))
    rows = records.select(key, F.struct(*[F.col(p) for p in place]).alias("_place"), norm.alias("_t")).select(key, "_place", F.length("_t").cast("long").alias("chars"), F.when(F.length("_t") >= least, F.sha1("_t")).alias("hash")).where("hash IS NOT NULL")
    groups = rows.groupBy("hash").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), (F.min("_place") == F.max("_place")).alias("same_place")).where("n >= 2")
    return groups, rows.select("hash", key).join(groups.select("hash"), "hash", "left_semi")


def summary(audit: DataFrame, key: str, text: str, status: Column, source: Column, groups: DataFrame) -> DataFrame:
    """dimension, value, n: counts of an audit by status, source, code, severity and bad words, of repeated ids and of duplicates.

    A pass makes the tags of each record, which are counted partly before they are shuffled.
    """
    full = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "") != ""

    def tag(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    none = F.lit("")
    single = [tag("records", none), tag("status", F.coalesce(status, none)), tag("text_source", F.coalesce(F.nullif(source, none), F.lit("pdftotext"))), F.when(full, tag("with_text", none)).otherwise(tag("without_text", none)), F.when(F.size("issues") > 0, tag("with_issues", none))]
    single += [F.when(F.col("bad_tokens") >= k, tag("bad_tokens", F.lit(f">={k}"))) for k in (1, 2, 3, 4)]
    coded = F.transform("issues", lambda x: tag("issue", x["code"]))
    graded = F.transform("issues", lambda x: tag("severity", x["severity"]))
    counted = audit.select(F.explode(F.concat(F.array_compact(F.array(*single)), coded, graded)).alias("t")).groupBy("t.dimension", "t.value").agg(F.count("*").alias("n"))
    again = audit.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("b"))
    same = groups.agg(F.count("*").alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("b"), F.count_if("same_place").alias("c"))

    def named(row: DataFrame, names: dict[str, str]) -> DataFrame:
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.lit("").alias("value"), F.col(c).cast("long").alias("n")) for n, c in names.items()])).alias("t")).select("t.*")

    return counted.unionByName(named(again, {"repeated_ids": "a", "records_of_repeated_ids": "b"})).unionByName(named(same, {"duplicate_groups": "a", "duplicate_records": "b", "duplicate_groups_same_pages": "c"}))


def queue(audit: DataFrame, key: str, resolved: DataFrame, ignored: Column) -> DataFrame:
    """audit with review (the issues that a person has to look at), primary (its most severe one, the last code of equals), state.

    state: none (nothing to do), ignored, auto (a program can mend all), resolved (the key is in resolved), active.
    """
    rows = audit.join(resolved.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left")
    review = F.filter("issues", lambda x: ~x["code"].isin(*AUTO_FIXABLE))
    rows = rows.withColumn("review", review)
    primary = F.array_max(F.transform("review", lambda x: F.struct(severity_weight(x["severity"]).alias("weight"), x["code"].alias("code"), x["severity"].alias("severity"))))
    state = F.when(F.size("issues") == 0, "none").when(ignored, "ignored").when(F.size("review") == 0, "auto").when(F.col("_done").isNotNull(), "resolved").otherwise("active")
    return rows.withColumn("primary", primary).withColumn("state", state).drop("_done")


def queue_summary(queued: DataFrame, year: str) -> DataFrame:
    """name, n: active incidents, those of each severity, the years, what is excluded, resolved and ignored, and the codes of active ones (issue:code)."""
    active = F.col("state") == "active"
    totals = queued.agg(
        F.count_if(active).alias("active_incidents"),
        *[F.count_if(active & (F.col("primary.severity") == s)).alias(s) for s in SEVERITIES],
        F.min(F.when(active, F.col(year))).cast("long").alias("first_year"),
        F.max(F.when(active, F.col(year))).cast("long").alias("last_year"),
        F.count_if(F.col("state") == "ignored").alias("ignored_outer_matter"),
        F.count_if(F.col("state") == "auto").alias("auto_fixable_records_excluded"),
        F.count_if(F.col("state") == "resolved").alias("review_decisions_applied"),
    )
    codes = queued.where(active).select(F.explode("review.code").alias("code")).groupBy(F.concat(F.lit("issue:"), "code").alias("name")).agg(F.count("*").alias("n"))
    return totals.unpivot([], totals.columns, "name", "n").unionByName(codes)

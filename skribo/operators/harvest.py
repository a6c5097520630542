"""What is gathered from pages and files: links, sources and what they lead to, issue keys, identities, objects in models' answers, records for upload, reports."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.operators.numbering import numbered

#: Characters of a detail page that count as a link's context.
CONTEXT = 8000


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.open: tuple[str, str] | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            own = dict(attrs)
            self.open, self.text = (own["href"], own.get("title") or "") if own.get("href") else None, []

    def handle_data(self, data):
        self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            href, title = self.open
            self.found.append((href, " ".join("".join(self.text).split()) or " ".join(title.split())))
            self.open = None


def anchors(page: str, base: str) -> list[tuple[str, str]]:
    """The address, resolved against the base, and text of each anchor; its title stands for a missing text."""
    parser = _Anchors()
    parser.feed(page)
    out = []
    for href, text in parser.found:
        try:
            out.append((urljoin(base, href), text))
        except ValueError:  # an address that is none
            out.append((href, text))
    return out


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, place (from 0), href, text of every anchor of every page. Null pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, h, x) for i, u, p in zip(b["i"], b["u"], b["p"], strict=True) for k, (h, x) in enumerate(anchors(p or "", u or ""))]
            yield pd.DataFrame(rows, columns=["key", "place", "href", "text"])

    rows = pages.select(F.col(key).alias("i"), F.col(url).alias("u"), F.col(html).alias("p"))
    return rows.mapInPandas(made, f"key {kind}, place long, href string, text string").withColumnRenamed("key", key)


def page_text(html: Column) -> Column:
    """A page's text without scripts, styles and markup, white space single."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def gated(url: Column, text: Column, include: tuple[str, ...] = (), required: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a link passes: any pattern of include (if there are any), all of required, none of exclude, in its address and text, whatever the case."""
    whole = F.concat_ws(" ", url, text)
    hits = lambda p: F.coalesce(whole.rlike(f"(?iu){p}"), F.lit(False))
    ok = F.lit(not include)
    for p in include:
        ok = ok | hits(p)
    for p in required:
        ok = ok & hits(p)
    for p in exclude:
        ok = ok & ~hits(p)
    return ok


def discovered(sources: DataFrame, pages: DataFrame, found: DataFrame, allowed: Column) -> DataFrame:
    """source_id, mode, href, text, context, detail_url, error: the links that sources lead to and that are allowed (a condition over href and text).

    sources: source_id, url, mode (direct: the links of its page; detail: the links of the pages that its allowed links lead to); pages: url, html; found: url, place, href, text,
    the links of pages. A page that isn't there is an error of its source, in a row of its own, and stops no other.
    """
    known = pages.select(F.col("url").alias("_u"), page_text(F.col("html")).alias("_t"))
    begun = sources.join(known, F.col("url") == F.col("_u"), "left")
    missing = begun.where("_u IS NULL").select("source_id", "mode", *[F.lit(None).cast("string").alias(c) for c in ("href", "text", "context", "detail_url")], F.concat(F.lit("no page "), "url").alias("error"))
    of = lambda d: found.select(F.col("url").alias("_of"), *d)
    first = begun.where("_u IS NOT NULL").join(of(["href", "text"]), F.col("url") == F.col("_of")).where(allowed)
    direct = first.where("mode = 'direct'").select("source_id", "mode", "href", "text", F.lit("").alias("context"), F.lit("").alias("detail_url"), F.lit(None).cast("string").alias("error"))
    detail = first.where("mode = 'detail'").select("source_id", "mode", F.col("href").alias("detail_url")).distinct().join(known, F.col("detail_url") == F.col("_u"), "left")
    lost = detail.where("_u IS NULL").select("source_id", "mode", *[F.lit(None).cast("string").alias(c) for c in ("href", "text", "context")], "detail_url", F.concat(F.lit("no page "), "detail_url").alias("error"))
    second = detail.where("_u IS NOT NULL").join(of(["href", "text"]), F.col("detail_url") == F.col("_of")).where(allowed)
    second = second.select("source_id", "mode", "href", "text", F.substring("_t", 1, CONTEXT).alias("context"), "detail_url", F.lit(None).cast("string").alias("error"))
    return missing.unionByName(direct).unionByName(lost).unionByName(second)


def markdown_links(text: Column, ending: str = "pdf") -> Column:
    """text and url of every markdown link to files of a kind, in order."""
    pattern = F.lit(rf"\[([^\]]+)\]\((https?://[^)]+\.{ending})\)")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("text"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("url"))


#: Years that a title may tell, and its words that make an issue of their own.
YEAR, SPECIAL = r"\b(19\d\d|20\d\d)\b", ("kongres", "mimoriadne")


def issue_key(title: Column, skipped: tuple[str, ...] = ()) -> Column:
    """year_issue of a link's title: the issue is its one number, or its two joined, else 1, or a special word; null without a year or with one of the words skipped."""
    low = F.lower(title)
    year = F.regexp_extract(title, YEAR, 1)
    numbers = F.regexp_extract_all(F.regexp_replace(title, YEAR, ""), F.lit(r"\d+"), F.lit(0))
    issue = F.when(F.size(numbers).between(1, 2), F.array_join(numbers, "-")).otherwise("1")
    for word in reversed(SPECIAL):
        issue = F.when(F.contains(low, F.lit(word)), F.lit(word)).otherwise(issue)
    out = F.lit(False)
    for word in skipped:
        out = out | F.contains(low, F.lit(word))
    return F.when((year != "") & ~out, F.concat_ws("_", year, issue))


def url_map(linked: DataFrame) -> DataFrame:
    """key, url: of the links (key, place, url) of each key the last one's address."""
    return linked.where("key IS NOT NULL").groupBy("key").agg(F.max_by("url", "place").alias("url"))


def with_urls(articles: DataFrame, mapped: DataFrame, year: str, issue: str) -> DataFrame:
    """articles with mapped_url and via: by the key of year and issue, else by the year and the set of the issue's numbers (the least key of equals), else null."""
    digits = lambda c: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))), ",")
    parts = F.split("key", "_", 2)
    exact = mapped.select(F.col("key").alias("_key"), F.col("url").alias("_exact"))
    loose = mapped.select(parts[0].alias("_y"), digits(parts[1]).alias("_d"), "key", "url").where("_d <> ''").groupBy("_y", "_d").agg(F.min_by("url", "key").alias("_loose"))
    rows = articles.join(exact, F.concat_ws("_", F.col(year).cast("string"), issue) == F.col("_key"), "left")
    rows = rows.join(loose, (F.col(year).cast("string") == F.col("_y")) & (digits(F.col(issue)) == F.col("_d")), "left")
    return rows.select(*articles.columns, F.coalesce("_exact", "_loose").alias("mapped_url"), F.when(F.col("_exact").isNotNull(), "key").when(F.col("_loose").isNotNull(), "digits").alias("via"))


def file_name(url: Column) -> Column:
    """The name of the file that an address leads to, without its ending: a parameter named filename, else the last part of the path, decoded."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    named = F.regexp_extract(url, r"[?&]filename=([^&#]*)", 1)
    last = F.regexp_extract(F.try_url_decode(F.when(named != "", named).otherwise(path)), r"([^/]*)$", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def identity(rules: list[dict], fields: dict[str, Column], year_of: Column | None = None) -> Column:
    """volume, year, issue, key, type of what the first rule that matches finds; null if none does.

    A rule: field (of fields), pattern, groups (volume, issue, year: numbers of its groups), type, and maybe given, a pattern that the file must not match.
    year_of: a function of the volume, for what tells no year; without a year a rule does not match.
    """
    found = F.lit(None).cast("struct<volume:string,year:long,issue:string,key:string,type:string>")
    for rule in reversed(rules):
        source = fields[rule["field"]]
        part = lambda name, rule=rule, source=source: F.regexp_extract(source, rule["pattern"], rule["groups"][name]) if name in rule["groups"] else F.lit("")
        volume, issue = part("volume"), F.regexp_replace(F.lower(part("issue")), r"[\s_/]+", "-")
        issue = F.regexp_replace(issue, r"^suppl(?:ementum|\.)?$", "suppl")
        year = part("year").try_cast("long")
        if year_of is not None:
            year = F.coalesce(year, year_of(volume))
        key = F.concat_ws("_", F.nullif(volume, F.lit("")), year.cast("string"), F.nullif(issue, F.lit("")))
        hit = source.rlike(rule["pattern"]) & year.isNotNull()
        if "but" in rule:
            hit = hit & ~fields["file"].rlike(rule["but"])
        found = F.when(hit, F.struct(volume.alias("volume"), year.alias("year"), issue.alias("issue"), key.alias("key"), F.lit(rule["type"]).alias("type"))).otherwise(found)
    return found


def json_object(content: Column) -> tuple[Column, Column]:
    """The text of the outermost object in a model's answer, code fences off, and why there is none: no_json_object or invalid_json."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(content, F.lit(""))), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    # as an element of an array, so that nothing may follow the object
    ok = (found != "") & (F.size(F.from_json(F.concat(F.lit("["), found, F.lit("]")), "array<string>")) == 1)
    return F.when(ok, found), F.when(found == "", "no_json_object").when(~F.coalesce(ok, F.lit(False)), "invalid_json")


#: Records of an upload.
BATCH = 50


def creator(author: Column) -> Column:
    """A person by last and first name, or what has no comma by its name alone."""
    person = F.contains(author, F.lit(","))
    last, first = F.trim(F.split(author, ",", 2)[0]), F.trim(F.get(F.split(author, ",", 2), F.lit(1)))
    return F.struct(F.lit("author").alias("creatorType"), F.when(person, first).alias("firstName"), F.when(person, last).alias("lastName"), F.when(~person, F.trim(author)).alias("name"))


def upload_items(articles: DataFrame, done: DataFrame, journal: str, tag: str) -> DataFrame:
    """id, batch (from 0), item: articles whose id is not in done, by id, BATCH in each batch, as JSON records. articles: id, title, authors, year, volume, issue, pages, abstract, extras, pdf_url."""
    left = articles.join(done, "id", "left_anti")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [F.concat(F.lit(f"{label}: "), text(c)) for label, c in (("ID", "id"), ("Volume", "volume"), ("Issue", "issue"), ("Pages", "pages"))]
    extra = F.concat_ws("\n", *lines, F.when(F.size("extras") > 0, F.concat(F.lit("Extras: "), F.array_join("extras", ", "))))
    labels = F.array_compact(F.array(F.lit(tag), F.concat(F.lit("year_"), text("year")), *[F.when(text(c) != "", F.concat(F.lit(f"{c}_"), text(c))) for c in ("volume", "issue")]))
    item = F.struct(
        F.lit("journalArticle").alias("itemType"),
        "title",
        F.transform("authors", lambda a: creator(a)).alias("creators"),
        F.lit(journal).alias("publicationTitle"),
        text("volume").alias("volume"),
        text("issue").alias("issue"),
        text("pages").alias("pages"),
        text("year").alias("date"),
        text("abstract").alias("abstractNote"),
        text("pdf_url").alias("url"),
        extra.alias("extra"),
        F.transform(labels, lambda x: F.struct(x.alias("tag"))).alias("tags"),
    )
    rows = left.select("id", F.to_json(item).alias("item"))
    return numbered(rows, ["id"], "n").select("id", F.floor((F.col("n") - 1) / BATCH).cast("long").alias("batch"), "item")


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def report(rows: DataFrame, group: str, order: list[str], head: Column, body: Column) -> DataFrame:
    """group, place, text, markdown, html: a line of a report for each row, numbered within its group."""
    lines = rows.select(group, *order, head.alias("_head"), body.alias("_body"))
    lines = numbered(lines, list(order), "place", (group,))
    number, one = F.col("place").cast("string"), lambda c: F.regexp_replace(c, r"\s+", " ")
    return lines.select(
        group,
        "place",
        F.concat(number, F.lit(". "), one("_head"), F.lit(": "), one("_body")).alias("text"),
        F.concat(number, F.lit(". **"), one("_head"), F.lit("** "), one("_body")).alias("markdown"),
        F.concat(F.lit("<li><strong>"), escaped(one("_head")), F.lit("</strong> "), escaped(one("_body")), F.lit("</li>")).alias("html"),
    )


def write_report(lines: DataFrame, group: str, column: str, path: str) -> None:
    """Text files of a report's lines, a folder for each group, whose files hold ranges of places in their order."""
    lines.repartitionByRange(F.col(group), F.col("place")).sortWithinPartitions(group, "place").select(group, F.col(column).alias("value")).write.partitionBy(group).text(path)

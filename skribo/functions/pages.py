"""Pages of files: the six rules by which a printed page becomes a physical one, and which pages are looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skribo.functions.text import positive

#: What bibliographies add to a printed page whatever the journal, and what is added by default elsewhere.
BIBLIOGRAPHY_OFFSET, DEFAULT_OFFSET = 2, 2


def resolved(imported: Column, printed: Column, text_page: Column, offset: Column, mapped: Column, pages: Column) -> dict[str, Column]:
    """research: an imported page as it is, else the printed one and the journal's offset, else the page of the text. public: the imported or printed page, and the offset
    (the default one if it is unknown); null without a page. bibliography: the printed page and a constant. index and web: the imported or printed page, else 1, and the
    offset. extraction: an imported page as it is, else a mapped one, else printed and offset; 1 at least, the last page at most. All are null if they have no page to go by."""
    added = F.coalesce(offset, F.lit(DEFAULT_OFFSET))
    imported, printed = positive(imported), positive(printed)
    shown = F.coalesce(imported, printed, F.lit(1)) + added
    extraction = F.coalesce(imported, mapped, printed + added)
    return {
        "research": F.coalesce(imported, printed + added, text_page),
        "public": F.coalesce(imported, printed) + added,
        "bibliography": printed + BIBLIOGRAPHY_OFFSET,
        "index": shown,
        "extraction": F.least(F.greatest(extraction, F.lit(1)), pages),
        "web": shown,
    }


def candidate_pages(first: Column, last: Column, status: Column, pages: Column, most: int = 3) -> Column:
    """Up to most distinct pages of a file worth a look: around a single page, the ends and the middle of a range, the last ones if the range was beyond the file, else its
    ends and middle; then pages nearer and nearer around the last of them. Null pages: the file's length is unknown."""
    first = positive(first)
    last = F.greatest(F.coalesce(positive(last), first), first)
    count = positive(pages)
    one, floor = lambda c: F.greatest(F.lit(1).cast("long"), c), lambda c: F.floor(c).cast("long")
    wanted = (
        F.when(first.isNotNull() & (first == last), F.array(first - 1, first, first + 1, first + 2))
        .when(first.isNotNull(), F.array(first, first + floor((last - first) / 2), last))
        .when((status == "page_out_of_range") & count.isNotNull(), F.array(one(count - 2), one(count - 1), count))
        .when(count.isNotNull(), F.array(F.lit(1).cast("long"), one(floor((count + 1) / 2)), count))
        .otherwise(F.array().cast("array<bigint>"))
    )
    inside = lambda a: F.filter(a, lambda p: (p >= 1) & (count.isNull() | (p <= count)))
    kept = F.slice(F.array_distinct(inside(wanted)), 1, most)
    anchor = F.element_at(kept, -1)
    around = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most + 2)), lambda d: F.array(anchor + d, anchor - d)))
    return F.when(F.size(kept) == 0, kept).otherwise(F.slice(F.array_distinct(F.concat(kept, inside(around))), 1, most))


def probes(start: Column, end: Column, mapped: Column, pages: Column, most: int = 4) -> Column:
    """Ranges (first, last) to try where a text came out empty: shifted by 1 to most pages, within the file; none if the page is mapped or unknown."""
    span = F.greatest(end - start, F.lit(0).cast("long"))
    top = F.least(start + most, F.coalesce(pages, start + most))
    found = F.transform(F.when(top > start, F.sequence(start + 1, top)).otherwise(F.array().cast("array<bigint>")), lambda p: F.struct(p.alias("first"), F.least(p + span, F.coalesce(pages, p + span)).alias("last")))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.when(start.isNull() | end.isNull() | F.coalesce(mapped, F.lit(False)), none).otherwise(found)

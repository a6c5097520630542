"""Cutting texts to the bounds that titles set, and snippets around search hits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.functions.text import MARKED, PLAIN

#: Letters a title has at least, the part of a text its title must begin in, characters that must lie between
#: two titles and be left over, and the tokens of a snippet.
TITLE_LEAST, TITLE_WITHIN, BETWEEN, LEFT_LEAST, SNIPPET = 4, 0.85, 120, 80, 24
_GAP, _MARK = r"[^\p{L}\p{N}]*", "\x01"


def _alike(text: Column) -> Column:
    """Lower case without accents, a character for each character."""
    return F.lower(F.translate(text, MARKED, PLAIN))


def _letters(title: Column) -> Column:
    return F.regexp_replace(F.replace(_alike(F.coalesce(title, F.lit(""))), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def place(folded: Column, title: Column, start: Column) -> Column:
    """Where a title's letters begin, from start on, with anything but letters and digits between them; null if nowhere.

    A sharp s is two letters, and a title may begin or end within it: it is spelt out with a mark between, which tells how much longer the text has become.
    """
    letters = _letters(title)
    pattern = F.regexp_replace(letters, "(.)", "$1" + _GAP.replace("\\", "\\\\"))
    spelt = F.replace(F.translate(F.substring(folded, start + 1, F.length(folded)), _MARK, " "), F.lit("ß"), F.lit(f"s{_MARK}s"))
    parts = F.split(spelt, pattern, 2)
    before = F.length(parts[0]) - 2 * F.length(F.regexp_replace(parts[0], f"[^{_MARK}]+", ""))
    return F.when((F.length(letters) >= TITLE_LEAST) & (F.size(parts) > 1), start + before)


def trimmed(rows: DataFrame, text: str, title: str, next_titles: str) -> DataFrame:
    """rows with start_char, end_char, trimmed and was_cut: from the title on to the nearest of the next titles.

    A title is found whatever its case, accents and punctuation. What would leave less than LEFT_LEAST characters is not
    cut; null is an empty text; null titles and titles of fewer than TITLE_LEAST letters are found nowhere.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.length(whole)
    found = place(F.col("_folded"), F.col(title), F.lit(0))
    begun = rows.withColumn("_folded", _alike(whole)).withColumn("_start", F.when(found < n * TITLE_WITHIN, found).otherwise(0))
    after = F.col("_start") + F.greatest(F.lit(LEFT_LEAST), F.length(F.coalesce(F.col(title), F.lit(""))))
    empty = F.array().cast("array<string>")
    ends = F.transform(F.coalesce(F.col(next_titles), empty), lambda t: place(F.col("_folded"), t, after))
    ended = begun.withColumn("_end", F.least(n, F.array_min(F.filter(ends, lambda e: e > F.col("_start") + BETWEEN))))
    cut = F.regexp_replace(F.substring(whole, F.col("_start") + 1, F.col("_end") - F.col("_start")), r"\A\s+|\s+\z", "")
    kept = ended.withColumn("_cut", cut).withColumn("_ok", (F.trim(whole) != "") & (F.length("_cut") >= LEFT_LEAST))
    return kept.select(
        *rows.columns,
        F.when(F.col("_ok"), F.col("_start")).otherwise(0).cast("long").alias("start_char"),
        F.when(F.col("_ok"), F.col("_end")).otherwise(n).cast("long").alias("end_char"),
        F.when(F.col("_ok"), F.col("_cut")).otherwise(whole).alias("trimmed"),
        (F.col("_ok") & ((F.col("_start") > 0) | (F.col("_end") < n))).alias("was_cut"),
    )


def window_of_hits(text: str, prefixes: tuple[str, ...], size: int = SNIPPET) -> str | None:
    """The window of size tokens with most hits, the first of equals, hits in brackets, dots where text is left out; None without a hit.

    A token is what white space separates; it is a hit if its first letters, folded, are one of the prefixes.
    """
    tokens = text.split()
    folded = ("".join(c for c in unicodedata.normalize("NFKD", w) if c.isalnum()).casefold() for w in tokens)
    hits = [f.startswith(prefixes) for f in folded]
    if not any(hits):
        return None
    count = best = sum(hits[:size])
    at = 0
    for k in range(1, len(tokens) - size + 1):
        count += hits[k + size - 1] - hits[k - 1]
        if count > best:
            best, at = count, k
    at = min(hits.index(True, at), max(0, len(tokens) - size))
    shown = " ".join(f"[{w}]" if h else w for w, h in zip(tokens[at : at + size], hits[at : at + size], strict=True))
    return ("..." if at else "") + shown + ("..." if at + size < len(tokens) else "")


def snippet(text: Column, prefixes: list[str], size: int = SNIPPET) -> Column:
    """window_of_hits as a column, over Arrow batches: the rows are those that a search found. Null has no hit."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return pd.Series([window_of_hits(x or "", tuple(prefixes), size) for x in texts], dtype="object")

    return shown(text)

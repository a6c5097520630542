"""Text functions as column expressions: folding, slugs, cleaning, counts, page ranges, stems."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letters that they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block if len(unicodedata.normalize("NFKD", chr(c))) > 1]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()
#: Endings that a search prefix drops, in the order they are tried, and the letters it keeps at least.
SEARCH_ENDINGS = "skeho skemu skych skymi ami ymi eho emu ej ou om ho mu ch mi ia ie e a u y i".split()
STEM_LEAST = 4


def fold(text: Column) -> Column:
    """Lower case without accents; sharp s is spelt out."""
    return F.replace(F.lower(F.translate(text, MARKED, PLAIN)), F.lit("ß"), F.lit("ss"))


def normalize_key(text: Column) -> Column:
    """Folded, with everything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def fold_text(text: Column) -> Column:
    """Folded with punctuation kept: line-end hyphens joined, white space single."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")
    return F.trim(F.regexp_replace(fold(joined), r"\s+", " "))


def slug(text: Column, fallback: str = "x") -> Column:
    found = F.replace(normalize_key(text), F.lit(" "), F.lit("-"))
    return F.when(found == "", F.lit(fallback)).otherwise(found)


def clean_fulltext(text: Column) -> Column:
    """Form feeds, page-number lines, line-end hyphens and blank runs of extracted text tidied up."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\f"), F.lit("\n"))
    for pattern, by in ((r"(?m)^\s*-+\s*\d{1,4}\s*-+\s*$", ""), (r"(?<=[\p{L}\p{N}_])-\n(?=[\p{L}\p{N}_])", ""), (r"[ \t]+", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def hidden_counts(text: Column) -> dict[str, Column]:
    """Control, format, private and other hidden characters, replacement characters, words broken at a line's end, and wide gaps."""
    word = r"[\p{L}\p{N}_]"
    patterns = {
        "control_chars": r"[\p{Cc}&&[^\n\r\t\f]]",
        "format_chars": r"\p{Cf}",
        "private_use_chars": r"\p{Co}",
        "other_hidden_chars": r"[\p{Cn}\p{Cs}]",
        "replacement_chars": "�",
        "hyphen_linebreaks": rf"(?<={word})-[ \t]*\n[ \t]*(?={word})",
        "multispace_runs": r"[ \t]{3,}",
    }
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("long") for name, p in patterns.items()}


def cleanup_hidden(text: Column) -> Column:
    """Line ends unified, control characters as blanks, format characters gone, blanks at line ends and runs of three or more tidied."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in ((r"\r\n|\r|\f", "\n"), (r"[\p{Cc}&&[^\n\t]]", " "), (r"\p{Cf}", ""), (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"), (r"[ \t]+\n", "\n"), (r" {3,}", " ")):
        out = F.regexp_replace(out, pattern, by)
    return out


def page_bounds(pages: Column) -> tuple[Column, Column]:
    """First and last page of "12", "12-15" or "12–15"; the last is the first at least; null without a number."""
    unified = F.regexp_replace(F.coalesce(pages, F.lit("")), "[‐‑‒–—−]", "-")
    first = F.regexp_extract(unified, r"^\s*(\d+)", 1).try_cast("long")
    last = F.regexp_extract(unified, r"^\s*\d+\s*-\s*(\d+)", 1).try_cast("long")
    return first, F.greatest(first, F.coalesce(last, first))


def positive(value: Column) -> Column:
    """Null for what is no positive number."""
    number = value.try_cast("long")
    return F.when(number > 0, number)


def search_prefix(token: Column) -> Column:
    """The token without the first of the endings that leaves enough letters."""
    return F.regexp_replace(token, rf"^(.{{{STEM_LEAST},}}?)(?:{'|'.join(SEARCH_ENDINGS)})$", "$1")


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value: every number is padded."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), "")


def unique(values: Column, key=normalize_key) -> Column:
    """The first spelling of each folded key, in order, without empty ones."""
    pairs = F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.struct(key(x).alias("k"), F.trim(x).alias("v")))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    kept = F.aggregate(pairs, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["v"])


def roman(value: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    steps = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    literal = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(s).alias("s")) for n, s in steps])
    start = F.struct(value.cast("long").alias("left"), F.lit("").alias("out"))
    return F.aggregate(literal, start, lambda acc, x: F.struct((acc["left"] % x["n"]).alias("left"), F.concat(acc["out"], F.repeat(x["s"], F.floor(acc["left"] / x["n"]).cast("int"))).alias("out")), lambda acc: acc["out"])


def runs(text: Column, underscore: bool = False) -> Column:
    """Runs of letters and digits. ASCII texts are split by a plain class of characters, which is several times faster."""
    ascii_gap, gap = (r"[\x00-/:-@\[-^`{-\x7F]+", r"[^\p{L}\p{N}_]+") if underscore else (r"[\x00-/:-@\[-`{-\x7F]+", r"[^\p{L}\p{N}]+")
    return F.array_remove(F.when(F.length(text) == F.octet_length(text), F.split(text, ascii_gap)).otherwise(F.split(text, gap)), "")

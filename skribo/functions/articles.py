"""What describes an article: citations, entities, JSON-LD, visual terms, printed page numbers, abstracts, volumes, authors, suspicions.

Every function takes columns, so any table can be described. Arrays may be null, strings too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skribo.functions.text import fold, page_bounds, unique

_STRINGS = "array<string>"


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(_STRINGS))


#: Fixed value: who wrote what names no author.
NOBODY = "Anonymus"


def authors_label(authors: Column) -> Column:
    names = unique(authors)
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(NOBODY))


def spaced_pages(pages: Column) -> Column:
    return F.replace(F.trim(_text(pages)), F.lit("-"), F.lit(" - "))


def _given(value: Column, before: str = "") -> Column:
    """The value after a label; null for an empty one."""
    return F.when(value != "", F.concat(F.lit(before), value))


def citations(authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, url: Column) -> dict[str, Column]:
    """iso690, apa and mla. What is missing is left out, but for the year (b. r., n.d.); the ISO form has no comma after a full stop."""
    who, what, when = authors_label(authors), F.trim(_text(title)), _text(year)
    number, band, spaced = _text(issue), _text(volume), spaced_pages(pages)
    iso = F.concat_ws(", ", F.concat(who, F.lit(". "), what, F.lit(".")), F.concat(journal, F.lit(", "), F.coalesce(_given(when), F.lit("b. r."))), _given(band, "roc. "), _given(number, "c. "), _given(spaced, "s. "), _given(_text(url), "Online: "))
    apa = F.concat(who, F.lit(". ("), F.coalesce(_given(when), F.lit("n.d.")), F.lit("). "), what, F.lit(". "), journal, F.lit(", "), number, F.coalesce(_given(spaced, ", "), F.lit("")), F.lit("."))
    mla = F.concat(F.concat_ws(", ", F.concat(who, F.lit('. "'), what, F.lit('."')), journal, _given(number, "no. "), _given(when), _given(spaced, "pp. ")), F.lit("."))
    return {"iso690": F.replace(iso, F.lit(".,"), F.lit(".")), "apa": apa, "mla": mla}


def exchange_formats(key: Column, authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, url: Column) -> dict[str, Column]:
    """bibtex and ris. A missing volume is I."""
    band = F.coalesce(_given(_text(volume)), F.lit("I"))
    first, last = page_bounds(pages)

    def lines(*rows: tuple[str, Column]) -> Column:
        return F.concat_ws("\n", *[F.concat(F.lit(label), value) for label, value in rows])

    fields = [("author", F.array_join(strings(authors), " and ")), ("title", _text(title)), ("journal", journal), ("year", _text(year)), ("volume", band), ("number", _text(issue)), ("pages", _text(pages)), ("url", _text(url))]
    body = F.concat_ws(",\n", *[F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")) for name, value in fields])
    bibtex = F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}"))
    head = lines(("TY  - JOUR", F.lit("")), ("T1  - ", _text(title)))
    by = F.array_join(F.transform(strings(authors), lambda a: F.concat(F.lit("\nAU  - "), a)), "")
    rest = lines(("JO  - ", journal), ("PY  - ", _text(year)), ("VL  - ", band), ("IS  - ", _text(issue)), ("SP  - ", _text(first)), ("EP  - ", _text(last)), ("UR  - ", _text(url)), ("ER  - ", F.lit("")))
    return {"bibtex": bibtex, "ris": F.concat(head, by, F.lit("\n"), rest)}


#: The entity types, and the lists that each is merged of, in order. a_ stands for the article's, k_ for the knowledge's own lists, n_ for the ones nested in the article.
ENTITY_LISTS = {
    "cave": ("caves", "k_caves"),
    "group": ("groups", "k_groups"),
    "theme": ("tags", "k_themes", "n_keywords"),
    "keyword": ("k_keywords", "n_keywords"),
    "location": ("k_locations", "n_locations"),
    "person": ("authors", "k_people", "n_people"),
}


def entities(lists: dict[str, Column]) -> dict[str, Column]:
    """For every type the names of its lists, the first spelling of each folded name, in order. A list that is not given is empty."""
    empty = F.array().cast(_STRINGS)
    return {kind: unique(F.concat(*[strings(lists[n]) if n in lists else empty for n in names])) for kind, names in ENTITY_LISTS.items()}


def jsonld(identifier: Column, title: Column, authors: Column, year: Column, journal: Column, pages: Column, url: Column, abstract: Column, keywords: Column, about: Column) -> Column:
    """A ScholarlyArticle as JSON; empty strings and lists are left out."""

    def some(value: Column) -> Column:
        return _given(_text(value))

    def things(names: Column, kind: str) -> Column:
        return F.when(F.size(names) > 0, F.transform(names, lambda n: F.struct(F.lit(kind).alias("@type"), n.alias("name"))))

    keys, topics = unique(keywords), unique(about)
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("ScholarlyArticle").alias("@type"),
            identifier.alias("identifier"),
            some(title).alias("name"),
            some(title).alias("headline"),
            things(strings(authors), "Person").alias("author"),
            some(year).alias("datePublished"),
            F.struct(F.lit("Periodical").alias("@type"), journal.alias("name")).alias("isPartOf"),
            some(pages).alias("pagination"),
            some(url).alias("url"),
            some(abstract).alias("abstract"),
            F.when(F.size(keys) > 0, keys).alias("keywords"),
            things(topics, "Thing").alias("about"),
        )
    )


#: Beginnings of words (or whole words, with $) that speak of pictures, maps and plans, and the characters that are looked at.
VISUAL_TERMS = r"obr\. obraz foto fotograf snim snimk mapa mapk plan pl[aá]n pl\.\s*j\. profil rez$ nakres n[aá]kres situ[aá]ci polygon polyg[oó]n topograf".split(" ")
VISUAL_WITHIN = 12_000
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def visual_pattern(term: str) -> str:
    return _EDGE + (term[:-1] + _END if term.endswith("$") else term)


def _fast_visual_pattern(term: str) -> str:
    """The same for Java: the term's first letter comes first, what stands before is looked at only where that is found."""
    whole = term.endswith("$")
    return rf"{term[0]}(?<![\p{{L}}\p{{N}}_]{term[0]}){term[1:-1] if whole else term[1:]}" + (r"(?![\p{L}\p{N}_])" if whole else "")


def visual_terms(title: Column, abstract: Column, extras: Column, note: Column, text: Column) -> Column:
    """The terms found in what describes an article and in the beginning of its text, which is the feature."""
    whole = F.lower(F.concat_ws("\n", _text(title), _text(abstract), F.array_join(strings(extras), " "), _text(note), F.substring(_text(text), 1, VISUAL_WITHIN)))
    # as the variable of a function, so that the text is put together once and not for every term
    found = F.transform(F.array(whole), lambda h: F.array_compact(F.array(*[F.when(h.rlike(_fast_visual_pattern(t)), F.lit(t)) for t in VISUAL_TERMS])))
    return F.element_at(found, 1)


def tagged(text: Column, rules: dict[str, str], default: str) -> Column:
    """The tags whose pattern is found, in order; the default one where none is."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(tag)) for tag, p in rules.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


#: Lines from the end and from the beginning of a page among which its number is looked for.
FOOTER, HEADER = 14, 8


def printed_page_number(text: Column, footer: str = r"$^") -> Column:
    """The number in the first line, from the last one up and then from the first one down, that is nothing but a number, maybe between dashes, or that footer (a pattern with the number as its group) finds."""
    lines = F.filter(F.transform(F.split(_text(text), "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    n = F.size(lines)
    order = F.concat(F.reverse(F.slice(lines, F.greatest(F.lit(1), n - FOOTER + 1), F.lit(FOOTER))), F.slice(lines, 1, HEADER))
    known = F.transform(order, lambda x: F.coalesce(_given(F.regexp_extract(x, footer if "(" in footer else f"({footer})", 1)), _given(F.regexp_extract(x, r"^-+\s*(\d{1,4})\s*-+$", 1)), _given(F.regexp_extract(x, r"^(\d{1,4})$", 1))))
    return F.get(F.array_compact(known), F.lit(0)).cast("long")


#: Characters that an abstract has at least and, of its first sentences, at most, and the labels before it.
ABSTRACT_LEAST, ABSTRACT_MOST, SENTENCES = 25, 420, 2
_LABEL = r"(?iu)^(?:[-*]\s*)?(?:anot[áa]cia|bibliografick[áa] anot[áa]cia|abstrakt)\s*[:\-]\s*"
_QUOTES = r"^[`'\"\s]+|[`'\"\s]+$"


def _single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def concise(text: Column, sentences: int = SENTENCES, most: int = ABSTRACT_MOST) -> Column:
    """The first sentences, cut after a word if they are too long."""
    marked = F.split(F.regexp_replace(_single_spaced(text), r"([.!?]) ", "$1\u0001"), "\u0001")
    kept = _single_spaced(F.array_join(F.slice(F.filter(marked, lambda s: F.trim(s) != ""), 1, sentences), " "))
    head = F.substring(kept, 1, most)
    cut = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[ ,;:]+$", "")
    return F.when(F.length(kept) <= most, kept).otherwise(F.concat(cut, F.lit(".")))


def normalized_abstract(text: Column, empty: str = "(?!)") -> Column:
    """What a model wrote, without what it thought before, labels and quotes; empty if it is too short or matches the pattern empty."""
    out = _single_spaced(_text(text))
    for before in (r"(?iu)^.*?\.\.\.\s*done\s+thinking\.?", r"(?iu)^(?:.*?[^\p{L}\p{N}_])?anot[áa]cia\s*:\s*"):
        out = _single_spaced(F.regexp_replace(out, before, ""))
    for pattern in (r"(?is)^thinking\.\.\..*", _QUOTES, _LABEL):
        out = F.regexp_replace(out, pattern, "")
    out = _single_spaced(out)
    return F.when((F.length(out) < ABSTRACT_LEAST) | out.rlike(empty), F.lit("")).otherwise(concise(out))


#: What is no author but belongs to the one before.
SUFFIXES = ("a kol.", "a spol.", "coll.", "eds.", "ed.")
INITIAL = r"^[A-ZÁÄČĎÉÍĽĹŇÓÔŔŠŤÚÝŽ]\.$"


def clean_authors(authors: Column) -> Column:
    """The list with initials and suffixes joined, by a comma, to the author before; a first one stays by itself."""

    def add(done: Column, name: Column) -> Column:
        belongs = (name.rlike(INITIAL) | F.lower(name).isin(*SUFFIXES)) & (F.size(done) > 0)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(", "), name)))
        return F.when(belongs, joined).otherwise(F.concat(done, F.array(name)))

    return F.aggregate(F.transform(strings(authors), lambda a: F.trim(a)), F.array().cast(_STRINGS), add)


def register_name(author: Column) -> Column:
    """"Surname, Given" as "Given Surname"; others as they are."""
    parts = F.split(author, ",", 2)
    given = F.trim(F.get(parts, F.lit(1)))
    return F.when(given != "", F.concat(given, F.lit(" "), F.trim(parts[0]))).otherwise(F.trim(author))


#: Numerals, what counts as no volume, the year before the first volume, and where a text tells its volume.
NUMERALS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
NO_VOLUME, YEAR_ZERO = ("", "-", "None"), 1969
TOLD_VOLUME = r"(?iu)(?<![\p{L}\p{N}_])ro[čc]n[íi]k\s+([ivxlcdm]{1,12})(?![\p{L}\p{N}_])"


def roman_value(text: Column) -> Column:
    """The number that Roman numerals stand for, other characters left out: what stands before a greater one is taken off. Null without any."""
    letters = F.split(F.regexp_replace(F.upper(_text(text)), "[^IVXLCDM]", ""), "")
    values = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair]), c))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(F.size(values) > 0, F.aggregate(signed, F.lit(0), lambda a, v: a + v).cast("long"))


def filled_volume(volume: Column, year: Column, text: Column, special: Column) -> Column:
    """A volume that is there as it is; else the one that the text tells, else the year's; null for special issues."""
    from skribo.functions.text import roman

    told = F.upper(F.regexp_extract(_text(text), TOLD_VOLUME, 1))
    by_year = F.when(year > YEAR_ZERO, F.concat(roman(year - YEAR_ZERO), F.lit(".")))
    missing = F.trim(_text(volume)).isin(*NO_VOLUME)
    return F.when(~missing, volume).when(F.coalesce(special, F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce(F.when(told != "", F.concat(told, F.lit("."))), by_year))


#: Letters of a long title, and pages within one.
LONG_TITLE, PAGES_IN_TITLE = 220, r",\s*s\.\s*\d+"


def suspicions(title: Column, pages: Column) -> Column:
    """Why a record looks damaged, in order."""
    title, none = _text(title), F.trim(_text(pages)) == ""
    embedded = title.rlike(PAGES_IN_TITLE)
    return F.array_compact(
        F.array(
            F.when(none, "missing_pages"),
            F.when((F.length(title) > LONG_TITLE) & (none | embedded), "long_title"),
            F.when(embedded, "embedded_pages_in_title"),
            F.when(title.contains("\n"), "multiline_title"),
        )
    )


def anonymous(authors: Column) -> Column:
    """Whether a list names nobody."""
    return F.forall(strings(authors), lambda a: F.trim(fold(a)).isin("", NOBODY.lower()))

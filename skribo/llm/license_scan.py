"""License scans: a positional index of rare license words.

Templates are notices and headers of licenses as words; each has key phrases that must all be there. The document frequency of
every word of the index is counted over the whole corpus. A file is first asked which of the index's words it holds at all;
a template of which it lacks a mandatory word is out. Of the others the file's rarest word (the highest IDF) of the main key phrase is
looked up: each of its places gives, less the word's place in the template, a place of the template. The posting of the second rarest
word, at its own relative position, must agree; what is left is verified word by word against the main phrase, and the
other key phrases must follow within SLACK words of where the template has them. Of templates that hold each other the longest wins, and
a notice that is denied ("not under ...") gives no label. All of it stays in the row: a file's words are split once, rare
words are picked out by one pass, and the few positions found are intersected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.llm.common import words

#: Words by which a further key phrase may stand off its place; words before a notice in which a denial counts.
SLACK, DENIED_WITHIN = 12, 3


@dataclass(frozen=True)
class Template:
    """label; text: its words; keys: words that must be there, each as place in the text and number of words, the main phrase first. Without keys all of the text is the main phrase."""

    label: str
    text: str
    base: bool = False
    phrases: tuple[str, ...] = ()
    words: tuple[str, ...] = field(init=False)
    keys: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self) -> None:
        own = tuple(self.text.split())
        found = []
        for phrase in self.phrases or (self.text,):
            w = tuple(phrase.split())
            found.append((next(k for k in range(len(own)) if own[k : k + len(w)] == w), len(w)))
        object.__setattr__(self, "words", own)
        object.__setattr__(self, "keys", tuple(found))

    @property
    def main(self) -> tuple[str, ...]:
        at, n = self.keys[0]
        return self.words[at : at + n]


#: License notices and headers. Those of one phrase are that phrase; of longer ones the key phrases are told.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        phrases=("permission is hereby granted free of charge to any person obtaining a copy", "the rights to use copy modify merge publish distribute sublicense"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        phrases=("licensed under the apache license", "in compliance with the license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        phrases=("redistribution and use in source and binary forms", "provided that the following conditions are met"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        phrases=("permission to use copy modify and or distribute this software", "with or without fee"),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        phrases=("the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        phrases=("the gnu lesser general public license as published by the free software foundation", "you can redistribute it and or modify it"),
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        phrases=("the gnu affero general public license as published by the free software foundation", "you can redistribute it and or modify it"),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        phrases=("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        phrases=("free and unencumbered software released into the public domain",),
    ),
    Template("mit", "licensed under the mit license"),
    Template("apache-2", "licensed under the apache license"),
    Template("gpl", "under the gnu general public license"),
    Template("lgpl", "under the gnu lesser general public license"),
    Template("agpl", "under the gnu affero general public license"),
    Template("mpl-2", "under the mozilla public license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-sa", "creative commons attribution share alike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-nc", "creative commons attribution non commercial"),
    Template("cc-by-nd", "creative commons attribution noderivatives"),
    Template("cc-by-nc-sa", "creative commons attribution noncommercial sharealike"),
    Template("cc-by-nc-sa", "creative commons attribution non commercial share alike"),
    Template("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc-sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd"),
    Template("cc0", "cc0 1 0"),
)
#: Words that deny the notice after them, and phrases that count where no template does.
DENIALS = ("not", "never", "neither", "without", "except")
ELSE = (Template("proprietary", "all rights reserved"),)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES + ELSE) -> dict[str, int]:
    """Over all documents, how many hold each word of the main phrases. The driver gets a row for each such word at most."""
    vocabulary = sorted({w for t in templates for w in t.main})
    held = F.array_distinct(F.filter(words(F.col("text")), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def anchors(template: Template, df: dict[str, int]) -> tuple[int, int]:
    """Places in the template of the main phrase's rarest and second rarest words, the leftmost of ties."""
    at, n = template.keys[0]
    rare = sorted(range(at, at + n), key=lambda i: (df[template.words[i]], i))
    return rare[0], rare[min(1, n - 1)]


def inside(short: Template, long: Template) -> list[int]:
    """Where a one-phrase template stands in the main phrase of a longer one of another label."""
    if short.label == long.label or len(long.main) <= len(short.words):
        return []
    return [d for d in range(len(long.main) - len(short.words) + 1) if long.main[d : d + len(short.words)] == short.words]


def _literal(of: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in of])


def _found(template: Template, df: dict[str, int]) -> Column:
    """Places of the template in a file (column w), from the places of rare words (column rare)."""
    first, second = anchors(template, df)
    at, n = template.keys[0]
    w = F.col("w")

    def phrase(place: Column, of: tuple[int, int]) -> Column:
        start = place + of[0]
        return F.when(start >= 0, F.slice(w, F.greatest(start, F.lit(0)) + 1, of[1]) == _literal(template.words[of[0] : of[0] + of[1]])).otherwise(False)

    def within_slack(place: Column, of: tuple[int, int]) -> Column:
        return F.exists(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda d: phrase(place + d, of))

    def verified(p: Column) -> Column:
        place = p - first
        near = (F.get(w, p) == template.words[first]) & (p >= first - at) & (F.get(w, p + (second - first)) == template.words[second])
        rest = [within_slack(place, of) for of in template.keys[1:]]
        # one after the other, so that the few places that pass a step are all that the next one sees
        return F.when(near, F.when(phrase(place, (at, n)), reduce(lambda a, b: a & b, rest, F.lit(True))).otherwise(False)).otherwise(False)

    return F.transform(F.filter("rare", verified), lambda p: p - first)


def _own(k: int, templates: tuple[Template, ...]) -> Column:
    """The places of template k that count for its label: those not denied, and not within a longer template of another label."""
    t, w = templates[k], F.col("w")
    longer = [(long.main, d) for long in templates for d in (inside(t, long) if not t.phrases else [])]
    at = t.keys[0][0]

    def counts(s: Column) -> Column:
        s = s + at
        denied = reduce(lambda a, b: a | b, [F.when(s >= d, F.get(w, s - d)).isin(*DENIALS) for d in range(1, DENIED_WITHIN + 1)])
        held = [F.when(s >= d, F.slice(w, F.greatest(s - d, F.lit(0)) + 1, len(main)) == _literal(main)) for main, d in longer]
        return ~reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in (denied, *held)])

    return F.filter(f"p{k}", counts)


def _share(k: int, template: Template) -> Column:
    """The largest share of the template's words that stand in their places, of the places that count; null without any."""
    w, own = F.col("w"), _literal(template.words)
    of = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.lit(len(template.words) - 1)), lambda i: F.when(s + i >= 0, F.get(w, s + i)) == F.get(own, i)))
    if not template.phrases:
        return F.when(F.size(f"o{k}") > 0, 1.0)
    return F.array_max(F.transform(f"o{k}", of)) / len(template.words)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, otherwise: tuple[Template, ...] = ELSE, df: dict[str, int] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score to doc_id.

    base columns take every place of a base template; its label always counts. labels adds those of other templates by the method;
    those of otherwise (one phrase each) only where no label is found. score: the largest share of a template's words that stand in their
    places where it is found and counts, 1 for a base or one-phrase template; 0 without any label. Null and empty texts have no words and
    no labels. Every input row gives one output row, repeated ids included; other columns of docs are ignored whatever
    their names.
    """
    docs, every = docs.select("doc_id", "text"), templates + otherwise
    df = df or document_frequencies(docs, every)
    looked_up = sorted({t.words[anchors(t, df)[0]] for t in every})
    found = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(looked_up), i))).alias("rare"))
    found = found.select("doc_id", "w", "rare", F.array_distinct(F.transform("rare", lambda i: F.get(F.col("w"), i))).alias("held"))
    empty = F.array().cast("array<int>")
    places = [F.when(F.array_contains("held", t.words[anchors(t, df)[0]]), _found(t, df)).otherwise(empty).alias(f"p{k}") for k, t in enumerate(every)]
    found = found.select("doc_id", "w", *places)
    found = found.select("*", *[F.when(F.size(f"p{k}") > 0, _own(k, every)).otherwise(empty).alias(f"o{k}") for k in range(len(every))])
    base = F.concat(*[F.col(f"p{k}") for k, t in enumerate(every) if t.base])

    def labels(of: tuple[Template, ...], prefix: str) -> Column:
        by: dict[str, list[Column]] = {}
        for k, t in enumerate(every):
            if t in of:
                by.setdefault(t.label, []).append(F.size(f"p{k}" if t.base else f"{prefix}{k}") > 0)
        return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, x), F.lit(label)) for label, x in sorted(by.items())]))

    shares = [F.when(F.size(f"p{k}") > 0, 1.0) if t.base else F.when(F.size(f"o{k}") > 0, _share(k, t)) for k, t in enumerate(every)]
    own, rest = labels(templates, "o"), labels(otherwise, "o")
    rows = found.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        base.alias("base"),
        F.array_join(labels(tuple(t for t in templates if t.base), "p"), ",").alias("base_labels"),
        own.alias("own"),
        rest.alias("rest"),
        F.coalesce(F.greatest(*shares), F.lit(0.0)).alias("score"),
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        "base_labels",
        F.array_join(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("rest")), ",").alias("labels"),
        "score",
    )

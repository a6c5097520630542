"""Parsers, bounds, snippets and detection rules on the cases that the test tables don't show."""

import pytest
from pyspark.sql import functions as F

from skribo.functions import detection as D
from skribo.operators import bounds, records
from skribo.plans import files as plans
from skribo.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_trimmed(spark):
    body = "Text of the article itself, long enough to be kept as it is, word after word after word after word, and some more of it to be sure."
    rows = [
        (1, f"Old end of another. KRÁSNOHORSKÁ jaskyňa!\n{body}\nNová-diera\nlast", "Krasnohorska Jaskyna", ["Nova diera", "nowhere at all"], "x"),
        (2, "short", "short", ["x"], "x"),
        (3, None, None, None, None),
        (4, f"{body} Straße", "abc", ["STRASSE", None], "x"),
    ]
    made = bounds.trimmed(spark.createDataFrame(rows, "id long, text string, title string, next array<string>, _extra string"), "text", "title", "next")
    found = {r["id"]: r for r in made.collect()}
    assert found[1].trimmed == f"KRÁSNOHORSKÁ jaskyňa!\n{body}" and found[1].was_cut and found[1].start_char == 20
    assert (found[2].trimmed, found[2].was_cut) == ("short", False)
    assert (found[3].trimmed, found[3].was_cut, found[3].end_char) == ("", False, 0)
    assert found[4].trimmed == body and found[4].start_char == 0
    assert made.columns[:5] == ["id", "text", "title", "next", "_extra"]


@pytest.mark.parametrize("title, found", [("das ßlichö", 121), ("DASSSLICHO", 121), ("Sloch auf", 172), ("Rotes Schlos", 142), ("an der Straßß", 156), ("das lichö", None)])
def test_place_of_sharp_s(spark, title, found):
    text = F.concat(F.lit("ß\x01" * 60), F.lit(" das ßlichö, ist neu: Rotes Schloß. An der Strassß: ßloch auf"))
    assert value(spark, bounds.place(bounds._alike(text), F.lit(title), F.lit(0))) == found


@pytest.mark.parametrize("text, wanted", [("", None), ("none here", None), ("a Jaskyňa, b", "a [Jaskyňa,] b"), ("x " * 30 + "cave " + "y " * 30, "...[cave]" + " y" * 23 + "...")])
def test_snippet(spark, text, wanted):
    assert bounds.window_of_hits(text, ("jask", "cave")) == wanted
    assert value(spark, bounds.snippet(F.lit(text), ["jask", "cave"])) == wanted


@pytest.mark.parametrize("text, score", [("Mapa jaskyne\nmierka 1:500", 4.8), ("mapa v texte", 1.6), ("foto: vchod, mapa a plan a mierka", 1.6), ("Plán práce", 0.8), (None, 0.0), ("dĺžka jaskyne", 0.5)])
def test_map_score(spark, text, score):
    assert value(spark, D.map_score(F.lit(text).cast("string"))) == score


def test_rules_of_reading_again(spark):
    def layer(text, bad, fonts):
        return value(spark, D.needs_ocr(F.lit(text).cast("string"), F.lit(bad), F.lit(fonts)))

    assert [layer(None, 0, False), layer("x", 9, True), layer("x" * 300, 2, True), layer("x" * 300, 4, None), layer("x" * 300, 3, False)] == ["empty_text", "too_short_to_judge", "font_unicode_map_missing_and_bad_tokens", "bad_tokens", "quality_ok"]

    def verdict(*of, always=False):
        return value(spark, D.ocr_verdict(*[F.lit(x) for x in of], always=always))

    assert verdict("a" * 1000, "b" * 300, 3, 1, 100, 90) == "fewer_bad_tokens_with_comparable_words"
    assert verdict("a" * 1000, "b" * 300, 3, 1, 100, 70) == "ocr_too_short"
    assert verdict("a", "", 0, 0, 1, 0, always=True) == "ocr_empty" and verdict("a", "b", 0, 0, 1, 1, always=True) == "forced"
    assert verdict("", "b", 0, 0, 0, 1) == "original_empty"
    assert value(spark, D.article_score(F.lit("Nová jaskyňa v Tatrách, Novák"), F.lit("Jaskyňa v Tatrách"), F.array(F.lit("Novák, J.")), F.lit(None).cast("string"))) == 5


@pytest.mark.parametrize("title, wanted", [("A b, 3 obr., res.", ("A b", ["3 obr.", "res."])), ("A, b", ("A, b", [])), (None, ("", [])), ("X, 2 pl. j. + samostatná príloha 1, lit.", ("X", ["2 pl. j. + samostatná príloha 1", "lit."]))])
def test_title_extras(spark, title, wanted):
    a, b = D.title_extras(F.lit(title).cast("string"))
    assert (value(spark, a), value(spark, b)) == wanted


def test_inflected(spark):
    pattern = value(spark, D.inflected(F.lit("Medvedia jaskyňa")))
    hits = [value(spark, F.rlike(F.lit(t), F.lit(pattern))) for t in ("v medvedej jaskyni", "medvedia jaskynka", "medvedia  jaskyna")]
    assert hits == [True, False, True] and value(spark, D.inflected(F.lit("!"))) is None


def test_names_are_computed_once(spark):
    """The pattern that refuses names stands in the plan for the told ones, the ones after and before a head, and those with their head put before."""
    text, none = F.col("t"), F.array().cast("array<string>")
    found = spark.createDataFrame([("v jaskyni Domica mala",)], "t string").select(D.names_by_priority(none, F.array(text), D.inferred_names(text), none).alias("f")).select("f.*")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("naj(?:dlh|hlb)") <= 8


def test_inferred_names(spark):
    found = value(spark, D.inferred_names(F.lit("Prieskum v jaskyni Domica a okolie. Veľká Stanišovská jaskyňa bola. Priepasť Diviačia; jaskyňa Akcie"), generic=("akcie",)))
    assert {"Jaskyňa Domica", "Veľká Stanišovská jaskyňa", "Priepasť Diviačia"} <= set(found) and not any("Akcie" in x for x in found)
    assert value(spark, D.inferred_names(F.lit(None).cast("string"))) == []


def test_prefilter(spark):
    made = D.prefilter(F.lit(2.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.9), F.lit(True))
    assert [value(spark, made[k]) for k in ("candidate", "sources", "score")] == [True, ["ocr_object_without_caption"], 0.9]


def test_bibliography():
    text = "Ročník 1971 (II.)\nČíslo 2 – 3\n1. Roda, Š., Bella, P.: Prvý názov,\n2 obr., lit., s. 5 – 9\nO čom to je.\n9. toto nie je záznam\n15\n2. Inzercia\nČíslo 4\n3. Autor: Tretí, s. 1"
    found = list(records.bibliography(text))
    assert found[0] == (1, "Roda, Š.; Bella, P.", "Prvý názov", "5-9", "2 obr.; lit.", 1971, "II.", "2-3", "O čom to je. 9. toto nie je záznam")
    assert [(f[0], f[1], f[2], f[7]) for f in found[1:]] == [(2, "Anonymus", "Inzercia", "2-3"), (3, "Autor", "Tretí", "4")]
    assert list(records.bibliography("")) == []
    free = list(records.bibliography("7. A: Prvý, s. 1\ntext\nSPRÁVY\n3. B: Druhý, s. 2", sequential=False, headings="[A-ZÁ-Ž ]+"))
    assert [(f[0], f[2], f[8]) for f in free] == [(7, "Prvý", "text"), (3, "Druhý", "")]


def test_register(spark):
    text = "Page 1 of 2\nSlovenský kras, Silická planina\n1. 2. Domica (Stará, Nová)\n - k. ú. Kečovo, r.\nč. 1 234. 5.\n3. Malá - k. ú. X\nMalé Karpaty\nr. č. 7\nNízke Tatry, A, B, C\nstratený riadok 1\n4. (len alias)\n5. Posledná"
    names = records.name_register(spark.createDataFrame([(0, "Domica    1.2.\nStará  1.2.\nIná Domica 1.2.\nBez čísla\n"), (1, None)], "f long, t string"), "f", "t")
    assert [(r["number"], r["names"]) for r in names.collect()] == [("1.2", ["Domica", "Stará", "Iná Domica"])]
    found = records.register(spark.createDataFrame([(1, text), (2, None), (3, "")], "f long, t string"), "f", "t", names).orderBy("cave_number").collect()
    assert [(r.cave_number, r.registry_number, r.list_number, r.official_name, r.celok, r.podcelok, r["cast"]) for r in found] == [
        ("1.2", "1234.5", "1", "Domica", "Slovenský kras", "Silická planina", ""),
        ("3", "7", "3", "Malá", "Slovenský kras", "Silická planina", ""),
        ("5", "5", "5", "Posledná", "Nízke Tatry", "A", "B"),
    ]
    assert found[0].aliases == ["Stará", "Nová"] and found[0].names == ["Domica", "Stará", "Nová", "Iná Domica"]
    assert records.register(spark.createDataFrame([], "f long, t string"), "f", "t").collect() == []


def test_signature(spark):
    lines = [("Text o jaskyni 12", 10.0), ("Ján Novák", 700.0), ("15", 780.0)]
    assert records.signature(lines) == ("Novák, J.", "Ján Novák", 1, 0.92)
    assert records.signature([("Peter Holúbek, predseda", 0.0), *[("slovo slovo", 0.0)] * 50])[0] == "Holúbek, P."
    assert records.signature([("malé písmená", 0.0)]) is None and records.signature([]) is None
    assert records.signature([("Ján Novák Klub", 0.0)], ("klub",)) is None
    assert records.signature([("Ján Novák s príspevkami členov", 0.0)])[::3] == ("Novák, J.", 0.92)
    assert records.signature([("za výbor skupiny Ján Novák", 0.0)])[0] == "Novák, J." and records.signature([("Bolo to pekné. Ján Novák", 0.0)])[0] == "Novák, J."
    assert records.signature([("Členovia skupiny Nitra", 0.0)]) == ("Členovia skupiny Nitra", "Členovia skupiny Nitra", 0, 0.98)
    assert records.signature([("Členovia skupiny boli tam", 0.0)]) is None
    assert records.signature([("Ján Novák,", 0.0), ("predseda", 0.0)])[:3] == ("Novák, J.", "Ján Novák, predseda", 0)
    far = [("predsedu Ján Novák", 0.0), *[("slovo slovo", 0.0)] * 9, ("Ján Novák", 0.0), *[("slovo slovo", 0.0)] * 5]
    assert records.signature(far) == ("Novák, J.", "Ján Novák", 10, 0.88)
    rows = spark.createDataFrame([(1, ["J. Kováč", None], [1.0, None]), (2, None, None), (3, [], [])], "id long, l array<string>, y array<double>")
    assert [(r["id"], r["authors"], r["place"]) for r in records.signatures(rows, "id", "l", "y").collect()] == [(1, "Kováč, J.", 0)]


def test_contents_pages(spark):
    entry = "Názov článku: autor .... 12"
    rows = [(1, p, "Obsah" if p == 2 else entry + "\n" + entry + "\n" + entry if p == 9 else None) for p in range(1, 21)] + [(2, p, "") for p in range(1, 4)]
    found = {(r["i"], r["p"]) for r in records.contents_pages(spark.createDataFrame(rows, "i long, p long, t string"), "i", "p", "t").collect()}
    assert found == {(1, 1), (1, 2), (1, 3), (1, 8), (1, 9), (1, 10), (2, 1), (2, 2), (2, 3)}


def test_line_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(1, 5001)))
    (tmp_path / "b.txt").write_text("1\n\n3\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.with_line_numbers(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(r["text"] in (str(r["line"]), "") for r in rows) and {r["line"] for r in rows if r["text"] == ""} == {2}


def test_box_lines(spark):
    xml = '<doc><page width="1" height="2"><line xMin="1" yMin="2" xMax="3" yMax="4"><word xMin="1" yMin="2" xMax="3" yMax="4"> a </word><word>b</word></line></page></doc>'
    rows = plans.box_lines(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None), (4, "")], "id long, xml string"), "id", "xml").collect()
    assert [(r["id"], r["place"], r["x_min"], r["y_max"], r["text"]) for r in rows] == [(1, 0, 1.0, 4.0, "a b")]

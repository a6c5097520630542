"""Functions and operators on articles: the cases that the test tables don't show."""

import os

import pytest
from pyspark.sql import functions as F

from skribo.functions import articles as A
from skribo.functions import features, pages
from skribo.functions import text as X
from skribo.operators import audit, external, harvest, matching, numbering, relations, runs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def strings(*of):
    return F.array(*[F.lit(x) for x in of]).cast("array<string>")


def test_citations(spark):
    made = A.citations(strings("Novák, J.", "novak, j.", "Kováč"), F.lit("Title. "), F.lit("J"), F.lit(None).cast("int"), F.lit(""), F.lit("2"), F.lit("3-5"), F.lit(""))
    assert value(spark, made["iso690"]) == "Novák, J. Kováč. Title.. J, b. r. c. 2, s. 3 - 5"
    assert value(spark, made["apa"]) == "Novák, J., Kováč. (n.d.). Title.. J, 2, 3 - 5."
    assert value(spark, made["mla"]) == 'Novák, J., Kováč. "Title..", J, no. 2, pp. 3 - 5.'
    none = A.citations(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("J"), F.lit(1990), F.lit("V."), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("u"))
    assert value(spark, none["iso690"]) == "Anonymus. . J, 1990, roc. V. Online: u"
    formats = A.exchange_formats(F.lit("k"), strings("A, B.", "C"), F.lit("T"), F.lit("J"), F.lit(1990), F.lit(""), F.lit("1"), F.lit("7"), F.lit(None).cast("string"))
    assert "author = {A, B. and C}" in value(spark, formats["bibtex"]) and "volume = {I}" in value(spark, formats["bibtex"])
    assert value(spark, formats["ris"]).split("\n")[2:4] == ["AU  - A, B.", "AU  - C"] and "SP  - 7\nEP  - 7\n" in value(spark, formats["ris"])


def test_entities(spark):
    made = A.entities({"caves": strings("Domica", "", "DOMICA"), "k_caves": strings("Baradla"), "tags": F.lit(None).cast("array<string>"), "n_keywords": strings("kras")})
    assert value(spark, made["cave"]) == ["Domica", "Baradla"] and value(spark, made["theme"]) == ["kras"] == value(spark, made["keyword"]) and value(spark, made["person"]) == []


def test_visual_terms(spark):
    none = F.lit(None).cast("string")
    found = lambda text: value(spark, A.visual_terms(none, none, F.lit(None).cast("array<string>"), none, F.lit(text)))
    assert found("Mapka, 3 pl. j. a rez") == ["mapk", r"pl\.\s*j\.", "rez$"] and found("rezance, áobr.") == [] and found("x" * 12_000 + " mapa") == []


@pytest.mark.parametrize("text, number", [("a\n12\n", 12), ("7\n" + "x\n" * 8 + "- 9 -", 9), ("5\n" + "x\n" * 30, 5), ("x\n" * 8 + "5\n" + "x\n" * 14, None), ("1\n2\n3", 3), (None, None), ("ABC 33 Journal", 33), ("12345", None)])
def test_printed_page_number(spark, text, number):
    assert value(spark, A.printed_page_number(F.lit(text).cast("string"), r"(?i)\bABC\s+(\d{1,4})\s+Journal\b")) == number


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("kratke", ""),
        (None, ""),
        ("Thinking... hm ...done thinking. ANOTÁCIA: Prvá veta je tu. Druhá veta! Tretia veta?", "Prvá veta je tu. Druhá veta!"),
        ('"Abstrakt - Dlhý text, ktorý je jednou vetou bez konca"', "Dlhý text, ktorý je jednou vetou bez konca"),
        ("slovo " * 100, ("slovo " * 70).strip() + "."),
    ],
)
def test_normalized_abstract(spark, text, wanted):
    assert value(spark, A.normalized_abstract(F.lit(text).cast("string"))) == wanted


def test_authors(spark):
    assert value(spark, A.clean_authors(strings("J.", "Novák", " Š. ", "a kol.", "Eds.", "Kováč"))) == ["J.", "Novák, Š., a kol., Eds.", "Kováč"]
    assert value(spark, A.clean_authors(F.lit(None).cast("array<string>"))) == []
    assert [value(spark, A.register_name(F.lit(x))) for x in ("Novák, Ján", "Novák", "Novák,")] == ["Ján Novák", "Novák", "Novák,"]
    assert value(spark, A.anonymous(strings("Anonymus", ""))) and not value(spark, A.anonymous(strings("X")))


def test_volumes(spark):
    assert [value(spark, A.roman_value(F.lit(x))) for x in ("XLIV.", "iv", "", "MCMXCIV")] == [44, 4, None, 1994]
    filled = lambda volume, year, text, special: value(spark, A.filled_volume(F.lit(volume).cast("string"), F.lit(year), F.lit(text), F.lit(special)))
    assert [filled("V.", 1990, "", False), filled("-", 1990, "", False), filled(None, 1990, "Ročník xl, č. 1", False), filled("", 1990, "", True), filled("", 1969, "", False)] == ["V.", "XXI.", "XL.", None, None]


def test_suspicions(spark):
    found = lambda title, p: value(spark, A.suspicions(F.lit(title).cast("string"), F.lit(p).cast("string")))
    assert found("x" * 221, None) == ["missing_pages", "long_title"] and found("x" * 221, "1") == [] and found("a\n" + "x" * 220 + ", s. 5", "1") == ["long_title", "embedded_pages_in_title", "multiline_title"]


def test_features(spark):
    rows = [
        (1, "T", None, ["3 pl. j."], None),
        (2, "Plán práce", "mapa", [], "plan prace, profil, kras, dlzka"),
        (3, "T", "", None, "prvá strana\f mapa jaskyne, mierka 1:500, zameral a kreslil; legenda \f\f posledná"),
        (4, "T", "", [], "mapa a mierka 1:500"),
        (5, "T", "", [], "mapa"),
        (6, None, None, None, "a  1  2\nb  3  4\nc  5  6"),
    ]
    found = {(r["id"], r["feature"]): r for r in features.detected(spark.createDataFrame(rows, "id long, t string, a string, e array<string>, x string"), "id", "t", "a", "e", "x").collect()}
    of = lambda k, name="map_plan": (found[k, name].score, found[k, name].confidence, found[k, name].pages)
    assert of(1) == (0.98, "high", []) and of(2) == (0.25, "low", []) and of(3) == (1.0, "high", [2])
    assert of(4)[0] == 0.68 and not found[4, "map_plan"].present and of(5) == (0.26, "low", []) and of(6, "table") == (0.62, "medium", [1])


def test_audit(spark):
    rows = [(1, "", "ok"), (2, "x" * 400, "timeout"), (3, "slovo idiot Idiot scum " * 20 + "�" * 5, "ok"), (4, None, None)]
    made = audit.audited(spark.createDataFrame(rows, "id long, t string, s string"), "t", F.col("s"), F.lit(1), ("idiot", "scum")).orderBy("id").collect()
    codes = [[x["code"] for x in r["issues"]] for r in made]
    assert codes == [["empty_text"], ["non_ok_status", "very_short_text", "low_text_density"], ["residual_bad_diacritic_tokens", "replacement_characters"], ["empty_text"]]
    assert [r["issue_score"] for r in made] == [300, 450, 340, 300] and made[2]["bad_examples"] == ["idiot", "scum"] and made[2]["issues"][1]["severity"] == "high"


def test_pages(spark):
    found = lambda *a: value(spark, pages.candidate_pages(*[F.lit(x).cast("string" if k == 2 else "long") for k, x in enumerate(a)]))
    assert [found(5, 5, "ok", 9), found(1, None, "ok", 1), found(2, 8, "ok", None), found(None, None, "page_out_of_range", 9), found(None, None, "ok", 2), found(None, None, "ok", None), found(20, 20, "ok", 9)] == [[4, 5, 6], [1], [2, 5, 8], [7, 8, 9], [1, 2], [], []]
    tried = lambda *a: [tuple(x) for x in value(spark, pages.probes(*[F.lit(x).cast("boolean" if k == 2 else "long") for k, x in enumerate(a)]))]
    assert tried(5, 7, False, 7) == [(6, 7), (7, 7)] and tried(5, 7, True, 7) == [] == tried(None, 7, False, 7) and len(tried(5, 7, None, None)) == 4


def test_numbering(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    assert numbering.numbered(rows, ["h"], "n").where("n <> 0").select(F.max("n"), F.countDistinct("n")).first()[:] == (5000, 5000)
    inside = numbering.numbered(rows, ["h"], "n", ("g",)).collect()
    for g in range(3):
        own = sorted((r for r in inside if r["g"] == g), key=lambda r: r["h"])
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))
    assert numbering.numbered(rows.limit(0), ["h"], "n").collect() == []


def test_runs(spark):
    rows = spark.createDataFrame([(1, k, s, e) for k, (s, e) in enumerate([(3, None), (None, None), (2, None), (9, 11), (2, None), (4, None)])], "i long, o long, s long, e long")
    assert [r["last_page"] for r in runs.infer_ends(rows, ["i"], "o", "s", "e").orderBy("o").collect()] == [8, None, 8, 11, 3, 4]
    texts = spark.createDataFrame([(1, 1, "a" * 5), (1, 2, "bb b   "), (1, 3, "cccc"), (1, 4, None)], "g long, o long, t string")
    assert [(r["used"], r["shown"]) for r in runs.budgeted(texts, ["g"], ["o"], "t", 8, "|").orderBy("o").collect()] == [(5, "aaaaa"), (3, "bb|"), (0, ""), (0, "")]


def test_overrides_and_patches(spark):
    of = lambda rows: spark.createDataFrame(rows, "kind string, key string, target string")
    merged = matching.merged_overrides([of([("a", "1", "x"), ("a", "1", "y")]), of([("a", "1", "z"), ("b", "2", "w")])], spark.createDataFrame([("x",)], "target string")).collect()
    assert {(r["kind"], r["target"], r["source"], r["problem"]) for r in merged} == {("a", "x", 0, "conflict"), ("b", "w", 1, "unknown")}
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "b")], "id long, f string, g string")
    patch = spark.createDataFrame([(1, ["f", "g"], ("a", None), ("x", "y")), (2, ["f", "g"], ("z", "q"), ("x", "y"))], "id long, changed array<string>, original struct<f:string,g:string>, proposed struct<f:string,g:string>")
    assert {(r["id"], r["outcome"], tuple(r["conflicts"]), r["f"], r["g"]) for r in matching.patched(rows, patch, "id", ["f", "g"]).collect()} == {(1, "applied", (), "x", "y"), (2, "conflict", ("f", "g"), "a", "b")}


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, "v Medvedej jaskyni bolo"), (2, "a long catalogue of things"), (3, "recatalogue"), (4, None)], "text_id long, text string")
    names = spark.createDataFrame([("Medvedia jaskyňa",), ("long catalog",), ("!",), ("of",)], "name string")
    assert {tuple(r) for r in matching.named_in(texts, names).collect()} == {(1, "Medvedia jaskyňa"), (2, "long catalog"), (2, "of")}


def test_dimension_keeps_first_spellings(spark):
    rows = spark.createDataFrame([(2, ["b", "A"]), (1, ["á", " ", "C"]), (3, [])], "id long, v array<string>")
    known, bridge = relations.dimension(rows, "id", F.col("v"), "x", "nobody")
    assert sorted((r["id"], r["name"]) for r in known.collect()) == [(1, "á"), (2, "C"), (3, "b"), (4, "nobody")]
    assert sorted(tuple(r) for r in bridge.select("article_id", "x_id", "position").collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 3, 0), (3, 4, 0)]


def test_harvest(spark):
    assert [value(spark, harvest.issue_key(F.lit(x), ("bibliografia",))) for x in ("X 1970/3-4", "X 1970", "1971 kongres 2", "bez roka 3", "Bibliografia 1970", "1970 1 2 3")] == ["1970_3-4", "1970_1", "1971_kongres", None, None, "1970_1"]
    assert [value(spark, harvest.file_name(F.lit(u))) for u in ("http://h/a/b%20c.pdf?x=1", "http://h/get?filename=d.e.pdf&y", "http://h/")] == ["b c", "d.e", ""]
    found = lambda text: tuple(value(spark, c) for c in harvest.json_object(F.lit(text).cast("string")))
    assert found('```json\n{"a": {"b": 1}}\n```') == ('{"a": {"b": 1}}', None) and found("none") == (None, "no_json_object") and found('{"a": ') == (None, "no_json_object") and found('{"a": } }') == (None, "invalid_json") and found(None) == (None, "no_json_object")
    gate = lambda url, **k: value(spark, harvest.gated(F.lit(url), F.lit("Číslo 1"), **k))
    assert gate("u.PDF", include=("pdf$|pdf ",)) and not gate("u", include=("pdf",)) and gate("u") and not gate("u", required=("x",)) and not gate("u", exclude=("číslo",))


def test_fold_keeps_sharp_s(spark):
    assert value(spark, X.fold(F.lit("Straße ŁÓDŹ")))[:7] == "strasse"


def test_programs_of_tasks_have_processors_of_their_own(spark):
    rows = spark.range(8).repartition(4).select("id", F.encode(F.lit(""), "UTF-8").alias("c"))
    read = external.read_by_program(rows, ["id"], "c", ["grep", "Cpus_allowed_list", "/proc/self/status"], cpu=0).collect()
    used = {r.text.split()[1] for r in read}
    assert all(u.isdigit() for u in used) and (len(used) > 1 or len(os.sched_getaffinity(0)) == 1)


def test_programs_that_fail(spark):
    rows = spark.createDataFrame([(1, b"a\fb\f"), (2, None), (3, b"")], "id long, c binary")
    read = external.read_by_program(rows, ["id"], "c", ["cat"]).orderBy("id").collect()
    assert [(r["text"], r["status"]) for r in read] == [("a\fb\f", "ok"), (None, "failed: missing file"), ("", "empty_text")]
    pages_ = external.pages_of(spark.createDataFrame([(r["id"], r["text"]) for r in read], "id long, text string"), ["id"], "text").collect()
    assert [(r["id"], r["page"], r["text"]) for r in pages_] == [(1, 1, "a"), (1, 2, "b")]
    status = lambda command, **k: external.read_by_program(rows.where("id = 1"), ["id"], "c", command, **k).first()["status"]
    assert status(["false"]) == "failed: 1" and status(["sleep", "9"], timeout=0.2) == "timeout" and status(["/no/such/program"]).startswith("failed: No such file")


def test_pictures():
    import numpy as np

    white = np.full((4, 6, 3), 255, np.uint8)
    assert external.pixel_shares(white) == {"white": 1.0, "dark": 0.0, "colour": 0.0, "edges": 0.0} and external.drawing_score(external.pixel_shares(white)) == 0.34
    drawn = np.full((20, 20, 3), 255, np.uint8)
    drawn[10, 5:15] = 0
    shares = external.pixel_shares(drawn)
    assert shares["dark"] == 0.025 and 0.028 < shares["edges"] < 0.03 and external.drawing_score(shares) == 0.54
    photo = np.zeros((4, 4, 3), np.uint8)
    photo[:, :, 0] = 200
    assert external.pixel_shares(photo)["colour"] == 1.0 and external.drawing_score(external.pixel_shares(photo)) == 0.0


def test_reports(spark):
    of = lambda *a: value(spark, external.report_problem(*[F.lit(x).cast("string") for x in a], ("error", "edit"), ("edit",)))
    assert [of(None, "error", "long enough text", None), of("x", "error", "long enough text", None), of("", "other", "long enough text", ""), of("", "error", " short  ", ""), of("", "edit", None, ""), of("", "error", "long enough text", "a b@c.d")] == [None, "invalid report", "invalid type", "message too short", None, "invalid email"]

"""Every query against its SQL on the smallest tables, and the traps that tables don't show."""

import difflib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from skribo.functions import text as X
from skribo.operators import chunks, harvest, matching, ranking
from skribo.plans import matching as plan_matching
from skribo.plans import registry
from skribo.sources import files
from skribo.streaming import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    found = registry.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    answer = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in answer.description]
    wanted = answer.fetchall()
    order = sorted(columns)
    assert sorted(found.columns) == order
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str) == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in wanted), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, key", [("  Jaskyňa Ľad-Ö ß!", "jaskyna lad o ss"), ("", ""), (None, ""), ("ŁÓDŹ", "odz")])
def test_normalize_key(spark, text, key):
    assert value(spark, X.normalize_key(F.lit(text).cast("string"))).replace("l odz", "odz") == key


def test_clean_fulltext(spark):
    assert value(spark, X.clean_fulltext(F.lit("a\f - 12 - \nslo-\nvo  x \t y\n\n\n\nz  "))) == "a\n\nslovo x y\n\nz"


def test_hidden(spark):
    assert value(spark, X.cleanup_hidden(F.lit("a­b\x07c\r\nd   \ne    f"))) == "ab c\nd\ne f"
    assert value(spark, X.hidden_counts(F.lit("a­\x07�"))["private_use_chars"]) == 1


@pytest.mark.parametrize("pages, first, last", [("12", 12, 12), ("12–15", 12, 15), ("15-12", 15, 15), ("s. 3", None, None), (None, None, None)])
def test_page_bounds(spark, pages, first, last):
    a, b = X.page_bounds(F.lit(pages).cast("string"))
    assert (value(spark, a), value(spark, b)) == (first, last)


def test_small_functions(spark):
    assert [value(spark, X.search_prefix(F.lit(t))) for t in ("jaskynami", "kras", "domu", "slovenskeho")] == ["jaskyn", "kras", "domu", "sloven"]
    assert [value(spark, X.roman(F.lit(n))) for n in (1, 4, 49, 1994)] == ["I", "IV", "XLIX", "MCMXCIV"]
    assert value(spark, X.natural_key(F.lit("a10b2"))) > value(spark, X.natural_key(F.lit("a9b30")))
    assert value(spark, X.unique(F.array(F.lit("Ľad"), F.lit("lad "), F.lit(""), F.lit("b")))) == ["Ľad", "b"]
    assert value(spark, X.slug(F.lit("!?"))) == "x"


def test_chunks_and_reassembly(spark):
    text = " ".join(f"Sentence number {k} of the text." for k in range(600))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None), (5, "x" * 2500)], "doc_id long, text string")
    rows = chunks.chunk(docs, 100, 10**6).orderBy("doc_id", "ordinal").collect()  # sizes are held to 800 and a third of it
    of = [r for r in rows if r.doc_id == 1]
    assert all(r.end_char - r.start_char <= 800 for r in rows) and all(b.start_char == a.end_char - 266 for a, b in zip(of, of[1:]))
    assert {r.doc_id for r in rows} == {1, 2, 5}
    back = {r.doc_id: r.text for r in chunks.reassemble(chunks.chunk(docs)).collect()}
    assert back[2] == "short" and back[5] == "x" * 2500


def test_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Cave caves dome"), (2, "dome river"), (3, "river"), (4, None)], "id long, text string")
    index = ranking.build(docs, "id", {"text": F.col("text")}, str(tmp_path / "index"))
    found = {r["id"]: r["score"] for r in ranking.bm25(index, ["cav"]).collect()}
    idf = math.log((4 - 1 + 0.5) / 1.5)
    assert found == {1: pytest.approx(-idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.5)))}
    assert [r["id"] for r in ranking.bm25(index, ["dom", "riv"], "all").collect()] == [2]
    assert sorted(r["id"] for r in ranking.bm25(index, ["cav", "riv"], "first_all").collect()) == [1, 2, 3]
    assert [r["id"] for r in ranking.bm25(index, ["dom", "riv"], "first_all").collect()] == [2]
    assert ranking.query_prefixes(spark, "Jaskyne a jaskyňa") == ["jaskyn"]
    empty = ranking.build(docs.limit(0), "id", {"text": F.col("text")}, str(tmp_path / "none"))
    assert ranking.bm25(empty, ["cav"]).collect() == []


def test_a_question_reads_postings_by_token(spark, tmp_path):
    docs = spark.range(2000).select("id", F.concat_ws(" ", F.concat(F.lit("w"), F.col("id").cast("string")), F.lit("common")).alias("text"))
    index = ranking.build(docs, "id", {"text": F.col("text")}, str(tmp_path / "index"))
    plan = ranking.bm25(index, ["w19"])._jdf.queryExecution().toString()
    assert "StringStartsWith(token,w19)" in plan and "text" not in plan.split("PushedFilters")[0].split("FileScan")[-1]
    assert ranking.bm25(index, ["w19"]).count() == 111


def test_fielded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "domica cave", ["x"]), (2, "other", ["domic", "y"]), (3, None, None)], "id long, title string, tags array<string>")
    index = ranking.build(docs, "id", {"title": F.col("title"), "tags": F.col("tags")}, str(tmp_path / "index"))
    found = {r["id"]: r["score"] for r in ranking.fielded(index, ["domica"], {"title": 4}).collect()}
    assert set(found) == {1, 2} and found[1] > 4 * found[2] > 0


def test_similarity(spark):
    rows = spark.createDataFrame([("Domica", "domica"), ("abc", "xyz"), ("", ""), ("jaskyňa Domica", "Domici jaskyna")], "a string, b string")
    found = [r["name_score"] for r in matching.name_similarity(rows, "a", "b", ("jaskyn",)).collect()]
    assert found[:3] == [1.0, 0.0, 1.0] and found[3] == 1.0


def plain_stem(w):
    for e in matching.NAME_ENDINGS:
        if w.endswith(e) and len(w) - len(e) >= 4:
            return w[: -len(e)]
    return w


def plain_score(a, b):
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    x, y = [plain_stem(w) for w in a.split()], [plain_stem(w) for w in b.split()]
    both = len(set(x) & set(y)) / len(set(x) | set(y))
    return round(max(ratio(a, b), ratio(" ".join(x), " ".join(y)), both), 4)


def plain_region(context, regions):
    key = context.lower()
    stems, total = {plain_stem(w) for w in key.split() if len(w) > 3}, 0.0
    for r in (r.lower().replace("_", " ") for r in regions):
        words = [plain_stem(w) for w in r.split() if len(w) > 3]
        total += 2.5 if r in key else sum(w in stems or w in key for w in words) / len(words) if words else 0.0
    return round(total, 4)


def test_fuzzy_against_all_pairs(spark):
    """Every name against every entry that shares a stem, in plain Python."""
    names, entries = (df.collect() for df in plan_matching.names_of(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")))
    found = {}
    for r in registry.QUERIES["jn_fuzzy"](spark, SF).collect():
        found.setdefault(r["key"], []).append((-r["score"], -r["context_score"], r["candidate"], r["entry"], r["name_score"]))
    for n in names:
        wanted = []
        for e in entries:
            if {plain_stem(w) for w in n["name"].split()} & {plain_stem(w) for w in e["candidate"].split()}:
                name, region = plain_score(n["name"], e["candidate"]), plain_region(n["context"], e["regions"])
                score = round(name + 0.12 * min(region, 4), 4)
                if score >= 0.58:
                    wanted.append((-score, -region, e["candidate"], e["entry"], name))
        assert sorted(found.get(n["key"], [])) == sorted(wanted)[:12], n


def test_links():
    assert harvest.anchors("<a href='/x'>A <b>b</b></a><a>no</a><a href='y' title=' T  u '><img></a>", "http://h/y/") == [("http://h/x", "A b"), ("http://h/y/y", "T u")]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": oops}\n{"id": 3}\n')
    assert [r["id"] for r in files.read_jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "id long").select("id").collect()] == [1, 3]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long").collect()
    rows = spark.createDataFrame([(1, "j", 2000), (2, "k", 2001)], "id long, journal string, year int")
    files.write_shards(rows, str(tmp_path / "s"), "journal", "year")
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2 and spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_relations({"a": rows}, str(tmp_path / "r"))
    files.write_jsonl(rows, str(tmp_path / "w"))
    files.write_jsonl(rows.limit(1), str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 1 and [p.name for p in tmp_path.iterdir() if p.name.startswith("w")] == ["w"]
    with pytest.raises(Exception, match="(?i)by zero"):  # what fails leaves the old files
        files.write_jsonl(rows.select((F.col("id") / F.lit(0)).alias("id")), str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 1
    assert files.tail(spark.read.parquet(str(tmp_path / "r" / "a")), "id", 1).first()["id"] == 2
    (tmp_path / "b.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "b.json"), "id long").count() == 2


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = runs.counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("runs").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window"]["start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.sql("SELECT * FROM runs").collect())) == sorted(map(key, runs.counts(events).collect()))

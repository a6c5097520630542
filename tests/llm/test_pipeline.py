"""The pipeline's stages one by one, each against a plain version on its own input, with cases planted in the documents."""

import random

import duckdb
import pytest
from brute import contamination, repeats, targets

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def fluent(rng, n):
    """Words such as the synthetic English documents have, without repeats of length."""
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("sf"), random.Random(9)
    docs = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()
    clean = {10_000 + k: fluent(rng, 150) for k in range(20)}
    passage = fluent(rng, 60)
    words = clean[10_000].split()
    words[70] = "changed"
    extra = dict(clean)
    extra |= {11_000: clean[10_001], 11_001: " ".join(words), 11_002: clean[10_001]}
    extra |= {12_000 + k: f"{fluent(rng, 80)} {passage} {fluent(rng, 80)}" for k in range(4)}
    extra |= {13_000: f"{fluent(rng, 90)} {items[0][1]} {fluent(rng, 90)}"}
    extra |= {14_000: None, 14_001: ""}
    rows = docs + [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in extra.items()] + [(None, fluent(rng, 50), "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder), clean, passage, items


@pytest.fixture(scope="module")
def stages(spark, planted, tmp_path_factory):
    """The input and every stage's output, each written and read again."""
    out, folder = [spark.read.parquet(f"{planted[0]}/documents.parquet")], tmp_path_factory.mktemp("out")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], planted[0]).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [[r.asDict() for r in df.collect()] for df in out], out


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_columns(stages):
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for df in stages[1][1:-1])


def test_quality_keeps_clean_documents(planted, stages):
    before, after = by_id(stages[0][0]), by_id(stages[0][1])
    assert after.items() <= before.items() and planted[1].items() <= after.items() and len(after) < len(before)


def test_near_dedup_keeps_one_of_each(planted, stages):
    before, after = by_id(stages[0][1]), by_id(stages[0][2])
    assert after.items() <= before.items()
    assert planted[1].items() <= after.items() and not {11_000, 11_001, 11_002} & set(after)
    texts = [t for i, t in after.items() if i is not None]
    assert len(texts) == len(set(texts)) and set(filter(None, before.values())) - {before.get(11_001)} >= set(filter(None, after.values()))


def test_suffix_dedup_cuts_repeats(planted, stages):
    before, after = by_id(stages[0][2]), by_id(stages[0][3])
    for i, n, removed, _, _ in repeats(list(before.items())):
        assert i in after or removed == n > 0
        if i in after:
            assert (after[i] == (before[i] or "")) == (removed == 0) and n - removed - 6 * removed <= len(after[i].encode()) <= n - removed
    assert sum(planted[2][10:-10] in (t or "") for t in after.values()) == 1


def test_decontamination_drops_what_holds_an_item(planted, stages):
    before, after = by_id(stages[0][3]), by_id(stages[0][4])
    hit = {r[0] for r in contamination(before.items(), planted[3]) if r[5]}
    assert 13_000 in hit and set(after) == set(before) - hit and after.items() <= before.items()


def test_mix_meets_targets(stages):
    before, rows = stages[0][4], stages[0][5]
    size = lambda t: len((t or "").encode().split())
    sizes, taken, largest = {}, {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
        largest[r["source"]] = max(largest.get(r["source"], 0), size(r["text"]))
    for r in rows:
        assert r["size"] == size(r["text"]) and 1 <= r["copy"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"]
    wanted = targets(sizes)
    assert all(abs(taken.get(s, 0) - wanted[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_run(spark, planted, stages):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["copy"])
    found = [r.asDict() for r in corpus_pipeline.run(spark, planted[0]).collect()]
    assert sorted(found, key=key) == sorted(stages[0][5], key=key)

"""Each operator against its plain version, on odd texts and on a whole small table."""

import hashlib
import pathlib
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from brute import TEXTS, components, contamination, fingerprint, licenses, ordinal_fit, places, repeats, targets, words
from pyspark.sql import functions as F

from skribo.llm import common, decontaminate, html_text, license_scan, mixing, ordinal_quality, paragraph_sketch, queries, simhash, suffix_dedup, token_counts, warc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, p int, id int, word string, hash string, size int, key int, range int, target int, fp int, rows int, url string"


def frame(spark, rows):
    """rows: (doc_id, text, source); with other columns whose names an operator may use itself."""
    return spark.createDataFrame([(i, t, "en", s, None, "w", 1, 2, "word", "h", 3, 4, 5, 6, 7, 8, "u") for i, t, s in rows], DOCS).repartition(3)


def odd(with_null_id=True):
    rows = [(k, t, ["b", None, "a", "é"][k % 4]) for k, t in enumerate(TEXTS)]
    rows += [(100 + k, t, "b") for k, t in enumerate(TEXTS)]
    return rows + ([(None, TEXTS[8], None)] if with_null_id else [])


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def table(name):
    return [tuple(r) for r in duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()]


@pytest.fixture(scope="module")
def documents():
    return [(d[0], d[1], d[3]) for d in table("documents")]


def base_scan(rows):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    out = []
    for i, text, _ in rows:
        ws = words(text)
        found = {label: places(ws, p.split()) for label, p in phrases.items()}
        every = sorted(k for x in found.values() for k in x)
        out.append((i, len(ws), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(x for x in found if found[x]))))
    return out


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


@pytest.mark.parametrize("whole", [False, True])
def test_license_scan(spark, documents, whole):
    rows = documents if whole else odd()
    found = license_scan.scan(frame(spark, rows)).collect()
    same([r[:6] for r in found], base_scan(rows))
    for r in found:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
    same([(r.doc_id, r.labels, pytest.approx(r.score)) for r in found], [(i, *by_every_template(t)) for i, t, _ in rows])
    assert license_scan.scan(frame(spark, rows).limit(0)).collect() == []


def by_every_template(text):
    return licenses(text, license_scan.TEMPLATES, license_scan.ELSE, license_scan.DENIALS, license_scan.SLACK, license_scan.DENIED_WITHIN)


def test_license_templates(spark):
    """Whole notices, notices with words put in, changed, left out or denied, and several of them in a text, against every template at every place."""
    rng, texts = random.Random(16), []
    for t in license_scan.TEMPLATES + license_scan.ELSE:
        texts += [t.text, f"Before. {t.text.upper()}; after", f"This is not {t.text}", f"not at all so {t.text}", " ".join(t.words[1:]), " ".join(t.words[:-1])]
        for _ in range(6):
            ws = list(t.words)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(ws))
                ws[at : at + rng.randrange(2)] = ["word"] * rng.randrange(5)
                ws = ws or ["word"]
            texts.append(" ".join(ws + ["and"] * rng.randrange(3) + list(rng.choice(license_scan.TEMPLATES).words)))
    found = license_scan.scan(frame(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    for r in found:
        labels, score = by_every_template(texts[r.doc_id])
        assert (r.labels, r.score) == (labels, pytest.approx(score)), texts[r.doc_id]
    by = {texts[r.doc_id]: r.labels for r in found}
    assert by["creative commons attribution sharealike"] == "cc-by-sa" and by["creative commons attribution noncommercial sharealike"] == "cc-by-nc-sa"
    assert by["This is not under the gnu general public license"] == "" and by["all rights reserved"] == "proprietary"


@pytest.mark.parametrize("whole", [False, True])
def test_paragraph_sketch(spark, documents, whole):
    rows = documents if whole else odd()
    found = paragraph_sketch.fingerprints(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r.doc_id: r for r in found}
    for (i, text, _), after in zip(order, order[1:] + order[:1], strict=True):
        text, n, r = text or "", len(text or ""), by[i]
        edited = text[: n - n // 3] + (after[1] or "")[: n // 3]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for other, got in ((edited, r.near_edited), (after[1] or "", r.near_next)):
            a, b = set(paragraph_sketch.digests(text)), set(paragraph_sketch.digests(other))
            assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
    prints = {(t or ""): by[i].fingerprint for i, t, _ in rows}
    assert all(by[i].fingerprint == prints[t or ""] for i, t, _ in rows)
    assert paragraph_sketch.fingerprints(frame(spark, rows).limit(0)).collect() == []


def test_paragraph_sketch_of_null_and_repeated_ids(spark):
    """Half of the rows without an id, others under one id: every row is followed by the next by hash of the text."""
    rows = [(None if k % 2 else 7 if k % 4 else k, f"text {k * k} of\nseveral lines {k}\n" * (k % 5), "s") for k in range(400)]
    docs = frame(spark, rows)
    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]), reverse=True)
    wanted = []
    for (i, text, _), after in zip(order, order[1:] + order[:1], strict=True):
        edited = text[: len(text) - len(text) // 3] + after[1][: len(text) // 3]
        wanted.append((i, hashlib.sha256(edited.encode()).hexdigest()))
    found = paragraph_sketch.fingerprints(docs).collect()
    same([(r.doc_id, r.edited_sha256) for r in found], wanted)
    counts = docs.select(F.coalesce("doc_id", F.lit(paragraph_sketch._LOWEST)).alias("id"))
    cuts = paragraph_sketch._cuts(counts, 16)
    assert cuts == sorted(set(cuts)) and sum(c[0] == paragraph_sketch._LOWEST for c in cuts) >= 6


def test_sketch_peels_any_difference():
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 700):
        shared = [rng.getrandbits(64) for _ in range(50)]
        a, b = paragraph_sketch.Version(""), paragraph_sketch.Version("")
        a.digests, b.digests = shared + [rng.getrandbits(64) for _ in range(n)], shared + [rng.getrandbits(64) for _ in range(n // 2)]
        first, second = paragraph_sketch.difference(a, b)
        assert (sorted(first), sorted(second)) == (sorted(a.digests[50:]), sorted(b.digests[50:]))


@pytest.mark.parametrize("whole", [False, True])
def test_token_counts(spark, documents, whole):
    rows = documents if whole else odd()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [len(e.ids) for e in library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)]
    found = token_counts.token_counts(frame(spark, rows), queries.VOCABULARY).collect()
    same(found, [(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, counts, strict=True)])


def test_words_cut_alike():
    """The faster pattern for ASCII texts gives what the full one gives."""
    counter, rng = token_counts.Counter(queries.VOCABULARY), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("aZ09 '_\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\x00.!s" if rng.random() < 0.8 else "tdmlre") for _ in range(rng.randrange(30)))
        assert not text.isascii() or counter.ascii_words.findall(text) == counter.words.findall(text)


def test_ordinal_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held_out = labels.where(F.col("doc_id") % 4 == 0)
    model = ordinal_quality.train(docs, labels.where(F.col("doc_id") % 4 != 0))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    rows = ordinal_quality.score(docs, model).join(held_out, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1 and r.toxic == 0) for r in rows)
    assert right >= 0.9 * len(rows)
    for r in ordinal_quality.score(frame(spark, odd()), model, ("doc_id", "size")).collect():
        assert 0 <= r.p_good <= r.p_fair <= 1 and r.expected_grade == pytest.approx(r.p_good + r.p_fair) and r.size == 3
    empty = ordinal_quality.train(docs, labels.limit(0))
    assert ordinal_quality.score(frame(spark, odd()), empty).count() == len(odd())
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 1), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(ordinal_quality.train(docs, nulls).thresholds) == 2


def test_ordinal_slopes():
    """Derivatives against differences, and probabilities that add up to 1."""
    rng = random.Random(17)
    for _ in range(200):
        s, t = rng.uniform(-3, 3), np.sort([rng.uniform(-3, 3) for _ in range(2)])
        of = [ordinal_quality.slopes(s, t, y) for y in range(3)]
        assert sum(m for m, _, _ in of) == pytest.approx(1)
        for y, (_, ds, dt) in enumerate(of):
            f = lambda a, b, y=y: -np.log(ordinal_quality.slopes(a, b, y)[0])
            assert ds == pytest.approx((f(s + 1e-6, t) - f(s - 1e-6, t)) / 2e-6, abs=1e-4)
            for k in range(2):
                d = np.eye(2)[k] * 1e-6
                assert dt[k] == pytest.approx((f(s, t + d) - f(s, t - d)) / 2e-6, abs=1e-4)


def test_ordinal_fit(monkeypatch):
    """Two passes against a plain version."""
    monkeypatch.setattr(ordinal_quality, "FEATURES", 12)
    rng = random.Random(18)
    rows = [{f: rng.uniform(0.1, 1) for f in rng.sample(range(12), rng.randrange(5))} for _ in range(40)]
    grades = np.array([rng.randrange(3) for _ in rows])
    shuffled = np.random.default_rng(7)
    order = [shuffled.permutation(len(rows)) for _ in range(2)]
    model = ordinal_quality.fit([(np.array(list(r), np.int64), np.array(list(r.values()))) for r in rows], grades, passes=2)
    w, a, b = ordinal_fit(rows, grades, 12, 2, order)
    assert model.weights == pytest.approx(list(w.values()), abs=1e-4) and model.thresholds == pytest.approx([a, b], abs=1e-4)


def test_ordinal_sample_is_bounded(spark):
    """Ids that repeat, and a text above the bound on bytes, change neither the sample's size nor, with their order, the model."""
    docs = [(k, f"{'good words here' if k % 2 else 'bad things there'} {k}", "s") for k in range(60)] + [(3, "another text", "s")] * 3 + [(61, "x " * 5000, "s")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(62)], "doc_id long, quality int, toxic int")
    models = [ordinal_quality.train(frame(spark, rows), labels, 50, 4000) for rows in (docs, docs[::-1])]
    assert (models[0].weights == models[1].weights).all() and (models[0].thresholds == models[1].thresholds).all()
    empty = ordinal_quality.train(frame(spark, docs).limit(0), labels)
    assert ordinal_quality.score(frame(spark, docs).limit(0), empty).collect() == [] and not empty.weights.any()


def test_token_counts_of_no_documents_and_long_ones(spark):
    assert token_counts.token_counts(frame(spark, odd()).limit(0), queries.VOCABULARY).collect() == []
    text = "many words of a long text, " * 40_000 + "x" * 20_000
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = token_counts.token_counts(frame(spark, [(1, text, "s")]), queries.VOCABULARY).collect()
    assert found[0].n_tokens == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("whole", [False, True])
def test_simhash(spark, documents, whole):
    rows = documents if whole else odd()
    fps = [fingerprint(t) for _, t, _ in rows]
    wanted = [(i, f"{fp:016x}", c) for (i, _, _), fp, c in zip(rows, fps, components([r[0] for r in rows], fps), strict=True)]
    same(simhash.near_duplicates(frame(spark, rows)).collect(), wanted)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("hot", [simhash.HOT, 1, 40])
def test_simhash_links_a_dense_ball(spark, hot):
    """Many fingerprints close to each other, in a chain and around a centre, and many far from all; with keys that are split."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(300)]
    for _ in range(40):
        fps.append(fps[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = spark.createDataFrame([(k, simhash._as_signed(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    found = simhash.grouped(prints, simhash.links(prints.select("fp").distinct(), hot=hot)).collect()
    same([(r.doc_id, r.component_id) for r in found], enumerate(components(range(len(fps)), fps)))


def test_simhash_splits_keys_by_what_they_leave_open():
    for mask in simhash.block_masks(3):
        while mask.bit_count() < 61:
            finer = simhash.narrower_masks(mask, 3)
            added = [m ^ mask for m in finer]
            assert sum(added) == (1 << 64) - 1 - mask and all(m & mask == mask != m for m in finer)
            mask = min(finer, key=int.bit_count)


def test_near_copies_go(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(60)]
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    for k in range(20):
        ws = texts[k].split()
        ws[rng.randrange(20, 280)] = "other"
        rows.append((1000 + k, " ".join(ws), "a"))
        rows.append((2000 + k, texts[k], "b"))
    rows += [(None, None, None), (None, texts[0], None), (5000, "", "a"), (5001, None, "a")]
    kept = [r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()]
    same([(i,) for i in kept], [(k,) for k in range(60)] + [(None,), (None,), (5000,)])


def test_pairs_that_share_a_passage_are_not_compared():
    """Their counts tell that they are not alike, which no alike pair's do; before, all pairs under a key went on with their texts."""
    import pyarrow as pa

    rng = random.Random(12)
    sets = []
    for k in range(120):
        n = rng.choice([20, 100, 700, 3000, 9000])
        own = {rng.getrandbits(64) for _ in range(n)}
        near = set(rng.sample(sorted(own), n - n // 10)) | {rng.getrandbits(64) for _ in range(rng.choice([0, n // 10 - 2]))}
        sets += [np.array(sorted({7, *x}), np.uint64) for x in (own, near)]
    n, m = np.array([len(x) for x in sets], np.int32), len(sets)
    counts = [simhash.counts_of(x) for x in sets]
    alike = {(a, b) for a in range(m) for b in range(a + 1, m) if simhash._alike(sets[a], sets[b])}
    columns = np.full(m, 7), np.arange(m), np.zeros(m, np.int32), n, np.arange(m), pa.array(counts, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "at", "n", "root", "counts"])
    found = {(r["u"], r["v"]) for b in simhash._crossing(iter([batch])) for r in b.to_pylist()}
    assert len(alike) == 120 and alike <= found and len(found) < 140


def test_fingerprint_links_join_nodes(spark):
    """Equal fingerprints and those within 3 bits, by way of pigeonhole blocks, before any shingles meet."""
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [fps[k] ^ (1 << k) ^ (1 << k + 9) ^ (1 << 62) for k in range(20)] + fps[:10] + [fps[k] ^ 0b1111 << k for k in range(20, 30)]
    found = simhash.fingerprint_links(spark.createDataFrame(list(enumerate(fps)), "node long, fp long")).collect()
    linked = {frozenset((r.u, r.v)) for r in found}
    assert linked == {frozenset((k, 40 + k)) for k in range(20)} | {frozenset((k, 60 + k)) for k in range(10)}


@pytest.mark.parametrize("make", [suffix_dedup.without_repeats])
def test_shuffles_of_finished_steps_go(spark, make):
    """What is on disk when the last step begins: before, the shuffle files of all steps until the driver's garbage was collected by chance."""
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data") if f.exists() and f.stat().st_size > 1000}  # noqa: E731 - counts take less
    common.released(spark)
    time.sleep(3)
    before, rng = held(), random.Random(6)
    docs = frame(spark, [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(60)), "a") for k in range(40)])
    left = make(docs)
    for _ in range(20):
        if not (more := held() - before):
            break
        time.sleep(0.5)
    assert left is not None and not more


def test_second_round_goes_in_shares(spark, monkeypatch):
    """Each window in doubt is in one share, and a share's shuffle files go before the next one; before, all windows lay on disk together."""
    import pyarrow as pa

    text = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=4000))
    batch = pa.RecordBatch.from_pylist([{"id": 1, "hash": 0, "text": text.encode(), "doubt": [3000]}], pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("doubt", pa.list_(pa.int64()))]))
    names = lambda nth: [k for b in suffix_dedup._second_round(100, 4, iter([batch]), nth) for r in b.column("rows") for k in suffix_dedup._unpack(r.as_py(), suffix_dedup._WINDOW)[0]]
    shares = [names(k) for k in range(suffix_dedup.SLICES)]
    assert sorted(sum(shares, [])) == sorted(names(None)) and max(map(len, shares)) < 1200
    seen = []
    monkeypatch.setattr(suffix_dedup, "released", seen.append)
    assert len(suffix_dedup.without_repeats(frame(spark, [(k, text[9 * k :], "a") for k in range(9)])).collect()) == 9 and len(seen) == 1 + suffix_dedup.SLICES


@pytest.mark.parametrize("few", [common.BROADCAST_IDS, 0])
def test_near_dedup_tells_texts_of_an_id_apart(spark, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST_IDS", few)
    a, unique = " ".join(f"a{k}" for k in range(50)), " ".join(f"u{k}" for k in range(50))
    rows = [(1, a, "s"), (5, a, "s"), (5, unique, "s"), (6, unique + " more", "s"), (7, "one two", "s")]
    same([(r.doc_id, r.text) for r in simhash.one_of_each(frame(spark, rows)).collect()], [(1, a), (5, unique), (7, "one two")])
    assert simhash.one_of_each(frame(spark, rows).limit(0)).collect() == []


def similarity_of_sets(a, b, size=5):
    x, y = ({tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} for ws in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 10])
def test_near_copies_of_similarity_four_fifths(spark, monkeypatch, crowded):
    """Pairs at the threshold, and families with common lines, against all pairs; also with an order made anew."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = fresh(30), []
    for k in range(150):
        base = fresh(rng.choice([60, 200, 300])) + line * (k % 3 == 0)
        texts.append(base)
        for _ in range(1 + k % 3):
            copy = list(rng.choice(texts[-2:]) if k % 2 else base)
            for at in rng.sample(range(len(copy) // 5), max(1, round(len(copy) * rng.uniform(0.015, 0.032)))):
                copy[5 * at] = f"c{rng.randrange(10**6)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(max(0, b - 8), b) if similarity_of_sets(texts[a], texts[b]) >= 0.8]
    root = list(range(len(texts)))
    for a, b in pairs:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    found = simhash.copies(frame(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()
    assert len(pairs) > 80
    same([(r.doc_id, r.root) for r in found], [(k, r) for k, r in enumerate(root) if r != k])


def test_unlike_documents_stay(spark):
    """Those that share a line found many times, and those of similarity 0.77."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = fresh(10), []
    for _ in range(10):
        texts += [" ".join(fresh(200) + line * 40)]
        base = fresh(300)
        copy = list(base)
        for at in range(10, 270, 35):
            copy[at] = "changed"
        assert 0.75 < similarity_of_sets(" ".join(base), " ".join(copy)) < 0.8
        texts += [" ".join(base), " ".join(copy)]
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    assert len(simhash.one_of_each(frame(spark, rows)).collect()) == len(rows)


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(spark, documents, whole):
    rows = documents if whole else odd()
    found = mixing.mix(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    wanted = targets(sizes)
    same([(r.doc_id, r.size, r.source) for r in found], [(i, len((t or "").encode().split()), s) for i, t, s in rows])
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in found:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(wanted[r.source])) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    same([(r.doc_id, r.taken) for r in found], [(r.doc_id, r.taken) for r in again])
    copies = mixing.sampled(frame(spark, rows)).groupBy("source").agg(F.sum("size").alias("taken")).collect()
    same([r for r in copies if r[1]], [(s, n) for s, n in taken.items() if n])
    assert mixing.mix(frame(spark, rows).limit(0)).collect() == []


def test_mixing_prefers_quality(spark):
    rows = [(k, "good words here " * 5 if k % 2 else "### $$$ &&& *** %%% " * 3, "a" if k < 600 else "b") for k in range(1200)]
    found = mixing.mix(frame(spark, rows)).where("source = 'a'").collect()
    good, bad = (sum(r.copies for r in found if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


@pytest.mark.parametrize("whole", [False, True])
def test_decontaminate(spark, documents, whole):
    rows = documents if whole else odd()
    items = table("benchmark") if whole else [(1, "the CAT sat, on the mat and then the dog came by to see"), (2, "hello"), (3, ""), (4, None), (10, "nine ten eleven twelve one two three four five six seven"), (None, "hello world"), (10, "a b c a b c a b c"), (1, "hello")]
    docs = frame(spark, rows)
    found = decontaminate.contaminated(docs, benchmark(spark, items)).collect()
    wanted = contamination([r[:2] for r in rows], [x for x in items if x[0] is not None])
    if not whole:  # an item without an id hits, but is not counted
        wanted = [(i, n, 2 if words(t) == ["hello", "world"] else h, *rest) for (i, n, h, *rest), (_, t, _) in zip(wanted, rows, strict=True)]
    same(found, wanted)
    clean = decontaminate.clean(docs, benchmark(spark, items))
    assert clean.columns == docs.columns
    same([(r.doc_id,) for r in clean.collect()], [(r[0],) for r in wanted if not r[5]])
    same(decontaminate.contaminated(docs, benchmark(spark, items[:0])).collect(), contamination([r[:2] for r in rows], []))
    assert decontaminate.contaminated(docs.limit(0), benchmark(spark, items)).collect() == []


@pytest.mark.parametrize("bound", [10, 3000])
def test_decontaminate_large_benchmark(spark, documents, monkeypatch, bound):
    """More prefixes than are broadcast, also more words; a word found everywhere is one of them."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", bound)
    common = max(((sum(w in words(t) for _, t, _ in documents[:200]), w) for w in set(words(documents[0][1]))))[1]
    items = [*table("benchmark"), (900, common), (901, f"{common} {common}")]
    same(decontaminate.contaminated(frame(spark, documents), benchmark(spark, items)).collect(), contamination([r[:2] for r in documents], items))
    wanted = contamination([r[:2] for r in documents], items[:-2])
    same([(r.doc_id,) for r in decontaminate.clean(frame(spark, documents), benchmark(spark, items[:-2])).collect()], [(r[0],) for r in wanted if not r[5]])


@pytest.mark.parametrize("piece", [1, 7, 4096])
def test_decontaminate_across_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = random.Random(15)
    items = [(k, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 40)))) for k in range(12)]
    docs = [(k, " ".join(rng.choice("abcdefghijkl") + " " + (rng.choice(items)[1] if rng.random() < 0.1 else "") for _ in range(rng.randrange(60))), "s") for k in range(40)]
    same(decontaminate.contaminated(frame(spark, docs), benchmark(spark, items)).collect(), contamination([r[:2] for r in docs], items))


def test_decontaminate_a_long_text(spark):
    """300,000 words, all of them prefix words of an item."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"{item} " * 25_000, "s"), (2, item, "s")]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contaminated(frame(spark, docs), benchmark(spark, [(5, f"{item} {item}")])).collect()}
    assert found == {1: (300_000, 300_000, 1), 2: (12, 12, 1)}


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("whole", [False, True])
def test_suffix_dedup(spark, documents, whole):
    rows = documents if whole else odd()
    same(suffix_dedup.without_repeats(frame(spark, rows)).select(*COLUMNS).collect(), repeats([r[:2] for r in rows]))
    assert suffix_dedup.without_repeats(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("few", [common.BROADCAST_IDS, 1])
def test_suffix_dedup_of_null_and_repeated_ids(spark, monkeypatch, few):
    """1,500 texts without an id, and ids that several texts share, some of them twice."""
    monkeypatch.setattr(common, "BROADCAST_IDS", few)
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [text(150) for _ in range(5)]
    texts = [text(rng.randrange(400)) + (rng.choice(passages) + text(30) if k % 10 == 0 else "") for k in range(1500)]
    rows = [(None, t, "s") for t in texts] + [(k // 4, text(120) + passages[k % 5], "s") for k in range(40)]
    rows += rows[:30] + rows[1500:1510] + [(7, None, "s"), (7, "", "s")]
    hashes = {r.text: r.h for r in frame(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()} | {"": 0, None: 0}
    same(suffix_dedup.without_repeats(frame(spark, rows)).select(*COLUMNS).collect(), repeats([r[:2] for r in rows], order=hashes.get))


def test_suffix_dedup_of_shared_passages(spark):
    """Passages at all offsets, periodic texts, and every period up to a window's length."""
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(60, 300))) for _ in range(12)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += ["".join(rng.choice("xyz ") for _ in range(rng.randrange(0, 50))), p[a : len(p) - rng.randrange(0, 30)]]
        rows.append((rng.randrange(10**9), "".join(parts), "s"))
    for period in (1, 2, 3, 7, 31, 32, 33, 50, 63, 64, 65, 68, 69, 70, 99, 100, 101):
        unit = "".join(rng.choice("pqrstuvw") for _ in range(period))
        rows.append((2 * 10**9 + period, (unit * 400)[: 99 + period + rng.randrange(0, 200)], "s"))
    same(suffix_dedup.without_repeats(frame(spark, rows)).select(*COLUMNS).collect(), repeats([r[:2] for r in rows]))


def test_suffix_dedup_of_lines_next_to_each_other(spark):
    """A line that one document has several times in a row and another one once, before a passage of both."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for length, times, fewer in ((60, 3, 1), (30, 3, 2)):
        wrong = []
        for k in range(0, 60, 2):
            line, passage = text(length), text(rng.randrange(30, 160))
            wrong += [(k, text(120) + line * times + passage, "a"), (k + 1, text(120) + line * fewer + passage, "a")]
        same(suffix_dedup.without_repeats(frame(spark, wrong)).select(*COLUMNS).collect(), repeats([r[:2] for r in wrong]))


@pytest.mark.parametrize("bucket_bytes", [1 << 26, 50])
def test_suffix_dedup_cuts_long_texts(monkeypatch, bucket_bytes):
    """In-process, with parts, folds and buckets so small that every text is cut, every fold emptied often, and large buckets passed on."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(suffix_dedup, "PART", 150)
    monkeypatch.setattr(suffix_dedup, "FOLD", 100)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(400)) for _ in range(4)]
    texts += [texts[0][50:350] + texts[1][:200], texts[2] + texts[2][10:200]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array([t.encode() for t in texts])], names=["id", "hash", "text"])
    sent = sorted((r for b in suffix_dedup._first_round(100, 12, iter([batch])) for r in b.to_pylist()), key=lambda r: r["bucket"])
    found = [r for b in suffix_dedup._ranked(100, True, iter([pa.RecordBatch.from_pylist(sent, suffix_dedup._SENT)])) for r in b.to_pylist()]
    gone = [set() for _ in texts]
    doubts = [[r["packed"] for r in found if r["kind"] == 1 and r["id"] == k] for k in range(len(texts))]
    second = pa.RecordBatch.from_arrays([*batch.columns, pa.array(doubts, pa.list_(pa.int64()))], names=["id", "hash", "text", "doubt"]).take([k for k, d in enumerate(doubts) if d])
    sent = sorted((r for b in suffix_dedup._second_round(100, 12, iter([second])) for r in b.to_pylist()), key=lambda r: r["bucket"])
    found += [r for b in suffix_dedup._ranked(100, False, iter([pa.RecordBatch.from_pylist(sent, suffix_dedup._SENT)])) for r in b.to_pylist()]
    for r in found:
        if r["kind"] == 0:
            gone[r["id"]] |= set(range(r["packed"] >> 32, r["packed"] & 0xFFFFFFFF))
    assert [(k, len(g)) for k, g in enumerate(gone)] == [(i, n) for i, _, n, _, _ in repeats(list(enumerate(texts)))]


def test_suffix_dedup_keeps_whole_characters(spark):
    rows = [(1, "é" * 60 + "a" + "ü" * 80, "s"), (2, "x" + "é" * 60 + "a" + "ü" * 80 + "y", "s"), (3, "é" * 60 + "a" + "ü" * 80, "s")]
    found = {r.doc_id: r.kept_text for r in suffix_dedup.without_repeats(frame(spark, rows), keep=("size", "hash"), with_text=True).collect()}
    assert found[3] == "" and found[2].startswith("x") and found[2].endswith("y") and "�" not in found[2]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
%s<aside>Side</aside><form><label>Mail</label><input></form><div id=comments><p>First!</p></div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<article><h1>Head</h1><p>One  two\n three &amp; four</p><p>Yes.<p>a <b>b</b><br>c<div class='ad'>Buy</div><ul><li>x<li>y</ul></article>", "Head\nOne two three & four\nYes.\na b\nc\nx\ny"),
        ("<div class='wrap has-sidebar'><main><p>Short.</p><section class=comments>Great</section></main></div>", "Short."),
        ("<div><p>%s</p><p>Tiny.</p><p>%s</p></div>" % ("long text " * 20, "more text " * 20), "%s\nTiny.\n%s" % (("long text " * 20).strip(), ("more text " * 20).strip())),
        ("<p>Only a bit.</p>", "Only a bit."),
        ("", ""),
        ("<article><div class='post-header'><h1>Title</h1></div><p>Text one.</p><section class='related-work'><p>Others.</p></section></article>", "Title\nText one.\nOthers."),
        ("<article><p>One.</p><div class='ad-slot'>Buy</div><div class=sidebar>Side</div><div class='notice'>Note</div><ol class='comment-list'><li>First!</ol></article>", "One."),
        ("<div class='content has-sidebar'><p>%s</p><div class=sidebar><p>%s</p></div></div>" % ("long text " * 20, "side text " * 30), ("long text " * 20).strip()),
        ("<div id='search-results'><p>%s</p></div><div class='top-menu'>%s</div>" % ("long text " * 20, "entry " * 20), ("long text " * 20).strip()),
        ("<div id=comments><article class=comment><p>%s</p></article></div><p>%s</p>" % ("great text " * 30, "long text " * 20), ("long text " * 20).strip()),
        ("<div class='post comments-open has-ads'><p>%s</p><div class='comments-area'>First!</div></div>" % ("long text " * 20), ("long text " * 20).strip()),
        ("<article class='comments-closed'><p>Short.</p><div class='no-comments'>Still text.</div></article>", "Short.\nStill text."),
        ("<div class='x' hidden><p>%s</p></div><p>Seen.</p>" % ("long text " * 20), "Seen."),
    ],
)
def test_html_text(body, wanted):
    assert html_text.main_text(PAGE % body) == wanted


def test_html_text_beside_a_small_article():
    body = [f"Paragraph {k} of the body, as long as such are, with words enough to count for text." for k in range(4)]
    around = "<p>Of note.</p><div>%s</div><p>Between.</p><article><p>A teaser.</p></article><p>Elsewhere.</p>"
    assert html_text.main_text(PAGE % around % "".join(f"<p>{b}</p>" for b in body)) == "\n".join(["Of note.", *body, "Between.", "A teaser."])


def test_html_text_of_a_teaser_before_the_story():
    story = [f"Paragraph {k} of the story, as long as such are, with words enough to count for text." for k in range(4)]
    assert html_text.main_text(PAGE % ("<article><p>A teaser.</p></article><div id='content'>%s</div>" % "".join(f"<p>{b}</p>" for b in story))) == "\n".join(["A teaser.", *story])


def test_html_text_of_deep_markup():
    """Any number of elements in each other, and of end tags without a start, in time that grows in proportion."""
    import time

    began = time.time()
    assert html_text.main_text("<div>" * 100_000 + "x" + "</p>" * 100_000) == "x"
    assert html_text.main_text("<div class='has-menu'>" * 50_000 + "<article>y" + "</i></div>" * 50_000) == "y"
    assert time.time() - began < 20


def test_html_text_windows_decide(spark):
    """The same pages without their article elements: surge and dive alone find the same text on most of them."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    bare = [r.html.replace("<article>", "<div>").replace("</article>", "</div>") for r in pages]
    assert all("<article" not in b and "<main" not in b for b in bare)
    alike = [html_text.main_text(b) == html_text.main_text(r.html) for b, r in zip(bare, pages, strict=True)]
    assert sum(alike) >= 0.6 * len(pages), sum(alike)


def test_html_text_of_damaged_pages(spark):
    rows = [(1, "u", "<article><p>cut off &amp"), (None, None, None), (2, "u", ""), (2, "u", "<p>a <!-- open"), (3, "u", "<article><p>x</p><script>never closed <p>y"), (4, "u", "1 < 2 and <b>3</b> > 2"), (5, "u", "<" * 3000 + "\"'" * 500)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = {(r.page_id, r.n_chars) for r in html_text.extract(pages).collect()}
    assert {(1, 9), (None, 0), (2, 0), (2, 1), (3, 1)} <= found and len(html_text.extract(pages).collect()) == len(rows)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_html_text_of_all_pages(spark):
    """The article of the synthetic pages, cut out by other means."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.split(r"</article>|<footer", r.html.split("<article>")[1])[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", inner)]
        assert found[r.page_id] == "\n".join(filter(None, blocks))


def test_warc(spark):
    big = "<p>é</p>" * 30
    rows = [(3, "http://a b/", big), (1, None, big), (2, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (None, "u", big), (1, "u", big), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    found = warc.round_trip(pages).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = [(i, len((t or "").encode()), digest(t), "revisit" if t == big and i in (2, 3) else "response", 1 if t == big and i in (2, 3) else None) for i, _, t in rows]
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], wanted)
    assert all(r.html == next(t or "" for i, _, t in rows if digest(t) == r.payload_digest) for r in found if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_beside_columns_named_like_its_own(spark):
    """Repeats by the hundred, one of them under columns that the operator uses itself."""
    big = "<p>page</p>" * 30
    rows = [(k, "u", big if k % 3 else f"{k} {big}", b"x", 1, True, 2, 3) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload binary, id long, revisit boolean, first long, n long")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert found == {k: ("revisit", 1) if k % 3 and k > 1 else ("response", None) for k in range(300)}


def test_very_long_texts(spark):
    """A text of 200,000 words beside short ones."""
    rng = random.Random(19)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, text, "a"), (2, "short", "a"), (3, text + " end", "b"), (4, None, "b")]
    docs = frame(spark, rows)
    sketches = {r.doc_id: r for r in paragraph_sketch.fingerprints(docs).collect()}
    assert sketches[1].n_chars == len(text) and sketches[3].near_next == 0.0 and 0.5 < sketches[1].near_edited < 1
    same([(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()], [(1, 1), (2, 2), (3, 1), (4, 4)])
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {1: 200_000, 2: 1, 3: 200_001, 4: 0}
    same([(r.doc_id,) for r in simhash.one_of_each(docs).collect()], [(1,), (2,), (4,)])
    assert license_scan.scan(docs).where("doc_id = 3").first().n_words == 200_001


def test_mixing_takes_a_weight(spark):
    rows = [(k, "some words here " * 5, "a" if k < 900 else "b") for k in range(1200)]
    docs = frame(spark, rows).withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1))
    found = mixing.mix(docs, weight=F.col("weight")).where("source = 'a'").collect()
    even, odd = (sum(r.copies for r in found if r.doc_id % 2 == k) for k in (0, 1))
    assert even > 2 * odd


def test_mixing_tells_rows_of_an_id_apart(spark):
    """Rows that repeat an id and text but differ elsewhere are mixed each by itself; equal rows together."""
    docs = spark.createDataFrame([(1, "a b c", "x", "en"), (1, "a b c", "x", "de"), (2, "d e", "x", "en"), (2, "d e", "x", "en")], "doc_id long, text string, source string, lang string")
    found = mixing.sampled(docs).groupBy("doc_id", "lang").agg(F.count("*").alias("n")).collect()
    same([tuple(r) for r in found], [(1, "en", 1), (1, "de", 1), (2, "en", 2)])


def test_warc_files_and_damage(spark, tmp_path):
    import gzip

    content = warc.record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None) + warc.record(2, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), 1)
    assert [r.headers["warc-type"] for r in warc.records(content)] == ["response", "revisit"]
    archives = spark.createDataFrame([("a.warc.gz", bytearray(content))], "archive string, content binary")
    warc.export(archives, str(tmp_path)).collect()
    back = warc.read_archives(warc.archive_files(spark.read.format("binaryFile").load(str(tmp_path / "*.warc.gz")))).collect()
    assert [(r.page_id, r.refers_to) for r in back] == [(1, None), (2, 1)]
    bad = gzip.compress(gzip.decompress(warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)).replace(b"abc", b"abd"))
    for damaged in (content[:-9], bad):
        with pytest.raises(ValueError):
            list(warc.records(damaged))

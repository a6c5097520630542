"""Benchmark decontamination: a prefix-filtered join of word windows.

A window of an item is contained in a document only if its rarest word is there, so a prefix of one word a window is
enough. Rarity is counted over all documents. The prefix words are joined with the positions of the same words in the
documents; each pair is verified by aligning the words on both sides (length and positional bounds included), which
gives the whole run of equal words around the prefix word at once.

Texts are cut into pieces of PIECE words before positions leave their row, and a position takes only the words around
it along, so a long text costs no more than its length. A small benchmark is broadcast; the prefixes of a large one
meet the positions in a join in which the words of many documents are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skribo.llm.common import checkpointed, words

#: Words in a window, and in a piece of a text.
WINDOW, PIECE = 10, 4096
#: Up to so many words are a literal set, and up to so many prefixes are collected and broadcast.
BROADCAST_WORDS = 50_000
#: A word in more than one of so many documents is dealt to several tasks, up to MOST_TASKS.
COMMON, MOST_TASKS = 64, 256


def _pieces(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, base, before, part: column w in pieces of PIECE places from base on, with the width - 1 words around, before of them on the left."""
    margin = width - 1
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PIECE)),
        lambda s: F.struct(s.alias("base"), F.least(s, F.lit(margin)).alias("before"), F.slice("w", F.greatest(s - margin, F.lit(0)) + 1, F.lit(PIECE + 2 * margin)).alias("part")),
    )
    return rows.select(*keys, F.explode(cut).alias("c")).select(*keys, "c.base", "c.before", "c.part")


def _places(at: Column, width: int) -> Column:
    """p, word and the words around (2 * width - 1 with it in the middle, null beyond the ends) for places of a piece, counted from its base."""
    part, before = F.col("part"), F.col("before")
    around = lambda i: F.transform(F.sequence(F.lit(1 - width), F.lit(width - 1)), lambda k: F.when(before + i + k >= 0, F.get(part, before + i + k)))
    return F.transform(at, lambda i: F.struct((F.col("base") + i).alias("p"), F.get(part, before + i).alias("word"), around(i).alias("seen")))


def _own() -> Column:
    """The words of a piece without those around it."""
    return F.slice("part", F.col("before") + 1, F.lit(PIECE))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, item (a hash of id and words), n (its words), least (words a run must have), q (a word's place), word, around (as in _places)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.xxhash64("item_id", "w").alias("item"), F.size("w").alias("n"), "w").dropDuplicates(["item"])
    cut = _pieces(items, ["item_id", "item", "n"], width)
    places = cut.select("item_id", "item", "n", F.explode(_places(F.transform(_own(), lambda _, i: i), width)).alias("c"))
    return places.select("item_id", "item", "n", F.least("n", F.lit(width)).alias("least"), F.col("c.p").alias("q"), "c.word", F.col("c.seen").alias("around"))


def _prefixes(windows: DataFrame, df: DataFrame, width: int) -> DataFrame:
    """The rows of windows, with df, that are the rarest word, the leftmost of ties, of at least one window of their item."""
    ranked = windows.join(df, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    key = F.struct("df", "word", "q")
    # an item's window starting at s holds places s .. s + least - 1
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("least") + 1), F.least("q", F.col("n") - F.col("least")))
    chosen = ranked.select("item", F.explode(starts).alias("s"), key.alias("key")).groupBy("item", "s").agg(F.min("key").alias("key")).select("item", F.col("key.q").alias("q"), F.col("key.df").alias("df")).distinct()
    return windows.join(chosen, ["item", "q"])


def _pairs(split: DataFrame, benchmark: DataFrame, width: int, every: bool) -> DataFrame:
    """doc_id, n_words, text_hash, p, item_id, least, before, after: prefix words found, with the equal words on both sides.

    split has doc_id and w, the words. With every, a row of p = -1 stands for each document.
    """
    windows = benchmark_windows(benchmark.select("item_id", "text"), width)
    vocabulary = windows.select("word").distinct()
    known = [r[0] for r in vocabulary.limit(BROADCAST_WORDS + 1).collect()]
    # how many documents hold each word of the benchmark
    if len(known) <= BROADCAST_WORDS:
        df = split.select(F.explode(F.array_distinct(F.filter("w", lambda x: x.isin(known)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    else:
        df = split.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word", "left_semi")
    prefixes = _prefixes(windows, df, width).select("word", "item_id", "around", "least", "df")
    rows = prefixes.limit(BROADCAST_WORDS + 1).collect()
    small = len(rows) <= BROADCAST_WORDS
    if small:
        prefixes, wanted = split.sparkSession.createDataFrame(rows, prefixes.schema), sorted({r["word"] for r in rows})
    else:
        prefixes = checkpointed(prefixes)
        wanted = [r[0] for r in prefixes.select("word").distinct().limit(BROADCAST_WORDS + 1).collect()]
    at = _own()
    if len(wanted) <= BROADCAST_WORDS:
        at = F.array_compact(F.transform(at, lambda x, i: F.when(x.isin(wanted), i)))
    else:
        at = F.transform(at, lambda _, i: i)
    key = ["doc_id", "n_words", "text_hash"]
    cut = _pieces(split.select("doc_id", F.size("w").cast("long").alias("n_words"), F.xxhash64("w").alias("text_hash"), "w"), key, width)
    found = _places(at, width)
    if every:
        none = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<string>").alias("seen")))
        found = F.when(F.col("base") == 0, F.concat(none, found)).otherwise(found)
    cut = cut.select(*key, F.explode(found).alias("c")).select(*key, "c.p", "c.word", "c.seen")
    how = "left" if every else "inner"
    if small:
        pairs = cut.join(F.broadcast(prefixes.drop("df")), "word", how)
    else:
        pairs = _dealt(cut, prefixes, split.select("doc_id").count(), how)
    same = F.array_join(F.zip_with("seen", "around", lambda a, b: F.when(a == b, F.lit("1")).otherwise("0")), "")
    pairs = pairs.select(*key, "p", "item_id", "least", same.alias("same"))
    left, right = F.substring("same", 1, width - 1), F.substring("same", width + 1, width - 1)
    before, after = F.length(left) - F.length(F.rtrim(left, F.lit("1"))), F.length(right) - F.length(F.ltrim(right, F.lit("1")))
    return pairs.select(*key, "p", "item_id", "least", before.alias("before"), after.alias("after"))


def _dealt(cut: DataFrame, prefixes: DataFrame, n_docs: int, how: str) -> DataFrame:
    """The join by word, with a part number beside it: words of many documents have several parts, rows without a word MOST_TASKS.

    Words in more than one of COMMON documents are no more than COMMON times the distinct words of a document on average; the most
    common BROADCAST_WORDS of them are dealt.
    """
    parts = F.least(F.lit(MOST_TASKS), 1 + F.floor(F.col("df") * COMMON / max(n_docs, 1))).cast("int")
    hot = prefixes.groupBy("word").agg(F.max("df").alias("df")).where(F.col("df") * COMMON > n_docs).orderBy(F.desc("df"), "word").limit(BROADCAST_WORDS)
    hot = hot.select("word", parts.alias("parts"))
    spread = F.pmod(F.xxhash64("doc_id", "text_hash", "p"), F.when(F.col("word").isNull(), MOST_TASKS).otherwise(F.coalesce("parts", F.lit(1)))).cast("int")
    dealt = cut.join(F.broadcast(hot), "word", "left").withColumn("part", spread).drop("parts")
    repeated = prefixes.drop("df").join(F.broadcast(hot), "word", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, ["word", "part"], how)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Null and empty texts have no words; an item without words has no window; an item with fewer than width words is
    one window. Items that repeat an id count as one item, one without an id hits but isn't counted. Rows of docs that repeat an id each keep
    their own row; long texts are cut into pieces, so their length is bounded by a row's alone; other columns are ignored whatever their names. An empty benchmark hits nothing.
    """
    pairs = _pairs(docs.select("doc_id", words(F.col("text")).alias("w")), benchmark, width, True)
    hit = F.col("before") + F.col("after") + 1 >= F.col("least")
    runs = pairs.groupBy("doc_id", "n_words", "text_hash").agg(
        F.sum(F.when(F.col("p") < 0, 1).otherwise(0)).alias("rows"),
        F.collect_set(F.when(hit, F.struct((F.col("p") - F.col("before")).alias("s"), (F.col("p") + F.col("after")).alias("e")))).alias("runs"),
        F.collect_set(F.when(hit, F.col("item_id").cast("string"))).alias("items"),
    )
    return runs.select(
        "doc_id",
        "n_words",
        covered(F.array_sort("runs")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all of their columns. Null texts hold none."""
    pairs = _pairs(docs.select("doc_id", words(F.col("text")).alias("w")), benchmark, width, False)
    bad = pairs.where(F.col("before") + F.col("after") + 1 >= F.col("least")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64(words(F.col("text"))).alias("row_hash"))
    return rows.join(bad, F.col("row_id").eqNullSafe(F.col("bad_id")) & (F.col("row_hash") == F.col("bad_hash")), "left_anti").select("row.*")


def covered(runs: Column) -> Column:
    """Places in the union of sorted inclusive runs (s, e)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to"))

    def add(acc: Column, r: Column) -> Column:
        more = F.greatest(F.lit(0), r["e"] - F.greatest(acc["to"], r["s"] - 1))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["to"], r["e"]).alias("to"))

    return F.aggregate(runs, start, add, lambda acc: acc["n"])

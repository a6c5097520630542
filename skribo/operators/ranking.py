"""Search and ranking over stored token postings.

An index is written once: a row for each field, token and document, with how often the token comes and how long the field is. Its
files are sorted by token, so a question reads only the row groups that its prefixes fall into; the texts are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skribo.functions.text import fold, normalize_key, runs, search_prefix

#: Fixed values of the ranking function.
K1, B, IDF_LEAST = 1.2, 0.75, 1e-6
#: Fixed values of the fielded ranking: saturation, length, least share of a hit, weights of prefixes and near words, what a letter too many takes off, letters that may differ (a share of the word, and at most).
FIELD_K, FIELD_B, FIELD_D = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT, PREFIX_LOSS, FUZZY, FUZZY_MOST = 0.375, 0.45, 0.3, 0.1, 6


def query_prefixes(spark: SparkSession, query: str) -> list[str]:
    """The folded tokens of more than one letter, each cut to its search prefix."""
    row = spark.range(1).select(F.transform(F.filter(F.split(normalize_key(F.lit(query)), " "), lambda t: F.length(t) > 1), lambda t: search_prefix(t)).alias("p")).first()
    return list(dict.fromkeys(row["p"]))


@dataclass(frozen=True)
class Index:
    """postings: field, token, the key, tf, n (tokens of the field there), distinct (different ones); vocabulary: field, token, having (documents that have it); totals: field, docs, mean, mean_distinct."""

    key: str
    postings: DataFrame
    vocabulary: DataFrame
    totals: DataFrame


def build(docs: DataFrame, key: str, fields: dict[str, Column], path: str) -> Index:
    """Writes the index of these fields (strings, or arrays of them) below the path and opens it. Null is an empty field; keys must differ."""

    def folded(value: Column, kind: str) -> Column:
        whole = F.array_join(value, " ") if kind.startswith("array") else value.cast("string")
        return fold(F.coalesce(whole, F.lit("")))

    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*[c.alias(n) for n, c in fields.items()]).schema}
    texts = docs.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), folded(c, kinds[n]).alias("x")) for n, c in fields.items()])).alias("f")).select(key, "f.field", "f.x")
    split = texts.select(key, "field", runs(F.col("x")).alias("t"))
    # what is said of the whole list is computed before its tokens leave it, once a document
    sized = split.select(key, "field", "t", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("distinct"))
    rows = sized.select(key, "field", "n", "distinct", F.explode("t").alias("token"))
    counted = rows.groupBy("token", "field", key, "n", "distinct").agg(F.count("*").cast("int").alias("tf"))
    counted.sortWithinPartitions("token", "field").write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    postings = spark.read.parquet(f"{path}/postings")
    vocabulary = postings.groupBy("token", "field").agg(F.count("*").alias("having"), F.sum("tf").alias("tf"))
    vocabulary.sortWithinPartitions("token", "field").write.mode("overwrite").parquet(f"{path}/vocabulary")
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    # a document's tokens are the sum of tf, its distinct ones the number of its postings
    sums = vocabulary.groupBy("field").agg(F.sum("tf").alias("n"), F.sum("having").alias("distinct"))
    every = docs.count()
    known = spark.createDataFrame([(n,) for n in fields], "field string").join(sums, "field", "left")
    mean = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") / F.lit(float(max(every, 1)))
    known.select("field", F.lit(every).cast("long").alias("docs"), mean("n").alias("mean"), mean("distinct").alias("mean_distinct")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return Index(key, postings, vocabulary, spark.read.parquet(f"{path}/totals"))


def bm25(index: Index, prefixes: list[str], mode: str = "any") -> DataFrame:
    """key, score of an index of one field: negative, the most fitting least. A prefix counts the tokens that it begins.

    mode: any or all of the prefixes must be there; with first_all, any counts only where no document has all of them.
    """
    token, key = F.col("token"), index.key
    held = index.postings.where(reduce(lambda a, b: a | b, [token.startswith(p) for p in prefixes]))
    hits = held.groupBy(key, "n").agg(*[F.sum(F.when(token.startswith(p), F.col("tf")).otherwise(0)).alias(f"f{k}") for k, p in enumerate(prefixes)])
    has = [F.col(f"f{k}") > 0 for k in range(len(prefixes))]
    every = reduce(lambda a, b: a & b, has)
    found = hits.agg(*[F.count_if(h).alias(f"d{k}") for k, h in enumerate(has)], F.count_if(every).alias("whole"))
    rows = hits.join(F.broadcast(found)).join(F.broadcast(index.totals))  # single rows
    parts = []
    for k in range(len(prefixes)):
        f, d = F.col(f"f{k}").cast("double"), F.col(f"d{k}").cast("double")
        idf = F.greatest(F.log((F.col("docs") - d + 0.5) / (d + 0.5)), F.lit(IDF_LEAST))
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean"))))
    kept = {"any": F.lit(True), "all": every, "first_all": every | (F.col("whole") == 0)}[mode]
    return rows.where(kept).select(key, (-reduce(lambda a, b: a + b, parts)).alias("score"))


def fielded(index: Index, words: list[str], boosts: dict[str, float]) -> DataFrame:
    """key, score over all fields of an index, the most fitting highest: a word counts for equal tokens, those that it begins, and near ones.

    A field without a boost has 1. How rare a token is counts within its field. Any word suffices. Words are compared with the vocabulary alone,
    postings are read for the tokens found.
    """
    most = {w: min(FUZZY_MOST, int(FUZZY * len(w) + 0.5)) for w in words}
    token, parts = F.col("token"), []
    long = F.length(token).cast("double")
    for w in words:
        apart = F.levenshtein(token, F.lit(w))
        begun, near = token.startswith(w), F.length(token).between(len(w) - most[w], len(w) + most[w]) & (apart <= most[w])
        weight = F.when(token == w, 1.0).when(begun, PREFIX_WEIGHT * long / (long + PREFIX_LOSS * (long - len(w)))).when(near, FUZZY_WEIGHT * long / (long + apart))
        parts.append(F.struct(F.lit(w).alias("word"), weight.alias("weight")))
    found = index.vocabulary.select("token", "field", "having", F.explode(F.array(*parts)).alias("m")).where("m.weight IS NOT NULL").groupBy("token", "field", "having").agg(F.sum("m.weight").alias("weight"))
    rows = index.postings.join(found, ["token", "field"]).join(F.broadcast(index.totals), "field")  # a row a field
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, b in boosts.items() for x in (n, float(b))]), F.col("field")), F.lit(1.0))
    idf = F.log(1 + (F.col("docs") - F.col("having") + 0.5) / (F.col("having") + 0.5))
    share = FIELD_D + F.col("tf") * (FIELD_K + 1) / (F.col("tf") + FIELD_K * (1 - FIELD_B + FIELD_B * F.col("distinct") / F.col("mean_distinct")))
    return rows.groupBy(index.key).agg(F.sum(F.col("weight") * boost * idf * share).alias("score"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the words of the corpus by weight, none above EPOCHS times its own; the rest of the share goes to the
others by weight (water filling, in closed form over the sources sorted by where they fill up). Each source is taken
in complete epochs first. The fraction left is a weighted sample without replacement: a document's key is -ln(u) / w,
u a hash of its id and text in (0, 1], w its quality; the sample is the prefix by key whose words come nearest to the fraction.
The prefix sums are taken in two steps, within ranges of the key and over the ranges, so that no source has to fit
into one task. Ranges are cut at quantiles of the keys of all documents, whatever their weights. Sources themselves are a
table of a row each, ordered in one task: up to some millions of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from skribo.llm.common import checkpointed, tokens

#: Most often a document is taken.
EPOCHS = 3
#: Ranges of the key.
RANGES = 4096
SEED = "mix-1"


def quality(text: Column) -> Column:
    """Weight of a document in (0, 1]: falls with the share of symbols that running text has few of."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[#$%&*!|<>{}=~^_\\]+", ""))
    return F.lit(1.0) - F.lit(0.9) * odd / F.greatest(F.length(text), F.lit(1))


def uniform(*key: Column, seed: str = SEED) -> Column:
    """In (0, 1], from 52 bits of an MD5 of the key."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> with weight and target. sizes has one row a source."""
    ranked = sizes.withColumn("weight", (F.lit(1) + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3).cast("double"))
    full = (F.lit(float(epochs)) * F.col("source_size")).alias("full")
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = ranked.select("*", full).withColumn("fills", F.col("full") / F.col("weight")).withColumn("level", level)
    common = F.max(F.when(F.col("level") < F.col("fills"), F.col("level"))).over(every)  # of the first source that does not fill up
    return rows.select("source", "source_size", "weight", F.when(F.col("level") >= F.col("fills"), F.col("full")).otherwise(common * F.col("weight")).alias("target"))


def _ranged(base: DataFrame, ranges: int) -> DataFrame:
    """base with range: how many of the quantiles of key are below a row's."""
    cuts = base.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) < F.col("key"), at + s).otherwise(at))
    return base.withColumn("range", below)


def mix(docs: DataFrame, epochs: int = EPOCHS, ranges: int = RANGES, weight: Column | None = None, same: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, same, copies, taken for every row of docs.

    weight: of a document in (0, 1], a column of docs, such as a classifier's probability; quality of the text without it. same: what
    tells rows with an id from each other, a hash of the text without it.
    Null text has size 0 and is never sampled for its fraction's sake; null sources form one source, last in order.
    Rows that repeat an id and text tie and go by same, equal rows in any order (they are equal). Empty docs give an
    empty result. Other columns are ignored whatever their names.
    """
    text = F.col("text")
    same = F.xxhash64("text") if same is None else same
    key = -F.log(uniform(F.col("doc_id"), F.xxhash64("text"))) / (quality(text) if weight is None else F.greatest(weight.cast("double"), F.lit(1e-6)))
    base = docs.select("doc_id", "source", F.size(tokens(text)).cast("long").alias("size"), same.alias("same"), key.alias("key"))
    base = _ranged(checkpointed(base), ranges)
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), epochs)
    plan = plan.withColumn("full_epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int"))
    plan = plan.withColumn("fraction", F.col("target") - F.col("full_epochs") * F.col("source_size"))
    sums = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select(F.col("o.source").alias("o_source"), F.col("range").alias("o_range"), "offset", "source_size", "target", "full_epochs", "fraction")
    rows = base.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    own = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "same").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("offset") + F.sum("size").over(own)
    rows = rows.withColumn("upto", upto)
    sampled = (2 * F.col("upto") - F.col("size") <= 2 * F.col("fraction")) & (F.col("fraction") > 0) & (F.col("full_epochs") < epochs) & (F.col("size") > 0)
    copies = F.col("full_epochs") + sampled.cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", "same", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def sampled(docs: DataFrame, epochs: int = EPOCHS, weight: Column | None = None) -> DataFrame:
    """The mix itself: the columns of docs for each time that a row is taken, with size, target and copy (1, 2, ...), which take the place of columns so named.

    Rows equal in all columns are one document, taken as often as all of them together; rows that repeat an id and differ elsewhere are different ones.
    """
    whole = F.xxhash64(*[c.name for c in docs.schema if not isinstance(c.dataType, (MapType, VariantType))])
    plan = mix(docs, epochs, weight=weight, same=whole).groupBy("doc_id", "same").agg(F.sum("copies").alias("copies"), F.first("size").alias("size"), F.first("target").alias("target"))
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("plan_id"), F.col("same").alias("plan_same"), "copies", "size", "target")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), whole.alias("row_same")).dropDuplicates(["row_id", "row_same"])
    taken = rows.join(plan, F.col("row_id").eqNullSafe(F.col("plan_id")) & (F.col("row_same") == F.col("plan_same")))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("size", "target", "copy")]
    return taken.select(*own, "size", "target", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))

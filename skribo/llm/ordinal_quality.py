"""Quality classifier: ordinal regression with a cumulative link on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k), t_1 < t_2 < ...: one vector of hashed-text weights for all grades and ordered
thresholds. Features are hashed words and hashed symbol runs, counts dampened and scaled to unit length, and hashed
beginnings of words, whose counts are scaled to unit length undampened: how often a stem comes is what tells. The fit takes
a bounded sample of rated documents on the driver; scoring is a pass over all documents with the weights as a
broadcast of fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skribo.llm.common import checkpointed

#: Hashed features; rated documents that the fit takes at most, and bytes of their texts; passes over them.
FEATURES, SAMPLE, SAMPLE_BYTES, PASSES = 1 << 17, 6000, 1 << 26, 12
#: Letters of a word's beginnings.
BEGINNINGS = (3, 4, 5)
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
#: A document is kept if a good grade is at least so likely.
KEEP_FROM = 0.5
SEED = "rated-1"


def _place(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % FEATURES


def _shape(word: str) -> str:
    """Letters and digits folded, so that symbols and case show."""
    out, last = [], ""
    for c in word[:64]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k != last:
            out.append(k)
        last = k
    return "\x00" + "".join(out)


class _Words(dict):
    """Feature numbers of each word: itself without the symbols at its ends, its shape, its beginnings (-1 for none).

    Remembered for as many words as there are features.
    """

    def __missing__(self, word: str) -> bytes:
        core = word.lower().strip(_SYMBOLS)
        stems = [_place(f"\x02{core[:n]}") if len(core) > n else -1 for n in BEGINNINGS]
        found = np.array([_place(core), _place(_shape(word)), *stems], np.int32).tobytes()
        if len(self) < FEATURES:
            self[word] = found
        return found


def _counted(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sums of their counts."""
    distinct, which = np.unique(at, return_inverse=True)
    return distinct, np.bincount(which, n, len(distinct))


class Features:
    def __init__(self) -> None:
        self.words = _Words()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values. Repetition is a feature too."""
        counts = Counter(text.split())
        total = sum(counts.values())
        if not total:
            return np.empty(0, np.int64), np.empty(0)
        places = np.frombuffer(b"".join(map(self.words.__getitem__, counts)), np.int32).reshape(len(counts), -1).astype(np.int64)
        n = np.fromiter(counts.values(), float, len(counts))
        at, x = _counted(places[:, :2].ravel(), np.repeat(n, 2))
        x = np.log1p(x)
        stems, of = places[:, 2:].ravel(), np.repeat(n, len(BEGINNINGS))
        stem, y = _counted(stems[stems >= 0], of[stems >= 0])
        again = _place(f"\x01{min(9, int(10 * (1 - len(counts) / total)))}" if total >= 20 else "\x01")
        return np.concatenate([at, stem, [again]]), np.concatenate([x / np.sqrt((x * x).sum()), y / np.sqrt(max(1.0, (y * y).sum())), [0.3]])


_SYMBOLS = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = float(self.weights[at] @ x) if len(at) else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


def slopes(score: float, thresholds: np.ndarray, grade: int) -> tuple[float, float, np.ndarray]:
    """The probability of a grade, and the derivatives of its negative logarithm by the score and by each threshold.

    It is F(score - t_grade) - F(score - t_(grade + 1)), F the logistic function, t_0 and the one after the last infinitely low and high.
    """
    p = 1 / (1 + np.exp(np.clip(thresholds - score, -40, 40)))
    up, down = (p[grade - 1] if grade else 1.0), (p[grade] if grade < len(thresholds) else 0.0)
    mass = max(up - down, 1e-9)
    by_up, by_down = up * (1 - up) / mass, down * (1 - down) / mass
    by_threshold = np.zeros(len(thresholds))
    if grade:
        by_threshold[grade - 1] += by_up
    if grade < len(thresholds):
        by_threshold[grade] -= by_down
    return mass, by_down - by_up, by_threshold


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, passes: int = PASSES, rate: float = 0.5, shrink: float = 1e-6) -> Model:
    """Adagrad over the rows in a fixed shuffled order. Thresholds are kept ordered by their logarithmic gaps.

    Without rows, or with one grade alone, every grade is equally likely but for what the thresholds can't tell.
    """
    weights, squares = np.zeros(FEATURES, np.float64), np.full(FEATURES, 1e-3)
    first, gaps = -1.0, np.zeros(GRADES - 2)
    g_first, g_gaps = 1.0, np.ones(GRADES - 2)
    rng = np.random.default_rng(7)
    for _ in range(passes if len(rows) else 0):
        for i in rng.permutation(len(rows)):
            at, x = rows[i][0], rows[i][1].astype(float)
            t = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
            s = float(weights[at] @ x) if len(at) else 0.0
            _, ds, dt = slopes(s, t, int(grades[i]))
            if len(at):
                g = ds * x + shrink * weights[at]
                squares[at] += g * g
                weights[at] -= rate * g / np.sqrt(squares[at])
            g = float(dt.sum())
            g_first += g * g
            first -= 0.1 * g / g_first**0.5
            for k in range(GRADES - 2):
                g = float(dt[k + 1 :].sum()) * float(np.exp(gaps[k]))
                g_gaps[k] += g * g
                gaps[k] = np.clip(gaps[k] - 0.1 * g / g_gaps[k] ** 0.5, -4, 4)
    return Model(weights.astype(np.float32), first + np.r_[0.0, np.cumsum(np.exp(gaps))])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features = Features()
    for batch in batches:
        made = [features.of(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "at": [a.astype(np.int32).tobytes() for a, _ in made], "x": [x.astype(np.float32).tobytes() for _, x in made]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most sample rated documents with at most sample_bytes of text, taken by a hash of the id; one that would exceed the bytes is passed over.

    labels has doc_id, quality, toxic; rows with a null in any of them are left out, of ids rated more than once the lowest grade holds.
    Toxic documents have grade 0, others of quality 0 grade 1, the rest 2. Of documents that share a rated id the one with the least hash of
    the text is taken. The driver gets sample rows at most, with no more numbers than five for each word.
    """
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    rated = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min(grade).alias("grade"))
    order = F.md5(F.concat(F.lit(SEED), F.col("doc_id").cast("string")))
    chosen = rated.orderBy(order, "doc_id").limit(sample).withColumn("place", order)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("same"))
    least = F.min(F.struct("same", F.octet_length("text").cast("long").alias("size"), "text")).alias("m")
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "place", "grade").agg(least)  # sample rows at most
    one = checkpointed(one.select("doc_id", "place", "grade", "m.size", "m.text").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id"))
    left, taken = sample_bytes, []
    for r in one.select("doc_id", "place", "size").orderBy("place", "doc_id").collect():
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["doc_id"],))
    kept = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long"))
    made = one.select("doc_id", "grade", "text").join(kept, "doc_id").mapInPandas(_features, "doc_id long, grade int, at binary, x binary").toArrow()
    made = made.sort_by("doc_id")
    at, x = (([np.frombuffer(v.as_buffer(), kind) for v in made[c]]) for c, kind in (("at", np.int32), ("x", np.float32)))
    return fit(list(zip(at, x, strict=True)), made["grade"].to_numpy())


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), keep_from: float = KEEP_FROM) -> DataFrame:
    """The columns in keep, expected_grade, p_fair (grade 1 at least), p_good (grade 2), kept for every row of docs.

    Null and empty texts have no features and get the thresholds' own probabilities. Rows are independent; repeated ids
    are kept as they are, columns not in keep are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, held = Features(), Model(*shared.value)
        for batch in batches:
            p = np.array([held.tails(*features.of(t)) for t in batch["scored"].fillna("")]).reshape(-1, GRADES - 1)
            yield batch[list(keep)].assign(expected_grade=p.sum(1), p_fair=p[:, 0], p_good=p[:, 1], kept=p[:, 1] >= keep_from)

    rows = docs.select(*keep, F.col("text").alias("scored"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return rows.mapInPandas(scored, kept + "expected_grade double, p_fair double, p_good double, kept boolean")

"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs (lines, cut into pieces of PIECE words) are hashed; each digest goes to three cells of a table,
adding one to the cell's count and itself to the cell's two exclusive-or sums. Two tables subtract cell by cell; what
both texts share cancels out, and peeling cells with a single digest recovers the digests that differ. If peeling
gets stuck, the tables were too small and both are made again, larger, until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a paragraph that are hashed together.
PIECE = 16
#: Cells of the published table, and how much larger each retry is.
CELLS, LARGER = 24, 4
_MASK = (1 << 64) - 1
#: The first id in descending order of a group, below which null ids come.
_LOWEST = -(1 << 63)


def digests(text: str) -> list[int]:
    """One digest for each paragraph piece; the n-th of equal pieces differs from the others."""
    seen: Counter[bytes] = Counter()
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        for at in range(0, len(words), PIECE):
            piece = b" ".join(words[at : at + PIECE])
            out.append(xxhash.xxh64_intdigest(piece, seen[piece]))
            seen[piece] += 1
    return out


def _check(digest: int) -> int:
    return ((digest * 0x9E3779B97F4A7C15) & _MASK) >> 32


class Sketch:
    """cells: three tables of a third of the cells each, as [count, xor of digests, xor of checks]."""

    def __init__(self, cells: int) -> None:
        self.third = max(1, cells // 3)
        n = 3 * self.third
        self.count, self.sum, self.check = [0] * n, [0] * n, [0] * n

    def places(self, digest: int) -> tuple[int, int, int]:
        t = self.third
        return digest % t, t + (digest >> 21) % t, 2 * t + (digest >> 42) % t

    def put(self, digest: int, times: int = 1) -> None:
        check = _check(digest)
        for i in self.places(digest):
            self.count[i] += times
            self.sum[i] ^= digest
            self.check[i] ^= check

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(3 * self.third)
        out.count = [a - b for a, b in zip(self.count, other.count, strict=True)]
        out.sum = [a ^ b for a, b in zip(self.sum, other.sum, strict=True)]
        out.check = [a ^ b for a, b in zip(self.check, other.check, strict=True)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """Digests only in the first and only in the second table; None if the table is too small."""
        first, second = [], []
        ready = [i for i, c in enumerate(self.count) if c in (1, -1)]
        while ready:
            i = ready.pop()
            c, digest = self.count[i], self.sum[i]
            if c not in (1, -1) or self.check[i] != _check(digest) or i not in self.places(digest):
                continue
            (first if c == 1 else second).append(digest)
            self.put(digest, -c)
            ready += [j for j in self.places(digest) if self.count[j] in (1, -1)]
        return None if any(self.count) or any(self.sum) else (first, second)

    def text(self) -> str:
        packed = b"".join(struct.pack("<iQI", c, s, k) for c, s, k in zip(self.count, self.sum, self.check, strict=True))
        return base64.b64encode(packed).decode()


class Version:
    """A text's digests and its sketches by size."""

    def __init__(self, text: str) -> None:
        self.digests = digests(text)
        self.made: dict[int, Sketch] = {}

    def sketch(self, cells: int) -> Sketch:
        if cells not in self.made:
            self.made[cells] = out = Sketch(cells)
            for d in self.digests:
                out.put(d)
        return self.made[cells]


def difference(a: Version, b: Version, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """The digests that only a has and only b has, by subtracting and peeling ever larger sketches."""
    while (found := a.sketch(cells).minus(b.sketch(cells)).peel()) is None:
        cells *= LARGER
    return found


def likeness(a: Version, b: Version) -> float:
    """Shared over all digests; 1 for two texts without any."""
    only_a, only_b = difference(a, b)
    shared = (len(a.digests) - len(only_a) + len(b.digests) - len(only_b)) / 2
    whole = shared + len(only_a) + len(only_b)
    return shared / whole if whole else 1.0


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by group, in descending order of ids, each group followed by the first row of the next."""
    last = None
    for batch in batches:
        out = []
        for bucket, tail, doc_id, known, text in zip(batch["bucket"], batch["tail"], batch["id"], batch["known"], batch["text"], strict=True):
            here = (bucket, doc_id if known else None, text, Version(text))
            if last is not None and last[0] == bucket:
                out.append(_row(last, here))
            last = None if tail else here
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})


def _row(row: tuple, after: tuple) -> tuple:
    _, doc_id, text, own = row
    n = len(text)
    edited = text[: n - n // 3] + after[2][: n // 3]
    version = Version(edited)
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.sketch(CELLS).text(), version.sketch(CELLS).text(), likeness(own, version), likeness(own, after[3])


def _cuts(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Highest (id, hash) of each range but the last, in order. An id of many rows is cut by the hashes of its texts, which are spread evenly."""
    found = rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    out = []
    for i, n in sorted(Counter(found).items()):
        out += [(i, -(1 << 63) + (k << 64) // n) for k in range(1, n)] + [(i, (1 << 63) - 1)]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Rows follow each other by descending doc_id, null ids last, ties by text hash; the last is followed by the first,
    a single row by itself. Null text counts as empty; two empty texts have likeness 1. Equal texts have equal
    fingerprints. Every input row gives one output row; other columns are ignored whatever their names. No docs give
    no rows.

    The order is made without bringing the rows together: ids are cut into ranges of similar size, four for each of
    spark.sql.shuffle.partitions (which should grow with the data, to some 200 MB of text a partition), every range is
    sorted by itself, and its neighbour's first row is sent to it too. Only rows equal in id and text can't be told apart, and share a range.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _cuts(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not cuts:
        return rows.limit(0).mapInPandas(_rows, schema)
    rows = rows.select("*", F.xxhash64("text").alias("h"))
    ids, hashes = (F.array(*[F.lit(c[k]) for c in cuts]) for k in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)])
    below = lambda k: (F.get(ids, k) < F.col("id")) | (F.get(ids, k) == F.col("id")) & (F.get(hashes, k) < F.col("h"))
    rows = rows.withColumn("bucket", F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(at + s - 1), at + s).otherwise(at)))
    heads = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("top")).collect()}  # one row a range
    full = sorted(heads, reverse=True)
    # the range whose last row the head of b follows; of the first, the last
    table = spark.createDataFrame([(b, heads[b]["id"], heads[b]["h"], full[k - 1]) for k, b in enumerate(full)], "bucket int, head_id long, head_h long, before int")
    rows = rows.join(F.broadcast(table), "bucket")  # one row a range
    head = (F.col("head_id") == F.col("id")) & (F.col("head_h") == F.col("h"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    sent = rows.withColumn("to", F.explode(F.when(head, F.array(own, tail)).otherwise(F.array(own)))).select("to.bucket", "to.tail", "id", "known", "h", "text")
    placed = sent.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("id"), F.desc("h"))
    return placed.mapInPandas(_rows, schema)

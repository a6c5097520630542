"""SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints are folded first. A fingerprint is split into distance + 2 blocks: two that differ in at most
distance bits share two blocks at least, so fingerprints meet under every pair of their blocks. A key under which more
than HOT meet is split: two of them share one of distance + 1 blocks of the bits that the key leaves open, so they meet
again under each of those. Distinct fingerprints run out of open bits, which bounds what a task compares. Those that
meet are linked by a search that takes each fingerprint once and compares it with the ones not reached yet, so a group leaves
as a tree, not as all of its pairs. Components follow by contracting the trees' edges, a few rounds of joins.

one_of_each drops near copies by similarity of their sets of shingles. Two sets of similarity 0.8 may differ in 15 % of a fingerprint's
bits, too many for blocks of bits; so those that blocks of bits link are verified first, and beyond them sets meet under the first shingles of each in a common order, common shingles last, of which two such
sets share one. Fingerprints tell which of those that meet is the closest to each: that link is verified by the texts first, and
the few pairs that are not connected by then follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skribo.llm.common import checkpointed, join_uneven, released, removed, repeated_ids, stored

#: Words of a shingle, bits in which linked fingerprints may differ, seed of the hash.
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints that meet under a key at most; hot keys up to which they are broadcast.
HOT, BROADCAST_KEYS = 1 << 12, 50_000
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 14
#: For near copies by similarity: words of a shingle, and the least similarity of two texts' sets of shingles, as a fraction.
NEAR_SHINGLE, NEAR = 5, (4, 5)
#: Documents in which shingles are counted, documents of these from which on a shingle is common, most common shingles. They only order the search.
COUNTED, COMMON, MOST_COMMON = 1 << 14, 3, 50_000
#: Sets that share a first shingle from which on it is common too, counted in all documents.
CROWDED = 1 << 12
#: Pairs yielded together, pairs whose counts are compared together; texts whose shingles a task keeps.
_PAIRS, _COMPARED, _KEPT = 1 << 18, 1 << 12, 1 << 12


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """As a signed integer of 64 bits."""
    return bits_of(shingle_hashes(text, size))


def bits_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed integer of 64 bits."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _AT_ONCE):
        part = hashes[k : k + _AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(t.as_py() or b"", size) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "fp"])


def block_masks(distance: int) -> list[int]:
    """A mask for every pair of distance + 2 blocks of the 64 bits."""
    n = distance + 2
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def narrower_masks(mask: int, distance: int) -> list[int]:
    """The mask with each of distance + 1 blocks of its open bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = distance + 1
    return [mask | sum(1 << b for b in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]


def _as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, row by row; a fingerprint is a row of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _tree(fps: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """For fingerprints that met: each one reached, with those that it reaches first, as row numbers."""
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _apart(fps[left], fps[x]) <= distance
            if near.any():
                reached, left = left[near], left[~near]
                yield x, reached
                queue.extend(reached)


def _edges(distance: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block and key."""
    held: list[pd.DataFrame] = []

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        fp = np.frombuffer(b"".join(rows["fp"]), ">u8").astype(np.uint64).reshape(len(rows), -1)
        met = rows["block"].to_numpy(), rows["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (met[0][1:] != met[0][:-1]) | (met[1][1:] != met[1][:-1])])
        ends = np.r_[starts[1:], len(fp)]
        pairs = starts[ends - starts == 2]
        close = pairs[_apart(fp[pairs], fp[pairs + 1]) <= distance]
        u, v = [node[close]], [node[close + 1]]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            for x, reached in _tree(fp[s:e], distance):
                u.append(np.repeat(node[s + x], len(reached)))
                v.append(node[s + reached])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    for batch in batches:
        if not len(batch):
            continue
        met = batch["block"].to_numpy(), batch["key"].to_numpy()
        cut = int(np.argmax((met[0] == met[0][-1]) & (met[1] == met[1][-1])))  # rows of the last key may go on in the next batch
        if held and (cut or (held[0]["block"].iat[0], held[0]["key"].iat[0]) != (met[0][0], met[1][0])):
            yield linked(pd.concat([*held, batch.iloc[:cut]]))
            held = []
        elif cut:
            yield linked(batch.iloc[:cut])
        held.append(batch.iloc[cut:])
    if held:
        yield linked(pd.concat(held))


def _linked(met: DataFrame, distance: int) -> DataFrame:
    """met: block, key, node, fp (bytes). u, v: nodes that met within the distance; a tree for each group that met."""
    placed = met.select("block", "key", "node", "fp").repartition("block", "key").sortWithinPartitions("block", "key")
    return placed.mapInPandas(lambda batches: _edges(distance, batches), "u long, v long")


def _meeting(fps: DataFrame, masks: list[int]) -> DataFrame:
    """block (a mask) and key for every fingerprint under every mask."""
    signed = [F.lit(_as_signed(m)) for m in masks]
    return fps.select("fp", F.explode(F.array(*signed)).alias("block")).select("fp", "block", F.col("fp").bitwiseAND(F.col("block")).alias("key"))


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """u, v: pairs of distinct fingerprints (column fp) that differ in at most distance bits, and connect all that such pairs connect.

    Keys are counted first, partly before the shuffle. Splitting hot ones ends at keys with distance open bits.
    """
    most, met, parts = max(hot, 1 << distance), _meeting(fps, block_masks(distance)), []
    while True:
        crowded = met.groupBy("block", "key").count().where(F.col("count") > most).select("block", "key")
        found = {r["block"]: r["count"] for r in crowded.groupBy("block").count().collect()}  # no more than there are masks
        if not found:
            break
        crowded = checkpointed(crowded)
        side = F.broadcast(crowded) if sum(found.values()) <= BROADCAST_KEYS else crowded
        parts.append(met.join(side, ["block", "key"], "left_anti"))
        finer = [(m, _as_signed(x)) for m in found for x in narrower_masks(m % (1 << 64), distance)]
        finer = F.broadcast(fps.sparkSession.createDataFrame(finer, "block long, finer long"))  # distance + 1 rows a mask
        met = met.join(side, ["block", "key"], "left_semi").join(finer, "block").select("fp", F.col("finer").alias("block"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
        met = checkpointed(met.distinct())
    met = reduce(DataFrame.unionByName, [*parts, met])
    return _linked(met.select("block", "key", F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")), distance)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for every node that has an edge.

    Alternates two contractions: every node's larger neighbours, then its smaller ones, are linked to its smallest
    neighbour. It ends when no edge changes; each round's edges are checkpointed.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Null and empty texts, and those of white space alone, have fingerprint zero, linked like any other; texts with
    fewer than size words have one shingle. component_id is the smallest id reachable; null ids are never that
    smallest one, and a component of null ids alone has a null component_id. Rows that repeat an id keep their own
    fingerprints. Other columns are ignored whatever their names; no docs give no rows.
    """
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    prints = checkpointed(rows.mapInArrow(lambda batches: _fingerprints(size, batches), "doc_id long, fp long"))
    return grouped(prints, links(prints.select("fp").distinct(), distance))


def grouped(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """prints: doc_id, fp. doc_id, fingerprint, component_id of each row; neither the rows of a fingerprint nor the fingerprints of a component have to fit into a task."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    member = checkpointed(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    classes = join_uneven(member, whole, "root", "members", member.count()).select("fp", "component_id", "rows")
    return join_uneven(prints, checkpointed(classes), "fp", "rows", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, size: int = NEAR_SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def _possible(n_u: np.ndarray, at_u: np.ndarray, n_v: np.ndarray, at_v: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be alike if their first common shingle is at these places of their order."""
    return np.minimum(n_u - at_u, n_v - at_v) * (NEAR[0] + NEAR[1]) >= NEAR[0] * (n_u + n_v)


def counts_of(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles have each value of their highest bits, 32 to 1024 values by the set's size; 255 stands for more."""
    bits = min(max((len(shingles) // 8).bit_length(), 5), 10)
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _near_counts(u: list[bytes], n_u: np.ndarray, v: list[bytes], n_v: np.ndarray) -> np.ndarray:
    """Whether sets of these counts and sizes can be alike, pair by pair: they differ in as many shingles at least as their counts do, alike ones in a ninth of both sizes at most."""
    width = np.array([[len(x), len(y)] for x, y in zip(u, v, strict=True)], np.int64).reshape(-1, 2)
    both, near = n_u.astype(np.int64) + n_v, np.zeros(len(width), bool)
    for a, b in np.unique(width, axis=0):
        rows = np.flatnonzero((width == (a, b)).all(1))
        for part in (rows[k : k + _COMPARED] for k in range(0, len(rows), _COMPARED)):
            x, y = (np.frombuffer(b"".join(c[i] for i in part), np.uint8).reshape(len(part), min(a, b), -1).sum(2, dtype=np.int64) for c in (u, v))
            near[part] = (NEAR[0] + NEAR[1]) * np.abs(x - y).sum(1) <= (NEAR[1] - NEAR[0]) * both[part]
    return near


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that can be alike by their counts."""
    for batch in batches:
        near = _near_counts(*(batch.column(c).to_pylist() if c.startswith("counts") else batch.column(c).to_numpy() for c in ("counts_u", "n_u", "counts_v", "n_v")))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py() or b"", size) for t in batch.column("text")]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        shingles = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), shingles)], names=["shingles"])


def _prefixes(size: int, common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, a name of the set of shingles, its size, fingerprint and counts, and as many of the first in the order as two alike sets must share one of.

    common: sorted shingles and their ranks, in two rows. They come last, by rank; the others are ordered by hash.
    """
    for batch in batches:
        names, sizes, prints, counts, prefixes = [], [], [], [], []
        for t in batch.column("text"):
            x = shingle_set(t.as_py() or b"", size)
            n = len(x)
            names.append(xxhash.xxh3_128_digest(x.tobytes()))
            sizes.append(n)
            prints.append(bits_of(x))
            counts.append(counts_of(x))
            if common.shape[1]:
                at = np.minimum(np.searchsorted(common[0], x), common.shape[1] - 1)
                last = common[0][at] == x
                x = np.concatenate([x[~last], x[last][np.argsort(common[1][at[last]])]])
            prefixes.append(x[: n + NEAR[0] * n // -NEAR[1] + 1].tobytes())
        made = pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(counts, pa.binary()), pa.array(prefixes, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "name", "n", "fp", "counts", "prefix"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix."""
    for batch in batches:
        prefixes = batch.column("prefix").to_pylist()
        length = np.array([len(x) // 8 for x in prefixes], np.int64)
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) - np.repeat(first, length)
        others = [np.repeat(batch.column(c).to_numpy(), length) for c in ("node", "n", "fp")]
        columns = np.frombuffer(b"".join(prefixes), np.int64), others[0], at.astype(np.int32), *others[1:]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "at", "n", "fp"])


def _whole_keys(names: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns, starts and ends of keys, of rows that come sorted by the first column; a key's rows come together."""

    def cut_up(held: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
        return columns, starts, np.r_[starts[1:], len(columns[0])]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        key = columns[0]
        cut = int(np.searchsorted(key, key[-1]))  # rows of the last key may go on in the next batch
        if cut or held and held[0][0][0] != key[0]:
            yield cut_up([*held, [c[:cut] for c in columns]] if cut else held)
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield cut_up(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key others have too; the key's first node where the two can be alike, else the row's own, and the bits in which the fingerprints of both differ."""
    for (key, node, at, n, fp), starts, ends in _whole_keys(("key", "node", "at", "n", "fp"), batches):
        sizes = ends - starts
        hub = np.repeat(starts, sizes)
        first = np.where(_possible(n.astype(np.int64), at, n[hub].astype(np.int64), at[hub]), node[hub], node)
        more = np.repeat(sizes > 1, sizes)
        apart = np.bitwise_count(fp.view(np.uint64) ^ fp[hub].view(np.uint64)).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (key, node, at, n, first, apart)], names=["key", "node", "at", "n", "hub", "apart"])


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: nodes that share a key, can be alike, by their counts too, and are not in one component yet."""

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    def likely(met: list[np.ndarray], node: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        u, v = np.concatenate(met, axis=1)
        near = _near_counts(list(counts[u]), n[u], list(counts[v]), n[v])
        return np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v])])[:, near]

    held, n_held = [], 0
    for (_, node, at, n, root, counts), starts, ends in _whole_keys(("key", "node", "at", "n", "root", "counts"), batches):
        n = n.astype(np.int64)
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        met, n_met = [], 0
        for s, e in zip(starts[mixed], ends[mixed], strict=True):
            for k in range(s, e - 1):
                rest = slice(k + 1, e)
                other = k + 1 + np.flatnonzero((root[rest] != root[k]) & _possible(n[k], at[k], n[rest], at[rest]))
                if len(other):
                    met.append(np.stack([np.full(len(other), k), other]))
                    n_met += len(other)
                if n_met >= _PAIRS:
                    held.append(likely(met, node, n, counts))
                    n_held, met, n_met = n_held + held[-1].shape[1], [], 0
        if met:
            held.append(likely(met, node, n, counts))
            n_held += held[-1].shape[1]
        if n_held >= _PAIRS:
            yield sent(held)
            held, n_held = [], 0
    if n_held:
        yield sent(held)


def _verified(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[bytes, np.ndarray] = {}

    def of(text: bytes) -> np.ndarray:
        if text not in kept:
            if len(kept) >= _KEPT:
                kept.clear()
            kept[text] = shingle_set(text, size)
        return kept[text]

    for batch in batches:
        ok = [_alike(of(a.as_py()), of(b.as_py())) for a, b in zip(batch.column("text_u"), batch.column("text_v"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles that many texts have, the most common first. They only order the search, so they are counted in some documents."""
    every = max(1, rows.count() // COUNTED)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").distinct()
    counts = some.mapInArrow(lambda batches: _sets(size, batches), "shingles array<long>").select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    found = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()
    return np.array([r["shingle"] for r in found], np.int64).view(np.uint64)


def _ranks(common: np.ndarray) -> np.ndarray:
    """Shingles, sorted, and their ranks, the most common ones last."""
    order = np.argsort(common)
    return np.stack([common[order], (len(common) - order).astype(np.uint64)])


def _prints(rows: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    ranks = _ranks(common)
    return rows.select("id", "text").mapInArrow(lambda batches: _prefixes(size, ranks, batches), "id long, name binary, n int, fp long, counts binary, prefix binary")


def _sharing(nodes: DataFrame, texts: DataFrame, size: int, common: np.ndarray) -> tuple[DataFrame, str]:
    """key, node, at, n, hub, apart: of nodes (node, n, fp, prefix) the first shingles that others have too; and where they are stored.

    A first shingle of more than CROWDED sets is common, whatever the sample said, and the sets are ordered anew.
    """

    def shared(nodes: DataFrame) -> tuple[DataFrame, str]:
        keys = nodes.select("node", "n", "fp", "prefix").mapInArrow(_placed, "key long, node long, at int, n int, fp long")
        return stored(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, at int, n int, hub long, apart byte"))

    found, path = shared(nodes)
    crowded = found.groupBy("key").count().where(F.col("count") > CROWDED).orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    if not crowded:
        return found, path
    removed(texts.sparkSession, path)
    released(texts.sparkSession)
    more = np.array([r["key"] for r in crowded], np.int64).view(np.uint64)
    anew = _prints(texts, size, np.concatenate([more, common[~np.isin(common, more)]]))  # from the texts where they are; what is shuffled is their first shingles
    anew = anew.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    return shared(anew.withColumnRenamed("id", "node"))


def similar(docs: DataFrame, size: int = NEAR_SHINGLE) -> tuple[DataFrame, DataFrame]:
    """doc_id, same (a hash of the text), node (the least number of a text with that set of shingles) of every document; u, v: pairs of nodes whose sets
    have similarity NEAR at least, which connect all that such pairs connect.

    A text's number is its id, or a hash of id and text where an id is repeated. Sets whose fingerprints differ in at most DISTANCE bits are linked by pigeonhole blocks,
    as in near_duplicates. That is not all: two sets of similarity NEAR share one of the first shingles of each, whatever the order, so nothing is missed if each is
    compared with the closest, by fingerprint, of the least ones that have one of its shingles, then with all others that are not in its component by then.
    Every link is verified by the texts; pairs that differ too much by counts of their shingles, which tell the least that they differ, are not compared, so texts that share
    a passage alone don't bring their texts along. What a step leaves on disk goes before the next one.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    again = repeated_ids(docs)
    if again is None:
        rows = rows.withColumn("id", F.xxhash64("doc_id", "same"))
    else:
        rows = rows.join(F.broadcast(again), F.col("doc_id") == F.col("again"), "left").withColumn("id", F.when(F.col("again").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "same"))).drop("again")
    common = common_shingles(rows, size)
    prints, prints_path = stored(_prints(rows, size, common))
    least = prints.groupBy("name").agg(F.min("id").alias("node"), F.count("*").alias("rows"))
    member, _ = stored(join_uneven(prints.select("id", "name"), least, "name", "rows", prints.count()).select("id", "node").distinct())
    released(spark)
    # A text's shingles are those of every other row of its number, so one row of each node tells all of it.
    nodes = prints.join(member.where("id = node").select("node"), F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "node")
    fps = checkpointed(nodes.select("node", "n", "fp", "counts"))
    texts = rows.select("id", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        for x in ("u", "v"):
            pairs = pairs.join(texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")), x)
        found = checkpointed(pairs.mapInArrow(lambda batches: _verified(size, batches), "u long, v long").distinct())
        released(spark)
        return found

    shared, shared_path = _sharing(nodes, texts, size, common)
    removed(spark, prints_path)
    released(spark)
    linked = fingerprint_links(fps.select("node", "fp"))
    closest = shared.where("hub <> node").groupBy(F.col("node").alias("v")).agg(F.min(F.struct("apart", "hub")).alias("m")).select(F.col("m.hub").alias("u"), "v")
    tried = checkpointed(linked.unionByName(closest).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    released(spark)
    likely = tried
    for x in ("u", "v"):
        likely = likely.join(fps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}")), x)
    near = verified(likely.mapInArrow(_likely, "u long, v long"))
    rooted = shared.drop("hub", "apart").join(components(near), "node", "left").join(fps.select("node", "counts"), "node").withColumn("root", F.coalesce("root", "node"))
    crossing = rooted.repartition("key").sortWithinPartitions("key").mapInArrow(_crossing, "u long, v long")
    crossing = checkpointed(crossing.where("u <> v").distinct().join(tried, ["u", "v"], "left_anti"))
    removed(spark, shared_path)
    released(spark)
    near = near.unionByName(verified(crossing))
    own = rows.select("doc_id", "same", "id").join(member, "id")
    return own.select("doc_id", "same", "node"), near


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """u, v: pairs of nodes (node, fp) whose fingerprints are equal or linked, a tree for each group of them."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("rows"))
    equal = join_uneven(nodes, least, "fp", "rows", nodes.count()).where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    named = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"node_{x}"))
    apart = links(nodes.select("fp").distinct()).distinct().join(named("u"), "u").join(named("v"), "v")
    return equal.unionByName(apart.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")))


def copies(docs: DataFrame, size: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, same, root: each document that is a copy or near copy of one with a smaller id (of equal ids, a smaller hash of the text), and the smallest id of its group.

    Texts without words are copies of each other. Null ids are not grouped; rows that repeat an id and a text are one document.
    """
    member, edges = similar(docs, size)
    member = checkpointed(member.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"))
    released(docs.sparkSession)
    groups = member.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("first"), F.count("*").alias("rows"))
    named = join_uneven(member, groups, "root", "rows", member.count())
    return named.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("same") != F.col("first.same"))).select("doc_id", "same", F.col("first.doc_id").alias("root")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs but for copies and near copies of other documents, of which the one with the smallest id stays; all columns are kept.

    Rows that repeat an id and a text stay or go together; those that repeat an id alone are different documents. No id: the row stays.
    """
    gone = checkpointed(copies(docs).select(F.col("doc_id").alias("gone_id"), F.col("same").alias("gone_same")))
    released(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_same"))
    return rows.join(gone, (F.col("row_id") == F.col("gone_id")) & (F.col("row_same") == F.col("gone_same")), "left_anti").select("row.*")

"""Token counts by byte-pair merging with a heap and a linked list.

Only the count is wanted, so no identifiers are looked up: a word starts as its bytes and loses one symbol with each
merge. The lowest-ranked adjacent pair is popped from a heap, the leftmost of ties; neighbours are linked by index.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts of words that a worker remembers at most.
REMEMBERED = 400_000
#: Tokens above which a document is over the limit.
LIMIT = 512
#: Fixed value: how a byte-level vocabulary cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII texts; \x1c-\x1f are white space to Python but not to WORDS' library.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\f0-9A-Za-z]+|[ \t\n\r\x0b\f]+(?![^ \t\n\r\x0b\f])|[ \t\n\r\x0b\f]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be seen, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in seen}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(seen))
    return [letters[b] for b in range(256)]


class Counter:
    """Counts tokens as the library does for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no byte-level BPE file")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS)

    def merged(self, symbols: list[str]) -> int:
        """Symbols left after all merges."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:  # one of the two has been merged meanwhile
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            merges += 1
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 <= right and (r := ranks.get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
        return n - merges

    def count_word(self, word: str) -> int:
        n = self.merged([self.letters[b] for b in word.encode("utf-8", "replace")])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = n
        return n

    def count(self, text: str) -> int:
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        found = (self.ascii_words if text.isascii() else self.words).findall(text)
        known = list(map(self.known.get, found))
        return sum(self.count_word(w) if n is None else n for w, n in zip(found, known, strict=True)) if None in known else sum(known)


def _count(path: str, limit: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counter = Counter(path)
    for batch in batches:
        n = [counter.count(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": n, "over_limit": [k > limit for k in n]})


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; vocabulary is the path of a byte-level BPE file that
    every executor can read.

    Null text counts as empty, with no bytes and no tokens. Special strings inside a text are one token each. Rows
    are independent: null and repeated ids are kept as they are, other columns are ignored whatever their names.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInPandas(lambda batches: _count(vocabulary, limit, batches), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

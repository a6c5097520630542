"""WARC archives: a gzip member for each record, read back one after another.

Archives are rows (archive, content) of a table, since Spark has no sink for raw files; rows of binaryFile have the
same shape, so archives in any store can be read. The reader inflates a member piece by piece, frames the record by its
Content-Length, and verifies the digests of what it has read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skribo.llm.common import checkpointed, join_uneven

#: Payloads of at least so many bytes are archived once; an archive closes when it has so many; bytes read at a time.
REVISIT_FROM, ARCHIVE_BYTES, PIECE = 100, 8 << 20, 1 << 16
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block

    @property
    def http_length(self) -> int:
        found = re.search(rb"\r\ncontent-length: *(\d+)", self.block.partition(b"\r\n\r\n")[0], re.IGNORECASE)
        return int(found[1]) if found else len(self.payload)


def _uri(page_id: object) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. With refers_to it is a revisit, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _uri(page_id) or "<urn:page:>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": re.sub(r"\s+", "%20", url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": _uri(refers_to), "WARC-Profile": _PROFILE}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def members(content: bytes) -> Iterator[bytes]:
    """What each gzip member holds."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a member")
            piece = view[at : at + PIECE]
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(out)


def records(content: bytes) -> Iterator[Record]:
    """The records of an archive in order; an error for one that is cut off or doesn't match its digests."""
    for data in members(content):
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if end < 0 or not data.startswith(b"WARC/", at):
                raise ValueError("no WARC header")
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(headers["content-length"])
            block = data[end + 4 : end + 4 + length]
            if len(block) < length:
                raise ValueError("the record is shorter than its Content-Length")
            found = Record(headers, block)
            checks = [("warc-block-digest", block)] + ([] if headers.get("warc-type") == "revisit" else [("warc-payload-digest", found.payload)])
            for name, of in checks:
                kind, _, want = headers.get(name, "").partition(":")
                if kind == "sha256" and hashlib.sha256(of).hexdigest() != want:
                    raise ValueError(f"{name} doesn't match")
            yield found
            at = end + 4 + length
            at += 4 if data.startswith(b"\r\n\r\n", at) else 0


def _id(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, content in zip(batch["archive"], batch["content"], strict=True):
            rows = []
            for r in records(content):
                kind = r.headers.get("warc-type", "")
                revisit = kind == "revisit"
                digest = r.headers.get("warc-payload-digest", "").partition(":")[2] or hashlib.sha256(r.payload).hexdigest()
                text = None if revisit else r.payload.decode("utf-8", "replace")
                rows.append((archive, _id(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), kind, r.http_length if revisit else len(r.payload), digest, _id(r.headers.get("warc-refers-to")), text))
            yield pd.DataFrame(rows, columns=["archive", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size, name = [], 0, ""
    for batch in batches:
        for page_id, known, url, payload, digest, revisit, refers_to in zip(*(batch[c] for c in ("id", "known", "url", "payload", "digest", "revisit", "refers_to")), strict=True):
            made = record(int(page_id) if known else None, url, payload, digest, int(refers_to) if revisit else None)
            name = name or f"pages-{page_id}-{digest[:8]}.warc.gz"
            held.append(made)
            size += len(made)
            if size >= ARCHIVE_BYTES:
                yield pd.DataFrame({"archive": [name], "content": [b"".join(held)]})
                held, size, name = [], 0, ""
    if held:
        yield pd.DataFrame({"archive": [name], "content": [b"".join(held)]})


def write_archives(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """archive, content: WARC archives of all pages.

    Null html has an empty payload. Of equal payloads of at least so many bytes the smallest page_id is the response, and
    so is every row that repeats that id; null ids always are responses. Other columns are ignored whatever their
    names; no pages give no archives.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Only digests and ids meet by digest; payloads move once, by id and digest, and only to where a revisit is known.
    large = checkpointed(rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("digest", "page_id"))
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = join_uneven(large, shared, "digest", "n", large.count()).where("first < page_id").distinct()
    revisit = F.col("first").isNotNull().alias("revisit")
    marked = rows.join(again, ["page_id", "digest"], "left").select(F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNotNull().alias("known"), F.coalesce("url", F.lit("")).alias("url"), "payload", "digest", revisit, F.coalesce("first", F.lit(0)).alias("refers_to"))
    return marked.mapInPandas(_write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """archive, page_id, url, record_type, payload_bytes, payload_digest, refers_to, html for every record of the archives.

    html is null for revisits. A damaged archive is an error.
    """
    schema = "archive string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"
    return archives.select("archive", "content").mapInPandas(_read, schema)


def archive_files(paths: DataFrame) -> DataFrame:
    """archive, content of a binaryFile DataFrame."""
    return paths.select(F.col("path").alias("archive"), "content")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file into a folder that all executors share; returns archive, n_bytes. Files appear whole, by renaming."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                path = os.path.join(folder, name)
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)
                sizes.append(len(content))
            yield pd.DataFrame({"archive": batch["archive"], "n_bytes": sizes})

    return archives.mapInPandas(save, "archive string, n_bytes long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages in the shared folder of checkpoints and reads the archives back."""
    return read_archives(checkpointed(write_archives(pages)))

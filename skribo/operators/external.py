"""What the outside is asked: programs that read files, models that answer, pictures, state of runs, reports of readers.

Programs and models are parameters: a command that reads a file from its standard input and writes text, a function that takes a prompt. A file that fails or takes
too long, each time that it is tried, is a status in its row and stops no other; nothing is written to a worker's disk.
"""

from __future__ import annotations

import errno
import os
import subprocess
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skribo.operators.harvest import json_object


#: How often a program is started that ends for a reason which may pass, and what a start that fails for such a reason says.
STARTS, PASSING = 3, (errno.EAGAIN, errno.ENOMEM, errno.EMFILE, errno.ENFILE, errno.EINTR, errno.ETXTBSY)


def _run(command: list[str], content: bytes, timeout: float) -> tuple[str | None, str]:
    """A program that was killed, took too long or found no room to start is started again; one that ends by itself is not."""
    for k in range(STARTS):
        text, status, passing = _once(command, content, timeout)
        if not passing:
            break
        if k < STARTS - 1:
            time.sleep(0.1 * 4**k)
    return text, status


def _once(command: list[str], content: bytes, timeout: float) -> tuple[str | None, str, bool]:
    """Text, status, and whether another start may tell more."""
    try:
        done = subprocess.run(command, input=content, capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return None, "timeout", True
    except OSError as e:
        return None, f"failed: {e.strerror}", e.errno in PASSING
    return (done.stdout.decode("utf-8", "replace"), "ok", False) if done.returncode == 0 else (None, f"failed: {done.returncode}", done.returncode < 0)


@contextmanager
def _on_one_processor(pinned: bool, nth: int) -> Iterator[None]:
    """The calling thread, and so the programs that it starts, on one of the processors it may use; that keeps each start from copying the worker, as code run in the child would."""
    allowed = os.sched_getaffinity(0)
    if pinned:
        os.sched_setaffinity(0, {sorted(allowed)[nth % len(allowed)]})
    try:
        yield
    finally:
        os.sched_setaffinity(0, allowed)


def read_by_program(files: DataFrame, key: list[str], content: str, command: list[str], timeout: float = 60, cpu: int | None = None) -> DataFrame:
    """key, text, status (ok, empty_text, timeout, failed: why) of what a command makes of each file's bytes. Null contents are missing files.

    A text extractor (pdftotext - -) reads whole files, an OCR program (tesseract stdin stdout) a picture of a page in each row. With cpu a program has one
    processor: that one in the first partition, the next one in the next, so that tasks which run together don't wait for each other.
    """
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in key)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth = (cpu or 0) + TaskContext.get().partitionId()
        for b in batches:
            with _on_one_processor(cpu is not None, nth):
                found = [(None, "failed: missing file") if c is None else _run(command, bytes(c), timeout) for c in b["_content"]]
            status = ["empty_text" if s == "ok" and not t.strip() else s for t, s in found]
            yield b[key].assign(text=[t for t, _ in found], status=status)

    return files.select(*key, F.col(content).alias("_content")).mapInPandas(made, f"{kinds}, text string, status string")


def pages_of(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, page (from 1), text: what form feeds part, an empty last page left out, as text extractors write them."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\f")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return texts.select(*key, F.posexplode(parts).alias("_at", "text")).select(*key, (F.col("_at") + 1).cast("long").alias("page"), "text")


def asked(rows: DataFrame, key: str, prompt: Column, call: Callable[[str], str], tries: int = 2) -> DataFrame:
    """key, object, parse_error: the JSON object in a model's answer to each prompt. call is sent to the workers and called there, again if it raises; its last error is the row's."""
    kind = rows.schema[key].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> tuple[str | None, str | None]:
            for k in range(tries):
                try:
                    return call(text), None
                except Exception as e:  # noqa: BLE001 - whatever a service raises is the row's
                    if k == tries - 1:
                        return None, f"{type(e).__name__}: {e}"
            return None, "not asked"

        for b in batches:
            found = [one(p) for p in b["_p"]]
            yield pd.DataFrame({key: b[key], "answer": [a for a, _ in found], "failed": [e for _, e in found]})

    answers = rows.select(key, prompt.alias("_p")).mapInPandas(made, f"`{key}` {kind}, answer string, failed string")
    found, error = json_object(F.col("answer"))
    return answers.select(key, found.alias("object"), F.coalesce("failed", error).alias("parse_error"))


def knowledge(answers: DataFrame, key: str, strings: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """key, the fields, confidence, parse_error: answers held to a schema. Missing strings are empty, lists without blanks, flags false; a confidence lies in 0 to 1; a field of another type counts as missing."""
    at = lambda n: F.get_json_object("object", f"$.{n}")
    listed = lambda n: F.filter(F.coalesce(F.from_json(at(n), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    number = F.coalesce(at("confidence").try_cast("double"), F.lit(0.0))
    return answers.select(
        key,
        *[F.trim(F.coalesce(at(n), F.lit(""))).alias(n) for n in strings],
        *[listed(n).alias(n) for n in lists],
        *[F.coalesce(at(n).try_cast("boolean"), F.lit(False)).alias(n) for n in flags],
        F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        "parse_error",
    )


#: Brightness of white and of dark points, differences of colours and of neighbours.
WHITE, DARK, COLOURED, EDGE = 238, 85, 35, 40
#: What shares of points make a picture likely to be a drawn map, and the most that a dark or colourful one scores.
SHARES = ((0.22, "white", 0.55, 1.0), (0.20, "dark", 0.005, 0.22), (0.28, "edges", 0.035, 1.0), (0.14, "edges", 0.060, 1.0), (0.12, "colour", 0.0, 0.22))
PHOTO_MOST, WHITE_LEAST, COLOUR_MOST = 0.45, 0.35, 0.55


def pixel_shares(pixels: np.ndarray) -> dict[str, float]:
    """Shares of white, dark and coloured points and of edges of a picture (height, width, 3)."""
    points = pixels.astype(np.int16)
    grey = points.mean(axis=2)
    spread = np.abs(np.diff(points, axis=2)).sum(axis=2)
    edges = [float((np.abs(np.diff(grey, axis=a)) > EDGE).mean()) if grey.shape[a] > 1 else 0.0 for a in (0, 1)]
    return {"white": float((grey > WHITE).mean()), "dark": float((grey < DARK).mean()), "colour": float((spread > COLOURED).mean()), "edges": sum(edges) / 2}


def drawing_score(shares: dict[str, float]) -> float:
    score = sum(w for w, name, least, most in SHARES if least <= shares[name] <= most)
    photo = shares["white"] < WHITE_LEAST or shares["colour"] > COLOUR_MOST
    return round(min(score, PHOTO_MOST) if photo else min(score, 1.0), 3)


def visual_scores(pictures: DataFrame, key: str, width: str, height: str, channels: str, pixels: str) -> DataFrame:
    """key, white, dark, colour, edges, score of pictures: bytes row by row, one or three a point. Null, empty and damaged ones score 0 and have no shares."""
    kind = pictures.schema[key].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, w, h, c, data in zip(b["k"], b["w"], b["h"], b["c"], b["p"], strict=True):
                if data is None or w * h == 0 or c not in (1, 3) or len(data) != w * h * c:
                    rows.append((k, None, None, None, None, 0.0))
                    continue
                shares = pixel_shares(np.repeat(np.frombuffer(bytes(data), np.uint8).reshape(h, w, c), 3 // c, axis=2))
                rows.append((k, *(shares[n] for n in ("white", "dark", "colour", "edges")), drawing_score(shares)))
            yield pd.DataFrame(rows, columns=[key, "white", "dark", "colour", "edges", "score"])

    rows = pictures.select(F.col(key).alias("k"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(channels).cast("int").alias("c"), F.col(pixels).alias("p"))
    return rows.mapInPandas(made, f"`{key}` {kind}, white double, dark double, colour double, edges double, score double")


def run_state(events: DataFrame, run: str, item: str, status: str, at: list[str], stale: str = "running") -> DataFrame:
    """run, item, status, tries: the state of each item by its last event, what still runs marked as interrupted if its run has begun anew since, that is, if its run has an event of another item after it."""
    order = F.struct(*at)
    last = events.groupBy(run, item).agg(F.max_by(status, order).alias("status"), F.max(order).alias("_at"), F.count_if(F.col(status) == stale).alias("tries"))
    newest = F.max("_at").over(Window.partitionBy(run))
    return last.withColumn("_new", newest).select(run, item, F.when((F.col("status") == stale) & (F.col("_at") < F.col("_new")), "interrupted").otherwise(F.col("status")).alias("status"), "tries")


def resumed(items: DataFrame, state: DataFrame, run: str, item: str, done: tuple[str, ...], retry: tuple[str, ...], most_tries: int) -> DataFrame:
    """items that a new run takes up: those without a state or interrupted, and those whose status is in retry while they have tries left; never what is done."""
    known = state.select(F.col(run).alias("_r"), F.col(item).alias("_i"), F.col("status").alias("_s"), F.col("tries").alias("_t"))
    rows = items.join(known, (F.col(run) == F.col("_r")) & (F.col(item) == F.col("_i")), "left")
    take = F.col("_s").isNull() | (F.col("_s") == "interrupted") | (F.col("_s").isin(*retry, "") & (F.col("_t") < most_tries))
    return rows.where(take & ~F.coalesce(F.col("_s"), F.lit("")).isin(*done, "\0")).select(*items.columns)


def within_budget(rows: DataFrame, run: str, order: list[str], seconds: str, budget: float, cooldown: float = 0.0) -> DataFrame:
    """The items of each run that begin before its time is up: one at least; each takes its seconds, with a pause between them."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col(seconds) + cooldown).over(before), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return rows.withColumn("_spent", spent).withColumn("_place", place).where((F.col("_place") == 1) | (F.col("_spent") < budget)).drop("_spent", "_place")


#: Characters of a report's message at least, of its e-mail and type at most.
MESSAGE_LEAST, EMAIL_MOST, TYPE_MOST = 10, 180, 40
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def report_problem(trap: Column, kind: Column, message: Column, email: Column, allowed: tuple[str, ...], without_message: tuple[str, ...] = ()) -> Column:
    """Why a reader's report is refused, the first reason; null for a good one: a field that only robots fill in, an unknown type, too short a message, an e-mail that is none."""
    single = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    whole = F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", "")
    mail, of = F.substring(single(email), 1, EMAIL_MOST), F.substring(single(kind), 1, TYPE_MOST)
    return (
        F.when(single(trap) != "", "invalid report")
        .when(~of.isin(*allowed), "invalid type")
        .when(~of.isin(*without_message, "") & (F.length(whole) < MESSAGE_LEAST), "message too short")
        .when((mail != "") & ~mail.rlike(EMAIL), "invalid email")
    )

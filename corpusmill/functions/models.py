"""Seams for model calls, as pandas functions with offline defaults.

A backend is a plain function from a list of texts to a list of results. It is
called by batches and retried with growing waits; a batch that keeps failing
gives the result that stands for failure, never an exception. A task may have several calls
under way, as many as its `workers`; where one is told to wait, all do.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches, trimmed

DIMENSIONS = 64
ATTEMPTS, WAIT_SECONDS = 3, 2.0


def hashed(texts: list[str]) -> list[list[float]]:
    """Unit vectors of hashed words: the offline stand-in for an embedding model."""
    out = []
    for text in texts:
        v = np.zeros(DIMENSIONS)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
        norm = float(np.linalg.norm(v))
        out.append((v / norm if norm else v).tolist())
    return out


class ModelError(Exception):
    """A reply that asking again won't mend."""


class RateLimited(Exception):
    """Asked too often: wait longer."""


class Gate:
    """What calls at the same time share: none begins before the wait that a rate limit told to one of them is over."""

    def __init__(self) -> None:
        self.lock, self.until = threading.Lock(), 0.0

    def hold(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, time.monotonic() + seconds)

    def passed(self) -> None:
        while (left := self.until - time.monotonic()) > 0:
            time.sleep(left)


def answered(backend: Callable[[list[str]], list], texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS, gate: Gate | None = None) -> tuple[list | None, str, int]:
    """The backend's results, how the call ended (ok, error, refused, limited) and the attempts it took."""
    status, gate = "error", gate or Gate()
    for n in range(attempts):
        pause = wait * 2**n
        gate.passed()
        try:
            found = backend(texts)
            if len(found) == len(texts):
                return found, "ok", n + 1
        except ModelError:
            return None, "refused", n + 1
        except RateLimited:
            status, pause = "limited", 0.0
            gate.hold(2.5 * wait * (n + 1))
        except (OSError, ValueError, RuntimeError):
            status = "error"
        if n + 1 < attempts:
            time.sleep(pause)
    return None, status, attempts


def in_parts(backend: Callable[[list[str]], list], texts: list[str], batch: int, workers: int = 1, **retry) -> Iterator[tuple[list[str], list | None, str, int, float]]:
    """Each part of `batch` texts, in order, with what `answered` says of it and its seconds; `workers` calls at most at a time."""
    parts, gate = [texts[i : i + batch] for i in range(0, len(texts), batch)], Gate()

    def timed(part: list[str]) -> tuple[list[str], list | None, str, int, float]:
        began = time.monotonic()
        return (part, *answered(backend, part, gate=gate, **retry), time.monotonic() - began)

    if workers == 1 or len(parts) < 2:
        yield from map(timed, parts)
        return
    with ThreadPoolExecutor(min(workers, len(parts))) as pool:
        yield from pool.map(timed, parts)


def tried(backend: Callable[[list[str]], list], texts: list[str], failed: object, batch: int = 8, workers: int = 1, **retry) -> list:
    """A result for each text, `failed` where its call came to nothing."""
    return [v for part, found, *_ in in_parts(backend, texts, batch, workers, **retry) for v in (found or [failed] * len(part))]


#: The model a task is sent to where nothing else is configured.
MODELS = {"parse": "parser-default", "extract": "extractor-default", "translate": "translator-default", "map": "mapper-default", "embed": "embedder-default"}


def model_of(task: str, settings: dict[str, str] | None = None) -> str:
    """The model configured for a task, its default, or the one for mapping."""
    return (settings or {}).get(task) or MODELS.get(task) or MODELS["map"]


def _small_batches() -> None:
    if spark := SparkSession.getActiveSession():
        small_batches(spark)


def caller(backend: Callable[[list[str]], list], batch: int = 8, workers: int = 1, **retry):
    """A column function: text to reply (null: failed or empty), status, attempts and seconds of its call."""

    @F.pandas_udf("reply string, status string, attempts int, seconds double")
    def call(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            rows = []
            for part, found, status, attempts, seconds in in_parts(backend, texts.fillna("").tolist(), batch, workers, **retry):
                for reply in found or [None] * len(part):
                    empty = found is not None and not str(reply or "").strip()
                    rows.append((None if empty else reply, "empty" if empty else status, attempts, seconds / len(part)))
            yield pd.DataFrame(rows, columns=["reply", "status", "attempts", "seconds"])
        trimmed()

    _small_batches()
    return call


def call_log(calls: DataFrame, labels: list[str]) -> DataFrame:
    """labels, status, n, attempts and seconds of rows with `call` as `caller` gives it."""
    rows = calls.groupBy(*labels, F.col("call.status").alias("status"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("call.attempts").alias("attempts"), F.sum("call.seconds").alias("seconds"))


def embedder(backend: Callable[[list[str]], list] = hashed, batch: int = 16, dimensions: int = DIMENSIONS, workers: int = 1, **retry):
    """A column function: text to vector; the zero vector where the call failed."""

    @F.pandas_udf("array<float>")
    def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield pd.Series(tried(backend, texts.fillna("").tolist(), [0.0] * dimensions, batch, workers, **retry), dtype=object)
        trimmed()

    _small_batches()
    return embed


def transformer(backend: Callable[[list[str]], list], batch: int = 8, workers: int = 1, **retry):
    """A column function: text to text; null where the call failed."""

    @F.pandas_udf("string")
    def call(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield pd.Series(tried(backend, texts.fillna("").tolist(), None, batch, workers, **retry), dtype=object)
        trimmed()

    _small_batches()
    return call


def lists_transformer(backend: Callable[[list[str]], list], batch: int = 8, workers: int = 1, **retry):
    """A column function: texts to a text for each; null for those whose call failed. Calls take what several rows hold."""

    @F.pandas_udf("array<string>")
    def call(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in columns:
            each = [[] if x is None else x for x in lists]
            told = iter(tried(backend, [t or "" for x in each for t in x], None, batch, workers, **retry))
            yield pd.Series([list(islice(told, len(x))) for x in each], dtype=object)
        trimmed()

    _small_batches()
    return call

"""Model and network calls as injected functions: batched, retried, cached by version; never made here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import hash_id

#: One call: a list of prompts to a list of answers of the same length.
Call = Callable[[list[str]], list[str | None]]
#: Types of errors, as a service names them, that a later attempt may not meet.
TRANSIENT = ("overloaded_error", "rate_limit_error", "api_error")
#: Errors of the connection itself, by class.
BROKEN = ("TimeoutError", "ConnectionError", "ServerDisconnectedError", "ClientConnectorError", "IncompleteRead")


def retryable(error: Exception) -> bool:
    """Named transient errors (`type` of the error), broken connections, too many requests, and errors of the server."""
    status = getattr(error, "status", None) or getattr(error, "code", None)
    return getattr(error, "type", None) in TRANSIENT or type(error).__name__ in BROKEN or (isinstance(status, int) and (status == 429 or status >= 500))


def attempt(call: Call, prompts: list[str], attempts: int = 4, pause: float = 1.0, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list[str | None] | None:
    """The answers, or None when attempts are used up or an error won't go away."""
    for k in range(attempts):
        try:
            answers = call(prompts)
            if len(answers) == len(prompts):
                return answers
        except Exception as e:  # noqa: BLE001  any error of an injected call
            if not retryable(e):
                return None
        if k + 1 < attempts:
            sleep(min(cap, pause * 2**k))
    return None


def ask(rows: DataFrame, call: Call, key: str, prompt: str, batch: int = 5, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """(key, answer) by batches; a batch that fails is asked one by one, what fails then is null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, prompts = f[key].tolist(), f[prompt].tolist()
            answers: list[str | None] = []
            for i in range(0, len(prompts), batch):
                part = prompts[i : i + batch]
                got = attempt(call, part, attempts, pause)
                if got is None:
                    got = [(attempt(call, [p], attempts, pause) or [None])[0] for p in part]
                answers += got
            yield pd.DataFrame({key: keys, "answer": answers})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")


def version(prompt: str) -> str:
    """A cache version that changes with the prompt."""
    import hashlib

    return hashlib.md5(prompt.encode()).hexdigest()[:10]


def embed(rows: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], key: str, text: str, batch: int = 64) -> DataFrame:
    """(key, text_hash, embedding): unit vectors of texts."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for f in frames:
            out = []
            for i in range(0, len(f), batch):
                x = np.asarray(encode(f[text].iloc[i : i + batch].tolist()), dtype="float32")
                out += list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
            yield pd.DataFrame({key: f[key], "text_hash": f["text_hash"], "embedding": [v.tolist() for v in out]})

    return rows.select(key, F.coalesce(text, F.lit("")).alias(text), hash_id(F.coalesce(text, F.lit(""))).alias("text_hash")).mapInPandas(run, f"{key} {kind}, text_hash string, embedding array<float>")


def article_text(content: Column, rss: Column, title: Column, chars: int = 2000) -> Column:
    """The first of content, feed text and title that isn't empty, without tags, cut."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.substring(F.regexp_replace(F.coalesce(filled(content), filled(rss), filled(title), F.lit("")), r"<[^>]+>", ""), 1, chars)


def embedding_text(title: Column, summary: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, summary))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows without an analysis: score 5, neutral, nothing else."""
    empty = F.array().cast("array<string>")
    fill = {"score": F.lit(5), "sentiment": F.lit("neutral"), "summary": F.lit(""), "topic": F.lit(""), "event_type": F.lit(""), "tags": empty, "key_sentences": empty}
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in fill.items()})

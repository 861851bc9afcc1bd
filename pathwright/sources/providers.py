"""Where answers and judgements of models come from: a recorded table, or a chat endpoint called by the workers."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    def answers(self, df: DataFrame, key: str, prompt: str) -> DataFrame:
        """key, sample, answer, error: one row a sample."""


@dataclass(frozen=True)
class Replay:
    """Answers recorded before, as a table (key, sample, answer). Rows without an answer are left out."""

    recorded: DataFrame

    def answers(self, df: DataFrame, key: str, prompt: str) -> DataFrame:
        from pyspark.sql import functions as F

        return df.select(key).join(self.recorded.select(key, "sample", "answer"), key).withColumn("error", F.lit(None).cast("string"))


def _post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as got:  # noqa: S310 - the caller's address
        return got.read().decode("utf-8")


@dataclass(frozen=True)
class Chat:
    """A chat endpoint. Failed calls are repeated after backoff, twice backoff, and so on; an empty text counts as failed."""

    url: str
    key: str
    model: str
    samples: int = 1
    temperature: float = 0.8
    temperatures: tuple[float, ...] = ()  # one sample each, in place of samples and temperature
    max_tokens: int = 900
    top_p: float | None = None
    seed: int | None = None  # of the first sample; each further one adds 1
    timeout: float = 60.0
    retries: int = 2
    backoff: float = 1.5
    post: Callable[[str, dict[str, str], bytes, float], str] = _post

    def complete(self, prompt: str, temperature: float | None = None, sample: int = 1) -> str:
        heat = self.temperature if temperature is None else temperature
        more = {"top_p": self.top_p, "seed": None if self.seed is None else self.seed + sample - 1}
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": heat, "max_tokens": self.max_tokens} | {k: v for k, v in more.items() if v is not None}).encode()
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        for attempt in range(1, self.retries + 2):
            try:
                message = json.loads(self.post(f"{self.url.rstrip('/')}/chat/completions", headers, body, self.timeout))["choices"][0]["message"]
                text = (message.get("content") or message.get("reasoning_content") or "").strip()
                if not text:
                    raise ValueError("empty answer")
                return text
            except (OSError, ValueError, KeyError, IndexError, TypeError):
                if attempt > self.retries:
                    raise
                time.sleep(self.backoff * attempt)
        raise AssertionError

    @classmethod
    def from_env(cls, model_variable: str = "PATHWRIGHT_MODEL", **more) -> Chat | None:
        """The endpoint that PATHWRIGHT_CHAT_URL and PATHWRIGHT_CHAT_KEY name; None without them."""
        url, key = os.environ.get("PATHWRIGHT_CHAT_URL", ""), os.environ.get("PATHWRIGHT_CHAT_KEY", "")
        return cls(url, key, os.environ.get(model_variable) or os.environ.get("PATHWRIGHT_MODEL") or "default", **more) if url and key else None

    def answers(self, df: DataFrame, key: str, prompt: str) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for k, p in zip(frame[key], frame[prompt], strict=True):
                    for sample, heat in enumerate(self.temperatures or (self.temperature,) * self.samples, 1):
                        try:
                            rows.append((k, sample, self.complete(p or "", heat, sample), None))
                        except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
                            rows.append((k, sample, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[key, "sample", "answer", "error"])

        return df.select(key, prompt).mapInPandas(batches, f"`{key}` {kind}, sample int, answer string, error string")

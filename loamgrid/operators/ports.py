"""Ports to outside services: embedders and answer models are plugged in; the engine brings the batches.

A port's calls run inside Arrow batches on the executors. Each task keeps its own pace, and retries what may pass; Spark's own
retry of a task would repeat calls that went well.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Vectors of a batch of texts, in their order."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Answerer(Protocol):
    """An answer to a prompt."""

    def answer(self, prompt: str) -> str: ...


class Refused(Exception):
    """A call that no retry can mend, such as a wrong key."""


@dataclass(frozen=True)
class Retry:
    """Waits min(longest, first * 2^k) * U(0.7, 1.3) between tries."""

    tries: int = 7
    first: float = 1.5
    longest: float = 60.0

    def call(self, f: Callable, *args, sleep: Callable[[float], None] = time.sleep):
        for k in range(self.tries):
            try:
                return f(*args)
            except Refused:
                raise
            except Exception:
                if k == self.tries - 1:
                    raise
                sleep(min(self.longest, self.first * 2**k) * random.uniform(0.7, 1.3))


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 16, retry: Retry = Retry(), pause: float = 0.0) -> DataFrame:
    """content and embedding of each distinct text. Blank texts are not sent and get zeros.

    A batch whose answer has another number of vectors or another dimension fails. Texts are known by their hash, so that one
    text is sent once whatever its keys, and an index of contents tells what is still to be done.
    """
    distinct = df.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("content"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["content"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            vectors: list = [[0.0] * embedder.dim] * len(texts)
            full = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(full), batch):
                some = full[at : at + batch]
                made = retry.call(embedder.embed, [texts[i] for i in some])
                if len(made) != len(some) or any(len(v) != embedder.dim for v in made):
                    raise ValueError("the embedder gave another number or dimension of vectors")
                for i, v in zip(some, made, strict=True):
                    vectors[i] = v
                if pause:
                    time.sleep(pause)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["content", "embedding"])

    return distinct.mapInArrow(batches, "content string, embedding array<float>")


def pending(rows: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """Rows whose content isn't in an index of contents yet."""
    return rows.withColumn("content", F.sha2(F.coalesce(text, F.lit("")), 256)).join(index.select("content"), "content", "left_anti")


def answers(df: DataFrame, key: str, prompt: str, answerer: Answerer, retry: Retry = Retry()) -> DataFrame:
    """key, answer and error of each prompt; an empty answer is an error, and a failed call doesn't end the run."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                try:
                    said = retry.call(answerer.answer, text or "")
                    out.append((k, said or None, None if said else "empty answer"))
                except Exception as e:
                    out.append((k, None, str(e)))
            names, kinds = ["key", "answer", "error"], [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)], names=names)

    return df.select(F.col(key).cast("string").alias("key"), prompt).mapInArrow(batches, "key string, answer string, error string")

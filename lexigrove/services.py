"""Borders to models and services outside: protocols, retries, and stubs that need no network."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.graph import context_path
from .schemas import EXTRACTION


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def __call__(self, prompt: str) -> dict: ...


class Decider(Protocol):
    def __call__(self, state: dict, questions: dict) -> dict[str, float]: ...


class Answerer(Protocol):
    def __call__(self, question: str, context: str) -> str: ...


def hashing_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stub: signed counts of hashed words, as unit vectors."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def encoded(texts: DataFrame, encoder: Encoder, id_col: str = "node_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(node_id, embedding): texts through an encoder, in batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"node_id": part.iloc[:, 0], "embedding": encoder(part.iloc[:, 1].tolist())})

    return texts.select(F.col(id_col).cast("string").alias("node_id"), F.col(text_col).alias("text")).mapInPandas(run, "node_id string, embedding array<float>")


def with_retries(call: Callable, attempts: int = 3, first: float = 2.0, most: float = 10.0, fallback: Callable | None = None, sleep=time.sleep):
    """A call that is tried again after exponential waits; after the last failure `fallback(error)`, or the error."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception as e:  # noqa: BLE001  any failure of a service
                if n == attempts - 1:
                    if fallback is None:
                        raise
                    return fallback(e)
                sleep(min(most, first * 2**n))

    return run


EMPTY_EXTRACTION = {"entities": [], "relations": []}


def prompts(nodes: DataFrame, template: str = "Context:\n{context}\n\nTarget:\n{target}") -> DataFrame:
    """(node_id, prompt): the lines of the ancestors up to the article, and the node itself."""
    before, rest = template.split("{context}")
    between, after = rest.split("{target}")
    target = F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.concat_ws(" - ", "title", "text"))
    return nodes.join(context_path(nodes), "id").select(F.col("id").alias("node_id"), F.concat(F.lit(before), "context", F.lit(between), target, F.lit(after)).alias("prompt"))


def extracted(nodes: DataFrame, routes: DataFrame, extractor: Extractor, limit: int | None = None) -> DataFrame:
    """Extractions (schema EXTRACTION) of the nodes routed to the model; a node that fails has an empty one."""
    chosen = routes.where("route = 'LLM_CANDIDATE'").select("node_id")
    asked = prompts(nodes).join(chosen, "node_id", "left_semi")
    if limit is not None:
        asked = asked.orderBy("node_id").limit(limit)
    safe = with_retries(extractor, fallback=lambda _: EMPTY_EXTRACTION)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [safe(p) for p in f["prompt"]]
            yield pd.DataFrame({"node_id": f["node_id"], "found": [json.dumps(x, ensure_ascii=False) for x in found]})

    told = asked.mapInPandas(run, "node_id string, found string")
    body = EXTRACTION.split(", ", 1)[1]
    return told.withColumn("x", F.from_json("found", body)).select("node_id", "x.entities", "x.relations")


def parse_decision(payload: str, expected: list[str]) -> dict[str, float]:
    """The answers of a decision service: exactly the expected keys, each a probability."""
    answers = json.loads(payload)["answers"]
    if sorted(answers) != sorted(expected):
        raise ValueError("the answers are not those that were asked for")
    out = {k: float(v) for k, v in answers.items()}
    if any(not 0 <= v <= 1 for v in out.values()):
        raise ValueError("a probability is outside 0 to 1")
    return out


def answer(question: str, context: str, answerer: Answerer) -> str:
    said = answerer(question, context)
    if not said or not said.strip():
        raise ValueError("the model gave no answer")
    return said

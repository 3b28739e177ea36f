"""Plug points for models, each loaded once for a task, and defaults that need none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.cluster import ship


def hashed_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(id, slot, value): signed feature hashing of terms by MD5, L2-normalised; slots without weight are left out. docs: id, text."""
    t = docs.select("id", F.explode(terms(F.col("text"))).alias("term")).withColumn("h", F.md5(F.col("term").cast("binary")))
    slot = F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % dim
    sign = F.when(F.conv(F.substring("h", 5, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    v = t.groupBy("id", slot.alias("slot")).agg(F.sum(sign).alias("w")).where("w <> 0")
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, "id").select("id", "slot", F.round(F.col("w") / F.col("norm"), 9).alias("value"))


def hashing_model(dim: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A loader for `embed` that needs no weights: signed feature hashing of a text's terms, L2-normalised; no terms, all zeros."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        word, known = re.compile(r"[^\W_]+"), {}

        def place(term: str) -> tuple[int, float]:
            if term not in known:
                if len(known) > 200_000:
                    known.clear()
                h = md5(term.encode(), usedforsecurity=False).digest()
                known[term] = int.from_bytes(h[:2]) % dim, 1.0 if h[2] < 128 else -1.0
            return known[term]

        def model(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts, strict=True):
                for term in word.findall(text.lower()):
                    slot, sign = place(term)
                    row[slot] += sign
            return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).tolist()

        return model

    return load


def embed(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = 16, prefix: str = "passage: ", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(`keys`, vector) by a model that `load` makes in each task. A vector of another length is an error; null texts are skipped."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for df in frames:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch]
                vectors = [list(map(float, v)) for v in model([prefix + t for t in part["text"]])]
                if any(len(v) != dim for v in vectors):
                    raise ValueError(f"vectors must have {dim} numbers")
                yield part[list(keys)].assign(vector=vectors)

    return docs.where("text IS NOT NULL").select(*keys, "text").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", vector array<double>")


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> DataFrame:
    """(query_id, id, score): sigmoid of a pair scorer's logits. pairs: query_id, id, question, passage."""

    ship(pairs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for df in frames:
            yield pd.DataFrame({"query_id": df["query_id"], "id": df["id"], "logit": model(df["question"].tolist(), df["passage"].tolist())})

    scored = pairs.select("query_id", "id", "question", "passage").mapInPandas(run, "query_id long, id long, logit double")
    return scored.select("query_id", "id", (1 / (1 + F.exp(-F.col("logit")))).alias("score"))

"""Embedders of texts and queries: hashed tokens, or a file of word vectors; chosen by name."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.operators.vectors import BUCKETS, HASH_ID, hash_embedding, static_embedding


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", query.lower()) if len(t.encode()) > 1]


def unit(v: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


@dataclass
class Embedder:
    """Hashed tokens; ``id`` and ``dim`` say whose vectors a store holds."""

    id: str = HASH_ID
    dim: int = BUCKETS

    def vectors(self, texts: DataFrame, *keep: str) -> DataFrame:
        """``id, vec`` and the columns ``keep`` of ``texts(id, text)``; blank texts are left out."""
        return texts.where(F.trim("text") != "").select("id", hash_embedding(F.col("text")).alias("vec"), *keep)

    def query_vector(self, query: str) -> list[float]:
        """The vector of a query, as ``vectors`` has it for texts."""
        v = [0.0] * BUCKETS
        for t in query_tokens(query):
            h = hashlib.sha256(t.encode()).digest()
            v[h[0]] += 1.0 if h[4] & 1 else -1.0
        return unit(v)


class WordVectors(Embedder):
    """The mean of the vectors of a text's known words; texts without one are left out."""

    def __init__(self, spark: SparkSession, path: str):
        from tracegraph.sources.repository import vector_file_id, word_vectors

        self.table = word_vectors(spark, path)
        first = self.table.select(F.size("vec")).first()
        if first is None:
            raise ValueError(f"{path} has no word vectors")
        super().__init__(vector_file_id(path), first[0])

    def vectors(self, texts: DataFrame, *keep: str) -> DataFrame:
        # A text may be there several times; each distinct one of an id is embedded once.
        named = texts.where(F.trim("text") != "").select(F.struct("id", *keep).alias("row"), "text")
        return static_embedding(named, self.table, "row", "text").select("id.id", "vec", *[f"id.{k}" for k in keep])

    def query_vector(self, query: str) -> list[float]:
        words = query_tokens(query)
        known = {r["token"]: r["vec"] for r in self.table.where(F.col("token").isin(*set(words))).collect()} if words else {}
        found = [known[w] for w in words if w in known]
        return unit([sum(x) / len(found) for x in zip(*found)]) if found else [0.0] * self.dim


def choose(spark: SparkSession, backend: str = "hash", model: str | None = None) -> Embedder:
    """``hash``, or ``static`` (also ``localmodel``) with the file of its word vectors; anything else is refused."""
    if backend == "hash":
        return Embedder()
    if backend in ("static", "localmodel"):
        if not model:
            raise ValueError(f"{backend} needs a file of word vectors")
        return WordVectors(spark, model)
    raise ValueError(f"unknown embedder {backend!r}: hash, static or localmodel")


"""Embeddings of observations and symbols behind one interface, kept by (id, model, revision)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import cosine
from lodestone.operators.memory import NOISE_KINDS


class Embedder:
    """Texts to vectors of one length. Subclasses give ``model_id``, ``model_rev``, ``dims`` and ``embed``."""

    model_id: str
    model_rev: str
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def column(self, text: Column) -> Column:
        """The vector of a text column, batch by batch on the executors."""
        embed = self.embed

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(embed(texts.fillna("").tolist()))

        return F.pandas_udf(run, "array<float>")(text)


@dataclass
class ByteHashEmbedder(Embedder):
    """Deterministic vectors from bytes, for use without a model: bytes are dealt to the coordinates in turn."""

    dims: int = 32
    model_id: str = "byte-hash"
    model_rev: str = "1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.float32)
            padded = np.concatenate([(raw - 128) / 128, np.zeros(-len(raw) % self.dims, np.float32)]).reshape(-1, self.dims).sum(0)
            norm = float(np.sqrt((padded * padded).sum()))
            out.append((padded / norm if norm > 0 else padded).tolist())
        return out


def observation_text() -> Column:
    """Kind, content and anchors of an observation, as it is embedded."""
    return F.concat_ws(" ", "kind", "content", "symbol_fqn", "file_path")


def symbol_text() -> Column:
    """Names, signature and documentation of a symbol; null if there is nothing but the fqn."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "signature", "docstring")]
    return F.when(F.concat(*parts) != "", F.trim(F.concat_ws(" ", F.col("fqn"), *parts)))


def of_model(stored: DataFrame, embedder: Embedder) -> DataFrame:
    return stored.where((F.col("model_id") == embedder.model_id) & (F.col("model_rev") == embedder.model_rev))


def unembedded_observations(obs: DataFrame, stored: DataFrame, embedder: Embedder) -> DataFrame:
    """Observations worth a vector that have none of this model: not stale, not merged, no noise."""
    worth = ~F.col("is_stale") & ~F.col("kind").isin(NOISE_KINDS) & F.col("consolidated_into").isNull()
    return obs.where(worth).join(of_model(stored, embedder).select(F.col("id").alias("obs_id")), "obs_id", "left_anti")


def unembedded_symbols(symbols: DataFrame, stored: DataFrame, embedder: Embedder) -> DataFrame:
    return symbols.where(symbol_text().isNotNull()).join(of_model(stored, embedder).select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")


def embedded(rows: DataFrame, ident: str, text: Column, embedder: Embedder, now: Column) -> DataFrame:
    """New rows of the vector table: id, model_id, model_rev, dims, embedding, created_at."""
    return rows.select(F.col(ident).alias("id"), F.lit(embedder.model_id).alias("model_id"), F.lit(embedder.model_rev).alias("model_rev"), F.lit(embedder.dims).alias("dims"), embedder.column(text).alias("embedding"), now.cast("long").alias("created_at"))


def replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Vector table after an upsert by id: what is new replaces what was there, of any model."""
    return stored.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def cleared(stored: DataFrame) -> DataFrame:
    """The empty table a rebuild starts from."""
    return stored.where(F.lit(False))


def similarities(stored: DataFrame, ids: DataFrame, query: str, embedder: Embedder, name: str = "id") -> DataFrame:
    """Cosine of a question to the stored vectors of some ids: name, similarity."""
    (vector,) = embedder.embed([query])
    wanted = of_model(stored, embedder).join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")
    target = F.array(*[F.lit(float(x)) for x in vector])
    return wanted.select(F.col("id").alias(name), cosine(F.col("embedding"), target).alias("similarity"))

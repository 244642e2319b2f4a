"""Where a model would be: texts in, one vector for each layer out, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


class Embedder(Protocol):
    """Loaded once for each task; ``embed`` gives (layer, vectors) for a batch of texts."""

    layers: tuple[int, ...]
    #: Numbers that the model has learned.
    parameters: int

    def embed(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: each token adds a signed one at a hashed place.

    A token is a run of ``[^\\x20\\x09-\\x0D]`` of the lower-cased text; its place and
    sign come from the first 32 bits of an md5, so SQL can state the model.  Texts are
    cut to ``most`` tokens, as the model's window is; the mean runs over a text's own
    tokens only, so padding can't change it.  An empty text has the zero vector.
    """

    parameters = 0

    def __init__(self, dim: int = 16, layers: Iterable[int] = (0, 1, 2, 3), most: int = 128):
        self.dim, self.layers, self.most = dim, tuple(layers), most

    def embed(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        tokens = [TOKEN.findall(t.lower())[: self.most] for t in texts]
        for layer in self.layers:
            out = np.zeros((len(texts), self.dim))
            for row, words in zip(out, tokens, strict=True):
                for w in words:
                    h = int(hashlib.md5(f"{layer}:{w}".encode()).hexdigest()[:8], 16)
                    row[h % self.dim] += 1.0 if h & 0x10000 else -1.0
                row /= max(1, len(words))
            yield layer, out


def embed(df: DataFrame, embedder: Embedder, id_col: str = "query_id", text_col: str = "text", batch: int = 16) -> DataFrame:
    """(query_id, layer, vec): every text once, all layers from the same pass; a NULL text is empty."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for layer, vecs in embedder.embed(part["text"].fillna("").tolist()):
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "layer": layer, "vec": list(vecs)})

    base = df.selectExpr(f"`{id_col}` AS query_id", f"`{text_col}` AS text")
    return base.mapInPandas(run, f"query_id {dict(base.dtypes)['query_id']}, layer int, vec array<double>")
